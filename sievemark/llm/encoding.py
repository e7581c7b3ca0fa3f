"""Encoding of whole texts with the ``tokenizers`` library, and where encoded files live.

A byte-level BPE file without a normaliser never merges across the start of a white-space run, so a text is encoded as its
white-space separated segments. Each distinct segment of a batch is looked up once, and frequent ones are encoded once per worker: a memo bounded by bytes, in two halves. When the young
half is full it becomes the old one, and what is still asked for comes back from there. The ids are those that the library gives for
the whole text; tests hold the two against each other. Other tokenizer files, and texts that hold the string of a special token, are encoded whole.

Special tokens: with ``literal`` their strings in a text are ordinary text (flat files need that, as an end id must only end documents);
without, they become their ids, which is the library's own default.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Unicode White_Space, which is what ``\s`` means to the library.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of the memo in a worker, both halves together; bytes of an entry besides its text and ids; the longest segment that is kept.
MEMO_BYTES, ENTRY_BYTES, MEMO_CHARS = 48 << 20, 150, 64
#: Words encoded by one call; pieces whose ids are put in their places at once.
WORDS_AT_ONCE, PIECES_AT_ONCE = 512, 1 << 18

_SPACE = re.compile(f"[{SPACES}]")
#: Two in a row, as Arrow's regular expressions spell it.
_RUN = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Letters of Latin-1 and sentence punctuation: between the two, the library always cuts.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

class Memo:
    """Ids of segments: two generations of at most half of ``limit`` bytes each."""

    def __init__(self, limit: int):
        self.half = limit // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def put(self, key: str, ids: bytes) -> None:
        self.young[key] = ids
        self.size += ENTRY_BYTES + len(key) + len(ids)
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0

    def put_all(self, found: dict[str, bytes]) -> None:
        """Many entries of one size class at once; they may overstep the half by themselves."""
        self.young.update(found)
        self.size += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0

    def recall(self, key: str) -> bytes | None:
        """From the old half, which makes it young again."""
        ids = self.old.get(key)
        if ids is not None:
            self.put(key, ids)
        return ids


class Encoder:
    def __init__(self, path: str, literal: bool = False, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, k in vocab.items():
            self.opens[k] = token.startswith("Ġ")  # the byte-level name of a space
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.cuttable = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = [t["content"] for t in kind.get("added_tokens") or [] if not (literal and t.get("special"))]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo = Memo(memo_bytes)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by the library alone."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (any piece without white space) after a space; one call for many."""
        out: list[bytes] = []
        for k in range(0, len(words), WORDS_AT_ONCE):
            some = words[k : k + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(some):
                out += self.whole([f" {w}" for w in some])
                continue
            data, cuts = ids.tobytes(), (starts * self.dtype.itemsize).tolist()
            out += [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces; a piece stands for a space and itself, or for itself if it begins with a line feed."""
        words: list[str] = []
        ended: list[tuple[str, str]] = []
        rest: list[str] = []
        for p in pieces:
            if p.isalpha() and (p.isascii() or _WORD.fullmatch(p)):
                words.append(p)
                continue
            w = p.rstrip(".,;:!?")
            if w.isalpha() and len(w) < len(p) and (w.isascii() or _WORD.fullmatch(w)):
                ended.append((p, w))
            else:
                rest.append(p)
        found = dict(zip(words, self._words(words)))
        young, old = self.memo.young.get, self.memo.old.get
        stems = {w: found.get(w) or young(w) or old(w) for _, w in ended}
        new = [w for w, ids in stems.items() if ids is None]
        stems.update(zip(new, self._words(new)))
        tails = dict.fromkeys(p[len(w) :] for p, w in ended)
        tails.update(zip(tails, self.whole(list(tails))))
        for p, w in ended:
            found[p] = stems[w] + tails[p[len(w) :]]
        # A space belongs to what follows it, and nothing else opens with one: pieces without white space go together as words do.
        odd = [p for p in rest if not p or _SPACE.search(p)]
        joined = [p for p in rest if p and not _SPACE.search(p)] if odd else rest
        found.update(zip(joined, self._words(joined)))
        found.update(zip(odd, self.whole([p if p[:1] == "\n" else f" {p}" for p in odd])))
        self.memo.put_all({p: ids for p, ids in found.items() if len(p) <= MEMO_CHARS})
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, as ``dtype`` items."""
        if not self.cuttable:
            return self.whole(texts)
        plain: list[str] = []
        odd: dict[int, bytes] = {}
        runs = pc.match_substring_regex(pa.array(texts, pa.large_string()), _RUN).to_pylist()
        for k, t in enumerate(texts):
            if self.added and self.added.search(t):
                odd[k] = self.whole([t])[0]
            elif runs[k]:  # white-space runs: rare, and cut by the general rule
                odd[k] = b"".join(self.whole(_SEGMENT.findall(t)))
            else:
                plain.append(t.replace("\n", " \n"))
        done = iter(self._plain(plain) if plain else ())
        return [odd[k] if k in odd else next(done) for k in range(len(texts))]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts cut at single spaces: each distinct piece is looked up once, and its ids go to wherever it stands."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, pieces = parts.offsets.to_numpy(), parts.flatten()
        heads = self.whole(pieces.take(pa.array(bounds[:-1])).to_pylist())
        behind = np.ones(len(pieces), bool)
        behind[bounds[:-1]] = False
        coded = pieces.filter(pa.array(behind)).dictionary_encode()
        found = self._ids(coded.dictionary.to_pylist())
        data, size = np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        start, at = np.cumsum(size) - size, coded.indices.to_numpy()
        out, ends = [], np.zeros(len(at) + 1, np.int64)
        np.cumsum(size[at], out=ends[1:])
        for k in range(0, len(at), PIECES_AT_ONCE):
            some = at[k : k + PIECES_AT_ONCE]
            first = int(ends[k])
            shift = (start[some] - ends[k : k + len(some)] + first).astype(np.int32)
            where = np.repeat(shift, size[some])
            where += np.arange(len(where), dtype=np.int32)
            out.append(data.take(where).tobytes())
        whole = memoryview(b"".join(out))
        cuts = (ends[bounds - np.arange(len(bounds))] * self.dtype.itemsize).tolist()
        return [head + whole[a:b] for head, a, b in zip(heads, cuts, cuts[1:])]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some distinct pieces."""
        found = list(map(self.memo.young.get, pieces))
        holes = [i for i, ids in enumerate(found) if ids is None]
        for i in holes:
            found[i] = self.memo.recall(pieces[i])
        holes = [i for i in holes if found[i] is None]
        if holes:
            new = self._learn([pieces[i] for i in holes])
            for i in holes:
                found[i] = new[pieces[i]]
        return found


def encoder(path: str, literal: bool = False, memo_bytes: int = MEMO_BYTES) -> Encoder:
    """One per worker process; another file's, or another operator's table, takes its place."""
    return held(("encoder", path, literal, memo_bytes), lambda: Encoder(path, literal, memo_bytes))


def filesystem(uri: str):
    """(file system, path) of a folder that the driver and all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else uri)
