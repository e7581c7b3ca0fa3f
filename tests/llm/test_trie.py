"""The prefix trie against one built turn by turn."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("sievemark.llm.queries")

from sievemark.llm import trie  # noqa: E402

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, class string, size int"


def said(rows):
    out = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            out.setdefault(c, []).append((t is not None, t or 0, r, digest, x))
    return {c: [(r, x) for _, _, r, _, x in sorted(own)] for c, own in out.items()}


def rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(convs):
    """A dictionary from each sequence of first turns to its members, and from there the rest."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    inside = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        below = [inside[k] for k in kids.get(path, [])]
        inside[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = set()
    for path, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(kids.get(path, [])), *inside[path], sha))
    return out


def rows():
    rng = np.random.default_rng(3)
    texts = ["hello", "", None, "wörld", "x" * 300]
    out = []
    for c in [*range(40), -3, -7, 10**15, 60, 61, 62]:
        for t in range(int(rng.integers(1, 12))):
            out.append((c, t if t else None, ["user", None][int(rng.integers(8)) // 7], texts[int(rng.integers(3 if t < 4 else 5)) % 5]))
    for c in (70, 71, 72, 75, 80):  # copies, one of them a prefix of the others
        out += [(c, t, "user", f"copy {t}") for t in range(30 if c < 80 else 20)]
    out += [(90, 1, "user", "a"), (90, 1, "user", "b"), (90, 1, "user", "a"), (None, 0, "user", "lost")]
    return [(*r, 0, "x", 1) for r in out]


@pytest.mark.parametrize("mode", ["rebuilt", "plain"])
def test_trie_against_paths(spark, mode):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    own = said([r[:4] for r in data])
    found = trie.rebuilt_trie(frame) if mode == "rebuilt" else trie.prefix_trie(frame)
    got = [tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    want = brute(rebuilt(own) if mode == "rebuilt" else own)
    assert len(got) == len(want) and set(got) == want
    if mode == "plain":
        for r in trie.with_turns(found, frame).collect():
            assert (r.role, r.text) == (own[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_copies_take_no_rounds(spark, tmp_path):
    turns = spark.createDataFrame([(c, d, f"turn {d}", 10) for c in (1, 2, 3) for d in range(1, 200)], "conv_id bigint, depth bigint, digest string, size bigint")
    assert trie._refine(turns.select("conv_id").distinct(), turns, tmp_path.as_uri()) == 0


def test_one_or_no_conversation(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.rebuilt_trie(none).count() == 0
    one = trie.prefix_trie(spark.createDataFrame([(5, 0, "user", "hi", 0, "x", 1)], SCHEMA)).orderBy("depth").collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in one] == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]


def test_segments_join_into_one_hash(spark, monkeypatch):
    ids = [*range(-5, 20_000, 3)]
    ends = spark.createDataFrame([(2, 7, i) for i in reversed(ids)] + [(3, 7, 4)], "depth bigint, class bigint, conv_id bigint").repartition(4)
    found = {(r.depth, r["class"]): r.sha for r in trie.ends_sha256(ends).collect()}
    assert found == {(2, 7): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (3, 7): hashlib.sha256(b"4").hexdigest()}
