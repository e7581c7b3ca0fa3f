"""Spelling variants: every word points to the much commoner word that differs by one inserted, deleted or replaced letter.

A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, of at least ``MIN_CHARS`` code points and ``MIN_COUNT``
occurrences overall. Words of a corpus with planted misspellings: if ``TYPO_EVERY`` divides h, the unsigned crc32 of
``<doc_id>:<run>``, the run's code point h % length goes (:func:`word_counts` does it only if asked).

Rolling-hash deletions. A word's prefix and suffix polynomial hashes (mod 2^64) give the hash of the word without its k-th letter, for
all k and a whole batch of words, in a few NumPy operations; the word itself has one more key. Two words differ by one
replaced letter exactly if they are equal without the letter at one same place, and by one inserted or deleted letter exactly if one
without some letter is the other. Keys are dealt by their leading bits (radix), sorted within each partition, and read as a stream;
keys that meet are verified on the strings. Every near pair meets under exactly one key, so counts are sums.

No pairs are listed: of the words equal without their k-th letter only the two most frequent matter to the others, and a word and those that
become it by a deletion are a star. A key holds at most as many words as the alphabet has letters for each place, so no group is unbounded.

Words over ``LONG`` code points don't carry their text with every key: their keys are counted first, and only those that occur
twice get it.

Forms lead from word to word with ten times the count at least, so chains have at most 18 links, and doubling them ends after 5 rounds.

Edge cases: a null or empty text has no words; a null ``doc_id`` counts as an empty string in h; repeated rows count again; an empty table
gives no row; ties go to the smallest word in code-point order. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

MIN_CHARS, MIN_COUNT = 7, 2
#: A form has at least so many times the word's occurrences.
TIMES = 10
TYPO_EVERY = 31
#: Words that a task counts before it hands them on.
COUNTED_AT_ONCE = 200_000
#: Code points of a word that carries its text with each key; positions of a longer word hashed at once.
LONG, BLOCK = 64, 1 << 18
#: Leading bits of a key by which keys are dealt.
RADIX_BITS = 16

#: Letters stay (A-Z lower-cased), all else separates words; in Latin-1 a letter is a byte.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


# -- words -------------------------------------------------------------------------------------------------------------


def runs(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def with_typo(owner: int, run: bytes) -> bytes:
    """``run`` as it counts; ``owner`` is the crc32 of what stands before it in h."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), owner)
    if h % TYPO_EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counter(least: int, typos: bool):
    def batch_of(found: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                owner = zlib.crc32(f"{doc_id or ''}:".encode())
                for w, n in Counter(w for w in runs(text) if len(w) >= least).items():
                    w = with_typo(owner, w) if typos else w
                    if len(w) >= least:
                        found[w] += n
                if len(found) > COUNTED_AT_ONCE:
                    yield batch_of(found)
                    found.clear()
        if found:
            yield batch_of(found)

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHARS, typos: bool = False) -> DataFrame:
    """(word, n) of all words with at least ``MIN_COUNT`` occurrences."""
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = map_arrow(slim, _counter(least, typos), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# -- deletion keys -----------------------------------------------------------------------------------------------------


def _powers(n: int, start: int = 0) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = pow(_BASE, start, 1 << 64)
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the hash over the leading bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, deleted place or -1, key) of the words and all their deletions."""
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(data)) - starts[own]
    value = _VALUES[data] * _powers(int(lengths.max(initial=0)))[at]
    upto = np.cumsum(value, dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), upto])
    prefix = upto - value - before[starts][own]
    total = before[starts + lengths] - before[starts]
    suffix = total[own] - prefix - value
    keys = np.concatenate([_mixed(prefix + _INVERSE * suffix), _mixed(total)])
    return np.concatenate([own, np.arange(len(words))]), np.concatenate([at, np.full(len(words), -1)]), keys


def long_word_keys(word: bytes, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(deleted place or -1, key) of one word, a block of places at a time."""
    data = np.frombuffer(word, np.uint8)
    value = lambda a: _VALUES[data[a : a + block]] * _powers(len(data[a : a + block]), a)
    total = np.uint64(sum(int(value(a).sum(dtype=np.uint64)) for a in range(0, len(data), block)) % (1 << 64))
    yield np.array([-1]), _mixed(np.array([total]))
    done = np.zeros(1, np.uint64)
    for a in range(0, len(data), block):
        v = value(a)
        prefix = done + np.cumsum(v, dtype=np.uint64) - v
        yield np.arange(a, a + len(v)), _mixed(prefix + _INVERSE * (total - prefix - v))
        done = prefix[-1:] + v[-1:]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word")
        own, at, keys = deletion_keys([w.encode("latin-1") for w in words.to_pylist()])
        pick = pa.array(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at.astype(np.int32)), words.take(pick), batch.column("n").take(pick)], names=["key", "at", "word", "n"])


def _keyed_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for owner, word in zip(batch.column("owner").to_pylist(), batch.column("word").to_pylist()):
            for at, keys in long_word_keys(word.encode("latin-1")):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), owner))], names=["key", "at", "owner"])


def _rows(words: DataFrame, long: int) -> DataFrame:
    """(key, at, word, n): every key of the short words, and those of the long ones that another word has too."""
    rows = map_arrow(words.where(F.length("word") <= long), _keyed, "key bigint, at int, word string, n bigint")
    tagged = materialize(words.where(F.length("word") >= long).withColumn("owner", F.monotonically_increasing_id()), "long-words")
    if tagged.where(F.length("word") > long).isEmpty():
        return rows
    keys = materialize(map_arrow(tagged.select("owner", "word"), _keyed_long, "key bigint, at int, owner bigint"), "long-keys")
    twice = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    return rows.unionByName(keys.join(twice, "key").join(tagged, "owner").where(F.length("word") > long).select("key", "at", "word", "n"))


# -- meetings ----------------------------------------------------------------------------------------------------------


def _best_two(members: list[tuple[int, str]]) -> tuple[tuple[int, str], tuple[int, str] | None]:
    """The first two of (-n, word)."""
    first = min(members)
    return first, min((m for m in members if m is not first), default=None)


def met(rows: Iterator[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n and word of the best of them) from the (place, word, n) that share a key; strings decide."""
    groups: dict[str, list[tuple[int, str, int]]] = defaultdict(list)
    for at, word, n in rows:
        groups[word if at < 0 else word[:at] + word[at + 1 :]].append((at, word, n))
    for group in groups.values():
        if len(group) < 2:
            continue
        places: dict[int, list[tuple[int, str]]] = defaultdict(list)
        centre, longer = None, []
        for at, word, n in group:
            if at < 0:
                centre = (-n, word)
                continue
            places[at].append((-n, word))
            if not at or word[at - 1] != word[at]:  # of equal neighbours the first stands for all
                longer.append((-n, word))
        for members in places.values():
            if len(members) > 1:
                first, second = _best_two(members)
                for m in members:
                    best = second if m is first else first
                    yield m[1], len(members) - 1, -best[0], best[1]
        if centre and longer:
            best = min(longer)
            yield centre[1], len(longer), -best[0], best[1]
            for m in longer:
                yield m[1], 1, -centre[0], centre[1]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last key of a batch waits for the next one."""
    names = ["word", "n_near", "best_n", "best"]
    types = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def links(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        shared = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        some = rows.take(pa.array(shared))
        found = list(met(zip(*(some.column(c).to_pylist() for c in ("at", "word", "n")))))
        return pa.RecordBatch.from_pydict(dict(zip(names, zip(*found))) if found else {c: [] for c in names}, types)

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not len(rows):
            continue
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        held = rows.slice(cut)
        if cut:
            yield links(rows.slice(0, cut))
    if held is not None:
        yield links(held)


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has a near word: how many, and the one of largest n."""
    dealt = _rows(words, long).repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    links = map_arrow(dealt, _meetings, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


# -- forms and roots ---------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of (word, form): the end of its chain of forms."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("to"))
        if found.join(further, "root", "left_semi").isEmpty():
            return found
        found = materialize(found.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root")), "roots")


def variants_of(words: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    words = materialize(words, "words")
    near = near_words(words, long)
    strong = F.col("best_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    found = materialize(found, "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", typos: bool = False) -> DataFrame:
    """Spelling variants among the words of ``docs``."""
    return variants_of(word_counts(docs, doc_id, text, typos=typos))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a DuckDB string of Latin-1 code points, of its UTF-8 bytes."""
    byte = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"
    turn = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {turn})), 4294967295)"


ORACLE = f"""
WITH r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM documents),
c AS (SELECT doc_id, r, count(*) AS n FROM r WHERE length(r) >= 7 GROUP BY doc_id, r),
h AS (SELECT r, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || r")} AS h FROM c),
t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other FROM k a JOIN k b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word FROM k JOIN w ON k.d = w.word
  UNION SELECT w.word, k.word FROM k JOIN w ON k.d = w.word),
b AS (SELECT p.word, count(*)::BIGINT AS n_near, min({{'n': -o.n, 'w': other}}) AS best FROM p JOIN w o ON o.word = other GROUP BY p.word),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.n >= 10 * w.n THEN best.w END AS form, CASE WHEN -best.n >= 10 * w.n THEN -best.n END::BIGINT AS form_n
  FROM w LEFT JOIN b USING (word)),
up AS (
  WITH RECURSIVE u AS (SELECT word, form AS up_to FROM f WHERE form IS NOT NULL UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.up_to WHERE f.form IS NOT NULL)
  SELECT u.word, up_to AS root FROM u JOIN f ON f.word = u.up_to WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN up USING (word)
"""
