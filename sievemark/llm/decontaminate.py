"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to lower-case words. Every window of ``WINDOW`` consecutive words of an item is a pattern; an item of fewer
words is one pattern. To the automaton each word of the benchmark is two characters, a high and a low one, and any other word two blanks; it
scans a document once, in runs of bounded size, and ends are mapped back to offsets in the original text.

An automaton has at most 2 * ``WINDOW`` nodes per window, and ``BLOCK_NODES`` at most. A larger benchmark is split into blocks of windows (long
items in pieces that overlap by ``WINDOW`` - 1 words), each with its own automaton and its own pass; one block at a time comes to the
driver, and the passes' hits are merged per document. Nothing of the corpus is collected.

Edge cases: a null or empty text has no words and no hits; a null item text has no window; items that repeat an
``item_id`` count once; a null ``item_id`` counts as one item and is written ``null``. Rows that repeat stay, each judged by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, held, map_arrow, materialize, text_bytes

WINDOW = 10
#: Nodes of one automaton at most: measured, some 40 bytes each, and as much again for the windows and their owners.
BLOCK_NODES = 3_000_000
#: Words of an item in one piece at most, of blocks of so many nodes.
PIECE_SHARE = 32

# a-z and 0-9 and every byte of a non-ASCII character stay, A-Z become lower case, the rest separates words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

Piece = tuple[str, str]


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(NORMAL).split() if data else []


def _letters(k: int) -> str:
    """Two characters of two ranges, so that no match begins within a word."""
    return chr(0x4000 + (k >> 8)) + chr(0x100 + (k & 255))


class Automaton:
    """The windows of some pieces of items; ``keys`` are their ids."""

    def __init__(self, pieces: list[Piece]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.keys = sorted({k for k, _ in pieces})
        place = {k: i for i, k in enumerate(self.keys)}
        owners: dict[str, set[int]] = {}
        for key, text in pieces:
            codes = [self.letters.get(w) or self.letters.setdefault(w, _letters(len(self.letters))) for w in words_of(text.encode())]
            for i in range(max(1, len(codes) - WINDOW + 1) if codes else 0):
                owners.setdefault("".join(codes[i : i + WINDOW]), set()).add(place[key])
        self.search = ahocorasick.Automaton()
        for window, ks in owners.items():
            self.search.add_word(window, (len(window) // 2, tuple(sorted(ks))))
        self.empty = not owners
        if owners:
            self.search.make_automaton()

    def scan(self, data: bytes | None) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items whose windows occur. Runs overlap by WINDOW - 1 words, so no window is lost."""
        steps: list[tuple[int, int]] = []
        found: set[int] = set()
        n, carry = 0, ""
        for run in byte_runs(data.translate(NORMAL)) if data else ():
            words = run.split()
            if not self.empty:
                text = carry + "".join(map(self.letters.get, words, repeat("  ")))
                base = n - len(carry) // 2
                for end, (length, ks) in self.search.iter(text):
                    upto = base + end // 2 + 1
                    steps.append((upto - length, upto))
                    found.update(ks)
                carry = text[-2 * (WINDOW - 1) :]
            n += len(words)
        edges = np.zeros(n + 1, np.int32)
        if steps:
            begins, ends = np.array(steps).T
            np.add.at(edges, begins, 1)
            np.add.at(edges, ends, -1)
        return np.cumsum(edges)[:n] > 0, found


def original_spans(data: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of maximal runs of hit words in the original text."""
    keep = np.frombuffer(data.translate(NORMAL), np.uint8) != 32
    steps = np.diff(np.concatenate(([0], keep.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [(int(begins[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1))]


def _built(pieces: list[Piece]) -> Automaton:
    return held(("automaton", hashlib.sha256(repr(pieces).encode()).hexdigest()), lambda: Automaton(pieces))


def _matcher(pieces: list[Piece]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(pieces)
        for batch in batches:
            n_words, n_hit, ids, spans = [], [], [], []
            for data in text_bytes(batch.column("text")):
                hit, found = automaton.scan(data)
                n_words.append(len(hit))
                n_hit.append(int(hit.sum()))
                ids.append(sorted({automaton.keys[k] for k in found}))
                spans.append([{"start": a, "end": b} for a, b in original_spans(data, hit)] if found else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(ids, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return run


SCHEMA = "doc_id {id}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def _pieces(words: int):
    """(item, text, nodes): items of normalised words, long ones in pieces of ``words`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column("i").to_pylist(), text_bytes(batch.column("t"))):
                all_words = words_of(data)
                last = max(1, len(all_words) - WINDOW + 1) if all_words else 0
                cuts = [all_words[k : min(k + words, last) + WINDOW - 1] for k in range(0, last, words)]
                texts = [b" ".join(c).decode("utf-8", "replace") for c in cuts]
                nodes = [2 * max(1, len(c) - WINDOW + 1) * min(WINDOW, len(c)) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cuts), pa.string()), pa.array(texts, pa.string()), pa.array(nodes, pa.int64())], names=["item", "text", "nodes"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_nodes: int) -> tuple[int, Iterator[list[Piece]]]:
    """The number of blocks, and the blocks: pieces of items with ``block_nodes`` nodes at most together, brought one at a time."""
    slim = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull()).distinct()
    pieces = materialize(map_arrow(slim, _pieces(max(1, block_nodes // (2 * WINDOW) // PIECE_SHARE)), "item string, text string, nodes bigint").distinct(), "benchmark")
    total, largest = pieces.agg(F.coalesce(F.sum("nodes"), F.lit(0)), F.coalesce(F.max("nodes"), F.lit(0))).first()
    block_nodes = max(block_nodes, largest)
    n = 1 if total <= block_nodes else -(-2 * total // block_nodes)
    block = lambda: F.pmod(F.xxhash64("item", "text"), F.lit(n))
    while n > 1 and pieces.groupBy(block().alias("b")).agg(F.sum("nodes").alias("n")).agg(F.max("n")).first()[0] > block_nodes:
        n *= 2

    def each() -> Iterator[list[Piece]]:
        for k in range(n):
            part = pieces if n == 1 else pieces.where(block() == k)
            yield sorted((r.item, r.text) for r in part.select("item", "text").collect())  # block_nodes nodes at most

    return n, each()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_nodes: int = BLOCK_NODES
) -> DataFrame:
    """One row per document: words, hit words, ids of the items whose windows occur, and hit spans as byte offsets of the original text."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(id=id_type)
    n, blocks = _blocks(benchmark, item_id, item_text, block_nodes)
    if n == 1:
        return map_arrow(slim, _matcher(next(blocks)), schema)
    # A document keeps its row by a key made once; spans of several passes are merged into one cover.
    keyed = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    out = None
    for pieces in blocks:
        part = map_arrow(keyed.select(F.col("row").alias("doc_id"), "text"), _matcher(pieces), SCHEMA.format(id="bigint"))
        part = materialize(part, "decontaminate-pass")
        out = part if out is None else out.unionByName(part.where(F.size("item_ids") > 0))
    merged = out.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = keyed.select(F.col("row"), F.col("doc_id").alias("id"), "text").join(merged.withColumnRenamed("doc_id", "row"), "row")
    return map_arrow(joined.select(F.col("id").alias("doc_id"), "text", "n_words", "item_ids", "spans"), _merge_spans, schema)


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, covers = [], []
        for data, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            cover: list[list[int]] = []
            hit = 0
            if spans:
                keep = np.frombuffer(data.translate(NORMAL), np.uint8) != 32
                begins = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))) == 1)
                flags = np.zeros(len(begins), bool)
                for s in spans:
                    flags[np.searchsorted(begins, s["start"]) : np.searchsorted(begins, s["end"])] = True
                hit = int(flags.sum())
                cover = [{"start": a, "end": b} for a, b in original_spans(data, flags)]
            hits.append(hit)
            covers.append(cover)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("item_ids"), pa.array(covers, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
        )


def _judge(pieces: list[Piece], text_col: str, clean: bool):
    """Keeps the rows without (``clean``) or with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(pieces)
        for batch in batches:
            yield batch.filter(pa.array([bool(automaton.scan(data)[1]) != clean for data in text_bytes(batch.column(text_col))], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; no shuffle while the benchmark is one block."""
    columns = docs.columns
    slim = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    text_at = f"c{columns.index(text)}"
    n, blocks = _blocks(benchmark, item_id, item_text, block_nodes)
    if n == 1:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
        return map_arrow(slim, _judge(next(blocks), text_at, clean=True), schema).toDF(*columns)
    keyed = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    bad = None
    for pieces in blocks:
        found = map_arrow(keyed.select("row", F.col(text_at).cast("string").alias("text")), _judge(pieces, "text", clean=False), "row bigint, text string").select("row")
        found = materialize(found, "contaminated")
        bad = found if bad is None else bad.unionByName(found)
    return keyed.join(bad.distinct().hint("merge"), "row", "left_anti").drop("row").toDF(*columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH item AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
spot AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, s.k, item FROM spot s JOIN windows USING (k, win)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""
