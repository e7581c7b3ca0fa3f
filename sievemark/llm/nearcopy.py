"""SimHash near-dedup for five words and a similarity of 0.8: the fingerprints' Gray-order index first, then what it can't see.

A text's set holds the distinct shingles of five words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (the whole sequence if shorter),
as 64-bit hashes. Texts link if their sets' Jaccard similarity is at least 4/5; a component is what links reach. A text is known by
its ``code``, a 64-bit hash of its set, so copies with equal sets are one node from the start.

1. Fingerprints: each set's SimHash is looked up in the Gray-order index of ``simhash`` (``MAX_BITS`` differing bits); every link it gives
   is confirmed on the whole sets. That joins the closest copies with no pair of a group ever listed.
2. The rest: at a similarity of 0.8 fingerprints differ in some ten bits, which no index of 64-bit codes separates from chance. Shingles are
   put in one order, and two sets that link share a shingle among the first n - ceil(4n/5) + 1 of each, so no pair is lost. For ``ROUNDS`` rounds,
   every set is compared with some random ones (``MET``) of other groups that share its prefix shingles, of which the likest (``LEADERS``) are confirmed:
   linearly many pairs, which join what is left of large groups. Then all pairs that still lie in different groups and whose sizes and places allow a link.
3. Before whole sets are moved, a pair passes its bitmaps: a bit for each shingle's hash, some four a shingle. A bit that one set has and the other hasn't is a
   shingle that they don't share, so the count bounds their difference from below, and no link is lost.

Shingles that are common in a sample go last in their order, the commonest at the end, which changes the number of candidates and nothing else. Every candidate is
confirmed on the whole sets. Sets are built anew from the texts that have candidates, chosen by a bitmap of fixed size
(``BITMAP`` bits, with the common shingles the only broadcast); texts are not shuffled for it.

Edge cases: null, empty and blank texts have the empty set and are copies of each other; rows that repeat are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import byte_runs, map_arrow, materialize, text_bytes

SHINGLE = 5
#: Jaccard similarity of a link: ALIKE[0] / ALIKE[1].
ALIKE = (4, 5)
#: Rounds of leaders, at most (one that finds no link is the last); leaders of a shingle, those of a set whose bitmaps are compared, and those confirmed.
ROUNDS, HEADS, MET, LEADERS = 3, 8, 16, 3
#: Bits of a set's bitmap: as many a shingle at least, between 64 and the most.
BITS, MAX_BITS = 4, 1 << 17
#: Share of the sets in the sample of common shingles, its count of a common shingle, and common shingles at most (8 bytes each).
SAMPLE, COMMON, MAX_COMMON = 0.2, 3, 1 << 20
BITMAP = 1 << 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    runs = [np.fromiter(map(xxh64_intdigest, run.lower().split()), np.uint64) for run in byte_runs(data or b"")]
    words = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k]
    return np.unique(_mix(total))


def prefix_length(n: int) -> int:
    return n - -(-ALIKE[0] * n // ALIKE[1]) + 1 if n else 0


def _marked(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            code, print_ = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            for i, data in enumerate(text_bytes(batch.column(text))):
                found = shingles(data)
                code[i] = xxh64_intdigest(found.tobytes())
                print_[i] = simhash.majority(simhash.bit_counts(found), len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64)), pa.array(print_.view(np.int64))], names=[*batch.schema.names, "code", "print"])

    return run


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        found = []
        for code, data in zip(batch.column("code").to_pylist(), text_bytes(batch.column("text"))):
            if code not in seen:
                if len(seen) < 1 << 17:
                    seen.add(code)
                found.append(shingles(data))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["token"])


def _prefixes(common: np.ndarray, place: np.ndarray):
    """(token, code, n, at) of the first shingles of each set, and their places; a task gives a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for code, data in zip(batch.column("code").to_pylist(), text_bytes(batch.column("text"))):
                if code in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(code)
                found = shingles(data)
                n = prefix_length(len(found))
                first = found[:n]
                if len(common):
                    k = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    first = found[np.argsort(np.where(common[k] == found, place[k], -1), kind="stable")[:n]]
                out.append((first, np.full(n, code, np.int64), np.full(n, len(found), np.int32), np.arange(n, dtype=np.int32)))
            if out:
                token, code, n, at = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(code), pa.array(n), pa.array(at)], names=["token", "code", "n", "at"])

    return run


def _sets(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            if len(batch):
                found = [shingles(data).view(np.int64) for data in text_bytes(batch.column("text"))]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(found))
                yield pa.RecordBatch.from_arrays([batch.column("code"), lists], names=["code", "hashes"])

    return run


def bits_of(found: np.ndarray) -> bytes:
    """The bitmap of a set's hashes; its size is a power of two, so that a larger one folds onto a smaller."""
    size = min(MAX_BITS, max(64, 1 << (BITS * len(found) - 1).bit_length())) if len(found) else 64
    bits = np.zeros(size, bool)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """So many shingles at least are in one set and not in the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (v if len(v) == size else np.bitwise_or.reduce(v.reshape(-1, size)) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashes.values.to_numpy().view(np.uint64) for hashes in batch.column("hashes")]
        yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array([len(f) for f in found], pa.int32()), pa.array(list(map(bits_of, found)), pa.binary())], names=["code", "n", "bits"])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = np.fromiter(map(least_difference, batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist()), np.int32, len(batch))
        # Sets of a and b shingles that differ in d link if d is at most this share of a + b.
        fit = (ALIKE[0] + ALIKE[1]) * d <= (ALIKE[1] - ALIKE[0]) * (batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d)], names=["a", "b", "d"]).filter(pa.array(fit))


def _bit(row: str):
    return F.pmod(F.xxhash64(row), F.lit(BITMAP))


def _wanted(pairs: DataFrame, end: str, marked: DataFrame, codes: DataFrame, fn: Callable[[np.ndarray], Callable], schema: str) -> DataFrame:
    """``fn`` of the texts of the codes in one column of ``pairs``; a few others may be among them, or one twice."""
    wanted = pairs.select(F.col(end).alias("code")).distinct().join(codes.select("code", F.col("least.r").alias("row")), "code").select(_bit("row").alias("at"))
    found = wanted.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # BITMAP / 64 rows at most
    bitmap = np.zeros(BITMAP >> 6, np.uint64)
    bitmap[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return map_arrow(marked.select("code", "text", _bit("row").alias("at")), fn(bitmap), schema)


def _sets_of(pairs: DataFrame, end: str, marked: DataFrame, codes: DataFrame) -> DataFrame:
    return _wanted(pairs, end, marked, codes, _sets, "code bigint, hashes array<bigint>").toDF(end, f"{end}_set")


def bitmaps(shared: DataFrame, marked: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, n, bits) of the sets that share a prefix shingle with another."""
    found = _wanted(shared, "code", marked, codes, lambda bitmap: lambda batches: _bitmaps(_sets(bitmap)(batches)), "code bigint, n int, bits binary")
    return materialize(found.dropDuplicates(["code"]), "bits")


def possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b, d): the rows of ``pairs`` whose bitmaps allow a link, and their least difference."""
    side = lambda c: bits.select(*(F.col(x).alias(y) for x, y in (("code", c), ("n", f"{c}_n"), ("bits", f"{c}_bits"))))
    both = pairs.select("a", "b").hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return map_arrow(both, _fitting, "a bigint, b bigint, d int")


def confirmed(pairs: DataFrame, marked: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets are alike, counted on the whole sets."""
    pairs = materialize(pairs, "pairs")
    both = F.size(F.array_intersect("a_set", "b_set"))
    alike = ALIKE[1] * both >= ALIKE[0] * (F.size("a_set") + F.size("b_set") - both)
    return pairs.join(_sets_of(pairs, "a", marked, codes), "a").join(_sets_of(pairs, "b", marked, codes), "b").where(alike).select("a", "b").distinct()


def printed(codes: DataFrame) -> DataFrame:
    """(a, b): spanning pairs of sets whose fingerprints link, and of sets of one fingerprint."""
    prints = materialize(codes.groupBy("print").agg(F.min("code").alias("rep")), "prints")
    rep = lambda c: prints.select(F.col("print").alias(c), F.col("rep").alias(f"{c}_rep"))
    near = simhash.links(prints.select(F.col("print").alias("code"))).join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    return codes.join(prints, "print").where("rep <> code").select(F.col("rep").alias("a"), F.col("code").alias("b")).unionByName(near)


def common_shingles(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order of their hashes, and the place of each among them by its count in the sample."""
    some = marked.where(F.pmod(F.xxhash64(F.lit("common"), "code"), F.lit(1000)) < int(SAMPLE * 1000))
    counted = map_arrow(some.select("code", "text"), _flat, "token bigint").groupBy("token").count().where(F.col("count") >= COMMON)
    top = counted.orderBy(F.desc("count"), "token").limit(MAX_COMMON).toArrow()
    tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(tokens)
    place = np.empty(len(tokens), np.int32)
    place[np.lexsort((tokens[order], counts[order]))] = np.arange(len(tokens))
    return tokens[order], place


def shared_tokens(marked: DataFrame) -> DataFrame:
    """(token, code, n, at): the prefix shingles that at least two sets have."""
    tokens = map_arrow(marked.select("code", "text"), _prefixes(*common_shingles(marked)), "token bigint, code bigint, n int, at int")
    same = Window.partitionBy("token")
    return tokens.withColumn("lo", F.min("code").over(same)).withColumn("hi", F.max("code").over(same)).where("lo <> hi").select("token", "code", "n", "at").distinct()


def _open(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(token, code, n, at, label): the shingles that sets of at least two groups have."""
    known = shared.join(label.withColumnRenamed("node", "code"), "code", "left").withColumn("label", F.coalesce("label", "code"))
    same = Window.partitionBy("token")
    return materialize(known.withColumn("lo", F.min("label").over(same)).withColumn("hi", F.max("label").over(same)).where("lo <> hi").select("token", "code", "n", "at", "label"), "open")


def _allowed(a_n: Column, b_n: Column) -> Column:
    return ALIKE[1] * F.least(a_n, b_n) >= ALIKE[0] * F.greatest(a_n, b_n)


def _early(a_n: Column, a_at: Column, b_n: Column, b_at: Column) -> Column:
    """Whether a shingle stands so early in both sets that as many as a link needs can follow it, and the sizes allow one.

    Sets that link have at least ``least`` shingles in common; the first of those has no more than n - least before it.
    """
    least = F.ceil(ALIKE[0] * (a_n + b_n) / (ALIKE[0] + ALIKE[1]))
    return _allowed(a_n, b_n) & (a_n - a_at >= least) & (b_n - b_at >= least)


def led(live: DataFrame, bits: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set b with up to ``LEADERS`` of the random leaders a of its shingles, the likest by their bitmaps."""
    order = lambda k: F.xxhash64(F.lit(f"turn {turn} {k}"), "token", "code").alias("h")
    heads = live.groupBy("token").agg(*(F.min(F.struct(order(k), "code", "n", "at", "label")).alias(f"l{k}") for k in range(HEADS)))
    heads = heads.select("token", F.array_distinct(F.array(*(F.struct(*(F.col(f"l{k}")[c].alias(c) for c in ("code", "n", "at", "label"))) for k in range(HEADS)))).alias("heads"))
    met = live.join(heads, "token").select("code", "n", "at", "label", F.explode("heads").alias("l"))
    met = met.where((F.col("label") != F.col("l.label")) & _early(F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at")))
    met = met.groupBy(F.col("l.code").alias("a"), F.col("code").alias("b")).agg(F.count("*").alias("c"))
    # A set has HEADS times as many leaders as prefix shingles at most.
    best = met.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "a")), False), 1, MET).alias("l"))
    fit = possible(best.select(F.explode("l.a").alias("a"), "b"), bits)
    likest = fit.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "a"))), 1, LEADERS).alias("l"))
    return likest.select(F.explode("l.a").alias("a"), "b")


def met_pairs(live: DataFrame) -> DataFrame:
    """(a, b): sets of different groups that have a shingle early in both."""
    side = lambda c: live.select("token", *(F.col(x).alias(f"{c}_{x}") for x in ("code", "n", "at", "label")))
    c = F.col
    fit = (c("a_code") < c("b_code")) & (c("a_label") != c("b_label")) & _early(c("a_n"), c("a_at"), c("b_n"), c("b_at"))
    return side("a").hint("merge").join(side("b"), "token").where(fit).select(c("a_code").alias("a"), c("b_code").alias("b")).distinct()


def pairs_left(live: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b): all sets of different groups whose prefixes and bitmaps allow a link."""
    return possible(materialize(met_pairs(live), "met"), bits).select("a", "b")


def links(marked: DataFrame, codes: DataFrame, by_print: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): edges between sets that are alike, enough of them to connect every component."""
    found = [materialize(confirmed(printed(codes) if by_print else codes.select(F.col("code").alias("a"), F.col("code").alias("b")).where("false"), marked, codes), "links")]
    shared = materialize(shared_tokens(marked), "shared")
    bits = bitmaps(shared, marked, codes)
    every = lambda: reduce(DataFrame.unionByName, found)
    live = _open(shared, simhash.components(every()))
    for turn in range(rounds):
        found.append(materialize(confirmed(led(live, bits, turn), marked, codes), "links"))
        if found[-1].isEmpty():
            break
        live = _open(shared, simhash.components(every()))
    return every().unionByName(confirmed(pairs_left(live, bits), marked, codes))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (null last), the first of rows that repeat it."""
    columns = docs.columns
    slim = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    id_at, text_at = f"c{columns.index(doc_id)}", f"c{columns.index(text)}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    marked = map_arrow(slim, _marked(text_at), f"{schema}, code bigint, print bigint")
    marked = materialize(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    first = F.struct(F.col(id_at).isNull().alias("n"), F.col(id_at).alias("i"), F.col("row").alias("r"))
    codes = materialize(marked.groupBy("code").agg(F.min(first).alias("least"), F.min("print").alias("print")), "codes")
    label = simhash.components(links(marked.select("row", "code", F.col(text_at).alias("text")), codes)).withColumnRenamed("node", "code")
    linked = codes.join(label, "code").groupBy("label").agg(F.min("least").alias("least"))
    alone = codes.join(label, "code", "left_anti")
    rows = materialize(linked.select("least.r").unionByName(alone.select("least.r")), "kept-rows")
    # Merged at every size: the kept rows grow with the input, so they are never broadcast.
    return marked.join(rows.hint("merge"), F.col("row") == F.col("r"), "left_semi").drop("code", "row", "print").toDF(*columns)
