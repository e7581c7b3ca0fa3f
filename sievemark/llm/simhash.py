"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint takes words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles of three words (repeats
included; the whole sequence if shorter) and XXH64 (seed 42) of each; a bit is 1 if set in over half of the hashes. No word:
fingerprint zero, which links like any other. Fingerprints link at ``MAX_BITS`` or fewer differing bits; a component is what
links reach.

The index. Distinct fingerprints are sorted by Gray rank, so neighbours share long masked bit patterns. Runs of equal size
become blocks; each block's shared bits (mask and pattern) are the leaves of a small routing tree (at most ``MAX_BLOCKS``
leaves: 1.5 MB, the only broadcast). A fingerprint goes to its own block and to those later blocks from which its
accumulated difference is within the limit. In a block, the codes are leaves of a tree whose upper nodes hold the bits that
all below share; a search carries the difference summed so far and drops a whole group once it passes the limit. Distinct
fingerprints have at most 2,080 neighbours within two bits, so work per fingerprint is bounded whatever the size of a
group of copies. A block returns a spanning forest of its links; components come from rounds of contraction with
random priorities over those edges, each round written to the shared folder.

Edge cases: null and empty texts have fingerprint zero; repeated rows stay, one result row each; a null ``doc_id`` keeps
its row and never becomes a component id unless its whole component has none (then it is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, map_arrow, materialize, text_bytes

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Blocks at least and at most; in between, a block holds BLOCK_CODES fingerprints. A fingerprint visits about
#: (log2 of the blocks) squared over 4 blocks, so their number is fixed while blocks fit a task easily.
MIN_BLOCKS, MAX_BLOCKS = 64, 65536
BLOCK_CODES = 65536
FANOUT = 8
SIGN = np.uint64(1 << 63)


# -- fingerprints ------------------------------------------------------------------------------------------------------


def _add(words: list[bytes], total: np.ndarray, whole: bool) -> int:
    from xxhash import xxh64_intdigest

    if len(words) < SHINGLE:
        if not whole or not words:
            return 0
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    total += bit_counts(hashes)
    return len(hashes)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set; bit j of byte i counts at place 8 i + j."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def majority(total: np.ndarray, n: int) -> int:
    """The fingerprint: bits set in over half of n hashes."""
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint(data: bytes | None) -> int:
    if not data:
        return 0
    total, n, carry = np.zeros(64, np.int64), 0, []
    for run in byte_runs(data):
        words = carry + run.lower().split()
        n += _add(words, total, whole=False)
        carry = words[-(SHINGLE - 1) :]
    if not n:
        n = _add(carry, total, whole=True)
    return majority(total, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.fromiter(map(fingerprint, text_bytes(batch.column("text"))), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], names=["doc_id", "code"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, code): the fingerprint's 64 bits as a signed long."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(slim, _fingerprints, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, code bigint")


# -- the index ---------------------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _gray_rank_column(code):
    """The same as a column, with the sign bit turned so that signed order is rank order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Masked patterns in Gray order at the bottom; every upper node keeps the bits that its children share."""

    def __init__(self, masks: np.ndarray, patterns: np.ndarray):
        self.levels = [(masks, patterns & masks)]
        while len(self.levels[-1][0]) > FANOUT:
            masks, patterns = self.levels[-1]
            starts = np.arange(0, len(masks), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(patterns | ~masks, starts), np.bitwise_or.reduceat(patterns & masks, starts)
            shared = np.bitwise_and.reduceat(masks, starts) & ~(ones ^ zeros)
            self.levels.append((shared, ones & shared))

    def search(self, queries: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) whose difference on the leaf's mask is at most ``most``."""
        masks, patterns = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(masks))
        node = np.tile(np.arange(len(masks)), len(queries))
        above = np.zeros(len(q), np.uint64)
        gone = np.zeros(len(q), np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            masks, patterns = self.levels[level]
            # Only bits that the parent had not factored out add to the difference.
            gone = gone + np.bitwise_count((queries[q] ^ patterns[node]) & masks[node] & ~above)
            keep = gone <= most
            q, node, gone = q[keep], node[keep], gone[keep]
            if level:
                below = len(self.levels[level - 1][0])
                above = np.repeat(masks[node], FANOUT)
                q, gone = np.repeat(q, FANOUT), np.repeat(gone, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < below
                q, node, gone, above = q[real], node[real], gone[real], above[real]
        return q, node


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each component."""
    root = np.arange(n) if root is None else root
    while len(a):
        a, b = root[a], root[b]
        differ = a != b
        a, b = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(root, b, a)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root


def forest(members: np.ndarray, visitors: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (node, root) of the links among the members of a block and between visitors and members."""
    members = members[np.argsort(gray_rank(members), kind="stable")]
    index = GrayIndex(np.full(len(members), ~np.uint64(0)), members)
    nodes = np.concatenate([members, visitors])
    root = np.arange(len(nodes))
    for k in range(0, len(nodes), 2048):
        q, leaf = index.search(nodes[k : k + 2048], most)
        q = q + k
        link = q > leaf if k < len(members) else q >= 0
        root = _roots(len(nodes), q[link], leaf[link], root)
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _routed(cuts: np.ndarray, tree: GrayIndex, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_numpy().view(np.uint64)
            own = _place(cuts, batch)
            q, leaf = tree.search(codes, most)
            visits = leaf > own[q]
            block = np.concatenate([own, leaf[visits]]).astype(np.int32)
            code = np.concatenate([codes, codes[q[visits]]])
            member = np.concatenate([np.ones(len(own), bool), np.zeros(int(visits.sum()), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(code.view(np.int64)), pa.array(member)], names=["block", "code", "member"])

    return run


def _block_forest(most: int):
    def run(block: pa.Table) -> pa.Table:
        codes = block.column("code").to_numpy().view(np.uint64)
        member = block.column("member").to_numpy(zero_copy_only=False)
        a, b = forest(codes[member], codes[~member], most)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def links(codes: DataFrame, most: int = MAX_BITS, block_codes: int = BLOCK_CODES) -> DataFrame:
    """(a, b): spanning edges of the graph of distinct fingerprints within ``most`` bits."""
    spark = codes.sparkSession
    ranked = codes.select("code", _gray_rank_column(F.col("code")).alias("rank"))
    n = ranked.count()
    n_blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, -(-n // block_codes)), max(1, n // 4))
    if n_blocks > 1:
        cuts = ranked.agg(F.percentile_approx("rank", [k / n_blocks for k in range(1, n_blocks)], 20 * n_blocks)).first()[0]
        cuts = np.unique(np.array(cuts, np.int64))
    else:
        cuts = np.array([], np.int64)
    nodes = map_arrow(ranked, _own_block(cuts), "code bigint, block int").groupBy("block").agg(F.bit_and("code").alias("ones"), F.bit_or("code").alias("zeros")).collect()  # one row per block
    masks, patterns = np.zeros(len(cuts) + 1, np.uint64), np.zeros(len(cuts) + 1, np.uint64)
    for r in nodes:
        ones, zeros = np.array([r.ones, r.zeros], np.int64).view(np.uint64)
        masks[r.block], patterns[r.block] = ~(ones ^ zeros), ones
    # The block is looked up again instead of piped through: one Python worker a task, not two.
    routed = map_arrow(ranked, _routed(cuts, GrayIndex(masks, patterns), most), "block int, code bigint, member boolean")
    return routed.groupBy("block").applyInArrow(_block_forest(most), "a bigint, b bigint")


def _place(cuts: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    return np.searchsorted(cuts, batch.column("rank").to_numpy(), side="left").astype(np.int32)


def _own_block(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(_place(cuts, batch))], names=["code", "block"])

    return run


# -- components --------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; nodes share a label exactly if edges connect them.

    Each round gives a node the label of its neighbour (or itself) with the smallest random priority and contracts equal
    labels; a constant share of the nodes goes in each round whatever the graph's shape.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A string, as its value isn't part of the generated code, which all rounds then share.
        key = lambda c: F.struct(F.xxhash64(F.lit(f"turn {turn}"), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        step = both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("node"), F.least(key("a"), F.col("m"))["v"].alias("to"))
        step = materialize(step, "step")
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        edges = materialize(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        if found is None:
            found = step.select("node", F.col("to").alias("label"))
        else:
            found = found.join(to("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label"))
            found = materialize(found, "found")
        turn += 1
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_BITS, block_codes: int = BLOCK_CODES) -> DataFrame:
    """(doc_id, code, component_id) of every row of ``docs``."""
    marked = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    codes = materialize(marked.groupBy("code").agg(F.min("doc_id").alias("least_id")), "codes")
    label = components(links(codes.select("code"), most, block_codes))
    inside = materialize(codes.join(label.withColumnRenamed("node", "code"), "code"), "inside")
    reach = inside.groupBy("label").agg(F.min("least_id").alias("component_id"))
    linked = inside.join(reach, "label").select("code", "component_id")
    of_code = codes.join(linked, "code", "left").select("code", F.coalesce("component_id", "least_id").alias("component_id"))
    # A third of the rows may share one fingerprint: the side of the rows is the one that adaptive execution splits.
    return marked.join(materialize(of_code, "of-code"), "code", "left").select("doc_id", "code", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_BITS, block_codes: int = BLOCK_CODES) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (null last), the first of rows that repeat it."""
    columns = docs.columns
    slim = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    id_at, text_at = f"c{columns.index(doc_id)}", f"c{columns.index(text)}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    marked = materialize(map_arrow(slim, _marked(text_at), f"{schema}, code bigint").withColumn("row", F.monotonically_increasing_id()), "marked")
    first = F.struct(F.col(id_at).isNull().alias("n"), F.col(id_at).alias("i"), F.col("row").alias("r"))
    codes = materialize(marked.groupBy("code").agg(F.min(first).alias("least")), "codes")
    label = components(links(codes.select("code"), most, block_codes)).withColumnRenamed("node", "code")
    linked = codes.join(label, "code").groupBy("label").agg(F.min("least").alias("least"))
    alone = codes.join(label, "code", "left_anti")
    rows = materialize(linked.select("least.r").unionByName(alone.select("least.r")), "kept-rows")
    # Merged at every size: the kept rows grow with the input, so they are never broadcast.
    return marked.join(rows.hint("merge"), F.col("row") == F.col("r"), "left_semi").drop("code", "row").toDF(*columns)


def _marked(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter(map(fingerprint, text_bytes(batch.column(text))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], names=[*batch.schema.names, "code"])

    return run
