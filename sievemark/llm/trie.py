"""Prefix trie of conversations by partition refinement.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it. A turn stands for
its SHA-256, so texts are read once and never shuffled.

Refinement. All conversations start in one class, the root. A round takes the next turn of every member of an active class and splits
the class by it. A class of one member retires: the rest of its turns is a unary chain, emitted without further rounds. So does
a class whose members agree to their end (copies), by 128 bits of hash over places and turns that aggregate in any order; so rounds go
only as deep as conversations that are no copies agree. Every round is written to the shared folder. Back from the last round to the
root, leaves and saved bytes are summed from children to parents, a level at a time.

A conversation may hold a third of all turns, a class a third of all conversations: turns are numbered by distributed prefix sums,
classes are counted with partial sums, and members learn their class from a written table, where adaptive execution splits hot
classes. The hash of the ids that end at a node is sequential by its nature: ids are sorted by range and put into segments of
``SEGMENT`` ids first, and one task streams the segments of a node through the hash, in constant memory.

Edge cases: a null role or text is an empty string; a null turn comes first; turns of one number are ordered by role, then by digest, and
repeated rows stay; a row without ``conv_id`` belongs to no conversation; a conversation without turns is a member of
the root and ends there; an empty table gives no row. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..prefix import prefix_sums
from .common import crc32_of, map_arrow, materialize, new_path
from .spelling import crc32_sql

#: Ids in one row on their way to the hash of a node's ends.
SEGMENT = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: The query's conversations take up to HEADS - 1 first turns from the first conversation of their FAMILY.
HEADS, FAMILY = 9, 5


# -- turns -------------------------------------------------------------------------------------------------------------


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, digest, one) without nulls but in ``turn``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return slim.withColumns({"digest": digest, "one": F.lit(1).cast("bigint")})


def _placed(turns: DataFrame) -> DataFrame:
    return prefix_sums(turns, "conv_id", ["turn", "role", "digest"], "one", "k").withColumn("k", F.col("k").cast("bigint"))


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, k, digest, size) of every turn: its place from 0, its SHA-256 and the UTF-8 bytes of its text."""
    turns = _turns(conversations, conv_id, turn, role, text)
    return _placed(turns.select("conv_id", "turn", "role", "digest", F.octet_length("text").cast("bigint").alias("size"), "one")).select("conv_id", "k", "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which every conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own
    turns after its first h; h is crc32 of the decimal c modulo 9. A conversation may end without turns."""
    turns = materialize(turns, "turns")
    n = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "turn-counts")
    c = F.col("conv_id")
    source = n.select(F.col("conv_id").alias("source"), F.col("n").alias("theirs"))
    convs = n.select("conv_id", (c - c % FAMILY).alias("source"), (crc32_of(c) % HEADS).alias("h")).join(source, "source", "left").select("conv_id", "source", "h", F.least("h", F.coalesce("theirs", F.lit(0))).alias("taken"))
    convs = materialize(convs, "convs")
    heads = convs.select(F.col("conv_id").alias("c"), "source", "h").join(turns.where(F.col("k") < HEADS - 1), F.col("source") == F.col("conv_id")).where("k < h").select(F.col("c").alias("conv_id"), (F.col("k") + 1).alias("depth"), "digest", "size")
    tails = turns.join(convs, "conv_id").where("k >= h").select("conv_id", (F.col("k") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "size")
    return convs.select("conv_id"), heads.unionByName(tails)


# -- refinement --------------------------------------------------------------------------------------------------------


def _refine(convs: DataFrame, turns: DataFrame, folder: str) -> int:
    """Writes classes/depth=d (conv_id, parent, n_convs, size, upto, total, bytes, state) and members/depth=d (conv_id, class, a, b, total,
    bytes, closed) for each round; returns the last depth. ``state``: one (a single member), same (all members agree to their end) or open."""
    spark = convs.sparkSession
    of_conv = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64(F.lit("a"), "depth", "digest")).alias("a"), F.bit_xor(F.xxhash64("digest", F.lit("b"), "depth")).alias("b"), F.count("*").alias("total"), F.sum("size").alias("bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    start = convs.join(of_conv, "conv_id", "left").select("conv_id", *map(zero, ("a", "b", "total", "bytes")))
    start = materialize(start, "signatures").withColumns({"parent": F.lit(None).cast("bigint"), "digest": F.lit(""), "size": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")})
    depth, joined = 0, start
    while True:
        same = (F.min("a") == F.max("a")) & (F.min("b") == F.max("b")) & (F.min("total") == F.max("total"))
        state = F.when(F.count("*") == 1, "one").when(same, "same").otherwise("open")
        classes = joined.groupBy("parent", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"), F.min(F.col("before") + F.col("size")).alias("upto"), F.min("total").alias("total"), F.min("bytes").alias("bytes"), state.alias("state"))
        classes.write.parquet(f"{folder}/classes/depth={depth}")
        shared = spark.read.schema(classes.schema).parquet(f"{folder}/classes/depth={depth}").where("state <> 'one'")
        shared = shared.select(F.col("parent").alias("p"), F.col("digest").alias("d"), F.col("conv_id").alias("class"), "upto", (F.col("state") == "same").alias("closed"))
        members = joined.join(shared, F.col("parent").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))).select("conv_id", "class", "a", "b", "total", "bytes", "upto", "closed")
        members.write.parquet(f"{folder}/members/depth={depth}")
        active = spark.read.schema(members.schema).parquet(f"{folder}/members/depth={depth}").where(~F.col("closed") & (F.col("total") > depth))
        if active.isEmpty():
            return depth
        depth += 1
        here = turns.where(F.col("depth") == depth).select("conv_id", "digest", "size")
        joined = active.withColumnsRenamed({"class": "parent", "upto": "before"}).drop("closed").join(here, "conv_id")


def _folded(classes: DataFrame, folder: str, last: int) -> DataFrame:
    """The nodes of the rounds with what their subtrees hold, summed from the deepest level up."""
    spark = classes.sparkSession
    kids = None
    for depth in range(last, -1, -1):
        here = classes.where(F.col("depth") == depth)
        # What one or several equal conversations add from this turn to their end.
        onward = (F.col("n_convs") - 1) * (F.col("bytes") - F.col("upto") + F.col("size"))
        more = (F.col("total") > F.col("depth")).cast("bigint")
        if kids is None:
            kids = spark.createDataFrame([], "p bigint, k bigint, l bigint, s bigint")
        joined = here.join(kids, F.col("conv_id") == F.col("p"), "left")
        is_open = F.col("state") == "open"
        level = joined.select(
            "conv_id", "parent", "n_convs", "total", "state", F.when(is_open, F.col("k")).otherwise(more).alias("n_children"), F.when(is_open, F.col("l")).otherwise(1).cast("bigint").alias("n_leaves"),
            F.when(is_open, (F.col("n_convs") - 1) * F.col("size") + F.col("s")).otherwise(onward).alias("saved_tokens"),
        )
        level.write.parquet(f"{folder}/folded/depth={depth}")
        below = spark.read.schema(level.schema).parquet(f"{folder}/folded/depth={depth}")
        kids = below.groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    return spark.read.parquet(f"{folder}/folded").withColumn("depth", F.col("depth").cast("bigint"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (depth, class, conv_id) as rows of at most ``SEGMENT`` ids."""
    key, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["depth", "class", "first", "ids"])

    for batch in batches:
        for depth, owner, conv_id in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if ids and ((depth, owner) != key or len(ids) == SEGMENT):
                yield row()
                ids = []
            key = (depth, owner)
            ids.append(conv_id)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the segments of each node through SHA-256."""
    key, sha = None, hashlib.sha256()
    done: list[tuple[int, int, str]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "class", "sha"])

    for batch in batches:
        for depth, owner, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "class", "ids"))):
            if key == (depth, owner):
                sha.update(b",")
            else:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = (depth, owner), hashlib.sha256()
            sha.update(ids.encode())
        yield out()
        done.clear()
    if key is not None:
        done.append((*key, sha.hexdigest()))
        yield out()


def ends_sha256(ends: DataFrame) -> DataFrame:
    """(depth, class, sha): lowercase SHA-256 of the comma-joined ascending conv_ids of each (depth, class) of (depth, class, conv_id)."""
    ranged = ends.select("depth", "class", "conv_id").repartitionByRange("depth", "class", "conv_id").sortWithinPartitions("depth", "class", "conv_id")
    segments = materialize(map_arrow(ranged, _segments, "depth bigint, class bigint, first bigint, ids string"), "segments")
    return map_arrow(segments.repartition("depth", "class").sortWithinPartitions("depth", "class", "first"), _hashed, "depth bigint, class bigint, sha string")


def nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of ``convs`` (conv_id) and ``turns`` (conv_id, depth from 1, digest, size): per node conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (bytes that its subtree needn't keep twice), ends_sha256."""
    spark = convs.sparkSession
    turns = materialize(turns, "trie-turns")
    folder = new_path(spark, "trie")
    last = _refine(convs, turns, folder)
    classes = spark.read.parquet(f"{folder}/classes")
    core = _folded(classes, folder, last)
    members = spark.read.parquet(f"{folder}/members")
    ends = members.where(F.col("closed") | (F.col("total") == F.col("depth"))).select(F.col("total").alias("depth"), "class", "conv_id")
    ended = materialize(ends_sha256(ends), "ends")
    # Chains: what retired classes go on with. Adaptive execution splits the turns of a hot conversation.
    retired = materialize(classes.where("state <> 'open' AND total > depth").select(F.col("conv_id").alias("c"), F.col("depth").cast("bigint").alias("from"), "n_convs", "total", "upto", "bytes"), "retired")
    chain = turns.join(retired, F.col("conv_id") == F.col("c")).where(F.col("depth") > F.col("from"))
    more = (F.col("total") > F.col("depth")).cast("bigint").alias("n_children")
    alone = chain.where("n_convs = 1").select("conv_id", "depth", F.col("conv_id").alias("parent"), "n_convs", more, F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), "total")
    # Copies save what is left of their text at each turn: a prefix sum, as one of them may be very long.
    copies = prefix_sums(chain.where("n_convs > 1").select("conv_id", "depth", "size", "n_convs", "total", "upto", "bytes"), "conv_id", ["depth"], "size", "inside")
    saved = (F.col("n_convs") - 1) * (F.col("bytes") - F.col("upto") - F.col("inside"))
    copies = copies.select("conv_id", "depth", F.col("conv_id").alias("parent"), "n_convs", more, F.lit(1).cast("bigint").alias("n_leaves"), saved.cast("bigint").alias("saved_tokens"), "total")
    columns = copies.columns
    ones, shared = core.where("state = 'one'").select(columns), core.where("state <> 'one'").select(columns)
    own = F.when(F.col("total") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA256))
    single = alone.unionByName(ones).withColumn("ends_sha256", own)
    several = shared.unionByName(copies).join(ended.withColumnsRenamed({"depth": "end", "class": "owner"}), (F.col("depth") == F.col("end")) & (F.col("conv_id") == F.col("owner")), "left")
    several = several.select(*columns, F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    return single.unionByName(several).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are."""
    turns = materialize(numbered(conversations, conv_id, turn, role, text), "turns")
    return nodes(turns.select("conv_id").distinct(), turns.select("conv_id", (F.col("k") + 1).alias("depth"), "digest", "size"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as :func:`rebuilt` puts them together."""
    return nodes(*rebuilt(numbered(conversations)))


def with_turns(found: DataFrame, conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of :func:`prefix_trie` with the role and text of their last turn, taken from their smallest member (root: null)."""
    placed = _placed(_turns(conversations, conv_id, turn, role, text)).select(F.col("conv_id").alias("_c"), (F.col("k") + 1).alias("_d"), "role", "text")
    return found.join(placed, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left").drop("_c", "_d")


ORACLE = f"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t1 AS (SELECT *, sha256(strlen(role)::VARCHAR || ':' || role || text) AS g FROM t0),
t AS MATERIALIZED (SELECT conv_id, g, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, g) - 1 AS k FROM t1),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS s, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, k, g, b FROM c JOIN t ON t.conv_id = s AND k < h
  UNION ALL SELECT conv_id, k, g, b FROM c JOIN t USING (conv_id) WHERE k >= h),
d AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, b, list(g) OVER (PARTITION BY conv_id ORDER BY k) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS MATERIALIZED (
  SELECT conv_id, depth, b, md5(array_to_string(path, ',')) AS key, md5(array_to_string(path[1:depth - 1], ',')) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM d),
n AS MATERIALIZED (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(b) AS b,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY depth, key),
k AS (SELECT depth, above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, above),
w AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth + 1 AND k.above = n.key),
u AS (
  SELECT m.depth, m.key, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.b) AS saved_tokens
  FROM w JOIN m ON m.conv_id = w.conv_id AND m.depth <= w.depth GROUP BY m.depth, m.key)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (depth, key) LEFT JOIN n p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.key = w.above
"""
