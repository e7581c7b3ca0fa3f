"""Mixing sources to target weights with exact budgets.

Every document gets a hash-random key. Within its source, documents are ordered by key; distributed prefix sums of their word
counts give each its place, and a source's exact budget cuts that order: whole epochs first, then the documents that fit
in the rest, the one on the cut in part. No source is taken more than ``MAX_EPOCHS`` times; what it can't give is shared
among the others by weight.

The prefix sum is a range partition on (source, key) and a running sum within each partition; only one number per partition and
source in it crosses partitions. A source that holds most rows is spread over many partitions. The text itself isn't
shuffled. Per-source sums reach the driver only up to ``MAX_SOURCES`` sources; more raise an error before anything is collected.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is a source, last in order; rows that repeat a
``doc_id`` get keys of their own occurrence only if their texts differ, else they share a key and a total order among
equals doesn't change any figure; an empty table gives no row. Reruns agree, as keys depend on ``doc_id`` and the text's size alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..prefix import prefix_sums
from .common import WORD_RE, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
MAX_SOURCES = 100_000
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def _key(doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), doc_id.cast("string")))


def water_fill(sizes: list[int], weights: list[float], total: float, most: int = MAX_EPOCHS) -> list[float]:
    """Targets that share ``total`` by weight, none above ``most`` times its size; the excess is reshared until none is above."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken) of every document; ``weights`` repeat over sources in code point order."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text).cast("string")).alias("size"))
    sized = sized.withColumn("key", _key(F.col("doc_id")))
    sized = materialize(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n"))
    if per_source.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(per_source.collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    plan = list(zip((r.source for r in rows), (r.n for r in rows), water_fill([r.n for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share * sum(r.n for r in rows), most)))
    # Not a hinted broadcast: adaptive execution broadcasts it only while it is small.
    targets = docs.sparkSession.createDataFrame(plan, "_source string, source_size bigint, target double")
    placed = prefix_sums(sized, "source", ["key", "doc_id", "size"], "size", "before")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.select("doc_id", "key", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def repeat_to_targets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; whole copies only, so the document on a source's cut goes in if at
    least half of it is within the budget.

    The cut of a source is one place in its order of keys, so one small row per source decides every document: texts
    are neither joined nor shuffled. Documents that share an id share its place.
    """
    mixed = materialize(mix(docs, doc_id, text, source, weights, share, most), "mixed")
    columns = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    doc_id, text, source = (f"c{columns.index(c)}" for c in (doc_id, text, source))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int").alias("n")
    # Copies fall along the order of keys by one at most: the last place of the larger number is the cut.
    per_source = mixed.where("size > 0").select("source", copies, F.struct("key", F.col("doc_id").cast("string").alias("id")).alias("at"))
    most_copies = per_source.groupBy("source").agg(F.max("n").alias("n"), F.min("n").alias("low"))
    cuts = per_source.join(most_copies.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (per_source["n"] == most_copies["n"])).groupBy("source").agg(F.max("at").alias("cut"), F.max(per_source["n"]).alias("high"), F.max("low").alias("low"))
    cuts = materialize(cuts.select(F.col("source").alias("_source"), F.col("cut").alias("_cut"), F.col("high").alias("_high"), F.col("low").alias("_low")), "cuts")
    place = F.struct(_key(F.col(doc_id)).alias("key"), F.col(doc_id).cast("string").alias("id"))
    # At most MAX_SOURCES rows.
    dealt = docs.join(F.broadcast(cuts), F.col(source).cast("string").eqNullSafe(F.col("_source")))
    times = F.when(n_words(F.col(text).cast("string")) == 0, 0).when(place <= F.col("_cut"), F.col("_high")).otherwise(F.col("_low"))
    return dealt.withColumn("_turn", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns).toDF(*columns)


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || doc_id::VARCHAR) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, i) AS j,
         (SELECT sum(n) FROM s)::DOUBLE - coalesce(sum(3 * n) OVER (ORDER BY 3.0 * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_words,
         sum(w) OVER (ORDER BY 3.0 * n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS left_weight
  FROM w),
free AS (SELECT min(j) AS j FROM r WHERE left_words * w / left_weight <= 3 * n),
t AS (
  SELECT source, n AS source_size,
         CASE WHEN r.j < free.j THEN (3 * n)::DOUBLE
              ELSE (SELECT left_words FROM r x WHERE x.j = free.j) * w / (SELECT left_weight FROM r x WHERE x.j = free.j) END AS target
  FROM r, free),
p AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
