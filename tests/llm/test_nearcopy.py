"""Near copies of the pipeline's stage against brute force."""

import re

import numpy as np
import pytest

pytest.importorskip("sievemark.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def planted():
    """Bases, edited copies around the limit, chains of edits, copies in another case, short texts and a shared passage."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    passage, texts = list(rng.choice(words, 40)), []
    for k in range(30):
        base = list(rng.choice(words, int(rng.integers(60, 400))))
        if k % 3 == 0:
            base[10:10] = passage
        texts += [" ".join(base), "\n".join(base).upper()]
        for edits in (1, 2, 4, 6, 9, len(base) // 40, len(base) // 25):
            copy = list(base)
            for at in rng.choice(len(copy), edits, replace=False):
                copy[at] = f"new{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
        chain = list(base)
        for _ in range(4):
            chain = chain[2:] + [f"x{rng.integers(1 << 30)}" for _ in range(3)]
            texts.append(" ".join(chain))
    texts += [" ".join(passage), " ".join(passage[:-1]), None, "", " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    order = rng.permutation(len(texts))
    rows = [(i, texts[k], "en", "s", len(texts[k] or "")) for i, k in enumerate(order.tolist())]
    return rows + [(None, texts[0], "en", "s", 1), (None, "only here", "en", "s", 1), (0, rows[0][1], "en", "s", 1)]


def kept_ids(rows):
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and near(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in sorted(set(group))]


def test_near_dedup_against_brute_force(spark):
    rows = planted()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, kept_ids(rows)))


def test_prefixes_alone_find_every_link(spark):
    from sievemark.llm import nearcopy
    from sievemark.llm.common import materialize
    from pyspark.sql import functions as F

    rows = planted()
    docs = spark.createDataFrame(rows, SCHEMA).select("text")
    marked = materialize(nearcopy.map_arrow(docs, nearcopy._marked("text"), "text string, code bigint, print bigint").withColumn("row", F.monotonically_increasing_id()), "marked")
    codes = marked.groupBy("code").agg(F.struct(F.min("row").alias("r")).alias("least"), F.min("print").alias("print"))
    got = {(r.a, r.b) for r in nearcopy.links(marked, codes, by_print=False, rounds=0).collect()}
    sets = {r.code: shingles(r.text) for r in marked.collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])} and len(got) > 100
    by_print = {tuple(sorted((r.a, r.b))) for r in nearcopy.confirmed(nearcopy.printed(codes), marked, codes).collect()}
    assert by_print and by_print < got


def test_bitmaps_bound_the_difference_from_below():
    from sievemark.llm import nearcopy

    rng = np.random.default_rng(6)
    for n in (0, 1, 3, 50, 700, 60_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, n // 9, n // 2, n):
            b = np.unique(np.concatenate([a[m:], rng.integers(0, 1 << 63, m + n // 3).astype(np.uint64)]))
            least = nearcopy.least_difference(nearcopy.bits_of(a), nearcopy.bits_of(b))
            assert least <= len(np.setxor1d(a, b)) and (n < 50 or n > 700 or 2 * least > len(np.setxor1d(a, b)))


def test_like_texts_that_do_not_link_move_no_sets(spark, monkeypatch):
    """Copies that share two thirds with each other meet in every prefix; their whole sets stay where they are."""
    from pyspark.sql import functions as F

    from sievemark.llm import nearcopy

    rng, base, rows = np.random.default_rng(8), [f"w{k}" for k in range(150)], []
    for i in range(100):
        copy = list(base)
        for j, at in enumerate(rng.choice(15, 3, replace=False)):
            copy[10 * at + 5] = f"n{i}x{j}"
        rows.append((i, " ".join(copy)))
    marked = nearcopy.materialize(nearcopy.map_arrow(spark.createDataFrame(rows, "row bigint, text string"), nearcopy._marked("text"), "row bigint, text string, code bigint, print bigint"), "marked")
    codes = marked.groupBy("code").agg(F.struct(F.min("row").alias("r")).alias("least"), F.min("print").alias("print"))
    moved, confirmed = [], nearcopy.confirmed
    monkeypatch.setattr(nearcopy, "confirmed", lambda pairs, *rest: (moved.append(pairs.count()), confirmed(pairs, *rest))[1])
    sets = {r.code: shingles(r.text) for r in marked.collect()}
    got = nearcopy.links(marked, codes, by_print=False).collect()
    linked = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    assert len(got) >= bool(linked) and {tuple(sorted((r.a, r.b))) for r in got} <= set(linked)
    assert sum(moved) < 500
