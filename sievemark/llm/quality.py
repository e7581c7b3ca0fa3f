"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted shallow trees are grown on labelled documents; every path from a root becomes a rule, a conjunction of comparisons.
A lasso logistic regression (proximal gradient) weighs the rules and drops most. What stays is compiled into one Spark column, so
scoring runs in the JVM: statistics in one projection, rules in the next, no shuffle.

Training takes all labelled rows up to ``MAX_TRAIN`` documents; beyond, a sample by hash of the id of about that size. Statistics
are computed on whole texts.

Edge cases: null and empty texts have all statistics 0 and are scored like any other; labels that repeat or contradict for a
document are averaged (0.5 and over counts as 1); without labelled rows, or with one class only, the score is that class's
share (0.5 without rows); repeated documents stay; columns of other names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, crc32_of

MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
MIN_LEAF = 5
LAMBDAS = (0.03, 0.01, 0.003, 0.001)
THRESHOLD = 0.3

#: What is counted in a text, as regular expressions.
COUNTED = {
    "words": WORD_RE,
    "symbols": r"""[^\p{L}\p{N}\p{M}\s.,;:!?'"()\-]""",
    "capitals": r"\p{Lu}",
    "digits": r"\p{Nd}",
    "shouts": r"!",
    "echoes": r"(?<!\S)(?=(\S{1,64})\s+\1(?!\S))",
    "stops": r"[.!?](?=\s|$)",
    "giants": r"\S{25,}",
}
STATS = ("log_words", "word_length", "symbol_rate", "capital_rate", "digit_rate", "shout_rate", "echo_rate", "stop_rate", "giant_rate", "distinct_rate", "line_rate", "same_line_rate")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns ``STATS`` prefixed by ``stat_``; numbers of the whole text only."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.split(t, "\n")
    counted = docs.select(
        "*",
        F.length(t).alias("_chars"),
        *(F.regexp_count(t, F.lit(p)).alias(f"_{k}") for k, p in COUNTED.items()),
        F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+"))).alias("_distinct"),
        F.size(lines).alias("_lines"),
        F.size(F.array_distinct(lines)).alias("_own_lines"),
    )
    chars, words = F.greatest(F.col("_chars"), F.lit(1)), F.greatest(F.col("_words"), F.lit(1))
    made = {
        "log_words": F.log1p("_words"),
        "word_length": F.col("_chars") / words,
        "symbol_rate": F.col("_symbols") / chars,
        "capital_rate": F.col("_capitals") / chars,
        "digit_rate": F.col("_digits") / chars,
        "shout_rate": F.col("_shouts") / words,
        "echo_rate": F.col("_echoes") / words,
        "stop_rate": F.col("_stops") / words,
        "giant_rate": F.col("_giants") / words,
        "distinct_rate": F.when(F.col("_words") > 0, F.col("_distinct") / words).otherwise(0.0),
        "line_rate": F.when(F.col("_words") > 0, F.col("_lines") / words).otherwise(0.0),
        "same_line_rate": 1 - F.col("_own_lines") / F.greatest(F.col("_lines"), F.lit(1)),
    }
    return counted.select(*docs.columns, *(made[k].cast("double").alias(f"stat_{k}") for k in STATS))


@dataclass(frozen=True)
class Rule:
    """All of ``value > threshold`` (above) or ``value <= threshold`` for the named statistics."""

    tests: tuple[tuple[str, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.tests:
            v = x[:, STATS.index(name)]
            out &= v > at if above else v <= at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, (name, above, at) in enumerate(self.tests):
            test = F.col(f"stat_{name}") > at if above else F.col(f"stat_{name}") <= at
            out = test if k == 0 else out & test
        return out


@dataclass
class RuleModel:
    bias: float = 0.0
    rules: list[tuple[float, Rule]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for w, r in self.rules:
            z += w * r.on(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a Spark column over the ``stat_`` columns."""
        z = F.lit(float(self.bias))
        for w, r in self.rules:
            z = z + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, tests: tuple, depth: int, step: np.ndarray, rules: list[Rule]) -> None:
    """One node of a boosting tree; notes its path as a rule and its Newton step for the rows in it."""
    if tests:
        rules.append(Rule(tests))
    g, h = grad[rows].sum(), hess[rows].sum()
    step[rows] = -g / (h + 1)
    if depth == DEPTH or len(rows) < 2 * MIN_LEAF:
        return
    best, found = 1e-6, None
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        place = np.searchsorted(at, x[rows, f], side="left")  # value <= at[k] falls in 0..k
        gs = np.cumsum(np.bincount(place, grad[rows], len(at) + 1))[:-1]
        hs = np.cumsum(np.bincount(place, hess[rows], len(at) + 1))[:-1]
        ns = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (f, float(at[k]))
    if found is None:
        return
    f, at = found
    low = x[rows, f] <= at
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _grow(x, grad, hess, cuts, part, (*tests, (STATS[f], above, at)), depth + 1, step, rules)


def _lasso(features: np.ndarray, y: np.ndarray, strength: float, turns: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty, by accelerated proximal gradient."""
    mean = features.mean(axis=0)
    spread = np.sqrt(mean * (1 - mean)) + 1e-3
    z = np.hstack([(features - mean) / spread, np.ones((len(y), 1))])
    rate = 4 / max(np.linalg.norm(z.T @ z / len(y), 2), 1e-9)
    w = look = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(turns):
        p = 1 / (1 + np.exp(-z @ look))
        new = look - rate * (z.T @ (p - y) / len(y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * strength, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weights = w[:-1] / spread
    return float(w[-1] - weights @ mean), weights


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weighed by lasso; the penalty is the strongest within a hair of the best on a fifth held back."""
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1 or len(y) < 4 * MIN_LEAF:
        share = min(max(share, 0.01), 0.99)
        return RuleModel(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    margin = np.full(len(y), np.log(share / (1 - share)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), (), 0, step, rules)
        margin += RATE * step
    columns, kept = {}, []
    for r in dict.fromkeys(rules):
        on = r.on(x)
        if 0 < on.mean() < 1 and columns.setdefault(on.tobytes(), r) is r:
            kept.append(r)
    if not kept:
        return RuleModel(float(np.log(share / (1 - share))))
    features = np.array([r.on(x) for r in kept], np.float64).T
    back = np.random.default_rng(seed).random(len(y)) < 0.2

    def loss(strength: float) -> float:
        b, w = _lasso(features[~back], y[~back], strength)
        p = np.clip(1 / (1 + np.exp(-(features[back] @ w + b))), 1e-9, 1 - 1e-9)
        return float(-(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)).mean())

    if back.any() and 0 < y[~back].mean() < 1:
        losses = [loss(s) for s in LAMBDAS]
        strength = next(s for s, v in zip(LAMBDAS, losses) if v <= min(losses) * 1.02 + 1e-4)
    else:
        strength = LAMBDAS[1]
    bias, w = _lasso(features, y, strength)
    return RuleModel(bias, [(float(v), r) for v, r in zip(w, kept) if abs(v) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    """Fits on the documents of ``docs`` that have a label."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), "_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    # About max_train rows of 12 bytes, whatever the input.
    rows = with_statistics(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(known), "_id"), "_text")
    rows = rows.groupBy("_id").agg(F.max("_y").alias("y"), *(F.avg(f"stat_{k}").alias(k) for k in STATS)).orderBy("_id").collect()
    x = np.array([[r[k] for k in STATS] for r in rows], np.float64).reshape(len(rows), len(STATS))
    return fit(x, np.array([r.y for r in rows], np.float64))


def score(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, in place of columns that have these names."""
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    scored = with_statistics(docs.toDF(*own.values()), own[text]).withColumn("score", model.column())
    kept = (F.col(n).alias(c) for c, n in own.items() if c not in ("score", "predicted"))
    return scored.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from documents whose crc32 isn't 0 modulo 5 and scores all."""
    held = F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False))
    model = train(docs.where(~held), labels.where(~held))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
