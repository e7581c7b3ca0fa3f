"""Language identification by hyperdimensional n-gram profiles.

Every letter symbol has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, the first
permuted twice, the second once; permuting is a rotation. A text's vector bundles (sums) the vectors of all its trigrams; a
language's prototype bundles those of all its training texts. A text takes the language whose prototype has the largest
cosine with it.

Symbols: 0 is any run of non-letters, 1 to 26 are a to z, every other letter is dealt to one of 37 more by its lower-case code
point. Letters of rare scripts share symbols, which leaves memory bounded by 64 ** 3 trigrams. Training sums trigram counts
per language over all training rows (no sample), and every task bundles its own counts; what is shuffled and reaches the driver is one
vector per language: ``MAX_LANGUAGES`` * ``DIMENSIONS`` numbers at most.

Edge cases: a text that is null or has no letter is ``und`` with score 0; if no row has a language, so is every text; equal
cosines go to the language first in code point order; repeated rows stay.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, map_arrow

SYMBOLS, ORDER = 64, 3
GRAMS = SYMBOLS**ORDER
DIMENSIONS = 1024
SEED = 20240
MAX_LANGUAGES = 128
#: Characters and texts handled at once, and trigram vectors held at once.
RUN_CHARS, RUN_TEXTS, RUN_GRAMS = 1 << 19, 256, 4096
UNKNOWN = "und"
#: Cosine that an unrelated text stays below but once in some 700: three deviations of a random vector's.
CHANCE = 3 / DIMENSIONS**0.5
#: Letters from which on a document with such a cosine is rejected.
ENOUGH = 100

_SYMBOL_OF: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of every code point; made once per process."""
    if not _SYMBOL_OF:
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        for cp in range(sys.maxunicode + 1):
            if (c := chr(cp)).isalpha():
                low = ord(c.lower()[0])
                out[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % 37
        _SYMBOL_OF.append(out)
    return _SYMBOL_OF[0]


def letter_vectors() -> tuple[np.ndarray, ...]:
    """Random letter vectors, rotated by 2, 1 and 0 places for the first, second and third letter of a trigram."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    return tuple(np.roll(base, k, axis=1) for k in range(ORDER - 1, -1, -1))


def gram_vectors(grams: np.ndarray, letters: tuple[np.ndarray, ...]) -> np.ndarray:
    first, second, third = letters
    return first[grams >> 12] * second[grams >> 6 & 63] * third[grams & 63]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, trigram) of every trigram that has a letter; each text stands between two boundaries."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = symbol_table()[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    keep = np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))
    owner = np.concatenate(([0], owner))[keep]
    symbols = symbols[keep].astype(np.int32)
    if len(symbols) < ORDER:
        return np.array([], np.int64), np.array([], np.int32)
    # A trigram with a boundary inside (letter, boundary, letter) would tie two words or texts; only its ends may be boundaries.
    inner = symbols[1:-1] != 0
    grams = (symbols[:-2] << 12 | symbols[1:-1] << 6 | symbols[2:])[inner]
    return owner[1:-1][inner], grams


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in runs of bounded size; a very long text comes in pieces cut where no letter stands, which changes no trigram."""
    rows, parts, size = [], [], 0
    for k, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = at + RUN_CHARS
            while end < len(text) and text[end].isalpha():
                end += 1
            piece, at = text[at:end], end
            rows.append(k)
            parts.append(piece)
            size += len(piece)
            if size >= RUN_CHARS or len(parts) >= RUN_TEXTS:
                yield rows, parts
                rows, parts, size = [], [], 0
            if at >= len(text):
                break
    if parts:
        yield rows, parts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for rows, parts in _runs(batch.column("text").to_pylist()):
            owner, grams = grams_of(parts)
            names = sorted({langs[k] for k in rows})
            place = {n: i for i, n in enumerate(names)}
            at = np.array([place[langs[k]] for k in rows])
            keys, counts = np.unique(at[owner] * GRAMS + grams, return_counts=True)
            for i, n in enumerate(names):
                own = keys // GRAMS == i
                if n not in sums:
                    if len(sums) == MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    sums[n] = np.zeros(GRAMS, np.int64)
                sums[n][keys[own] % GRAMS] += counts[own]
    letters = letter_vectors()
    for n, total in sums.items():
        bundle = np.zeros(DIMENSIONS, np.int64)
        some = np.flatnonzero(total)
        for k in range(0, len(some), RUN_GRAMS):
            bundle += total[some[k : k + RUN_GRAMS]] @ gram_vectors(some[k : k + RUN_GRAMS], letters).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(bundle)], names=["lang", "k", "v"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their prototypes, one row each and of length 1. Tasks bind and bundle what they read; whole
    numbers are summed, so that the order doesn't matter."""
    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    summed = map_arrow(known, _count, "lang string, k int, v bigint").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():  # DIMENSIONS rows a language
        if r.lang not in found and len(found) == MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r.k] = r.v
    names = sorted(found)
    rows = [found[n] / max(np.linalg.norm(found[n]), 1e-300) for n in names]
    return names, np.array(rows).reshape(len(names), DIMENSIONS)


def cosines(texts: list[str | None], prototypes: np.ndarray) -> np.ndarray:
    """Cosine of each text with each prototype; NaN where a text has no letter."""
    letters, bundle = letter_vectors(), np.zeros((len(texts), DIMENSIONS), np.float32)
    for rows, parts in _runs(texts):
        owner, grams = grams_of(parts)
        distinct, place = np.unique(grams, return_inverse=True)
        for k in range(0, len(distinct), RUN_GRAMS):
            some = distinct[k : k + RUN_GRAMS]
            inside = (place >= k) & (place < k + RUN_GRAMS)
            counts = np.bincount(owner[inside] * len(some) + place[inside] - k, minlength=len(parts) * len(some)).reshape(len(parts), len(some))
            np.add.at(bundle, rows, counts.astype(np.float32) @ gram_vectors(some, letters).astype(np.float32))
    length = np.linalg.norm(bundle, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (bundle @ prototypes.T.astype(np.float32)) / length[:, None]


def _predictor(names: list[str], prototypes: np.ndarray, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if names:
                cos = cosines(texts, prototypes)
                known = ~np.isnan(cos[:, 0])
                best = np.argmax(np.where(known[:, None], cos, 0), axis=1)
                score = np.where(known, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0.0)
                pred = [names[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            else:
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], names=[*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score`` (the cosine, not below 0), in place of columns that have these names."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    own = [f"c{k}" for k in range(len(keep))]
    slim = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, own)), F.col(text).cast("string").alias("text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.drop("text").schema)
    return map_arrow(slim, _predictor(*model, own, "text"), f"{schema}lang_pred string, score double").toDF(*keep, "lang_pred", "score")


def held_out_prediction(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32 isn't 1 modulo 3 and predicts all."""
    held = crc32_of("doc_id") % 3 == 1
    model = train(docs.where(~F.coalesce(held, F.lit(False))))
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the documents that no learned language claims: those without any letter, and those of ``ENOUGH`` letters or more
    whose largest cosine is one that chance gives (another script, codes, noise). Shorter ones tell too little to be rejected.

    Where no row has a language nothing can be identified, and every document stays.
    """
    columns = docs.columns
    slim = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    text = f"c{columns.index(text)}"
    model = train(slim, text, f"c{columns.index(lang)}")
    if not model[0]:
        return docs
    found = predict(slim, model, slim.columns, text)
    by_chance = F.when(F.col("score") < CHANCE, F.regexp_count(F.col(text).cast("string"), F.lit(r"\p{L}")) >= ENOUGH).otherwise(False)
    return found.where((F.col("lang_pred") != UNKNOWN) & ~by_chance).drop("lang_pred", "score").toDF(*columns)
