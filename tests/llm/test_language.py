"""Language identification against profiles bound and bundled trigram by trigram."""

import numpy as np
import pytest

pytest.importorskip("sievemark.llm.queries")

from sievemark.llm import language  # noqa: E402
from sievemark.llm.common import crc32_of  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, score double, lang_pred string"


def symbol(c):
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % 37


def bundle(text):
    """The sum of a text's trigram vectors; a run of other characters is one boundary."""
    base = np.random.default_rng(language.SEED).choice(np.array([-1, 1], np.int8), (64, language.DIMENSIONS)).astype(np.int64)
    symbols = [0]
    for c in text or "":
        s = symbol(c)
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    total = np.zeros(language.DIMENSIONS, np.int64)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b:
            total += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return total


def profile(text):
    total = bundle(text).astype(float)
    return total / max(np.linalg.norm(total), 1e-300)


def profiles(rows):
    out = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            out[r[2]] = out.get(r[2], np.zeros(language.DIMENSIONS)) + bundle(r[1])
    return {k: v / max(np.linalg.norm(v), 1e-300) for k, v in out.items()}


def rows():
    rng = np.random.default_rng(2)
    make = lambda syllables, n: " ".join("".join(rng.choice(syllables, 3)) for _ in range(n))
    sets = {"en": ["th", "er", "on", "an"], "fr": ["é", "ou", "le", "ç"], "de": ["sch", "ü", "ei", "nd"]}
    base = [(k, make(sets[lang], 1 + k % 40), lang if k % 5 else None) for k, lang in enumerate(list(sets) * 40)]
    odd = [(900, None, "en"), (901, "", "fr"), (902, "12 -- 34", None), (903, "日本語" * 60, None), (904, "A", None), (905, "same same", "en"), (None, "thon eran", "en"), (906, "ſ İ K", None)]
    return [(i, t, lang, 0.5, "x") for i, t, lang in base + odd]


def test_predictions_equal_explicit_profiles(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (crc32_of("doc_id") % 3 == 1).alias("h")).collect()}
    prototypes = profiles([r for r in data if not held[r[0]]])
    names = sorted(prototypes)
    for r in language.held_out_prediction(docs).collect():
        text = next(t for i, t, *_ in data if i == r.doc_id)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = [float(profile(text) @ prototypes[n]) for n in names]
        assert abs(r.score - min(1, max(0, max(cos)))) < 1e-5
        assert cos[names.index(r.lang_pred)] > max(cos) - 1e-5
    assert language.held_out_prediction(docs.limit(0)).count() == 0


def test_equal_cosines_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "abc abd", "b"), (2, "abc abd", "a"), (3, "abc", None)], "doc_id bigint, text string, lang string")
    got = language.predict(docs, language.train(docs), ["doc_id"]).collect()
    assert {r.lang_pred for r in got} == {"a"}


def test_rejected_documents(spark):
    data = [(1, "the one and other " * 9, "en"), (2, "the", None), (3, "日本語処理" * 40, None), (4, "日本", None), (5, "12 !", None), (6, None, "en"), (7, "other one " * 20, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in language.drop_unknown(docs).collect()) == [1, 2, 4, 7]
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert sorted(r.doc_id for r in language.drop_unknown(unknown).collect()) == [1, 2, 3, 4, 5, 6, 7]
