"""Spelling variants against a search of all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sievemark.llm.queries")

from sievemark.llm import spelling  # noqa: E402

SCHEMA = "doc_id bigint, text string, word string, n int, key string, best string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, times=10, typos=True):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typos and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    out = {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        out[w] = (n[w], len(others), others[0] if others and n[others[0]] >= times * n[w] else None)
    root = lambda w: root(out[w][2]) if out[w][2] else w
    return {w: (k, m, f, n.get(f), root(w)) for w, (k, m, f) in out.items()}


def rows():
    rng = np.random.default_rng(5)
    base = ["aaaaaaaa", "bananananas", "Straßenbahn", "GÉOMÉTRIE", "committee", "accommodation", "x" * 70]
    out = []
    for k in range(60):
        words = []
        for _ in range(60):
            w = base[int(rng.integers(len(base)))]
            for _ in range(int(rng.integers(8)) // 5):
                at, c = int(rng.integers(len(w))), "abmßéx"[int(rng.integers(6))]
                w = (w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :])[int(rng.integers(3))]
            words.append(w)
        out.append((k % 50, " ".join(words) + ".\nŁódź 日本 committee2committee×÷"))
    return out + [(None, "Committee committee accommodation"), (100, None), (101, ""), (101, "")]


@pytest.mark.parametrize("long", [64, 8])
def test_variants_against_all_pairs(spark, long):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 0, "k", "b") for i, t in data], SCHEMA).repartition(3)
    for times in (10, 2):
        found = spelling.variants_of(spelling.word_counts(docs, typos=True), times, long).collect()
        assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == brute(data, times)
        assert len({r.word for r in found}) == len(found)
    plain = spelling.variants(docs).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in plain} == brute(data, typos=False)
    assert spelling.variants(docs.limit(0), typos=True).count() == 0


def test_keys_of_long_words_are_the_same():
    word = bytes(np.random.default_rng(1).integers(97, 123, 1000, np.uint8))
    own, at, keys = spelling.deletion_keys([b"another", word])
    whole = dict(zip(at[own == 1].tolist(), keys[own == 1].tolist()))
    parts = {}
    for places, some in spelling.long_word_keys(word, block=64):
        parts.update(zip(places.tolist(), some.tolist()))
    assert parts == whole
    shorter = spelling.deletion_keys([word[:10] + word[11:]])
    assert whole[10] == shorter[2][-1]


def test_strings_decide_where_keys_collide():
    assert list(spelling.met(iter([(0, "abcdefg", 5), (0, "hijklmn", 9), (-1, "opqrstu", 7)]))) == []


def test_chains_of_forms(spark):
    words = [("a" * 7 + "b" * k, 10**k) for k in range(12)]
    found = spelling.variants_of(spark.createDataFrame(words, "word string, n bigint")).collect()
    assert {r.root for r in found} == {words[-1][0]}
    assert {r.word: r.form for r in found} == {w: words[k + 1][0] if k < 11 else None for k, (w, _) in enumerate(words)}
