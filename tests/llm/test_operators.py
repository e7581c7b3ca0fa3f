"""Training-data operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("sievemark.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from sievemark.llm import decontaminate, language, license, mixing, quality, search, simhash, tokencount, tokenfile, urlfilter  # noqa: E402
from sievemark.llm.queries import URL_RULES, tokenizer_path  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row bigint, lang_pred string"


def text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n)) + "."


def rows():
    base = [(k, text(k % 7), "en", f"s{k % 3}") for k in range(24)]
    odd = [(100, None, None, None), (101, "", "en", "s0"), (102, "  \n\t ", None, "s0"), (103, "Short", "en", None), (104, text(5, 9000), "en", "s1"), (104, text(5, 9000), "en", "s1"), (None, text(3), "en", "s2"), (105, "12 34 !!", "en", "s1"), (106, "Ünïcode éà ñ 日本語 " * 3, "fr", "s2")]
    return [(i, t, lang, s, len(t or ""), 0.5, i, "x") for i, t, lang, s in base + odd]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library_ids(t):
    """Ids by the library alone, in its default way."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, none, tmp_path):
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(107).cast("bigint")).withColumn("text", F.lit("a<|endoftext|>b  <|endoftext|> c")))
    folder = tmp_path.as_uri()
    found = tokenfile.round_trip(docs, tokenizer_path(), 2, folder).collect()
    want = sorted([*((r[0], r[1] or "") for r in rows()), (107, "a<|endoftext|>b  <|endoftext|> c")], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, expected = 0, []
    for i, t in want:
        ids = [*library_ids(t), 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in found)
    files = [p for p in tmp_path.iterdir() if p.name.startswith("ids-") and p.suffix == ".zst"]
    import zstandard
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(files[0])) as f:
        reader = tokenfile.TokenFileReader(f)
        whole = b"".join(reader.read(k).tobytes() for k in range(len(reader.doc_ids)))
    with open(files[0], "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(len(whole) + 10) == whole  # any decoder reads it
    data = bytearray(files[0].read_bytes())
    data[9] ^= 0xFF
    files[0].write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(files[0])) as f, pytest.raises(Exception):
        tokenfile.TokenFileReader(f).read(0)
    assert tokenfile.round_trip(none, tokenizer_path(), 2).count() == 0


@pytest.mark.parametrize("literal", [False, True])
def test_memo_gives_the_ids_of_whole_texts(literal):
    from sievemark.llm.encoding import Encoder

    enc = Encoder(tokenizer_path(), literal)
    odd = ["", " ", "a  b", "it's", "\n\n x", "a \n b", "x y", "\t a", "tail ", "<|endoftext|>", "a<|endoftext|>b", "日本 語。", "é. È!", "a" * 300, "w1 w2. w3,\nw4"]
    for _ in range(2):
        assert enc.encode(odd) == enc.whole(odd)
    assert literal or np.frombuffer(enc.encode(["a<|endoftext|>b"])[0], "<u2").tolist() == library_ids("a<|endoftext|>b")


def test_memo_stays_within_its_bytes():
    from sievemark.llm.encoding import Encoder

    limit = 1 << 20
    enc = Encoder(tokenizer_path(), memo_bytes=limit)
    common = " the of and"
    for k in range(40):
        texts = [common + " ".join(f"w{k}x{i}{'!' * (i % 40)}" for i in range(500)), f"word{'abc' * (k % 7)} " * 5 + common]
        assert enc.encode(texts) == enc.whole(texts)
        held = sum(150 + len(p) + len(ids) for half in (enc.memo.young, enc.memo.old) for p, ids in half.items())
        assert held <= limit + 400
    assert len(enc.memo.young) + len(enc.memo.old) < 20_000


def test_token_counts_stitch_blocks(spark, docs, none):
    from sievemark.llm.encoding import encoder

    enc = encoder(tokenizer_path(), literal=True)
    want = sorted((r[0] if r[0] is not None else -1, len(enc.whole([r[1] or ""])[0]) // 2) for r in rows())
    for block in (7, 1000, 1 << 20):
        got = tokencount.token_counts(docs, tokenizer_path(), 50256, block_ids=block).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == want
    assert tokencount.token_counts(none, tokenizer_path(), 50256).count() == 0


def test_unterminated_flat_file(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], "<u2").tofile(tmp_path / "a.bin")
    got = tokencount.scan_flat_files(spark, tmp_path.as_uri(), ["a.bin"], 9, 2, 2).orderBy("place").collect()
    assert [(r.place, r.n_tokens, r.ended) for r in got] == [(0, 2, True), (1, 0, True), (2, 1, False)]


def test_mixing_meets_targets(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    for (_, size, target), taken in by.items():
        assert sum(taken) == int(target) <= 3 * size
    assert abs(sum(t for _, _, t in by) - sum(n for _, n, _ in by)) < 1e-6
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: repr((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0
    kept = mixing.repeat_to_targets(docs)
    assert kept.columns == docs.columns and kept.count() > 0


def test_water_fill():
    assert mixing.water_fill([10, 10, 1000], [5, 2, 1], 1020) == [30.0, 30.0, 960.0]
    assert mixing.water_fill([0, 5], [5, 2], 5) == [0.0, 5.0]
    assert mixing.water_fill([], [], 0) == []


def brute_fingerprint(t):
    import xxhash

    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, docs, none):
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    codes = [(r[0], brute_fingerprint(r[1])) for r in rows()]
    assert sorted(repr((i, f"{c:016x}")) for i, c in codes) == sorted(repr((r.doc_id, r.fingerprint)) for r in got)
    group = {}
    for _, c in codes:
        same = {d for d in group if bin(c ^ d).count("1") <= 2} | {c}
        reach = set().union(*(group.get(d, {d}) for d in same))
        for d in reach:
            group[d] = reach
    least = {c: min((i for i, d in codes if d in group[c] and i is not None), default=None) for _, c in codes}
    assert all(r.component_id == least[int(r.fingerprint, 16)] for r in got)
    assert simhash.near_duplicates(none).count() == 0
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len({repr(sorted(g)) for g in group.values()})


@pytest.mark.parametrize("seed", range(3))
def test_forest_links_all_near_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 2), np.uint64)
    codes = np.unique(np.concatenate([base, base[rng.integers(0, 40, 400)] ^ flips[:, 0] ^ flips[:, 1]]))
    a, b = simhash.forest(codes[::2], codes[1::2])
    root = {int(c): int(c) for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        root[find(x)] = find(y)
    members = codes[::2].tolist()
    for i, x in enumerate(members):
        for y in [*members[i + 1 :], *codes[1::2].tolist()]:
            if bin(x ^ y).count("1") <= 2:
                assert find(x) == find(y)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a bigint, b bigint")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert len({labels[k] for k in range(301)}) == 1 and labels[1000] == labels[1001] != labels[0] and len(labels) == 303


def test_decontamination_blocks_agree(spark, docs, none):
    items = [(1, " ".join(text(0).split()[5:25])), (2, "short"), (2, "short"), (3, None), (4, ""), (None, " ".join(text(1).split()[:10])), (5, "nowhere to be found in any of the documents at hand, really")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = decontaminate.digest(decontaminate.decontaminate(docs, bench)).collect()
    many = decontaminate.digest(decontaminate.decontaminate(docs, bench, block_nodes=100)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, one)) == sorted(map(key, many)) and len(one) == len(rows())
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in set(items):
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    want = []
    for r in rows():
        w, hit, found = split(r[1]), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        want.append((r[0], len(w), len(hit), len(found)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items)) for r in one)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0
    for nodes in (decontaminate.BLOCK_NODES, 100):
        assert decontaminate.drop_contaminated(docs, bench, block_nodes=nodes).count() == sum(1 for x in want if x[2] == 0)


def test_spans_map_to_the_original():
    data = "Ah, BETA-gamma é!".encode()
    assert [data[a:b].decode() for a, b in decontaminate.original_spans(data, np.array([False, True, True, False]))] == ["BETA-gamma"]


def test_language(spark, docs, none):
    en, fr = "the cat sat on the mat and then the dog ran", "le chat est sur la table et puis le chien court"
    known = spark.createDataFrame([(k, f"{(en if k % 2 else fr)} {k}", "en" if k % 2 else "fr") for k in range(40)] + [(90, None, "en"), (91, "x y", None)], "doc_id bigint, text string, lang string")
    model = language.train(known)
    assert model[0] == ["en", "fr"]
    asked = spark.createDataFrame([(1, "the dog and the cat"), (2, "le chien et la table"), (3, None), (4, "12 !"), (5, "the dog and the cat " * 60_000)], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(asked, model, ["doc_id"], "text").collect()}
    assert [got[k][0] for k in range(1, 6)] == ["en", "fr", "und", "und", "en"] and got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language.predict(asked, language.train(none), ["doc_id"], "text").collect()} == {"und"}
    assert language.drop_unknown(docs).columns == docs.columns
    whole, parts = language.cosines(["the dog and the cat " * 60_000], model[1]), language.cosines(["the dog and the cat "], model[1])
    assert np.allclose(whole, parts, atol=0.02)


def test_quality_rules(spark, docs, none):
    good = [(k, text(k), 1, 0) for k in range(80)]
    bad = [(100 + k, " ".join(w + "###" for w in text(k).split()), 0, 0) for k in range(40)]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in good + bad] + [(999, None), (998, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in good + bad] + [(1, 1, 0), (None, 1, 0), (5000, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(d, labels)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    assert all(got[i].predicted == q for i, _, q, _ in good + bad) and 0 <= got[999].score <= 1 and got[999].score == got[998].score
    x = np.array([[r[f"stat_{k}"] for k in quality.STATS] for r in quality.with_statistics(d).orderBy("doc_id").collect()])
    assert np.allclose(model.scores(x), [got[i].score for i in sorted(got)])
    assert quality.train(d, labels.where("false")).rules == []
    assert quality.score(docs.drop("score"), model).count() == len(rows()) and quality.train(none, labels).rules == []


def test_licenses_native_agrees_with_plain(spark, docs, none):
    lines = {1: ("mit", "Released under the MIT License."), 2: ("apache", "Licensed under the Apache License, Version 2.0."), 3: ("gpl", "This work is licensed under the GNU General Public License, version 3."), 4: ("proprietary", "All rights reserved."), 5: ("cc-by-nc", "Licensed under CC BY-NC 4.0."), 6: ("none", "nothing here at all"), 7: ("unknown", "Licensed under the terms of the Foo vendor license.")}
    d = spark.createDataFrame([(i, f"{text(i)}\n{line}\n{text(i + 1)}") for i, (_, line) in lines.items()] + [(8, None), (9, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license.scan(d).collect()}
    assert {i: got[i].license for i in lines} == {i: name for i, (name, _) in lines.items()} and got[8].license == got[9].license == "none"
    model = license.train(license._background(d, "text"))
    for i, (name, line) in lines.items():
        if got[i].confirmed:
            assert license.classify(line, model) == pytest.approx((name, got[i].probability), abs=1e-4)
    assert license.scan(docs).count() == len(rows()) and license.scan(none).count() == 0


def test_license_plan_is_native(docs):
    plan = license.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!.*metadata)", plan)


def test_url_filter(spark):
    cases = [
        ("https://A.example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://b.net/z#f", "b.net", "/z", "net/", "block"), ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("https://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"), ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("https://example.net", "example.net", "", None, "allow"),
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("https://planet/", "planet", "/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], None, "x") for k, c in enumerate(cases)], "page_id bigint, url string, html string, host string")
    many = URL_RULES + [urlfilter.UrlRule("block", f"h{k}.test/") for k in range(300)]
    for rules in (URL_RULES, many):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
        assert got == {k: c[1:] for k, c in enumerate(cases)}
    assert urlfilter.judge(pages.where("false"), URL_RULES).count() == 0


def test_distrust_flows_to_linking_hosts(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [(1, "https://bad.net/", ""), (2, "https://farm.example.com/", link("bad.net", "bad.net", "worse.net")), (3, "https://fine.example.com/", link("good.org")), (4, "https://good.org/fr/", link("fine.example.com")), (5, "https://worse.net/", ""), (6, "https://alone.example.com/", "")]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), URL_RULES).collect()}
    assert [got[k].verdict for k in range(1, 7)] == ["block", "block", "allow", "allow", "block", "allow"]
    edges = np.zeros((3, 3))
    edges[0, 1], edges[0, 2], edges[1, 2] = 0.5, 0.5, 1.0
    seed, mass = np.array([1.0, 0, 0]), np.array([1.0, 0, 0])
    for _ in range(200):
        mass = 0.15 * seed + 0.85 * (edges.T @ mass + np.array([0, 0, mass[2]]))
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "c", 2)], "src string, dst string, n bigint")
    r = {x.host: x.mass for x in urlfilter.propagate(e, spark.createDataFrame([("a", 1.0)], "host string, seed double"), tolerance=1e-6).collect()}
    assert np.allclose([r["a"], r["b"], r["c"]], mass, atol=1e-3)


def test_search_against_brute_force(spark, docs, none):
    got = search.top_k(docs.repartition(5), F.col("doc_id") % 20 == 0, top=5).collect()
    parsed = [(r[0], [w.decode() for w in decontaminate.words_of((r[1] or "").encode())]) for r in rows()]
    n, mean = len(parsed), sum(len(w) for _, w in parsed) / len(parsed)
    df = {}
    for _, w in parsed:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    want = []
    for q, qw in parsed:
        if q is None or q % 20:
            continue
        scored = []
        for d, w in parsed:
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(qw) & set(w))
            if s > 0:
                scored.append((-round(s, 6), d if d is not None else 1 << 62, d))
        want += [(q, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:5])]
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    assert [key(r) for r in sorted(map(tuple, got), key=key)] == [key(r) for r in sorted(want, key=key)]
    assert search.top_k(none, F.lit(True)).count() == 0


def test_clashing_column_names(spark, docs):
    """Extra columns that have the operators' own names neither break them nor come twice."""
    own = ["score", "predicted", "lang_pred", "_cut", "_source", "_turn", "_words", "_chars", "stat_log_words", "c0", "key", "size", "row", "code", "r"]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(k).alias(n) for k, n in enumerate(own)))
    mixed = mixing.repeat_to_targets(more)
    assert mixed.columns == more.columns and mixed.count() == mixing.repeat_to_targets(docs).count()
    scored = quality.score(more, quality.RuleModel(0.5))
    assert sorted(scored.columns) == sorted(more.columns) and {r.score for r in scored.collect()} == {1 / (1 + np.exp(-0.5))}
    said = language.predict(more, language.train(more), more.columns)
    assert sorted(said.columns) == sorted(more.columns) and said.where("lang_pred = 'en'").count() > 20
    assert language.drop_unknown(more).columns == simhash.keep_one(more).columns == more.columns
    bench = spark.createDataFrame([(1, "short")], "item_id bigint, text string")
    assert decontaminate.drop_contaminated(more, bench, block_nodes=1).columns == more.columns


def test_held_out_queries_against_their_parts(spark):
    """The bodies of op5 and op8: learned from the one part, right about the other, and never from the columns they may not see."""
    en, fr = "the cat sat on the mat and then the dog ran off into the wood", "le chat est sur la table et puis le chien court vers la forêt"
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        good = k % 2
        words = rng.permutation((en if k % 3 else fr).split() * 4).tolist()
        rows.append((k, (" ".join(words).capitalize() + ".") if good else " ".join(w.upper() + "!!! $$$" for w in words[:6]), "en" if k % 3 else "fr", "s", good))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows], "doc_id bigint, quality int, toxic int")
    got = language.held_out_prediction(docs).collect()
    assert [r.held_out for r in sorted(got, key=lambda r: r.doc_id)] == [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(300)]
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in got)
    # Languages of held-out rows are never seen: with them overwritten, every prediction stays.
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(repr, language.held_out_prediction(hidden).collect())) == sorted(map(repr, got))
    scored = quality.held_out_score(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) == rows[r.doc_id][4] for r in scored)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    assert sorted(map(repr, quality.held_out_score(docs, flipped).collect())) == sorted(map(repr, scored))
