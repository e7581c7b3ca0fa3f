import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sievemark.llm.common import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_output"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF), name)
        assert after.columns == columns
        assert after.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name != "source_mixing":
            assert after.count() <= before.count()
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count()


def test_stages_on_nothing(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert materialize(stage(spark, none, SF), f"none-{name}").count() == 0


def claimed(rows):
    """Rows that a language claims, by explicit binding and bundling of every trigram."""
    from .test_language import profile, profiles

    prototypes = profiles(rows)
    out = []
    for r in rows:
        letters = sum(c.isalpha() for c in r[1] or "")
        best = max((float(profile(r[1]) @ p) for p in prototypes.values()), default=0) if letters else 0
        if letters and (letters < 100 or best >= 3 / 32):
            out.append(r)
    return out


def brute_force(rows, items):
    """(doc_id, start, n_tokens, ids_crc32) of the whole pipeline in plain Python."""
    import hashlib
    import re
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from sievemark.llm.mixing import water_fill
    from sievemark.llm.queries import tokenizer_path
    from .test_nearcopy import kept_ids

    rows = claimed(rows)
    kept = set(kept_ids(rows))
    rows = [r for r in rows if r[0] in kept]
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for w in map(split, items) for k in range(max(1, len(w) - 9))}
    clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    rows = [r for r in rows if clean(split(r[1]))]
    size = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1])) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r[0]] for r in rows if r[3] == s) for s in sources]
    out = []
    for s, n, target in zip(sources, sizes, water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], sum(sizes))):
        epochs, left = divmod(int(target), n)
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()):
            own = size[r[0]]
            out += [r] * int((epochs * own + max(0, min(own, left))) / own + 0.5)
            left -= own
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(out):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_run_against_brute_force(spark, tmp_path):
    from .test_nearcopy import SCHEMA, planted

    item = " ".join(f"quiz{k}" for k in range(14))
    rows = [(i, t, lang, f"s{i % 4}" if i % 9 else None, n) for i, t, lang, _, n in planted() if i is not None]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(5000 + k, f"{'intro ' * k}{item} tail{k} and some more words about it", "en", "s1", 9) for k in range(3)] + [(6000, "123 456 !!", "en", "s0", 3), (6001, "ends with <|endoftext|> inside", "fr", "s2", 3)]
    greek = np.random.default_rng(8).integers(0x3B1, 0x3C9, (2, 400))
    rows += [(6002, " ".join("".join(map(chr, greek[0, k : k + 8])) for k in range(0, 400, 8)), None, "s1", 9), (6003, "".join(map(chr, greek[1, :40])), None, "s1", 9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    want = brute_force(rows, [item])
    assert got == sorted(want) and len(got) > 100 and not {r[0] for r in got} & {5000, 5001, 5002, 6000, 6002} and 6003 in {r[0] for r in got}
