"""Search of a shard by batches of queries: the same answers as brute force, with long lists read by block and few documents scored whole."""

import numpy as np
import pytest

pytest.importorskip("sievemark.llm.queries")

from sievemark.llm import search  # noqa: E402

TOP = 5


def corpus() -> list[tuple[int | None, list[str]]]:
    """Documents of a few topics with common words, copies, an empty one and one without an id."""
    rng = np.random.default_rng(7)
    out: list[tuple[int | None, list[str]]] = []
    for k in range(600):
        words = rng.zipf(1.3, int(rng.integers(1, 120)))
        out.append((k, [f"w{x}" if x < 40 else f"t{k % 7}x{x % 900}" for x in words.tolist()]))
    out += [(1000 + k, out[20 * k][1]) for k in range(6)] + [(None, out[40][1]), (2000, [])]
    return out


def found(docs, n_shards: int, top: int = TOP):
    """(query_id, doc_id, score) of every 20th document's best, and the shards; as a task would do it."""
    counted = [search._counted(" ".join(w).encode()) for _, w in docs]
    mean = sum(len(w) for _, w in docs) / len(docs)
    terms, df = np.unique(np.concatenate([k for k, _, _ in counted]), return_counts=True)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    asked = [(i, np.searchsorted(terms, c[0])) for (i, _), c in zip(docs, counted) if i is not None and i % 20 == 0]
    best, shards = [search.Best(top) for _ in asked], []
    for k in range(n_shards):
        part = range(k, len(docs), n_shards)
        shard = search.Shard(search.shard_parts([docs[i][0] for i in part], [False] * len(part), [counted[i] for i in part]), mean)
        rows = shard.rows_of(terms)
        there = [mine[rows[mine] >= 0] for _, mine in asked]
        shard.search([(rows[mine], idf[mine], b) for mine, b in zip(there, best)])
        shards.append(shard)
    return [(q, None if none else i, s) for (q, _), b in zip(asked, best) for i, none, s in zip(b.id.tolist(), b.no_id.tolist(), b.score.tolist())], shards


def wanted(docs, top: int = TOP):
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df: dict[str, int] = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, asked in docs:
        if q is None or q % 20:
            continue
        scored = []
        for d, w in docs:
            both = set(asked) & set(w)
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in both)
            if s > 0:
                scored.append((-round(float(s), 6), d is None, d or 0, d))
        out += [(q, d, -s) for s, _, _, d in sorted(scored)[:top]]
    return out


@pytest.mark.parametrize("long_cells, batch_cells", [(search.LONG_CELLS, search.BATCH_CELLS), (3000, 1), (0, 2000)])
def test_batches_against_brute_force(monkeypatch, long_cells, batch_cells):
    monkeypatch.setattr(search, "LONG_CELLS", long_cells)
    monkeypatch.setattr(search, "BATCH_CELLS", batch_cells)
    docs = corpus()
    want = wanted(docs)
    for n_shards in (1, 4):
        got, _ = found(docs, n_shards)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


def test_long_lists_are_read_by_block_and_few_documents_scored(monkeypatch):
    """No query reads a long list by itself, a batch multiplies each block once, and bounds settle most documents."""
    read, scored = [], []
    given, scores = search.Shard._given, search.Shard.scores
    monkeypatch.setattr(search.Shard, "_given", lambda self, rows, weights: read.append(self.long[rows].max(initial=-1)) or given(self, rows, weights))
    monkeypatch.setattr(search.Shard, "scores", lambda self, places, rows, weights: scored.append(len(places)) or scores(self, places, rows, weights))
    docs = corpus()
    got, shards = found(docs, 3)
    asked = len({q for q, _, _ in got})
    assert all(len(s.block_most) > 10 for s in shards) and max(read) == -1
    # 335; the search of one query at a time scored 431.
    assert asked == 31 and sum(scored) < 400


def test_copies_are_scored_in_portions(monkeypatch):
    """Documents that all tie are scored whole, some at a time, and the smallest ids stay."""
    sizes = []
    scores = search.Shard.scores
    monkeypatch.setattr(search.Shard, "scores", lambda self, places, rows, weights: sizes.append(len(places)) or scores(self, places, rows, weights))
    got, _ = found([(k, ["a", "b", "c"]) for k in range(299, -1, -1)], 2)
    assert [d for q, d, _ in got if q == 100] == list(range(TOP))
    assert max(sizes) <= search.SCORED and sum(sizes) == 300 * 15


def test_small_blocks_and_steps_against_brute_force(monkeypatch):
    """Words with long lists in some blocks and short ones in others, and blocks that end after any of many steps."""
    for name, value in (("BLOCK", 16), ("STEP", 2), ("LONG_SHARE", 0.2), ("READ_POSTINGS", 300)):
        monkeypatch.setattr(search, name, value)
    docs = corpus()
    want = wanted(docs)
    got, shards = found(docs, 2)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)
    assert all(((s.wide >= 0) & (s.size > 0)).any() and max(map(len, s.steps)) > 3 for s in shards)


class Read:
    """An array that counts the rows that slices take of it."""

    def __init__(self, whole):
        self.whole, self.rows = whole, 0

    def __getitem__(self, some):
        self.rows += len(self.whole[some])
        return self.whole[some]


def test_short_documents_are_left_after_few_steps(monkeypatch):
    """Maxima let queries open blocks of short documents; what these have at all ends them before most of the lists are multiplied."""
    for name, value in (("BLOCK", 32), ("STEP", 8), ("LONG_SHARE", 0.1)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    docs = [(k, [f"w{x}" for x in rng.integers(0, 300, 40 if k % 20 else 400).tolist()]) for k in range(640)]
    opened, multiplied = [], []
    steps = search.Shard._opened

    def counted(self, block, *rest):
        whole, self.out = self.out, Read(self.out)
        out = steps(self, block, *rest)
        if not (self.ids % 20 == 0).any():
            opened.append(self.cuts[block + 1] - self.cuts[block])
            multiplied.append(self.out.rows)
        self.out = whole
        return out

    monkeypatch.setattr(search.Shard, "_opened", counted)
    got, _ = found(docs, 2)
    assert [x[:2] for x in got] == [x[:2] for x in wanted(docs)]
    # All 10 blocks of the second shard, which holds the short ones alone.
    assert len(opened) == 10 and sum(opened) > 1000 and sum(multiplied) < 0.2 * sum(opened)
