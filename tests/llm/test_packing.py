"""Best-fit packing against best fit over single pieces, and against whole-text encoding."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest

pytest.importorskip("sievemark.llm.queries")

from sievemark.llm import packing  # noqa: E402
from sievemark.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id bigint, text string, length int, rank int, sequence_id string, part int"


def best_fit_of_pieces(lengths, limit):
    rooms = []
    for length in sorted(lengths, reverse=True):
        k = bisect_left(rooms, length)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else limit) - length)
    return len(rooms)


@pytest.mark.parametrize("limit", [1, 7, 64, 1024])
def test_plan_over_counts_is_best_fit_over_pieces(limit):
    for seed in range(40):
        rng = random.Random(f"{limit} {seed}")
        counts = {rng.randrange(1, limit + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 150))}
        plan = packing.best_fit(counts, limit)
        length = np.array([n for n, c in counts.items() for _ in range(c)])
        rank = np.array([r for c in counts.values() for r in range(c)])
        assert plan.sequences == best_fit_of_pieces(length.tolist(), limit)
        places = {}
        for n, s, o in zip(length.tolist(), *(x.tolist() for x in plan.place(length, rank))):
            places.setdefault(s, []).append((o, n))
        assert sorted(places) == list(range(plan.sequences))
        for own in places.values():
            ends = 0
            for o, n in sorted(own):
                assert o == ends
                ends += n
            assert ends <= limit
    assert packing.best_fit({}, limit).sequences == 0
    with pytest.raises(ValueError):
        packing.best_fit({limit + 1: 1}, limit)


def test_plan_size_does_not_follow_the_documents():
    counts = {n: 1_000_000_007 * (n % 13 + 1) for n in range(1, 1025)}
    plan = packing.best_fit(counts)
    total = sum(n * c for n, c in counts.items())
    assert len(plan.length) < 140_000
    assert -(-total // 1024) <= plan.sequences <= -(-total // 1024) * 1.005


def test_cut():
    assert packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)]
    assert packing.cut(3) == [(0, 3)]
    assert packing.cut(2048) == [(0, 1024), (1024, 1024)]


def texts():
    word = lambda k: "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(4 + k % 5))
    rows = [(k, " ".join(word(k + j) for j in range(k % 40 * 3))) for k in range(120)]
    return rows + [(200, None), (201, ""), (None, "no id"), (202, " ".join(word(j) for j in range(3000))), (202, " ".join(word(j) for j in range(3000))), (203, "x <|endoftext|> y")]


def test_packed_pieces_are_the_library_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0, 0, "x", 0) for i, t in rows], SCHEMA).repartition(5)
    packed = packing.pack(docs, tokenizer_path(), 2, limit=128, with_ids=True)
    found = packed.collect()
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids), 128), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in found)
    assert len({r.sequence_id for r in found}) == best_fit_of_pieces([w[3] for w in want], 128)
    for s in packing.sequences(packed).collect():
        assert s.n_tokens <= 128 and len(s.ids) == 4 * s.n_tokens
        at = 0
        for p in s.pieces:
            assert p.offset == at
            own = next(r for r in found if (r.sequence_id, r.offset) == (s.sequence_id, p.offset))
            assert bytes(s.ids[4 * at : 4 * (at + p.length)]) == bytes(own.ids)
            at += p.length
    assert packing.pack(docs.limit(0), tokenizer_path(), 2).count() == 0
