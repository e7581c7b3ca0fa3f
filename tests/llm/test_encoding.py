"""A batch's pieces are looked up once each, and put together to what the library gives for whole texts."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc

from sievemark.llm import encoding
from sievemark.llm.queries import tokenizer_path


def test_a_piece_is_looked_up_once_a_batch(monkeypatch):
    class Counting(dict):
        gets = 0

        def get(self, key, default=None):
            Counting.gets += 1
            return super().get(key, default)

    enc = encoding.Encoder(tokenizer_path())
    texts = ["so oft wie es geht, so oft. " * 3 + "über"] * 200
    whole = enc.whole(texts)
    enc.memo.young = Counting()
    assert enc.encode([t.replace("  ", " ") for t in texts]) == whole and Counting.gets < 40


def test_pieces_make_whole_texts(monkeypatch):
    monkeypatch.setattr(encoding, "PIECES_AT_ONCE", 7)
    rng = random.Random(2)
    words = ["über", "Haus.", "haus", "a!?", "ΣΑΣ", "x1", "don't", "<|endoftext|>", " ", "\n", "\n\n", "", "😀", "é,", "...", " b", "中文"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(400)] + ["", " ", "\n", "a"]
    enc = encoding.Encoder(tokenizer_path())
    for _ in range(2):
        assert enc.encode(texts) == enc.whole(texts)
    assert enc.encode([]) == [] and enc.encode([""]) == [b""]


def test_runs_are_those_of_the_white_space_class():
    signs = [chr(c) for c in range(0x3100)]
    pairs = [a + b for a in signs for b in (" ", a)] + [" " + a for a in signs]
    assert pc.match_substring_regex(pa.array(pairs, pa.large_string()), encoding._RUN).to_pylist() == [bool(re.search(f"[{encoding.SPACES}]{{2}}", p)) for p in pairs]
