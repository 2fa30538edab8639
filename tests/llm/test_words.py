import random
import re

import numpy as np
import pyarrow as pa
import pytest

from procura.llm import words as W

ALPHABET = ["a", "B", "é", "ÑO", " ", "\n", "\t", ".", "9", "x" * 40, " ", "😀", ""]


def texts(seed, n=300):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else "".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(n)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
def test_words_match_a_regular_expression_at_any_window(monkeypatch, window):
    monkeypatch.setattr(W, "WINDOW", window)
    rows = texts(window)
    hashes, starts = W.word_hashes(W.buffer_of(pa.array(rows)))
    seen = {}
    for row, a, b in zip(rows, starts[:-1], starts[1:], strict=True):
        expected = re.findall(r"[^\x20\x09-\x0D]+", lower(row or ""))
        assert b - a == len(expected)
        for word, value in zip(expected, hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_all_rows_and_sliced_columns():
    batch = pa.record_batch([pa.array(range(300)), pa.array(texts(3))], ["doc_id", "text"]).slice(5, 250)
    parts = list(W.slices(batch, "text", 100))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert len(parts) > 5
    assert list(W.slices(batch.slice(0, 0), "text")) == []


def test_shingle_sets_of_short_and_empty_rows():
    rows = ["a b c d e f", "A b  c\nd e f", "a b", "", None, "b a"]
    sets = list(W.shingles(*W.word_hashes(W.buffer_of(pa.array(rows))), 5))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1]
    assert np.array_equal(sets[0], sets[1]) and not np.array_equal(sets[2], sets[5])


def fold(n):
    """Thue-Morse word of 2 ** n letters and its complement: equal under every polynomial modulo 2 ** 64."""
    bits = [bin(i).count("1") % 2 for i in range(2**n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_built_to_collide_have_different_hashes():
    import pyarrow as pa

    from procura.llm.words import buffer_of, word_hashes

    for n in (6, 10, 11):
        hashes, _ = word_hashes(buffer_of(pa.array([" ".join(fold(n))])))
        assert len(hashes) == 2 and hashes[0] != hashes[1]
    same, _ = word_hashes(buffer_of(pa.array(["É" + "A" * 90 + " x É" + "a" * 90])))
    assert same[0] == same[2]
