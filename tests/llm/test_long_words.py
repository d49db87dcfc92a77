"""Words beyond lm.LONG: forward-backward counts, spans of any size, constant memory."""

import tracemalloc

import numpy as np
import pytest

from fathom.llm import lm

SPANS = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba"]


def test_long_words_count_like_short_ones(monkeypatch):
    pieces = lm.Pieces(SPANS, np.array([1.0, 2, 3, 4, 5, 6, 7]))
    words, n = [b"ab" * 30, b"a", b"bbaabab", b"ba" * 40], np.array([2.0, 1, 3, 1])
    got, want = np.zeros(len(SPANS)), np.zeros(len(SPANS))
    lm.word_lattices(words, pieces, n, got)
    monkeypatch.setattr(lm, "LONG", 1000)
    lm.word_lattices(words, pieces, n, want)
    assert np.allclose(got, want) and np.isclose(got @ [len(s) for s in SPANS], n @ [len(w) + 1 for w in words])


def test_adapted_weights_see_long_words(spark):
    pieces = lm.Pieces([*SPANS, b"ccc"], np.ones(len(SPANS) + 1))
    words = spark.createDataFrame([(bytearray(b"ab"), 1), (bytearray(b"abccc" * 20), 1)], "word binary, n long")
    assert np.exp(lm.adapt(words, pieces).log[-1]) > 0.2


@pytest.mark.parametrize("span", [1, 2, 3, 7, 64, 80, 81, 82, 1000])
def test_spans_of_any_size_agree(monkeypatch, span):
    pieces = lm.Pieces(SPANS, np.array([1.0, 2, 3, 4, 5, 6, 7]))
    word = np.frombuffer(b" " + b"abbabaab" * 10, np.uint8)
    want, got = np.zeros(len(SPANS)), np.zeros(len(SPANS))
    whole = lm.long_lattice(word, pieces, 2.0, want)
    monkeypatch.setattr(lm, "SPAN", span)
    assert np.isclose(lm.long_lattice(word, pieces, 2.0, got), whole) and np.allclose(got, want)
    assert np.isclose(lm.long_lattice(word, pieces), whole)


@pytest.mark.parametrize("span", [3, 1000])
def test_a_word_without_segmentation(monkeypatch, span):
    monkeypatch.setattr(lm, "SPAN", span)
    pieces, out = lm.Pieces(SPANS, np.ones(len(SPANS))), np.zeros(len(SPANS))
    assert lm.long_lattice(np.frombuffer(b" abab?abab", np.uint8), pieces, 1.0, out) == -np.inf and not out.any()


def test_two_megabytes_without_a_blank():
    pieces, out = lm.load_pieces(), np.zeros(len(lm.load_pieces().spans))
    rng = np.random.default_rng(3)
    word = np.frombuffer(b" " + bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 2_000_000)), np.uint8)
    pieces.find(np.zeros(1, np.uint64))
    tracemalloc.start()
    try:
        ln = lm.long_lattice(word[:100_000], pieces, 1.0, np.zeros(len(out)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.isfinite(ln) and peak < 100 << 20
    assert np.isfinite(lm.long_lattice(word, pieces, 1.0, out))
    assert np.isclose(out @ [len(s) for s in pieces.spans], len(word))
