"""Hashes of words taken from bytes in bulk, against splitting text by text."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import kneser, wordhash

from .fixtures import awkward, words_of

TEXTS = st.lists(st.none() | st.text(alphabet="aAbBé \t\n\x0b\x0c\r\x85 z", max_size=12), max_size=8)


def agree(column, texts):
    """Equal words and only they have equal hashes, in the order of the texts."""
    codes, sizes = wordhash.hashed(column)
    words = [w for t in texts for w in words_of(t)]
    assert sizes.tolist() == [len(words_of(t)) for t in texts] and len(codes) == len(words)
    assert len(set(zip(words, codes.tolist()))) == len(set(words)) == len(set(codes.tolist()))
    assert all((c == wordhash.END) == (w == b" ") for c, w in zip(codes, words))


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_of_any_texts(texts, cut):
    agree(pa.array(texts, pa.string())[cut:], texts[cut:])


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_blocks_do_not_show(monkeypatch, block):
    texts = [t for _, t, *_ in awkward()] + ["x" * 5000 + " y", "ab ba aab aba baa", "", None]
    want, sizes = wordhash.hashed(pa.array(texts, pa.string()))
    monkeypatch.setattr(wordhash, "BLOCK", block)
    got, again = wordhash.hashed(pa.array(texts, pa.string()))
    assert got.tolist() == want.tolist() and again.tolist() == sizes.tolist()
    agree(pa.array(texts, pa.string()), texts)


def test_a_text_of_many_megabytes():
    text = "Word " * 1_000_000 + "q" * 3_000_000
    codes, sizes = wordhash.hashed(pa.array([text, "word"]))
    assert sizes.tolist() == [1_000_002, 2] and len(set(codes[:1_000_000].tolist())) == 1 and codes[-2] == codes[0]


def test_many_different_words_have_different_hashes():
    words = [f"{i:x}" for i in range(300_000)] + ["".join(p) for p in ("abcd", "abdc", "badc", "dcba", "cdab")]
    codes, _ = wordhash.hashed(pa.array([" ".join(words)]))
    assert len(np.unique(codes)) == len(set(words)) + 1


@pytest.mark.parametrize("columns", [1, 4])
def test_counts_beyond_a_byte(tmp_path, columns):
    counts = np.array([0, 1, 254, 255, 256, 70_000, 1 << 40, 2] * columns, dtype=np.int64).reshape(-1, columns)
    kneser._save_counts(str(tmp_path), "counts", counts)
    at = np.array([3, 0, 3, len(counts) - 1])
    assert kneser.Counts(str(tmp_path), "counts", columns)[at].tolist() == counts[at].tolist()
