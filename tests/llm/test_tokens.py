"""Token counts and byte-level BPE against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from sluice.llm import bytebpe, tokencount

from .fixtures import awkward, awkward_docs, clashing, empty_docs, rows_of

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = ["a", "b", "A", "é", "É", "ß", "Σ", "ς", "İ", "ǅ", "中", "한", "١", "½", "Ⅷ", "🙂", "‍", " ", " ", "\x1c",
           "\x85", "'", "'s", "'S", "'ll", " ", " ", "\n", "!", "!!!", "_", "<|endoftext|>", "<|startoftext|>", "0", "12", "the", "th", "ing"]


def texts(count: int) -> list[str]:
    rnd = random.Random(count)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(count)]
    plain = [x for x in LETTERS if x.isascii()] + ["\x0b", "\x0c", "\x1f", "\x00", "\r"]
    made += ["".join(rnd.choice(plain) for _ in range(rnd.randint(0, 40))) for _ in range(count)]
    latin = [*plain, *map(chr, range(0x80, 0x100))]
    made += ["".join(rnd.choice(latin) for _ in range(rnd.randint(0, 40))) for _ in range(count)]
    letters = [c for c in latin if c.isalpha() and c not in "ªµº"] + list(" \n'!1")
    made += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(count)]
    return [*made, *("a" * n for n in range(1, 80)), "ab" * 500, "ha" * 333, "the" * 999, " " * 300, "é" * 200]


@pytest.fixture(scope="module")
def word_library():
    return tokenizers.Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def rank_library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library_on_odd_strings(word_library):
    made = texts(3000)
    want = [len(e.ids) for e in word_library.encode_batch(made, add_special_tokens=False)]
    assert tokencount.loaded(WORDS).count(made) == want


def test_ids_equal_the_library_on_odd_strings(rank_library):
    fst, made = bytebpe.loaded(RANKS, public_tokenizers.PATTERN), texts(3000)
    assert [np.frombuffer(fst.encode(t), "<u4").tolist() for t in made] == [rank_library.encode_ordinary(t) for t in made]


def test_a_forgetful_transducer_gives_the_same_ids(monkeypatch):
    made = texts(200)
    want = [bytebpe.loaded(RANKS, public_tokenizers.PATTERN).encode(t) for t in made]
    monkeypatch.setattr(bytebpe, "STATES", 5)
    monkeypatch.setattr(bytebpe, "PAIRS", 5)
    monkeypatch.setattr(bytebpe, "WORDS", 5)
    small = bytebpe.Transducer(bytebpe.loaded(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    assert [small.encode(t) for t in made] == want


def test_stream_gives_whole_characters_at_any_cut():
    rnd = random.Random(1)
    for text in texts(300):
        raw, stream = text.encode(), bytebpe.Utf8Stream()
        cuts = sorted(rnd.randint(0, len(raw)) for _ in range(4))
        parts = [stream.feed(raw[a:b]) for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        stream.close()
        assert "".join(parts) == text


@pytest.mark.parametrize("raw", [b"\x80", b"\xc0\x80", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf5", b"\xe2\x82", b"\xe2\x28\xa1"])
def test_stream_refuses_what_is_not_utf8(raw):
    with pytest.raises(ValueError):
        stream = bytebpe.Utf8Stream()
        for b in raw:
            stream.feed(bytes([b]))
        stream.close()


def test_count_rows(spark, word_library):
    got = rows_of(tokencount.counted(clashing(awkward_docs(spark)), WORDS, limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit")
    sizes = [len(word_library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in awkward()]
    want = [(r[0], len((r[1] or "").encode()), n, n > 50) for r, n in zip(awkward(), sizes)]
    assert got == sorted(want, key=repr)
    assert tokencount.counted(empty_docs(spark), WORDS).count() == 0


def test_round_trip_rows(spark, rank_library):
    docs = clashing(awkward_docs(spark))
    got = rows_of(bytebpe.round_trip(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, text, *_ in awkward():
        ids = rank_library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bytebpe.round_trip(empty_docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_ids_decode_to_the_texts(spark):
    ids = bytebpe.encoded(awkward_docs(spark), RANKS, public_tokenizers.PATTERN)
    got = rows_of(bytebpe.decoded(ids, RANKS, public_tokenizers.PATTERN), "doc_id", "text")
    assert got == sorted(((i, t or "") for i, t, *_ in awkward()), key=repr)
