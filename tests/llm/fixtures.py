"""Small documents with every awkward case, and their plain Python counterparts."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("n_tokens", "score", "fingerprint", "component_id", "rank", "range", "shard", "size", "ref", "core", "runs", "n_words")


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    parts = ["an", "der", "ing", "ció", "na", "the", "el", "st", "mo", "ra", "un", "ge"]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(words)) + "."


def awkward() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a long one, copies, near copies, repeated rows, odd characters."""
    long_text = prose(1, 9000)
    rows = [
        (1, prose(2, 120), "en", "a", 1), (2, prose(2, 120), "en", "a", 1), (3, prose(3, 80), "de", "a", 1),
        (4, None, "en", "a", None), (5, "", "en", None, 0), (6, " \t\n", None, "a", 3), (7, long_text, "es", "b", 9),
        (8, "one", "en", "a", 3), (9, "two words", "en", "a", 9), (10, "Straße Ünïcode 🙂🙂 ΣΑΣ ﬁ", "de", "a", 1),
        (11, long_text[:20_000] + prose(4, 30), "es", "b", 9), (11, prose(5, 60), "fr", "a", 1), (12, "a" * 3000, "en", "a", 1),
        (13, prose(2, 120) + " x", "en", "a", 1), (None, prose(6, 70), "en", "a", 1), (None, None, None, None, None),
        (14, "<|endoftext|> it's 12 o'clock!!", "en", "a", 1), (15, "7 8 9", "en", "a", 5), (16, prose(7, 90), "en", "a", 2),
        (16, prose(7, 90), "en", "a", 2), (-5, prose(8, 50), "de", "a", 1), (17, "ab" * 700, "en", "a", 1)]
    return rows


def awkward_docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def clashing(docs):
    """``docs`` with more columns, named like those that operators make."""
    from pyspark.sql import functions as F
    return docs.withColumns({c: F.lit("mine") for c in CLASHING})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    order = names or df.columns
    return sorted((tuple(r[n] for n in order) for r in df.collect()), key=repr)


def words_of(text):
    """Words with A-Z lower-cased, then one end, which white space stands for."""
    return [*(text or "").encode().lower().split(), b" "]
