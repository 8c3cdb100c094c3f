"""The Kneser-Ney model of three and four words against direct computation."""

import collections
import math

import pytest

from sluice.llm import kneser
from sluice.llm.common import documents
from sluice.llm.queries import QUERIES

from .fixtures import awkward, awkward_docs, clashing, empty_docs, rows_of, words_of
from .test_models import NAMES, assert_scores, fold


def plain_chance(texts, order):
    """P(word | context of order - 1 words): raw counts at the top, different words before an n-gram below."""
    words = [[None] * (order - 1) + words_of(t) for t in texts]
    grams = {order: collections.Counter(tuple(ws[i - order + 1:i + 1]) for ws in words for i in range(order - 1, len(ws)))}
    for k in range(order - 1, 0, -1):
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])
    cut = {}
    for k, found in grams.items():
        times = collections.Counter(found.values())
        cut[k] = [0, *kneser.discounts(*(times[i] for i in (1, 2, 3, 4)))]
    after = collections.defaultdict(lambda: [0, 0.0])
    for k, found in grams.items():
        for g, n in found.items():
            after[k, g[:-1]][0] += n
            after[k, g[:-1]][1] += cut[k][min(n, 3)]

    def chance(context, word, k=order):
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        lower = chance(context[1:], word, k - 1)
        total, left = after[k, context] if (k, context) in after else (0, 1)
        n = grams[k][(*context, word)]
        return max(n - cut[k][min(n, 3)], 0) / max(total, 1) + left / max(total, 1) * lower

    return grams, chance


def plain_rows(rows, order):
    train = [t for i, t in rows if fold(i, 5) != 1]
    count = collections.Counter(w for t in train for w in words_of(t))
    _, chance = plain_chance(train, order)
    n, v, out = sum(count.values()), len(count), []
    for i, t in rows:
        words = words_of(t)
        padded = [None] * (order - 1) + words
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        score = sum(math.log10(chance(tuple(padded[j:j + order - 1]), w)) for j, w in enumerate(words))
        out.append((i, fold(i, 5) == 1, len(words), sum(w in count for w in words), n, base, score))
    return out


@pytest.mark.parametrize(("order", "hold"), [(2, 1 << 22), (3, 1 << 22), (3, 50), (4, 1 << 22)])
def test_scores_of_order(spark, monkeypatch, order, hold):
    monkeypatch.setattr(kneser, "HOLD", hold)
    rows = [(r[0], r[1]) for r in awkward()] + [(100 + i, f"to be or not to be {i % 3} or to be not to be") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert_scores([tuple(r) for r in kneser.scored(docs, order).select(*NAMES).collect()], plain_rows(rows, order))


def test_the_query_looks_back_two_words(spark):
    sf = "/root/testdata/sf0.001"
    want = plain_rows([(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()], 3)
    assert_scores([tuple(r) for r in QUERIES["op7_kneser_ney"](spark, sf).select(*NAMES).collect()], want)


def test_chances_of_order_three_add_up():
    texts = ["a b a b c", "a b c a b a", "c a b", "", None]
    grams, chance = plain_chance(texts, 3)
    for context in ((None, None), (None, b"a"), (b"a", b"b"), (b"x", b"b"), (b"x", b"y")):
        assert sum(chance(context, w) for w in [*(g[0] for g in grams[1]), b"new"]) == pytest.approx(1)


def test_order_three_of_awkward_tables(spark):
    assert kneser.scored(empty_docs(spark), 3).count() == 0
    alone = next(i for i in range(100) if fold(i, 5) == 1)
    only_held = spark.createDataFrame([(alone, "a b")], "doc_id long, text string")
    assert rows_of(kneser.scored(only_held, 3), *NAMES) == [(alone, True, 3, 0, 0, 0.0, 0.0)]
    assert kneser.scored(clashing(awkward_docs(spark)), 3).count() == len(awkward())
    with pytest.raises(ValueError, match="order"):
        kneser.scored(empty_docs(spark), 1)
