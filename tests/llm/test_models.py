"""Language identification, quality and the Kneser-Ney model: held-out figures and brute force."""

import collections
import math
import zlib

import numpy as np
import pytest

from sluice.llm import kneser, langid, quality, subword
from sluice.llm.common import documents

from .fixtures import awkward, awkward_docs, clashing, empty_docs, prose, rows_of, words_of

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_languages_of_held_out_documents(spark):
    docs = documents(spark, SF)
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["rejected"] for r in got if r["lang_pred"] == r["lang"])


def test_languages_of_awkward_rows(spark):
    got = langid.identified(clashing(awkward_docs(spark))).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (4, 5, 6, 15):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    assert by_id[1]["lang_pred"] in ("en", "de", "es", "fr")
    assert langid.identified(empty_docs(spark)).count() == 0


def test_language_learns_nothing_from_held_out_rows(spark):
    rows = [(i, prose(i, 30), "xx" if fold(i, 4) == 2 else "yy") for i in range(60)]
    got = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"yy"}
    unlabelled = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.identified(unlabelled).first()["lang_pred"] == "und"


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.scored(documents(spark, SF), labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_quality_of_awkward_rows(spark):
    docs = clashing(awkward_docs(spark))
    labels = spark.createDataFrame([(i, q) for i, q in ((1, 1), (2, 1), (3, 0), (7, 0), (9, None), (None, 1), (16, 0), (16, 1))], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    assert {r["score"] for r in quality.scored(docs, labels.where("quality > 5")).collect()} == {0.5}
    assert quality.scored(empty_docs(spark), labels).count() == 0


def test_features_fold_into_one_table():
    rng = np.random.default_rng(1)
    model = subword.Model(rng.normal(size=(subword.BUCKETS, 3)).astype(np.float32), np.arange(3.0), ["a", "b", "c"], 1.0, 0.0)
    scorer = subword.Scorer(model, fold=False)
    for text in ("one two two three", prose(3, 200), "x"):
        ids, share = subword.counts_of(text, False)
        z = share @ model.table[ids] + model.bias
        assert np.allclose(scorer.probabilities([text])[0], np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_ngrams_stay_inside_their_words():
    own, grams = subword.word_features(["ab", "c", "abab"])
    pieces = [[w[i:i + n] for i in range(len(w) - n + 1)] for n in subword.GRAMS for w in ("<ab>", "<c>", "<abab>")]
    for k, (of, bucket) in enumerate(grams):
        want = pieces[3 * k:3 * k + 3]
        assert [int((of == i).sum()) for i in range(3)] == [len(p) for p in want]
        code = {}
        for text, b in zip([p for part in want for p in part], bucket.tolist()):
            assert code.setdefault(text, b) == b
        assert len(set(code.values())) == len(code)
    assert len(set(own.tolist())) == 3


def plain_model(texts):
    words = [words_of(t) for t in texts]
    count = collections.Counter(w for ws in words for w in ws)
    pairs = collections.Counter(p for ws in words for p in zip([None, *ws[:-1]], ws))
    cont = collections.Counter(b for _, b in pairs)
    times, widths = collections.Counter(pairs.values()), collections.Counter(cont.values())
    high = [0, *kneser.discounts(*(times[i] for i in (1, 2, 3, 4)))]
    low = [0, *kneser.discounts(*(widths[i] for i in (1, 2, 3, 4)))]
    context = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), n in pairs.items():
        context[a][0] += n
        context[a][min(n, 3)] += 1
    unseen = (sum(low[min(n, 3)] for n in cont.values()) / len(pairs) if pairs else 1) / (len(count) + 1)

    def chance(a, b):
        base = max(cont[b] - low[min(cont[b], 3)], 0) / max(1, len(pairs)) + unseen
        if a not in context:
            return base
        total, *by = context[a]
        n = pairs[a, b]
        return max(n - high[min(n, 3)], 0) / total + sum(d * c for d, c in zip(high[1:], by)) / total * base

    return count, chance


def plain_scores(rows):
    count, chance = plain_model([t for i, t in rows if fold(i, 5) != 1])
    n, v, out = sum(count.values()), len(count), []
    for i, t in rows:
        words = words_of(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        score = sum(math.log10(chance(a, b)) for a, b in zip([None, *words[:-1]], words))
        out.append((i, fold(i, 5) == 1, len(words), sum(w in count for w in words), n, base, score))
    return count, chance, out


def assert_scores(got, want):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize("hold", [1 << 22, 50])
def test_scores_equal_direct_computation(spark, monkeypatch, hold):
    monkeypatch.setattr(kneser, "HOLD", hold)
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count, chance, want = plain_scores(rows)
    assert_scores([tuple(r) for r in kneser.scored(docs).select(*NAMES).collect()], want)
    for a in (b"the", None):  # the chances of all words and one unseen word add up to 1
        assert sum(chance(a, w) for w in [*count, b"not a word"]) == pytest.approx(1)


def test_scores_of_awkward_rows(spark):
    want = plain_scores([(i, t) for i, t, *_ in awkward()])[2]
    assert_scores([tuple(r) for r in kneser.scored(clashing(awkward_docs(spark))).select(*NAMES).collect()], want)
    assert kneser.scored(empty_docs(spark)).count() == 0
    alone = next(i for i in range(100) if fold(i, 5) == 1)
    only_held = spark.createDataFrame([(alone, "a b")], "doc_id long, text string")
    assert rows_of(kneser.scored(only_held), *NAMES) == [(alone, True, 3, 0, 0, 0.0, 0.0)]


def test_model_beats_words_alone_on_held_out_documents(spark):
    r = kneser.scored(documents(spark, SF)).where("held_out").groupBy().sum("base_score", "score").first()
    assert r[1] > r[0]
