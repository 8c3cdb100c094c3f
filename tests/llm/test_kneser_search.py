"""How n-grams are kept and looked up: word ids by context, four bytes each, found within their context's words."""

import os

import numpy as np
import pytest

from sluice.llm import kneser


@pytest.mark.parametrize("bits", [12, 64])
def test_distinct_values_of_any_width(bits):
    values = np.random.default_rng(1).integers(0, 1 << 12, 5000).astype(np.uint64) << np.uint64(bits - 12)
    for some in (values, values[:1], values[:0]):
        want, back = np.unique(some, return_inverse=True)
        got, at = kneser._distinct(some, bits)
        assert got.tolist() == want.tolist() and at.tolist() == back.tolist()


def test_longer_ngrams_are_found_among_the_words_of_their_context(spark):
    texts = [f"go on w{i % 700} and w{i} x" for i in range(900)] + ["go on", "", None]
    model = kneser.trained(spark.createDataFrame([(t,) for t in texts], "text string"), parts=5, order=3)
    sizes = [os.path.getsize(f) if os.path.exists(f) else 0 for f in (f"{model.folder}/ids-3-{p}" for p in range(5))]
    assert sizes == [4 * n for n in model.levels[1]]
    scorer = kneser.Scorer(model)
    pairs, grams = scorer.levels
    have = set()
    for p in range(5):
        if grams.ids[p].size:
            context = np.repeat(np.arange(len(grams.begins[p]) - 1), np.diff(grams.begins[p].astype(int))) + pairs.start[p]
            have |= set(zip(context.tolist(), grams.ids[p].tolist()))
    assert len(have) == sum(model.levels[1])
    context, ids = (x.reshape(-1) for x in np.meshgrid(np.arange(pairs.total + 1), np.arange(0, model.words, 37), indexing="ij"))
    places, times = grams.follow(context, ids, scorer.gram_counts[1])
    assert [x >= 0 for x in places.tolist()] == [x in have for x in zip(context.tolist(), ids.tolist())]
    assert ((times > 0) == (places >= 0)).all() and len(set(places[places >= 0].tolist())) == (places >= 0).sum()
