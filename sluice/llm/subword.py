"""Hashed word and character n-gram vectors, averaged per text, with a softmax on top; trained by numpy SGD.

A text is the mean of the vectors of its features: every word, the character n-grams of every word between marks, and
every pair of neighbouring words.  Training sees a bounded sample of labelled rows inside one Spark task.  Since mean
and output layer are linear, a trained model folds into one table of class scores per bucket; scoring adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import column, give_back, pieces, widened

#: Labelled rows used for training at most (drawn by a hash of the id), and the part of them that calibrates.
SAMPLE, CALIBRATE = 6000, 0.2
BUCKETS, DIM = 1 << 16, 16
GRAMS = (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 32, 0.5
#: Words a worker remembers, and new words hashed together.
CACHE, TOGETHER = 200_000, 20_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    """Bucket scores (buckets x classes), bias, classes, temperature and the calibrated limit of rejection."""

    table: np.ndarray
    bias: np.ndarray
    classes: list[str]
    heat: float
    reject_below: float


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes ^ np.uint64(kind)) * _MIX >> np.uint64(40)).astype(np.int64) % BUCKETS


def word_features(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The bucket of each word, and of each size of n-gram the word's number and the bucket.

    All words are hashed at once: their letters stand in one array, marked at both ends, and n-grams inside a word are
    polynomials of neighbouring letters.  Every letter of any word counts.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(letters)) - first[of]
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _STEP))
    own = _bucket(np.add.reduceat(letters * powers[inside], first), 1)
    grams, h = [], letters
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _STEP + letters[n - 1:]
        if n in GRAMS:
            whole = np.flatnonzero(inside[:len(h)] + n <= sizes[of[:len(h)]])
            grams.append((of[whole], _bucket(h[whole], n)))
    return own, grams


def pair_features(codes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; a word repeated at once has one bucket whatever it is."""
    a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.where(a == b, 0, (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)


def _split(text: str, fold: bool) -> list[str]:
    return (text.lower() if fold else text).split()


def counts_of(text: str, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = _split(text, fold)
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    order = np.array([number[w] for w in words])
    times = np.bincount(order)
    own, grams = word_features(list(number))
    total = np.bincount(own, weights=times, minlength=BUCKETS)
    for of, bucket in grams:
        total += np.bincount(bucket, weights=times[of], minlength=BUCKETS)
    total += np.bincount(pair_features(own[order]), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, (total[ids] / total.sum()).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: list[str], seed: int = 7) -> Model:
    """SGD with a falling rate over sparse rows; the last CALIBRATE part only sets temperature and rejection."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[:int(len(rows) * CALIBRATE)]
    fit = order[len(held):]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(classes)), dtype=np.float32)
    bias = np.zeros(len(classes), dtype=np.float32)
    steps, done = max(1, EPOCHS * ((len(fit) + BATCH - 1) // BATCH)), 0
    for _ in range(EPOCHS):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), BATCH):
            part = fit[at:at + BATCH]
            ids = np.concatenate([rows[i][0] for i in part])
            share = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            hidden = np.stack([rows[i][1] @ vectors[rows[i][0]] for i in part])
            p = _softmax(hidden @ out + bias)
            p[np.arange(len(part)), y[part]] -= 1
            rate = RATE * (1 - done / steps)
            done += 1
            back = p @ out.T
            out -= rate * (hidden.T @ p)
            bias -= rate / len(part) * p.sum(axis=0)
            # Shares are small, so each bucket's step is scaled up to that of a text with some dozens of features.
            np.add.at(vectors, ids, -rate * 64 * share[:, None] * back[of])
    table = vectors @ out
    scores = np.stack([rows[i][1] @ table[rows[i][0]] + bias for i in held]) if len(held) else np.zeros((0, len(classes)))
    heat, limit = _calibrated(scores, y[held])
    return Model(table.astype(np.float32), bias, classes, heat, limit)


def _calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss, and the score below which at most 1 in 1000 right predictions falls, or 0.5 if less."""
    if not len(scores):
        return 1.0, 0.0
    heats = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(scores / h)[np.arange(len(y)), y], 1e-12)).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(scores / heat)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    limit = float(right[int(len(right) * 0.001)]) if len(right) else 0.0
    return heat, min(limit, 0.5)


def fitted(rows: DataFrame, id_col: str, text_col: str, label_col: str, fold: bool, sample: int = SAMPLE) -> Model | None:
    """A model from at most about ``sample`` of the labelled ``rows``, drawn by a hash of the id; None without rows.

    The draw keeps one expected number of rows at every size.  Training runs in one task over that bounded sample;
    only the model, a table of BUCKETS x classes, comes to the driver.
    """
    rows = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    # The text breaks no tie: rows of one id are drawn together, which the hash spreads over all ids.
    few = rows.where(draw < int(min(1.0, sample / n) * (1 << 30))).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(t, fold) for _, texts in pieces(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
                 pa.array([f[1].tobytes() for f in found], pa.binary())], names=["id", "label", "ids", "shares"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In the order of the ids, so that the result does not depend on how the rows arrived.
        data = sorted((row for b in batches for row in zip(*(column(b, n) for n in ("id", "label", "ids", "shares")))),
                      key=lambda d: (repr(d[0]), d[1], d[2], d[3]))
        if not data:
            return
        classes = sorted({d[1] for d in data})
        y = np.array([classes.index(d[1]) for d in data])
        sparse = [(np.frombuffer(d[2], dtype=np.int32).astype(np.int64), np.frombuffer(d[3], dtype=np.float32)) for d in data]
        made = train(sparse, y, classes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([made.table.astype("<f4").tobytes()], pa.binary()), pa.array([made.bias.tolist()], pa.list_(pa.float64())),
             pa.array([classes]), pa.array([made.heat]), pa.array([made.reject_below])],
            names=["table", "bias", "classes", "heat", "reject_below"])

    kind = rows.schema[id_col].dataType.simpleString()
    made = few.mapInArrow(features, f"id {kind}, label string, ids binary, shares binary")
    found = made.repartition(1).mapInArrow(
        learn, "table binary, bias array<double>, classes array<string>, heat double, reject_below double").collect()
    if not found:
        return None
    m = found[0]
    table = np.frombuffer(m["table"], dtype="<f4").reshape(BUCKETS, -1)
    return Model(table, np.array(m["bias"]), list(m["classes"]), m["heat"], m["reject_below"])


class Scorer:
    """Class probabilities of whole texts under a model; remembers the summed scores of words it has met."""

    def __init__(self, model: Model, fold: bool):
        self.model, self.fold = model, fold
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.classes) + 2))  # scores, features, code

    def _learn(self, words: set[str]) -> None:
        if len(self.place) > CACHE:
            self.place.clear()
        new = list(words.difference(self.place))
        if not new:
            return
        at, need = len(self.place), len(self.place) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((2 * need - len(self.rows), self.rows.shape[1]))])
        table = self.model.table
        for start in range(0, len(new), TOGETHER):
            part = new[start:start + TOGETHER]
            own, grams = word_features(part)
            rows = self.rows[at + start:at + start + len(part)]
            rows[:, :-2], rows[:, -2], rows[:, -1] = table[own], 1, own
            for of, bucket in grams:
                for c in range(table.shape[1]):
                    rows[:, c] += np.bincount(of, weights=table[bucket, c], minlength=len(part))
                rows[:, -2] += np.bincount(of, minlength=len(part))
        self.place.update(zip(new, range(at, need)))

    def scores(self, words: list[str]) -> np.ndarray:
        """Class scores of a text whose words have been learned."""
        if not words:
            return self.model.bias.astype(float)
        rows = self.rows[[self.place[w] for w in words]]
        pairs = pair_features(rows[:, -1].astype(np.int64))
        total = rows[:, :-2].sum(axis=0) + self.model.table[pairs].sum(axis=0, dtype=float)
        return total / (rows[:, -2].sum() + len(pairs)) + self.model.bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        words = [_split(t or "", self.fold) for t in texts]
        self._learn(set().union(*words))
        return _softmax(np.stack([self.scores(w) for w in words]) / self.model.heat)


def scored(docs: DataFrame, model: Model, text_col: str, fold: bool, add: str, fill) -> DataFrame:
    """``docs`` with the columns of schema ``add`` that ``fill(scorer, texts)`` gives; one Python pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x classes floats, whatever the corpus
    made: dict[int, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = made.setdefault(0, Scorer(shared.value, fold))
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                more = fill(scorer, texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, more)],
                                                 names=[*part.schema.names, *(x.split()[0] for x in add.split(", "))])
        made.clear()
        del scorer
        give_back()

    return docs.mapInArrow(run, widened(docs, add))


def trained_on(fold_number: Column, held: int) -> Column:
    """Rows outside the held-out fold."""
    return fold_number != held
