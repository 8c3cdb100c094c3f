"""Quality classifier: supervised subword embeddings over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import subword
from sluice.llm.common import fold_of

FOLDS, HELD, AT = 5, 0, 0.3


def fitted(docs: DataFrame, labels: DataFrame) -> subword.Model | None:
    """A model of ``labels.quality`` from documents outside the held-out fold; only the text is an input.

    Null labels, null texts and null ids do not train.  An id labelled twice trains with each of its labels.
    """
    marked = labels.select("doc_id", F.col("quality").alias("label_")).where(subword.trained_on(fold_of(F.col("doc_id"), FOLDS), HELD))
    rows = docs.select("doc_id", "text").join(marked, "doc_id")
    return subword.fitted(rows, "doc_id", "text", "label_", fold=False)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Id, held_out, score (probability of label 1) and predicted of every document.

    Null and empty texts score as the model's bias does.  With no usable label, or labels of one class alone, every
    score is that class's share (0.5 without any).  Repeated rows each give a row.
    """
    model = fitted(docs, labels)
    base = docs.select("doc_id", "text")
    if model is None:
        out = base.withColumn("score_", F.lit(0.5))
    else:
        one = [c == "1" for c in model.classes]

        def fill(scorer: subword.Scorer, texts: list[str | None]) -> list:
            p = scorer.probabilities(texts)
            return [p[:, one].sum(axis=1)]

        out = subword.scored(base, model, "text", False, "score_ double", fill)
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
                      F.col("score_").alias("score"), (F.col("score_") >= AT).cast("int").alias("predicted"))
