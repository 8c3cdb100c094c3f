"""Language identification: averaged subword vectors, a softmax, and a calibrated limit of rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import subword
from sluice.llm.common import fold_of

FOLDS, HELD, UNKNOWN = 4, 2, "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fitted(docs: DataFrame) -> subword.Model | None:
    """A model of ``lang`` from documents outside the held-out fold; only text and lang are read for training."""
    return subword.fitted(docs.select("doc_id", "text", "lang").where(subword.trained_on(fold_of(F.col("doc_id"), FOLDS), HELD)),
                          "doc_id", "text", "lang", fold=True)


def predicted(docs: DataFrame, model: subword.Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred_, score_ and rejected_.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text when nothing could be
    learned.  Otherwise the likeliest language (ties: the first in order) with its calibrated probability, rejected if
    that lies below the limit under which only 1 in 1000 right predictions of the calibration rows fell, or below 0.5 if
    the limit is higher.  With two languages nothing with a letter is rejected, as the best one always has 0.5.
    """
    if model is None:
        return docs.withColumns({"lang_pred_": F.lit(UNKNOWN), "score_": F.lit(0.0), "rejected_": F.lit(True)})

    def fill(scorer: subword.Scorer, texts: list[str | None]) -> list:
        p = scorer.probabilities(texts)
        known = [has_letter(t) for t in texts]
        best = p.argmax(axis=1)
        names = [scorer.model.classes[b] if k else UNKNOWN for b, k in zip(best, known)]
        score = [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]
        return [names, score, [not k or s < scorer.model.reject_below for k, s in zip(known, score)]]

    return subword.scored(docs, model, text_col, True, "lang_pred_ string, score_ double, rejected_ boolean", fill)


def identified(docs: DataFrame) -> DataFrame:
    """Id, held_out, lang_pred, score and rejected of every document; repeated rows each give a row."""
    return predicted(docs.select("doc_id", "text"), fitted(docs)).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.col("lang_pred_").alias("lang_pred"),
        F.col("score_").alias("score"), F.col("rejected_").alias("rejected"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with their own columns."""
    named = predicted(docs, fitted(docs))
    return named.where(~F.col("rejected_")).select(*(F.col(f"`{c}`") for c in docs.columns))
