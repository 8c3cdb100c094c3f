"""The operators as stages of a pipeline: documents in, the documents that stay out, with their own columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import decontaminate, langid, simhash, suffixdedup
from sluice.llm.common import parked

#: Columns that stages read; all others pass through.
ROLES = ("doc_id", "text", "lang", "n_chars")


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over ``docs`` whose other columns have names that clash with none of its own."""
    safe = [c if c in ROLES else f"passed_{i}_" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*safe)).select(*safe).toDF(*docs.columns)


def known_language(docs: DataFrame) -> DataFrame:
    """Drops the documents whose language is rejected: null texts, texts without letters, uncertain ones.

    The model learns from the labelled documents of ``docs`` itself; without any, nothing can be rejected and only
    texts without letters go.
    """
    def work(d: DataFrame) -> DataFrame:
        model = langid.fitted(d)
        if model is None:
            return d.where(F.col("text").rlike(r"\p{L}"))
        return langid.predicted(d, model).where(~F.col("rejected_"))

    return shielded(docs, work)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Keeps one document of each component of linked fingerprints: the one with the smallest id.

    Texts without words have one fingerprint and so count as one group.  Null ids give way to others; of rows that
    repeat in full, or that share the smallest id, one stays.
    """
    def work(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("ref_", F.xxhash64("doc_id", "text"))
        prints = parked(simhash.with_fingerprints(keyed.select("doc_id", "ref_", "text"), "text", "print_").select(
            "doc_id", "ref_", "print_"), "stage-prints")
        of = simhash.grouped(prints, "doc_id", "print_", "component_")
        stays = of.groupBy("component_", "group_").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ref_")).alias("row"))
        # The join leaves rows of one ref together, so numbering them needs no shuffle of its own.
        ref = Window.partitionBy("ref_").orderBy("doc_id")
        return (keyed.join(stays.select(F.col("row.ref_").alias("ref_")), "ref_", "left_semi")
                .withColumn("copy_", F.row_number().over(ref)).where("copy_ = 1"))

    return shielded(docs, work)


def repeats_removed(docs: DataFrame) -> DataFrame:
    """Takes byte strings that occur twice out of the texts; a document that is nothing else goes."""
    return shielded(docs, suffixdedup.without_repeats)


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    def work(d: DataFrame) -> DataFrame:
        return decontaminate.contaminated(d, benchmark, keep=d.columns, unnamed=True).where("n_hit = 0")

    return shielded(docs, work)
