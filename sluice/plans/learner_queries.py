"""Learners without an SQL form; their results are checked in the tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from sluice.functions.exprs import r6
from sluice.operators import forecast as fc, learners as ln, resample as rs
from sluice.plans.base import cut_train, train_of
from sluice.plans.fit_queries import rounded
from sluice.plans.forecast_queries import FAMILY_CONFIDENCE, FAMILY_REPS, SCORE_ROUND
from sluice.plans.registry import query
from sluice.session import durable


def errors(rows):
    return rows.groupBy("series_id").agg(
        F.count("*").alias("sessions"), r6(F.avg(F.abs(F.col("point") - F.col("y")))).alias("mae"),
        r6(F.sqrt(F.avg(F.pow(F.col("point") - F.col("y"), F.lit(2.0))))).alias("rmse"))


@query("huber_fit")
def huber_fit(spark, sf_dir):
    return rounded(ln.rolling_huber(train_of(spark, sf_dir)), "x", "y", "intercept", "slope", "point")


@query("huber_pooled")
def huber_pooled(spark, sf_dir):
    return errors(ln.pooled_huber(cut_train(spark, sf_dir)))


@query("ridge_residual")
def ridge_residual(spark, sf_dir):
    return rounded(ln.rolling_ridge(cut_train(spark, sf_dir)), "y", "p_base", "point")


@query("boosted_residual")
def boosted_residual(spark, sf_dir):
    return errors(ln.boosted_correction(cut_train(spark, sf_dir)))


@query("sealed_forecast")
def sealed_forecast(spark, sf_dir):
    return rounded(ln.sealed_forecast(train_of(spark, sf_dir)), "move", "point", "p_up", "p_down", "low", "high",
                   "slope", "intercept")


@query("learner_scorecard")
def learner_scorecard(spark, sf_dir):
    """The fitted line, the prequential line, Huber, ridge and boosted on identical dates."""
    long = fc.losses(durable(ln.learner_rows(cut_train(spark, sf_dir))), ln.LEARNERS)
    return rounded(fc.scorecard(long), *SCORE_ROUND)


@query("learner_family")
def learner_family(spark, sf_dir):
    """Corrected intervals of the three learners' error gains at three block lengths."""
    rows = ln.learner_rows(cut_train(spark, sf_dir))
    names = list(ln.LEARNERS[2:])
    err = lambda n: F.abs(F.col(f"{n}.point") - F.col("y"))
    gains = durable(rows.select("series_id", "session", *[(err("production") - err(c)).alias(c) for c in names]))
    parts = [rs.block_intervals(gains, "session", names, b, FAMILY_REPS, "family", FAMILY_CONFIDENCE).withColumn("block", F.lit(b))
             for b in (5, 10, 20)]
    out = reduce(lambda a, b: a.unionByName(b), parts).withColumnRenamed("column", "candidate")
    whole = Window.partitionBy("series_id", "candidate")
    return rounded(out.withColumn("positive_at_all_lengths", F.bool_and(F.col("low") > 0).over(whole)), "low", "high")
