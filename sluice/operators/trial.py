"""Prospective comparison of a challenger with production decisions.

An input is sealed at decision time, a forecast is made before a deadline, and
an outcome is scored later; a late or failed forecast is scored as production's
own (intention to treat), so coverage problems cannot flatter the challenger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.exprs import count_if, ratio
from sluice.operators import decide, resample as rs
from sluice.operators.align import by_session, in_series
from sluice.operators.ledger import settlement_based

# Fixed values of the registered plan.
NEEDED_PAIRS, REVIEW_PAIRS, OPERATIONAL_PAIRS = 482, 320, 60
MIN_GAIN, MIN_COVERAGE, RESAMPLES, BLOCKS = 0.1, 0.95, 20000, (5, 10, 20)
BASELINE_TOL, SCORE_TOL = 0.000051, 1e-7
DEADLINE = "1600"


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HHmm")


def known_at(log: DataFrame, history: DataFrame) -> DataFrame:
    """``log`` with what the history held at ``captured_at``: the prior posting, and whether an outcome was on file.

    The history is bitemporal: a row says what was recorded for a session at ``recorded_at``, and a later record of the
    same session replaces it from then on.  ``h_driver`` is the newest record of the prior session, ``on_file`` tells
    that some row of this or a later session was there already.
    """
    keys = ["series_id", "session"]
    versions = history.select("series_id", F.col("session").alias("prior_session"), F.col("driver").alias("v_driver"), "recorded_at")
    # A session has a few records; the newest one known at the capture is taken.
    in_time = log.select(*keys, "prior_session", "captured_at").distinct().join(versions, ["series_id", "prior_session"])
    prior = in_time.where("recorded_at <= captured_at").groupBy(*keys, "captured_at").agg(
        F.max_by("v_driver", "recorded_at").alias("h_driver"))
    # The earliest record of this session or of any later one, by one pass over the sessions of a series.
    first = history.groupBy(*keys).agg(F.min("recorded_at").alias("first_record"))
    asked = log.select(*keys).distinct()
    back = Window.partitionBy("series_id").orderBy(F.desc("session"))
    earliest = first.join(asked, keys, "full").withColumn("earliest", F.min("first_record").over(back)).select(*keys, "earliest")
    return (log.join(prior, [*keys, "captured_at"], "left").join(earliest, keys, "left")
            .withColumn("on_file", F.coalesce(F.col("earliest") <= F.col("captured_at"), F.lit(False))).drop("earliest"))


def inputs(log: DataFrame, train: DataFrame, history: DataFrame) -> DataFrame:
    """Sealed inputs with the first reason that makes one ineligible, one row per (series, session).

    ``log`` carries ``captured_at``, ``recorded_baseline``, ``snapshot_at`` and the hashes of the runtime configuration
    at the decision (``logged_config``) and at the capture (``runtime_config``); a session may have several rows, of
    which exactly one must be live.  ``history`` carries ``recorded_at``.  Captures past the deadline never happened and
    leave no row.
    """
    back = lambda k: F.lag("session", k).over(by_session())
    bounds = train.select("series_id", "session", (F.col("ord") - 1).alias("prior_pairs"),
                          back(NEEDED_PAIRS).alias("training_start"), back(1).alias("training_end"))
    live = F.coalesce(F.col("prediction_source") == "live", F.lit(False))
    same_session = Window.partitionBy("series_id", "session")
    one = (log.withColumn("live_rows", F.count_if(live).over(same_session))
           .withColumn("turn", F.row_number().over(same_session.orderBy(live.desc(), "captured_at"))).where("turn = 1").drop("turn"))
    rows = known_at(one.where(hhmm(F.col("captured_at")) < DEADLINE), history).join(bounds, ["series_id", "session"])
    c = F.col
    snapshot = ((F.to_date("snapshot_at") == c("session")) & (hhmm(c("snapshot_at")) >= "1330") & (hhmm(c("snapshot_at")) <= "1345")
                & (c("snapshot_at") <= c("verdict_ts")) & (c("verdict_ts") <= c("captured_at")))
    same = F.coalesce(c("baseline_source").isin(*decide.CALIBRATED_SOURCES) & settlement_based(c("settlement_source"))
                      & (hhmm(c("verdict_ts")) >= "1435") & (hhmm(c("verdict_ts")) < DEADLINE) & snapshot, F.lit(False))
    reason = (F.when(c("live_rows") != 1, "no_unique_live_row")
              .when(~same, "not_same_contract_verdict")
              .when(c("on_file"), "outcome_on_file")
              .when(c("h_driver").isNull(), "prior_posting_missing")
              .when(F.abs(c("h_driver") - c("recorded_baseline")) > BASELINE_TOL, "baseline_differs")
              .when(c("prior_pairs") < NEEDED_PAIRS, "insufficient_history")
              .when(~c("logged_config").eqNullSafe(c("runtime_config")), "config_changed"))
    return rows.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "eligible").otherwise("ineligible"))


def states(sealed: DataFrame) -> DataFrame:
    """forecasted / failed / missed_deadline / ineligible."""
    late = (hhmm(F.col("computed_at")) >= DEADLINE) | (F.to_date("computed_at") > F.col("session"))
    return sealed.withColumn("state", F.when(F.col("status") == "ineligible", "ineligible")
                             .when(late, "missed_deadline").when(F.col("worker_failed"), "failed")
                             .otherwise("forecasted"))


SCORES = ("abs_error", "squared_error", "brier_up", "gross_timing", "wrong_wait_cost")


def score(point: Column, p_up: Column, side: Column, actual: Column) -> dict[str, Column]:
    up = (actual > 0).cast("double")
    return {"abs_error": F.abs(point - actual), "squared_error": F.pow(point - actual, F.lit(2.0)),
            "brier_up": F.pow(p_up - up, F.lit(2.0)), "gross_timing": side * actual,
            "wrong_wait_cost": F.when(side == -1, F.greatest(actual, F.lit(0.0))).otherwise(0.0)}


def outcomes(forecasts: DataFrame) -> DataFrame:
    """Scored eligible sessions, production beside intention-to-treat challenger."""
    ok = F.col("state") == "forecasted"
    pick = lambda s, p: F.when(ok, F.col(s)).otherwise(F.col(p))
    rows = forecasts.where("status = 'eligible' AND actual IS NOT NULL").withColumns({
        "on_time": ok, "itt_point": pick("shadow_point", "expected"),
        "itt_p_up": pick("shadow_p_up", "p_up"), "itt_dir": pick("shadow_dir", "dir")})
    prod = score(F.col("expected"), F.col("p_up"), F.col("dir"), F.col("actual"))
    itt = score(F.col("itt_point"), F.col("itt_p_up"), F.col("itt_dir"), F.col("actual"))
    return rows.withColumns({**{f"prod_{k}": v for k, v in prod.items()},
                             **{f"itt_{k}": v for k, v in itt.items()}})


def link_audit(stored: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Stored outcomes against their forecast: references, order, recomputed scores."""
    keys = ["series_id", "session"]
    fresh = outcomes(forecasts).select(
        *keys, F.col("input_hash").alias("f_hash"), F.col("computed_at").alias("f_computed"),
        F.col("on_time").alias("f_on_time"), F.col("itt_dir").alias("f_dir"),
        *[F.col(f"{w}_{k}").alias(f"f_{w}_{k}") for w in ("prod", "itt") for k in SCORES])
    j = stored.join(fresh, keys, "left")
    wrong = F.lit(False)
    for w in ("prod", "itt"):
        for k in SCORES:
            wrong = wrong | (F.abs(F.col(f"{w}_{k}") - F.col(f"f_{w}_{k}")) > SCORE_TOL)
    issue = (F.when(F.col("f_hash").isNull(), "no_forecast")
             .when(F.col("input_hash") != F.col("f_hash"), "input_hash")
             .when(F.col("scored_at") < F.col("f_computed"), "scored_before_forecast")
             .when((F.col("on_time") != F.col("f_on_time")) | (F.col("itt_dir") != F.col("f_dir")), "mislabelled")
             .when(wrong, "score_differs").otherwise("ok"))
    return j.select(*keys, issue.alias("issue"))


def status(forecasts: DataFrame, cal: DataFrame, start: str) -> DataFrame:
    """Coverage, cohort completeness and headline errors per series."""
    first = Window.partitionBy("series_id", "status").orderBy("session")
    scored = outcomes(forecasts).select("series_id", "session", "prod_abs_error", "itt_abs_error",
                                        "prod_squared_error", "itt_squared_error", "prod_brier_up", "itt_brier_up")
    rows = forecasts.join(scored, ["series_id", "session"], "left").withColumn(
        "place", F.row_number().over(first))
    in_cohort = (F.col("status") == "eligible") & (F.col("place") <= REVIEW_PAIRS)
    resolved = F.col("prod_abs_error").isNotNull()
    g = rows.groupBy("series_id").agg(
        F.count("*").alias("captured"), count_if(F.col("status") == "eligible").alias("eligible"),
        count_if(F.col("state") == "forecasted").alias("on_time"),
        count_if(F.col("state").isin("failed", "missed_deadline")).alias("failed_or_late"),
        count_if(resolved).alias("resolved"), count_if(in_cohort).alias("cohort"),
        count_if(in_cohort & resolved).alias("cohort_resolved"),
        F.max("session").alias("last_session"), F.avg("prod_abs_error").alias("prod_mae"),
        F.avg("itt_abs_error").alias("itt_mae"), F.sqrt(F.avg("prod_squared_error")).alias("prod_rmse"),
        F.sqrt(F.avg("itt_squared_error")).alias("itt_rmse"), F.avg("prod_brier_up").alias("prod_brier"),
        F.avg("itt_brier_up").alias("itt_brier"))
    days = cal.where("is_bd").select(F.col("d").alias("session"))
    want = g.select("series_id", F.explode(F.sequence(F.lit(start).cast("date"), "last_session")).alias("session"))
    missing = (want.join(F.broadcast(days), "session")
               .join(forecasts.select("series_id", "session"), ["series_id", "session"], "left_anti")
               .groupBy("series_id").agg(F.count("*").alias("uncaptured")))
    return (g.join(missing, "series_id", "left").na.fill(0, ["uncaptured"])
            .withColumn("pending", F.col("eligible") - F.col("resolved"))
            .withColumn("operational_review_due", F.col("resolved") >= OPERATIONAL_PAIRS)
            .withColumn("cohort_complete", (F.col("cohort") == REVIEW_PAIRS)
                        & (F.col("cohort_resolved") == REVIEW_PAIRS)))


def formal_review(forecasts: DataFrame, uncaptured: DataFrame) -> DataFrame:
    """The one review of the fixed cohort: the first resolved eligible pairs."""
    first = in_series().orderBy("session")
    cohort = (outcomes(forecasts).withColumn("place", F.row_number().over(first))
              .where(F.col("place") <= REVIEW_PAIRS)
              .withColumn("gain", F.col("prod_abs_error") - F.col("itt_abs_error")))
    rows = cohort.select("series_id", "session", "gain", "on_time")
    g = rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("session").alias("start_session"), F.max("session").alias("end_session"),
        F.avg("gain").alias("mean_gain"), ratio(count_if(F.col("on_time")), F.count("*")).alias("coverage"))
    out = g.where(F.col("n") == REVIEW_PAIRS)
    for b in BLOCKS:
        ci = rs.block_intervals(rows, "session", ["gain"], b, RESAMPLES, "review")
        out = out.join(ci.select("series_id", F.col("low").alias(f"low_{b}"), F.col("high").alias(f"high_{b}")), "series_id")
    positive = F.lit(True)
    for b in BLOCKS:
        positive = positive & (F.col(f"low_{b}") > 0)
    out = out.join(uncaptured, "series_id", "left")
    return out.withColumn("positive_all", positive).withColumn(
        "passes", F.col("positive_all") & (F.col("mean_gain") >= MIN_GAIN)
        & (F.col("coverage") >= MIN_COVERAGE) & (F.coalesce("uncaptured", F.lit(0)) == 0))
