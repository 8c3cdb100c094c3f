"""Small panels for the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sluice.functions.calendar import business_calendar
from sluice.operators.align import one_session_deltas, training_pairs


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def panel(spark, rows):
    """rows of (series, date text, driver, response)."""
    num = lambda v: None if v is None else float(v)
    data = [(s, day(d), num(a), num(b)) for s, d, a, b in rows]
    return spark.createDataFrame(data, "series_id string, session date, driver double, response double")


def business_days(spark, start: str, count: int):
    rows = (business_calendar(spark).where(F.col("is_bd") & (F.col("d") >= F.lit(start).cast("date")))
            .orderBy("d").limit(count).collect())
    return [r["d"] for r in rows]


def synthetic(spark, count=700, slope=0.7, noise=0.008, seed=5, start="2003-03-03", lag=0, series="A", outcome_shift=None):
    """A driver walk and a response that follows it, one row per business day."""
    rng = np.random.default_rng(seed)
    step = rng.normal(0, 0.04, count)
    driver = 2.5 + np.cumsum(step - step.mean())
    echo = np.roll(step - step.mean(), lag)
    response = 2.6 + np.cumsum(slope * echo + rng.normal(0, noise, count))
    if outcome_shift is not None:
        response[outcome_shift:] += rng.normal(0, 0.5, count - outcome_shift)
    days = business_days(spark, start, count)
    data = [(series, d, float(a), float(b)) for d, a, b in zip(days, driver, response)]
    return spark.createDataFrame(data, "series_id string, session date, driver double, response double")


def train(spark, frame):
    return training_pairs(one_session_deltas(frame, business_calendar(spark)))


def pair_frame(spark, x, y, series="A"):
    """Training pairs given directly, on consecutive days."""
    n = len(x)
    base = dt.date(2001, 1, 1)
    data = [(series, base + dt.timedelta(days=i), base + dt.timedelta(days=i - 1), float(x[i]), float(y[i]), i + 1, n)
            for i in range(n)]
    return spark.createDataFrame(
        data, "series_id string, session date, prior_session date, x double, y double, ord int, n int")
