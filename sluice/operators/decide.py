"""Decision rules applied to a move and a set of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sluice.operators.fit import FALLBACK_FLOOR

# Baseline sources on which the model itself was fitted.
CALIBRATED_SOURCES = ("provenance_verified", "history_same_contract")
LOW_CONFIDENCE = 0.70
ACTIONS = ("BUY_NOW", "WAIT", "LEAN_BUY", "LEAN_WAIT")


def action_ladder(x: Column) -> Column:
    """First matching step of hike, drop, lean hike, lean drop."""
    c = F.col
    return (F.when(x >= c("hike"), "BUY_NOW").when(x <= c("drop_"), "WAIT")
            .when(x >= c("lean_hike"), "LEAN_BUY").when(x <= c("lean_drop"), "LEAN_WAIT")
            .otherwise("NO_EDGE"))


def effective_thresholds(source: Column, floor: float = FALLBACK_FLOOR) -> dict[str, Column]:
    """Thresholds widened to the fallback floor on an uncalibrated baseline."""
    known = F.coalesce(source.isin(*CALIBRATED_SOURCES), F.lit(False))
    up = lambda n: F.when(known, F.col(n)).otherwise(F.greatest(F.col(n), F.lit(floor)))
    down = lambda n: F.when(known, F.col(n)).otherwise(F.least(F.col(n), F.lit(-floor)))
    hike, drop = up("hike"), down("drop_")
    return {"hike": hike, "drop_": drop, "lean_hike": F.least(up("lean_hike"), hike),
            "lean_drop": F.greatest(down("lean_drop"), drop)}


def direction_of(action: Column) -> Column:
    return (F.when(action.isin("BUY_NOW", "LEAN_BUY"), "HIKE")
            .when(action.isin("WAIT", "LEAN_WAIT"), "DROP").otherwise("FLAT"))


def threshold_used(action: Column) -> Column:
    return (F.when(action == "BUY_NOW", F.col("hike")).when(action == "LEAN_BUY", F.col("lean_hike"))
            .when(action == "WAIT", F.col("drop_")).when(action == "LEAN_WAIT", F.col("lean_drop"))
            .otherwise(0.0))


def confidence_label(p: Column) -> Column:
    """Band text with a whole-percent figure, from the probability alone."""
    pct = F.concat(F.lit(" ("), F.round(p * 100).cast("int").cast("string"), F.lit("%)"))
    return (F.when(p.isNull(), "Confidence unavailable")
            .otherwise(F.concat(F.when(p >= 0.90, "High confidence")
                                .when(p >= 0.75, "Moderate confidence")
                                .otherwise("Low confidence"), pct)))


def z_band(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 1.5, "High").when(a >= 1.0, "Moderate").otherwise("Low")
