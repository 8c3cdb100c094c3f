"""Validation rules as violation rows, and provenance checks.

Every rule of a validator is tested in one pass: a row collects the names of
the rules it breaks and is exploded once, so adding a rule adds no scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.calendar import MONTH_CODES, in_calendar, valid_symbol
from sluice.functions.exprs import ratio
from sluice.operators import decide
from sluice.operators.align import by_session, in_series
from sluice.operators.ledger import GENESIS, micro

# Fixed values of the validators.
PRICES = ("driver", "response")
#: Texts that count as a missing value, in any letter case.
BLANKS = ("", "na", "n/a", "nan", "null", "none")
MAX_GAP_DAYS, PRICE_LOW, PRICE_HIGH, MAX_JUMP = 7, 1.0, 10.0, 1.0
MOVE_TOL, Z_TOL, CONTRACT_TOL, BASELINE_GAP = 0.011, 0.005, 0.00015, 0.05
SHA = "^[0-9a-f]{64}$"


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per (key, rule) that the row breaks; unknown counts as kept."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("rule"))


def history_violations(raw: DataFrame, cal: DataFrame) -> DataFrame:
    """Rules on a price file in the order it was written (``line_no``)."""
    file_order = in_series().orderBy("line_no")
    same_day = Window.partitionBy("series_id", "session")
    before = file_order.rowsBetween(Window.unboundedPreceding, -1)
    days = cal.select(F.col("d").alias("session"), "is_holiday_alt")
    rows = (in_calendar(raw, "session").withColumn("copies", F.count("*").over(same_day))
            .withColumn("prev", F.lag("session").over(file_order))
            .withColumns({f"prev_{p}": F.last(p, ignorenulls=True).over(before) for p in PRICES})
            .join(F.broadcast(days), "session", "left"))
    c = F.col
    trading = (F.weekday("session") < 5) & ~c("is_holiday_alt")
    # Against the last line that has this price, however many lines lie between.
    jumped = lambda p: F.abs(c(p) - c(f"prev_{p}")) > MAX_JUMP
    outside = lambda p: (p > 0) & ((p < PRICE_LOW) | (p > PRICE_HIGH))
    return violations(rows, ["series_id", "session"], {
        "duplicate_date": c("copies") > 1, "unsorted": c("session") < c("prev"),
        "gap_over_7_days": F.datediff("session", "prev") > MAX_GAP_DAYS,
        "not_positive": (c("driver") <= 0) | (c("response") <= 0),
        "out_of_bounds": outside(c("driver")) | outside(c("response")),
        "jump_over_1": jumped("driver"), "response_jump_over_1": jumped("response"),
        "missing_on_trading_day": trading & c("driver").isNull(),
    })


def file_violations(rows: DataFrame, file: str, session: str = "session", prices: tuple[str, ...] = PRICES) -> DataFrame:
    """Rules on a price file as it was delivered, all of its columns text: (file, column, rule, lines).

    A column that is not there is told and the others are checked all the same; a file without lines is ``empty_file``.
    Blank values are missing, not wrong.  One pass, whatever the number of columns.
    """
    spark, there = rows.sparkSession, [c for c in (session, *prices) if c in rows.columns]
    missing = spark.createDataFrame([(file, c, "missing_column", None) for c in (session, *prices) if c not in there],
                                    "file string, column string, rule string, lines long")
    text = lambda name: F.trim(F.col(f"`{name}`").cast("string"))
    wrong: dict[str, Column] = {}
    for c in there:
        read = text(c).try_cast("date") if c == session else text(c).try_cast("double")
        wrong[c] = F.count_if(~F.coalesce(F.lower(text(c)), F.lit("")).isin(*BLANKS) & read.isNull())
    counted = rows.agg(F.count("*").alias("all"), *(n.alias(f"wrong_{i}") for i, n in enumerate(wrong.values())))
    told = [F.struct(F.lit("*").alias("column"), F.lit("empty_file").alias("rule"),
                     F.when(F.col("all") == 0, F.lit(0)).cast("long").alias("lines"))]
    told += [F.struct(F.lit(c).alias("column"), F.lit("invalid_date" if c == session else "non_numeric").alias("rule"),
                      F.nullif(F.col(f"wrong_{i}"), F.lit(0)).cast("long").alias("lines")) for i, c in enumerate(wrong)]
    found = counted.select(F.lit(file).alias("file"), F.inline(F.array(*told))).where("lines IS NOT NULL")
    return missing.unionByName(found)


def parity_violations(raw: DataFrame) -> DataFrame:
    """Sessions on which some series have a driver and others do not."""
    g = raw.groupBy("session").agg(F.count("driver").alias("k"), F.count("*").alias("n"))
    return g.where("k > 0 AND k < n").select(F.lit("*").alias("series_id"), "session",
                                             F.lit("mismatched_presence").alias("rule"))


def log_violations(log: DataFrame, arts: DataFrame) -> DataFrame:
    """Enumerations, formats, artifact references and recomputed decisions."""
    a = arts.select("series_id", F.col("artifact_id").alias("calibration_id"),
                    F.col("effective_session").alias("a_session"), F.col("hike").alias("a_hike"),
                    F.col("drop_").alias("a_drop"), F.col("lean_hike").alias("a_lean_hike"),
                    F.col("lean_drop").alias("a_lean_drop"), F.col("daily_std").alias("a_std"))
    rows = log.join(a, ["series_id", "calibration_id"], "left")
    c = F.col
    price_move = (c("signal_price") - c("baseline_price")) * 100
    action = decide.action_ladder(price_move)
    p = F.regexp_extract("label", r" \| p=(0\.[0-9]+|1\.0+)$", 1).try_cast("double")
    text = F.regexp_extract("label", r"^(.+?) \| p=", 1)
    known = F.coalesce(c("baseline_source").isin(*decide.CALIBRATED_SOURCES), F.lit(False))
    floor_up = lambda v: F.when(known, v).otherwise(F.greatest(v, F.lit(1.2)))
    floor_down = lambda v: F.when(known, v).otherwise(F.least(v, F.lit(-1.2)))
    off = lambda a_, b_: F.abs(a_ - b_) > 0.00011
    backed = c("a_session").isNotNull()
    return violations(rows, ["series_id", "session"], {
        "direction_enum": ~c("modeled_direction").isin("HIKE", "DROP", "FLAT"),
        "source_enum": ~c("prediction_source").isin("live", "backfill", "unlabelled"),
        "outcome_enum": ~c("outcome_status").isin("RESOLVED", "PENDING", "NO_PRIOR_SESSION"),
        "label_malformed": p.isNull(),
        "label_mismatch": p.isNotNull() & (text != decide.confidence_label(p)),
        "artifact_format": ~c("calibration_id").rlike(SHA),
        "artifact_unknown": c("calibration_id").rlike(SHA) & ~backed,
        "artifact_session": backed & (c("a_session") != c("effective_session")),
        "artifact_fields": backed & (off(c("hike"), floor_up(c("a_hike"))) | off(c("drop_"), floor_down(c("a_drop")))
                                     | off(c("daily_std"), c("a_std"))),
        "std_not_positive": c("daily_std") <= 0,
        "move_mismatch": F.abs(price_move - c("move")) > MOVE_TOL,
        "z_mismatch": F.abs(c("z") - ratio(c("move"), c("daily_std"))) > Z_TOL,
        "direction_mismatch": c("modeled_direction").isin("HIKE", "DROP", "FLAT")
        & (c("modeled_direction") != decide.direction_of(action)),
        "threshold_mismatch": F.abs(c("modeled_threshold") - decide.threshold_used(action)) > MOVE_TOL,
    })


def provenance_violations(rows: DataFrame) -> DataFrame:
    copies = F.count("*").over(Window.partitionBy("session", "commodity"))
    rows = rows.withColumn("copies", copies)
    c, verified = F.col, F.col("status") == "verified"
    return violations(rows, ["session", "commodity"], {
        "duplicate_key": c("copies") > 1,
        "commodity_enum": ~c("commodity").isin("RB", "HO"),
        "status_enum": ~c("status").isin("verified", "unknown"),
        "price_not_positive": F.coalesce(c("price") <= 0, F.lit(True)),
        "symbol_format": verified & ~valid_symbol(c("symbol")),
        "symbol_commodity": verified & valid_symbol(c("symbol"))
        & ~c("symbol").startswith(F.concat(F.lit("/"), c("commodity"))),
    })


DAILY_SCHEMA = ("date string, captured_at string, settlement_schema_version int, "
                "rb_settlement double, rb_contract string, ho_settlement double, ho_contract string")


def daily_violations(records: DataFrame, column: str) -> DataFrame:
    """Settlement records as JSON text; contract identity from version 2 on."""
    rows = records.select("session", F.from_json(column, DAILY_SCHEMA).alias("r")).select("session", "r.*")
    version = F.coalesce("settlement_schema_version", F.lit(1))
    rules = {
        "bad_date": F.col("date").try_cast("date").isNull(),
        "no_timezone": ~F.coalesce(F.col("captured_at"), F.lit("")).rlike("([+-][0-9]{2}:[0-9]{2}|Z)$"),
    }
    for p in ("rb", "ho"):
        price, contract = F.col(f"{p}_settlement"), F.coalesce(F.col(f"{p}_contract"), F.lit(""))
        rules[f"{p}_price"] = price <= 0
        rules[f"{p}_contract"] = price.isNotNull() & (version >= 2) & ~contract.rlike(
            f"^/{p.upper()}[{MONTH_CODES}][0-9]{{2}}$")
    return violations(rows, ["session"], rules)


def artifact_violations(arts: DataFrame) -> DataFrame:
    """Formats, dates, recomputed content id, and the chain to the one before."""
    w = in_series().orderBy("effective_session", "block")
    rows = (arts.withColumn("last_id", F.lag("artifact_id", 1, GENESIS).over(w))
            .withColumn("last_end", F.lag("training_end").over(w))
            .withColumn("copies", F.count("*").over(Window.partitionBy("series_id", "effective_session"))))
    c = F.col
    core = F.concat_ws("|", "series_id", *[F.col(k).cast("string") for k in (
        "effective_session", "training_start", "training_end", "rows")], *[micro(k) for k in (
            "slope", "intercept", "hike", "drop_", "lean_hike", "lean_drop", "daily_std")])
    return violations(rows, ["series_id", "effective_session"], {
        "id_format": ~c("artifact_id").rlike(SHA),
        "date_order": (c("training_start") > c("training_end")) | (c("training_end") >= c("effective_session")),
        "content_id": c("artifact_id") != F.sha2(F.concat_ws("|", "prior_artifact_id", core), 256),
        "chain_broken": c("prior_artifact_id") != c("last_id"),
        "training_moved_back": c("training_end") < c("last_end"),
        "duplicate_session": c("copies") > 1, "no_rows": c("rows") < 1,
    })


def execution_violations(rows: DataFrame) -> DataFrame:
    """Execution ledger rules; ``seq`` is the order of recording.

    The record a correction points to is found by one equi-join on its id.
    Rows without a reference keep a distinct null-safe key out of that join, so
    the many first records do not meet on one null key.
    """
    target = rows.select(F.col("record_id").alias("supersedes"), F.col("seq").alias("t_seq"),
                         F.col("signal_date").alias("t_date"), F.col("series_id").alias("t_series"))
    fixes = rows.where(F.col("supersedes").isNotNull())
    claim = Window.partitionBy("supersedes").orderBy("seq")
    fixes = (fixes.withColumn("claim_no", F.row_number().over(claim))
             .join(target, "supersedes", "left"))
    c = F.col
    links = violations(fixes, ["record_id"], {
        "supersedes_unknown": c("t_seq").isNull() | (c("t_seq") >= c("seq")),
        "supersedes_twice": c("claim_no") > 1,
        "identity_changed": c("t_seq").isNotNull() & ((c("t_date") != c("signal_date"))
                                                      | (c("t_series") != c("series_id"))),
    })
    paid, cf, real = c("paid"), c("counterfactual"), c("realized")
    own = violations(rows, ["record_id"], {
        "id_format": ~c("record_id").rlike("^[0-9a-f]{32}$"),
        "gallons": c("gallons") <= 0,
        "recommendation_enum": ~c("recommendation").isin("HIKE", "DROP", "FLAT"),
        "action_enum": ~c("action").isin("DISPATCHED_SAME_DAY", "WAITED", "NO_ACTION"),
        "same_day_date": (c("action") == "DISPATCHED_SAME_DAY") & ~c("load_date").eqNullSafe(c("signal_date")),
        "wait_date": (c("action") == "WAITED") & (c("load_date") <= c("signal_date")),
        "incomplete_prices": (paid.isNotNull() != cf.isNotNull()) | (paid.isNotNull() != real.isNotNull()),
        "price_not_positive": (paid <= 0) | (cf <= 0),
        "savings_mismatch": F.abs(real - (cf - paid) * c("gallons")) > MOVE_TOL,
    })
    return own.unionByName(links)


def row_hash(*cols: str) -> Column:
    """Hash of a row with numbers in canonical form."""
    return F.sha2(F.concat_ws("|", *[micro(c) if c not in ("series_id", "session") else F.col(c).cast("string")
                                     for c in cols]), 256)


def prefix_integrity(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Row-level comparison of a ledger with its recorded hashes.

    Rows are matched by position, so the answer names each changed row, and a
    missing tail is told apart from an appended one.
    """
    j = (stored.select("series_id", "ord", F.col("h").alias("old"))
         .join(current.select("series_id", "ord", F.col("h").alias("new")), ["series_id", "ord"], "full_outer"))
    return j.withColumn("status", F.when(F.col("old").isNull(), "appended").when(F.col("new").isNull(), "truncated")
                        .when(F.col("old") != F.col("new"), "changed").otherwise("ok"))


def history_hash(rows: DataFrame) -> DataFrame:
    """Fingerprint per series of its rows in date order (bounded by the calendar)."""
    h = rows.select("series_id", "session", row_hash("session", "driver", "response").alias("h"))
    return h.groupBy("series_id").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("session", "h"))),
                                        lambda s: s["h"]), ""), 256).alias("history_hash"),
        F.count("*").alias("rows"), F.max("session").alias("last_session"))


def contract_audit(stored: DataFrame, vendor: DataFrame) -> DataFrame:
    """Stored price against the continuous quote and every contract's close.

    Sessions are matched exactly and prices within a tolerance afterwards, so
    the join is an equi-join over at most a handful of contracts per session.
    """
    j = stored.join(vendor, ["series_id", "session"], "left")
    near = lambda p: F.abs(F.col("close") - p) <= CONTRACT_TOL
    g = j.groupBy("series_id", "session").agg(
        F.first("stored").alias("stored"), F.first("continuous").alias("continuous"),
        F.collect_set(F.when(near(F.col("stored")), F.col("symbol"))).alias("s"),
        F.collect_set(F.when(near(F.col("continuous")), F.col("symbol"))).alias("a"))
    status = (F.when(F.col("continuous").isNull(), "unverifiable")
              .when(F.abs(F.col("stored") - F.col("continuous")) <= CONTRACT_TOL, "verified").otherwise("mismatch"))
    return g.select("series_id", "session", status.alias("status"), F.size("s").alias("stored_matches"),
                    F.size("a").alias("active_matches"),
                    ((status == "mismatch") & (F.size("a") == 1)).alias("correction_eligible"))


def contract_status(active: Column, baseline: Column, snapshot: Column, used_snapshot: Column) -> Column:
    """Whether a verdict compares two prices of one contract."""
    return (F.when(active.isNull() | baseline.isNull(), "unavailable")
            .when(active != baseline, "mismatch_suppressed")
            .when(used_snapshot & (F.coalesce(snapshot, active) != active), "mismatch_suppressed")
            .otherwise("verified"))


def baseline_pick(days: DataFrame, provenance: DataFrame, history: DataFrame, vendor: DataFrame) -> DataFrame:
    """Prior settle by trust: same-contract provenance, history, vendor close.

    Recorded values yield to the vendor's when they lie further apart than one
    contract could, which also costs the calibrated-source status.
    """
    keys = ["series_id", "prev_bd"]
    p = provenance.select("series_id", F.col("session").alias("prev_bd"), F.col("symbol").alias("p_symbol"), F.col("price").alias("p_price"))
    h = history.select("series_id", F.col("session").alias("prev_bd"), F.col("driver").alias("h_price"))
    v = vendor.select("series_id", "session", F.col("close").alias("v_price"))
    j = days.join(p, keys, "left").join(h, keys, "left").join(v, ["series_id", "session"], "left")
    same = F.col("p_price").isNotNull() & (F.col("p_symbol") == F.col("active"))
    usable_h = F.col("h_price").isNotNull() & ~F.col("is_roll")
    recorded = F.when(same, F.col("p_price")).when(usable_h, F.col("h_price"))
    fits = recorded.isNotNull() & (F.col("v_price").isNull() | (F.abs(recorded - F.col("v_price")) <= BASELINE_GAP))
    source = (F.when(fits & same, "provenance_verified").when(fits, "history_same_contract")
              .when(F.col("v_price").isNotNull(), "exchange_close")
              .when(F.col("h_price").isNotNull(), "history_unverified").otherwise("none"))
    price = F.when(fits, recorded).otherwise(F.coalesce("v_price", "h_price"))
    return j.select("series_id", "session", source.alias("source"), price.alias("baseline"))


def calibration_current(fresh: DataFrame, published: DataFrame, cal: DataFrame, method: str) -> DataFrame:
    """Which series may skip recalibration, and when a new artifact would apply.

    A slot already taken moves the new artifact past the last occupied session.
    """
    days = cal.select(F.col("d").alias("last_session"), "next_bd")
    later = cal.select(F.col("d").alias("occupied"), F.col("next_bd").alias("after_occupied"))
    j = (fresh.join(F.broadcast(days), "last_session").join(published, "series_id", "left")
         .join(F.broadcast(later), "occupied", "left"))
    same = F.coalesce((F.col("old_hash") == F.col("history_hash")) & (F.col("method") == method)
                      & (F.col("occupied") >= F.col("next_bd")), F.lit(False))
    slot = F.when(F.col("occupied") >= F.col("next_bd"), F.col("after_occupied")).otherwise(F.col("next_bd"))
    return j.select("series_id", same.alias("current"),
                    F.when(same, F.col("occupied")).otherwise(slot).alias("effective_session"))


def artifact_lookup(sessions: DataFrame, arts: DataFrame) -> DataFrame:
    """Exact-session artifact, and the latest one effective by that session.

    The as-of side is a running last value over the union of both tables: one
    shuffle by series and no inequality join.
    """
    a = arts.select("series_id", F.col("effective_session").alias("session"), "artifact_id")
    both = (sessions.select("series_id", "session").withColumn("asked", F.lit(True))
            .withColumn("artifact_id", F.lit(None).cast("string"))
            .unionByName(a.withColumn("asked", F.lit(False)).select("series_id", "session", "asked", "artifact_id")))
    both = both.groupBy("series_id", "session").agg(
        F.bool_or("asked").alias("asked"), F.max("artifact_id").alias("exact_id"))
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("asof_id", F.last("exact_id", ignorenulls=True).over(upto))
            .where("asked").select("series_id", "session", "exact_id", "asof_id"))


def training_cut(train: DataFrame, arts: DataFrame) -> DataFrame:
    """Rows strictly before each effective session, against what was recorded."""
    before = train.select("series_id", F.col("session").alias("effective_session"),
                          (F.col("ord") - 1).alias("eligible_rows"),
                          F.lag("session").over(by_session()).alias("last_eligible"))
    j = arts.join(before, ["series_id", "effective_session"])
    return j.select("series_id", "effective_session", "eligible_rows", "last_eligible",
                    (F.col("training_end") < F.col("effective_session")).alias("no_leak"),
                    (F.col("training_end") == F.col("last_eligible")).alias("uses_latest"))
