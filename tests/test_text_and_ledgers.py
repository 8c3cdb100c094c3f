import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import ledger, postings as po, quality as ql, report as rp, resample as rs
from sluice.sources import records as rec
from tests.helpers import day, panel

# One notice in several layouts: separators, case, blanks, sentences around the prices.
PRICES = {"unleaded": 1.8725, "premium": 3.0419, "diesel": 2.6600}
VARIANTS = [
    "{0}: $1.8725 per gallon\n{1}: $3.0419 per gallon\n{2}: $2.6600 per gallon",
    "{2} ... 2.6600\n\n{1} ... 3.0419\n\n{0} ... 1.8725",
    "today {0}|1.8725|x\ntoday {1}|3.0419|y\ntoday {2}|2.6600|z",
    "\t{0}\t\t=>\t1.8725\n\t{1}\t\t=>\t3.0419\n\t{2}\t\t=>\t2.6600",
]
LABELS = ["E10 - UNLEADED", "E10 - PREMIUM", "CLEAR DIESEL"]


def parsed(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    return po.posting_prices(df).orderBy("i").collect()


def test_posting_variants(spark):
    shouted = [v.format(*LABELS) for v in VARIANTS]
    quiet = [v.format(*(l.lower().replace(" ", "   ") for l in LABELS)) for v in VARIANTS]
    for r in parsed(spark, *shouted, *quiet):
        assert {k: r[k] for k in PRICES} == PRICES and r["reason"] is None


def test_posting_refusals(spark):
    far = "E10 - UNLEADED " + "x" * 70 + " 2.10\nE10 - PREMIUM 2.30\nCLEAR DIESEL 2.50"
    rows = parsed(spark, "E10 - UNLEADED 2.10\nCLEAR DIESEL 2.50", far,
                  "E10 - UNLEADED 2.10\nE10 - PREMIUM 12.30\nCLEAR DIESEL 2.50",
                  "E10 - UNLEADED\n2.10\nE10 - PREMIUM 2.30\nCLEAR DIESEL 2.50")
    assert [r["reason"] for r in rows] == ["missing_label", "missing_label", "out_of_bounds", "missing_label"]


def test_random_text_never_yields_a_posting(spark):
    rng = random.Random(11)
    words = ["E10", "-", "UNLEADED", "PREMIUM", "CLEAR", "2.1", "$", "9.99", "\n", " ", "{", "\\", "%"]
    bodies = [" ".join(rng.choices(words, k=30)).replace("CLEAR DIESEL", "") for _ in range(500)]
    assert all(r["reason"] is not None for r in parsed(spark, *bodies))


def test_effective_dates(spark):
    df = spark.createDataFrame(
        [("a", "good from 5/8/26", "2026-05-01 10:00:00"), ("b", "none", "2026-05-07 18:00:00"),
         ("c", "none", "2026-05-08 08:59:00"), ("d", "none", "2026-05-08 09:00:00")],
        "k string, body string, h string").withColumn("header_ts", F.to_timestamp_ntz("h"))
    got = {(r["k"], r["session"].isoformat(), r["rule"]) for r in po.effective_dates(df).collect()}
    assert got == {("a", "2026-05-08", "body"), ("b", "2026-05-07", "header"), ("c", "2026-05-08", "header"),
                   ("c", "2026-05-07", "late_morning"), ("d", "2026-05-08", "header")}


def test_masking_and_html(spark):
    df = spark.createDataFrame([("write jane.doe@x.org or bob@y.com, al@z.net now",
                                 "<p>a &amp; b</p><!-- <b>no</b> --><script>if (1<2) '</p>'</script> c")], "t string, h string")
    row = df.select(po.mask_contacts(F.col("t")), po.html_text(F.col("h"))).first()
    assert row[0] == "write ja***e@x.org or ***@y.com, ***@z.net now"
    assert row[1] == "a & b c"


def test_character_references(spark):
    cases = {"it&#39;s 2&mdash;3": "it's 2\u20143", "&#x1F642;&amp;lt;&nbsp;&eacute;": "\U0001f642&lt; \u00e9", "a && b &bogus; &#0; &#xD800; &": "a && b &bogus; &#0; &#xD800; &", "none": "none"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for r in df.withColumn("got", po.unescaped(F.col("raw"))).collect():
        assert r["got"] == r["want"]


def test_given_values_are_masked(spark):
    df = spark.createDataFrame([("call +1-555-0142 or ann@x.io, key s3cr3t-k3y-91, pin 1234",)], "t string")
    got = df.select(po.mask_values(F.col("t"), ["+1-555-0142", " ann@x.io", "s3cr3t-k3y-91", "1234", ""])).first()[0]
    assert got == "call +1***42 or ***@x.io, key s3***91, pin 1234"
    one = spark.createDataFrame([("maria.lopez@y.org",), ("5550142",), ("1234",), ("",), (None,)], "v string")
    assert [r[0] for r in one.select(po.mask_recipient(F.col("v"))).collect()] == ["ma***z@y.org", "55***42", "***", "None", "None"]


def test_active_symbol_tiers(spark):
    docs = ['{"/RB":{"reference":{"futureActiveSymbol":"rbz26:XNYM"}}}',
            '{"a":{"reference":{"futureActiveSymbol":"/RBF27"}},"b":{"reference":{"futureActiveSymbol":"RBF27"}}}',
            '{"a":{"reference":{"futureIsActive":"true"},"quote":{"symbol":"/RBG27"}},"b":{"reference":{"futureIsActive":false}}}',
            '{"/RBH27":{"reference":{"futureIsActive":true}}}',
            '{"a":{"reference":{"futureActiveSymbol":"/RBF27"}},"b":{"reference":{"futureActiveSymbol":"/RBG27"}}}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = df.select("i", rec.active_symbol(F.from_json("d", rec.QUOTE_SCHEMA), "RB").alias("s")).orderBy("i")
    assert [r["s"] for r in got.collect()] == ["/RBZ26", "/RBF27", "/RBG27", "/RBH27", None]


def test_contract_audit_truth_table(spark):
    s = spark.createDataFrame([("A", day(f"2026-01-0{i}"), 2.0, c) for i, c in
                               ((1, 2.0), (2, 2.1), (3, 2.2), (4, None))],
                              "series_id string, session date, stored double, continuous double")
    v = spark.createDataFrame([("A", day(f"2026-01-0{i}"), sym, c) for i, sym, c in
                               ((1, "p", 2.0), (2, "q", 2.1), (3, "q", 2.2), (3, "r", 2.2))],
                              "series_id string, session date, symbol string, close double")
    got = {r["session"].day: (r["status"], r["correction_eligible"]) for r in ql.contract_audit(s, v).collect()}
    assert got == {1: ("verified", False), 2: ("mismatch", True), 3: ("mismatch", False), 4: ("unverifiable", False)}


def test_history_rules_fire_once_each(spark):
    from sluice.functions.calendar import business_calendar
    rows = [("2026-05-18", 2.0), ("2026-05-19", -1.0), ("2026-05-20", 12.0), ("2026-05-20", 2.0),
            ("2026-05-21", None), ("2026-06-02", 2.0), ("2026-06-01", 2.0)]
    data = [("A", day(d), p, 2.0, i) for i, (d, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "series_id string, session date, driver double, response double, line_no int")
    got = {}
    for r in ql.history_violations(df, business_calendar(spark)).collect():
        got[r["rule"]] = got.get(r["rule"], 0) + 1
    assert got == {"duplicate_date": 2, "not_positive": 1, "out_of_bounds": 1, "jump_over_1": 3,
                   "missing_on_trading_day": 1, "gap_over_7_days": 1, "unsorted": 1}


def test_current_rows_and_append(spark):
    led = spark.createDataFrame([("r1", None, 1), ("r2", None, 2), ("r3", "r1", 3)], "record_id string, supersedes string, v int")
    assert sorted(r["record_id"] for r in ledger.current_rows(led).collect()) == ["r2", "r3"]
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in ledger.append_absent(old, new, ["k"]).collect()) == [(2, "b", True), (3, "d", False)]


ARTIFACT = "series_id string, session date, artifact_id string, prior_artifact_id string, training_end date"


def status_of(spark, filed, arriving):
    row = lambda r: ("A", day(r[0]), r[1], r[2], day(r[3]))
    made = lambda rows: spark.createDataFrame([row(r) for r in rows], ARTIFACT)
    return sorted((r["session"].isoformat(), r["new_id"], r["status"])
                  for r in ledger.append_status(made(filed), made(arriving), "session").collect())


def test_append_status_reports_every_id(spark):
    filed = [("2026-01-05", "a1", "bootstrap_config", "2026-01-02")]
    assert status_of(spark, filed, [("2026-01-06", "aaa", "a1", "2026-01-05"), ("2026-01-06", "bbb", "a1", "2026-01-05")]) == [
        ("2026-01-06", "aaa", "conflict"), ("2026-01-06", "bbb", "conflict")]
    assert status_of(spark, filed, [("2026-01-05", "a1", "bootstrap_config", "2026-01-02"), ("2026-01-05", "zz", "x", "2026-01-02")]) == [
        ("2026-01-05", "a1", "same"), ("2026-01-05", "zz", "conflict")]


def test_append_status_follows_the_chain(spark):
    filed = [("2026-01-05", "a1", "bootstrap_config", "2026-01-02")]
    batch = [("2026-01-04", "a0", "bootstrap_config", "2026-01-01"), ("2026-01-07", "a3", "a2", "2026-01-01"),
             ("2026-01-06", "a2", "a1", "2026-01-05"), ("2026-01-08", "a4", "a2", "2026-01-07")]
    assert status_of(spark, filed, batch) == [
        ("2026-01-04", "a0", "out_of_order"), ("2026-01-06", "a2", "new"), ("2026-01-07", "a3", "training_back"),
        ("2026-01-08", "a4", "broken_chain")]
    assert status_of(spark, [], batch[2:3]) == [("2026-01-06", "a2", "broken_chain")]


def test_append_table_is_idempotent_and_refuses_changes(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame([("A", day(d), v) for d, v in rows], "series_id string, session date, v string")
    told = lambda rows: {(r["session"].isoformat()): r["status"] for r in ledger.append_table(
        made(*rows), str(tmp_path / "log"), ["series_id", "session"]).collect()}
    assert told([("2026-01-05", "a"), ("2026-02-03", "b")]) == {"2026-01-05": "appended", "2026-02-03": "appended"}
    assert told([("2026-01-05", "a"), ("2026-02-03", "z"), ("2026-02-04", None)]) == {
        "2026-01-05": "present", "2026-02-03": "conflict", "2026-02-04": "appended"}
    assert told([("2026-02-04", None), ("2026-02-05", "c"), ("2026-02-05", "d")]) == {"2026-02-04": "present", "2026-02-05": "conflict"}
    filed = ledger.table_at(str(tmp_path / "log"), made(("2026-01-01", "x"))).collect()
    assert sorted((r["session"].isoformat(), r["v"]) for r in filed) == [("2026-01-05", "a"), ("2026-02-03", "b"), ("2026-02-04", None)]


def test_priority_skips_missing_prices(spark):
    c = spark.createDataFrame([("A", 1, None, "first"), ("A", 2, 2.5, "second"), ("B", 1, None, "first")],
                              "series_id string, priority int, price double, source string")
    assert [tuple(r) for r in rec.priority_pick(c, ["series_id"], "price").collect()] == [("A", 2, 2.5, "second")]


def test_unknown_series_has_no_floor(spark):
    rows = [(s, 1, True, 2.0) for s in "AZ" for _ in range(30)]
    live = spark.createDataFrame(rows, "series_id string, dir int, correct boolean, z double")
    floors = spark.createDataFrame([("A", 0.6)], "series_id string, floor double")
    assert {r["series_id"]: r["status"] for r in rp.live_floor_check(live, floors).collect()} == {"A": "validated", "Z": "no_floor"}


def test_few_recent_rows_leave_the_whole_sample(spark):
    rows = [(i, f"2026-01-0{1 + i}") for i in range(4)] + [(9, "2025-01-01")]
    live = spark.createDataFrame(rows, "k int, t string").withColumn("verdict_ts", F.to_timestamp_ntz("t"))
    assert rp.tested_rows(live).count() == 5
    assert rp.tested_rows(live.unionAll(live)).count() == 8


def test_live_summary_and_policy_numbers(spark):
    df = spark.createDataFrame(
        [("A", 1, 2.0, 2.0, True, "High confidence (90%) | p=0.9000"),
         ("A", 0, -4.0, 0.0, False, "Low confidence (60%) | p=0.6000"),
         ("A", -1, 1.0, -1.0, False, "Moderate confidence (75%) | p=0.7500")],
        "series_id string, dir int, actual double, savings double, correct boolean, label string")
    row = {r["series_id"]: r for r in rp.live_summary(df).collect()}["All"]
    assert (row["alerts"], row["wins"]) == (2, 1)
    assert row["brier"] == pytest.approx((0.01 + 0.5625) / 2)
    assert row["calibration_gap"] == pytest.approx(0.5 - 0.825)


def test_permuted_days_keep_their_series_together(spark):
    """When the second series is the first plus 100, every donor day adds the
    same signed constant, so the null spread is that of one series alone."""
    data = [(s, day("2026-01-01").replace(day=1 + i % 28, month=1 + i // 28), 1, float(i) + (100 if s == "B" else 0))
            for i in range(35) for s in "AB"]
    log = spark.createDataFrame(data, "series_id string, session date, dir int, y double")
    row = rs.date_block_permutation(log, 200, "t").first()
    # All signals point the same way, so each permutation reproduces the total.
    assert row["as_extreme"] == 200 and row["p_value"] == 1.0 and row["duplicate_sessions"] == 0
    assert row["null_mean"] == pytest.approx(row["real_savings"])


def test_mann_kendall_against_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(0, 1, 70) + np.arange(70) * 0.02, 1)
    days = [f"2026-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in range(70)]
    frame = panel(spark, [("A", d, 2.0, 2.0 + x / 100) for d, x in zip(days, v)])
    row = rp.mann_kendall(frame).first()
    b = np.array([(2.0 + x / 100 - 2.0) * 100 for x in v[-65:]])
    i, j = np.triu_indices(65, 1)
    assert row["s"] == np.sign(b[j] - b[i]).sum()
    assert row["sen_slope"] == pytest.approx(np.median((b[j] - b[i]) / (j - i)))


def test_quarantine_anywhere(spark):
    lines = spark.createDataFrame([("1,2026-01-01,5",), ("2,2026-01-02",), ("x,2026-01-03,7",), ("4,2026-01-04,8",)], "line string")
    out = rec.split_malformed(lines, "line", "k BIGINT, d DATE, c BIGINT").select("quarantined", "c")
    assert [r["quarantined"] for r in out.collect()] == [False, True, True, False]


def test_export_round_trip_and_no_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5), ("B", 2.5)], "series_id string, v double")
    for fmt in ("parquet", "csv", "json"):
        path = str(tmp_path / fmt)
        rec.export(df, path, fmt)
        reader = spark.read.schema(df.schema).format(fmt)
        back = reader.options(header="true").load(path) if fmt == "csv" else reader.load(path)
        assert sorted(map(tuple, back.collect())) == [("A", 1.5), ("B", 2.5)]
        with pytest.raises(Exception):
            rec.export(df, path, fmt)
