"""One JSON file per record: written once, told apart by what is wrong with it."""

import json

from pyspark.sql import functions as F

from sluice.sources import file_records as fr

SCHEMA = "day string, price double"


def bodies(spark, *rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return fr.sealed(df, F.col("day"), ["day", "price"])


def told(df):
    return {r["stem"]: r["status"] for r in df.collect()}


def seen(spark, folder, **kw):
    return {r["file_name"]: r["status"] for r in fr.checked_files(spark, folder, SCHEMA, "day", **kw).collect()}


def test_records_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "records")
    first = bodies(spark, ("2001-01-02", 2.5), ("2001-01-03", None))
    assert told(fr.write_once(first, folder)) == {"2001-01-02": "written", "2001-01-03": "written"}
    before = {p.name: p.read_text() for p in (tmp_path / "records").glob("*.json")}
    assert set(before) == {"2001-01-02.json", "2001-01-03.json"}
    second = bodies(spark, ("2001-01-02", 2.5), ("2001-01-03", 2.0), ("2001-01-04", 1.0))
    assert told(fr.write_once(second, folder)) == {"2001-01-02": "present", "2001-01-03": "conflict", "2001-01-04": "written"}
    assert {n: (tmp_path / "records" / n).read_text() for n in before} == before
    assert seen(spark, folder) == {f"2001-01-0{d}.json": "ok" for d in (2, 3, 4)}


def test_two_texts_of_one_name_and_bad_names(spark, tmp_path):
    rows = spark.createDataFrame([("a", "{}"), ("a", "{} "), ("b", "{}"), ("b", "{}"), ("../c", "{}"), (".d", "{}"), (None, "{}"), ("e", None)],
                                 "stem string, body string")
    got = told(fr.write_once(rows, str(tmp_path / "r")))
    assert got == {"a": "conflict", "b": "written", "../c": "bad_name", ".d": "bad_name", None: "bad_name", "e": "conflict"}
    assert [p.name for p in tmp_path.rglob("*.json")] == ["b.json"]
    assert [p.name for p in (tmp_path / "r").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")] == []


def test_every_kind_of_fault(spark, tmp_path):
    folder = tmp_path / "r"
    good = {r["stem"]: r["body"] for r in bodies(spark, *[(f"2001-01-{d:02d}", 1.5) for d in range(2, 12)]).collect()}
    fr.write_once(bodies(spark, ("2001-01-02", 1.5)), str(folder))
    put = lambda name, text: (folder / f"{name}.json").write_text(text)
    record = lambda d: json.loads(good[d])
    put("2001-01-03", json.dumps({**record("2001-01-03"), "price": 1.6}))  # changed
    put("2001-01-04", json.dumps({**record("2001-01-04"), "note": "x"}))  # a field more
    put("2001-01-05", json.dumps({"day": "2001-01-05", "price": 1.5}))  # no seal
    put("2001-01-06", "")
    put("2001-01-07", good["2001-01-07"][:15])
    put("2001-01-08", "[1, 2]")
    put("renamed", good["2001-01-09"])
    put("2001-01-10", json.dumps(record("2001-01-10"), indent=2) + "\n")  # laid out over several lines
    put("2001-01-11", json.dumps({**record("2001-01-11"), "price": "dear"}))
    assert seen(spark, str(folder)) == {
        "2001-01-02.json": "ok", "2001-01-03.json": "hash_mismatch", "2001-01-04.json": "hash_mismatch",
        "2001-01-05.json": "hash_mismatch", "2001-01-06.json": "unreadable", "2001-01-07.json": "unreadable",
        "2001-01-08.json": "unreadable", "renamed.json": "misnamed", "2001-01-10.json": "ok", "2001-01-11.json": "unreadable"}
    late = seen(spark, str(folder), inside=F.col("day") >= "2001-01-10")
    assert late["2001-01-02.json"] == late["renamed.json"] == "out_of_bounds" and late["2001-01-10.json"] == "ok"


def test_empty_folder(spark, tmp_path):
    assert seen(spark, str(tmp_path)) == {}
    assert told(fr.write_once(spark.createDataFrame([], "stem string, body string"), str(tmp_path / "n"))) == {}
