"""Rules, value checks, published exports, free dates and registries by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloom.functions.dates import day_first, registry_date
from gridloom.operators import audit, quality, registry
from gridloom.sources import files


def test_rules_find_bad_rows_by_group(spark):
    rows = [("a", "1", "2011-01-05", "x"), ("a", "1", "31/12/2010", "x"), ("a", None, "soon", "y"), ("b", "-3", " ", "z"), ("b", "n/a", None, "x"), ("b", "9", "2012-05-01", "x")]
    df = spark.createDataFrame(rows, "g string, v string, d string, k string")
    rules = audit.rules_of(spark, [("missing", ["v"], "missing", [], [(0.5, "high"), (0.3, "medium")]), ("outside", ["v"], "outside", ["0", "5"], []), ("text", ["v"], "not_number", [], []), ("date", ["d"], "not_date", [], []), ("period", ["d"], "date_outside", ["2011-01-01", "2011-12-31"], []), ("kind", ["k"], "domain", ["x", "y"], [(0.0, "high")]), ("twice", ["v"], "repeated", [], []), ("gone", ["w"], "missing", [], [])])
    got = {(r["g"], r["finding"]): (r["n"], r["severity"]) for r in audit.audit(df, rules, ["g"]).collect()}
    assert got == {("a", "missing"): (1, "medium"), ("a", "date"): (1, "low"), ("a", "period"): (1, "low"), ("a", "twice"): (1, "low"), ("a", "no_column"): (3, "high"), ("b", "text"): (1, "low"), ("b", "outside"): (2, "low"), ("b", "period"): (1, "low"), ("b", "kind"): (1, "high"), ("b", "no_column"): (3, "high")}
    assert audit.audit(df, rules.limit(0)).count() == 0 and audit.audit(df.limit(0), rules).count() == 0
    whole = audit.audit(df.union(df.limit(1)), audit.rules_of(spark, [("rows", [], "repeated", [], [])]))
    assert [(r["finding"], r["n"]) for r in whole.collect()] == [("rows", 1)]
    plan = audit.audit(df, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1 and "Join" not in plan


def test_report_of_an_inventory(spark):
    df = spark.createDataFrame([(2001, "a", 1.0, 2.0), (2002, "a", None, -1.0), (2002, "a", None, -1.0)], "year int, place string, m double, k double")
    r = audit.inventory_report(df, "t", ["year", "place"], "year", (2001, 2003), ["m", "k"], rows_read=5).first()
    assert (r["rows"], r["left_out"], r["null_values"], r["negative_values"], r["repeated_rows"], r["repeated_keys"], r["total_k"], r["status"]) == (3, 2, 2, 2, 1, 1, 0.0, "review")
    assert r["notes"] == "other period; years missing; null values; negative values; repeated rows; repeated keys"
    good = audit.inventory_report(df.filter("year = 2001"), "t", ["year", "place"], "year", (2001, 2001), ["m", "k"]).first()
    assert (good["status"], good["notes"]) == ("ok", "")
    assert audit.inventory_report(df.limit(0), "t", ["year"], "year", (2001, 2001), ["m"]).first()["notes"].startswith("no rows; other period")


def test_columns_without_values_or_of_one_value(spark):
    df = spark.createDataFrame([(1, None, "x", "p", [1]), (2, None, "x", None, [1])], "a int, b string, c string, d string, _rows array<int>")
    got = {r["check"]: (r["value"], r["status"]) for r in quality.check_values(df, "m").collect()}
    assert got == {"m: columns without values": ("b", "error"), "m: columns of one value": ("c,_rows", "warning")}
    assert {r["status"] for r in quality.check_values(df.limit(0), "m").collect()} == {"ok"}
    assert {r["status"] for r in quality.check_values(df.select("a", "b", "c"), "m", ["b", "c"]).collect()} == {"ok"}


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_batches_are_visible_whole_or_not_at_all(spark, tmp_path, kind):
    at = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, at)
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    assert files.publish_batch(df, at, "one", kind) and files.publish_batch(df.limit(1), at, "two", kind)
    assert not files.publish_batch(df, at, "one", kind)
    broken = df.withColumn("t", F.when(F.col("k") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("t")))
    with pytest.raises(Exception):
        files.publish_batch(broken, at, "three", kind)
    rows = files.read_published(spark, at, "k long, t string").collect()
    assert sorted((r["batch"], r["k"]) for r in rows) == [("one", 1), ("one", 2), ("two", 1)]
    listed = {r["batch"]: r for r in files.manifests(spark, at).collect()}
    assert set(listed) == {"one", "two"} and listed["one"]["rows"] == 2 and listed["one"]["columns"] == ["k", "t"]
    assert all(r["folder"].startswith("export_2") for r in listed.values())
    df.limit(1).write.mode("append").option("header", "true").format(kind).save(f"{at}/data/{listed['one']['folder']}")
    with pytest.raises(ValueError, match="one"):
        files.read_published(spark, at, "k long, t string")


FREE = {
    "3 March 2011": (2011, 3, 3), "3-mar-11": (2011, 3, 3), "March 3, 2011": (2011, 3, 3), "03.02.2011": (2011, 2, 3), "3/2/11": (2011, 2, 3), "13/2/2011": (2011, 2, 13), "2/13/2011": (2011, 2, 13),
    "2011/3/2": (2011, 2, 3), "2011/13/2": (2011, 2, 13), "2011 Mar 3": (2011, 3, 3), "Thu, 3 Mar 2011 10:11:12": (2011, 3, 3), "3 Mar 2011 4:05 PM": (2011, 3, 3), "31/2/2011": None, "30 Feb 2011": None,
    "abc": None, "3 de marzo de 2011": (2011, 3, 3), "1st May 2010": (2010, 5, 1), "2011-03-04T10:00:00": (2011, 4, 3), "31-12-68": (2068, 12, 31), "31-12-69": (1969, 12, 31), "": None, None: None,
    "12/25/99": (1999, 12, 25), "1 2 3 4": None, "5 Xyz 2011": None, "3 Sept 2012": (2012, 9, 3), "2012-02-29": (2012, 2, 29) and None, "29/02/2011": None, "15 agosto 2009": (2009, 8, 15),
}


def test_free_dates_day_first(spark):
    df = spark.createDataFrame([(t,) for t in FREE], "t string").select("t", day_first(F.col("t")).alias("d"), registry_date(F.col("t")).alias("r"))
    for r in df.collect():
        if r["t"] == "2012-02-29":
            assert r["r"] == date(2012, 2, 29)  # a form of its own comes before the free ones
        else:
            assert r["d"] == (date(*FREE[r["t"]]) if FREE[r["t"]] else None), r["t"]
    assert [r[0] for r in spark.createDataFrame([("40000",), ("99999999999",)], "t string").select(registry_date(F.col("t"))).collect()] == [date(2009, 7, 6), None]


def test_registries_come_to_one_schema(spark):
    states = spark.createDataFrame([("1", "Norte"), ("2", "Sur")], "state string, state_name string")
    regions = spark.createDataFrame([("1", "11", "Río"), ("2", "21", "Río")], "state string, region string, region_name string")
    raw = spark.createDataFrame([(" a 1", "norte", None, "rÃ­o", "3/4/2005", "-", "12.5", "Severe", "x"), ("b", "Sur", "2", "Río", None, "2005-04-09", "s/d", "x", "light")], "`Clave Única` string, Estado string, CVE string, Municipio string, `Inicio` string, Fin string, Sup string, c1 string, c2 string")
    kinds = {"key": "key", "state": "text", "state_name": "text", "region": "text", "region_name": "text", "begin": "date", "finish": "date", "area": "number"}
    schema = {"key": "string", "state": "int", "region": "int", "begin": "date", "finish": "date", "area": "double", "impact": "string", "cause": "string", "origin": "string"}
    names = {"clave_unica": "key", "estado": "state_name", "cve": "state", "municipio": "region_name", "inicio": "begin", "fin": "finish", "sup": "area"}
    out = registry.historical_registry(raw, names, kinds, {"impact": ("c1", "c2", {"severe": "S", "light": "L"})}, {"origin": "old"}, schema, states, regions)
    assert out.columns == list(schema)
    assert sorted(map(tuple, out.collect())) == [("A1", 1, 11, date(2005, 4, 3), None, 12.5, "S", None, "old"), ("B", 2, 21, None, date(2005, 4, 9), None, "L", None, "old")]
    again = registry.reread_registry(raw.toDF(*names.values(), "c1", "c2"), kinds, schema, states, regions)
    assert [r["region"] for r in again.orderBy("key").collect()] == [11, 21] and again.filter("origin is not null").count() == 0
