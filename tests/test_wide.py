import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conceptmill.functions.xsd import canonical
from conceptmill.operators.wide import Attribute, WideTable
from conceptmill.plans import problems

SAME = {
    "xsd:boolean": [[" true", "1"], ["false", "0\n"]],
    "xsd:integer": [["7", "+7", " 007\t"], ["0", "-0"], ["9223372036854775807"]],
    "xsd:decimal": [["1.50", "+1.5", "01.5"], ["0", "-0.0", ".0"], ["-12.25", " -12.250"], ["123456789012345678901234567890123456789012345.1"]],
    "xsd:double": [["1e3", "1000", "1000.0"], ["NaN"], ["INF", "1e999"], ["-INF"], ["0", "-0"]],
    "xsd:date": [["2020-02-29"], ["2020-02-28Z", "2020-02-28"], ["12020-01-01"], ["2000-01-01+13:00", "1999-12-31-11:00"]],
    "xsd:dateTime": [
        ["2020-02-29T00:00:00Z", "2020-02-28T24:00:00", "2020-02-29T01:00:00.000+01:00"],
        ["2020-01-01T00:00:00.5Z", "2020-01-01T00:00:00.50"],
        ["-0044-03-15T10:00:00"],
    ],
    "xsd:string": [["a"], [" a"], [""]],
}
BAD = {
    "xsd:boolean": ["TRUE", "", "-1", "tru e"],
    "xsd:integer": ["9223372036854775808", "1.0", "", "−9", "5_000", "0x1F", "2e3", "+", "7 8"],
    "xsd:decimal": ["1e2", "", ".", "NaN", "1,5", "71%", "6 . 8"],
    "xsd:double": ["inf", "nan", "Infinity", "1e5f", "71.5E", "--", "1.5 E3", "", "1d"],
    "xsd:date": ["2019-02-29", "20200101", "2020-1-1", "2020-01", "2020-01-01T00:00:00Z", "2020-13-01", "99-01-01", "02020-01-01", "2020-01-01+15:00", "2020-06-31"],
    "xsd:dateTime": ["2020-01-01", "2020-01-01 00:00:00", "2020-01-01T00:00", "2020-01-01T24:00:01", "2020-01-01T23:60:00", "2019-02-29T00:00:00", "1601891600", "2020-01-01T00:00:00.Z"],
}


@pytest.mark.parametrize("datatype", SAME)
def test_values(spark, datatype):
    texts = [t for g in SAME[datatype] for t in g] + BAD.get(datatype, [])
    got = dict(tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical(F.col("t"), datatype)).collect())
    for t in BAD.get(datatype, []):
        assert got[t] is None, t
    classes = [{got[t] for t in g} for g in SAME[datatype]]
    assert all(len(c) == 1 and None not in c for c in classes), classes
    assert len({next(iter(c)) for c in classes}) == len(classes)


ATTRS = [
    Attribute("p:n", "n", "xsd:integer", True), Attribute("p:d", "d", "xsd:decimal", True), Attribute("p:t", "t", "xsd:dateTime", True),
    Attribute("p:day", "day", "xsd:date", True), Attribute("p:b", "b", "xsd:boolean", True), Attribute("p:x", "x", "xsd:double", True),
    Attribute("p:s", "s_", "xsd:string", True), Attribute("p:m", "m", "xsd:string", False),
]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_wide(spark, block):
    rows = [
        ("a", "p:n", "7"), ("a", "p:n", "+7"), ("a", "p:d", "1.50"), ("a", "p:t", "2020-01-01T00:00:00+01:00"), ("a", "p:day", "2020-02-03 "),
        ("a", "p:b", "1"), ("a", "p:x", "1e2"), ("a", "p:s", "x"), ("a", "p:m", "2"), ("a", "p:m", "1"), ("a", "p:m", "1"),
        ("b", "p:n", "x"), ("b", "p:n", "1"), ("b", "p:s", "u"), ("b", "p:s", "U"), ("b", "p:other", "1"),
        ("c", "rdf:type", "skos:Concept"), ("d", "rdf:type", "other"), (None, "p:n", "1"), ("e", "p:n", None), ("e", None, "1"),
        *[("f", "p:m", f"v{i}") for i in range(9)],
    ]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "s string, p string, o string, v string, block int")
    w = WideTable(df, ATTRS, block=block, max_values=5)
    got = {r["s"]: r.asDict() for r in w.wide().collect()}
    assert set(got) == {"a", "b", "c", "f"}
    a = got["a"]
    assert (a["n"], a["d"], a["b"], a["x"], a["s_"], a["m"], a["unfit"]) == (7, Decimal("1.5"), True, 100.0, "x", ["1", "2"], [])
    assert a["t"] == dt.datetime(2019, 12, 31, 23) and a["day"] == dt.date(2020, 2, 3)
    assert sorted(got["b"]["unfit"]) == ["p:n", "p:s"] and got["b"]["n"] is None and got["b"]["m"] == []
    assert got["c"]["m"] == [] and got["c"]["unfit"] == []
    assert got["f"]["m"] is None and got["f"]["long_cells"] == ["p:m"]
    assert sorted(r["v"] for r in w.long_values().collect()) == [f"v{i}" for i in range(9)]
    assert sorted(tuple(r) for r in w.unfit().collect()) == [("b", "p:n"), ("b", "p:s")]


def test_blocks_are_joined_without_a_shuffle(spark):
    df = spark.createDataFrame([("a", "p:n", "7"), ("a", "p:m", "7")], "s string, p string, o string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = WideTable(df, ATTRS, block=2).wide()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], "s string, p string, o string")
    assert WideTable(df, ATTRS).wide().collect() == []


@pytest.fixture
def folder(spark, tmp_path):
    """One concept with a cell of 10 001 values and one of 2."""
    rows = [("g", "a", "skos:altLabel", f"v{i}") for i in range(10_001)] + [("g", "b", "skos:altLabel", x) for x in "xyy"] + [("other", "b", "skos:altLabel", "z")]
    rows += [("g", "a", "tam:tariff", "1" * 21), ("g", "b", "tam:tariff", "2.50")]
    spark.createDataFrame(rows, "g string, s string, p string, o string").write.parquet(f"{tmp_path}/quads.parquet")
    spark.createDataFrame([("g", "vocabulary"), ("other", "candidate")], "g string, kind string").write.parquet(f"{tmp_path}/graphs.parquet")
    columns = [("skos:altLabel", "alt_labels", "xsd:string", False), ("tam:tariff", "tariff", "xsd:decimal", True)]
    spark.createDataFrame(columns, "p string, column_name string, datatype string, single_valued boolean").write.parquet(f"{tmp_path}/wide_columns.parquet")
    return str(tmp_path)


def test_values_beyond_their_type_are_named(spark):
    """Dates keep the day that is written; what a column cannot hold, or not exactly, is named and not unfit."""
    rows = [
        ("zoned", "p:day", "2020-01-01+05:00", dt.date(2020, 1, 1), False), ("same", "p:day", "2000-01-01+13:00", dt.date(1999, 12, 31), False), ("same", "p:day", "1999-12-31-11:00", dt.date(1999, 12, 31), False),
        ("large", "p:d", "123456789012345678901234", None, True), ("fine", "p:d", "0.1234567890123456789", Decimal("0.123456789012345679"), True), ("late", "p:day", "10000-01-01", None, True),
        ("nano", "p:t", "2020-01-01T00:00:00.1234567Z", dt.datetime(2020, 1, 1, 0, 0, 0, 123456), True), ("year 0", "p:day", "0000-01-01", None, True),
        ("first", "p:day", "0001-01-01Z", dt.date(1, 1, 1), False), ("last", "p:t", "9999-12-31T23:59:59Z", dt.datetime(9999, 12, 31, 23, 59, 59), False),
    ]
    w = WideTable(spark.createDataFrame([r[:3] for r in rows], "s string, p string, o string"), ATTRS)
    got = {r["s"]: r.asDict() for r in w.wide().collect()}
    column = {a.p: a.column for a in ATTRS}
    for s, p, _, want, lost in rows:
        assert (got[s][column[p]], got[s]["unfit"], got[s]["inexact"]) == (want, [], [p] if lost else [])


def test_two_thousand_attributes(spark):
    """One plan over all blocks."""
    attrs = [Attribute(f"p:{i:04}", f"c{i:04}", ("xsd:integer", "xsd:date", "xsd:string")[i % 3], i % 10 != 9) for i in range(2000)]
    rows = [(f"s{i % 7}", f"p:{i:04}", str(i)) for i in range(0, 2000, 3)] + [("s1", "p:1999", "x"), ("s1", "p:1999", "y"), ("s2", "p:0000", "none")]
    w = WideTable(spark.createDataFrame(rows, "s string, p string, o string"), attrs)
    assert len(w._blocks) <= 32
    got = {r["s"]: r.asDict() for r in w.wide().collect()}
    assert len(got) == 7 and got["s1"]["c1999"] == ["x", "y"] and got["s2"]["unfit"] == ["p:0000"]
    for i in range(0, 2000, 3):
        assert got[f"s{i % 7}"][f"c{i:04}"] == ([str(i)] if i % 10 == 9 else i)


def test_long_cells_have_a_query(spark, folder):
    wide = {r["s"]: r for r in problems.wide_table(spark, folder).wide().collect()}
    assert wide["a"]["alt_labels"] is None and wide["a"]["long_cells"] == ["skos:altLabel"] and wide["b"]["alt_labels"] == ["x", "y"]
    got = [tuple(r) for r in problems.QUERIES["p5_long_values"](spark, folder).collect()]
    assert sorted(got) == sorted(("a", "skos:altLabel", f"v{i}") for i in range(10_001))


def test_values_that_cannot_be_typed_have_a_query(spark, folder):
    wide = {r["s"]: r for r in problems.wide_table(spark, folder).wide().collect()}
    assert wide["a"]["tariff"] is None and wide["a"]["unfit"] == [] and wide["b"]["tariff"] == Decimal("2.5")
    assert [tuple(r) for r in problems.QUERIES["p5_untyped"](spark, folder).collect()] == [("a", "tam:tariff", "1" * 21)]
    rows = [
        ("big", "p:d", "1" * 20 + "." + "1" * 18, False), ("small", "p:d", "0." + "1" * 19, True), ("zeros", "p:d", "0.1" + "0" * 30, False), ("neg", "p:d", "-" + "9" * 21, True),
        ("bce", "p:t", "-0044-03-15T10:00:00", True), ("far", "p:day", "12020-01-01", True), ("farther", "p:day", "1" * 14 + "-01-01", True), ("day", "p:day", "9999-12-31", False),
        ("nano", "p:t", "2020-01-01T00:00:00.1234567Z", True), ("micro", "p:t", "2020-01-01T00:00:00.123456Z", False), ("inf", "p:x", "INF", False), ("nan", "p:x", "NaN", False),
        ("n", "p:n", "-9223372036854775808", False), ("no", "p:b", "0", False), ("empty", "p:s", "", False), ("bad", "p:d", "x", False), ("m", "p:m", "v", False),
    ]
    w = WideTable(spark.createDataFrame([r[:3] for r in rows], "s string, p string, o string"), ATTRS)
    assert {(r["s"], r["p"]) for r in w.untyped().collect()} == {r[:2] for r in rows if r[3]}
