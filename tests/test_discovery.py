import pytest
from pyspark.sql import functions as F

from conceptmill.operators import discovery, search

ST = "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string"
ASKED = "query_id long, text string, match_mode string, lang_range string, kinds string, max_hits int"


def label(g, s, text, p="skos:prefLabel"):
    return (g, s, p, text, "literal", "en", "rdf:langString")


@pytest.fixture
def local(spark):
    vocabularies = spark.createDataFrame([label("home", "h", "Red stone"), label("v", "a", "Stone"), label("v", "b", "stone", "skos:altLabel"), label("v", "c", "Stonework")], ST)
    proposed = spark.createDataFrame([label("change/additions", "n", "stone age")], ST)
    return discovery.LocalSource("here", vocabularies, proposed, "home")


def asked(spark, *texts):
    return spark.createDataFrame([(i, t, "infix", None, None, None) for i, t in enumerate(texts)], ASKED)


class Broken:
    name = "far"

    def __init__(self, what):
        self.what = what

    def answer(self, queries):
        if self.what == "error":
            raise discovery.Unavailable("no answer\nwith a second line")
        spark = queries.sparkSession
        if self.what == "late":  # fails when it is read
            bad = queries.select("query_id", F.raise_error(F.lit("lost")).cast("string").alias("g"))
            return bad.selectExpr("query_id", "g", "g as node", "g as text", "g as lang", "0 as q", "0 as k", "false as home", "false as pending"), spark.createDataFrame([("x", 1)], "searched string, labels_read long")
        other = spark.createDataFrame([(99, "g", "n", "t", "en", 0, 0, False, False)], "query_id long, g string, node string, text string, lang string, q int, k int, home boolean, pending boolean")
        return other, spark.createDataFrame([("x", 1)], "searched string, labels_read long")


def test_local(spark, local):
    best, told = discovery.discover([local], asked(spark, "stone", "nothing", ""), max_matches=3)
    got = [(r["query_id"], r["node"], r["quality"], r["home"], r["pending"], r["place"]) for r in best.orderBy("query_id", "place").collect()]
    assert got == [(0, "a", "exact", False, False, 1), (0, "b", "exact", False, False, 2), (0, "c", "prefix", False, False, 3)]
    rows = {r["query_id"]: r for r in told.collect()}
    assert set(rows) == {0, 1}  # the empty label is refused and not put to anyone
    assert (rows[0]["matched"], rows[0]["listed"], rows[0]["labels_read"], rows[0]["searched"]) == (5, 3, 5, "2 vocabularies and 1 proposed changes")
    assert (rows[1]["matched"], rows[1]["outcome"]) == (0, "answered")
    everything, _ = discovery.discover([local], asked(spark, "stone"))
    assert [r["node"] for r in everything.filter("home or pending").orderBy("place").collect()] == ["n", "h"]


@pytest.mark.parametrize("what", ["error", "late", "other"])
def test_a_source_that_fails_is_told_and_stops_nothing(spark, local, what):
    best, told = discovery.discover([Broken(what), local], asked(spark, "stone", "red"))
    assert best.filter("source = 'here'").count() == 6 and best.filter("source = 'far'").isEmpty()
    off = told.filter("source = 'far'").collect()
    assert len(off) == 2 and all(r["outcome"] == "unavailable" and r["reason"] and "\n" not in r["reason"] and r["matched"] == 0 for r in off)
    far, here = discovery.consulted(told).collect()
    assert (far["source"], far["outcome"], far["labels_read"]) == ("far", "unavailable", 0)
    assert (here["source"], here["outcome"], here["matched"], here["labels_read"]) == ("here", "answered", 6, 10)


def test_unavailable_for_one_label_is_unavailable(spark):
    told = spark.createDataFrame(
        [(0, 0, "s", "answered", None, 3, 3, "all", 9), (1, 0, "s", "unavailable", "gone", 0, 0, None, 0)],
        "query_id long, asked int, source string, outcome string, reason string, matched long, listed long, searched string, labels_read long",
    )
    assert [tuple(r) for r in discovery.consulted(told).collect()] == [("s", "unavailable", "gone", 0, None, 0)]


def test_nothing_asked_or_no_sources(spark, local):
    for sources, texts in (([local], []), ([], ["stone"]), ([Broken("error")], [])):
        best, told = discovery.discover(sources, asked(spark, *texts) if texts else spark.createDataFrame([], ASKED))
        assert best.collect() == [] and told.collect() == [] and discovery.consulted(told).collect() == []


def test_best_hits_of_a_hot_question(spark, monkeypatch):
    """Ranking in parts gives the order of ranking at once."""
    hits = spark.createDataFrame([(i % 2, f"g{i % 3}", f"n{i:03}", f"t{(i * 37) % 101:03}", 5) for i in range(400)], "query_id int, g string, node string, text string, most int")
    order = [F.col("text"), F.col("node")]
    for parts in (1, 32):
        monkeypatch.setattr(search, "_SPLITS", parts)
        got = [tuple(r) for r in search.foremost(hits, "query_id", "most", order).select("query_id", "text", "node", "place").orderBy("query_id", "place").collect()]
        want = [(q, t, n, i + 1) for q in (0, 1) for i, (t, n) in enumerate(sorted((f"t{(i * 37) % 101:03}", f"n{i:03}") for i in range(400) if i % 2 == q)[:5])]
        assert got == want
