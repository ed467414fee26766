import random

import pytest

from conceptmill.operators import reports, walks
from conceptmill.operators.integrity import Integrity, verdicts
from conceptmill.operators.linked import linked
from conceptmill.operators.skos import CoreModel

ST = "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string"


def model(spark, *rows):
    full = [("g", s, p, o, *(("literal", None, "xsd:string") if kind == "text" else ("iri", None, ""))) for s, p, o, *kind_ in rows for kind in [kind_[0] if kind_ else "iri"]]
    return CoreModel(spark.createDataFrame(full, ST))


def test_linked(spark):
    rnd = random.Random(3)
    links = [(rnd.choice("gh"), f"n{rnd.randrange(60):02}", f"n{rnd.randrange(60):02}") for _ in range(60)] + [("k", f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    links += [("g", None, "x"), ("s", "alone", "alone")]
    group = {}
    for g, a, b in links:
        if a is not None:
            x, y = group.setdefault((g, a), {(g, a)}), group.setdefault((g, b), {(g, b)})
            both = x | y
            for n in both:
                group[n] = both
    want = {(g, min(ms)[1], n) for (g, n), ms in group.items()}
    assert {tuple(r) for r in linked(spark.createDataFrame(links, "g string, a string, b string")).collect()} == want
    assert linked(spark.createDataFrame([], "g string, a string, b string")).collect() == []


def test_member_lists_of_any_length(spark):
    rows = [("c", "skos:memberList", "x000")]
    for i in range(70):
        rows += [(f"x{i:03}", "rdf:first", f"m{i}"), (f"x{i:03}", "rdf:rest", f"x{i + 1:03}" if i < 69 else "rdf:nil")]
    rows += [("d", "skos:memberList", "x060"), ("r", "skos:memberList", "y0")]  # shared cells; a loop entered from outside
    for i in range(5):
        rows += [(f"y{i}", "rdf:first", f"q{i}"), (f"y{i}", "rdf:rest", f"y{i + 1}" if i < 4 else "y2")]
    got = {r["node"]: (r["items"], r["defect"]) for r in model(spark, *rows).member_lists.collect()}
    assert got == {"c": ([f"m{i}" for i in range(70)], None), "d": ([f"m{i}" for i in range(60, 70)], None), "r": ([f"q{i}" for i in range(5)], "cyclic")}


CHAIN = [(f"c{i}", "skos:broader", f"c{i + 1}") for i in range(6)] + [("c0", "skos:related", "c4"), ("c3", "skos:related", "x"), ("c2", "skos:related", "c2")]


@pytest.mark.parametrize(
    "nodes, links, want",
    [
        (100, 1000, {("RelatedAndBroaderTransitive", "c0", "c4")}),
        (3, 1000, {("AncestryBoundReached", "c0", "3"), ("AncestryBoundReached", "c2", "3")}),
        (100, 7, {("RelatedAndBroaderTransitive", "c0", "c4"), ("DisjointnessSweepExhausted", None, "2 | 3 | 7")}),
    ],
)
def test_related_under_bounds(spark, nodes, links, want):
    """Owed in order: c0 (6 links up), c2 (4), c3 (3), c4 (2), x (none)."""
    got = {(r["kind"], r["node"], r["detail"]) for r in Integrity(model(spark, *CHAIN)).related_within(nodes, links).collect()}
    assert {x for x in got if x[0] != "RelatedAndBroaderTransitive" or nodes > 3} == want


def test_bounded_checks_and_verdicts(spark):
    rows = [("a", "skos:exactMatch", "b"), ("b", "skos:exactMatch", "c"), ("a", "skos:broadMatch", "c")]
    i = Integrity(model(spark, *rows))
    assert {(r["kind"], r["node"]) for r in i.exact_chains_within(10, 100).collect()} == {("ExactMatchChainClash", "a")}
    few = i.exact_chains_within(10, 2)
    assert {r["kind"] for r in few.collect()} >= {"ExactMatchSweepExhausted"}
    graphs = spark.createDataFrame([("g",), ("h",)], "g string")
    assert {tuple(r) for r in verdicts(i.findings(), graphs).collect()} == {("g", False, True), ("h", True, True)}
    assert ("g", True, False) in {tuple(r) for r in verdicts(few.filter("severity = 'unchecked'"), graphs).collect()}


def test_preferred_label_in_a_language(spark):
    rows = [("g", "a", "skos:prefLabel", t, "literal", lang, "rdf:langString") for t, lang in (("Zug", "de"), ("Bahn", "DE"), ("train", "en"), ("Zügli", "de-CH"))] + [("g", "b", "skos:prefLabel", "none", "literal", None, "xsd:string")]
    m = CoreModel(spark.createDataFrame(rows, ST))
    assert [tuple(r) for r in m.preferred_in("De").collect()] == [("g", "a", "Bahn")] and [tuple(r) for r in m.preferred_in(None).collect()] == [("g", "b", "none")]
    assert m.preferred_in("fr").collect() == []


def test_notes_of(spark):
    rows = [("a", "skos:definition", "d", "text"), ("a", "my:remark", "r", "text"), ("my:remark", "rdfs:subPropertyOf", "skos:scopeNote"), ("b", "skos:broader", "a"), ("b", "my:other", "z", "text")]
    m = model(spark, *rows)
    at = lambda *names: spark.createDataFrame([("g", n) for n in names], "g string, node string")
    got = {(r["node"], r["kind"], r["value"], r["origin"], r["premise"]) for r in reports.notes_of(m, at("a", "b")).collect()}
    assert got == {
        ("a", "skos:definition", "d", "asserted", None), ("a", "skos:scopeNote", "r", "rdfs7", "my:remark"),
        ("a", "skos:note", "d", "S17", "skos:definition"), ("a", "skos:note", "r", "S17", "my:remark"),
    }
    with pytest.raises(reports.NoSuchResource):
        reports.notes_of(m, at("a", "nobody"))
    assert {tuple(r) for r in reports.unread(m.facts).collect()} == {("g", "my:remark", 1), ("g", "my:other", 1)}


def test_mappings_of(spark):
    m = model(spark, ("a", "skos:exactMatch", "b"), ("b", "skos:exactMatch", "c"), ("a", "skos:broadMatch", "z"))
    start = spark.createDataFrame([("g", "a")], "g string, concept string")
    rows, tally = reports.mappings_of(m, start)
    got = {(r["p"], r["other"], r["origin"], r["also"], r["chain"]) for r in rows.collect()}
    assert got == {
        ("skos:exactMatch", "b", "asserted", None, None), ("skos:closeMatch", "b", "S42", None, None), ("skos:broadMatch", "z", "asserted", "skos:broader", None),
        ("skos:exactMatch", "c", "S45", None, "a > b > c"), ("skos:exactMatch", "a", "S45", None, "a > b > a"),
    }
    assert tally.collect()[0]["complete"] and not reports.mappings_of(m, start, 10, 1)[1].collect()[0]["complete"]


def test_inspect(spark):
    m = model(spark, ("s", "skos:hasTopConcept", "a"), ("b", "skos:broader", "a"), ("a", "skos:prefLabel", "A", "text"), ("b", "owl:deprecated", "true", "text"), ("a", "skos:prefLabel", "B", "text"))
    got = {(r["section"], r["item"]): (r["n"], r["n_inferred"]) for r in reports.inspect(m, walks.retirements(m.facts)).collect()}
    assert got[("classes", "skos:Concept")] == (2, 2) and got[("languages", "concepts without preferred label")] == (1, 0) and got[("languages", "- preferred")] == (2, 0)
    assert got[("relations", "skos:narrower")] == (1, 1) and got[("top concepts", "s")] == (1, 0) and got[("retirements", "without successor")] == (1, 0) and got[("statements", "read")] == (5, 0)
    assert got[("findings", "MultiplePreferredLabels")] == (1, 0)


def test_summits(spark):
    m = model(spark, ("a", "skos:broader", "b"), ("b", "skos:topConceptOf", "s"), ("c", "skos:broader", "d"))
    paths, _ = walks.routes(m.relations, spark.createDataFrame([("g", "a"), ("g", "c")], "g string, origin string"))
    assert {(r["origin"], r["summit"], tuple(r["top_concept_of"])) for r in walks.summits(paths, m.top_concepts).collect()} == {("a", "b", ("s",)), ("c", "d", ())}


def test_above(spark):
    from conceptmill.operators.hierarchy import Hierarchy

    links = [("g", f"n{i}", f"n{i + 1}") for i in range(9)] + [("g", "r1", "r2"), ("g", "r2", "r1"), ("g", "r1", "n0")]
    h = Hierarchy(spark.createDataFrame(links, "g string, child string, parent string"))
    pairs = [("g", a, b) for a in ("r1", "r2", "n0", "n5", "out") for b in ("r1", "r2", "n0", "n5", "n9")]
    got = {tuple(r)[1:] for r in h.above(spark.createDataFrame(pairs, "g string, low string, high string")).collect()}
    up = {"r1": {"r1", "r2", "n0", "n5", "n9"}, "r2": {"r1", "r2", "n0", "n5", "n9"}, "n0": {"n5", "n9"}, "n5": {"n9"}, "out": set()}
    assert got == {(a, b) for a, bs in up.items() for b in bs}
