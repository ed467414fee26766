import pytest

from conceptmill.operators.edits import Edit, Editor, EditRefused
from conceptmill.operators.hierarchy import ClosureTooLarge, Hierarchy
from conceptmill.operators.minting import MintRefused, agreed
from conceptmill.operators.store import Store, StoreRefused
from conceptmill.sources import rdf

G = "urn:g"
ST = "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string"


def links(spark, *rows):
    typed = {x for s, _, o in rows for x in (s, o)}
    return spark.createDataFrame([(G, *r, "iri", None, "") for r in rows] + [(G, x, "rdf:type", "skos:Concept", "iri", None, "") for x in sorted(typed)], ST)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create_graph(G)
    return s


@pytest.mark.parametrize(
    "syntax, text", [("ntriples", "<urn:a> <urn:b> .\n"), ("turtle", "<urn:a> <urn:b> ."), ("trig", "<urn:g> { <urn:a> }"), ("rdfxml", "<rdf:RDF"), ("jsonld", "{")]
)
def test_imports(spark, store, tmp_path, syntax, text):
    (tmp_path / "bad").write_text(text)
    with pytest.raises(StoreRefused) as e:
        store.propose_import(G, str(tmp_path / "bad"), syntax)
    assert e.value.code == "ImportSyntax"
    with pytest.raises(StoreRefused) as e:
        store.propose_retraction(G, str(tmp_path / "missing"), syntax)
    assert e.value.code == "ImportRead" and store.candidates().isEmpty()


def test_restore_and_export(spark, store, tmp_path):
    new = Store(spark, str(tmp_path / "new"))
    (tmp_path / "bad.nq").write_text("no quads\n")
    for name, code in (("bad.nq", "RestoreSyntax"), ("missing.nq", "RestoreRead")):
        with pytest.raises(StoreRefused) as e:
            new.restore(str(tmp_path / name))
        assert e.value.code == code
    with pytest.raises(StoreRefused, match="Export"):
        store.export(G, str(tmp_path / "store"), "ntriples")  # the folder exists
    assert new.graphs().isEmpty()


def test_candidates(spark, store):
    none = spark.createDataFrame([], ST)
    with pytest.raises(StoreRefused, match="CandidateEmpty"):
        store.propose_edit(G, Edit(none, none))
    for row in ((G, "urn:s", "iri", None, "urn:o", "iri", None, ""), (G, "a text", "literal", "urn:p", "urn:o", "iri", None, ""), (G, "urn:s", "iri", "_:p", "urn:o", "iri", None, "")):
        with pytest.raises(StoreRefused, match="CandidateStatementInvalid"):
            store.propose_statements(G, spark.createDataFrame([row], rdf.SCHEMA))


def test_bounds_of_edits(spark):
    rows = [(f"c{i}", "skos:broader", f"c{i + 1}") for i in range(6)] + [("x", "skos:broader", "y")]
    ed = Editor(links(spark, *rows), G)
    with pytest.raises(EditRefused, match="SubtreeTooLarge"):
        ed.move("c4", "y", max_subtree=3)
    assert ed.move("c4", "y", max_subtree=4).report["moved_with_it"] == 4
    with pytest.raises(EditRefused, match="HierarchyTooLarge"):
        ed.merge("c0", "x", max_hierarchy=2)
    with pytest.raises(EditRefused, match="WouldCycle"):
        ed.merge("c0", "c4", max_hierarchy=10)
    assert ed.merge("c0", "x", max_hierarchy=10).additions.count() == 1
    for edit in (lambda n: ed.deprecate("c0", max_scan=n), lambda n: ed.reinstate("c0", max_scan=n)):
        with pytest.raises(EditRefused, match="ScanTruncated"):
            edit(15)
    assert ed.deprecate("c0", max_scan=16).additions.count() == 1


@pytest.mark.parametrize(
    "nodes, code", [([], "NoConcepts"), (["_:a", "_:b"], "NoIris"), (["urn:x/a", "urn:y/b"], "NoMajority")]
)
def test_conventions(spark, nodes, code):
    classes = spark.createDataFrame([(G, n, "skos:Concept", "asserted") for n in nodes] + [("urn:h", "urn:z/1", "skos:Concept", "asserted")], "g string, node string, class string, origin string")
    with pytest.raises(MintRefused, match=code):
        agreed(classes, G)
    assert agreed(classes, "urn:h").placeholder == "n"


def test_closure_size(spark):
    rows = [(G, "a", "b"), (G, "b", "a"), (G, "b", "top"), (G, "leaf", "a"), ("h", "x", "y"), ("h", "s", "s")]
    h = Hierarchy(spark.createDataFrame(rows, "g string, child string, parent string"))
    assert {tuple(r) for r in h.closure_size().collect()} == {(G, 4 + 2 + 2 + 1), ("h", 2)}
    with pytest.raises(ClosureTooLarge):
        h.closure_size(10)


def test_split_of_a_concept_with_more_links_than_the_bound(spark):
    rows = [(f"k{i}", "skos:broader", "c") for i in range(5)] + [("c", "skos:broader", "p1"), ("p2", "skos:narrower", "c"), ("c", "skos:broadMatch", "p3"), ("c", "skos:broader", "_:p4"), ("_:p4", "skos:narrower", "c")]
    said = [(G, "c", "skos:inScheme", f"s{i}", "iri", None, "") for i in range(4)] + [(G, f"t{i}", "skos:hasTopConcept", "c", "iri", None, "") for i in range(3)]
    said += [(G, f"n{i}", "skos:prefLabel", "One", "literal", "en", "rdf:langString") for i in range(3)] + [(G, "c", "skos:prefLabel", "C", "literal", "en", "rdf:langString")]
    ed = lambda n: Editor(links(spark, *rows).unionByName(spark.createDataFrame(said, ST)), G, list_bound=n)
    parts = [("x1", "One"), ("x2", "Two")]
    few, many = ed(2).split("c", parts), ed(100).split("c", parts)
    for got in (few, many):
        r = got.report
        assert r["unapportioned"]["narrower"] == [f"k{i}" for i in range(5)] and r["unapportioned"]["related"] == [] and r["parents"] == ["_:p4", "p1", "p2", "p3"]
        assert r["already_called"] == ["n0", "n1", "n2"] and r["schemes"] == ["s0", "s1", "s2", "s3", "t0", "t1", "t2"] and r["top_concept_of"] == ["t0", "t1", "t2"]
        links_ = sorted((x["s"], x["p"], x["o"], x["o_kind"]) for x in got.additions.collect() if "x1" in (x["s"], x["o"]))
        want = [("x1", "skos:broader", p, "bnode" if p[0] == "_" else "iri") for p in ("_:p4", "p1", "p3")] + [(p, "skos:narrower", "x1", "iri") for p in ("_:p4", "p2")]
        want += [("x1", "skos:inScheme", s, "iri") for s in r["schemes"]] + [("x1", "skos:topConceptOf", s, "iri") for s in ("t0", "t1", "t2")]
        want += [("x1", "rdf:type", "skos:Concept", "iri"), ("x1", "skos:prefLabel", "One", "literal"), ("x1", "prov:wasDerivedFrom", "c", "iri")]
        assert links_ == sorted(want) and got.additions.count() == 2 * len(want)
    below = few.report["unapportioned"]["narrower"]
    assert len(below) == 5 and "k3" in below and "p1" not in below and below[-1] == "k4" and below[3:0:-2] == ["k3", "k1"] and below[5:] == [] and below != ["k0"]
    with pytest.raises(IndexError):
        below[5]
    assert len(ed(2).split("c", parts, "below").report["unapportioned"]["narrower"]) == 5


def test_deprecation_strands_more_than_the_bound(spark):
    rows = [(f"k{i}", "skos:broader", "c") for i in range(5)] + [("c", "skos:broader", f"p{i}") for i in range(3)] + [("c", "skos:related", f"r{i}") for i in range(3)]
    rows += [(f"l{i}", "skos:member", "c") for i in range(3)] + [(f"t{i}", "skos:hasTopConcept", "c") for i in range(3)] + [("c", "dcterms:isReplacedBy", f"n{i}") for i in range(3)]
    ed = Editor(links(spark, *rows), G, list_bound=2)
    got = ed.deprecate("c", "n1")
    left = got.report["stranded"]
    assert got.additions.count() == 1 and got.report["replacement"] is None and left["incoming"] == 11 and left["mapped_to"] == 0
    for name, letter, n in (("narrower", "k", 5), ("broader", "p", 3), ("related", "r", 3), ("collections", "l", 3), ("top_concept_of", "t", 3)):
        assert left[name] == [f"{letter}{i}" for i in range(n)]
    with pytest.raises(EditRefused, match="AlreadyReplaced: n0, n1, n2"):
        ed.deprecate("c", "k1")
