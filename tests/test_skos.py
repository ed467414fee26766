"""Rules, conditions, walks and search on small graphs; shapes after the examples of the SKOS Reference."""

import pytest
from pyspark.sql import functions as F

from conceptmill.operators import minting, search, walks
from conceptmill.operators.integrity import Integrity, newly_violated
from conceptmill.operators.skos import CoreModel
from conceptmill.vocabulary import CONDITIONS, RULES, SEVERITY

SCHEMA = "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string"


def graph(spark, *rows):
    out = []
    for s, p, o, *lit in rows:
        p = p if ":" in p else f"skos:{p}"
        if not lit:
            out.append(("g", s, p, o, "iri", None, ""))
        else:
            tag = lit[0]
            out.append(("g", s, p, o, "literal", tag, lit[1] if len(lit) > 1 else "rdf:langString" if tag else "xsd:string"))
    return spark.createDataFrame(out, SCHEMA)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_top_concepts_and_schemes(spark):
    m = CoreModel(graph(spark, ("a", "topConceptOf", "sch"), ("sch2", "hasTopConcept", "b"), ("b", "topConceptOf", "sch2")))
    assert rows(m.top_concepts, "concept", "scheme", "of_origin", "has_origin") == {("a", "sch", "asserted", "S8"), ("b", "sch2", "asserted", "asserted")}
    assert rows(m.in_scheme, "node", "scheme", "origin") == {("a", "sch", "S7"), ("b", "sch2", "S7")}
    assert rows(m.classes, "node", "class", "origin") == {("a", "skos:Concept", "S6"), ("sch", "skos:ConceptScheme", "S5"), ("b", "skos:Concept", "S6"), ("sch2", "skos:ConceptScheme", "S5")}


def test_collections_and_lists(spark):
    lists = [
        ("c", "memberList", "l1"), ("l1", "rdf:first", "a"), ("l1", "rdf:rest", "l2"), ("l2", "rdf:first", "b"), ("l2", "rdf:rest", "rdf:nil"), ("c", "member", "a"),
        ("bad", "memberList", "k1"), ("k1", "rdf:first", "a"), ("k1", "rdf:rest", "k1"), ("two", "memberList", "rdf:nil"), ("two", "memberList", "z"), ("br", "memberList", "r"), ("r", "rdf:first", "a"),
        ("r", "rdf:rest", "rdf:nil"), ("r", "rdf:rest", "l1"), ("lit", "memberList", "text", None),
    ]
    m = CoreModel(graph(spark, *lists))
    assert rows(m.members, "collection", "member", "origin") == {("c", "a", "asserted"), ("c", "b", "S36")}
    assert {(r["node"], r["defect"]) for r in m.member_lists.collect()} == {("c", None), ("bad", "cyclic"), ("two", None), ("two", "no first"), ("br", "branches"), ("lit", "not a node")}
    got = rows(m.classes.filter("node = 'c'"), "class", "origin")
    assert got == {("skos:OrderedCollection", "S33"), ("skos:Collection", "S31")}
    assert rows(CoreModel(graph(spark, ("o", "memberList", "rdf:nil"))).classes, "class", "origin") == {("skos:OrderedCollection", "S33"), ("skos:Collection", "S29")}
    assert rows(Integrity(m).lists(), "kind", "node") == {("DefectiveMemberList", "bad"), ("DefectiveMemberList", "two"), ("MultipleMemberLists", "two"), ("DefectiveMemberList", "br"), ("DefectiveMemberList", "lit")}


def test_relations_and_mappings(spark):
    m = CoreModel(graph(spark, ("a", "broader", "b"), ("c", "broadMatch", "d"), ("e", "exactMatch", "f"), ("f", "closeMatch", "e"), ("x", "related", "y"), ("n", "narrowerTransitive", "o")))
    assert rows(m.mappings, "s", "p", "o", "origin") >= {("d", "skos:narrowMatch", "c", "S43"), ("f", "skos:exactMatch", "e", "S44"), ("e", "skos:closeMatch", "f", "S44"), ("f", "skos:closeMatch", "e", "asserted")}
    assert rows(m.relations, "s", "p", "o", "origin") == {
        ("a", "skos:broader", "b", "asserted"), ("b", "skos:narrower", "a", "S25"), ("a", "skos:broaderTransitive", "b", "S22"), ("b", "skos:narrowerTransitive", "a", "S22"),
        ("c", "skos:broader", "d", "S41"), ("d", "skos:narrower", "c", "S41"), ("c", "skos:broaderTransitive", "d", "S22"), ("d", "skos:narrowerTransitive", "c", "S22"),
        ("x", "skos:related", "y", "asserted"), ("y", "skos:related", "x", "S23"), ("n", "skos:narrowerTransitive", "o", "asserted"), ("o", "skos:broaderTransitive", "n", "S26"),
    }
    assert rows(m.classes.filter("node in ('a', 'b', 'e', 'f')"), "node", "origin") == {("a", "S19"), ("b", "S20"), ("f", "S19"), ("e", "S20")}  # closeMatch comes before exactMatch


def test_labels_notes_and_xl(spark):
    m = CoreModel(
        graph(
            spark, ("c", "prefLabel", "A", "EN"), ("c", "altLabel", "B", None), ("c", "skosxl:hiddenLabel", "x"), ("x", "skosxl:literalForm", "H", "en"), ("c", "skosxl:prefLabel", "y"),
            ("y", "skosxl:literalForm", "1", "en"), ("y", "skosxl:literalForm", "2", "en"), ("c", "definition", "d", "en"), ("c", "note", "d", "en"), ("c", "ex:gloss", "g", "en"),
            ("ex:gloss", "rdfs:subPropertyOf", "ex:mid"), ("ex:mid", "rdfs:subPropertyOf", "skos:scopeNote"), ("x", "skosxl:labelRelation", "z"), ("c", "prefLabel", "9", None, "xsd:integer"),
        )
    )
    assert rows(m.labels, "kind", "lang", "text", "origin") == {("preferred", "en", "A", "asserted"), ("alternative", None, "B", "asserted"), ("hidden", "en", "H", "S57")}
    assert rows(m.notes, "kind", "value", "origin") == {("skos:definition", "d", "asserted"), ("skos:note", "d", "asserted"), ("skos:scopeNote", "g", "rdfs7"), ("skos:note", "g", "S17")}
    assert rows(m.label_relations, "s", "o", "origin") == {("x", "z", "asserted"), ("z", "x", "S62")}
    assert rows(m.display_labels, "node", "text") == {("c", "A")}
    i = Integrity(m)
    assert rows(i.literal_forms(), "kind", "node") == {("MultipleLiteralForms", "y"), ("NoLiteralForm", "z")}
    assert rows(i.odd_labels(), "node", "rule") == {("c", "S12")}
    assert rows(i.unread_refinements(), "term", "reaches") == {("ex:gloss", "skos:scopeNote"), ("ex:mid", "skos:scopeNote")}


VIOLATIONS = {
    "S9": [("a", "rdf:type", "skos:Concept"), ("a", "rdf:type", "skos:ConceptScheme")],
    "S13": [("a", "prefLabel", "x", "en"), ("a", "altLabel", "x", "EN")],
    "S14": [("a", "prefLabel", "x", "en"), ("a", "prefLabel", "y", "en")],
    "S27": [("a", "broader", "b"), ("b", "broader", "c"), ("c", "related", "a")],
    "S37": [("a", "rdf:type", "skos:Collection"), ("a", "broader", "b")],
    "S46": [("a", "exactMatch", "b"), ("b", "broadMatch", "a")],
    "S3": [("a", "inScheme", "x", None)],
    "S18": [("a", "broader", "x", None)],
    "S30": [("a", "member", "x", None)],
    "S38": [("a", "closeMatch", "x", None)],
    "S48": [("a", "rdf:type", "skosxl:Label"), ("a", "skosxl:literalForm", "f", None), ("a", "broader", "b")],
    "S49": [("a", "skosxl:literalForm", "n"), ("a", "skosxl:literalForm", "f", None)],
    "S52": [("a", "skosxl:literalForm", "n", None), ("a", "skosxl:literalForm", "f", None)],
    "S53": [("a", "skosxl:prefLabel", "n", None)],
    "S58": [("a", "skosxl:prefLabel", "n"), ("a", "skosxl:altLabel", "n"), ("n", "skosxl:literalForm", "f", None)],
    "S59": [("a", "skosxl:labelRelation", "n", None)],
}


def test_each_condition(spark):
    """Every condition in a graph of its own, all read at once."""
    all_ = None
    for rule, facts in VIOLATIONS.items():
        one = graph(spark, *facts).withColumn("g", F.lit(rule))
        all_ = one if all_ is None else all_.unionByName(one)
    bad = {}
    for g, rule in rows(Integrity(CoreModel(all_)).findings().filter("severity = 'inconsistent'"), "g", "rule"):
        bad.setdefault(g, set()).add(rule)
    # S58's graph dumbs one form down to two kinds of label, which S13 forbids as well
    assert bad == {rule: {rule} | ({"S13"} if rule == "S58" else set()) for rule in VIOLATIONS}


def test_consistent_examples(spark):
    fine = [("a", "broader", "b"), ("b", "broader", "a"), ("c", "related", "c"), ("d", "exactMatch", "e"), ("d", "prefLabel", "x", "en"), ("d", "prefLabel", "x", "fr"), ("d", "altLabel", "z", "en"), ("f", "narrower", "a"), ("sch", "hasTopConcept", "a")]
    i = Integrity(CoreModel(graph(spark, *fine)))
    assert i.findings().count() == 0
    assert rows(i.roll_call(), "verdict") == {("held",)} and i.roll_call().count() == len(CONDITIONS) == 16
    before = i.roll_call()
    after = Integrity(CoreModel(graph(spark, *fine, ("d", "prefLabel", "y", "en")))).roll_call()
    assert rows(newly_violated(before, after), "rule") == {("S14",)}
    unread = Integrity(CoreModel(graph(spark, *fine, ("ex:up", "rdfs:subPropertyOf", "skos:broader")))).roll_call()
    assert rows(unread.filter("verdict = 'unchecked'"), "rule") == {("S9",), ("S18",), ("S27",), ("S37",), ("S48",)}


def test_chain_clash(spark):
    m = CoreModel(graph(spark, ("a", "exactMatch", "b"), ("b", "exactMatch", "c"), ("a", "relatedMatch", "c"), ("a", "closeMatch", "q")))
    i = Integrity(m)
    assert i.exact_match_clashes().count() == 0 and rows(i.exact_chain_clashes(), "node", "detail") == {("a", "c | skos:relatedMatch")}
    assert rows(i.clusters, "lowest", "concept") == {("a", "a"), ("a", "b"), ("a", "c")}


def test_catalogue():
    assert len(RULES) == 54 and len(SEVERITY) == 20 and {c[0] for c in CONDITIONS} <= set(RULES)


# -- walks ---------------------------------------------------------------------------------------------


@pytest.fixture
def tree(spark):
    links = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("r", "e"), ("k", "l"), ("l", "k")]
    return CoreModel(graph(spark, *[(x, "broader", y) for x, y in links], ("x", "broaderTransitive", "a"))).relations


def start(spark, *names):
    return spark.createDataFrame([("g", n) for n in names], "g string, origin string")


def test_walks(spark, tree):
    up, tally = walks.walk(walks.upward(tree), start(spark, "e", "k"))
    assert rows(up, "origin", "node", "pred", "depth") == {("e", "d", "e", 1), ("e", "b", "d", 2), ("e", "c", "d", 2), ("e", "a", "b", 3), ("k", "l", "k", 1), ("k", "k", "l", 2)}
    assert rows(tally, "complete") == {(True,)}
    why = up.select("node", walks.entailed(F.col("path"), "skos:broaderTransitive").alias("why")).filter("node = 'b'").collect()[0]["why"]
    assert why == "e skos:broaderTransitive d, and d skos:broaderTransitive b"
    for rounds in (2, 4):
        fast, _ = walks.walk(walks.upward(tree), start(spark, "e", "k"), rounds=rounds)
        assert rows(fast, "origin", "node", "pred", "depth") == rows(up, "origin", "node", "pred", "depth")
    _, few = walks.walk(walks.upward(tree), start(spark, "e", "k"), max_nodes=2, max_links=100)
    assert rows(few, "origin", "complete") == {("e", False), ("k", True)}
    assert rows(walks.siblings(tree, start(spark, "b")).withColumn("parents", F.array_join("parents", " ")), "origin", "sibling", "parents") == {("b", "c", "a")}
    empty, _ = walks.walk(walks.upward(tree), start(spark))
    assert empty.count() == 0


def test_routes(spark, tree):
    paths, cycles = walks.routes(tree, start(spark, "e", "k", "x", "a"))
    assert {(r["origin"], "".join(r["path"]), "".join("Y" if s else "n" for s in r["stated"])) for r in paths.collect()} == {("e", "edba", "YYY"), ("e", "edca", "YYY"), ("x", "xa", "n"), ("a", "a", "")}
    assert {(r["origin"], "".join(r["cycle"])) for r in cycles.collect()} == {("k", "kl")}
    with pytest.raises(walks.WalkIncomplete):
        walks.routes(tree, start(spark, "e"), max_paths=1)


def test_current(spark, tree):
    gone = spark.createDataFrame([("g", "d"), ("g", "r")], "g string, node string")
    up, _ = walks.walk(walks.upward(tree), start(spark, "e"))
    assert rows(walks.current_ancestors(up, gone), "node") == {("a",), ("b",), ("c",)}
    down, _ = walks.walk(walks.downward(tree), start(spark, "a"))
    assert rows(walks.current_tree(down, gone), "node", "role") == {("b", "kept"), ("c", "kept"), ("d", "route"), ("e", "kept"), ("r", "dropped"), ("x", "kept")}
    paths, _ = walks.routes(tree, start(spark, "e", "b"))
    assert rows(walks.current_routes(paths, gone), "origin", "withheld") == {("e", True), ("b", False)}


def test_retirements(spark):
    g = graph(spark, ("a", "owl:deprecated", "true", None, "xsd:boolean"), ("b", "owl:deprecated", "true", None), ("c", "owl:deprecated", "1", None, "xsd:boolean"), ("d", "dcterms:isReplacedBy", "a"), ("a", "dcterms:isReplacedBy", "a"))
    got = {r["node"]: (r["retired"], r["replaced_by"]) for r in walks.retirements(g).collect()}
    assert got == {"a": (True, []), "b": (True, []), "d": (False, ["a"])}


# -- search ----------------------------------------------------------------------------------------------


@pytest.fixture
def labels(spark):
    data = [("a", "preferred", "en", "Mineral wool"), ("b", "preferred", "en-GB", "mineral"), ("c", "alternative", None, "Mineral oil"), ("d", "hidden", "de", "MINERAL"), ("d", "alternative", "de", "MINERAL"), ("e", "preferred", "fr", "un minéral"), ("f", "preferred", "en", "demineral")]
    return spark.createDataFrame([("g", *r) for r in data], "g string, node string, kind string, lang string, text string")


def test_search(spark, labels):
    hits, counts = search.search(labels, search.LabelQuery("mineral"))
    assert [(r["node"], r["quality"], r["kind"]) for r in hits.collect()] == [("b", "exact", "preferred"), ("d", "exact", "alternative"), ("a", "prefix", "preferred"), ("c", "prefix", "alternative"), ("f", "infix", "preferred")]
    assert tuple(counts.collect()[0]) == (5, 6, 6, 0, 0)
    gone = spark.createDataFrame([("g", "b")], "g string, node string")
    hits, counts = search.search(labels, search.LabelQuery("mineral", mode="prefix", lang_range="en", untagged=True, max_hits=1), gone)
    assert [r["node"] for r in hits.collect()] == ["a"] and tuple(counts.collect()[0]) == (2, 6, 6, 1, 1)
    assert {r["node"] for r in search.search(labels, search.LabelQuery("mineral", lang_range="*"))[0].collect()} == {"a", "b", "d", "f"}
    for bad in ({"text": ""}, {"text": "x", "kinds": ()}, {"text": "x", "lang_range": "en-*"}):
        with pytest.raises(search.SearchRefused):
            search.LabelQuery(**bad)


def test_search_all_is_search_for_each(spark, labels):
    asked = [(1, "mineral", "infix", None, None, None), (2, "MINERAL", "prefix", "en", "preferred", 1), (3, "oi", None, None, None, None), (4, "n", "infix", "*", "preferred,hidden", 2), (5, "", None, None, None, None), (6, "wool", "exact", None, None, 5), (7, "zzz", "infix", "en-*", None, None), (8, "mineral", "infix", None, "none", None), (9, None, None, None, None, None)]
    q = spark.createDataFrame(asked, "query_id long, text string, match_mode string, lang_range string, kinds string, max_hits int")
    got = {}
    for r in search.search_all(labels, q).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["node"], r["text"], r["kind"], r["quality"]))
    for i, text, mode, range_, kinds, most in asked:
        try:
            one = search.LabelQuery(text, mode or "infix", range_, False, tuple(k for k in (kinds or "preferred,alternative,hidden").split(",") if k in search.KINDS), most or 200)
        except search.SearchRefused:
            assert i not in got
            continue
        want = [(r["node"], r["text"], r["kind"], r["quality"]) for r in search.search(labels, one)[0].collect()]
        assert got.get(i, []) == want, i


def test_discovery(spark, labels):
    two = labels.unionByName(labels.filter("node = 'a'").withColumn("g", F.lit("h")))
    got = [(r["g"], r["node"]) for r in search.discover(two, "mineral w", "h").collect()]
    assert got == [("h", "a"), ("g", "a")]


# -- identifiers --------------------------------------------------------------------------------------


def test_slugs(spark):
    want = {"Mineral's Wool, fine!": "minerals-wool-fine", "  --x--  ": "x", "Über ２": "über-２", "!!": None, "’": None, "a" * 100: "a" * 96, ("ab " * 40).strip(): "-".join(["ab"] * 32), "x" * 95 + " yz": "x" * 95}
    got = dict(tuple(r) for r in spark.createDataFrame([(k,) for k in want], "t string").select("t", minting.slug(F.col("t"))).collect())
    assert got == want


def test_minting(spark):
    base = "http://ex.org/c_"
    g = graph(spark, (base + "007", "rdf:type", "skos:Concept"), (base + "12", "rdf:type", "skos:Concept"), ("x", "related", base + "3"), (base + "x9", "prefLabel", base + "99", "en"))
    assert minting.mint(g, minting.Pattern.parse(base + "{n}")) == base + "13"
    padded = graph(spark, (base + "0007", "rdf:type", "skos:Concept"))
    assert minting.mint(padded, minting.Pattern.parse(base + "{n}")) == base + "0008"
    assert minting.mint(g, minting.Pattern.parse("http://ex.org/{slug}"), "Wool & Oil") == "http://ex.org/wool-oil"
    with pytest.raises(minting.MintRefused, match="Taken"):
        minting.mint(g, minting.Pattern.parse("http://ex.org/c_{slug}"), "007")
    for text, code in (("http://ex.org/", "NoPlaceholder"), ("http://ex.org/{n}{n}", "TwoPlaceholders"), ("http://ex.org/{n", "UnclosedPlaceholder"), ("http://ex.org/{x}", "UnknownPlaceholder"), ("http://ex .org/{n}", "NotIriText"), ("ex/{n}", "NoScheme")):
        with pytest.raises(minting.MintRefused, match=code):
            minting.Pattern.parse(text)
    with pytest.raises(minting.MintRefused, match="LabelRequired"):
        minting.mint(g, minting.Pattern.parse("http://ex.org/{slug}"))


def test_convention(spark):
    m = CoreModel(graph(spark, *[(f"http://ex.org/v#c_{i}", "rdf:type", "skos:Concept") for i in range(3)], ("http://ex.org/v#word", "rdf:type", "skos:Concept"), ("http://other/x", "rdf:type", "skos:Concept")))
    r = minting.convention(m.classes).collect()[0]
    assert (r["namespace"], r["n"], r["concepts"], r["pattern"]) == ("http://ex.org/v#", 4, 5, "http://ex.org/v#c_{n}")
    assert minting.chosen(None, None, r["pattern"])[0] == "inferred" and minting.chosen(None, "u:{n}", "v:{n}")[0] == "recorded"
    with pytest.raises(minting.MintRefused):
        minting.chosen(None, "broken", r["pattern"])
