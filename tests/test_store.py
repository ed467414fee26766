import pytest
from pyspark.sql import functions as F

from conceptmill.operators.edits import Editor, EditRefused, applied
from conceptmill.operators.store import FORMAT, Store, StoreRefused, migrate, parse_stamp
from conceptmill.plans import catalog
from conceptmill.sources import rdf

G = "urn:v"
TTL = """@prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix : <http://ex.org/> .
:a a skos:Concept ; skos:prefLabel "A"@en , "日本 \\"q\\" 🎈"@ja ; skos:narrower :b ; skos:note [ skos:example "x\\ny" ] .
:b a skos:Concept ; skos:notation 7 , 1.5 , 2e3 , true ; skos:prefLabel '''long
text''' .
:l skos:memberList ( :a :b ) .
"""
XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xml:base="http://ex.org/">
<skos:Concept rdf:about="a"><skos:prefLabel xml:lang="en">A &amp; B</skos:prefLabel><skos:broader rdf:resource="b"/><skos:note><rdf:Description><skos:example>x</skos:example></rdf:Description></skos:note></skos:Concept></rdf:RDF>"""
JSON = """{"@context": {"skos": "http://www.w3.org/2004/02/skos/core#", "label": {"@id": "skos:prefLabel", "@language": "en"}, "broader": {"@id": "skos:broader", "@type": "@id"}},
"@id": "http://ex.org/a", "@type": "skos:Concept", "label": "A", "broader": ["http://ex.org/b"], "skos:notation": [7, {"@value": "x", "@type": "http://www.w3.org/2001/XMLSchema#token"}]}"""


def facts(df):
    return {tuple(r[c] for c in ("s", "p", "o", "o_kind", "o_lang", "o_dt")) for r in df.collect()}


def shape(df):
    """Statements with blank nodes blotted out."""
    hide = lambda v, k: "_" if k == "bnode" else v
    return sorted((hide(r["s"], r["s_kind"]), r["p"], hide(r["o"], r["o_kind"]), r["o_kind"], r["o_lang"] or "", r["o_dt"]) for r in df.collect())


@pytest.fixture
def turtle(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(TTL)
    return rdf.read(spark, str(tmp_path / "x.ttl"), "turtle", G)


def test_turtle(turtle):
    got = facts(turtle)
    assert ("http://ex.org/a", "skos:prefLabel", '日本 "q" 🎈', "literal", "ja", "rdf:langString") in got
    assert {x[2:] for x in got if x[1] == "skos:notation"} == {("7", "literal", None, "xsd:integer"), ("1.5", "literal", None, "xsd:decimal"), ("2e3", "literal", None, "xsd:double"), ("true", "literal", None, "xsd:boolean")}
    assert any(x[2] == "long\ntext" for x in got) and any(x[2] == "x\ny" for x in got)
    assert sum(x[1] == "rdf:rest" for x in got) == 2 and ("rdf:nil" in {x[2] for x in got})


@pytest.mark.parametrize("syntax", [x.token for x in rdf.SYNTAXES])
def test_round_trip(spark, turtle, tmp_path, syntax):
    path = str(tmp_path / "out")
    rdf.write(turtle, path, syntax)
    back = rdf.read(spark, path, syntax, None if rdf.syntax_of(syntax).quads else G)
    assert shape(back) == shape(turtle)
    assert {r["g"] for r in back.select("g").distinct().collect()} == {G}


def test_xml_and_json():
    xml = {r[1:] for r in rdf.parse_text(XML, "rdf")}
    assert ("http://ex.org/a", "iri", "skos:prefLabel", "A & B", "literal", "en", "rdf:langString") in xml and ("http://ex.org/a", "iri", "skos:broader", "http://ex.org/b", "iri", None, "") in xml
    js = {r[1:] for r in rdf.parse_text(JSON, "application/ld+json")}
    assert ("http://ex.org/a", "iri", "skos:prefLabel", "A", "literal", "en", "rdf:langString") in js and ("http://ex.org/a", "iri", "skos:notation", "x", "literal", None, "xsd:token") in js


def test_lines(spark):
    ok = ['<urn:a> <urn:p> "x\\u00e9\\U0001F388\\t"^^<urn:d> <urn:g> .', "_:b <urn:p> <urn:o> . # note", "# only a note", "", '<urn:a> <urn:p> "y"@en-GB .']
    got = {tuple(r) for r in rdf.read_lines(spark.createDataFrame([(x,) for x in ok], "value string"), "d").collect()}
    assert got == {("urn:g", "urn:a", "iri", "urn:p", "xé🎈\t", "literal", None, "urn:d"), ("d", "_:b", "bnode", "urn:p", "urn:o", "iri", None, ""), ("d", "urn:a", "iri", "urn:p", "y", "literal", "en-GB", "rdf:langString")}
    with pytest.raises(Exception, match="malformed line"):
        rdf.read_lines(spark.createDataFrame([("<urn:a> <urn:p> .",)], "value string")).collect()


@pytest.mark.parametrize("text", ["<urn:a> <urn:b> .", "x:a x:b x:c .", "<urn:a> <urn:b> 'x"])
def test_refused_text(text):
    with pytest.raises(rdf.SyntaxRefused):
        rdf.parse_text(text, "turtle")


def test_negotiation():
    assert rdf.negotiate("text/turtle;q=0.5, application/ld+json") == "application/ld+json"
    assert rdf.negotiate("*/*") == "text/turtle" and rdf.negotiate("image/png") is None
    assert rdf.negotiate("text/*;q=0.2, application/n-quads;q=0.1") == "text/turtle"


def test_store(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(TTL)
    s = Store(spark, str(tmp_path / "store"))
    s.create_graph(G)
    with pytest.raises(StoreRefused, match="GraphExists"):
        s.create_graph(G)
    with pytest.raises(StoreRefused, match="NotWritable"):
        s.create_graph("urn:s", "system")
    assert s.scan(G).count() == 0
    with pytest.raises(StoreRefused, match="NoSuchGraph"):
        s.scan("urn:none")
    with pytest.raises(StoreRefused, match="CandidateProvenance"):
        s.propose_import(G, str(tmp_path / "x.ttl"), "turtle", confidence=2.0)
    one = s.propose_import(G, str(tmp_path / "x.ttl"), "turtle")
    assert s.scan(G).count() == 0 and s.candidate(one)["additions"] == 17
    s.decide(one, True, "me")
    with pytest.raises(StoreRefused, match="CandidateDecided"):
        s.decide(one, False, "me")
    assert s.scan(G).count() == 17
    (tmp_path / "gone.nt").write_text('<http://ex.org/a> <http://www.w3.org/2004/02/skos/core#prefLabel> "A"@en .\n')
    (tmp_path / "never.nt").write_text("<http://ex.org/a> <urn:p> <urn:q> .\n")
    with pytest.raises(StoreRefused, match="RetractionNotPresent"):
        s.propose_retraction(G, str(tmp_path / "never.nt"), "ntriples")
    two, three = (s.propose_retraction(G, str(tmp_path / "gone.nt"), "ntriples") for _ in range(2))
    assert [two, three] == [2, 3]
    s.decide(two, True, "me")
    with pytest.raises(StoreRefused, match="CandidateStale"):
        s.decide(three, True, "me")
    assert s.candidate(three)["state"] == "proposed" and s.scan(G).count() == 16
    s.decide(three, False, "me")
    with pytest.raises(StoreRefused, match="PolicyRejected"):
        s.record_policy(G, "http://ex.org/{x}")
    s.record_policy(G, "http://ex.org/{n}")
    with pytest.raises(StoreRefused, match="JustificationRejected"):
        s.justify([{"target": G, "created": "urn:n", "because": " ", "considered": ["urn:o"]}])
    s.justify([{"target": G, "created": "urn:n", "because": "other sense", "considered": ["urn:o"], "candidate": one}])
    assert s.justifications(G).collect()[0]["fate"] == "approved"
    again = Store(spark, str(tmp_path / "store"))
    assert again.scan(G).count() == 16 and [r["state"] for r in again.candidates().orderBy("id").collect()] == ["approved", "approved", "rejected"]
    again.backup(str(tmp_path / "backup"))
    with pytest.raises(Exception, match="(?i)exists"):
        again.backup(str(tmp_path / "backup"))
    new = Store(spark, str(tmp_path / "new"))
    new.restore(str(tmp_path / "backup"))
    assert shape(new.scan(G)) == shape(again.scan(G)) and new.policy(G) == "http://ex.org/{n}" and new.candidate(2)["removals"] == 1
    assert new.staged(2)[1].count() == 1
    with pytest.raises(StoreRefused, match="RestoreNotEmpty"):
        new.restore(str(tmp_path / "backup"))
    (tmp_path / "other.nq").write_text("<urn:a> <urn:b> <urn:c> <urn:g> .\n")
    with pytest.raises(StoreRefused, match="NotABackup"):
        Store(spark, str(tmp_path / "third")).restore(str(tmp_path / "other.nq"))


def test_migrations():
    got = migrate({"format": 1, "graphs": {}})
    assert got["format"] == FORMAT and got["policies"] == {} and len(got["history"]) == FORMAT - 1
    with pytest.raises(StoreRefused, match="FormatTooNew"):
        migrate({"format": FORMAT + 1})
    with pytest.raises(StoreRefused, match="NoTimeZone"):
        parse_stamp("2024-01-01T00:00:00")


# -- edits -------------------------------------------------------------------------------------------


def graph(spark, *rows):
    out = []
    for s, p, o, *lang in rows:
        lit = bool(lang)
        out.append((G, s, p, o, "literal" if lit else "iri", lang[0] if lit else None, "" if not lit else lang[1] if len(lang) > 1 else "rdf:langString" if lang[0] else "xsd:string"))
    return spark.createDataFrame(out, "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string")


def types(*names):
    return [(n, "rdf:type", "skos:Concept") for n in names]


def said(df):
    return {(r["s"], r["p"], r["o"]) for r in df.collect()}


def test_move(spark):
    g = graph(spark, *types("a", "b", "c", "d", "e"), ("b", "skos:broader", "a"), ("a", "skos:narrower", "b"), ("c", "skos:broader", "b"), ("e", "skos:broader", "a"), ("e", "skos:broader", "d"))
    ed = Editor(g, G)
    got = ed.move("b", "d")
    assert said(got.additions) == {("b", "skos:broader", "d"), ("d", "skos:narrower", "b")} and said(got.removals) == {("b", "skos:broader", "a"), ("a", "skos:narrower", "b")} and got.report["moved_with_it"] == 1
    for args, code in (
        (("z", "a"), "NoSuchConcept"), (("b", "z"), "NoSuchParent"), (("b", "b"), "IntoItself"), (("b", "a"), "AlreadyThere"), (("e", "b"), "AmbiguousParent"),
        (("b", "d", "c"), "NotAParent"), (("a", "b"), "NoBroaderConcept"), (("b", "c"), "IntoItsOwnDescendant"),
    ):
        with pytest.raises(EditRefused) as e:
            ed.move(*args)
        assert e.value.code == code


def test_merge(spark):
    g = graph(
        spark, *types("s", "t", "k", "top"), ("s", "skos:prefLabel", "One", "en"), ("t", "skos:prefLabel", "Two", "EN"), ("s", "skos:prefLabel", "Un", "fr"), ("s", "skos:prefLabel", "Autre", "fr"),
        ("s", "skos:altLabel", "Two", "en"), ("k", "skos:broader", "s"), ("s", "skos:related", "t"), ("x", "urn:p", "s"), ("s", "skos:altLabel", "Un", "fr"), ("s", "skos:broader", "top"), ("t", "skos:broader", "top"),
    )
    got = Editor(g, G).merge("s", "t")
    assert said(got.additions) == {
        ("t", "skos:altLabel", "One"), ("t", "skos:prefLabel", "Autre"), ("t", "skos:altLabel", "Un"), ("k", "skos:broader", "t"), ("x", "urn:p", "t"),
    }
    assert got.report["self_links"] == 1 and got.report["demotions"] == 1 and got.removals.count() == 10
    after = applied(g, got.additions, got.removals)
    assert after.filter((F.col("s") == "s") | (F.col("o") == "s")).count() == 0
    chain = graph(spark, *types("a", "b", "c"), ("a", "skos:broader", "b"), ("b", "skos:broader", "c"))
    with pytest.raises(EditRefused, match="WouldCycle"):
        Editor(chain, G).merge("a", "c")


def test_split(spark):
    g = graph(spark, *types("c", "p", "k"), ("c", "skos:broader", "p"), ("k", "skos:broader", "c"), ("c", "skos:prefLabel", "C", "en"), ("c", "skos:inScheme", "sch"))
    ed = Editor(g, G)
    got = ed.split("c", [("n1", "One"), ("n2", "Two")])
    assert ("n1", "skos:broader", "p") in said(got.additions) and ("n2", "skos:inScheme", "sch") in said(got.additions) and got.report["unapportioned"]["narrower"] == ["k"] and got.report["language"] == "en"
    assert ("n1", "skos:broader", "c") in said(ed.split("c", [("n1", "One"), ("n2", "Two")], "below").additions)
    for parts, code in (([("n", "x")], "TooFewParts"), ([("c", "x"), ("n", "y")], "PartIsTheConcept"), ([("n", "x"), ("n", "y")], "RepeatedPartIri"), ([("n", "x"), ("m", "x")], "RepeatedPartLabel"), ([("n", " "), ("m", "x")], "UnusableLabel"), ([("p", "x"), ("m", "y")], "PartIriInUse")):
        with pytest.raises(EditRefused) as e:
            ed.split("c", parts)
        assert e.value.code == code


def test_retire_and_return(spark):
    g = graph(spark, *types("c", "n", "k"), ("k", "skos:broader", "c"), ("c", "skos:prefLabel", "C", "en"))
    got = Editor(g, G).deprecate("c", "n", "old")
    assert said(got.additions) == {("c", "owl:deprecated", "true"), ("c", "dcterms:isReplacedBy", "n"), ("c", "skos:changeNote", "old")} and got.report["stranded"]["narrower"] == ["k"]
    retired = applied(g, got.additions, got.removals)
    ed = Editor(retired, G)
    for args, code in ((("c",), "AlreadyDeprecated"), (("c", "k"), "AlreadyReplaced"), (("n", "c"), "ReplacementDeprecated"), (("n", "n"), "ReplacementIsTheConcept"), (("k", None, " "), "EmptyNote")):
        with pytest.raises(EditRefused) as e:
            ed.deprecate(*args)
        assert e.value.code == code
    back = ed.reinstate("c")
    assert said(back.removals) == {("c", "owl:deprecated", "true"), ("c", "dcterms:isReplacedBy", "n")} and back.report["kept_notes"] == 1
    with pytest.raises(EditRefused, match="NotRetired"):
        ed.reinstate("k")


def test_nquads_roundtrip_shows_datatypes(spark, tmp_path):
    """Statements that differ in their datatype only stay apart; what N-Quads cannot say comes back as it reads."""
    rows = [("xsd:integer", None), ("xsd:string", None), ("", None), ("rdf:langString", None), ("rdf:langString", "en"), ("xsd:decimal", "")]
    schema = "g string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dt string"
    spark.createDataFrame([("urn:g", "x", "bnode", "skos:notation", "7", "literal", lang, dt) for dt, lang in rows], schema).write.parquet(f"{tmp_path}/quads.parquet")
    got = sorted((r["s"], r["s_kind"], r["o_lang"], r["o_dt"]) for r in catalog.QUERIES["a8_nquads_statements"](spark, str(tmp_path)).collect())
    assert got == [("x", "bnode", *x) for x in [("", "xsd:decimal"), ("", "xsd:integer"), ("", "xsd:string"), ("en", "rdf:langString")]]


def test_large_documents_are_parsed_as_they_are_read():
    from itertools import islice

    from conceptmill.sources.rdf import SyntaxRefused, iter_text

    turtle = "@prefix e: <urn:e:> .\n" + "".join(f'e:s{i} e:p "v{i}", e:o ; e:q [ e:r ( 1 2 ) ] .\n' for i in range(2000))
    rows = iter_text(turtle + "this is no Turtle", "turtle")
    assert [r[1] for r in islice(rows, 2)] == ["urn:e:s0", "urn:e:s0"]
    with pytest.raises(SyntaxRefused):
        list(rows)
    assert len(list(iter_text(turtle, "turtle"))) == 2000 * 8
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    xml = f'<?xml version="1.0" encoding="iso-8859-1"?><rdf:RDF xmlns:rdf="{rdf}" xmlns:e="urn:e:">' + "".join(f'<rdf:Description rdf:about="urn:s{i}"><e:p>é{i}</e:p></rdf:Description>' for i in range(2000))
    rows = iter_text(xml + "</rdf:RDF", "rdfxml")
    assert [(r[1], r[4]) for r in islice(rows, 2)] == [("urn:s0", "é0"), ("urn:s1", "é1")]
    with pytest.raises(SyntaxRefused):
        list(rows)
    assert len(list(iter_text(xml + "</rdf:RDF>", "rdfxml"))) == 2000
