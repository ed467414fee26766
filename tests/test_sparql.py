import json

import pytest

from conceptmill.plans.algebra import answers, run, serialise
from conceptmill.plans.sparql import QueryRefused, parse

C, L = "skos:Concept", "skos:prefLabel"
ROWS = [
    ("g1", "x:a", "rdf:type", C), ("g1", "x:b", "rdf:type", C), ("g1", "x:c", "rdf:type", C), ("g2", "x:a", "rdf:type", C), ("g2", "x:d", "rdf:type", C),
    ("g1", "x:b", "skos:broader", "x:a"), ("g1", "x:c", "skos:broader", "x:b"), ("g1", "x:d", "skos:broader", "x:c"), ("g1", "x:a", "skos:related", "x:c"),
    ("g1", "x:a", L, "Alpha", "en", "rdf:langString"), ("g1", "x:b", L, "beta", "en", "rdf:langString"), ("g1", "x:b", L, "Bêta", "fr", "rdf:langString"), ("g1", "x:c", L, "gamma", None, "xsd:string"),
    ("g1", "x:a", "x:n", "7", None, "xsd:integer"), ("g1", "x:b", "x:n", "3.5", None, "xsd:decimal"), ("g1", "x:c", "x:n", "many", None, "xsd:integer"), ("g1", "x:d", "x:n", "1e1", None, "xsd:double"),
    ("g1", "x:a", "x:t", "2020-01-01T00:00:00Z", None, "xsd:dateTime"), ("g1", "x:b", "x:t", "2020-01-01T00:30:00+01:00", None, "xsd:dateTime"),
    ("g1", "x:loop", "skos:broader", "x:pool"), ("g1", "x:pool", "skos:broader", "x:loop"),
]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(r[0], r[1], "iri", r[2], r[3], "literal" if len(r) > 4 else "iri", r[4] if len(r) > 4 else None, r[5] if len(r) > 4 else "") for r in ROWS]
    return spark.createDataFrame(rows * 2, "g string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dt string").cache()


def ask(data, text, order=False):
    _, df = run(data, "PREFIX x: <x:> " + text)
    out = [tuple(None if v is None else v["v"] for v in r) for r in df.collect()]
    return out if order else sorted(out, key=str)


SELECTS = {
    "SELECT ?s { ?s a skos:Concept }": [("x:a",), ("x:b",), ("x:c",), ("x:d",)],
    "SELECT ?s ?l { ?s a skos:Concept ; skos:prefLabel ?l . FILTER(lang(?l) = 'en') }": [("x:a", "Alpha"), ("x:b", "beta")],
    "SELECT ?s { ?s skos:prefLabel 'beta'@en }": [("x:b",)],
    "SELECT ?s { ?s a skos:Concept FILTER NOT EXISTS { ?s skos:broader ?p } }": [("x:a",)],
    "SELECT ?s { ?s a skos:Concept FILTER EXISTS { ?s skos:broader ?p FILTER(?p = x:b) } }": [("x:c",)],
    "SELECT ?s { ?s a skos:Concept FILTER(EXISTS { ?s skos:broader ?p } || ?s = x:a) }": [("x:a",), ("x:b",), ("x:c",), ("x:d",)],
    "SELECT ?s ?l { ?s a skos:Concept OPTIONAL { ?s skos:prefLabel ?l FILTER(lang(?l) = 'fr') } }": [("x:a", None), ("x:b", "Bêta"), ("x:c", None), ("x:d", None)],
    "SELECT ?s ?m { ?s a skos:Concept OPTIONAL { ?s skos:related ?m } OPTIONAL { ?s skos:broader ?m } }": [("x:a", "x:c"), ("x:b", "x:a"), ("x:c", "x:b"), ("x:d", "x:c")],
    "SELECT ?x { { ?x skos:broader x:a } UNION { ?x skos:broader x:b } }": [("x:b",), ("x:c",)],
    "SELECT ?s { ?s a skos:Concept MINUS { ?s skos:broader ?p } }": [("x:a",)],
    "SELECT ?s { ?s a skos:Concept MINUS { ?y skos:broader ?p } }": [("x:a",), ("x:b",), ("x:c",), ("x:d",)],
    "SELECT ?g ?s { GRAPH ?g { ?s a skos:Concept } FILTER(?g = <g2>) }": [("g2", "x:a"), ("g2", "x:d")],
    "SELECT ?s FROM <g2> { ?s a skos:Concept }": [("x:a",), ("x:d",)],
    "SELECT ?s FROM NAMED <g2> { GRAPH ?g { ?s a skos:Concept } }": [("x:a",), ("x:d",)],
    "SELECT ?x { x:d skos:broader+ ?x }": [("x:a",), ("x:b",), ("x:c",)],
    "SELECT ?x { ?x skos:broader* x:b }": [("x:b",), ("x:c",), ("x:d",)],
    "SELECT ?x { x:d skos:broader/skos:broader ?x }": [("x:b",)],
    "SELECT ?x { x:a ^skos:broader|skos:related ?x }": [("x:b",), ("x:c",)],
    "SELECT ?x { x:a !(rdf:type|skos:prefLabel|x:n|x:t) ?x }": [("x:c",)],
    "SELECT ?x { x:d skos:broader? ?x }": [("x:c",), ("x:d",)],
    "SELECT ?x { ?x skos:broader+ ?x }": [("x:loop",), ("x:pool",)],
    "SELECT ?s { VALUES ?s { x:b x:z } ?s a skos:Concept }": [("x:b",)],
    "SELECT ?s ?p { VALUES (?s ?p) { (x:b UNDEF) (UNDEF x:b) } ?s skos:broader ?p }": [("x:b", "x:a"), ("x:c", "x:b")],
    "SELECT ?s { ?s x:n ?n FILTER(?n > 3) }": [("x:a",), ("x:b",), ("x:d",)],
    "SELECT ?s ?m { ?s x:n ?n BIND(?n * 2 + 1 AS ?m) }": [("x:a", "15"), ("x:b", "8"), ("x:c", None), ("x:d", "21.0")],
    "SELECT ?s { ?s x:n ?n FILTER(!isNumeric(?n)) }": [("x:c",)],
    "SELECT ?s { ?s x:t ?t FILTER(?t < '2020-01-01T00:00:00Z'^^xsd:dateTime) }": [("x:b",)],
    "SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?sum) { ?s x:n ?v FILTER(isNumeric(?v)) }": [("3", "20.5")],
    "SELECT ?p (COUNT(DISTINCT ?s) AS ?n) { ?s ?p ?o } GROUP BY ?p HAVING(COUNT(DISTINCT ?s) > 4)": [("skos:broader", "5")],
    "SELECT (GROUP_CONCAT(?l; separator='|') AS ?all) { ?s skos:prefLabel ?l }": [("Alpha|Bêta|beta|gamma",)],
    "SELECT (MIN(?n) AS ?a) (MAX(?n) AS ?b) { ?s x:n ?n FILTER(isNumeric(?n)) }": [("3.5", "1e1")],
    "SELECT ?u { ?s skos:prefLabel ?l BIND(UCASE(SUBSTR(STR(?l), 2, 3)) AS ?u) FILTER(STRLEN(?l) = 5) }": [("AMM",), ("LPH",)],
    "SELECT ?s { ?s skos:prefLabel ?l FILTER(REGEX(?l, '^B', 'i') && LANGMATCHES(LANG(?l), '*')) }": [("x:b",), ("x:b",)],
    "SELECT DISTINCT ?x { ?s skos:prefLabel ?l BIND(IF(CONTAINS(?l, 'a'), 'yes', 'no') AS ?x) }": [("yes",)],
    "SELECT (STRBEFORE('a-b', '-') AS ?x) (STRAFTER('a-b', '-') AS ?y) (CONCAT('a', 'b') AS ?z) (REPLACE('abc', 'b', 'x') AS ?r) (xsd:integer('7') + 1 AS ?i) {}": [("a", "b", "ab", "axc", "8")],
    "SELECT (COALESCE(?nope, 'd') AS ?x) (MD5('a') AS ?m) (ENCODE_FOR_URI('a b') AS ?e) (YEAR('2020-05-06T01:02:03Z'^^xsd:dateTime) AS ?y) (ROUND(2.5) AS ?r) {}": [("d", "0cc175b9c0f1b6a831c399e269772661", "a%20b", "2020", "3")],
    "SELECT ?s ?n { ?s a skos:Concept { SELECT ?s (COUNT(?l) AS ?n) { ?s skos:prefLabel ?l } GROUP BY ?s } }": [("x:a", "1"), ("x:b", "2"), ("x:c", "1")],
    "SELECT ?s { ?s x:n 07 }": [],
    "SELECT ?a ?b { ?a skos:broader ?b . ?b skos:broader ?a }": [("x:loop", "x:pool"), ("x:pool", "x:loop")],
    "SELECT ?s { ?s skos:prefLabel ?l FILTER(?l IN ('gamma', 'Alpha'@en)) }": [("x:a",), ("x:c",)],
    "SELECT ?s { ?s skos:broader ?o FILTER(datatype(?o) = xsd:string) }": [],
}


@pytest.mark.parametrize("text", SELECTS)
def test_select(data, text):
    assert ask(data, text) == sorted(SELECTS[text], key=str)


def test_order(data):
    assert ask(data, "SELECT ?n { ?s x:n ?n } ORDER BY ?n", True) == [("many",), ("3.5",), ("7",), ("1e1",)]
    assert ask(data, "SELECT ?s { ?s a skos:Concept } ORDER BY DESC(?s) LIMIT 2 OFFSET 1", True) == [("x:c",), ("x:b",)]
    assert ask(data, "SELECT ?s ?l { ?s a skos:Concept OPTIONAL { ?s skos:related ?l } } ORDER BY ?l ?s LIMIT 2", True) == [("x:b", None), ("x:c", None)]


def test_other_forms(data):
    form, df = run(data, "ASK { <x:a> skos:broader ?x }")
    assert form == "ask" and df.collect()[0][0] is False
    form, df = run(data, "CONSTRUCT { ?b skos:narrower ?a . ?a <x:via> [ <x:is> ?b ] } WHERE { ?a skos:broader ?b }")
    rows = df.collect()
    assert form == "construct" and len(rows) == 15 and sum(r["p"] == "skos:narrower" for r in rows) == 5 and len({r["s"] for r in rows if r["s_kind"] == "bnode"}) == 5
    form, df = run(data, "DESCRIBE <x:d>")
    assert form == "describe" and {(r["p"], r["o"]) for r in df.collect()} == {("rdf:type", C), ("skos:broader", "x:c"), ("x:n", "1e1")}


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT ?s {", "QuerySyntax"), ("INSERT DATA { <a> <b> <c> }", "QueryIsUpdate"), ("PREFIX x: <x:> DELETE WHERE { ?s ?p ?o }", "QueryIsUpdate"), ("SELECT * { SERVICE <http://x> { ?s ?p ?o } }", "QueryNeedsFederation"),
        ("SELECT ?s { ?s nope:x ?o }", "QuerySyntax"), ("SELECT ?s { ?s ?p ?o BIND(1 AS ?o) }", "QuerySyntax"), ("hello", "QuerySyntax"),
    ],
)
def test_refusals(text, code):
    with pytest.raises(QueryRefused) as e:
        parse(text)
    assert e.value.code == code


def test_cap_and_formats(data):
    form, df = run(data, "SELECT ?s ?l { ?s skos:prefLabel ?l } ORDER BY ?s ?l")
    with pytest.raises(QueryRefused, match="QueryTooLarge"):
        answers(df, cap=3)
    assert len(answers(df, cap=4)) == 4
    got = json.loads(serialise(form, df))
    assert got["head"]["vars"] == ["s", "l"] and {"type": "literal", "value": "Bêta", "xml:lang": "fr"} in [b["l"] for b in got["results"]["bindings"]]
    assert serialise(form, df, "csv").splitlines()[:2] == ["s,l", "x:a,Alpha"]
    assert '<x:a>\t"Alpha"@en' in serialise(form, df, "tsv") and '<literal xml:lang="fr">' in serialise(form, df, "xml")
    assert json.loads(serialise(*run(data, "ASK {}")))["boolean"] is True


def test_deadline(spark, data):
    _, df = run(data, "SELECT * { ?a ?b ?c . ?d ?e ?f . ?g ?h ?i . ?j ?k ?l . ?m ?n ?o . ?p ?q ?r . ?s ?t ?u . ?v ?w ?x FILTER(CONCAT(STR(?c), STR(?f), STR(?u), STR(?x), STR(?o)) = 'x') }")
    with pytest.raises(QueryRefused, match="QueryTimedOut"):
        answers(df, seconds=0.5)
