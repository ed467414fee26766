"""Queries for the store's own operators over the whole statement tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.xsd import canonical
from ..operators import edits, minting, search, walks
from ..operators.integrity import Integrity, newly_violated
from ..operators.skos import CoreModel, language
from ..tables import graphs_of_kind, in_graphs, table
from .algebra import plain, run

#: the graph and the text that single-graph queries ask about
GRAPH = "https://store.tamarel.example/graph/tamarel"
SYSTEM = "https://store.tamarel.example/graph/system"
TEXT = "archive"


def vocabularies(spark: SparkSession, folder: str) -> DataFrame:
    return in_graphs(table(spark, folder, "quads"), table(spark, folder, "graphs"), "vocabulary")


def model(spark: SparkSession, folder: str) -> CoreModel:
    return CoreModel(vocabularies(spark, folder))


def one_graph(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "quads").filter(F.col("g") == GRAPH)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Shared parts of the SQL.  v: statements of vocabularies; n: those with a resource as object.
_V = """v AS MATERIALIZED (SELECT DISTINCT g, s, p, o, o_kind, o_lang, o_dt FROM quads WHERE g IN (SELECT g FROM graphs WHERE kind = 'vocabulary')),
n AS MATERIALIZED (SELECT DISTINCT g, s, p, o FROM v WHERE o_kind <> 'literal')"""
_MAP = f"""{_V},
m0 AS (SELECT g, s, p, o, 0 AS k, 'asserted' AS origin FROM n WHERE p IN ('skos:broadMatch', 'skos:narrowMatch', 'skos:relatedMatch', 'skos:closeMatch', 'skos:exactMatch')),
m1 AS (SELECT * FROM m0 UNION ALL SELECT g, o, CASE p WHEN 'skos:broadMatch' THEN 'skos:narrowMatch' WHEN 'skos:narrowMatch' THEN 'skos:broadMatch' ELSE p END, s, 1,
  CASE WHEN p IN ('skos:broadMatch', 'skos:narrowMatch') THEN 'S43' ELSE 'S44' END FROM m0),
m AS MATERIALIZED (SELECT g, s, p, o, arg_min(origin, k) AS origin FROM (SELECT * FROM m1 UNION ALL SELECT g, s, 'skos:closeMatch', o, 2, 'S42' FROM m1 WHERE p = 'skos:exactMatch') GROUP BY g, s, p, o)"""
_REL = f"""{_MAP},
r0 AS (SELECT g, s, p, o, 0 AS k, 'asserted' AS origin FROM n WHERE p IN ('skos:broader', 'skos:narrower', 'skos:related', 'skos:broaderTransitive', 'skos:narrowerTransitive')
  UNION ALL SELECT g, s, CASE p WHEN 'skos:broadMatch' THEN 'skos:broader' WHEN 'skos:narrowMatch' THEN 'skos:narrower' ELSE 'skos:related' END, o, 1, 'S41' FROM m
  WHERE p IN ('skos:broadMatch', 'skos:narrowMatch', 'skos:relatedMatch')),
r1 AS (SELECT * FROM r0 UNION ALL SELECT g, o, CASE p WHEN 'skos:broader' THEN 'skos:narrower' WHEN 'skos:narrower' THEN 'skos:broader' WHEN 'skos:broaderTransitive' THEN 'skos:narrowerTransitive'
  WHEN 'skos:narrowerTransitive' THEN 'skos:broaderTransitive' ELSE p END, s, 2, CASE WHEN p IN ('skos:broader', 'skos:narrower') THEN 'S25' WHEN p = 'skos:related' THEN 'S23' ELSE 'S26' END FROM r0),
rel AS MATERIALIZED (SELECT g, s, p, o, arg_min(origin, k) AS origin FROM (SELECT * FROM r1 UNION ALL SELECT g, s, p || 'Transitive', o, 3, 'S22' FROM r1 WHERE p IN ('skos:broader', 'skos:narrower'))
  GROUP BY g, s, p, o)"""
_TOP = """top AS (SELECT g, concept, scheme, max(a) AS a, max(b) AS b FROM (SELECT g, s AS concept, o AS scheme, 1 AS a, 0 AS b FROM n WHERE p = 'skos:topConceptOf'
  UNION ALL SELECT g, o, s, 0, 1 FROM n WHERE p = 'skos:hasTopConcept') GROUP BY ALL),
ins AS (SELECT g, node, scheme, arg_min(origin, k) AS origin FROM (SELECT g, s AS node, o AS scheme, 0 AS k, 'asserted' AS origin FROM n WHERE p = 'skos:inScheme'
  UNION ALL SELECT g, concept, scheme, 1, 'S7' FROM top) GROUP BY g, node, scheme)"""
_CLASS = f"""{_V}, {_TOP},
cl AS (SELECT g, s AS node, o AS class, 0 AS k, '' AS place, 'asserted' AS origin FROM n WHERE p = 'rdf:type' AND o IN ('skos:Concept', 'skos:ConceptScheme', 'skos:Collection', 'skos:OrderedCollection', 'skosxl:Label')
  UNION ALL SELECT g, scheme, 'skos:ConceptScheme', 1, '', 'S5' FROM top UNION ALL SELECT g, concept, 'skos:Concept', 1, '', 'S6' FROM top
  UNION ALL SELECT g, scheme, 'skos:ConceptScheme', 2, '', 'S4' FROM ins
  UNION ALL SELECT g, s, 'skos:Collection', 3, '', 'S31' FROM n WHERE p = 'skos:member'
  UNION ALL SELECT g, s, 'skos:OrderedCollection', 4, '', 'S33' FROM n WHERE p = 'skos:memberList'
  UNION ALL SELECT g, s, 'skos:Collection', 5, '', 'S29' FROM n WHERE p = 'skos:memberList' OR (p = 'rdf:type' AND o = 'skos:OrderedCollection')
  UNION ALL SELECT g, unnest([s, o]), 'skos:Concept', 6, unnest([lpad(CAST(i AS VARCHAR), 2, '0') || chr(1) || s || chr(1) || o || chr(1) || '0', lpad(CAST(i AS VARCHAR), 2, '0') || chr(1) || s || chr(1) || o || chr(1) || '1']), unnest(['S19', 'S20'])
    FROM n JOIN (VALUES ('skos:broadMatch', 0), ('skos:narrowMatch', 1), ('skos:relatedMatch', 2), ('skos:closeMatch', 3), ('skos:exactMatch', 4), ('skos:mappingRelation', 5)) t(p, i) USING (p)
  UNION ALL SELECT g, unnest([s, o]), 'skos:Concept', 7, unnest([lpad(CAST(i AS VARCHAR), 2, '0') || chr(1) || s || chr(1) || o || chr(1) || '0', lpad(CAST(i AS VARCHAR), 2, '0') || chr(1) || s || chr(1) || o || chr(1) || '1']), unnest(['S19', 'S20'])
    FROM n JOIN (VALUES ('skos:broader', 0), ('skos:narrower', 1), ('skos:related', 2), ('skos:broaderTransitive', 3), ('skos:narrowerTransitive', 4), ('skos:semanticRelation', 5)) t(p, i) USING (p)
  UNION ALL SELECT g, s, 'skosxl:Label', 8, '', 'S50' FROM v WHERE p = 'skosxl:literalForm'
  UNION ALL SELECT g, o, 'skosxl:Label', 9, '', 'S54' FROM n WHERE p IN ('skosxl:prefLabel', 'skosxl:altLabel', 'skosxl:hiddenLabel')
  UNION ALL SELECT g, unnest([s, o]), 'skosxl:Label', 10, unnest([s || chr(1) || o || chr(1) || '0', s || chr(1) || o || chr(1) || '1']), unnest(['S60', 'S61']) FROM n WHERE p = 'skosxl:labelRelation'),
classes AS MATERIALIZED (SELECT g, node, class, arg_min(origin, (k, place)) AS origin FROM cl GROUP BY g, node, class)"""
_LABEL = f"""{_V},
forms AS (SELECT g, s AS label, count(*) AS n_forms, count(*) FILTER (o_dt IN ('xsd:string', 'rdf:langString')) AS n_plain, min(o) FILTER (o_dt IN ('xsd:string', 'rdf:langString')) AS text,
  min(lang) FILTER (o_dt IN ('xsd:string', 'rdf:langString')) AS lang FROM (SELECT DISTINCT g, s, o, lower(nullif(o_lang, '')) AS lang, o_dt FROM v WHERE p = 'skosxl:literalForm' AND o_kind = 'literal') GROUP BY g, s),
labels AS MATERIALIZED (SELECT g, node, kind, lang, text, arg_min(origin, k) AS origin FROM (
  SELECT g, s AS node, CASE p WHEN 'skos:prefLabel' THEN 'preferred' WHEN 'skos:altLabel' THEN 'alternative' ELSE 'hidden' END AS kind, lower(nullif(o_lang, '')) AS lang, o AS text, 0 AS k, 'asserted' AS origin
    FROM v WHERE p IN ('skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel') AND o_kind = 'literal' AND o_dt IN ('xsd:string', 'rdf:langString')
  UNION ALL SELECT n.g, n.s, CASE p WHEN 'skosxl:prefLabel' THEN 'preferred' WHEN 'skosxl:altLabel' THEN 'alternative' ELSE 'hidden' END, f.lang, f.text, 1,
    CASE p WHEN 'skosxl:prefLabel' THEN 'S55' WHEN 'skosxl:altLabel' THEN 'S56' ELSE 'S57' END
    FROM n JOIN forms f ON n.g = f.g AND n.o = f.label WHERE n_plain = 1 AND p IN ('skosxl:prefLabel', 'skosxl:altLabel', 'skosxl:hiddenLabel')) GROUP BY g, node, kind, lang, text)"""
_RETIRED = """retired AS (SELECT g, s AS node, bool_or(p = 'owl:deprecated') AS retired, count(DISTINCT o) FILTER (p <> 'owl:deprecated') AS n_next FROM v
  WHERE (p = 'owl:deprecated' AND o_kind = 'literal' AND o = 'true' AND o_dt IN ('xsd:boolean', 'xsd:string')) OR (p = 'dcterms:isReplacedBy' AND o_kind <> 'literal' AND o <> s) GROUP BY g, s)"""


# -- A: scans ---------------------------------------------------------------------------------------


@query("a2_graphs", "SELECT g, kind FROM graphs")
def a2_graphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graphs").select("g", "kind").orderBy("g")


@query("a4_graph_scan", f"SELECT DISTINCT s, s_kind, p, o, o_kind, o_lang, o_dt FROM quads WHERE g = '{GRAPH}'")
def a4_graph_scan(spark: SparkSession, folder: str) -> DataFrame:
    return one_graph(spark, folder).select("s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt").distinct()


@query("a5_pattern_scan", "SELECT DISTINCT g, s, o FROM quads WHERE p = 'skos:inScheme' AND o = 'https://store.tamarel.example/scheme/tamarel'")
def a5_pattern_scan(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "quads").filter((F.col("p") == "skos:inScheme") & (F.col("o") == "https://store.tamarel.example/scheme/tamarel")).select("g", "s", "o").distinct()


@query("a6_system_records", f"SELECT s, p, o FROM quads WHERE g = '{SYSTEM}'")
def a6_system_records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "quads").filter(F.col("g") == SYSTEM).select("s", "p", "o")


# -- C: aggregates ----------------------------------------------------------------------------------


@query(
    "c3_label_coverage",
    f"""WITH {_LABEL} SELECT g, lang, count(*) FILTER (kind = 'preferred') AS preferred, count(*) FILTER (kind = 'alternative') AS alternative, count(*) FILTER (kind = 'hidden') AS hidden,
count(DISTINCT node) FILTER (kind = 'preferred') AS with_preferred FROM labels GROUP BY g, lang""",
)
def c3_label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return model(spark, folder).labels.groupBy("g", "lang").agg(
        count("preferred"), count("alternative"), count("hidden"), F.count_distinct(F.when(F.col("kind") == "preferred", F.col("node"))).alias("with_preferred")
    )


_NOTES = f"""{_CLASS},
own AS (SELECT g, s AS node, p AS kind, o, o_kind, lower(nullif(o_lang, '')) AS lang, o_dt, 0 AS k, 'asserted' AS origin FROM v
  WHERE p IN ('skos:note', 'skos:changeNote', 'skos:definition', 'skos:editorialNote', 'skos:example', 'skos:historyNote', 'skos:scopeNote')),
notes AS MATERIALIZED (SELECT g, node, kind, o, o_kind, lang, o_dt, arg_min(origin, k) AS origin FROM (SELECT * FROM own UNION ALL SELECT g, node, 'skos:note', o, o_kind, lang, o_dt, 2, 'S17' FROM own WHERE kind <> 'skos:note')
  GROUP BY g, node, kind, o, o_kind, lang, o_dt)"""


@query(
    "c4_doc_coverage",
    f"""WITH {_NOTES}, c AS (SELECT g, node FROM classes WHERE class = 'skos:Concept'),
k AS (SELECT unnest(['skos:note', 'skos:changeNote', 'skos:definition', 'skos:editorialNote', 'skos:example', 'skos:historyNote', 'skos:scopeNote']) AS kind)
SELECT k.kind, count(DISTINCT (x.g, x.node)) FILTER (x.g IS NOT NULL) AS concepts, count(x.g) AS notes, count(*) FILTER (x.origin = 'S17') AS inferred, count(*) FILTER (x.origin = 'rdfs7') AS refined
FROM k LEFT JOIN (SELECT notes.* FROM notes SEMI JOIN c USING (g, node)) x ON x.kind = k.kind GROUP BY k.kind""",
)
def c4_doc_coverage(spark: SparkSession, folder: str) -> DataFrame:
    from .. import vocabulary as V

    m = model(spark, folder)
    concepts = m.classes.filter(F.col("class") == "skos:Concept").select("g", "node")
    by = m.notes.join(concepts, ["g", "node"], "left_semi").groupBy("kind").agg(
        F.count_distinct("g", "node").alias("concepts"), F.count(F.lit(1)).alias("notes"), F.count_if(F.col("origin") == "S17").alias("inferred"), F.count_if(F.col("origin") == "rdfs7").alias("refined")
    )
    kinds = spark.createDataFrame([(k,) for k in V.NOTES], "kind string")
    return kinds.join(by, "kind", "left").fillna(0)


@query("c5_class_counts", f"WITH {_CLASS} SELECT g, class, count(*) AS n, count(*) FILTER (origin <> 'asserted') AS n_inferred FROM classes GROUP BY g, class")
def c5_class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).classes.groupBy("g", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") != "asserted").alias("n_inferred"))


@query("c6_polyhierarchy", f"WITH {_REL} SELECT g, s, count(*) AS n_parents FROM rel WHERE p = 'skos:broader' GROUP BY g, s HAVING count(*) > 1")
def c6_polyhierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).relations.filter("p = 'skos:broader'").groupBy("g", "s").agg(F.count(F.lit(1)).alias("n_parents")).filter("n_parents > 1")


@query("c7_link_counts", f"WITH {_REL} SELECT g, p, count(*) AS n FROM rel WHERE p IN ('skos:broader', 'skos:broaderTransitive') OR (p = 'skos:related' AND s <= o) GROUP BY g, p")
def c7_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    one_way = F.col("p").isin("skos:broader", "skos:broaderTransitive") | ((F.col("p") == "skos:related") & (F.col("s") <= F.col("o")))
    return model(spark, folder).relations.filter(one_way).groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c8_namespaces",
    f"""WITH {_CLASS}, x AS (SELECT g, nullif(regexp_extract(node, '^(.*#|[^#]*/)([^#/]+)$', 1), '') AS namespace, nullif(regexp_extract(node, '^(.*#|[^#]*/)([^#/]+)$', 2), '') AS l
  FROM classes WHERE class = 'skos:Concept' AND NOT starts_with(node, '_:'))
SELECT g, namespace, CASE WHEN regexp_matches(l, '[0-9]+$') THEN regexp_replace(l, '[0-9]+$', '') END AS fixed, count(*) AS n, count(*) FILTER (regexp_matches(l, '[0-9]+$')) AS n_numbered
FROM x WHERE namespace IS NOT NULL GROUP BY ALL""",
)
def c8_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    return minting.namespaces(model(spark, folder).classes)


@query(
    "c9_mentions",
    """WITH q AS (SELECT DISTINCT g, s, p, o, o_kind, o_lang, o_dt FROM quads)
SELECT node, g, count(*) AS n FROM (SELECT g, s AS node, s, p, o, o_lang, o_dt FROM q UNION SELECT g, o, s, p, o, o_lang, o_dt FROM q WHERE o_kind <> 'literal') GROUP BY node, g""",
)
def c9_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each node is mentioned, by graph.  Each statement sends at most two counts; map-side sums take the heat off hot nodes."""
    q = table(spark, folder, "quads").select("g", "s", "p", "o", "o_kind", "o_lang", "o_dt").distinct()
    both = F.array_distinct(F.when(F.col("o_kind") == "literal", F.array("s")).otherwise(F.array("s", "o")))
    return q.select("g", F.explode(both).alias("node")).groupBy("node", "g").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c12_retirement_backlog",
    f"""WITH {_V}, {_RETIRED} SELECT g, count(*) FILTER (retired) AS retired, count(*) FILTER (retired AND n_next = 0) AS dead_ends, count(*) FILTER (NOT retired AND n_next > 0) AS unmarked FROM retired GROUP BY g""",
)
def c12_retirement_backlog(spark: SparkSession, folder: str) -> DataFrame:
    r = walks.retirements(vocabularies(spark, folder))
    none = F.size("replaced_by") == 0
    return r.groupBy("g").agg(F.count_if("retired").alias("retired"), F.count_if(F.col("retired") & none).alias("dead_ends"), F.count_if(~F.col("retired") & ~none).alias("unmarked"))


# -- D and E: order, sets, scalars -------------------------------------------------------------------


@query(
    "d7_cycle_rotation",
    """WITH c AS (SELECT report_id, g, concepts, CAST(list_position(concepts, list_min(concepts)) AS BIGINT) AS i FROM cycle_reports WHERE concepts IS NOT NULL)
SELECT report_id, g, array_to_string(list_concat(concepts[i:], concepts[:i - 1]), ' > ') AS turned FROM c""",
)
def d7_cycle_rotation(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "cycle_reports").filter("concepts is not null")
    return c.select("report_id", "g", F.array_join(walks.lowest_first(F.col("concepts")), " > ").alias("turned"))


_CAND = "SELECT DISTINCT s, p, o, o_kind, o_lang, o_dt FROM quads WHERE g LIKE 'https://store.tamarel.example/graph/candidate/%/{}'"
_IN_GRAPH = f"SELECT DISTINCT s, p, o, o_kind, o_lang, o_dt FROM quads WHERE g = '{GRAPH}'"


def _candidate(spark: SparkSession, folder: str, half: str) -> DataFrame:
    q = table(spark, folder, "quads").filter(F.col("g").startswith("https://store.tamarel.example/graph/candidate/") & F.col("g").endswith("/" + half))
    return q.select(F.lit(GRAPH).alias("g"), *edits.STATEMENT[1:]).distinct()


@query("d8_graph_as_changed", f"({_IN_GRAPH} EXCEPT {_CAND.format('removals')}) UNION {_CAND.format('additions')}")
def d8_graph_as_changed(spark: SparkSession, folder: str) -> DataFrame:
    return edits.applied(one_graph(spark, folder), _candidate(spark, folder, "additions"), _candidate(spark, folder, "removals")).drop("g")


@query("d9_already_said", f"{_CAND.format('additions')} INTERSECT {_IN_GRAPH}")
def d9_already_said(spark: SparkSession, folder: str) -> DataFrame:
    have, new = one_graph(spark, folder).select(*edits.STATEMENT).distinct(), _candidate(spark, folder, "additions")
    return new.join(have, [new[c].eqNullSafe(have[c]) for c in edits.STATEMENT], "left_semi").drop("g")


@query("k2_retraction_missing", f"{_CAND.format('removals')} EXCEPT {_IN_GRAPH}")
def k2_retraction_missing(spark: SparkSession, folder: str) -> DataFrame:
    have, gone = one_graph(spark, folder).select(*edits.STATEMENT).distinct(), _candidate(spark, folder, "removals")
    return gone.join(have, [gone[c].eqNullSafe(have[c]) for c in edits.STATEMENT], "left_anti").drop("g")


@query(
    "e3_numeric_guard",
    """SELECT p, o_dt, count(*) AS n, count(*) FILTER (regexp_full_match(trim(o, chr(32) || chr(9) || chr(10) || chr(13)), '[+-]?[0-9]+')
  AND TRY_CAST(trim(o, chr(32) || chr(9) || chr(10) || chr(13)) AS BIGINT) IS NOT NULL) AS n_integers FROM quads WHERE o_kind = 'literal' GROUP BY p, o_dt""",
)
def e3_numeric_guard(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quads").filter("o_kind = 'literal'")
    return q.groupBy("p", "o_dt").agg(F.count(F.lit(1)).alias("n"), F.count(canonical(F.col("o"), "xsd:integer")).alias("n_integers"))


@query("e9_lang_range", "SELECT DISTINCT g, s, o FROM quads WHERE p = 'skos:prefLabel' AND (lower(o_lang) = 'de' OR starts_with(lower(o_lang), 'de-'))")
def e9_lang_range(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quads").filter("p = 'skos:prefLabel'")
    return q.filter(search.in_range(language(F.col("o_lang")), F.lit("de"))).select("g", "s", "o").distinct()


@query(
    "e10_slug",
    r"""SELECT DISTINCT s, o, nullif(regexp_replace(regexp_replace(regexp_replace(lower(o), '[''’]', '', 'g'), '[^\p{L}\p{Nd}\p{Nl}\p{No}]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug
FROM quads WHERE p = 'skos:prefLabel'""",
)
def e10_slug(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "quads").filter("p = 'skos:prefLabel'").select("s", "o", minting.slug(F.col("o")).alias("slug")).distinct()


@query("e14_curie", "SELECT g, CASE WHEN starts_with(g, 'https://store.tamarel.example/graph/') THEN 'g:' || substr(g, 37) ELSE g END AS curie FROM graphs")
def e14_curie(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graphs").select("g", minting.curie(F.col("g"), {"g": "https://store.tamarel.example/graph/"}).alias("curie"))


@query(
    "e17_display_label",
    f"""WITH {_LABEL} SELECT g, node, arg_min(text, (CASE kind WHEN 'preferred' THEN 0 ELSE 1 END, coalesce(lang, ''), text)) AS text FROM labels WHERE kind <> 'hidden' GROUP BY g, node""",
)
def e17_display_label(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).display_labels


# -- F: rules ---------------------------------------------------------------------------------------


@query("f2_top_concepts", f"WITH {_V}, {_TOP} SELECT g, concept, scheme, CASE WHEN a = 1 THEN 'asserted' ELSE 'S8' END AS of_origin, CASE WHEN b = 1 THEN 'asserted' ELSE 'S8' END AS has_origin FROM top")
def f2_top_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).top_concepts


@query("f4_in_scheme", f"WITH {_V}, {_TOP} SELECT * FROM ins")
def f4_in_scheme(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).in_scheme


@query("f21_first_rule_wins", f"WITH {_CLASS} SELECT * FROM classes")
def f21_first_rule_wins(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).classes


@query("f8_f9_mapping_closure", f"WITH {_MAP} SELECT * FROM m")
def f8_f9_mapping_closure(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).mappings


@query("f11_f12_relation_closure", f"WITH {_REL} SELECT * FROM rel")
def f11_f12_relation_closure(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).relations


@query("f15_labels", f"WITH {_LABEL} SELECT * FROM labels WHERE origin = 'asserted'")
def f15_labels(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).labels.filter("origin = 'asserted'")


@query("f16_note_lift", f"WITH {_NOTES} SELECT g, node, kind, o AS value, o_kind AS value_kind, lang, o_dt AS datatype, origin FROM notes")
def f16_note_lift(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).notes


@query("f19_literal_forms", f"WITH {_LABEL} SELECT g, label, n_forms, n_plain, CASE WHEN n_plain = 1 THEN text END AS text, CASE WHEN n_plain = 1 THEN lang END AS lang FROM forms")
def f19_literal_forms(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).literal_forms


@query("f20_xl_dumb_down", f"WITH {_LABEL} SELECT * FROM labels WHERE origin <> 'asserted'")
def f20_xl_dumb_down(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).labels.filter("origin <> 'asserted'")


@query(
    "f22_derivations",
    f"""WITH {_REL}, {_TOP} SELECT rule, count(*) AS n FROM (SELECT origin AS rule FROM rel UNION ALL SELECT origin FROM m UNION ALL SELECT origin FROM ins) WHERE rule <> 'asserted' GROUP BY rule""",
)
def f22_derivations(spark: SparkSession, folder: str) -> DataFrame:
    m = model(spark, folder)
    every = m.relations.select("origin").unionAll(m.mappings.select("origin")).unionAll(m.in_scheme.select("origin"))
    return every.filter("origin <> 'asserted'").groupBy(F.col("origin").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


# -- G: walks -----------------------------------------------------------------------------------------

_UP = f"""{_REL}, e AS MATERIALIZED (SELECT DISTINCT g, s AS a, o AS b FROM rel WHERE p = 'skos:broaderTransitive'),
start AS (SELECT DISTINCT w.g, origin FROM walk w JOIN graphs USING (g) WHERE kind = 'vocabulary' AND direction = 'up')"""
_DOWN = _UP.replace("SELECT DISTINCT g, s AS a, o AS b FROM rel", "SELECT DISTINCT g, o AS a, s AS b FROM rel").replace("direction = 'up'", "direction = 'down'")
#: every shortest distance, by keeping the least depth of each pair
_WALK = """w(g, origin, node, depth) USING KEY (g, origin, node) AS (
  SELECT start.g, origin, b, min(1) FROM start JOIN e ON e.g = start.g AND e.a = origin GROUP BY ALL
  UNION SELECT w.g, w.origin, e.b, min(w.depth + 1) FROM w JOIN e ON e.g = w.g AND e.a = w.node
    LEFT JOIN recurring.w AS r ON r.g = w.g AND r.origin = w.origin AND r.node = e.b WHERE r.depth IS NULL OR r.depth > w.depth + 1 GROUP BY ALL)"""


def _origins(spark: SparkSession, folder: str, direction: str) -> DataFrame:
    """Origins of all logged walks in vocabularies."""
    logged = table(spark, folder, "walk").filter(F.col("direction") == direction).select("g", "origin")
    return logged.join(graphs_of_kind(table(spark, folder, "graphs"), "vocabulary"), "g", "left_semi").dropna().distinct()


def _ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return walks.walk(walks.upward(model(spark, folder).relations), _origins(spark, folder, "up"), rounds=4)[0]


def _descendants(spark: SparkSession, folder: str) -> DataFrame:
    return walks.walk(walks.downward(model(spark, folder).relations), _origins(spark, folder, "down"), rounds=4)[0]


@query("g4_ancestors", f"WITH RECURSIVE {_UP}, {_WALK} SELECT g, origin, node, CAST(depth AS INTEGER) AS depth FROM w")
def g4_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return _ancestors(spark, folder).select("g", "origin", "node", "depth")


@query("g5_ancestors_current", f"WITH RECURSIVE {_UP}, {_RETIRED}, {_WALK} SELECT g, origin, node, CAST(depth AS INTEGER) AS depth FROM w WHERE (g, node) NOT IN (SELECT (g, node) FROM retired WHERE retired)")
def g5_ancestors_current(spark: SparkSession, folder: str) -> DataFrame:
    gone = walks.retirements(vocabularies(spark, folder)).filter("retired")
    return walks.current_ancestors(_ancestors(spark, folder), gone).select("g", "origin", "node", "depth")


@query("g7_descendants", f"WITH RECURSIVE {_DOWN}, {_WALK} SELECT g, origin, node, CAST(depth AS INTEGER) AS depth FROM w")
def g7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return _descendants(spark, folder).select("g", "origin", "node", "depth")


@query("g8_tree_current")
def g8_tree_current(spark: SparkSession, folder: str) -> DataFrame:
    gone = walks.retirements(vocabularies(spark, folder)).filter("retired")
    return walks.current_tree(_descendants(spark, folder), gone).groupBy("g", "origin").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("kept", "route", "dropped")])


@query("g6_children", f"WITH {_REL} SELECT g, s AS parent, o AS child, origin FROM rel WHERE p = 'skos:narrower'")
def g6_children(spark: SparkSession, folder: str) -> DataFrame:
    return walks.children(model(spark, folder).relations)


@query(
    "g9_siblings",
    f"""WITH {_UP} SELECT x.g, x.s AS origin, y.o AS sibling, string_agg(DISTINCT x.o, ' ' ORDER BY x.o) AS parents FROM rel x JOIN rel y ON x.g = y.g AND x.o = y.s
JOIN start ON start.g = x.g AND start.origin = x.s WHERE x.p = 'skos:broader' AND y.p = 'skos:narrower' AND y.o <> x.s GROUP BY ALL""",
)
def g9_siblings(spark: SparkSession, folder: str) -> DataFrame:
    return walks.siblings(model(spark, folder).relations, _origins(spark, folder, "up"), joined=" ")


_ROUTES = f"""{_UP}, t AS (SELECT g, origin, origin AS tip, [origin] AS path, false AS loop FROM start
  UNION ALL SELECT t.g, t.origin, e.b, list_append(t.path, e.b), list_contains(t.path, e.b) FROM t JOIN e ON e.g = t.g AND e.a = t.tip WHERE NOT t.loop)"""


@query(
    "g10_routes",
    f"WITH RECURSIVE {_ROUTES} SELECT g, origin, array_to_string(path, ' > ') AS path, tip AS summit FROM t WHERE NOT loop AND (g, tip) NOT IN (SELECT (g, a) FROM e)",
)
def g10_routes(spark: SparkSession, folder: str) -> DataFrame:
    paths, _ = walks.routes(model(spark, folder).relations, _origins(spark, folder, "up"))
    return paths.select("g", "origin", F.array_join("path", " > ").alias("path"), "summit")


@query(
    "g11_cycles",
    f"""WITH RECURSIVE {_ROUTES}, c AS (SELECT g, origin, path[list_position(path, tip):len(path) - 1] AS ring FROM t WHERE loop),
k AS (SELECT *, list_position(ring, list_min(ring)) AS i FROM c) SELECT DISTINCT g, origin, array_to_string(list_concat(ring[i:], ring[:i - 1]), ' > ') AS cycle FROM k""",
)
def g11_cycles(spark: SparkSession, folder: str) -> DataFrame:
    _, cycles = walks.routes(model(spark, folder).relations, _origins(spark, folder, "up"))
    return cycles.select("g", "origin", F.array_join("cycle", " > ").alias("cycle"))


@query(
    "g13_routes_current",
    f"""WITH RECURSIVE {_ROUTES}, {_RETIRED}, z AS (SELECT g, list(node) AS gone FROM retired WHERE retired GROUP BY g),
f AS (SELECT t.g, origin, coalesce(list_has_any(path[2:], gone), false) AS w FROM t LEFT JOIN z USING (g) WHERE NOT loop AND (t.g, tip) NOT IN (SELECT (g, a) FROM e))
SELECT g, origin, count(*) FILTER (NOT w) AS shown, count(*) FILTER (w) AS withheld FROM f GROUP BY g, origin""",
)
def g13_routes_current(spark: SparkSession, folder: str) -> DataFrame:
    gone = walks.retirements(vocabularies(spark, folder)).filter("retired")
    paths, _ = walks.routes(model(spark, folder).relations, _origins(spark, folder, "up"))
    return walks.current_routes(paths, gone).groupBy("g", "origin").agg(F.count_if(~F.col("withheld")).alias("shown"), F.count_if("withheld").alias("withheld"))


@query(
    "g14_exact_clusters",
    f"""WITH RECURSIVE {_MAP}, x AS (SELECT g, s AS concept, s AS node FROM m WHERE p = 'skos:exactMatch' UNION SELECT x.g, concept, o FROM x JOIN m ON m.g = x.g AND m.s = x.node WHERE p = 'skos:exactMatch')
SELECT g, min(node) AS lowest, concept FROM x GROUP BY g, concept""",
)
def g14_exact_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return Integrity(model(spark, folder)).clusters


# -- H: conditions ----------------------------------------------------------------------------------

_FOUND = "g, '{}' AS kind, '{}' AS severity, {} AS rule, {} AS node, {} AS detail"


def _found(kind: str, severity: str, rule: str, node: str, *detail: str) -> str:
    return _FOUND.format(kind, severity, rule, node, " || ' | ' || ".join(f"coalesce(CAST({d} AS VARCHAR), '')" for d in detail) or "''")


def _check(name: str, method: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return getattr(Integrity(model(spark, folder)), method)()

    query(name, sql)(run)


_check(
    "h1_disjoint_classes",
    "disjoint_classes",
    f"""WITH {_CLASS}, d(a, b, r) AS (VALUES ('skos:ConceptScheme', 'skos:Concept', 'S9'), ('skos:Collection', 'skos:Concept', 'S37'), ('skos:Collection', 'skos:ConceptScheme', 'S37'),
  ('skosxl:Label', 'skos:Concept', 'S48'), ('skosxl:Label', 'skos:ConceptScheme', 'S48'), ('skosxl:Label', 'skos:Collection', 'S48'))
SELECT x.{_found("DisjointClasses", "inconsistent", "r", "x.node", "a", "b")} FROM classes x JOIN d ON x.class = a JOIN classes y ON x.g = y.g AND x.node = y.node AND y.class = b""",
)
_check(
    "h2_label_clashes",
    "label_clashes",
    f"WITH {_LABEL} SELECT {_found('LabelPropertiesClash', 'inconsistent', chr(39) + 'S13' + chr(39), 'node', 'lang', 'text', 'ks')} FROM (SELECT g, node, lang, text, string_agg(DISTINCT kind, ',' ORDER BY kind) AS ks FROM labels GROUP BY g, node, lang, text HAVING count(DISTINCT kind) > 1)",
)
_check(
    "h3_several_preferred",
    "several_preferred",
    f"WITH {_LABEL} SELECT {_found('MultiplePreferredLabels', 'inconsistent', chr(39) + 'S14' + chr(39), 'node', 'lang', 'n')} FROM (SELECT g, node, lang, count(*) AS n FROM labels WHERE kind = 'preferred' GROUP BY g, node, lang HAVING count(*) > 1)",
)
_check(
    "h4_related_vs_broader",
    "related_and_broader",
    f"""WITH RECURSIVE {_REL}, e AS MATERIALIZED (SELECT DISTINCT g, s, o FROM rel WHERE p = 'skos:broaderTransitive'), rr AS MATERIALIZED (SELECT DISTINCT g, s, o FROM rel WHERE p = 'skos:related'),
up AS (SELECT g, s, o FROM e WHERE (g, s) IN (SELECT (g, s) FROM rr) UNION SELECT up.g, up.s, e.o FROM up JOIN e ON e.g = up.g AND e.s = up.o)
SELECT {_found("RelatedAndBroaderTransitive", "inconsistent", "'S27'", "s", "o")} FROM rr SEMI JOIN up USING (g, s, o)""",
)
_check(
    "h5_exact_match_clashes",
    "exact_match_clashes",
    f"""WITH {_MAP} SELECT {_found("ExactMatchClash", "inconsistent", "'S46'", "s", "o", "ps")} FROM (SELECT x.g, x.s, x.o, string_agg(DISTINCT y.p, ',' ORDER BY y.p) AS ps FROM m x JOIN m y ON x.g = y.g AND x.s = y.s AND x.o = y.o
  WHERE x.p = 'skos:exactMatch' AND x.s <= x.o AND y.p IN ('skos:broadMatch', 'skos:narrowMatch', 'skos:relatedMatch') GROUP BY x.g, x.s, x.o)""",
)
_check(
    "h6_exact_chain_clashes",
    "exact_chain_clashes",
    f"""WITH RECURSIVE {_MAP}, x AS (SELECT g, s AS a, o AS b FROM m WHERE p = 'skos:exactMatch' UNION SELECT x.g, a, o FROM x JOIN m ON m.g = x.g AND m.s = x.b WHERE p = 'skos:exactMatch')
SELECT {_found("ExactMatchChainClash", "inconsistent", "'S46'", "s", "o", "ps")} FROM (SELECT m.g, s, o, string_agg(DISTINCT p, ',' ORDER BY p) AS ps FROM m JOIN x ON m.g = x.g AND s = a AND o = b
  WHERE s <= o AND p IN ('skos:broadMatch', 'skos:narrowMatch', 'skos:relatedMatch') GROUP BY m.g, s, o) ANTI JOIN (SELECT g, s, o FROM m WHERE p = 'skos:exactMatch') USING (g, s, o)""",
)
_check(
    "h7_literals_as_objects",
    "literals_as_objects",
    f"""WITH {_V} SELECT {_found("LiteralOnObjectProperty", "inconsistent", "CASE WHEN p LIKE 'skosxl:%' THEN 'S53' WHEN p LIKE '%Match' OR p = 'skos:mappingRelation' THEN 'S38' WHEN p LIKE 'skos:member%' THEN 'S30' WHEN p IN ('skos:inScheme', 'skos:hasTopConcept', 'skos:topConceptOf') THEN 'S3' ELSE 'S18' END", "s", "p", "o")}
FROM (SELECT DISTINCT g, s, p, o, o_lang, o_dt FROM v WHERE o_kind = 'literal' AND p IN ('skos:inScheme', 'skos:hasTopConcept', 'skos:topConceptOf', 'skos:semanticRelation', 'skos:broader', 'skos:narrower', 'skos:related', 'skos:broaderTransitive', 'skos:narrowerTransitive',
  'skos:member', 'skos:memberList', 'skos:mappingRelation', 'skos:broadMatch', 'skos:narrowMatch', 'skos:relatedMatch', 'skos:closeMatch', 'skos:exactMatch', 'skosxl:prefLabel', 'skosxl:altLabel', 'skosxl:hiddenLabel'))""",
)
_check("h8_nodes_as_forms", "nodes_as_forms", f"WITH {_V} SELECT {_found('NodeOnDatatypeProperty', 'inconsistent', chr(39) + 'S49' + chr(39), 's', 'p', 'o')} FROM n WHERE p = 'skosxl:literalForm'")
_check(
    "h9_literal_forms",
    "literal_forms",
    f"""WITH {_CLASS}, f AS (SELECT DISTINCT g, s, o, lower(nullif(o_lang, '')) AS lang, o_dt FROM v WHERE p = 'skosxl:literalForm' AND o_kind = 'literal'),
c AS (SELECT x.g, x.node, count(f.o) AS n FROM classes x LEFT JOIN f ON f.g = x.g AND f.s = x.node WHERE class = 'skosxl:Label' GROUP BY x.g, x.node)
SELECT {_found("MultipleLiteralForms", "inconsistent", "'S52'", "node", "n")} FROM c WHERE n > 1 UNION ALL SELECT {_found("NoLiteralForm", "ill-formed", "'S52'", "node")} FROM c WHERE n = 0
UNION ALL SELECT {_found("NonPlainLiteralForm", "ill-formed", "'S51'", "s", "o", "o_dt")} FROM (SELECT DISTINCT g, s, o, o_dt FROM f WHERE o_dt NOT IN ('xsd:string', 'rdf:langString'))""",
)
_check(
    "h10_xl_clashes",
    "xl_clashes",
    f"WITH {_V} SELECT {_found('XlLabelPropertiesClash', 'inconsistent', chr(39) + 'S58' + chr(39), 's', 'o', 'ps')} FROM (SELECT g, s, o, string_agg(DISTINCT p, ',' ORDER BY p) AS ps FROM n WHERE p IN ('skosxl:prefLabel', 'skosxl:altLabel', 'skosxl:hiddenLabel') GROUP BY g, s, o HAVING count(DISTINCT p) > 1)",
)
_check(
    "h11_odd_labels",
    "odd_labels",
    f"WITH {_V} SELECT {_found('NonPlainLiteralLabel', 'ill-formed', chr(39) + 'S12' + chr(39), 's', 'p', 'o', 'o_dt')} FROM (SELECT DISTINCT g, s, p, o, o_dt FROM v WHERE p IN ('skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel') AND (o_kind <> 'literal' OR o_dt NOT IN ('xsd:string', 'rdf:langString')))",
)
_check("h12_list_defects", "lists")


def _roll_call_sql() -> str:
    from .. import vocabulary as V

    rules = ", ".join(f"('{r}', '{s}', '{a}')" for r, s, a, _ in V.CONDITIONS)
    terms = ", ".join(f"('{r}', '{x}')" for r, _, _, ts in V.CONDITIONS for x in ts)
    checks = " UNION ALL ".join(f"SELECT g, rule FROM ({sql}) WHERE severity = 'inconsistent'" for name, sql in SQL.items() if name.startswith("h"))
    own = "(x LIKE 'skos:%' OR x LIKE 'skosxl:%')"
    return f"""WITH RECURSIVE {_V}, c(rule, section, authority) AS (VALUES {rules}), k(rule, reaches) AS (VALUES {terms}), bad AS MATERIALIZED ({checks}),
d AS (SELECT DISTINCT g, s AS term, o AS reaches FROM n WHERE p IN ('rdfs:subPropertyOf', 'rdfs:subClassOf') AND s <> o AND NOT {own.replace("x", "s")}),
u AS (SELECT * FROM d UNION SELECT u.g, u.term, d.reaches FROM u JOIN d ON d.g = u.g AND d.term = u.reaches),
b AS (SELECT g, rule, count(*) AS n_violations FROM bad GROUP BY g, rule), w AS (SELECT g, rule, count(*) AS n_caveats FROM u JOIN k USING (reaches) GROUP BY g, rule), gs AS (SELECT DISTINCT g FROM v)
SELECT gs.g, c.rule, section, authority, CASE WHEN n_violations > 0 THEN 'violated' WHEN n_caveats > 0 THEN 'unchecked' ELSE 'held' END AS verdict, coalesce(n_violations, 0) AS n_violations, coalesce(n_caveats, 0) AS n_caveats
FROM gs CROSS JOIN c LEFT JOIN b ON b.g = gs.g AND b.rule = c.rule LEFT JOIN w ON w.g = gs.g AND w.rule = c.rule"""


@query("integrity_roll_call", _roll_call_sql())
def integrity_roll_call(spark: SparkSession, folder: str) -> DataFrame:
    return Integrity(model(spark, folder)).roll_call()


@query("h16_newly_violated")
def h16_newly_violated(spark: SparkSession, folder: str) -> DataFrame:
    before = one_graph(spark, folder)
    after = edits.applied(before, _candidate(spark, folder, "additions"), _candidate(spark, folder, "removals"))
    return newly_violated(Integrity(CoreModel(before)).roll_call(), Integrity(CoreModel(after)).roll_call())


# -- I: search --------------------------------------------------------------------------------------

_RANKED = f"""WITH {_LABEL}, {_RETIRED}, x AS (SELECT g, node, lang, text, min(CASE kind WHEN 'preferred' THEN 0 WHEN 'alternative' THEN 1 ELSE 2 END) AS k FROM labels GROUP BY ALL),
h AS (SELECT *, CASE WHEN lower(text) = '{TEXT}' THEN 0 WHEN starts_with(lower(text), '{TEXT}') THEN 1 ELSE 2 END AS q FROM x WHERE contains(lower(text), '{TEXT}'))"""
_NAMES = "CASE k WHEN 0 THEN 'preferred' WHEN 1 THEN 'alternative' ELSE 'hidden' END AS kind, CASE q WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'infix' END AS quality"
_HIT_ORDER = "ORDER BY q, k, text, lang NULLS FIRST, node, g LIMIT 200"


@query("i1_label_search", f"{_RANKED} SELECT g, node, text, lang, {_NAMES} FROM h {_HIT_ORDER}")
def i1_label_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(model(spark, folder).labels, search.LabelQuery(TEXT))[0]


@query("i2_search_current", f"{_RANKED} SELECT g, node, text, lang, {_NAMES} FROM h WHERE (g, node) NOT IN (SELECT (g, node) FROM retired WHERE retired) {_HIT_ORDER}")
def i2_search_current(spark: SparkSession, folder: str) -> DataFrame:
    gone = walks.retirements(vocabularies(spark, folder)).filter("retired")
    return search.search(model(spark, folder).labels, search.LabelQuery(TEXT), gone)[0]


@query(
    "i3_search_counts",
    f"""{_RANKED}, w AS (SELECT h.*, (g, node) IN (SELECT (g, node) FROM retired WHERE retired) AS gone FROM h)
SELECT count(*) FILTER (NOT gone) AS matched, (SELECT count(*) FROM x) AS labels_read, (SELECT count(DISTINCT (g, node)) FROM x) AS resources_read, count(*) FILTER (gone) AS withheld,
count(DISTINCT (g, node)) FILTER (gone) AS withheld_resources FROM w""",
)
def i3_search_counts(spark: SparkSession, folder: str) -> DataFrame:
    gone = walks.retirements(vocabularies(spark, folder)).filter("retired")
    return search.search(model(spark, folder).labels, search.LabelQuery(TEXT), gone)[1]


@query("i5_discovery_local", f"{_RANKED} SELECT g, node, text, lang, {_NAMES}, g = '{GRAPH}' AS home FROM h ORDER BY q, k, (g <> '{GRAPH}'), text, node, g, lang NULLS FIRST LIMIT 20")
def i5_discovery_local(spark: SparkSession, folder: str) -> DataFrame:
    return search.discover(model(spark, folder).labels, TEXT, GRAPH)


@query(
    "i6_multi_query",
    f"""WITH {_LABEL}, x AS MATERIALIZED (SELECT g, node, lang, text, list(DISTINCT kind) AS has FROM labels GROUP BY ALL),
a AS (SELECT query_id, lower(text) AS t, coalesce(match_mode, 'infix') AS mode, lang_range, string_split(kinds, ',') AS kinds, coalesce(max_hits, 200) AS max_hits FROM label_queries
  WHERE text <> '' AND (lang_range IS NULL OR regexp_full_match(lang_range, '\\*|[A-Za-z]{{1,8}}(-[A-Za-z0-9]{{1,8}})*')) AND (kinds IS NULL OR list_has_any(string_split(kinds, ','), ['preferred', 'alternative', 'hidden']))),
d AS MATERIALIZED (SELECT DISTINCT t FROM a), tx AS MATERIALIZED (SELECT DISTINCT text, lower(text) AS low FROM x),
pr AS (SELECT t, text, CASE WHEN low = t THEN 0 WHEN starts_with(low, t) THEN 1 ELSE 2 END AS q FROM d JOIN tx ON contains(low, t)),
h AS (SELECT query_id, max_hits, g, node, x.text, lang, q, list_min(list_transform(list_filter(has, lambda z: kinds IS NULL OR list_contains(kinds, z)), lambda z: CASE z WHEN 'preferred' THEN 0 WHEN 'alternative' THEN 1 ELSE 2 END)) AS k
  FROM a JOIN pr USING (t) JOIN x USING (text) WHERE q <= CASE mode WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 WHEN 'infix' THEN 2 ELSE -1 END
  AND (lang_range IS NULL OR (lang IS NOT NULL AND (lang_range = '*' OR lang = lower(lang_range) OR starts_with(lang, lower(lang_range) || '-'))))),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY q, k, text, lang NULLS FIRST, node, g) AS INTEGER) AS place FROM h WHERE k IS NOT NULL)
SELECT query_id, g, node, text, lang, {_NAMES}, place FROM o WHERE place <= max_hits""",
)
def i6_multi_query(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_all(model(spark, folder).labels, table(spark, folder, "label_queries"))


@query(
    "i7_refused_queries",
    """SELECT query_id, CASE WHEN text IS NULL OR text = '' THEN 'empty query' WHEN kinds IS NOT NULL AND NOT list_has_any(string_split(kinds, ','), ['preferred', 'alternative', 'hidden']) THEN 'no kinds'
WHEN lang_range IS NOT NULL AND NOT regexp_full_match(lang_range, '\\*|[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*') THEN 'malformed language range' END AS refused FROM label_queries""",
)
def i7_refused_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "label_queries").select("query_id", search.refused("text", "lang_range", "kinds").alias("refused"))


# -- J: edits and identifiers -------------------------------------------------------------------------


@query(
    "j9_convention",
    f"""WITH {_CLASS}, x AS (SELECT g, node, nullif(regexp_extract(node, '^(.*#|[^#]*/)([^#/]+)$', 1), '') AS namespace, nullif(regexp_extract(node, '^(.*#|[^#]*/)([^#/]+)$', 2), '') AS l FROM classes WHERE class = 'skos:Concept'),
b AS (SELECT g, namespace, CASE WHEN regexp_matches(l, '[0-9]+$') THEN regexp_replace(l, '[0-9]+$', '') END AS fixed, count(*) AS n, count(*) FILTER (regexp_matches(l, '[0-9]+$')) AS nn FROM x WHERE namespace IS NOT NULL AND NOT starts_with(node, '_:') GROUP BY ALL),
ns AS (SELECT g, namespace, CAST(sum(n) AS BIGINT) AS n, CAST(sum(nn) AS BIGINT) AS n_numbered, arg_min(fixed, (-n, fixed)) FILTER (fixed IS NOT NULL) AS fixed FROM b GROUP BY g, namespace),
f AS (SELECT g, arg_min(namespace, (-n, namespace)) AS namespace FROM ns GROUP BY g), t AS (SELECT g, count(*) AS concepts FROM x GROUP BY g)
SELECT ns.g, ns.namespace, n, concepts, CASE WHEN fixed IS NOT NULL AND n_numbered * 2 > n THEN fixed END AS fixed, n_numbered,
CASE WHEN n * 2 > concepts AND fixed IS NOT NULL AND n_numbered * 2 > n THEN ns.namespace || fixed || '{{n}}' WHEN n * 2 > concepts THEN ns.namespace || '{{slug}}' END AS pattern
FROM ns JOIN f USING (g, namespace) JOIN t ON t.g = ns.g""",
)
def j9_convention(spark: SparkSession, folder: str) -> DataFrame:
    return minting.convention(model(spark, folder).classes)


_PREFIX = "https://vocab.tamarel.example/id/c_"


@query(
    "j8_collisions",
    f"""SELECT iri, min(g) AS found_in FROM (SELECT g, s AS iri FROM quads UNION ALL SELECT g, p FROM quads UNION ALL SELECT g, o FROM quads WHERE o_kind <> 'literal') WHERE starts_with(iri, '{_PREFIX}') GROUP BY iri""",
)
def j8_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return minting.in_use(table(spark, folder, "quads"), _PREFIX)


@query(
    "j7_mint_number",
    f"""SELECT '{_PREFIX}' || CAST(max(CAST(substr(iri, {len(_PREFIX) + 1}) AS BIGINT)) + 1 AS VARCHAR) AS iri FROM (SELECT s AS iri FROM quads UNION SELECT o FROM quads WHERE o_kind <> 'literal')
WHERE regexp_full_match(iri, '{_PREFIX}[0-9]+')""",
)
def j7_mint_number(spark: SparkSession, folder: str) -> DataFrame:
    iri = minting.mint(table(spark, folder, "quads"), minting.Pattern.parse(_PREFIX + "{n}"))
    return spark.createDataFrame([(iri,)], "iri string")


# -- B: SPARQL text over the vocabularies ------------------------------------------------------------

_D = "d AS MATERIALIZED (SELECT DISTINCT s, p, o, o_kind, coalesce(o_lang, '') AS o_lang, o_dt FROM quads WHERE g IN (SELECT g FROM graphs WHERE kind = 'vocabulary'))"
_T = "'https://vocab.tamarel.example/id/'"


def _sparql(name: str, text: str, sql: str | None) -> None:
    def ask(spark: SparkSession, folder: str) -> DataFrame:
        form, df = run(vocabularies(spark, folder), text)
        return plain(df) if form == "select" else df

    ask.__doc__ = text
    query(name, sql)(ask)


_sparql("b1_bgp_join", "SELECT ?c ?p ?l { ?c skos:broader ?p . ?p skos:prefLabel ?l }", f"WITH {_D} SELECT x.s AS c, x.o AS p, y.o AS l FROM d x JOIN d y ON x.o = y.s WHERE x.p = 'skos:broader' AND x.o_kind <> 'literal' AND y.p = 'skos:prefLabel'")
_sparql("b2_bound_subject", "SELECT ?p ?o { <https://vocab.tamarel.example/id/c_1> ?p ?o }", f"WITH {_D} SELECT p, o FROM d WHERE s = 'https://vocab.tamarel.example/id/c_1'")
_sparql("b3_bound_literal", "SELECT ?s { ?s skos:prefLabel 'General'@en }", f"WITH {_D} SELECT s FROM d WHERE p = 'skos:prefLabel' AND o = 'General' AND o_lang = 'en' AND o_dt = 'rdf:langString'")
_sparql("b6_filter_cmp", "SELECT ?s ?n { ?s tam:usageCount ?n FILTER(isNumeric(?n) && ?n >= 1000) }".replace("tam:", "<tam:").replace("<tam:usageCount", "<tam:usageCount>"), f"WITH {_D} SELECT s, o AS n FROM d WHERE p = 'tam:usageCount' AND ((o_dt = 'xsd:integer' AND regexp_full_match(trim(o, chr(32) || chr(9) || chr(10) || chr(13)), '[+-]?[0-9]+') AND TRY_CAST(trim(o, chr(32) || chr(9) || chr(10) || chr(13)) AS BIGINT) >= 1000) OR (o_dt IN ('xsd:decimal', 'xsd:double', 'xsd:float') AND TRY_CAST(trim(o, chr(32) || chr(9) || chr(10) || chr(13)) AS DOUBLE) >= 1000))")
_sparql("b7_not_exists", "SELECT ?c { ?c a skos:Concept FILTER NOT EXISTS { ?c skos:broader ?p } }", f"WITH {_D} SELECT DISTINCT s AS c FROM d WHERE p = 'rdf:type' AND o = 'skos:Concept' AND s NOT IN (SELECT s FROM d WHERE p = 'skos:broader')")
_sparql("b8_exists", "SELECT ?c { ?c a skos:Concept FILTER EXISTS { ?c skos:exactMatch ?m } }", f"WITH {_D} SELECT DISTINCT s AS c FROM d WHERE p = 'rdf:type' AND o = 'skos:Concept' AND s IN (SELECT s FROM d WHERE p = 'skos:exactMatch')")
_sparql("b9_optional", "SELECT ?c ?d { ?c a skos:Concept OPTIONAL { ?c skos:definition ?d } }", f"WITH {_D} SELECT x.s AS c, y.o AS d FROM (SELECT DISTINCT s FROM d WHERE p = 'rdf:type' AND o = 'skos:Concept') x LEFT JOIN (SELECT s, o FROM d WHERE p = 'skos:definition') y ON x.s = y.s")
_sparql("b10_union", "SELECT ?a ?b { { ?a skos:broader ?b } UNION { ?b skos:narrower ?a } }", f"WITH {_D} SELECT s AS a, o AS b FROM d WHERE p = 'skos:broader' UNION ALL SELECT o, s FROM d WHERE p = 'skos:narrower'")
_sparql("b11_minus", "SELECT ?c { ?c a skos:Concept MINUS { ?c skos:inScheme ?x } }", f"WITH {_D} SELECT DISTINCT s AS c FROM d WHERE p = 'rdf:type' AND o = 'skos:Concept' AND s NOT IN (SELECT s FROM d WHERE p = 'skos:inScheme')")
_sparql("b12_graph_var", "SELECT ?g (COUNT(?c) AS ?n) { GRAPH ?g { ?c a skos:Concept } } GROUP BY ?g", "SELECT g, CAST(count(DISTINCT s) AS VARCHAR) AS n FROM quads WHERE g IN (SELECT g FROM graphs WHERE kind = 'vocabulary') AND p = 'rdf:type' AND o = 'skos:Concept' GROUP BY g")
_sparql("b13_from", f"SELECT ?c FROM <{GRAPH}> {{ ?c a skos:Concept }}", f"SELECT DISTINCT s AS c FROM quads WHERE g = '{GRAPH}' AND p = 'rdf:type' AND o = 'skos:Concept'")
_sparql("b14_path_plus", "SELECT ?x { ?x skos:broader+ <https://vocab.tamarel.example/id/c_2> }", f"WITH RECURSIVE {_D}, r AS (SELECT s AS x FROM d WHERE p = 'skos:broader' AND o = 'https://vocab.tamarel.example/id/c_2' UNION SELECT d.s FROM r JOIN d ON d.o = r.x WHERE p = 'skos:broader' AND o_kind <> 'literal') SELECT x FROM r")
_sparql("b15_path_star", "SELECT ?x { <https://vocab.tamarel.example/id/c_2> (^skos:broader|skos:narrower)* ?x }", f"WITH RECURSIVE {_D}, k AS (SELECT o AS a, s AS b FROM d WHERE p = 'skos:broader' AND o_kind <> 'literal' UNION SELECT s, o FROM d WHERE p = 'skos:narrower'), r AS (SELECT 'https://vocab.tamarel.example/id/c_2' AS x UNION SELECT k.b FROM r JOIN k ON k.a = r.x) SELECT x FROM r")
_sparql("b16_subselect", "SELECT ?c ?n { ?c a skos:Concept { SELECT ?c (COUNT(?l) AS ?n) { ?c skos:altLabel ?l } GROUP BY ?c HAVING(COUNT(?l) > 1) } }", f"WITH {_D} SELECT s AS c, CAST(count(*) AS VARCHAR) AS n FROM d WHERE p = 'skos:altLabel' AND s IN (SELECT s FROM d WHERE p = 'rdf:type' AND o = 'skos:Concept') GROUP BY s HAVING count(*) > 1")
_sparql("b17_values", "SELECT ?c ?k { VALUES ?k { skos:Concept skos:ConceptScheme } ?c a ?k }", f"WITH {_D} SELECT s AS c, o AS k FROM d WHERE p = 'rdf:type' AND o IN ('skos:Concept', 'skos:ConceptScheme')")
_sparql("c2_group_having", "SELECT ?p (COUNT(?s) AS ?n) { ?s ?p ?o } GROUP BY ?p HAVING(COUNT(?s) > 100)", f"WITH {_D} SELECT p, CAST(count(*) AS VARCHAR) AS n FROM d GROUP BY p HAVING count(*) > 100")
_sparql("e1_prefix_search", "SELECT ?c ?l { ?c skos:prefLabel ?l FILTER(STRSTARTS(LCASE(STR(?l)), 'regional')) }", f"WITH {_D} SELECT s AS c, o AS l FROM d WHERE p = 'skos:prefLabel' AND starts_with(lower(o), 'regional')")
_sparql("d6_order_limit", "SELECT ?c ?l { ?c skos:prefLabel ?l FILTER(LANG(?l) = 'de') } ORDER BY ?l ?c LIMIT 50", f"WITH {_D} SELECT s AS c, o AS l FROM d WHERE p = 'skos:prefLabel' AND o_lang = 'de' ORDER BY o, o_lang, o_dt, s LIMIT 50")
_sparql("b22_ask", "ASK { ?c a skos:Concept ; skos:exactMatch ?m }", f"WITH {_D} SELECT count(*) > 0 AS answer FROM d x JOIN d y ON x.s = y.s WHERE x.p = 'rdf:type' AND x.o = 'skos:Concept' AND y.p = 'skos:exactMatch'")
_sparql("b22_construct", "CONSTRUCT { ?b skos:narrower ?a } WHERE { ?a skos:broader ?b }", f"WITH {_D} SELECT DISTINCT o AS s, o_kind AS s_kind, 'skos:narrower' AS p, s AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_lang, '' AS o_dt FROM d WHERE p = 'skos:broader' AND o_kind <> 'literal'")
_sparql("b22_describe", "DESCRIBE <https://vocab.tamarel.example/id/c_1>", "SELECT DISTINCT s, s_kind, p, o, o_kind, o_lang, o_dt FROM quads WHERE s = 'https://vocab.tamarel.example/id/c_1' AND g IN (SELECT g FROM graphs WHERE kind = 'vocabulary')")


# -- J and K: edits on concepts that the data name; A: files ------------------------------------------

_EDIT_COLS = ["half", "s", "p", "o", "o_kind", "o_lang", "o_dt"]


def _halves(e: edits.Edit) -> DataFrame:
    """Both halves of an edit in one frame."""
    a = e.additions.withColumn("half", F.lit("add")).select(*_EDIT_COLS)
    return a.unionByName(e.removals.withColumn("half", F.lit("remove")).select(*_EDIT_COLS))


def _lowest(df: DataFrame, *cols: str) -> tuple:
    """The lowest row of a frame: which concept an edit query asks about."""
    row = df.select(*cols).orderBy(*cols).limit(1).collect()
    return tuple(row[0]) if row else tuple(None for _ in cols)


_G = f"v AS MATERIALIZED (SELECT DISTINCT g, s, p, o, o_kind, o_lang, o_dt FROM quads WHERE g = '{GRAPH}'), n AS MATERIALIZED (SELECT DISTINCT g, s, p, o FROM v WHERE o_kind <> 'literal')"
_C = "c AS MATERIALIZED (SELECT DISTINCT s FROM n WHERE p = 'rdf:type' AND o = 'skos:Concept')"
_GONE = "gone AS MATERIALIZED (SELECT DISTINCT s FROM v WHERE p = 'owl:deprecated' AND o_kind = 'literal' AND o = 'true' AND o_dt IN ('xsd:boolean', 'xsd:string'))"


def _concepts(statements: DataFrame) -> DataFrame:
    return statements.filter((F.col("p") == "rdf:type") & (F.col("o") == "skos:Concept")).select("s").distinct()


def _retired(statements: DataFrame) -> DataFrame:
    return walks.retirements(statements).filter("retired").select(F.col("node").alias("s"))


@query(
    "j4_deprecate",
    f"""WITH {_G}, {_C}, {_GONE}, k AS (SELECT min(s) AS s FROM (SELECT s FROM c ANTI JOIN gone USING (s)))
SELECT 'add' AS half, s, 'owl:deprecated' AS p, 'true' AS o, 'literal' AS o_kind, CAST(NULL AS VARCHAR) AS o_lang, 'xsd:boolean' AS o_dt FROM k""",
)
def j4_deprecate(spark: SparkSession, folder: str) -> DataFrame:
    g = one_graph(spark, folder)
    (concept,) = _lowest(_concepts(g).join(_retired(g), "s", "left_anti"), "s")
    return _halves(edits.Editor(g, GRAPH).deprecate(concept))


@query(
    "j5_reinstate",
    f"""WITH {_G}, {_GONE}, k AS (SELECT min(s) AS s FROM gone)
SELECT 'remove' AS half, v.s, p, o, o_kind, o_lang, o_dt FROM v JOIN k USING (s) WHERE (p = 'owl:deprecated' AND o_kind = 'literal' AND o = 'true' AND o_dt IN ('xsd:boolean', 'xsd:string'))
OR (p = 'dcterms:isReplacedBy' AND o_kind <> 'literal')""",
)
def j5_reinstate(spark: SparkSession, folder: str) -> DataFrame:
    g = one_graph(spark, folder)
    (node,) = _lowest(_retired(g), "s")
    return _halves(edits.Editor(g, GRAPH).reinstate(node))


@query(
    "j2_merge",
    f"""WITH {_REL}{_LABEL[len(_V) :]}, w AS MATERIALIZED (SELECT s, p, o, o_kind, o_lang, o_dt FROM v WHERE g = '{GRAPH}'),
leaf AS (SELECT DISTINCT s FROM n WHERE g = '{GRAPH}' AND p = 'rdf:type' AND o = 'skos:Concept' AND s NOT IN (SELECT s FROM rel WHERE g = '{GRAPH}' AND p = 'skos:narrowerTransitive')),
k AS (SELECT list_sort(list(s))[1] AS a, list_sort(list(s))[2] AS b FROM leaf),
about AS (SELECT w.* FROM w, k WHERE s = a OR (o = a AND o_kind <> 'literal')),
new AS (SELECT DISTINCT CASE WHEN s = a THEN b ELSE s END AS s, p, CASE WHEN o = a AND o_kind <> 'literal' THEN b ELSE o END AS o, o_kind, o_lang, o_dt FROM about, k),
fresh AS (SELECT new.* FROM new, k WHERE NOT (s = b AND o = b AND o_kind <> 'literal') AND NOT EXISTS (SELECT 1 FROM w x WHERE x.s = new.s AND x.p = new.p AND x.o = new.o AND x.o_kind = new.o_kind AND x.o_lang IS NOT DISTINCT FROM new.o_lang AND x.o_dt = new.o_dt)),
lab AS (SELECT fresh.*, coalesce(lower(nullif(o_lang, '')), '') AS l FROM fresh, k WHERE s = b AND o_kind = 'literal' AND o_dt IN ('xsd:string', 'rdf:langString') AND p IN ('skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel')),
mine AS (SELECT coalesce(lang, '') AS l, text, kind FROM labels, k WHERE node = b AND g = '{GRAPH}'),
arr AS (SELECT *, row_number() OVER (PARTITION BY l, o ORDER BY p) AS i FROM lab WHERE (l, o) NOT IN (SELECT (l, text) FROM mine)),
one AS (SELECT *, row_number() OVER (PARTITION BY l, p ORDER BY o) AS j FROM arr WHERE i = 1)
SELECT 'remove' AS half, s, p, o, o_kind, o_lang, o_dt FROM about
UNION ALL SELECT 'add', s, p, o, o_kind, o_lang, o_dt FROM fresh, k WHERE NOT (s = b AND o_kind = 'literal' AND o_dt IN ('xsd:string', 'rdf:langString') AND p IN ('skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel'))
UNION ALL SELECT 'add', s, CASE WHEN p = 'skos:prefLabel' AND (j > 1 OR l IN (SELECT l FROM mine WHERE kind = 'preferred')) THEN 'skos:altLabel' ELSE p END, o, o_kind, o_lang, o_dt FROM one""",
)
def j2_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The two lowest concepts with nothing below them."""
    g = one_graph(spark, folder)
    ed = edits.Editor(g, GRAPH)
    leaf = _concepts(g).join(ed.model.relations.filter("p = 'skos:narrowerTransitive'").select("s"), "s", "left_anti")
    a, b = (r["s"] for r in leaf.orderBy("s").limit(2).collect())
    return _halves(ed.merge(a, b))


@query(
    "j1_move",
    f"""WITH {_REL.replace("FROM quads WHERE g IN (SELECT g FROM graphs WHERE kind = 'vocabulary')", f"FROM quads WHERE g = '{GRAPH}'")}, {_C},
one AS (SELECT s, min(o) AS old FROM rel WHERE p = 'skos:broader' GROUP BY s HAVING count(*) = 1),
x AS (SELECT s, old FROM one WHERE s IN (SELECT s FROM c) AND s NOT IN (SELECT s FROM rel WHERE p = 'skos:narrower') AND (s, old) NOT IN (SELECT (s, o) FROM n WHERE p = 'skos:broaderTransitive') AND (s, old) NOT IN (SELECT (o, s) FROM n WHERE p = 'skos:narrowerTransitive')),
k AS (SELECT min(s) AS s, arg_min(old, s) AS old FROM x), t AS (SELECT min(c.s) AS top FROM c, k WHERE c.s <> k.s AND c.s <> k.old)
SELECT half, s, p, o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_lang, '' AS o_dt FROM (
  SELECT 'remove' AS half, k.s, 'skos:broader' AS p, old AS o FROM k WHERE (k.s, old) IN (SELECT (s, o) FROM n WHERE p = 'skos:broader')
  UNION ALL SELECT 'add', k.s, 'skos:broader', top FROM k, t WHERE (k.s, old) IN (SELECT (s, o) FROM n WHERE p = 'skos:broader')
  UNION ALL SELECT 'remove', old, 'skos:narrower', k.s FROM k WHERE (old, k.s) IN (SELECT (s, o) FROM n WHERE p = 'skos:narrower')
  UNION ALL SELECT 'add', top, 'skos:narrower', k.s FROM k, t WHERE (old, k.s) IN (SELECT (s, o) FROM n WHERE p = 'skos:narrower'))""",
)
def j1_move(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest leaf with one broader concept, moved below the lowest other concept."""
    g = one_graph(spark, folder)
    ed = edits.Editor(g, GRAPH)
    rel = ed.model.relations
    one = rel.filter("p = 'skos:broader'").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("old")).filter("n = 1")
    stated = ed.statements.filter(F.col("p") == "skos:broaderTransitive").select("s", F.col("o").alias("old")).unionByName(ed.statements.filter(F.col("p") == "skos:narrowerTransitive").select(F.col("o").alias("s"), F.col("s").alias("old")))
    leaf = one.join(_concepts(g), "s", "left_semi").join(rel.filter("p = 'skos:narrower'").select("s"), "s", "left_anti").join(stated, ["s", "old"], "left_anti")
    concept, old = _lowest(leaf, "s", "old")
    (to,) = _lowest(_concepts(g).filter(~F.col("s").isin(concept, old)), "s")
    return _halves(ed.move(concept, to))


@query(
    "j3_split",
    f"""WITH {_LABEL.replace("FROM quads WHERE g IN (SELECT g FROM graphs WHERE kind = 'vocabulary')", f"FROM quads WHERE g = '{GRAPH}'")}, {_C}, {_TOP},
l AS (SELECT node, min(lang) AS lang FROM labels WHERE kind = 'preferred' GROUP BY node HAVING count(DISTINCT coalesce(lang, '')) = 1), k AS (SELECT min(node) AS s, arg_min(lang, node) AS lang FROM l JOIN c ON c.s = l.node),
x AS (SELECT 'urn:part:1' AS iri, 'First part' AS t UNION ALL SELECT 'urn:part:2', 'Second part')
SELECT 'add' AS half, iri AS s, 'rdf:type' AS p, 'skos:Concept' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_lang, '' AS o_dt FROM x
UNION ALL SELECT 'add', iri, 'skos:prefLabel', t, 'literal', lang, CASE WHEN lang IS NULL THEN 'xsd:string' ELSE 'rdf:langString' END FROM x, k
UNION ALL SELECT 'add', iri, 'prov:wasDerivedFrom', k.s, 'iri', NULL, '' FROM x, k UNION ALL SELECT 'add', iri, 'skos:broader', k.s, 'iri', NULL, '' FROM x, k
UNION ALL SELECT 'add', iri, 'skos:inScheme', scheme, 'iri', NULL, '' FROM x, k JOIN ins ON ins.node = k.s""",
)
def j3_split(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest concept with preferred labels in one language, split in two below it."""
    g = one_graph(spark, folder)
    ed = edits.Editor(g, GRAPH)
    one = ed.model.labels.filter("kind = 'preferred'").groupBy(F.col("node").alias("s")).agg(F.count_distinct(F.coalesce("lang", F.lit(""))).alias("n")).filter("n = 1")
    (concept,) = _lowest(one.join(_concepts(g), "s", "left_semi"), "s")
    return _halves(ed.split(concept, [("urn:part:1", "First part"), ("urn:part:2", "Second part")], place="below"))


@query("a8_nquads_roundtrip", "SELECT DISTINCT g, s, p, o, o_kind, coalesce(o_lang, '') AS o_lang FROM quads")
def a8_nquads_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All statements written as N-Quads and read back."""
    return _roundtrip(spark, folder).select("g", "s", "p", "o", "o_kind", F.coalesce("o_lang", F.lit("")).alias("o_lang")).distinct()


@query(
    "a8_nquads_statements",
    """SELECT DISTINCT g, s, s_kind, p, o, o_kind, coalesce(o_lang, '') AS o_lang, CASE WHEN o_kind <> 'literal' THEN '' WHEN o_lang <> '' THEN 'rdf:langString'
  WHEN o_dt IN ('', 'rdf:langString') THEN 'xsd:string' ELSE o_dt END AS o_dt FROM quads""",
)
def a8_nquads_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The same with all fields; statements are a set there.  N-Quads has no datatype beside a language tag, and a
    literal with neither is an xsd:string; so one without datatype, or an rdf:langString without tag, comes back as that."""
    cols = ["g", "s", "s_kind", "p", "o", "o_kind", F.coalesce("o_lang", F.lit("")).alias("o_lang"), "o_dt"]
    return _roundtrip(spark, folder).select(*cols).distinct()


def _roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources import rdf
    from ..staging import Stage

    path = Stage(spark, "export").folder + "/nquads"
    q = table(spark, folder, "quads")
    bare = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.lit("_:"), F.col(c))).otherwise(F.col(c))
    rdf.write(q.withColumn("s", bare("s", "s_kind")).withColumn("o", bare("o", "o_kind")), path, "nquads")
    back = rdf.read(spark, path, "nquads")
    name = lambda c, k: F.when(F.col(k) == "bnode", F.regexp_replace(c, "^_:", "")).otherwise(F.col(c)).alias(c)
    return back.select("g", name("s", "s_kind"), "s_kind", "p", name("o", "o_kind"), "o_kind", "o_lang", "o_dt")
