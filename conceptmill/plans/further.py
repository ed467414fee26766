"""More registered queries: paths and derivations of walks, discovery, reports, bounded checks, and conditions on planted statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..operators import discovery, edits, reports, walks
from ..operators.hierarchy import Hierarchy
from ..operators.integrity import Integrity, newly_violated, verdicts
from ..operators.skos import CoreModel
from ..tables import table
from . import catalog
from .catalog import _CAND, _CLASS, _DOWN, _FOUND, _LABEL, _MAP, _NOTES, _REL, _RETIRED, _ROUTES, _TOP, _UP, _V, GRAPH, _candidate, _origins, _roll_call_sql, model, one_graph, vocabularies

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- walks with their paths ---------------------------------------------------------------------------

#: the least of the shortest paths; a round's rows all have the same length
_PATHS = """w(g, origin, node, path) USING KEY (g, origin, node) AS (
  SELECT start.g, origin, b, min([origin, b]) FROM start JOIN e ON e.g = start.g AND e.a = origin GROUP BY ALL
  UNION SELECT w.g, w.origin, e.b, min(list_append(w.path, e.b)) FROM w JOIN e ON e.g = w.g AND e.a = w.node
    LEFT JOIN recurring.w AS r ON r.g = w.g AND r.origin = w.origin AND r.node = e.b WHERE r.path IS NULL GROUP BY ALL)"""


@query("g2_shortest_paths", f"WITH RECURSIVE {_UP}, {_PATHS} SELECT g, origin, node, array_to_string(path, ' > ') AS path FROM w")
def g2_shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    return catalog._ancestors(spark, folder).select("g", "origin", "node", F.array_join("path", " > ").alias("path"))


@query(
    "g3_entailed",
    f"""WITH RECURSIVE {_UP}, {_PATHS} SELECT g, origin, node, array_to_string(list_transform(range(1, len(path)), lambda i: path[i] || ' skos:broaderTransitive ' || path[i + 1]), ', and ') AS because
FROM w WHERE len(path) > 2""",
)
def g3_entailed(spark: SparkSession, folder: str) -> DataFrame:
    """What only S24 gives, with the statements that it follows from."""
    why = walks.entailed(F.col("path"), "skos:broaderTransitive")
    return catalog._ancestors(spark, folder).filter("depth > 1").select("g", "origin", "node", why.alias("because"))


SQL["g8_tree_current"] = f"""WITH RECURSIVE {_DOWN}, {_RETIRED}, {_PATHS}, gone AS (SELECT g, node FROM retired WHERE retired), x AS MATERIALIZED (SELECT w.*, (g, node) IN (SELECT (g, node) FROM gone) AS off FROM w),
on_way AS (SELECT DISTINCT g, origin, unnest(path[2:len(path) - 1]) AS node FROM x WHERE NOT off)
SELECT g, origin, count(*) FILTER (NOT off) AS kept, count(*) FILTER (off AND o.node IS NOT NULL) AS route, count(*) FILTER (off AND o.node IS NULL) AS dropped FROM x LEFT JOIN on_way o USING (g, origin, node) GROUP BY g, origin"""


@query(
    "g11_approaches",
    f"""WITH RECURSIVE {_ROUTES}, c AS (SELECT g, origin, list_position(path, tip) AS pos, path FROM t WHERE loop), k AS (SELECT g, origin, path[pos:len(path) - 1] AS ring, path[:pos] AS approach FROM c),
z AS (SELECT *, list_position(ring, list_min(ring)) AS i FROM k)
SELECT g, origin, array_to_string(list_concat(ring[i:], ring[:i - 1]), ' > ') AS cycle, array_to_string(min(approach), ' > ') AS approach FROM z GROUP BY ALL""",
)
def g11_approaches(spark: SparkSession, folder: str) -> DataFrame:
    _, cycles = walks.routes(model(spark, folder).relations, _origins(spark, folder, "up"))
    return cycles.select("g", "origin", F.array_join("cycle", " > ").alias("cycle"), F.array_join("approach", " > ").alias("approach"))


@query(
    "g12_summits",
    f"""WITH RECURSIVE {_ROUTES}, {_TOP}, s AS (SELECT DISTINCT g, origin, tip AS summit FROM t WHERE NOT loop AND (g, tip) NOT IN (SELECT (g, a) FROM e))
SELECT s.g, s.origin, summit, coalesce(string_agg(DISTINCT scheme, ' ' ORDER BY scheme), '') AS top_concept_of FROM s LEFT JOIN top ON top.g = s.g AND top.concept = summit GROUP BY s.g, s.origin, summit""",
)
def g12_summits(spark: SparkSession, folder: str) -> DataFrame:
    m = model(spark, folder)
    return walks.summits(walks.routes(m.relations, _origins(spark, folder, "up"))[0], m.top_concepts).withColumn("top_concept_of", F.array_join("top_concept_of", " "))


@query(
    "g15_closure_size",
    f"""WITH RECURSIVE {_REL}, e AS MATERIALIZED (SELECT DISTINCT g, s, o FROM rel WHERE p = 'skos:broaderTransitive'), c AS (SELECT g, s, o FROM e UNION SELECT c.g, c.s, e.o FROM c JOIN e ON e.g = c.g AND e.s = c.o)
SELECT g, count(*) AS pairs FROM c GROUP BY g""",
)
def g15_closure_size(spark: SparkSession, folder: str) -> DataFrame:
    up = walks.upward(model(spark, folder).relations)
    return Hierarchy(up, child="a", parent="b").closure_size()


# -- model --------------------------------------------------------------------------------------------


@query("e18_preferred_in", f"WITH {_LABEL} SELECT g, node, min(text) AS text FROM labels WHERE kind = 'preferred' AND lang = 'de' GROUP BY g, node")
def e18_preferred_in(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).preferred_in("DE")


@query("f0_unread", f"WITH {_V} SELECT g, p, count(*) AS n FROM v WHERE p NOT IN ({', '.join(repr(p) for p in reports.READ)}) GROUP BY g, p")
def f0_unread(spark: SparkSession, folder: str) -> DataFrame:
    return reports.unread(vocabularies(spark, folder))


_LISTS = f"""{_V}, heads AS (SELECT DISTINCT g, s AS node, o AS head, o_kind FROM v WHERE p = 'skos:memberList'),
cells AS (SELECT g, s AS cell, count(*) FILTER (p = 'rdf:first') AS n_first, count(*) FILTER (p = 'rdf:rest') AS n_rest, min(o) FILTER (p = 'rdf:first') AS item, min(o) FILTER (p = 'rdf:rest') AS next,
  bool_or(p = 'rdf:first' AND o_kind = 'literal') AS lit FROM (SELECT DISTINCT g, s, p, o, o_kind FROM v WHERE p IN ('rdf:first', 'rdf:rest')) GROUP BY g, s),
lw AS (SELECT g, node, head, head AS cell, CAST([] AS VARCHAR[]) AS items, CAST([] AS VARCHAR[]) AS seen, CASE WHEN o_kind = 'literal' THEN 'not a node' END AS defect FROM heads
  UNION ALL SELECT g, node, head, CASE WHEN why IS NULL THEN next ELSE cell END, CASE WHEN why IS NULL THEN list_append(items, item) ELSE items END, list_append(seen, cell), why FROM (
    SELECT lw.*, item, next, CASE WHEN list_contains(seen, lw.cell) THEN 'cyclic' WHEN coalesce(n_first, 0) = 0 THEN 'no first' WHEN coalesce(n_rest, 0) = 0 THEN 'no rest'
      WHEN n_first > 1 OR n_rest > 1 THEN 'branches' WHEN lit THEN 'not a node' END AS why FROM lw LEFT JOIN cells USING (g, cell) WHERE lw.cell <> 'rdf:nil' AND lw.defect IS NULL)),
lists AS MATERIALIZED (SELECT g, node, head, items, defect FROM lw WHERE cell = 'rdf:nil' OR defect IS NOT NULL)"""
_FOUND_LISTS = f"""WITH RECURSIVE {_LISTS} SELECT {_FOUND.format("MultipleMemberLists", "ill-formed", "CAST(NULL AS VARCHAR)", "node", "CAST(n AS VARCHAR)")} FROM (SELECT g, node, count(DISTINCT head) AS n FROM lists GROUP BY g, node HAVING count(DISTINCT head) > 1)
UNION ALL SELECT {_FOUND.format("DefectiveMemberList", "ill-formed", "CAST(NULL AS VARCHAR)", "node", "head || ' | ' || defect")} FROM lists WHERE defect IS NOT NULL"""
SQL["h12_list_defects"] = _FOUND_LISTS
_MEMBERS = f"""WITH RECURSIVE {_LISTS} SELECT g, collection, member, arg_min(origin, k) AS origin FROM (SELECT g, s AS collection, o AS member, 0 AS k, 'asserted' AS origin FROM n WHERE p = 'skos:member'
  UNION ALL SELECT g, node, unnest(items), 1, 'S36' FROM lists WHERE defect IS NULL) GROUP BY g, collection, member"""
_LABEL_RELATIONS = f"""WITH {_V} SELECT g, s, o, arg_min(origin, k) AS origin FROM (SELECT g, s, o, 0 AS k, 'asserted' AS origin FROM n WHERE p = 'skosxl:labelRelation'
  UNION ALL SELECT g, o, s, 1, 'S62' FROM n WHERE p = 'skosxl:labelRelation') GROUP BY g, s, o"""

# -- conditions on planted statements ------------------------------------------------------------------

_X = "https://store.tamarel.example/planted/"


def _x(s: str, p: str, o: str, kind: str = "iri", lang: str | None = None, dt: str = "") -> tuple:
    name = lambda n: n if ":" in n else _X + n
    return (GRAPH, name(s), "iri", p, name(o) if kind == "iri" else o, kind, lang, dt)


# One case at least of each condition that the test data keep, and the lists and label relations that they do not have.
PLANTED = [
    _x("a", "rdf:type", "skos:Concept"), _x("a", "rdf:type", "skos:ConceptScheme"), _x("a", "rdf:type", "skos:Collection"), _x("l", "rdf:type", "skos:Concept"),
    _x("a", "skos:prefLabel", "same", "literal", "en", "rdf:langString"), _x("a", "skos:altLabel", "same", "literal", "EN", "rdf:langString"), _x("a", "skos:hiddenLabel", "same", "literal", "en", "rdf:langString"),
    _x("a", "skos:exactMatch", "b"), _x("a", "skos:broadMatch", "b"), _x("b", "skos:relatedMatch", "a"), _x("b", "skos:exactMatch", "c"), _x("a", "skos:relatedMatch", "c"), _x("c", "skos:narrowMatch", "a"),
    _x("l", "skosxl:literalForm", "b"), _x("l", "skosxl:literalForm", "form", "literal", None, "xsd:string"), _x("a", "skosxl:prefLabel", "l"), _x("a", "skosxl:altLabel", "l"), _x("l", "skosxl:labelRelation", "m"),
    _x("a", "skos:prefLabel", "5", "literal", None, "xsd:integer"), _x("b", "skos:altLabel", "c"),
    _x("good", "skos:memberList", "g1"), _x("g1", "rdf:first", "a"), _x("g1", "rdf:rest", "g2"), _x("g2", "rdf:first", "b"), _x("g2", "rdf:rest", "g3"), _x("g3", "rdf:first", "c"), _x("g3", "rdf:rest", "rdf:nil"),
    _x("good", "skos:memberList", "g2"), _x("none", "skos:memberList", "rdf:nil"), _x("round", "skos:memberList", "r1"), _x("r1", "rdf:first", "a"), _x("r1", "rdf:rest", "r2"), _x("r2", "rdf:first", "b"), _x("r2", "rdf:rest", "r1"),
    _x("self", "skos:memberList", "s1"), _x("s1", "rdf:first", "a"), _x("s1", "rdf:rest", "s1"), _x("text", "skos:memberList", "not a list", "literal", None, "xsd:string"), _x("open", "skos:memberList", "o1"), _x("o1", "rdf:first", "a"),
    _x("bare", "skos:memberList", "b1"), _x("b1", "rdf:first", "a"), _x("b1", "rdf:rest", "b2"), _x("b2", "rdf:rest", "rdf:nil"), _x("fork", "skos:memberList", "f1"), _x("f1", "rdf:first", "a"), _x("f1", "rdf:first", "b"), _x("f1", "rdf:rest", "rdf:nil"),
    _x("lit", "skos:memberList", "l1"), _x("l1", "rdf:first", "words", "literal", None, "xsd:string"), _x("l1", "rdf:rest", "rdf:nil"), _x("gone", "skos:memberList", "nowhere"), _x("good", "skos:member", "b"),
]
_COLS = ("g", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt")


def _value(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


def _planted_sql(sql: str, rows: list[tuple] = PLANTED) -> str:
    """The SQL of a query over the statements and the planted ones."""
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    sql = re.sub(r"\bFROM quads\b", "FROM planted", sql)
    own = f"planted AS (SELECT {', '.join(_COLS)} FROM quads UNION ALL SELECT * FROM (VALUES {values}) planted_rows({', '.join(_COLS)}))"
    head = re.match(r"WITH (RECURSIVE )?", sql)
    return sql[: head.end()] + own + ", " + sql[head.end() :] if head else f"WITH {own} {sql}"


def _with_planted(spark: SparkSession, quads: DataFrame, rows: list[tuple] = PLANTED) -> DataFrame:
    return quads.select(*_COLS).unionByName(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in _COLS)))


def _planted(name: str, frame, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return frame(CoreModel(_with_planted(spark, vocabularies(spark, folder))))

    query(name, _planted_sql(sql))(run)


for _name, _method in {
    "h1_disjoint_classes": "disjoint_classes", "h2_label_clashes": "label_clashes", "h5_exact_match_clashes": "exact_match_clashes", "h6_exact_chain_clashes": "exact_chain_clashes",
    "h8_nodes_as_forms": "nodes_as_forms", "h10_xl_clashes": "xl_clashes", "h11_odd_labels": "odd_labels",
}.items():
    _planted(f"{_name}_planted", lambda m, f=_method: getattr(Integrity(m), f)(), catalog.SQL[_name])
_planted("h12_list_defects_planted", lambda m: Integrity(m).lists(), _FOUND_LISTS)
_planted("f7_members_planted", lambda m: m.members, _MEMBERS)
_planted("f18_label_relations_planted", lambda m: m.label_relations, _LABEL_RELATIONS)


@query("f7_members", _MEMBERS)
def f7_members(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).members


@query("f18_label_relations", _LABEL_RELATIONS)
def f18_label_relations(spark: SparkSession, folder: str) -> DataFrame:
    return model(spark, folder).label_relations


#: the additions of a change that says again what is planted, and breaks S9
_CHANGE = [(f"{GRAPH[: GRAPH.rindex('/')]}/candidate/planted/additions", *r[1:]) for r in PLANTED]


@query("d9_already_said_planted", _planted_sql(f"{_CAND.format('additions')} INTERSECT SELECT DISTINCT s, p, o, o_kind, o_lang, o_dt FROM quads WHERE g = '{GRAPH}'", PLANTED[:9] + _CHANGE[4:20]))
def d9_already_said_planted(spark: SparkSession, folder: str) -> DataFrame:
    q = _with_planted(spark, table(spark, folder, "quads"), PLANTED[:9] + _CHANGE[4:20])
    new = q.filter(F.col("g").startswith(f"{GRAPH[: GRAPH.rindex('/')]}/candidate/") & F.col("g").endswith("/additions")).withColumn("g", F.lit(GRAPH)).select(*edits.STATEMENT).distinct()
    have = q.filter(F.col("g") == GRAPH).select(*edits.STATEMENT).distinct()
    return new.join(have, [new[c].eqNullSafe(have[c]) for c in edits.STATEMENT], "left_semi").drop("g")


def _newly_sql() -> str:
    """The roll-call of the graph as changed, less what is violated before."""
    here = "FROM quads WHERE g IN (SELECT g FROM graphs WHERE kind = 'vocabulary')"
    roll = _roll_call_sql()
    before = roll.replace(here, f"FROM quads WHERE g = '{GRAPH}'")
    changed = f"(({_IN}) EXCEPT {_half('removals')}) UNION {_half('additions')}"
    after = roll.replace(here, f"FROM ({changed}) changed")
    assert here not in before and "FROM quads WHERE g IN" not in after
    return f"SELECT * FROM ({after}) WHERE verdict = 'violated' AND rule NOT IN (SELECT rule FROM ({before}) WHERE verdict = 'violated')"


_IN = f"SELECT DISTINCT g, s, p, o, o_kind, o_lang, o_dt FROM quads WHERE g = '{GRAPH}'"


def _half(name: str) -> str:
    return f"SELECT DISTINCT '{GRAPH}' AS g, s, p, o, o_kind, o_lang, o_dt FROM quads WHERE g LIKE 'https://store.tamarel.example/graph/candidate/%/{name}'"


SQL["h16_newly_violated"] = _newly_sql()


@query("h16_newly_violated_planted", _planted_sql(_newly_sql(), _CHANGE))
def h16_newly_violated_planted(spark: SparkSession, folder: str) -> DataFrame:
    before = one_graph(spark, folder)
    extra = spark.createDataFrame(PLANTED, ", ".join(f"{c} string" for c in _COLS)).select(*edits.STATEMENT)
    after = edits.applied(before, _candidate(spark, folder, "additions").unionByName(extra), _candidate(spark, folder, "removals"))
    return newly_violated(Integrity(CoreModel(before)).roll_call(), Integrity(CoreModel(after)).roll_call())


@query(
    "h17_verdicts",
    f"""WITH {_V}, bad AS ({" UNION ALL ".join(f"SELECT g, severity FROM ({sql})" for name, sql in catalog.SQL.items() if re.match(r"h[0-9]+_", name) and name != "h16_newly_violated")})
SELECT v.g, NOT coalesce(bool_or(severity = 'inconsistent'), false) AS consistent, NOT coalesce(bool_or(severity = 'unchecked'), false) AS complete FROM (SELECT DISTINCT g FROM v) v LEFT JOIN bad USING (g) GROUP BY v.g""",
)
def h17_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    m = model(spark, folder)
    return verdicts(Integrity(m).findings(), m.facts)


@query("h13_related_within", catalog.SQL["h4_related_vs_broader"])
def h13_related_within(spark: SparkSession, folder: str) -> DataFrame:
    """Under bounds that these data do not meet, so nothing is left unchecked."""
    return Integrity(model(spark, folder)).related_within(1_000_000, 1_000_000_000)


# -- discovery ------------------------------------------------------------------------------------------

_ASKED = "a AS MATERIALIZED (SELECT query_id, lower(text) AS t FROM label_queries WHERE text <> '')"
_DISCOVER = f"""WITH {_LABEL.replace("WHERE kind = 'vocabulary'", "WHERE kind = 'vocabulary' OR (kind = 'candidate' AND g LIKE '%/additions')")}, {_ASKED},
x AS MATERIALIZED (SELECT g, node, lang, text, lower(text) AS low, min(CASE kind WHEN 'preferred' THEN 0 WHEN 'alternative' THEN 1 ELSE 2 END) AS k FROM labels GROUP BY ALL),
h AS MATERIALIZED (SELECT query_id, x.*, CASE WHEN low = t THEN 0 WHEN starts_with(low, t) THEN 1 ELSE 2 END AS q, g = '{GRAPH}' AS home, g LIKE '%/additions' AS pending FROM a JOIN x ON contains(low, t))"""


class _NoAnswer:
    """A source that is not there."""

    name = "remote catalogue"

    def answer(self, queries: DataFrame):
        raise discovery.Unavailable("the catalogue cannot be reached")


def _discovered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    changes = table(spark, folder, "quads").filter(F.col("g").endswith("/additions"))
    local = discovery.LocalSource("this store", vocabularies(spark, folder), changes, GRAPH)
    none = F.lit(None).cast("string")
    asked = table(spark, folder, "label_queries").select("query_id", "text", F.lit("infix").alias("match_mode"), none.alias("lang_range"), none.alias("kinds"), F.lit(None).cast("int").alias("max_hits"))
    return discovery.discover([local, _NoAnswer()], asked)


@query(
    "i4_discovery",
    f"""{_DISCOVER}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY q, k, NOT home, text, node, g, lang NULLS FIRST) AS INTEGER) AS place FROM h)
SELECT query_id, 'this store' AS source, g, node, text, lang, {catalog._NAMES}, home, pending, place FROM o WHERE place <= 20""",
)
def i4_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """What the vocabularies and the proposed changes hold under each label asked for."""
    return _discovered(spark, folder)[0]


@query(
    "i4_sources",
    f"""{_DISCOVER} SELECT a.query_id, 0 AS asked, 'this store' AS source, 'answered' AS outcome, CAST(NULL AS VARCHAR) AS reason, count(h.query_id) AS matched, least(count(h.query_id), 20) AS listed,
(SELECT count(DISTINCT g) FILTER (g NOT LIKE '%/additions') || ' vocabularies and ' || count(DISTINCT g) FILTER (g LIKE '%/additions') || ' proposed changes' FROM v) AS searched, (SELECT count(*) FROM x) AS labels_read FROM a LEFT JOIN h USING (query_id) GROUP BY a.query_id
UNION ALL SELECT query_id, 1, 'remote catalogue', 'unavailable', 'the catalogue cannot be reached', 0, 0, NULL, 0 FROM a""",
)
def i4_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What each source answered about each label."""
    return _discovered(spark, folder)[1]


@query(
    "i7_consulted",
    f"""{_DISCOVER} SELECT 'this store' AS source, 'answered' AS outcome, CAST(NULL AS VARCHAR) AS reason, (SELECT count(*) FROM h) AS matched,
(SELECT count(DISTINCT g) FILTER (g NOT LIKE '%/additions') || ' vocabularies and ' || count(DISTINCT g) FILTER (g LIKE '%/additions') || ' proposed changes' FROM v) AS searched, (SELECT count(*) FROM x) * (SELECT count(*) FROM a) AS labels_read
UNION ALL SELECT 'remote catalogue', 'unavailable', 'the catalogue cannot be reached', 0, NULL, 0""",
)
def i7_consulted(spark: SparkSession, folder: str) -> DataFrame:
    return discovery.consulted(_discovered(spark, folder)[1])


# -- reports ---------------------------------------------------------------------------------------------


def _inspect_sql() -> str:
    part = "SELECT g, '{}' AS section, {} AS item, count(*) AS n, {} AS n_inferred FROM {} GROUP BY g, item"
    derived = "count(*) FILTER (origin <> 'asserted')"
    parts = [
        part.format("statements", "'read'", "0", "v"), part.format("classes", "class", derived, "classes"), part.format("languages", "coalesce(lang, '-') || ' ' || kind", derived, "labels"),
        "SELECT g, 'languages', 'concepts without preferred label', count(*) FILTER (NOT has), 0 FROM (SELECT g, node, (g, node) IN (SELECT (g, node) FROM labels WHERE kind = 'preferred') AS has FROM classes WHERE class = 'skos:Concept') GROUP BY g",
        part.format("label resources", "'with exactly one form'", "0", "forms WHERE n_forms = 1"), part.format("label resources", "'links'", derived, f"({_LABEL_RELATIONS[_LABEL_RELATIONS.index('SELECT g, s, o, arg_min') :]}) WHERE s <= o"),
        part.format("documentation", "kind", derived, "(SELECT * FROM notes SEMI JOIN (SELECT g, node FROM classes WHERE class = 'skos:Concept') USING (g, node))"), part.format("top concepts", "scheme", "0", "top"),
        part.format("members", "collection", derived, "mem"), part.format("relations", "p", derived, "rel"), part.format("mappings", "p", derived, "m"),
        part.format("retirements", "CASE WHEN n_next = 0 THEN 'without successor' ELSE 'with successor' END", "0", "retired WHERE retired"),
    ]
    mem = _MEMBERS[_MEMBERS.index("SELECT g, collection, member, arg_min") :]
    body = ", ".join([_NOTES, _LABEL[len(_V) + 1 :].strip(), _REL[len(_V) + 1 :].strip(), _LISTS[len(_V) + 1 :].strip(), _RETIRED, f"mem AS ({mem})"])
    return f"WITH RECURSIVE {body} " + " UNION ALL ".join(parts)


@query("l1_inspect", _inspect_sql())
def l1_inspect(spark: SparkSession, folder: str) -> DataFrame:
    return reports.inspect(model(spark, folder), walks.retirements(vocabularies(spark, folder)), findings=False)


@query(
    "l3_notes",
    f"""WITH {_NOTES}, c AS (SELECT DISTINCT about AS node FROM documents), u AS (SELECT g, s AS node, o, o_kind, string_agg(DISTINCT p, ' ' ORDER BY p) AS premise FROM v WHERE p IN ({", ".join(repr(k) for k in V.NOTES)}) GROUP BY ALL)
SELECT g, node, kind, o AS value, lang, origin, CASE WHEN origin <> 'asserted' THEN premise END AS premise FROM notes SEMI JOIN c USING (node) LEFT JOIN u USING (g, node, o, o_kind)""",
)
def l3_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The notes on all concepts that the documents are about."""
    m = model(spark, folder)
    named = table(spark, folder, "documents").select(F.col("about").alias("node")).dropna().distinct()
    known = m.facts.select("g", F.col("s").alias("node")).distinct().join(named, "node", "left_semi")
    return reports.notes_of(m, known.select("g", "node"))


@query(
    "l4_mappings",
    f"""WITH RECURSIVE {_MAP}, start AS (SELECT DISTINCT g, origin FROM exact_clusters JOIN (SELECT DISTINCT g, s AS origin FROM m WHERE p = 'skos:exactMatch') USING (origin)), e AS (SELECT DISTINCT g, s AS a, o AS b FROM m WHERE p = 'skos:exactMatch'), {_PATHS}
SELECT m.g, s AS concept, p, o AS other, origin, CASE p WHEN 'skos:broadMatch' THEN 'skos:broader' WHEN 'skos:narrowMatch' THEN 'skos:narrower' WHEN 'skos:relatedMatch' THEN 'skos:related' END AS also, CAST(NULL AS VARCHAR) AS chain
FROM m SEMI JOIN start ON start.g = m.g AND start.origin = m.s
UNION ALL SELECT g, origin, 'skos:exactMatch', node, 'S45', NULL, array_to_string(path, ' > ') FROM w WHERE len(path) > 2""",
)
def l4_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """All mappings, and the chains of exact matches, of the concepts from which exact matches were walked."""
    m = model(spark, folder)
    origins = table(spark, folder, "exact_clusters").select(F.col("origin").alias("concept")).dropna().distinct()
    here = m.mappings.filter("p = 'skos:exactMatch'").select("g", F.col("s").alias("concept")).distinct().join(origins, "concept", "left_semi")
    return reports.mappings_of(m, here.select("g", "concept"))[0]


# -- more SPARQL texts ------------------------------------------------------------------------------------


def _sparql(name: str, text: str, sql: str) -> None:
    def ask(spark: SparkSession, folder: str) -> DataFrame:
        return catalog.plain(catalog.run(vocabularies(spark, folder), text)[1])

    ask.__doc__ = text
    query(name, f"WITH {catalog._D} {sql}")(ask)


_sparql("b4_select_all", "SELECT * { ?c skos:topConceptOf ?s }", "SELECT s AS c, o AS s FROM d WHERE p = 'skos:topConceptOf'")
_sparql("b5_bind", "SELECT ?c ?u { ?c skos:notation ?n BIND(UCASE(STR(?n)) AS ?u) }", "SELECT s AS c, upper(o) AS u FROM d WHERE p = 'skos:notation'")
_sparql("b13_from_named", f"SELECT ?g ?c FROM NAMED <{GRAPH}> {{ GRAPH ?g {{ ?c a skos:Concept }} }}", f"SELECT DISTINCT '{GRAPH}' AS g, s AS c FROM quads WHERE g = '{GRAPH}' AND p = 'rdf:type' AND o = 'skos:Concept'")
_sparql("b15_path_sequence", "SELECT ?x ?y { ?x skos:broader/skos:prefLabel ?y }", "SELECT x.s AS x, y.o AS y FROM d x JOIN d y ON x.o = y.s WHERE x.p = 'skos:broader' AND x.o_kind <> 'literal' AND y.p = 'skos:prefLabel'")
_sparql("b15_path_optional", "SELECT ?y { <https://vocab.tamarel.example/id/c_2> skos:broader? ?y }", "SELECT 'https://vocab.tamarel.example/id/c_2' AS y UNION SELECT o FROM d WHERE s = 'https://vocab.tamarel.example/id/c_2' AND p = 'skos:broader'")
_sparql("b15_path_negated", "SELECT ?x ?y { ?x !(rdf:type|skos:broader|skos:prefLabel) ?y }", "SELECT s AS x, o AS y FROM (SELECT DISTINCT s, o, o_kind, o_lang, o_dt FROM d WHERE p NOT IN ('rdf:type', 'skos:broader', 'skos:prefLabel'))")
_sparql("e4_bound", "SELECT ?c { ?c a skos:Concept OPTIONAL { ?c skos:definition ?d } FILTER(!BOUND(?d)) }", "SELECT DISTINCT s AS c FROM d WHERE p = 'rdf:type' AND o = 'skos:Concept' AND s NOT IN (SELECT s FROM d WHERE p = 'skos:definition')")
_sparql("e6_strings", "SELECT ?c (STRLEN(?l) AS ?n) (SUBSTR(STR(?l), 2, 3) AS ?h) (CONTAINS(STR(?l), 'ar') AS ?a) { ?c skos:prefLabel ?l }", "SELECT s AS c, CAST(length(o) AS VARCHAR) AS n, substr(o, 2, 3) AS h, CAST(contains(o, 'ar') AS VARCHAR) AS a FROM d WHERE p = 'skos:prefLabel'")
_sparql("c2_distinct_min_max", "SELECT ?p (COUNT(DISTINCT ?s) AS ?n) (MIN(STR(?o)) AS ?lo) (MAX(STR(?o)) AS ?hi) { ?s ?p ?o FILTER(isLiteral(?o)) } GROUP BY ?p", "SELECT p, CAST(count(DISTINCT s) AS VARCHAR) AS n, min(o) AS lo, max(o) AS hi FROM d WHERE o_kind = 'literal' GROUP BY p")
_sparql("d6_offset", "SELECT ?c ?l { ?c skos:prefLabel ?l FILTER(LANG(?l) = 'de') } ORDER BY ?l ?c LIMIT 50 OFFSET 20", "SELECT s AS c, o AS l FROM d WHERE p = 'skos:prefLabel' AND o_lang = 'de' ORDER BY o, o_lang, o_dt, s LIMIT 50 OFFSET 20")
