"""Queries of the general data problems over the statement store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import Hierarchy, links_of
from ..operators.skew import per_key
from ..operators.wide import WideTable, attributes
from ..tables import in_graphs, table

UP = ("skos:broader", "skos:broaderTransitive")
DOWN = ("skos:narrower", "skos:narrowerTransitive")

# -- 1: hierarchies ------------------------------------------------------------------------------


def hierarchy(spark: SparkSession, folder: str) -> Hierarchy:
    quads = table(spark, folder, "quads").select("g", "s", "p", "o", "o_kind")
    return Hierarchy(links_of(in_graphs(quads, table(spark, folder, "graphs"), "vocabulary"), UP, DOWN))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(spark, folder).loops()


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(spark, folder).paths()


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(spark, folder).descendants()


def p1_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(spark, folder).concepts()


# The three above have one row set for each loop, under its lowest member, as their SQL has; these have one for each member.


def p1_member_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(spark, folder).member_paths()


def p1_member_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(spark, folder).member_descendants()


def p1_member_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(spark, folder).member_concepts()


_LINKS = """e AS MATERIALIZED (SELECT DISTINCT g, CASE WHEN up THEN s ELSE o END AS c, CASE WHEN up THEN o ELSE s END AS p FROM (
  SELECT g, s, o, p IN ('skos:broader', 'skos:broaderTransitive') AS up FROM quads
  WHERE o_kind <> 'literal' AND g IN (SELECT g FROM graphs WHERE kind = 'vocabulary')
  AND p IN ('skos:broader', 'skos:broaderTransitive', 'skos:narrower', 'skos:narrowerTransitive'))),
r AS (SELECT g, c AS d, p AS a FROM e UNION SELECT r.g, r.d, e.p FROM r JOIN e ON r.g = e.g AND r.a = e.c),
m AS MATERIALIZED (SELECT * FROM r),
low AS MATERIALIZED (SELECT x.g, x.d AS concept, min(x.a) AS lowest FROM m x JOIN m y ON x.g = y.g AND x.d = y.a AND x.a = y.d GROUP BY ALL)"""

_TREE = f"""{_LINKS},
n AS (SELECT g, c AS x FROM e UNION SELECT g, p FROM e),
f AS MATERIALIZED (SELECT DISTINCT e.g, coalesce(lc.lowest, e.c) AS c, coalesce(lp.lowest, e.p) AS p FROM e
  LEFT JOIN low lc ON lc.g = e.g AND lc.concept = e.c LEFT JOIN low lp ON lp.g = e.g AND lp.concept = e.p
  WHERE coalesce(lc.lowest, e.c) <> coalesce(lp.lowest, e.p)),
x AS (SELECT DISTINCT n.g, coalesce(lowest, x) AS x FROM n LEFT JOIN low ON low.g = n.g AND concept = x),
t AS (SELECT g, x AS concept, x AS path, 0 AS depth, x AS root FROM x WHERE (g, x) NOT IN (SELECT (g, c) FROM f)
  UNION ALL SELECT f.g, f.c, t.path || ' > ' || f.c, t.depth + 1, t.root FROM t JOIN f ON t.g = f.g AND t.concept = f.p)"""

# -- 2: hot keys ---------------------------------------------------------------------------------

#: a key is hot if it holds at least one in so many rows
HOT_ONE_IN = 50


def _objects(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    return per_key(table(spark, folder, "quads"), "o", "s")


def _origins(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    return per_key(table(spark, folder, "walk"), "origin", "node", "depth")


def p2_objects(spark: SparkSession, folder: str) -> DataFrame:
    return _objects(spark, folder)[0].select(F.col("k").alias("o"), "n_rows", F.col("n_values").alias("n_subjects"))


def p2_origins(spark: SparkSession, folder: str) -> DataFrame:
    return _origins(spark, folder)[0].select(F.col("k").alias("origin"), "n_rows", F.col("n_values").alias("n_nodes"), F.col("greatest").alias("greatest_depth"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    out = []
    for name, (keys, n) in (("quads", _objects(spark, folder)), ("walk", _origins(spark, folder))):
        hot = keys.filter(F.col("k").isNotNull() & (F.col("n_rows") * HOT_ONE_IN >= n))
        out.append(hot.select(F.lit(name).alias("found_in"), F.col("k").alias("hot_key")))
    return out[0].unionByName(out[1])


# -- 5: wide table -------------------------------------------------------------------------------


def wide_table(spark: SparkSession, folder: str) -> WideTable:
    quads = table(spark, folder, "quads").select("g", "s", "p", "o")
    return WideTable(in_graphs(quads, table(spark, folder, "graphs"), "vocabulary"), attributes(table(spark, folder, "wide_columns")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return wide_table(spark, folder).unfit()


def p5_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays are joined with a unit separator and times are written out, so that the rows can be compared."""
    w = wide_table(spark, folder).wide()
    shown = {"array<string>": lambda c: F.array_join(F.array_sort(c), "\x1f"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return w.select(*[shown.get(t, F.col)(c).alias(c) for c, t in w.dtypes])


def p5_long_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values of the cells that are null in p5_wide because they hold too many."""
    return wide_table(spark, folder).long_values()


def p5_untyped(spark: SparkSession, folder: str) -> DataFrame:
    """The cells whose one valid value p5_wide cannot hold exactly, with the value's canonical text."""
    return wide_table(spark, folder).untyped()


def _valid_sql() -> str:
    zone = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
    t = r"trim(o, chr(32) || chr(9) || chr(10) || chr(13))"
    return f"""CASE datatype WHEN 'xsd:string' THEN o
  WHEN 'xsd:boolean' THEN CASE WHEN {t} IN ('true', '1') THEN 'true' WHEN {t} IN ('false', '0') THEN 'false' END
  WHEN 'xsd:integer' THEN CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN CAST(TRY_CAST({t} AS BIGINT) AS VARCHAR) END
  WHEN 'xsd:decimal' THEN CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') THEN CAST(TRY_CAST({t} AS DECIMAL(38, 12)) AS VARCHAR) END
  WHEN 'xsd:double' THEN CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(TRY_CAST({t} AS DOUBLE) + 0.0 AS VARCHAR)
    WHEN {t} IN ('INF', '+INF') THEN 'inf' WHEN {t} = '-INF' THEN '-inf' WHEN {t} = 'NaN' THEN 'nan' END
  WHEN 'xsd:date' THEN CASE WHEN regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{zone}') THEN CAST(TRY_CAST(substr({t}, 1, 10) AS DATE) AS VARCHAR) END
  WHEN 'xsd:dateTime' THEN CASE WHEN regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?{zone}')
    THEN CAST(TRY_CAST(replace(CASE WHEN regexp_matches({t}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN {t} ELSE {t} || 'Z' END, 'Z', '+00:00') AS TIMESTAMPTZ) AS VARCHAR) END
  END"""


# The columns of the test data's wide table, by type.
_WIDE = {
    "xsd:dateTime": {"dcterms:created": "created", "dcterms:modified": "modified", "tam:lastSync": "last_sync"},
    "xsd:string": {"dcterms:identifier": "identifier", "skos:notation": "notation", "tam:shelfCode": "shelf_code"},
    "xsd:integer": {"tam:usageCount": "usage_count", "tam:pageCount": "page_count", "tam:legacyId": "legacy_id"},
    "xsd:decimal": {"tam:confidence": "confidence", "tam:tariff": "tariff"},
    "xsd:date": {"tam:reviewDate": "review_date", "tam:firstUse": "first_use"},
    "xsd:boolean": {"owl:deprecated": "deprecated", "tam:locked": "locked"},
    "xsd:double": {"tam:weight": "weight", "tam:density": "density"},
    "": {"skos:altLabel": "alt_labels", "skos:hiddenLabel": "hidden_labels", "skos:scopeNote": "scope_notes", "skos:definition": "definitions"},
}


def _wide_sql() -> str:
    shown = {
        "xsd:dateTime": "strftime(CAST({} AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')", "xsd:string": "{}", "xsd:integer": "CAST({} AS BIGINT)", "xsd:decimal": "CAST({} AS DECIMAL(38, 18))",
        "xsd:date": "CAST({} AS DATE)", "xsd:boolean": "CAST({} AS BOOLEAN)", "xsd:double": "CAST({} AS DOUBLE)", "": "coalesce({}, '')",
    }
    cols = ",\n".join(f"{shown[d].format(f"max(v) FILTER (p = '{p}')")} AS {c}" for d, own in _WIDE.items() for p, c in own.items())
    here = "g IN (SELECT g FROM graphs WHERE kind = 'vocabulary') AND s IS NOT NULL AND o IS NOT NULL"
    return f"""WITH c AS (SELECT s, p, {_valid_sql()} AS v FROM quads JOIN wide_columns USING (p) WHERE single_valued AND {here}),
x AS (SELECT s, p, CASE WHEN count(*) = count(v) AND count(DISTINCT v) = 1 THEN min(v) END AS v, count(*) > count(v) OR count(DISTINCT v) > 1 AS unfit FROM c GROUP BY s, p
  UNION ALL SELECT s, p, string_agg(DISTINCT o, chr(31) ORDER BY o), false FROM quads JOIN wide_columns USING (p) WHERE NOT single_valued AND {here} GROUP BY s, p
  UNION ALL SELECT DISTINCT s, NULL, NULL, false FROM quads WHERE p = 'rdf:type' AND o = 'skos:Concept' AND {here})
SELECT s, {cols}, coalesce(string_agg(p, chr(31) ORDER BY p) FILTER (unfit), '') AS unfit, '' AS inexact, '' AS long_cells FROM x GROUP BY s"""


QUERIES = {
    "p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p1_concepts": p1_concepts,
    "p1_member_paths": p1_member_paths, "p1_member_descendants": p1_member_descendants, "p1_member_concepts": p1_member_concepts,
    "p2_found": p2_found, "p2_objects": p2_objects, "p2_origins": p2_origins,
    "p5_found": p5_found, "p5_wide": p5_wide, "p5_long_values": p5_long_values, "p5_untyped": p5_untyped,
}

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT g, lowest, concept FROM low",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT m.g, m.a AS concept, m.d AS below, ld.concept IS NOT NULL AS on_loop FROM m
LEFT JOIN low la ON la.g = m.g AND la.concept = m.a LEFT JOIN low ld ON ld.g = m.g AND ld.concept = m.d
WHERE la.lowest IS NULL OR la.lowest = m.a""",
    "p1_paths": f"""WITH RECURSIVE {_TREE}
SELECT t.*, EXISTS (SELECT 1 FROM low WHERE low.g = t.g AND low.lowest = t.root) AS root_on_loop FROM t""",
    "p1_concepts": f"""WITH RECURSIVE {_TREE},
b AS (SELECT m.g, coalesce(la.lowest, m.a) AS concept, count(DISTINCT coalesce(ld.lowest, m.d)) AS n_below FROM m LEFT JOIN low la ON la.g = m.g AND la.concept = m.a
  LEFT JOIN low ld ON ld.g = m.g AND ld.concept = m.d WHERE coalesce(la.lowest, m.a) <> coalesce(ld.lowest, m.d) GROUP BY ALL)
SELECT t.g, t.concept, min(depth) AS min_depth, max(depth) AS max_depth, count(*) AS n_paths, count(DISTINCT root) AS n_roots, min(root) AS root, coalesce(any_value(n_below), 0) AS n_below
FROM t LEFT JOIN b ON b.g = t.g AND b.concept = t.concept GROUP BY t.g, t.concept""",
    "p1_member_paths": f"""WITH RECURSIVE {_TREE}
SELECT t.g, coalesce(l.concept, t.concept) AS concept, path, depth, root, EXISTS (SELECT 1 FROM low WHERE low.g = t.g AND low.lowest = t.root) AS root_on_loop, l.concept IS NOT NULL AS on_loop
FROM t LEFT JOIN low l ON l.g = t.g AND l.lowest = t.concept""",
    "p1_member_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT m.g, m.a AS concept, m.d AS below, la.concept IS NOT NULL AS concept_on_loop, ld.concept IS NOT NULL AS on_loop FROM m
LEFT JOIN low la ON la.g = m.g AND la.concept = m.a LEFT JOIN low ld ON ld.g = m.g AND ld.concept = m.d""",
    "p1_member_concepts": f"""WITH RECURSIVE {_TREE}, b AS (SELECT g, a, count(*) AS n_below FROM m GROUP BY g, a)
SELECT t.g, coalesce(l.concept, t.concept) AS concept, min(depth) AS min_depth, max(depth) AS max_depth, count(*) AS n_paths, count(DISTINCT root) AS n_roots, min(root) AS root,
coalesce(any_value(n_below), 0) AS n_below, l.concept IS NOT NULL AS on_loop
FROM t LEFT JOIN low l ON l.g = t.g AND l.lowest = t.concept LEFT JOIN b ON b.g = t.g AND b.a = coalesce(l.concept, t.concept) GROUP BY t.g, t.concept, l.concept""",
    "p2_found": """SELECT 'quads' AS found_in, o AS hot_key FROM quads WHERE o IS NOT NULL GROUP BY o HAVING count(*) * 50 >= (SELECT count(*) FROM quads)
UNION ALL SELECT 'walk', origin FROM walk WHERE origin IS NOT NULL GROUP BY origin HAVING count(*) * 50 >= (SELECT count(*) FROM walk)""",
    "p2_objects": "SELECT o, count(*) AS n_rows, count(DISTINCT s) AS n_subjects FROM quads GROUP BY o",
    "p2_origins": "SELECT origin, count(*) AS n_rows, count(DISTINCT node) AS n_nodes, CAST(max(depth) AS BIGINT) AS greatest_depth FROM walk GROUP BY origin",
    "p5_found": f"""WITH c AS (SELECT s, p, {_valid_sql()} AS v FROM quads JOIN wide_columns USING (p)
  WHERE single_valued AND s IS NOT NULL AND o IS NOT NULL AND g IN (SELECT g FROM graphs WHERE kind = 'vocabulary'))
SELECT s, p FROM c GROUP BY s, p HAVING count(*) > count(v) OR count(DISTINCT v) > 1""",
    "p5_wide": _wide_sql(),
    "p5_long_values": """WITH v AS MATERIALIZED (SELECT DISTINCT s, p, o AS v FROM quads JOIN wide_columns USING (p)
  WHERE NOT single_valued AND s IS NOT NULL AND o IS NOT NULL AND g IN (SELECT g FROM graphs WHERE kind = 'vocabulary'))
SELECT s, p, v FROM v WHERE (s, p) IN (SELECT (s, p) FROM v GROUP BY s, p HAVING count(*) > 10000)""",
}
