"""Label search: one question, or a table of questions, against all labels."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("preferred", "alternative", "hidden")
MODES = ("exact", "prefix", "infix")
#: basic language range: '*' or subtags of one to eight letters and digits, the first of letters
RANGE = r"^(\*|[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*)\z"
_RANGE = re.compile(RANGE.replace(r"\z", r"\Z"))


#: parts in which the hits of one question are ranked
_SPLITS = 32


class SearchRefused(ValueError):
    """The question cannot be asked: empty text, no kinds, or a malformed language range."""


@dataclass(frozen=True)
class LabelQuery:
    text: str
    mode: str = "infix"
    lang_range: str | None = None
    untagged: bool = False
    kinds: tuple[str, ...] = KINDS
    max_hits: int = 200

    def __post_init__(self) -> None:
        if not self.text:
            raise SearchRefused("the text is empty")
        if not self.kinds or not set(self.kinds) <= set(KINDS):
            raise SearchRefused("no kind of label is asked for")
        if self.lang_range is not None and not _RANGE.match(self.lang_range):
            raise SearchRefused(f"malformed language range {self.lang_range}")
        if self.mode not in MODES:
            raise SearchRefused(f"unknown mode {self.mode}")


def quality(label: Column, text: Column) -> Column:
    """0 exact, 1 prefix, 2 infix, null for none; both in lower case."""
    return F.when(label == text, 0).when(label.startswith(text), 1).when(label.contains(text), 2)


def quality_name(q: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODES]), q + 1)


def in_range(lang: Column, range_: Column) -> Column:
    """Basic filtering: the whole tag or a prefix at a hyphen; '*' selects any tag, and no range an untagged label."""
    r = F.lower(range_)
    return lang.isNotNull() & ((r == "*") | (lang == r) | lang.startswith(F.concat(r, F.lit("-"))))


def _kind_rank(kind: Column) -> Column:
    return F.when(kind == "preferred", 0).when(kind == "alternative", 1).otherwise(2)


def _ranked(hits: DataFrame, *extra: str) -> list[Column]:
    """The total order of hits: quality, kind, text, language (none first), node."""
    return [F.col("q"), F.col("k"), *[F.col(e) for e in extra], F.col("text"), F.col("lang").asc_nulls_first(), F.col("node"), F.col("g")]


def search(labels: DataFrame, query: LabelQuery, retired: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(g, node, text, lang, kind, quality), best first, and a row (matched, labels_read, resources_read, withheld, withheld_resources).

    Retired resources are left out before the bound applies, and counted."""
    rows = labels.groupBy("g", "node", "lang", "text").agg(F.min(F.when(F.col("kind").isin(*query.kinds), _kind_rank(F.col("kind")))).alias("k"))
    wanted = F.lit(True)
    if query.lang_range is not None:
        wanted = in_range(F.col("lang"), F.lit(query.lang_range))
        if query.untagged:
            wanted = wanted | F.col("lang").isNull()
    elif query.untagged:
        wanted = F.col("lang").isNull()
    rows = rows.withColumn("q", quality(F.lower("text"), F.lit(query.text.lower())))
    hit = wanted & F.col("k").isNotNull() & (F.col("q") <= MODES.index(query.mode))
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    gone = F.lit(False)
    if retired is not None:
        rows = rows.join(retired.select("g", "node", F.lit(True).alias("gone")), ["g", "node"], "left")
        gone = F.coalesce("gone", F.lit(False))
    counts = rows.agg(
        F.count_if(F.col("hit") & ~gone).alias("matched"), F.count(F.lit(1)).alias("labels_read"), F.count_distinct("g", "node").alias("resources_read"),
        F.count_if(F.col("hit") & gone).alias("withheld"), F.count_distinct(F.when(F.col("hit") & gone, F.struct("g", "node"))).alias("withheld_resources"),
    )
    top = rows.filter(F.col("hit") & ~gone).orderBy(*_ranked(rows)).limit(query.max_hits)
    return top.select("g", "node", "text", "lang", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1).alias("kind"), quality_name(F.col("q")).alias("quality")), counts


def refused(text: str, lang_range: str, kinds: str) -> Column:
    """Why a question is refused; null if it is not."""
    known = F.size(F.array_intersect(F.split(F.col(kinds), ","), F.array(*[F.lit(k) for k in KINDS])))
    return (
        F.when(F.col(text).isNull() | (F.col(text) == ""), "empty query")
        .when(F.col(kinds).isNotNull() & (known == 0), "no kinds")
        .when(F.col(lang_range).isNotNull() & ~F.col(lang_range).rlike(RANGE), "malformed language range")
    )


def matches(labels: DataFrame, queries: DataFrame, default_hits: int = 200) -> DataFrame:
    """(query_id, max_hits, g, node, text, lang, q, k) of every label that a question meets, with the rank of its quality and kind.

    Texts meet by an equi-join on a gram: each question is looked up by the rarest of its three-character grams (a shorter
    text by itself), which every label that contains the text contains too; the match is then checked in full.  No
    question is compared with all labels."""
    asked = queries.filter(refused("text", "lang_range", "kinds").isNull()).select(
        "query_id", F.lower("text").alias("t"), F.coalesce("match_mode", F.lit("infix")).alias("mode"), "lang_range", F.split("kinds", ",").alias("kinds"),
        F.coalesce("max_hits", F.lit(default_hits)).alias("max_hits"),
    ).filter(F.col("mode").isin(*MODES))
    texts = labels.select("text").distinct().withColumn("low", F.lower("text"))

    def grams(col: str, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.char_length(col) - (n - 1), F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.substring(F.col(col), i, F.lit(n))))

    long = asked.filter(F.char_length("t") >= 3)
    probes = long.select("t").distinct().select("t", F.explode(grams("t", 3)).alias("gram"))
    index = texts.filter(F.char_length("low") >= 3).select("text", "low", F.explode(grams("low", 3)).alias("gram"))
    index = index.join(probes.select("gram").distinct(), "gram", "left_semi")
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = probes.join(often, "gram", "left").groupBy("t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b")).select("t", F.col("b.gram").alias("gram"))
    pairs = best.join(index, "gram").filter(F.col("low").contains(F.col("t"))).select("t", "text", "low")
    for n in (1, 2):  # texts of one or two characters are their own gram
        few = asked.filter(F.char_length("t") == n).select("t").distinct()
        pairs = pairs.unionByName(few.join(texts.select("text", "low", F.explode(grams("low", n)).alias("t")), "t").select("t", "text", "low"))
    pairs = pairs.withColumn("q", quality(F.col("low"), F.col("t"))).drop("low")
    grouped = labels.groupBy("g", "node", "lang", "text").agg(F.collect_set("kind").alias("has"))
    hits = asked.join(pairs, "t").filter(F.col("q") <= F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode")) - 1)
    hits = hits.join(grouped, "text").filter(F.col("lang_range").isNull() | in_range(F.col("lang"), F.col("lang_range")))
    usable = F.when(F.col("kinds").isNull(), F.col("has")).otherwise(F.array_intersect("has", "kinds"))
    hits = hits.withColumn("k", F.array_min(F.transform(usable, _kind_rank))).filter("k is not null")
    return hits.select("query_id", "max_hits", "g", "node", "text", "lang", "q", "k")


def search_all(labels: DataFrame, queries: DataFrame, default_hits: int = 200) -> DataFrame:
    """(query_id, g, node, text, lang, kind, quality, place) for every question (query_id, text, match_mode, lang_range, kinds, max_hits) that is not refused."""
    hits = matches(labels, queries, default_hits)
    top = foremost(hits, "query_id", "max_hits", _ranked(hits))
    return top.select("query_id", "g", "node", "text", "lang", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1).alias("kind"), quality_name(F.col("q")).alias("quality"), "place")


def foremost(hits: DataFrame, key: str, most: str, order: list[Column]) -> DataFrame:
    """``hits`` with ``place``, for each ``key`` the first ``most`` in ``order``.  A key's hits are ranked in ``_SPLITS`` parts first, and
    only the first of each part meet, so a key with most of the hits is no single task's."""
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    part = F.pmod(F.xxhash64("g", "node", "text"), F.lit(_SPLITS)).alias("_part")
    first = hits.select("*", part).withColumn("place", rank(key, "_part")).filter(F.col("place") <= F.col(most)).drop("_part", "place")
    return first.withColumn("place", rank(key)).filter(F.col("place") <= F.col(most))


def discover(labels: DataFrame, text: str, home: str, max_hits: int = 20) -> DataFrame:
    """(g, node, text, lang, kind, quality, home): best matches for a new concept's label over all graphs; ties go to the home graph."""
    if not text:
        raise SearchRefused("the text is empty")
    rows = labels.groupBy("g", "node", "lang", "text").agg(F.min(_kind_rank(F.col("kind"))).alias("k"))
    rows = rows.withColumn("q", quality(F.lower("text"), F.lit(text.lower()))).filter("q is not null").withColumn("away", (F.col("g") != home).cast("int"))
    top = rows.orderBy("q", "k", "away", "text", "node", "g", F.col("lang").asc_nulls_first()).limit(max_hits)
    return top.select("g", "node", "text", "lang", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1).alias("kind"), quality_name(F.col("q")).alias("quality"), (F.col("away") == 0).alias("home"))
