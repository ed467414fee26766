"""Discovery: what several sources already hold under the labels of things about to be created.

Each source is asked once, about all labels together.  A source that fails is recorded as unavailable for every label, with its
reason, and never left out; the others' answers stand.  Best matches come first, up to a bound, and what the bound
withholds is counted.

Defined cases: no labels give no rows; a refused label (empty text, no kinds, malformed range) has no matches and is not put
to the sources; a source that answers about a label it was not asked about is unavailable; without sources nothing is consulted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Stage
from .search import KINDS, foremost, matches, quality_name, refused
from .skos import CoreModel

#: matches listed for a label
MAX_MATCHES = 20


class Unavailable(RuntimeError):
    """A source cannot answer; the reason goes into the report."""


class Source(Protocol):
    name: str

    def answer(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Matches (query_id, g, node, text, lang, q, k, home, pending) of all queries, and one row (searched, labels_read)."""


@dataclass
class LocalSource:
    """Every vocabulary of a store and the additions of every proposed change.  Each part is read as a graph of its own."""

    name: str
    vocabularies: DataFrame
    proposed: DataFrame  # statements; g is the graph of the change's additions
    home: str | None = None

    def answer(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        cols = ["g", "s", "p", "o", "o_kind", "o_lang", "o_dt"]
        parts = self.vocabularies.select(*cols).unionByName(self.proposed.select(*cols))
        stage = Stage(parts.sparkSession, "local-source")
        labels = stage.write(CoreModel(parts).labels, "labels")
        graphs = stage.write(
            self.vocabularies.select("g").distinct().withColumn("pending", F.lit(False)).unionByName(self.proposed.select("g").distinct().withColumn("pending", F.lit(True))), "parts"
        )
        kinds = graphs.agg(F.count_if(~F.col("pending")).alias("v"), F.count_if("pending").alias("c"))
        pairs = labels.agg(F.count_distinct("g", "node", F.coalesce("lang", F.lit("")), "text").alias("labels_read"))
        read = kinds.crossJoin(pairs)  # one row each
        home = F.lit(False) if self.home is None else F.col("g") == self.home
        found = matches(labels, queries).join(graphs, "g").withColumn("home", home)
        return found, read.select(F.concat_ws(" ", "v", F.lit("vocabularies and"), "c", F.lit("proposed changes")).alias("searched"), "labels_read")


def _order() -> list[Column]:
    """Quality, kind, home before away, then by text, node, graph and language."""
    return [F.col("q"), F.col("k"), (~F.col("home")).cast("int"), F.col("text"), F.col("node"), F.col("g"), F.col("source"), F.col("lang").asc_nulls_first()]


def discover(sources: list[Source], queries: DataFrame, max_matches: int = MAX_MATCHES) -> tuple[DataFrame, DataFrame]:
    """(query_id, source, g, node, text, lang, kind, quality, home, pending, place): the best matches of each label; and
    (query_id, asked, source, outcome, reason, matched, listed, searched, labels_read) for each label and source, in the order of the sources."""
    spark = queries.sparkSession
    stage = Stage(spark, "discovery")
    asked = stage.write(queries.filter(refused("text", "lang_range", "kinds").isNull()), "asked")
    answers: list[DataFrame] = []
    notes: list[DataFrame] = []
    for i, source in enumerate(sources):
        try:  # the answer is read here, so that a failure is this source's and not the report's
            found, read = source.answer(asked)
            found = stage.write(found.select("query_id", F.lit(source.name).alias("source"), "g", "node", "text", "lang", "q", "k", "home", "pending"), "answer")
            if not found.select("query_id").distinct().join(asked.select("query_id"), "query_id", "left_anti").isEmpty():
                raise Unavailable("it answered about labels that it was not asked about")
            read = stage.write(read.select("searched", "labels_read").limit(1), "read")
        except Exception as e:  # noqa: BLE001  any failure of a source is an answer of its own
            reason = str(e).strip().split("\n")[0] or type(e).__name__
            notes.append(asked.select("query_id", F.lit(i).alias("asked"), F.lit(source.name).alias("source"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("searched"), F.lit(0).cast("long").alias("labels_read")))
            continue
        answers.append(found)
        notes.append(asked.select("query_id", F.lit(i).alias("asked"), F.lit(source.name).alias("source"), F.lit(None).cast("string").alias("reason")).crossJoin(F.broadcast(read)))  # one row
    none = "query_id long, source string, g string, node string, text string, lang string, q int, k int, home boolean, pending boolean"
    every = reduce(DataFrame.unionByName, answers) if answers else spark.createDataFrame([], none)
    best = foremost(every.withColumn("_most", F.lit(max_matches)), "query_id", "_most", _order()).drop("_most")
    best = stage.write(best, "best")
    count = lambda df, name: df.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias(name))
    told = reduce(DataFrame.unionByName, notes) if notes else spark.createDataFrame([], "query_id long, asked int, source string, reason string, searched string, labels_read long")
    told = told.join(count(every, "matched"), ["query_id", "source"], "left").join(count(best, "listed"), ["query_id", "source"], "left")
    told = told.select(
        "query_id", "asked", "source", F.when(F.col("reason").isNull(), "answered").otherwise("unavailable").alias("outcome"), "reason",
        F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("listed", F.lit(0)).alias("listed"), "searched", "labels_read",
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1).alias("kind")
    return best.select("query_id", "source", "g", "node", "text", "lang", kind, quality_name(F.col("q")).alias("quality"), "home", "pending", "place"), told


def consulted(told: DataFrame) -> DataFrame:
    """(source, outcome, reason, matched, searched, labels_read): one row for each source over all labels, in the order asked.  A source that was
    unavailable for any label is unavailable."""
    out = told.groupBy("source").agg(
        F.min("asked").alias("asked"), F.max(F.col("outcome") == "unavailable").alias("off"), F.min("reason").alias("reason"),
        F.sum("matched").alias("matched"), F.min("searched").alias("searched"), F.sum("labels_read").alias("labels_read"),
    )
    kept = lambda c, none=None: F.when(~F.col("off"), F.col(c)).otherwise(F.lit(none)).alias(c)
    return out.orderBy("asked").select("source", F.when(F.col("off"), "unavailable").otherwise("answered").alias("outcome"), "reason", kept("matched", 0), kept("searched"), kept("labels_read", 0))
