"""Probes over a generated tree, in the shape of the published figures: `python scale.py [concepts ...]`, one line of JSON for each size.

Ten top concepts with ten narrower concepts each, and so on; six statements for each concept and a broader one below the
top.  One warm-up, then the median of three runs; every answer is counted and compared with what the tree must give.
"""

from __future__ import annotations

import json
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmill.operators.hierarchy import Hierarchy
from conceptmill.operators.skos import CoreModel
from conceptmill.operators.walks import upward
from conceptmill.plans.algebra import plain, run
from conceptmill.session import local_session
from conceptmill.staging import runs

TOPS = BRANCHING = 10
WORDS = 17  # a label starts with one of so many words
BASE = "https://example.org/scale/"


def tree(spark: SparkSession, n: int) -> DataFrame:
    c = F.concat(F.lit(BASE + "c"), F.col("id"))
    parent = F.concat(F.lit(BASE + "c"), F.floor((F.col("id") - TOPS) / BRANCHING))
    word = lambda part: F.concat(F.lit(part), F.col("id") % WORDS, F.lit(" "), F.col("id"))

    def node(p: str, o) -> Column:
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), F.lit("").alias("o_dt"))

    def text(p: str, o, lang: str) -> Column:
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit(lang).alias("o_lang"), F.lit("rdf:langString").alias("o_dt"))

    facts = F.array_compact(F.array(
        node("rdf:type", F.lit("skos:Concept")), node("skos:inScheme", F.lit(BASE + "scheme")), text("skos:prefLabel", word("Term"), "en"), text("skos:prefLabel", word("Wort"), "de"),
        text("skos:altLabel", word("Other"), "en"), text("skos:definition", word("Definition of "), "en"), F.when(F.col("id") >= TOPS, node("skos:broader", parent)),
    ))
    rows = spark.range(n).select(c.alias("s"), F.explode(facts).alias("x")).select("s", "x.*")
    tops = spark.range(min(TOPS, n)).select(F.lit(BASE + "scheme").alias("s"), F.lit("skos:hasTopConcept").alias("p"), c.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), F.lit("").alias("o_dt"))
    return rows.unionByName(tops).select(F.lit(BASE + "graph").alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_lang", "o_dt")


def below(n: int) -> int:
    """Concepts below concept 0."""
    found, low, high = 0, TOPS, TOPS + BRANCHING
    while low < n:
        found += min(high, n) - low
        low, high = low * BRANCHING + TOPS, high * BRANCHING + TOPS
    return found


def above(i: int) -> int:
    return 0 if i < TOPS else 1 + above((i - TOPS) // BRANCHING)


def main(sizes: list[int]) -> None:
    spark = local_session(8, partitions=8, memory="16g")
    for n in sizes:
        folder = tempfile.mkdtemp(prefix="scale-")
        began = time.time()
        tree(spark, n).write.parquet(folder + "/quads")
        took = {"write": round(time.time() - began, 2)}
        quads = spark.read.parquet(folder + "/quads")
        ask = lambda text, q=quads: plain(run(q, text)[1]).count()
        levels = sum(above(i) for i in range(n)) if n <= 1_000_000 else None
        probes = {
            "count_concepts": (lambda: int(plain(run(quads, "SELECT (COUNT(?c) AS ?n) { ?c a skos:Concept }")[1]).collect()[0]["n"]), n),
            "top_concepts_derived": (lambda: ask("SELECT ?c ?l { ?c a skos:Concept ; skos:prefLabel ?l FILTER(LANG(?l) = 'en') FILTER NOT EXISTS { ?c skos:broader ?p } }"), TOPS),
            "search_prefix_all": (lambda: ask("SELECT ?c ?l { ?c skos:prefLabel ?l FILTER(STRSTARTS(LCASE(STR(?l)), 'term16 ')) }"), len(range(16, n, WORDS))),
            "ancestors": (lambda: ask(f"SELECT ?a {{ <{BASE}c{n - 1}> skos:broader+ ?a }}"), above(n - 1)),
            "descendants": (lambda: ask(f"SELECT ?d {{ ?d skos:broader+ <{BASE}c0> }}"), below(n)),
            "relation_closure": (lambda: CoreModel(quads).relations.count(), 4 * (n - TOPS)),
            "closure_pairs": (lambda: Hierarchy(upward(CoreModel(quads).relations), child="a", parent="b").closure_size(10**9).collect()[0]["pairs"], levels),
        }
        for name, (probe, want) in probes.items():
            times = []
            for _ in range(4):
                began = time.time()
                with runs():
                    got = probe()
                times.append(time.time() - began)
            if want is not None and got != want:
                raise AssertionError(f"{name}: {got}, not {want}")
            took[name] = round(statistics.median(times[1:]), 3)
        print(json.dumps({"concepts": n, "quads": quads.count(), "unit": "sec", "probes": took}), flush=True)
        shutil.rmtree(folder)


if __name__ == "__main__":
    main([int(x) for x in sys.argv[1:]] or [100_000, 1_000_000])
