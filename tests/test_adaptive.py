"""The operators for skewed data with adaptive execution, its skew splitting at work on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from conceptmill.operators.hierarchy import Hierarchy
from conceptmill.operators.linked import linked
from conceptmill.operators.skew import per_key

from .test_hierarchy import brute

SPLIT = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.shuffle.partitions": "4",
}


@pytest.fixture
def split(spark):
    old = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_skewed_join_is_split(split):
    """What the README relies on: a hot key's rows go to several tasks."""
    rows = split.range(60_000).select(F.when(F.col("id") % 10 < 9, F.lit(7)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    df = rows.join(split.range(100).select(F.col("id").alias("k"), F.lit(1).alias("x")), "k")
    assert df.count() == sum(1 for i in range(60_000) if i % 10 < 9 or i < 100)
    df.write.format("noop").mode("overwrite").save()
    plan = df.select("v", "x")
    plan.collect()
    assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()


def test_per_key(split):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(50)}", f"v{rnd.randrange(300)}") for _ in range(4000)]
    got, n = per_key(split.createDataFrame(rows, "k string, v string"), "k", "v", chunk_rows=500)
    assert n == 4000 and {(r["k"], r["n_rows"], r["n_values"]) for r in got.collect()} == {(k, sum(x == k for x, _ in rows), len({v for x, v in rows if x == k})) for k in {x for x, _ in rows}}


def test_hierarchy_with_a_hot_parent(split):
    links = [("g", f"n{i:04}", "hub") for i in range(900)] + [("g", "hub", "top"), ("g", "top", "hub"), ("g", "leaf", "n0001")] + [("g", f"c{i:02}", f"c{i + 1:02}") for i in range(30)]
    h = Hierarchy(split.createDataFrame(links, "g string, child string, parent string"))
    loops, below, paths = brute(links)
    assert {tuple(r) for r in h.loops().collect()} == loops
    assert {tuple(r) for r in h.descendants().collect()} == below
    assert sorted(tuple(r) for r in h.paths().collect()) == paths


def test_linked_with_a_hot_node(split):
    links = [("g", "hub", f"n{i:04}") for i in range(800)] + [("g", f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    got = {(r["concept"], r["lowest"]) for r in linked(split.createDataFrame(links, "g string, a string, b string")).collect()}
    assert got == {("hub", "hub")} | {(f"n{i:04}", "hub") for i in range(800)} | {(f"c{i:03}", "c000") for i in range(61)}
