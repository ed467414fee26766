import random

import pytest
from pyspark.sql import functions as F

from conceptmill.operators import walks
from conceptmill.operators.skew import chunked, per_key
from conceptmill.staging import Stage


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_per_key_matches_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    rows = [("hot", f"v{rnd.randrange(6)}", rnd.choice([None, 1, 9]), "x") for _ in range(60)]
    rows += [("hot2", "same", 4, "x")] * 25
    rows += [(f"k{rnd.randrange(9)}", rnd.choice([None, "a", "b"]), rnd.randrange(5), "x") for _ in range(40)]
    rows += [(None, "n", 1, "x"), (None, None, 2, "x"), ("", "", None, "x")]
    df = spark.createDataFrame(rows, "key string, val string, depth int, chunk string")
    got, n = per_key(df, "key", "val", "depth", chunk_rows=chunk)
    assert n == len(rows)
    want = {}
    for k, v, d, _ in rows:
        w = want.setdefault(k, [0, set(), []])
        w[0] += 1
        w[1] |= {v} - {None}
        w[2] += [d] if d is not None else []
    assert {tuple(r) for r in got.collect()} == {(k, a, len(b), max(c, default=None)) for k, (a, b, c) in want.items()}
    assert got.count() == len(want)


@pytest.mark.parametrize("rows, most", [(100, 7), (1000, 33), (64, 64), (65, 64), (3, 1)])
def test_chunks_are_equal(spark, rows, most):
    """Within one row, whatever the keys; and in order."""
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 11}", i % 5) for i in range(rows)], "k string, v int")
    got, n = chunked(Stage(spark, "test"), df, ["k", "v"], most)
    size, ends = {}, {}
    for r in got.collect():
        size[r["chunk"]] = size.get(r["chunk"], 0) + 1
        ends.setdefault(r["chunk"], []).append((r["k"], r["v"]))
    assert n == rows and sum(size.values()) == rows and set(size) == set(range(-(-rows // most)))
    assert max(size.values()) <= most and max(size.values()) - min(size.values()) <= 1
    assert all(max(ends[i]) <= min(ends[i + 1]) for i in range(len(size) - 1))


def test_empty(spark):
    got, n = per_key(spark.createDataFrame([], "k string, v string"), "k", "v")
    assert n == 0 and got.collect() == []


def test_siblings_of_a_large_parent_are_made_in_cells(spark):
    up = {f"k{i}": {"a"} | ({"b"} if i % 2 else set()) | ({"c"} if i % 3 == 0 else set()) for i in range(11)} | {"x": {"b"}, "y": {"c"}, "z": {"d"}}
    links = [("g", *x, "asserted") for c, ps in up.items() for p in ps for x in ((c, "skos:broader", p), (p, "skos:narrower", c))]
    relations = spark.createDataFrame(links + [("h", "k0", "skos:broader", "a", "asserted"), ("h", "a", "skos:narrower", "k0", "asserted")], "g string, s string, p string, o string, origin string")
    asked = ["k0", "k1", "k2", "k3", "k4", "k6", "x", "z", "none"]
    origins = spark.createDataFrame([(g, x) for g in "gh" for x in asked] + [("g", "k0")], "g string, origin string")
    want = sorted(("g", o, s, " ".join(sorted(up[o] & up[s]))) for o in asked if o in up for s in up if s != o and up[o] & up[s])
    for cell in (2, 512):
        got = walks.siblings(relations, origins, joined=" ", cell=cell)
        assert sorted(map(tuple, got.select("g", "origin", "sibling", "parents").collect())) == want
    got = walks.siblings(relations, origins, cell=2).filter("parents = array('a') and origin in ('k0', 'k2')")
    assert got.groupBy(F.spark_partition_id()).count().count() > 1  # the pairs of one parent are in several tasks
