"""Groups of directly or indirectly linked records.

Large-star and small-star rewrites alternate until the links are stars around each group's lowest member.
The lowest neighbour of every node comes from a partial aggregation; it is joined back to the links.  A
node with more than ``hot_links`` links would fill one join task, so such nodes, of which there are at most
links / ``hot_links``, are joined by broadcast and the rest by shuffle.  They are counted first; beyond ``_SENT`` of them
the join is Spark's own, which splits skewed keys.  Number of rounds: logarithmic.

Defined cases: links with a null end and links of a node with itself are ignored, repeated and reversed links
count once, extra columns are ignored, no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Stage


#: hot nodes that are broadcast
_SENT = 100_000


def _with_lowest(stage: Stage, links: DataFrame, hot_links: int) -> tuple[DataFrame, DataFrame]:
    """``links`` (u, v) with ``m``, the lowest of u and its neighbours."""
    lowest, seen = stage.write(
        links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"),
        "lowest", hot=F.count_if(F.col("n") > hot_links),
    )
    if not 0 < seen["hot"] <= _SENT:
        return links.join(lowest.select("u", "m"), "u"), lowest
    hot = lowest.filter(F.col("n") > hot_links).select("u", F.col("m").alias("hot_m"))
    rest = lowest.filter(F.col("n") <= hot_links).select("u", "m")
    marked = links.join(F.broadcast(hot), "u", "left")
    cool = marked.filter("hot_m is null").drop("hot_m").join(rest, "u")
    return cool.unionByName(marked.filter("hot_m is not null").select("u", "v", F.col("hot_m").alias("m"))), lowest


def groups(links: DataFrame, a: str, b: str, hot_links: int = 1_000_000) -> DataFrame:
    """(member, group_low) for every record linked with another one."""
    stage = Stage(links.sparkSession, "groups")
    x, y = F.col(a), F.col(b)
    # a link is kept as (v, m) with v > m
    now = stage.write(links.filter(x != y).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("m")).distinct(), "links")
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.select(F.col("m").alias("u"), "v"))
        large, low1 = _with_lowest(stage, both, hot_links)
        large = stage.write(large.filter("v > u").select("v", "m").distinct(), "large")
        small, low2 = _with_lowest(stage, large.select(F.col("v").alias("u"), F.col("m").alias("v")), hot_links)
        new = small.select(F.explode(F.array("u", "v")).alias("v"), "m").filter("v <> m").distinct()
        new = stage.write(new, "small")
        stage.drop(now, low1, large, low2)
        now = new
        ends = now.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        ends = ends.unionByName(now.select(F.col("m").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        loose = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or (below = 1 and above = 1)")
        if loose.isEmpty():
            break
    return now.select(F.col("v").alias("member"), F.col("m").alias("group_low")).unionByName(
        now.select(F.col("m").alias("member"), F.col("m").alias("group_low")).distinct()
    )
