"""Groups of nodes linked directly or indirectly, graph by graph.

Each node points to the lowest node it knows of.  In a round it learns the lowest that its neighbours point to, tells the node
it points to as well, and then points where that one points.  Distances double, so rounds are logarithmic; each is two
aggregations and two joins.  A hot node's links are split by Spark's skew-join handling and reduced before the shuffle.

Defined cases: links with a null end are ignored, a node linked with itself only is a group of one, repeated and
reversed links count once, no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Stage


def linked(links: DataFrame) -> DataFrame:
    """(g, lowest, concept) for each end of the links (g, a, b)."""
    stage = Stage(links.sparkSession, "linked")
    links = stage.write(links.select("g", "a", "b").dropna().distinct(), "links")
    ends = links.select("g", F.explode(F.array("a", "b")).alias("name")).distinct()
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = stage.write(ends.repartitionByRange(n, "g", "name").sortWithinPartitions("g", "name").withColumn("id", F.monotonically_increasing_id()), "nodes")
    at = lambda end, id_: nodes.select("g", F.col("name").alias(end), F.col("id").alias(id_))
    one = links.join(at("a", "u"), ["g", "a"]).join(at("b", "v"), ["g", "b"]).filter("u <> v").select("u", "v")
    edges = stage.write(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    points = nodes.select(F.col("id").alias("u"), F.col("id").alias("to"))
    while True:
        heard = edges.join(points.select(F.col("u").alias("v"), F.col("to").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        told = points.join(heard, "u", "left").select("u", "to", F.least("to", "m").alias("m"))
        told = stage.write(told, "told")
        rows = told.select("u", "to", "m").unionByName(told.select(F.col("to").alias("u"), F.lit(None).cast("long").alias("to"), "m"))
        low = rows.groupBy("u").agg(F.max("to").alias("was"), F.min("m").alias("m"))
        jump = told.select(F.col("u").alias("m"), F.col("m").alias("next"))
        new, seen = stage.write(
            low.join(jump, "m").select("u", "was", F.least("m", "next").alias("to")), "points", moved=F.sum((F.col("to") < F.col("was")).cast("long"))
        )
        points = new.select("u", "to")
        if not seen["moved"]:
            break
    name = nodes.select(F.col("id").alias("to"), F.col("name").alias("lowest"))
    return points.join(nodes.withColumnRenamed("id", "u"), "u").join(name, "to").select("g", "lowest", F.col("name").alias("concept"))
