"""What changed between two versions of a graph, concept by concept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skos import CoreModel
from .walks import retirements


def concepts(statements: DataFrame) -> DataFrame:
    """(g, node, label, parents, retired) of each concept."""
    m = CoreModel(statements)
    parents = m.relations.filter("p = 'skos:broader'").groupBy("g", F.col("s").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("o")), " ").alias("parents"))
    gone = retirements(statements).filter("retired").select("g", "node", F.lit(True).alias("retired"))
    out = m.classes.filter("class = 'skos:Concept'").select("g", "node")
    out = out.join(m.display_labels.withColumnRenamed("text", "label"), ["g", "node"], "left").join(parents, ["g", "node"], "left").join(gone, ["g", "node"], "left")
    return out.select("g", "node", "label", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("retired", F.lit(False)).alias("retired"))


def concept_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(g, node, change, was, now) with change one of added, removed, relabelled, moved, deprecated, reinstated."""
    a, b = concepts(before).alias("a"), concepts(after).alias("b")
    both = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.node") == F.col("b.node")), "full")
    old, new = F.col("a.node").isNull(), F.col("b.node").isNull()
    here = ~old & ~new

    def change(when, name: str, was, now):
        return F.when(when, F.struct(F.lit(name).alias("change"), was.cast("string").alias("was"), now.cast("string").alias("now")))

    la, lb = F.col("a.label"), F.col("b.label")
    found = F.array(
        change(old, "added", F.lit(None), lb), change(new, "removed", la, F.lit(None)), change(here & ~la.eqNullSafe(lb), "relabelled", la, lb),
        change(here & (F.col("a.parents") != F.col("b.parents")), "moved", F.col("a.parents"), F.col("b.parents")),
        change(here & ~F.col("a.retired") & F.col("b.retired"), "deprecated", F.lit(None), F.lit(None)), change(here & F.col("a.retired") & ~F.col("b.retired"), "reinstated", F.lit(None), F.lit(None)),
    )
    rows = both.select(F.coalesce("a.g", "b.g").alias("g"), F.coalesce("a.node", "b.node").alias("node"), F.explode(F.array_compact(found)).alias("c"))
    return rows.select("g", "node", "c.*")
