"""Reading the statement store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def graphs_of_kind(graphs: DataFrame, *kinds: str) -> DataFrame:
    return graphs.filter(F.col("kind").isin(*kinds)).select("g").distinct()


def in_graphs(quads: DataFrame, graphs: DataFrame, *kinds: str) -> DataFrame:
    """Statements of registered graphs of the given kinds.  The registry is small, so Spark's own
    size check makes this a broadcast; a large registry falls back to a shuffled semi join."""
    return quads.join(graphs_of_kind(graphs, *kinds), "g", "left_semi")
