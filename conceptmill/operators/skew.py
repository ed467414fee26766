"""Per-key results when a few keys hold most rows.

Rows are put in order of (key, value) over a fixed number of range partitions that also split a run of equal rows.  The rows
of each partition are counted, prefix sums of the counts give each partition's offset, and offset plus place
numbers every row.  Chunks of consecutive numbers, of ``chunk_rows`` at most, are then equal in size within one row whatever the
keys: a hot key fills many chunks and a chunk holds many rare keys.  Each chunk yields one state per key;
only the first and last key of a chunk can go on in a neighbour, so only those states are merged, in order.

The partitions counted are the ordered ones and not those of the input: values are counted once each by comparing the ends
of neighbouring chunks, and that needs the rows of a key in order of their values over all chunks.  Counts and
offsets are a table with one row per partition; nothing that grows with the rows reaches the driver or is broadcast.

Defined cases: a null key is a key of its own; null values are not counted as values; repeated rows all
count as rows and once as a value; ties on (key, value) are split freely as the states do not depend on
their order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import Stage

#: monotonically_increasing_id holds the place within its partition in the low 33 bits
_PLACE = (1 << 33) - 1


def numbered(stage: Stage, rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_no``, their exact place (from 0) in the total order of ``order``; and the number of rows.

    One range shuffle; ties go anywhere.  The ordered rows are written, so counts and numbers see the same
    layout even if executors are lost.  The offsets are one number per partition, broadcast."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order, "_tie")
        .sortWithinPartitions(*order)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    laid, seen = stage.write(laid, "ordered", n=F.count(F.lit(1)))
    part = F.shiftright("_at", 33).alias("_part")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = stage.write(laid.groupBy(part).agg(F.count(F.lit(1)).alias("n")), "counts")
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    out = laid.select("*", part).join(F.broadcast(offsets), "_part")
    return out.withColumn("row_no", F.col("_offset") + F.col("_at").bitwiseAND(F.lit(_PLACE))).drop("_part", "_offset", "_at"), seen["n"]


def chunked(stage: Stage, rows: DataFrame, order: list[str], chunk_rows: int) -> tuple[DataFrame, int]:
    """``rows`` with ``chunk``, equal runs of at most ``chunk_rows`` rows in ``order``, each in one task; and the number of rows."""
    placed, n = numbered(stage, rows, order)
    chunks = max(1, -(-n // chunk_rows))
    low, more = divmod(n, chunks)  # the first ``more`` chunks have one row more
    wide, at = more * (low + 1), F.col("row_no")
    chunk = F.when(at < wide, F.floor(at / (low + 1))).otherwise(F.lit(more) + F.floor((at - wide) / max(low, 1)))
    return placed.withColumn("chunk", chunk).drop("row_no").repartition("chunk"), n


def per_key(rows: DataFrame, key: str, value: str, greatest: str | None = None, chunk_rows: int = 100_000) -> tuple[DataFrame, int]:
    """(key, n_rows, n_values, greatest) for each key, and the number of all rows."""
    stage = Stage(rows.sparkSession, "per-key")
    m = F.col(greatest).cast("long") if greatest else F.lit(None).cast("long")
    lean = rows.select(F.col(key).alias("k"), F.col(value).alias("v"), m.alias("m"))
    placed, n = chunked(stage, lean, ["k", "v"], chunk_rows)
    states = (
        placed.groupBy("chunk", "k", "v").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
        .groupBy("chunk", "k").agg(
            F.sum("n").alias("n_rows"), F.count("v").alias("n_values"), F.max("m").alias("greatest"), F.min("v").alias("first"), F.max("v").alias("last")
        )
    )
    whole = W.partitionBy("chunk")
    states = states.withColumn("edge", F.col("k").isNull() | (F.col("k") == F.min("k").over(whole)) | (F.col("k") == F.max("k").over(whole)))
    states = stage.write(states, "states")
    inner = states.filter("not edge").select("k", "n_rows", "n_values", "greatest")
    ordered = W.partitionBy("k").orderBy("chunk")
    merged = (
        states.filter("edge")
        .withColumn("again", F.coalesce((F.col("first") == F.lag("last").over(ordered)).cast("long"), F.lit(0)))
        .groupBy("k")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_values") - F.col("again")).alias("n_values"), F.max("greatest").alias("greatest"))
    )
    return inner.unionByName(merged), n
