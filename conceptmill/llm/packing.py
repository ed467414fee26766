"""Texts into containers of a fixed number of tokens, in a controlled mixture.

Each source is a queue.  Deficit round-robin serves the queues window by window, a window being the room of
``window_containers`` containers: every queue gets its share of the window, and what a text takes beyond it,
or leaves, is carried on.  Over a whole queue that is a prefix sum: a text belongs to the window in which
the queue's allowance reaches the text's last token.  So the windows of all queues follow from distributed
prefix sums, with the deficits carried exactly over windows and partitions, and no task walks a queue.
When a queue is empty the others share its allowance, since every text has its place; sources without a target follow at the
end.  So the mixture holds, within one text of each queue, as long as all queues last, and ``mix`` reports for each window and
source what it got, what it should have got and the deficit so far.

Within a window, of bounded size, texts are packed best-fit by decreasing size.  A text larger than a container
is divided into full containers and a rest; no other text is divided.

Defined cases: a null or empty text takes no room and is assigned like any other; it counts as one token in the
queue, so that a window's rows are bounded.  Repeated rows are packed once each.  Ties in order are broken by
id.  Without targets all sources form one queue.  An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import Stage

_PLACE_BITS = 33


def running_total(stage: Stage, rows: DataFrame, group: str, order: list[str], weight: str, out: str) -> DataFrame:
    """``rows`` with the inclusive running sum of ``weight`` per ``group``, in ``order``.

    Range partitions by (group, order) split a large group; their sums per group are small, and prefix sums
    over them are the offsets at which each partition goes on."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    laid = stage.write(laid.withColumn("_part", F.shiftright("_at", _PLACE_BITS)), "ordered")
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = laid.groupBy("_part", group).agg(F.sum(weight).alias("_sum")).select("_part", group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    here = W.partitionBy("_part", group).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    return laid.withColumn("_run", F.sum(weight).over(here)).join(offsets, ["_part", group]).withColumn(out, F.col("_run") + F.col("_offset")).drop("_run", "_offset", "_part", "_at")


def schedule(totals: dict[str, int], shares: dict[str, float]) -> list[tuple[str, int, int, float, float]]:
    """(queue, from, to, time at from, time per token): how a queue's own tokens map to the tokens served in all.

    Round-robin with the given shares; queues without a share are served last, in proportion to their size."""
    left = {q: float(n) for q, n in totals.items() if n}
    out: list[tuple[str, int, int, float, float]] = []
    now = 0.0
    for weights in ({q: w for q, w in shares.items() if q in left and w > 0}, {q: left[q] for q in left if shares.get(q, 0) <= 0}):
        active = dict(weights)
        done = dict.fromkeys(active, 0.0)
        while active:
            total = sum(active.values())
            lasts = min(active, key=lambda q: (left[q] * total / active[q], q))
            span = left[lasts] * total / active[lasts]
            for q, w in active.items():
                got = left[q] if q == lasts else span * w / total
                out.append((q, round(done[q]), round(done[q] + got), now, total / w))
                done[q] += got
                left[q] -= got
            now += span
            del active[lasts]
            active = {q: w for q, w in active.items() if left[q] >= 0.5}
    return [x for x in out if x[2] > x[1]]


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(container, place in it) of each item, largest items first into the fullest container that takes them."""
    free_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0  # bit f is set if some container has f tokens free
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    made = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = room >> size
        if fits:
            f = size + ((fits & -fits).bit_length() - 1)
            bin_ = free_at[f].pop()
            if not free_at[f]:
                room &= ~(1 << f)
        else:
            bin_, f = made, capacity
            made += 1
        out[i] = (bin_, capacity - f)
        free_at[f - size].append(bin_)
        room |= 1 << (f - size)
    return out


def pack(docs: DataFrame, id: str, tokens: str, source: str, targets: DataFrame, capacity: int = 2048, window_containers: int = 256) -> DataFrame:
    """(id, source, piece, first_token, n_tokens, window, slot, place): window and slot name the container.

    ``targets`` (source, target_share) is the wanted mixture: one row per source, read on the driver."""
    stage = Stage(docs.sparkSession, "packing")
    shares = {r["source"]: float(r["target_share"]) for r in targets.select("source", "target_share").dropna().collect()}
    queue = F.when(F.col(source).isin(list(shares)), F.col(source)).otherwise("") if shares else F.lit("")
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n"), queue.alias("queue"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity).cast("long")))
    items = rows.select("id", "source", "queue", "n", first.alias("first_token"))
    items = items.select(
        "id", "source", "queue", (F.col("first_token") / capacity).cast("int").alias("piece"), "first_token",
        F.least(F.col("n") - F.col("first_token"), F.lit(capacity)).alias("n_tokens"),
    )
    items = items.withColumn("_weight", F.greatest("n_tokens", F.lit(1))).withColumn("_mix", F.xxhash64("id")).withColumn("_row", F.monotonically_increasing_id())
    items = stage.write(items, "items")
    totals = {r["queue"]: r["t"] for r in items.groupBy("queue").agg(F.sum("_weight").alias("t")).collect()}  # one row per target
    plan = schedule(totals, shares)
    spark = docs.sparkSession
    served = running_total(stage, items, "queue", ["_mix", "id", "piece", "_row"], "_weight", "_own")
    parts = F.broadcast(spark.createDataFrame(plan, "queue string, _from long, _to long, _time double, _rate double")) if plan else None
    if parts is None:
        return items.select(F.col("id").alias(id), "source", "piece", "first_token", "n_tokens", F.lit(0).cast("long").alias("window"), F.lit(0).alias("slot"), F.lit(0).alias("place"))
    time = F.col("_time") + (F.col("_own") - F.col("_from")) * F.col("_rate")
    room = capacity * window_containers
    windows = served.join(parts, "queue").filter("_own > _from and _own <= _to").withColumn("window", F.greatest(F.ceil(time / room) - 1, F.lit(0)).cast("long"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_mix", "id", "piece"], ascending=[False, True, True, True], kind="stable")
        at = best_fit(pdf["n_tokens"].tolist(), capacity)
        return pdf.assign(slot=[a for a, _ in at], place=[b for _, b in at])[["id", "source", "piece", "first_token", "n_tokens", "window", "slot", "place"]]

    kind = items.schema["id"].dataType.simpleString()
    lean = windows.select("id", "source", "piece", "first_token", "n_tokens", "window", "_mix")
    return lean.groupBy("window").applyInPandas(fill, f"id {kind}, source string, piece int, first_token long, n_tokens long, window long, slot int, place int").withColumnRenamed("id", id)


def mix(packed: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """(window, source, target_share, n_tokens, reached_share, deficit, all_last) for each window of ``pack`` and each source with a target
    and texts.  Targets are scaled to sum to 1 over these sources.  ``deficit`` is the tokens that the source should have got up to the end of
    the window less those it got; ``all_last`` tells whether no queue was empty before the end of the window."""
    stage = Stage(packed.sparkSession, "mix")
    got = packed.groupBy("window", F.col(source).alias("source")).agg(F.sum("n_tokens").alias("n_tokens"))
    got = stage.write(got.filter("n_tokens > 0"), "got")
    share = {r["source"]: float(r["target_share"]) for r in targets.select("source", "target_share").dropna().collect() if r["target_share"] > 0}
    ends = {r["source"]: r["w"] for r in got.filter(F.col("source").isin(list(share))).groupBy("source").agg(F.max("window").alias("w")).collect()}  # one row per target
    share = {q: share[q] / sum(share[x] for x in ends) for q in sorted(ends)}
    kinds = F.array(*[F.struct(F.lit(q).alias("source"), F.lit(w).alias("target_share")) for q, w in share.items()])
    if not share:
        kinds = F.array().cast("array<struct<source:string,target_share:double>>")
    all_ = got.groupBy("window").agg(F.sum("n_tokens").alias("all_tokens"))
    grid = all_.select("window", "all_tokens", F.explode(kinds).alias("x")).select("window", "all_tokens", "x.*")
    rows = grid.join(got, ["window", "source"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    rows = rows.withColumn("_over", F.col("target_share") * F.col("all_tokens") - F.col("n_tokens"))
    rows = running_total(stage, rows, "source", ["window"], "_over", "deficit")
    return rows.select(
        "window", "source", "target_share", "n_tokens", (F.col("n_tokens") / F.col("all_tokens")).alias("reached_share"), "deficit",
        (F.col("window") < min(ends.values(), default=0)).alias("all_last"),
    )
