"""A selection of texts in which each source holds its target share of all tokens.

The largest total for which no source needs a text more than ``max_repeats`` times follows from the sources'
token totals.  It sets how often a source is used: some whole times, and a fraction of its texts once more.
That fraction is drawn by the cube method: inclusion probabilities, equal within a source, move through the
null space of two constraints, the source's tokens and its number of texts, until all but two texts of each block
are decided.  Blocks are bounded and hashed by text, so a large source is spread over many tasks; the
undecided texts go on to the next level, until one block per source is left.  That leaves at most two texts of a source, the landing
problem: of their outcomes that keep the source's number of texts within 1 of the expected one, the one nearest to its tokens is
taken.  So a source misses its tokens by less than one text, and all other decisions are the flight's; ``reached()`` has the
expected tokens and texts beside the reached ones.

Random directions are seeded by block, so a repeated task decides alike.

Defined cases: null and empty texts, and texts of sources without a target, are not selected.  A source of a
target that has no tokens is reported with nothing reached; the others keep their proportions to each other.
Repeated rows are texts of their own.  A target with a null or non-positive share or repeats is ignored.  No
texts give no selection.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Stage

_EPS = 1e-9


def flight(xs: list[float], ps: list[float], seed: int) -> list[float]:
    """Move ``ps`` to 0 or 1, but for at most two, keeping their sum and their sum weighted by ``xs``."""
    rnd = random.Random(seed)
    ps = list(ps)
    open_: list[int] = []
    for i, p in enumerate(ps):
        if _EPS < p < 1 - _EPS:
            open_.append(i)
        while len(open_) == 3 or (len(open_) == 2 and xs[open_[0]] == xs[open_[1]]):
            if len(open_) == 3:
                a, b, c = (xs[j] for j in open_)
                u = (b - c, c - a, a - b)
                if not any(u):
                    u = (1.0, -1.0, 0.0)
            else:
                u = (1.0, -1.0)
            ahead = min((1 - ps[j]) / d if d > 0 else ps[j] / -d for j, d in zip(open_, u) if d)
            back = min(ps[j] / d if d > 0 else (1 - ps[j]) / -d for j, d in zip(open_, u) if d)
            step = ahead if rnd.random() * (ahead + back) < back else -back
            for j, d in zip(open_, u):
                ps[j] += step * d
                if ps[j] < _EPS:
                    ps[j] = 0.0
                elif ps[j] > 1 - _EPS:
                    ps[j] = 1.0
            open_ = [j for j in open_ if 0 < ps[j] < 1]
    return ps


def land(xs: list[float], ps: list[float]) -> list[float]:
    """Decide what flight left open, at most two texts: their number stays within 1 of its expectation, the tokens are as near as that allows."""
    open_ = [i for i, p in enumerate(ps) if 0 < p < 1]
    texts, tokens = sum(ps[i] for i in open_), sum(xs[i] * ps[i] for i in open_)
    ways = [[float(k >> b & 1) for b in range(len(open_))] for k in range(1 << len(open_))]
    near = [w for w in ways if abs(sum(w) - texts) < 1 - _EPS]
    best = min(near, key=lambda w: (abs(sum(xs[i] * d for i, d in zip(open_, w)) - tokens), abs(sum(w) - texts)))
    out = list(ps)
    for i, d in zip(open_, best):
        out[i] = d
    return out


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    max_repeats: int
    supply_tokens: int
    supply_texts: int
    whole: int
    fraction: float


def shares(totals: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Share]:
    """How often each source is used; ``total`` tokens in all, by default as many as the repeats allow."""
    good = [(s, w, r) for s, w, r in targets if s is not None and w and w > 0 and r and r > 0]
    most = min((totals[s][0] * r / w for s, w, r in good if totals.get(s, (0, 0))[0]), default=0.0)
    size = most if total is None else min(total, most)
    out = []
    for s, w, r in sorted(good):
        tokens, texts = totals.get(s, (0, 0))
        times = min(w * size / tokens, r) if tokens else 0.0
        whole = int(times + _EPS)
        out.append(Share(s, w, r, tokens, texts, whole, max(0.0, times - whole)))
    return out


def _flier(level: int, blocks: dict[str, int]):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        xs = pdf["n"].astype(float).tolist()
        seed = hash((int(pdf["row"].iloc[0]), level, len(xs)))  # of integers, so alike in every process
        ps = flight(xs, pdf["p"].tolist(), seed)
        return pdf.assign(p=land(xs, ps) if blocks[pdf["source"].iloc[0]] == 1 else ps)[["id", "source", "n", "row", "p"]]

    return fly


class Mixture:
    def __init__(self, docs: DataFrame, id: str, tokens: str, source: str, targets: DataFrame, total: float | None = None, block_rows: int = 2000):
        self.spark = docs.sparkSession
        self.stage = Stage(self.spark, "mixture")
        self.id = id
        wanted = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()]  # the mixture itself
        names = [s for s, _, _ in wanted if s is not None]
        rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("n"))
        rows = rows.filter((F.col("n") > 0) & F.col("source").isin(names)).withColumn("row", F.monotonically_increasing_id())
        self.rows = self.stage.write(rows, "texts")
        got = self.rows.groupBy("source").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).collect()  # one row per target
        self.plan = shares({r["source"]: (r["t"], r["k"]) for r in got}, wanted, total)
        self._draw(block_rows)

    def _draw(self, block_rows: int) -> None:
        fraction = {s.source: s.fraction for s in self.plan if s.fraction > _EPS}
        blocks = {s.source: max(1, -(-s.supply_texts // block_rows)) for s in self.plan}
        kept = self.rows.filter(F.col("source").isin(list(fraction)))
        p = F.lit(0.0)
        for s, f in fraction.items():
            p = F.when(F.col("source") == s, F.lit(f)).otherwise(p)
        open_ = kept.select("id", "source", "n", "row", p.alias("p"))
        decided: list[DataFrame] = []
        level = 0
        while True:
            last = all(b == 1 for s, b in blocks.items() if s in fraction)
            of = F.lit(1)
            for s, b in blocks.items():
                of = F.when(F.col("source") == s, F.lit(b)).otherwise(of)
            open_ = open_.withColumn("block", F.pmod(F.xxhash64("id", "row", F.lit(level)), of).cast("int"))

            kind = self.rows.schema["id"].dataType.simpleString()
            t = self.stage.write(open_.groupBy("source", "block").applyInPandas(_flier(level, blocks), f"id {kind}, source string, n long, row long, p double"), "flight")
            decided.append(t.filter("p >= 1"))
            if last:
                break
            open_ = t.filter("p > 0 and p < 1")
            blocks = {s: max(1, -(-2 * b // block_rows)) for s, b in blocks.items()}
            level += 1
        drawn = decided[0]
        for x in decided[1:]:
            drawn = drawn.unionByName(x)
        whole = F.lit(0)
        for s in self.plan:
            whole = F.when(F.col("source") == s.source, F.lit(s.whole)).otherwise(whole)
        extra = drawn.select("row", F.lit(1).alias("extra"))
        out = self.rows.join(extra, "row", "left").select("id", "source", "n", (whole + F.coalesce("extra", F.lit(0))).alias("copies"))
        self._selected = self.stage.write(out.filter("copies > 0"), "selected")

    def selection(self) -> DataFrame:
        """(id, source, n_tokens, copies) of the texts used."""
        return self._selected.select(F.col("id").alias(self.id), "source", F.col("n").alias("n_tokens"), "copies")

    def reached(self) -> DataFrame:
        """(source, target_share, reached_share, n_tokens, n_texts, most_copies, max_repeats, supply_tokens, expected_tokens, expected_copies, n_copies)
        for each target; copies are texts counted as often as they are used."""
        plan = self.spark.createDataFrame(
            [(s.source, s.target, s.max_repeats, s.supply_tokens, (s.whole + s.fraction) * s.supply_tokens, (s.whole + s.fraction) * s.supply_texts) for s in self.plan],
            "source string, target_share double, max_repeats int, supply_tokens long, expected_tokens double, expected_copies double",
        )
        used = self._selected.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies"), F.sum("copies").alias("n_copies"))
        all_ = used.agg(F.sum("n_tokens").alias("all_tokens"))
        return (
            plan.join(used, "source", "left").crossJoin(all_)  # one row
            .select(
                "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", "supply_tokens",
                "expected_tokens", "expected_copies", F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
            )
        )
