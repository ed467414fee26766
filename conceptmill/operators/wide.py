"""Attribute-value rows into one wide, typed row per entity.

Cells, the rows of one entity and attribute, are reduced first with partial aggregation to a fixed state (any
invalid value, least and greatest canonical value), so neither a hot entity nor a hot cell reaches one task
in rows.  Attributes are divided into blocks of ``block`` columns; the cells are written once, bucketed by
entity and partitioned by block.  What is done to a cell follows from a table of the attributes, so only the pivots grow with their
number.  Each block is pivoted on its buckets and the blocks are joined on the same
buckets: no shuffle after the write, however many blocks there are.

Defined cases
-------------
Statements with a null subject, predicate or object are ignored.  Repeated rows count once.  A cell that holds an
invalid value, or two different ones, is null in its typed column and named in ``unfit``.  Multi-valued
attributes become sorted arrays of distinct strings; a cell of more than ``max_values`` values would make
one row unbounded, so it is null in the array column, named in ``long_cells``, and all its values are
rows of ``long_values()``.  A date keeps the day that is written, whatever its zone; of equal dates with different days, the
least.  A valid value that its typed column cannot hold is null, one that it cannot hold exactly is rounded; both are
named in ``inexact`` and are rows of ``untyped()``.  Attributes that ``columns`` does not list are left out.  Entities are the subjects
of type ``entity_type`` and all others with a listed attribute.  Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.xsd import canonical, inexact, trimmed, typed, written_day
from ..staging import Stage

_NO_BLOCK = -1
#: blocks at most, by default; each is one join of the wide table
_BLOCKS = 32
#: attributes whose table is broadcast; they are on the driver already, as names of columns
_SENT = 100_000
_MARKS = ("unfit", "inexact", "long")


@dataclass(frozen=True)
class Attribute:
    p: str
    column: str
    datatype: str
    single: bool


def attributes(columns: DataFrame) -> list[Attribute]:
    """The wide table's schema; it becomes column names, so it is read on the driver."""
    rows = columns.select("p", "column_name", "datatype", "single_valued").dropna().distinct().collect()
    return sorted((Attribute(r["p"], r["column_name"], r["datatype"], r["single_valued"]) for r in rows), key=lambda a: a.p)


class WideTable:
    def __init__(self, statements: DataFrame, attrs: list[Attribute], entity_type: str = "skos:Concept", block: int | None = None, max_values: int = 10_000):
        self.spark = statements.sparkSession
        self.stage = Stage(self.spark, "wide")
        self.attrs = attrs
        block = block or max(8, -(-len(attrs) // _BLOCKS))
        rows = statements.select("s", "p", "o").dropna()
        self._blocks = blocks = [attrs[i : i + block] for i in range(0, len(attrs), block)]
        kinds = self.spark.createDataFrame([(a.p, a.datatype, a.single, i) for i, part in enumerate(blocks) for a in part], "p string, datatype string, single boolean, block int")
        kinds = F.broadcast(kinds) if len(attrs) <= _SENT else kinds
        many = any(not a.single for a in attrs)
        listed = rows.join(kinds, "p")

        # single-valued cells: a state of five fields whatever the number of rows
        canon, day = F.lit(None).cast("string"), F.lit(None).cast("string")
        for dt in sorted({a.datatype for a in attrs if a.single}):
            canon = F.when(F.col("datatype") == dt, canonical(F.col("t"), dt)).otherwise(canon)
            day = F.when(F.col("datatype") == dt, written_day(F.col("t"))) if dt == "xsd:date" else day
        # blanks around a value count in strings only
        text = F.when(F.col("datatype") == "xsd:string", F.col("o")).otherwise(trimmed(F.col("o")))
        state = listed.filter("single").withColumn("t", text).select("s", "p", "datatype", "block", canon.alias("c"), day.alias("day"))
        state = state.groupBy("s", "p", "datatype", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bool_or(F.col("c").isNull()).alias("bad"), F.min("day").alias("day"))
        one = ~F.col("bad") & (F.col("lo") == F.col("hi"))
        cells = state.select("s", "p", F.when(one, F.coalesce("day", "lo")).alias("v"), "datatype", (~one).alias("unfit"), F.lit(False).alias("long"), "block")

        # multi-valued cells: distinct values; cells beyond the bound keep a marker and their rows stand apart
        no, none = F.lit(False), F.lit(None).cast("string")
        values = listed.filter("not single").select("s", "p", F.col("o").alias("v"), "block").distinct()
        self._values = values.select("s", "p", "v")
        self._long = None
        if many:
            long = values.groupBy("s", "p", "block").count().filter(F.col("count") > max_values).select("s", "p", "block")
            self._long = self.stage.write(long, "long")  # at most rows / max_values cells
            kept = values.join(self._long.select("s", "p"), ["s", "p"], "left_anti").select("s", "p", "v", none.alias("datatype"), no.alias("unfit"), no.alias("long"), "block")
            marks = self._long.select("s", "p", none.alias("v"), none.alias("datatype"), no.alias("unfit"), F.lit(True).alias("long"), "block")
            cells = cells.unionByName(kept).unionByName(marks)
        found = rows.filter((F.col("p") == "rdf:type") & (F.col("o") == entity_type)).select("s").distinct()
        cells = cells.unionByName(found.select("s", none.alias("p"), none.alias("v"), none.alias("datatype"), no.alias("unfit"), no.alias("long"), F.lit(_NO_BLOCK).alias("block")))
        lost = F.lit(False)
        for dt in sorted({a.datatype for a in attrs if a.single}):
            lost = F.when(F.col("datatype") == dt, F.coalesce(inexact(F.col("v"), dt), F.lit(False))).otherwise(lost)
        cells = cells.select("s", "p", "v", "unfit", "long", (F.col("v").isNotNull() & lost).alias("inexact"), "block")

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._table = self.stage.own(f"cells_{uuid.uuid4().hex[:12]}")
        (
            cells.repartition(n, "s").write.format("parquet").option("compression", "zstd")
            .option("path", f"{self.stage.folder}/cells").partitionBy("block").bucketBy(n, "s").saveAsTable(self._table)
        )

    def _block(self, i: int) -> DataFrame:
        aggs = []
        for a in self._blocks[i]:
            own = F.when(F.col("p") == a.p, F.col("v"))
            aggs.append(F.max(own).alias(a.column) if a.single else F.array_sort(F.collect_set(own)).alias(a.column))
        for mark in _MARKS:
            aggs.append(F.collect_list(F.when(F.col(mark), F.col("p"))).alias(f"_{mark}{i}"))
        return self.spark.table(self._table).filter(F.col("block") == i).groupBy("s").agg(*aggs)

    def wide(self) -> DataFrame:
        """(s, one typed column per attribute, unfit array<string>, inexact array<string>, long_cells array<string>)."""
        out = self.spark.table(self._table).select("s").distinct()
        for i in range(len(self._blocks)):
            out = out.join(self._block(i), "s", "left")
        none = F.array().cast("array<string>")
        named = {m: F.concat(none, *[F.coalesce(f"_{m}{i}", none) for i in range(len(self._blocks))]) for m in _MARKS}
        cols = []
        for i, part in enumerate(self._blocks):
            long = F.coalesce(f"_long{i}", none)
            for a in part:
                whole = F.when(~F.array_contains(long, a.p), F.coalesce(F.col(a.column), none))
                cols.append((typed(F.col(a.column), a.datatype) if a.single else whole).alias(a.column))
        return out.select("s", *cols, named["unfit"].alias("unfit"), named["inexact"].alias("inexact"), named["long"].alias("long_cells"))

    def unfit(self) -> DataFrame:
        """(s, p): cells that cannot be filled with one value."""
        return self.wide().select("s", F.explode("unfit").alias("p"))

    def untyped(self) -> DataFrame:
        """(s, p, canonical): cells with one valid value that is null or rounded in its typed column.  Times are
        canonical as seconds from 1970, dates as their days, years of more than 12 digits as written."""
        return self.spark.table(self._table).filter("inexact").select("s", "p", F.col("v").alias("canonical"))

    def long_values(self) -> DataFrame:
        """(s, p, v): all values of the cells too long for one row."""
        if self._long is None:
            return self._values
        return self._values.join(self._long.select("s", "p"), ["s", "p"], "left_semi")
