"""Full hierarchies from parent-child rows.

Leaves are peeled from below, round by round; the round in which a node goes is its level.  When a round peels nothing,
what is left are loops and all that lies above them: loops are found there, contracted, and the peeling goes on to the
top.  Peeled nodes send their descendant lists to their parents, level by level; in reverse peel order the paths and
depths go from the tops to the leaves.  All of it is distributed, at every size.

Shape of the work
-----------------
* Nodes get ordered 64-bit ids once, so each round moves two longs per link.
* A node survives a round if a child of it survived the round before.  So a round is one join of the remaining links with the
  survivors and one aggregation.  Rounds chain: as many run as one job as leave at least half of the rows that the job starts
  with, one at the wide bottom and up to ``most_rounds`` in the long thin top.  There links are first joined to hops of up to eight
  links, as long as that makes no more than proportionally more of them, and a join peels that many levels, exactly.
* The levels of one job are a batch, and so are all those of the thin top.  Lists and paths move from batch to batch through one table, partitioned by the batch
  that receives.  A batch of one level joins what it got with its links.  A batch of several levels first closes the links
  within it by doubling; those pairs are part of the result, so that is no more than the result.  Then it sends on, and its partition is dropped.
* Descendants and paths are rows, never arrays per root: a root with a third of all concepts below it
  is spread over all tasks.  Joins on one hot parent are split by Spark's skew-join handling.
* A list is sent on when all children of its node have sent, as a distinct set, so its length is the size of the subtree.
  The sizes themselves are not added up on the way: with several parents to a concept, the sum of the children's
  sizes counts twice what lies below two of them.
* Loops are found by colouring (``strongly_connected``) in what the peeling does not remove.

Defined cases
-------------
Rows with a null scope, child or parent are no links.  Repeated rows count once.  A node linked to
itself is a loop of one.  Loops are contracted to their lowest member: paths and descendant lists name
that member, and ``loops()`` lists all members.  ``member_paths()``, ``member_descendants()`` and
``member_concepts()`` have rows for every member, with what holds for its loop.  An empty table gives empty results.  Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Stage

#: receiver of what is complete
_DONE = -1
_STEP = " > "


def links_of(quads: DataFrame, up: tuple[str, ...], down: tuple[str, ...]) -> DataFrame:
    """(g, child, parent) from statements: ``up`` predicates put the object above the subject, ``down`` ones below."""
    is_up = F.col("p").isin(*up)
    return quads.filter(F.col("p").isin(*up, *down) & (F.col("o_kind") != "literal")).select(
        "g",
        F.when(is_up, F.col("s")).otherwise(F.col("o")).alias("child"),
        F.when(is_up, F.col("o")).otherwise(F.col("s")).alias("parent"),
    )


#: links joined to one hop at most
_HOP = 16
#: levels over which half of the nodes go, from which on hops are used
_THIN = 4


class ClosureTooLarge(RuntimeError):
    """A bound on the closure was met; the answer is refused."""


@dataclass(frozen=True)
class Batch:
    """Levels ``low`` to ``high``, peeled in one job; ``nodes`` (v, k)."""

    low: int
    high: int
    nodes: DataFrame


def hops(stage: Stage, edges: DataFrame, most: int = _HOP) -> tuple[DataFrame, int]:
    """(c, p, w): pairs joined by a walk of exactly w links, and the greatest w.  Links are doubled twice in a job, up to ``most``,
    as long as the pairs grow no more than the length does, with half to spare."""
    all_, seen = stage.write(edges.select("c", "p", F.lit(1).alias("w")).distinct(), "hops", n=F.count(F.lit(1)))
    reach, n = 1, seen["n"]
    while 4 * reach <= most:
        more, at = all_, reach
        for _ in range(2):
            on = more.select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("w").alias("v"))
            two = more.filter(F.col("w") == at).join(on, "p").select("c", F.col("q").alias("p"), (F.col("w") + F.col("v")).alias("w")).distinct()
            more, at = more.unionByName(two), 2 * at
        more, seen = stage.write(more, "hops", n=F.count(F.lit(1)))
        if seen["n"] > 6 * n:
            stage.drop(more)
            break
        stage.drop(all_)
        all_, n, reach = more, seen["n"], at
    return all_, reach


def peel(stage: Stage, edges: DataFrame, nodes: DataFrame, first: int = 0, most_rounds: int = 64) -> tuple[list[Batch], DataFrame | None, int]:
    """Peel ``nodes`` (v) from below along ``edges`` (c, p) between them, c <> p: the batches of levels, what no peeling removes (v), and
    the next level."""
    at, rounds, batches = first, 1, []
    state = nodes.select("v", F.lit(first).alias("k"))
    links, hop = edges.select("c", "p", F.lit(1).alias("w")), 1
    written = None  # survivors when the remaining links were last written
    while True:
        plus = links.unionByName(state.select(F.col("v").alias("c"), F.col("v").alias("p"), F.lit(0).alias("w")))
        new, end = state, at
        while end < at + rounds:
            goes_on = new.join(plus, F.col("v") == F.col("c")).filter((F.col("w") == 0) | (F.col("k") == end))
            new = goes_on.groupBy(F.col("p").alias("v")).agg(F.max(F.col("k") + F.col("w")).alias("k"))
            end += hop
        k = F.col("k")
        count = lambda x: F.sum(x.cast("long"))
        new, seen = stage.write(new, "levels", all=F.count(F.lit(1)), last=count(k >= end - 1), left=count(k >= end), top=F.max(F.when(k < end, k)))
        if seen["all"] > seen["left"]:
            batches.append(Batch(at, seen["top"], new.filter(k < end)))
            at = seen["top"] + 1
        if not seen["left"]:
            return batches, None, at
        state = new.filter(k == end)
        if seen["left"] == seen["last"]:
            return batches, state.select("v"), at
        thin = (end - batches[-1].low) * math.log(0.5) / math.log(seen["left"] / seen["all"])
        rounds = min(most_rounds, max(1, int(thin)))
        if written is None or seen["left"] * 2 <= written or (thin >= _THIN and hop == 1):  # the links of peeled nodes go
            left = links.join(state.select(F.col("v").alias("c")), "c", "left_semi")
            if thin >= _THIN and hop == 1:
                new_links, hop = hops(stage, left)
            else:
                new_links = stage.write(left, "rest")
            if written is not None:
                stage.drop(links)
            links, written = new_links, seen["left"]


def _joined(batches: list[Batch]) -> list[Batch]:
    """Neighbouring batches of the thin top, of ``_THIN`` levels or more each, as one."""
    out: list[Batch] = []
    for x in batches:
        if out and min(x.high - x.low, out[-1].high - out[-1].low) + 1 >= _THIN:
            out[-1] = Batch(out[-1].low, x.high, out[-1].nodes.unionByName(x.nodes))
        else:
            out.append(x)
    return out


class Hierarchy:
    def __init__(self, links: DataFrame, scope: str = "g", child: str = "child", parent: str = "parent", most_rounds: int = 64):
        self.spark = links.sparkSession
        self.stage = Stage(self.spark, "hierarchy")
        self.most_rounds = most_rounds
        links = links.select(F.col(scope).alias("scope"), F.col(child).alias("child"), F.col(parent).alias("parent")).dropna().distinct()
        self._number(links)
        self._peel()

    # -- ids ---------------------------------------------------------------------------------

    def _number(self, links: DataFrame) -> None:
        """Ids in the order of (scope, name), so that the smallest id of a set is its lowest name."""
        links = self.stage.write(links, "links")
        ends = links.select("scope", F.explode(F.array("child", "parent")).alias("name")).distinct()
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.nodes = self.stage.write(
            ends.repartitionByRange(n, "scope", "name").sortWithinPartitions("scope", "name").withColumn("id", F.monotonically_increasing_id()),
            "nodes",
        )
        c = self.nodes.select("scope", F.col("name").alias("child"), F.col("id").alias("c"))
        p = self.nodes.select("scope", F.col("name").alias("parent"), F.col("id").alias("p"))
        self.edges = self.stage.write(links.join(c, ["scope", "child"]).join(p, ["scope", "parent"]).select("c", "p"), "edges")
        self.stage.drop(links)

    # -- peeling -----------------------------------------------------------------------------

    def _peel(self) -> None:
        """Up to the first loops, which are found."""
        links = self.edges.filter("c <> p")
        self._batches, self._residue, self._next = peel(self.stage, links, self.nodes.select(F.col("id").alias("v")), most_rounds=self.most_rounds)
        loops = self.edges.filter("c = p").select(F.col("c").alias("id"), F.col("c").alias("lowest"))
        if self._residue is not None:
            self._tangle = self.stage.write(links.join(self._residue.select(F.col("v").alias("c")), "c", "left_semi"), "residue")
            loops = loops.unionByName(strongly_connected(self.stage, self._tangle, self._residue))
        # a node with a link to itself on a longer loop belongs to that loop
        self._loops = self.stage.write(loops.groupBy("id").agg(F.min("lowest").alias("lowest")), "loops")

    @cached_property
    def batches(self) -> list[Batch]:
        """All levels; loops are contracted, and the peeling has gone on above them."""
        peeled = [self._batches]
        if self._residue is not None:
            low = self._loops.select(F.col("id").alias("v"), "lowest")
            nodes = self._residue.join(low, "v", "left").select(F.coalesce("lowest", "v").alias("v")).distinct()
            links = self.stage.write(self._contracted(self._tangle), "contracted")
            more, left, _ = peel(self.stage, links, nodes, self._next, self.most_rounds)
            assert left is None
            peeled.append(more)
        return [x for part in peeled for x in _joined(part)]

    def _contracted(self, edges: DataFrame) -> DataFrame:
        c = self._loops.select(F.col("id").alias("c"), F.col("lowest").alias("cl"))
        p = self._loops.select(F.col("id").alias("p"), F.col("lowest").alias("pl"))
        both = edges.join(c, "c", "left").join(p, "p", "left").select(F.coalesce("cl", "c").alias("c"), F.coalesce("pl", "p").alias("p"))
        return both.filter("c <> p").distinct()

    def loops(self) -> DataFrame:
        """(g, lowest, concept): each concept on a loop, with the lowest concept of its loop."""
        low = self.nodes.select(F.col("id").alias("lowest"), F.col("name").alias("low_name"))
        return (
            self._loops.join(self.nodes, "id")
            .join(low, "lowest")
            .select(F.col("scope").alias("g"), F.col("low_name").alias("lowest"), F.col("name").alias("concept"))
        )

    @cached_property
    def levels(self) -> DataFrame:
        """(v, b): the batch of each node, loops contracted."""
        parts = [x.nodes.select("v", F.lit(b).alias("b")) for b, x in enumerate(self.batches)]
        none = self.nodes.select(F.col("id").alias("v"), F.lit(0).alias("b")).filter(F.lit(False))
        return self.stage.write(reduce(DataFrame.unionByName, parts, none), "level")

    @cached_property
    def links(self) -> DataFrame:
        """(c, cb, p, pb): links between contracted nodes, with the batch of both ends."""
        at = lambda end: self.levels.select(F.col("v").alias(end), F.col("b").alias(f"{end}b"))
        return self.stage.write(self._contracted(self.edges).join(at("c"), "c").join(at("p"), "p").select("c", "p", "pb", "cb"), "links", partition_by="cb")

    # -- descendants: upward messages --------------------------------------------------------

    def below_ids(self, of: DataFrame | None = None) -> DataFrame:
        """(a, d): d lies below a; loops contracted.  With ``of`` (v) only for the d of that set, and nothing else is sent."""
        sent = self.stage.mailbox("below", "a long, d long")
        start = self.levels
        if of is not None:
            start = self.stage.write(start.join(of.select("v").distinct(), "v", "left_semi").select("v", "b"), "start")
        for b, batch in enumerate(self.batches):
            own = self.links.filter(F.col("cb") == b)
            selves = self.levels.filter(F.col("b") == b).select(F.col("v").alias("c"), F.col("v").alias("p"))
            lists = start.filter(F.col("b") == b).select(F.col("v").alias("a"), F.col("v").alias("d")).unionByName(sent.take(b))
            if batch.high > batch.low:
                up = self._closed(own.filter(F.col("pb") == b).select("c", "p"), selves, batch.high - batch.low)
                lists = lists.join(up, F.col("a") == F.col("c")).select(F.col("p").alias("a"), "d")
            out = own.filter(F.col("pb") > b).select("c", "p", F.col("pb").alias("to")).unionByName(selves.select("c", "p", F.lit(_DONE).alias("to")))
            out = lists.distinct().join(out, F.col("a") == F.col("c")).filter((F.col("to") != _DONE) | (F.col("a") != F.col("d")))
            sent.send(out.select(F.col("p").alias("a"), "d", "to"))
            sent.drop(b)
        return sent.take(_DONE).select("a", "d")

    def _closed(self, links: DataFrame, selves: DataFrame, length: int) -> DataFrame:
        """(c, p): nodes joined by at most ``length`` links, each with itself.  Pairs joined by exactly 2^i links are joined with those by fewer
        and with each other, twice in a job."""
        if length == 1:
            return links.unionByName(selves)
        t = links.withColumn("exact", F.lit(True)).unionByName(selves.withColumn("exact", F.lit(False)))
        reach = 0
        while reach < length:
            for _ in range(2):
                first = t.filter("exact").select("c", F.col("p").alias("m"))
                on = first.join(t.select(F.col("c").alias("m"), "p", "exact"), "m").select("c", "p", "exact")
                t = on.unionByName(t.filter("not exact")).distinct()
                reach = 2 * reach + 1
            t = self.stage.write(t, "closed")
        return t.filter("not exact").select("c", "p")

    @cached_property
    def _below(self) -> DataFrame:
        return self.below_ids()

    def above(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (g, low, high) in which ``high`` lies above ``low``, as all members of a loop lie above each other."""
        low = self._loops.withColumnRenamed("id", "v")
        at = self.nodes.withColumnsRenamed({"id": "v", "scope": "g"}).join(low, "v", "left").select("g", "name", F.coalesce("lowest", "v").alias("v"), F.col("lowest").isNotNull().alias("on_loop"))
        end = lambda e: at.withColumnsRenamed({"name": e, "v": f"{e}_v", "on_loop": f"{e}_loop"})
        asked = self.stage.write(pairs.select("g", "low", "high").distinct().join(end("low"), ["g", "low"]).join(end("high"), ["g", "high"]), "asked")
        apart = asked.filter("low_v <> high_v")
        below = self.below_ids(apart.select(F.col("low_v").alias("v"))).select(F.col("d").alias("low_v"), F.col("a").alias("high_v"))
        return apart.join(below, ["low_v", "high_v"], "left_semi").select("g", "low", "high").unionByName(asked.filter("low_v = high_v and low_loop").select("g", "low", "high"))

    def descendants(self) -> DataFrame:
        """(g, concept, below, on_loop): one row for each concept below another.  Concepts of a loop stand
        under the loop's lowest concept; below another concept every member of a loop has its row."""
        pairs = self._below.join(self._loops.select(F.col("lowest").alias("d"), "id"), "d", "left")
        pairs = pairs.select("a", F.coalesce("id", "d").alias("d"), F.col("id").isNotNull().alias("on_loop"))
        own = self._loops.select(F.col("lowest").alias("a"), F.col("id").alias("d"), F.lit(True).alias("on_loop"))
        names = self.nodes.select(F.col("id").alias("a"), F.col("scope").alias("g"), F.col("name").alias("concept"))
        below = self.nodes.select(F.col("id").alias("d"), F.col("name").alias("below"))
        return pairs.unionByName(own).join(names, "a").join(below, "d").select("g", "concept", "below", "on_loop")

    def member_descendants(self) -> DataFrame:
        """(g, concept, below, concept_on_loop, on_loop): one row for each concept below another, every member of
        a loop being a concept of its own on both sides; all members of a loop stand below each of them."""
        pairs = self._below.join(self._loops.select(F.col("lowest").alias("d"), "id"), "d", "left")
        pairs = pairs.select(F.col("a").alias("id"), F.coalesce("id", "d").alias("d"), F.col("id").isNotNull().alias("below_on_loop"))
        own = self._loops.select(F.col("lowest").alias("id"), F.col("id").alias("d"), F.lit(True).alias("below_on_loop"))
        names = self.nodes.select("id", F.col("scope").alias("g"), F.col("name").alias("concept"))
        below = self.nodes.select(F.col("id").alias("d"), F.col("name").alias("below"))
        rows = self._for_members(pairs.unionByName(own)).join(names, "id").join(below, "d")
        return rows.select("g", "concept", "below", F.col("on_loop").alias("concept_on_loop"), F.col("below_on_loop").alias("on_loop"))

    def _for_members(self, df: DataFrame) -> DataFrame:
        """Rows of a loop's lowest member (``id``) for each of its members; ``on_loop`` marks them."""
        loops = self._loops.select(F.col("lowest").alias("id"), F.col("id").alias("member"))
        own = [c for c in df.columns if c != "id"]
        return df.join(loops, "id", "left").select(F.coalesce("member", "id").alias("id"), *own, F.col("member").isNotNull().alias("on_loop"))

    # -- paths: downward messages ------------------------------------------------------------

    @cached_property
    def _paths(self) -> DataFrame:
        """(id, path, depth, root): every path from a top down to the node, loops contracted; ``path`` has the names, joined."""
        step = F.concat(F.lit(_STEP), "name").alias("way")
        down = self.links.join(self.nodes.select(F.col("id").alias("c"), "name"), "c").select("p", "c", "cb", step, "pb")
        down = self.stage.write(down, "down", partition_by="pb")
        tops = self.levels.join(self.links.select(F.col("c").alias("v")).distinct(), "v", "left_anti").join(self.nodes.withColumnRenamed("id", "v"), "v")
        tops = self.stage.write(tops.select(F.col("v").alias("id"), F.col("name").alias("path"), F.lit(0).alias("depth"), F.col("name").alias("root"), "b"), "tops", partition_by="b")
        sent = self.stage.mailbox("paths", "id long, path string, depth int, root string")
        for b in reversed(range(len(self.batches))):
            batch, own = self.batches[b], down.filter(F.col("pb") == b)
            selves = self.levels.filter(F.col("b") == b).select(F.col("v").alias("p"), F.col("v").alias("c"), F.lit("").alias("way"), F.lit(0).alias("n"))
            paths = tops.filter(F.col("b") == b).select("id", "path", "depth", "root").unionByName(sent.take(b))
            if batch.high > batch.low:
                paths = _along(paths, self._ways(own.filter(F.col("cb") == b).select("p", "c", "way", F.lit(1).alias("n")), selves, batch.high - batch.low))
            out = own.filter(F.col("cb") < b).select("p", "c", "way", F.lit(1).alias("n"), F.col("cb").alias("to")).unionByName(selves.withColumn("to", F.lit(_DONE)))
            sent.send(_along(paths, out, "to"))
            sent.drop(b)
        return sent.take(_DONE).select("id", "path", "depth", "root")

    def _ways(self, links: DataFrame, selves: DataFrame, length: int) -> DataFrame:
        """(p, c, way, n): every way down of at most ``length`` links.  Each is made once: of one of exactly 2^i links and a shorter one."""
        if length == 1:
            return links.unionByName(selves)
        t = links.withColumn("exact", F.lit(True)).unionByName(selves.withColumn("exact", F.lit(False)))
        reach = 0
        while reach < length:
            for _ in range(2):
                first = t.filter("exact").select("p", F.col("c").alias("m"), F.col("way").alias("way1"), F.col("n").alias("n1"))
                on = first.join(t.withColumnRenamed("p", "m"), "m").select("p", "c", F.concat("way1", "way").alias("way"), (F.col("n1") + F.col("n")).alias("n"), "exact")
                t = on.unionByName(t.filter("not exact"))
                reach = 2 * reach + 1
            t = self.stage.write(t, "ways")
        return t.filter("not exact").drop("exact")

    def paths(self) -> DataFrame:
        """(g, concept, path, depth, root, root_on_loop): one row for each full path to the top."""
        return self._path_rows(self._paths)

    def member_paths(self) -> DataFrame:
        """(g, concept, path, depth, root, root_on_loop, on_loop): as ``paths()``, with the paths of a loop's lowest
        member for each of its members."""
        return self._path_rows(self._for_members(self._paths), "on_loop")

    def _path_rows(self, ids: DataFrame, *more: str) -> DataFrame:
        looped = self._loops.select(F.col("lowest").alias("id")).distinct()
        root = self.nodes.join(looped, "id", "left_semi").select(F.col("scope").alias("g"), F.col("name").alias("root"), F.lit(True).alias("root_on_loop"))
        return (
            ids.join(self.nodes, "id")
            .select(
                F.col("scope").alias("g"),
                F.col("name").alias("concept"),
                "path",
                "depth",
                "root",
                *more,
            )
            .join(root, ["g", "root"], "left")
            .select("g", "concept", "path", "depth", "root", F.coalesce("root_on_loop", F.lit(False)).alias("root_on_loop"), *more)
        )

    def concepts(self) -> DataFrame:
        """(g, concept, min_depth, max_depth, n_paths, n_roots, root, n_below): a row for each concept, loops contracted."""
        by = self._path_counts()
        size = self._below.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_below"))
        return (
            by.join(size, "id", "left")
            .join(self.nodes, "id")
            .select(
                F.col("scope").alias("g"), F.col("name").alias("concept"), "min_depth", "max_depth", "n_paths", "n_roots", "root",
                F.coalesce("n_below", F.lit(0)).alias("n_below"),
            )
        )

    def closure_size(self, most: int = 20_000_000) -> DataFrame:
        """(g, pairs): how many pairs of a concept and one above it each scope has, members of loops counted one by one; more than ``most`` in all
        are refused."""
        loop = self._loops.groupBy("lowest").agg(F.count(F.lit(1)).alias("m"))
        of = lambda end: loop.select(F.col("lowest").alias(end), F.col("m").alias(f"{end}_m"))
        pairs = self._below.join(of("a"), "a", "left").join(of("d"), "d", "left").select(F.col("a").alias("id"), (F.coalesce("a_m", F.lit(1)) * F.coalesce("d_m", F.lit(1))).alias("n"))
        pairs = pairs.unionByName(loop.select(F.col("lowest").alias("id"), (F.col("m") * F.col("m")).alias("n")))
        by = pairs.groupBy("id").agg(F.sum("n").alias("n")).join(self.nodes, "id").groupBy(F.col("scope").alias("g")).agg(F.sum("n").alias("pairs"))
        by, seen = self.stage.write(by, "closure_size", n=F.sum("pairs"))
        if seen["n"] > most:
            raise ClosureTooLarge(f"{seen['n']} pairs, more than {most}")
        return by

    def _path_counts(self) -> DataFrame:
        return self._paths.groupBy("id").agg(
            F.min("depth").alias("min_depth"),
            F.max("depth").alias("max_depth"),
            F.count(F.lit(1)).alias("n_paths"),
            F.count_distinct("root").alias("n_roots"),
            F.min("root").alias("root"),
        )

    def member_concepts(self) -> DataFrame:
        """(g, concept, min_depth, max_depth, n_paths, n_roots, root, n_below, on_loop): a row for each concept, members of
        loops too.  ``n_below`` counts every concept below, so it is the concept's rows in ``member_descendants()``."""
        loop = self._loops.groupBy("lowest").agg(F.count(F.lit(1)).alias("members"))
        below = self._below.join(loop.withColumnRenamed("lowest", "d"), "d", "left").select(F.col("a").alias("id"), F.coalesce("members", F.lit(1)).alias("n"))
        own = loop.select(F.col("lowest").alias("id"), F.col("members").alias("n"))
        size = below.unionByName(own).groupBy("id").agg(F.sum("n").alias("n_below"))
        rows = self._for_members(self._path_counts().join(size, "id", "left")).join(self.nodes, "id")
        return rows.select(
            F.col("scope").alias("g"), F.col("name").alias("concept"), "min_depth", "max_depth", "n_paths", "n_roots", "root",
            F.coalesce("n_below", F.lit(0)).alias("n_below"), "on_loop",
        )


def _along(paths: DataFrame, ways: DataFrame, *more: str) -> DataFrame:
    """``paths`` gone on with ``ways`` (p, c, way, n)."""
    on = paths.join(ways, F.col("id") == F.col("p"))
    return on.select(F.col("c").alias("id"), F.concat("path", "way").alias("path"), (F.col("depth") + F.col("n")).alias("depth"), "root", *more)


def strongly_connected(stage: Stage, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lowest) of all nodes on loops of ``edges`` (c, p), c <> p, between ``nodes`` (v), none of which can be peeled.

    The lowest node that reaches a node colours it, and the nodes that reach their colour's own node, which they do within the
    colour, are one loop.  Those are taken out and what hung on them alone is peeled, until nothing is left.  Rounds follow
    the length of the loops and of what lies between them, by hops, and four run as one job."""
    found: list[DataFrame] = []
    while nodes is not None:
        far, _ = hops(stage, edges)
        plus = far.select("c", "p").unionByName(nodes.select(F.col("v").alias("c"), F.col("v").alias("p")))
        own = F.col("c") == F.col("p")
        state, moved = nodes.select("v", F.col("v").alias("x")), True
        while moved:
            for _ in range(4):
                on = state.select("v", "x").join(plus, F.col("v") == F.col("c"))
                state = on.groupBy(F.col("p").alias("v")).agg(F.min("x").alias("x"), F.max(F.when(own, F.col("x"))).alias("was"))
            state, seen = stage.write(state, "colour", moved=F.sum((F.col("x") < F.col("was")).cast("long")))
            moved = seen["moved"] > 0
        state, moved = state.select("v", "x", (F.col("v") == F.col("x")).alias("on")), True
        while moved:
            for _ in range(4):  # a message of another colour has no row of the node itself beside it
                on = state.select("v", "x", "on").join(plus, F.col("v") == F.col("p"))
                state = on.groupBy(F.col("c").alias("v"), "x").agg(F.max("on").alias("on"), F.max(F.when(own, F.col("on"))).alias("was")).filter("was is not null")
            state, seen = stage.write(state, "reach", moved=F.sum((F.col("on") != F.col("was")).cast("long")), rest=F.sum((~F.col("on")).cast("long")))
            moved = seen["moved"] > 0
        loop = state.filter("on").select(F.col("v").alias("id"), F.col("x").alias("lowest"))
        found.append(loop.join(loop.groupBy("lowest").count().filter("count > 1").select("lowest"), "lowest", "left_semi").select("id", "lowest"))
        if not seen["rest"]:
            break
        rest = state.filter("not on").select("v")
        inside = lambda end: rest.select(F.col("v").alias(end))
        edges = stage.write(edges.join(inside("c"), "c", "left_semi").join(inside("p"), "p", "left_semi").select("c", "p"), "core")
        _, nodes, _ = peel(stage, edges, rest)
        if nodes is not None:
            edges = stage.write(edges.join(nodes.select(F.col("v").alias("c")), "c", "left_semi"), "core")
    none = edges.select(F.col("c").alias("id"), F.col("p").alias("lowest")).filter(F.lit(False))
    return reduce(DataFrame.unionByName, found, none)
