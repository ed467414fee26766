"""Walks over links from any number of origins at once.

A walk goes level by level.  Each level is one join of the frontier with the links, a partial minimum that picks the
first approach to each node, and an anti join with what was reached before.  Levels are written to the shared
folder, so lineage stays one level deep.  The path to each node comes with it: the least path of the shortest ones,
which is the one a queue with sorted neighbours finds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Stage


class WalkIncomplete(RuntimeError):
    """A bound was met; the answer is refused rather than shortened."""


def walk(links: DataFrame, origins: DataFrame, max_nodes: int | None = None, max_links: int | None = None, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(g, origin, node, pred, depth, path) of all nodes reached from (g, origin) over (g, a, b), and
    (g, origin, links_walked, reached, complete).  An origin on a loop reaches itself.

    Where a bound is given, an origin that meets it stops there and is not complete.  So many ``rounds`` run as one job: the
    nodes of the last rounds go along, and what an earlier job reached is taken out at the end of the job; nothing is walked but what the
    origins reach.  Bounds count links, and need one round a job."""
    bounded = max_nodes is not None or max_links is not None
    if rounds > 1 and bounded:
        raise ValueError("bounds need one round a job")
    stage = Stage(links.sparkSession, "walk")
    links = stage.write(links.select("g", "a", "b").dropna().distinct(), "links")
    start = origins.select("g", "origin").dropna().distinct()
    front = stage.write(start.select("g", "origin", F.col("origin").alias("node"), F.array("origin").alias("path")), "front")
    step = links.select("g", F.col("a").alias("node"), "b")
    if rounds > 1:
        ends = links.select("g", F.explode(F.array("a", "b")).alias("node")).unionByName(front.select("g", "node")).distinct()
        step = stage.write(step.unionByName(ends.select("g", "node", F.lit(None).cast("string").alias("b"))), "steps")
    reached: list[DataFrame] = []
    keys: list[DataFrame] = []  # what was reached, in few tables
    tally = stage.write(start.select("g", "origin", F.lit(0).cast("long").alias("links_walked"), F.lit(0).cast("long").alias("reached"), F.lit(True).alias("complete")), "tally")
    first = F.min(F.struct(F.size("path").alias("n"), "path")).alias("m")
    at = 1
    while True:
        if rounds == 1:
            steps = front.join(step, ["g", "node"]).select("g", "origin", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
            if bounded:
                steps = stage.write(steps, "steps")
            new = steps.groupBy("g", "origin", "node").agg(first).select("g", "origin", "node", F.col("m.path").alias("path"))
        else:
            new = front
            for k in range(at, at + rounds):
                on = new.join(step, ["g", "node"]).filter(F.col("b").isNull() | (F.size("path") == k))
                stays = F.col("b").isNull()
                on = on.select("g", "origin", F.coalesce("b", "node").alias("node"), F.when(stays, F.col("path")).otherwise(F.concat("path", F.array("b"))).alias("path"))
                # an origin that is reached stands beside the one that the walk starts at
                new = on.groupBy("g", "origin", "node", (F.size("path") == 1).alias("start")).agg(first).select("g", "origin", "node", F.col("m.path").alias("path"))
            new = new.filter(F.size("path") > at)
        if keys:
            seen = reduce(DataFrame.unionByName, keys)
            new = new.join(seen, ["g", "origin", "node"], "left_anti")
        new, n = stage.write(new, "front", n=F.count(F.lit(1)))
        if bounded:
            more = steps.groupBy("g", "origin").agg(F.count(F.lit(1)).alias("l")).join(new.groupBy("g", "origin").agg(F.count(F.lit(1)).alias("r")), ["g", "origin"], "left")
            walked, got = F.col("links_walked") + F.coalesce("l", F.lit(0)), F.col("reached") + F.coalesce("r", F.lit(0))
            ok = F.lit(True)
            if max_nodes is not None:
                ok = ok & (got <= max_nodes)
            if max_links is not None:
                ok = ok & (walked <= max_links)
            tally = stage.write(
                tally.join(more, ["g", "origin"], "left").select("g", "origin", walked.alias("links_walked"), got.alias("reached"), (F.col("complete") & ok).alias("complete")), "tally"
            )
            over = tally.filter("not complete").select("g", "origin")
            new = new.join(over, ["g", "origin"], "left_anti")
        if not n["n"]:
            break
        reached.append(new)
        keys.append(new.select("g", "origin", "node"))
        if len(keys) > 8:
            keys = [stage.write(reduce(DataFrame.unionByName, keys), "keys")]
        at += rounds
        front = new.filter(F.size("path") == at)  # nodes that the next round goes on from
    if not reached:
        reached = [front.limit(0)]
    out = reduce(DataFrame.unionByName, reached)
    return out.select("g", "origin", "node", F.element_at("path", -2).alias("pred"), (F.size("path") - 1).alias("depth"), "path"), tally


def upward(relations: DataFrame) -> DataFrame:
    return relations.filter("p = 'skos:broaderTransitive'").select("g", F.col("s").alias("a"), F.col("o").alias("b"))


def downward(relations: DataFrame) -> DataFrame:
    return relations.filter("p = 'skos:narrowerTransitive'").select("g", F.col("s").alias("a"), F.col("o").alias("b"))


def entailed(path: Column, predicate: str) -> Column:
    """The derivation by transitivity, for paths of three or more nodes."""
    steps = F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1), lambda a, b: F.concat(a, F.lit(f" {predicate} "), b))
    return F.when(F.size(path) >= 3, F.array_join(steps, ", and "))


def children(relations: DataFrame) -> DataFrame:
    """(g, parent, child, origin): one narrower step."""
    return relations.filter("p = 'skos:narrower'").select("g", F.col("s").alias("parent"), F.col("o").alias("child"), "origin")


#: siblings: at most about so many children of a parent on either side of a cell, and pairs in a task
CELL, PAIRS = 512, 1 << 22


def siblings(relations: DataFrame, origins: DataFrame, joined: str | None = None, cell: int = CELL) -> DataFrame:
    """(g, origin, sibling, parents): the other children of each origin's parents, with the parents shared, as a sorted array or, with
    ``joined``, as one text.  Only the given origins are paired with their siblings, never all children of a parent with each other.

    A parent of many children is dealt with in cells of its origins and its children, so no task has all its pairs; tasks are
    as many as the pairs need, which are counted first.  Two concepts share several parents only if both have several; these
    pairs alone are grouped, all others are given on as they are made."""
    stage = Stage(relations.sparkSession, "siblings")
    links = stage.write(relations.filter(F.col("p").isin("skos:broader", "skos:narrower")).select("g", "s", "p", "o").distinct(), "links")

    def side(p: str, child: str, own: str, parent: str) -> DataFrame:
        """(g, child, parent, several): several tells whether the child has more than one parent."""
        rows = links.filter(F.col("p") == p).select("g", F.col(own).alias(child), F.col(parent).alias("parent"))
        more = rows.groupBy("g", child).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", child, F.lit(True).alias("several"))
        return rows.join(more, ["g", child], "left").select("g", child, "parent", F.coalesce("several", F.lit(False)).alias("several"))

    mine = stage.write(side("skos:broader", "origin", "s", "o").join(origins.select("g", "origin").distinct(), ["g", "origin"], "left_semi"), "mine")
    others = stage.write(side("skos:narrower", "sibling", "o", "s").join(mine.select("g", "parent").distinct(), ["g", "parent"], "left_semi"), "others")
    n_mine, n_others = (df.groupBy("g", "parent").agg(F.count(F.lit(1)).alias(n)) for df, n in ((mine, "n_mine"), (others, "n_others")))
    sizes, seen = stage.write(n_mine.join(n_others, ["g", "parent"]), "sizes", pairs=F.sum(F.col("n_mine") * F.col("n_others")))
    # as many parents as links / cell at most
    large = sizes.filter(f"n_mine > {cell} or n_others > {cell}").select("g", "parent", *[F.ceil(F.col(n) / cell).cast("int").alias(k) for n, k in (("n_mine", "down"), ("n_others", "across"))])
    tasks = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen["pairs"] // PAIRS))

    def dealt(df: DataFrame, child: str, own: str, over: str) -> DataFrame:
        """Each row in all cells of its line or column."""
        rows = df.join(F.broadcast(large), ["g", "parent"], "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("down", "across")})
        rows = rows.withColumn(own, F.pmod(F.xxhash64(child), F.col(own)).cast("int")).withColumn(over, F.explode(F.sequence(F.lit(0), F.col(over) - 1)))
        return rows.select("g", "parent", "down", "across", child, F.col("several").alias(f"{child}_several")).repartition(tasks, "g", "parent", "down", "across")

    def pairs(asked: DataFrame, found: DataFrame) -> DataFrame:
        return dealt(asked, "origin", "down", "across").join(dealt(found, "sibling", "across", "down"), ["g", "parent", "down", "across"]).filter("sibling <> origin")

    one = pairs(mine, others).filter("not (origin_several and sibling_several)")
    one = one.select("g", "origin", "sibling", F.array("parent").alias("parents") if joined is None else F.col("parent").alias("parents"))
    both = pairs(mine.filter("several"), others.filter("several")).groupBy("g", "origin", "sibling").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    if joined is not None:
        both = both.withColumn("parents", F.array_join("parents", joined))
    return one.unionByName(both)


# -- routes ------------------------------------------------------------------------------------------


def routes(relations: DataFrame, origins: DataFrame, max_paths: int | None = None, max_steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(g, origin, path, stated, summit): every simple path up to a concept without a broader one; and
    (g, origin, cycle, approach): the loops met, turned to start at their lowest node, by their first approach.

    ``stated`` tells of each step whether it is a broader link or only a transitive one.  Routes may be many where
    hierarchies meet, so bounds refuse the whole answer."""
    stage = Stage(relations.sparkSession, "routes")
    up = upward(relations)
    broad = relations.filter("p = 'skos:broader'").select("g", F.col("s").alias("a"), F.col("o").alias("b"), F.lit(True).alias("plain")).distinct()
    up = stage.write(up.distinct().join(broad, ["g", "a", "b"], "left").select("g", "a", "b", F.coalesce("plain", F.lit(False)).alias("plain")), "up")
    front = origins.select("g", "origin").dropna().distinct()
    front = stage.write(front.select("g", "origin", F.array("origin").alias("path"), F.array().cast("array<boolean>").alias("stated")), "front")
    found: list[DataFrame] = []
    loops: list[DataFrame] = []
    n_paths = n_steps = 0
    while True:
        at = front.withColumn("a", F.element_at("path", -1)).join(up, ["g", "a"], "left")
        looped = F.coalesce(F.array_contains("path", F.col("b")), F.lit(False))
        grown = F.when(F.col("b").isNull(), F.col("path")).otherwise(F.concat("path", F.array("b")))
        kind = F.when(F.col("b").isNull(), "end").when(looped, "loop").otherwise("on")
        t, seen = stage.write(
            at.select("g", "origin", grown.alias("path"), F.when(F.col("b").isNull(), F.col("stated")).otherwise(F.concat("stated", F.array("plain"))).alias("stated"), kind.alias("kind")),
            "step", ends=F.sum((F.col("kind") == "end").cast("long")), on=F.sum((F.col("kind") == "on").cast("long")), steps=F.sum((F.col("kind") != "end").cast("long")),
        )
        n_paths, n_steps = n_paths + seen["ends"], n_steps + seen["steps"]
        if (max_paths is not None and n_paths > max_paths) or (max_steps is not None and n_steps > max_steps):
            raise WalkIncomplete(f"more than {max_paths} routes or {max_steps} steps")
        found.append(t.filter("kind = 'end'").drop("kind"))
        loops.append(t.filter("kind = 'loop'").drop("kind"))
        if not seen["on"]:
            break
        front = t.filter("kind = 'on'").drop("kind")
    paths = reduce(DataFrame.unionByName, found).withColumn("summit", F.element_at("path", -1))
    met = reduce(DataFrame.unionByName, loops)
    start = F.array_position("path", F.element_at("path", -1))
    met = met.select("g", "origin", F.slice("path", start.cast("int"), F.size("path") - start.cast("int")).alias("ring"), F.slice("path", 1, start.cast("int")).alias("approach"))
    cycles = met.select("g", "origin", lowest_first(F.col("ring")).alias("cycle"), "approach").groupBy("g", "origin", "cycle").agg(F.min("approach").alias("approach"))
    return paths, cycles


def summits(paths: DataFrame, top_concepts: DataFrame) -> DataFrame:
    """(g, origin, summit, top_concept_of array<string>): where the routes of an origin end, with the schemes that name the summit a top concept.  A
    summit need not be one, nor a top concept a summit."""
    named = top_concepts.groupBy("g", F.col("concept").alias("summit")).agg(F.array_sort(F.collect_set("scheme")).alias("top_concept_of"))
    out = paths.select("g", "origin", "summit").distinct().join(named, ["g", "summit"], "left")
    return out.select("g", "origin", "summit", F.coalesce("top_concept_of", F.array().cast("array<string>")).alias("top_concept_of"))


def lowest_first(ring: Column) -> Column:
    """A loop's nodes turned so that the lowest comes first."""
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.when(F.size(ring) == 0, ring).otherwise(F.concat(F.slice(ring, at, F.size(ring) - at + 1), F.slice(ring, 1, at - 1)))


# -- retirement --------------------------------------------------------------------------------------


def retirements(statements: DataFrame) -> DataFrame:
    """(g, node, retired, replaced_by): marked as deprecated by a true boolean or the plain text 'true'; successors
    other than the node itself."""
    marked = (F.col("p") == "owl:deprecated") & (F.col("o_kind") == "literal") & (F.col("o") == "true") & F.col("o_dt").isin("xsd:boolean", "xsd:string")
    next_ = (F.col("p") == "dcterms:isReplacedBy") & (F.col("o_kind") != "literal") & (F.col("o") != F.col("s"))
    rows = statements.filter(marked | next_)
    return rows.groupBy("g", F.col("s").alias("node")).agg(F.bool_or(marked).alias("retired"), F.array_sort(F.collect_set(F.when(next_, F.col("o")))).alias("replaced_by"))


def current_ancestors(walked: DataFrame, retired: DataFrame) -> DataFrame:
    """Ancestors without the retired ones; those above them stay, and paths are whole."""
    return walked.join(retired.select("g", "node"), ["g", "node"], "left_anti")


def current_tree(walked: DataFrame, retired: DataFrame) -> DataFrame:
    """Descendants with ``role``: kept, route (retired, but above a kept one in the tree) or dropped."""
    out = walked.join(retired.select("g", "node", F.lit(True).alias("gone")), ["g", "node"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    inner = F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))
    routes_ = out.filter(~F.col("gone")).select("g", "origin", F.explode(inner).alias("node")).distinct().withColumn("on", F.lit(True))
    out = out.join(routes_, ["g", "origin", "node"], "left")
    return out.withColumn("role", F.when(~F.col("gone"), "kept").when(F.col("on"), "route").otherwise("dropped")).drop("gone", "on")


def current_routes(paths: DataFrame, retired: DataFrame) -> DataFrame:
    """Routes with ``withheld``: whether any concept above the origin is retired.  Loops are never narrowed."""
    steps = paths.select("g", "origin", "path", F.explode(F.slice("path", 2, F.size("path"))).alias("node"))
    bad = steps.join(retired.select("g", "node"), ["g", "node"], "left_semi").select("g", "origin", "path").distinct().withColumn("withheld", F.lit(True))
    return paths.join(bad, ["g", "origin", "path"], "left").withColumn("withheld", F.coalesce("withheld", F.lit(False)))
