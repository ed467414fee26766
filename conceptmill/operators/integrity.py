"""Integrity conditions as frames of findings, and the roll-call over them."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..staging import Stage
from .linked import linked
from .skos import CoreModel, mapped
from .walks import upward, walk


def _finding(df: DataFrame, kind: str, rule: str | Column | None, node: str, *detail: str | Column) -> DataFrame:
    rule = F.lit(rule).cast("string") if rule is None or isinstance(rule, str) else rule
    parts = [F.coalesce(F.col(d) if isinstance(d, str) else d, F.lit("")).cast("string") for d in detail] or [F.lit("")]
    return df.select("g", F.lit(kind).alias("kind"), F.lit(V.SEVERITY[kind]).alias("severity"), rule.alias("rule"), F.col(node).alias("node"), F.concat_ws(" | ", *parts).alias("detail"))


class Integrity:
    def __init__(self, model: CoreModel):
        self.m = model

    def disjoint_classes(self) -> DataFrame:
        """A node in two classes that exclude each other.  One aggregation by node, no self-join."""
        held = self.m.classes.groupBy("g", "node").agg(F.collect_set("class").alias("c"))
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(r).alias("r")) for a, b, r in V.DISJOINT_CLASSES])
        x = held.select("g", "node", F.explode(F.filter(pairs, lambda p: F.array_contains("c", p["a"]) & F.array_contains("c", p["b"]))).alias("p"))
        return _finding(x.select("g", "node", "p.*"), "DisjointClasses", F.col("r"), "node", "a", "b")

    def label_clashes(self) -> DataFrame:
        x = self.m.labels.groupBy("g", "node", "lang", "text").agg(F.collect_set("kind").alias("k")).filter(F.size("k") > 1)
        return _finding(x, "LabelPropertiesClash", "S13", "node", "lang", "text", F.array_join(F.array_sort("k"), ","))

    def several_preferred(self) -> DataFrame:
        x = self.m.labels.filter("kind = 'preferred'").groupBy("g", "node", "lang").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return _finding(x, "MultiplePreferredLabels", "S14", "node", "lang", "n")

    def related_and_broader(self) -> DataFrame:
        """S27 through the closure.  Walks go up from the concepts that something is related to, and from no others, so
        the closure of all concepts is never built."""
        r = self.m.hold("mappings", "relations").relations
        related = r.filter("p = 'skos:related'").select("g", F.col("s").alias("origin"), F.col("o").alias("node"))
        above, _ = walk(upward(r), related.select("g", "origin"), rounds=8)
        return _finding(related.join(above.select("g", "origin", "node"), ["g", "origin", "node"], "left_semi"), "RelatedAndBroaderTransitive", "S27", "origin", "node")

    def related_within(self, max_nodes: int, max_links: int) -> DataFrame:
        """S27 under bounds: what was found, and what was left unchecked.

        Concepts with something related are walked upwards in their order.  All walks of a graph share ``max_links``; the one that
        uses them up ends the check (DisjointnessSweepExhausted).  A concept with more than ``max_nodes`` above it
        is left unchecked by itself (AncestryBoundReached)."""
        r = self.m.relations
        up = r.filter("p = 'skos:broaderTransitive'").select("g", F.col("s").alias("a"), F.col("o").alias("b"))
        related = r.filter("p = 'skos:related'").select("g", F.col("s").alias("origin"), F.col("o").alias("node")).distinct()
        origins = related.select("g", "origin").distinct()
        return self._within(up, origins, related, max_nodes, max_links, "AncestryBoundReached", "DisjointnessSweepExhausted", "S27", "RelatedAndBroaderTransitive")

    def exact_chains_within(self, max_nodes: int, max_links: int) -> DataFrame:
        """S46 across chains under bounds, as ``related_within`` (ExactMatchClusterBoundReached, ExactMatchSweepExhausted)."""
        m = self.m.mappings
        exact = m.filter("p = 'skos:exactMatch'").select("g", F.col("s").alias("a"), F.col("o").alias("b"))
        bad = m.filter(F.col("p").isin("skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch") & (F.col("s") <= F.col("o")))
        bad = bad.select("g", F.col("s").alias("origin"), F.col("o").alias("node")).distinct().join(exact.select("g", F.col("a").alias("origin"), F.col("b").alias("node")), ["g", "origin", "node"], "left_anti")
        origins = exact.select("g", F.col("a").alias("origin")).distinct()
        return self._within(exact, origins, bad, max_nodes, max_links, "ExactMatchClusterBoundReached", "ExactMatchSweepExhausted", "S46", "ExactMatchChainClash")

    def _within(self, links: DataFrame, origins: DataFrame, pairs: DataFrame, max_nodes: int, max_links: int, one: str, all_: str, rule: str, kind: str) -> DataFrame:
        stage = Stage(self.m.spark, "sweep")
        reached, tally = walk(links, origins, max_nodes, max_links)
        tally = stage.write(tally, "tally")
        # each walk that costs anything costs a link, so the first max_links of them are all that the budget can pay
        costly = tally.filter("links_walked > 0").select("g", "origin", "links_walked")
        order = W.partitionBy("g").orderBy("origin")
        paid = costly.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= max_links + 1)
        paid = paid.withColumn("spent", F.sum("links_walked").over(order.rowsBetween(W.unboundedPreceding, 0)))
        last = paid.filter(F.col("spent") >= max_links).groupBy("g").agg(F.min("origin").alias("last"), F.min("spent").alias("spent"))
        open_ = tally.join(last, "g", "left")
        beyond = F.col("last").isNotNull() & (F.col("origin") > F.col("last"))
        stopped = open_.groupBy("g").agg(F.count_if(~beyond).alias("checked"), F.count_if(beyond).alias("unchecked"), F.max("last").alias("last"), F.max("spent").alias("spent"))
        stopped = stopped.filter(F.col("last").isNotNull() & ((F.col("unchecked") > 0) | (F.col("spent") > max_links)))
        done = open_.filter(~beyond)
        large = done.filter((F.col("reached") > max_nodes) & ~F.coalesce((F.col("origin") == F.col("last")) & (F.col("spent") > max_links), F.lit(False)))
        hits = pairs.join(reached.select("g", "origin", "node"), ["g", "origin", "node"], "left_semi").join(done.select("g", "origin"), ["g", "origin"], "left_semi")
        return (
            _finding(hits, kind, rule, "origin", "node")
            .unionByName(_finding(large, one, rule, "origin", F.lit(max_nodes)))
            .unionByName(_finding(stopped.withColumn("node", F.lit(None).cast("string")), all_, rule, "node", "checked", "unchecked", F.lit(max_links)))
        )

    def exact_match_clashes(self) -> DataFrame:
        """S46 on the links held, once per pair."""
        m = self.m.mappings
        exact = m.filter("p = 'skos:exactMatch' and s <= o").select("g", "s", "o")
        bad = m.filter(F.col("p").isin("skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch")).groupBy("g", "s", "o").agg(F.collect_set("p").alias("ps"))
        return _finding(exact.join(bad, ["g", "s", "o"]), "ExactMatchClash", "S46", "s", "o", F.array_join(F.array_sort("ps"), ","))

    @cached_property
    def clusters(self) -> DataFrame:
        """(g, lowest, concept): concepts joined by exact matches in any number of steps, within a graph."""
        return linked(self.m.mappings.filter("p = 'skos:exactMatch'").select("g", F.col("s").alias("a"), F.col("o").alias("b")))

    def exact_chain_clashes(self) -> DataFrame:
        """S46 across chains: both ends in one cluster and no exact match between them."""
        m = self.m.mappings
        bad = m.filter(F.col("p").isin("skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch") & (F.col("s") <= F.col("o")))
        bad = bad.groupBy("g", "s", "o").agg(F.collect_set("p").alias("ps"))
        a = self.clusters.select("g", F.col("concept").alias("s"), F.col("lowest").alias("cluster"))
        b = self.clusters.select("g", F.col("concept").alias("o"), F.col("lowest").alias("cluster"))
        x = bad.join(a, ["g", "s"]).join(b, ["g", "o", "cluster"])
        x = x.join(m.filter("p = 'skos:exactMatch'").select("g", "s", "o"), ["g", "s", "o"], "left_anti")
        return _finding(x, "ExactMatchChainClash", "S46", "s", "o", F.array_join(F.array_sort("ps"), ","))

    def literals_as_objects(self) -> DataFrame:
        x = self.m.facts.filter(F.col("p").isin(*V.OBJECT_PROPERTIES) & (F.col("o_kind") == "literal")).select("g", "s", "p", "o", "o_lang", "o_dt").distinct()
        return _finding(x, "LiteralOnObjectProperty", mapped(F.col("p"), V.OBJECT_PROPERTIES), "s", "p", "o")

    def nodes_as_forms(self) -> DataFrame:
        return _finding(self.m.links("skosxl:literalForm"), "NodeOnDatatypeProperty", "S49", "s", "p", "o")

    def literal_forms(self) -> DataFrame:
        """Label resources with several forms, without a form, or with forms that are no plain literals."""
        held = self.m.classes.filter("class = 'skosxl:Label'").select("g", F.col("node").alias("label"))
        x = held.join(self.m.literal_forms, ["g", "label"], "left").withColumn("n", F.coalesce("n_forms", F.lit(0)))
        odd = self.m.facts.filter("p = 'skosxl:literalForm' and o_kind = 'literal'").filter(~F.col("o_dt").isin(*V.PLAIN)).select("g", F.col("s").alias("label"), "o", "o_dt").distinct()
        return (
            _finding(x.filter("n > 1"), "MultipleLiteralForms", "S52", "label", "n")
            .unionByName(_finding(x.filter("n = 0"), "NoLiteralForm", "S52", "label"))
            .unionByName(_finding(odd, "NonPlainLiteralForm", "S51", "label", "o", "o_dt"))
        )

    def xl_clashes(self) -> DataFrame:
        x = self.m.links(*V.XL_LABELS).groupBy("g", "s", "o").agg(F.collect_set("p").alias("ps")).filter(F.size("ps") > 1)
        return _finding(x, "XlLabelPropertiesClash", "S58", "s", "o", F.array_join(F.array_sort("ps"), ","))

    def odd_labels(self) -> DataFrame:
        x = self.m.facts.filter(F.col("p").isin(*V.LABELS) & ((F.col("o_kind") != "literal") | ~F.col("o_dt").isin(*V.PLAIN)))
        return _finding(x.select("g", "s", "p", "o", "o_dt").distinct(), "NonPlainLiteralLabel", "S12", "s", "p", "o", "o_dt")

    def lists(self) -> DataFrame:
        heads = self.m.member_lists
        many = heads.groupBy("g", "node").agg(F.count_distinct("head").alias("n")).filter("n > 1")
        return _finding(many, "MultipleMemberLists", None, "node", "n").unionByName(_finding(heads.filter("defect is not null"), "DefectiveMemberList", None, "node", "head", "defect"))

    def findings(self) -> DataFrame:
        """(g, kind, severity, rule, node, detail) of all checks.  Walks here are not bounded, so nothing is left unchecked.

        The closed frames are written once, as most checks read them."""
        self.m.hold("mappings", "relations", "classes", "literal_forms", "labels")
        return reduce(
            DataFrame.unionByName,
            [
                self.disjoint_classes(), self.label_clashes(), self.several_preferred(), self.related_and_broader(), self.exact_match_clashes(),
                self.exact_chain_clashes(), self.literals_as_objects(), self.nodes_as_forms(), self.literal_forms(), self.xl_clashes(), self.odd_labels(), self.lists(),
            ],
        )

    def unread_refinements(self) -> DataFrame:
        """(g, term, reaches): terms declared to refine a SKOS term that the rules do not follow; walks stop at SKOS terms."""
        spark = self.m.spark
        stage = Stage(spark, "unread")
        own = F.col("term").startswith("skos:") | F.col("term").startswith("skosxl:")
        sub = self.m.links("rdfs:subPropertyOf", "rdfs:subClassOf").select("g", F.col("s").alias("term"), F.col("o").alias("reaches"))
        sub = stage.write(sub.filter(~own & (F.col("term") != F.col("reaches"))).distinct(), "declared")
        ends = F.col("reaches").startswith("skos:") | F.col("reaches").startswith("skosxl:")
        seen = front = sub
        while True:
            step = front.filter(~ends).join(sub.select("g", F.col("term").alias("reaches"), F.col("reaches").alias("next")), ["g", "reaches"])
            step = step.select("g", "term", F.col("next").alias("reaches")).distinct().join(seen, ["g", "term", "reaches"], "left_anti")
            front, n = stage.write(step, "front", n=F.count(F.lit(1)))
            if not n["n"]:
                break
            seen = seen.unionByName(front)
        return seen.filter(ends)

    def roll_call(self) -> DataFrame:
        """(g, rule, section, authority, verdict, n_violations, n_caveats) for each graph and condition."""
        spark = self.m.spark
        rules = spark.createDataFrame([(r, s, a, list(t)) for r, s, a, t in V.CONDITIONS], "rule string, section string, authority string, terms array<string>")
        graphs = self.m.facts.select("g").distinct()
        bad = self.findings().filter("severity = 'inconsistent'").groupBy("g", "rule").agg(F.count(F.lit(1)).alias("n_violations"))
        touched = rules.select("rule", F.explode("terms").alias("reaches"))
        caveats = self.unread_refinements().join(F.broadcast(touched), "reaches").groupBy("g", "rule").agg(F.count(F.lit(1)).alias("n_caveats"))
        each = graphs.crossJoin(F.broadcast(rules.drop("terms")))  # a fixed number of conditions per graph
        out = each.join(bad, ["g", "rule"], "left").join(caveats, ["g", "rule"], "left").fillna(0, ["n_violations", "n_caveats"])
        verdict = F.when(F.col("n_violations") > 0, "violated").when(F.col("n_caveats") > 0, "unchecked").otherwise("held")
        return out.select("g", "rule", "section", "authority", verdict.alias("verdict"), "n_violations", "n_caveats")


def verdicts(findings: DataFrame, graphs: DataFrame) -> DataFrame:
    """(g, consistent, complete) for each graph (g): whether nothing inconsistent was found, and whether every check was carried through.  The first
    without the second says only that nothing was found so far."""
    has = lambda severity: F.max(F.col("severity") == severity)
    by = findings.groupBy("g").agg(has("inconsistent").alias("bad"), has("unchecked").alias("open"))
    return graphs.select("g").distinct().join(by, "g", "left").select("g", (~F.coalesce("bad", F.lit(False))).alias("consistent"), (~F.coalesce("open", F.lit(False))).alias("complete"))


def newly_violated(before: DataFrame, after: DataFrame) -> DataFrame:
    """(g, rule, ...) of the roll-call ``after`` a change, without what was violated ``before`` as well."""
    was = before.filter("verdict = 'violated'").select("g", "rule")
    return after.filter("verdict = 'violated'").join(was, ["g", "rule"], "left_anti")
