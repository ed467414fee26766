"""Reports over one or many graphs as frames: what a graph holds, what is noted on a resource, what a concept is mapped to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from .integrity import Integrity
from .skos import ASSERTED, CoreModel
from .walks import walk

#: predicates that some rule reads
READ = (
    "rdf:type", "rdf:first", "rdf:rest", "rdfs:subPropertyOf", "rdfs:subClassOf", "owl:deprecated", "dcterms:isReplacedBy", "skosxl:literalForm",
    "skos:mappingRelation", *V.OBJECT_PROPERTIES, *V.LABELS, *V.NOTES,
)


class NoSuchResource(LookupError):
    """The graph says nothing about the resource, which is not the same as an undocumented one."""


def unread(statements: DataFrame) -> DataFrame:
    """(g, p, n): statements of each graph whose predicate no rule reads; they are counted and otherwise left alone."""
    whole = statements.filter("g is not null and s is not null and p is not null and o is not null").filter(~F.col("p").isin(*READ))
    return whole.select("g", "s", "p", "o", "o_kind", "o_lang", "o_dt").distinct().groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


def inspect(model: CoreModel, retired: DataFrame, findings: bool = True) -> DataFrame:
    """(g, section, item, n, n_inferred): the counts of a graph, section by section.

    ``retired`` is what ``walks.retirements`` gives.  Counts of links that are stated in both directions are of one link.  Sections
    without anything to count have no rows, but for concepts without a preferred label."""
    model.hold("top_concepts", "in_scheme", "classes", "literal_forms", "labels", "mappings", "relations", "notes", "members", "label_relations")
    derived: Column = F.col("origin") != ASSERTED
    parts: list[DataFrame] = []

    def add(df: DataFrame, section: str, item: str | Column, inferred: Column | None = None) -> None:
        item = F.lit(item) if isinstance(item, str) else item
        by = df.groupBy("g", item.alias("item"))
        parts.append(by.agg(F.count(F.lit(1)).alias("n"), (F.lit(0).cast("long") if inferred is None else F.count_if(inferred)).alias("n_inferred")).select("g", F.lit(section).alias("section"), "item", "n", "n_inferred"))

    concepts = model.classes.filter("class = 'skos:Concept'").select("g", "node")
    add(model.facts.distinct(), "statements", "read")
    add(model.classes, "classes", F.col("class"), derived)
    add(model.labels, "languages", F.concat_ws(" ", F.coalesce("lang", F.lit("-")), "kind"), derived)
    preferred = model.labels.filter("kind = 'preferred'").select("g", "node")
    bare = concepts.join(preferred, ["g", "node"], "left_anti").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    bare = concepts.select("g").distinct().join(bare, "g", "left").select("g", F.lit("languages").alias("section"), F.lit("concepts without preferred label").alias("item"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("n_inferred"))
    parts.append(bare)
    add(model.literal_forms.filter("n_forms = 1"), "label resources", "with exactly one form")
    add(model.label_relations.filter("s <= o"), "label resources", "links", derived)
    documented = model.notes.join(concepts, ["g", "node"], "left_semi")
    add(documented, "documentation", F.col("kind"), derived)
    add(model.top_concepts, "top concepts", F.col("scheme"))
    add(model.members, "members", F.col("collection"), derived)
    add(model.relations, "relations", F.col("p"), derived)
    add(model.mappings, "mappings", F.col("p"), derived)
    add(retired.filter("retired"), "retirements", F.when(F.size("replaced_by") == 0, "without successor").otherwise("with successor"))
    if findings:
        add(Integrity(model).findings(), "findings", F.col("kind"))
    return reduce(DataFrame.unionByName, parts)


def notes_of(model: CoreModel, resources: DataFrame) -> DataFrame:
    """(g, node, kind, value, lang, origin, premise) of the given resources (g, node), in the order of kinds; refused if a graph says nothing
    about one.  ``premise`` is what the note is stated as, where that is another property."""
    asked = resources.select("g", "node").distinct()
    known = model.facts.select("g", F.col("s").alias("node")).unionByName(model.facts.filter("o_kind <> 'literal'").select("g", F.col("o").alias("node")))
    missing = asked.join(known, ["g", "node"], "left_anti").limit(1).collect()
    if missing:
        raise NoSuchResource(f"{missing[0]['node']} in {missing[0]['g']}")
    mine = model.notes.join(asked, ["g", "node"], "left_semi")
    by = model.refinements.select("g", F.col("property").alias("p"), F.col("kind").alias("refines"))
    used = model.facts.join(asked.withColumnRenamed("node", "s"), ["g", "s"], "left_semi").join(by, ["g", "p"], "left")
    used = used.filter(F.col("p").isin(*V.NOTES) | F.col("refines").isNotNull())
    used = used.groupBy("g", F.col("s").alias("node"), F.col("o").alias("value"), F.col("o_kind").alias("value_kind")).agg(F.array_join(F.array_sort(F.collect_set("p")), " ").alias("premise"))
    out = mine.join(used, ["g", "node", "value", "value_kind"], "left")
    return out.select("g", "node", "kind", "value", "lang", "origin", F.when(F.col("origin") != ASSERTED, F.col("premise")).alias("premise"))


def mappings_of(model: CoreModel, concepts: DataFrame, max_nodes: int | None = None, max_links: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(g, concept, p, other, origin, also, chain) of the given (g, concept), and (g, concept, complete).

    One row for each mapping held, with the semantic relation it also is; and one with origin S45 for each concept that only a chain of exact
    matches reaches, the concept itself included, with the chain.  Where a bound stopped the walk, the chains are those reached."""
    asked = concepts.select("g", F.col("concept")).distinct()
    held = model.mappings.withColumnRenamed("s", "concept").join(asked, ["g", "concept"], "left_semi")
    also = F.lit(None).cast("string")
    for p, r in V.LIFTED.items():
        also = F.when(F.col("p") == p, F.lit(r)).otherwise(also)
    held = held.select("g", "concept", "p", F.col("o").alias("other"), "origin", also.alias("also"), F.lit(None).cast("string").alias("chain"))
    exact = model.mappings.filter("p = 'skos:exactMatch'").select("g", F.col("s").alias("a"), F.col("o").alias("b"))
    reached, tally = walk(exact, asked.withColumnRenamed("concept", "origin"), max_nodes, max_links)
    far = reached.filter("depth > 1").select(
        "g", F.col("origin").alias("concept"), F.lit("skos:exactMatch").alias("p"), F.col("node").alias("other"), F.lit("S45").alias("origin"), F.lit(None).cast("string").alias("also"),
        F.array_join("path", " > ").alias("chain"),
    )
    return held.unionByName(far), tally.select("g", F.col("origin").alias("concept"), "complete")
