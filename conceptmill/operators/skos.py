"""A graph read as SKOS and SKOS-XL: one frame for each kind of fact, closed under the rules.

All frames carry ``g``, so one plan reads any number of graphs at once.  Frames are lazy; each filters the
statements by predicate before anything is shuffled.  Where a fact may come from several passes, the
passes are numbered in their fixed order and the first one gives the origin, by a partial minimum.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..staging import Stage

ASSERTED = "asserted"


def mapped(column: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def language(tag: Column) -> Column:
    """Tags in lower case; no tag is null."""
    return F.when(tag != "", F.lower(tag))


def first_wins(rows: DataFrame, *key: str) -> DataFrame:
    """The origin of the lowest ``pass_no`` for each key."""
    return rows.groupBy(*key).agg(F.min(F.struct("pass_no", "origin")).alias("_w")).select(*key, F.col("_w.origin").alias("origin"))


class CoreModel:
    def __init__(self, statements: DataFrame):
        self.spark = statements.sparkSession
        self._held: set[str] = set()
        self.facts = statements.select("g", "s", "p", "o", "o_kind", "o_lang", "o_dt").filter("g is not null and s is not null and p is not null and o is not null")

    def hold(self, *names: str) -> CoreModel:
        """Write the named frames once, in the order given, for work that reads them several times."""
        stage = Stage(self.spark, "model")
        for name in names:
            if name not in self._held:
                self.__dict__[name] = stage.write(getattr(self, name), name)
                self._held.add(name)
        return self

    def links(self, *predicates: str) -> DataFrame:
        """(g, s, p, o) with a resource as object, each once."""
        return self.facts.filter(F.col("p").isin(*predicates) & (F.col("o_kind") != "literal")).select("g", "s", "p", "o").distinct()

    # -- schemes and collections -----------------------------------------------------------------

    @cached_property
    def top_concepts(self) -> DataFrame:
        """(g, concept, scheme, of_origin, has_origin): both directions of a top concept link, S8."""
        x = self.links("skos:topConceptOf", "skos:hasTopConcept")
        of = F.col("p") == "skos:topConceptOf"
        x = x.select("g", F.when(of, F.col("s")).otherwise(F.col("o")).alias("concept"), F.when(of, F.col("o")).otherwise(F.col("s")).alias("scheme"), of.alias("of"))
        x = x.groupBy("g", "concept", "scheme").agg(F.bool_or("of").alias("of"), F.bool_or(~F.col("of")).alias("has"))
        origin = lambda c: F.when(F.col(c), ASSERTED).otherwise("S8")
        return x.select("g", "concept", "scheme", origin("of").alias("of_origin"), origin("has").alias("has_origin"))

    @cached_property
    def in_scheme(self) -> DataFrame:
        """(g, node, scheme, origin): stated, or by S7."""
        stated = self.links("skos:inScheme").select("g", F.col("s").alias("node"), F.col("o").alias("scheme"), F.lit(0).alias("pass_no"), F.lit(ASSERTED).alias("origin"))
        tops = self.top_concepts.select("g", F.col("concept").alias("node"), "scheme", F.lit(1).alias("pass_no"), F.lit("S7").alias("origin"))
        return first_wins(stated.unionByName(tops), "g", "node", "scheme")

    @cached_property
    def member_lists(self) -> DataFrame:
        """(g, node, head, items array<string>, defect): the list of each collection.

        Defects: cyclic, no first, no rest, branches, not a node; ``items`` are those before the defect.  Cells find their place by
        doubling: in each round a cell learns where the cell that it points to points, so a list of n cells takes
        log n rounds.  The items of one list are one row of the result."""
        stage = Stage(self.spark, "lists")
        heads = stage.write(self.facts.filter("p = 'skos:memberList'").select("g", F.col("s").alias("node"), F.col("o").alias("head"), "o_kind").distinct(), "heads")
        cells = self.facts.filter(F.col("p").isin("rdf:first", "rdf:rest")).select("g", "s", "p", "o", "o_kind").distinct()
        first, rest = F.col("p") == "rdf:first", F.col("p") == "rdf:rest"
        cells = cells.groupBy("g", F.col("s").alias("cell")).agg(
            F.sum(first.cast("int")).alias("n_first"), F.sum(rest.cast("int")).alias("n_rest"), F.min(F.when(first, F.col("o"))).alias("item"),
            F.min(F.when(rest, F.col("o"))).alias("next"), F.bool_or(first & (F.col("o_kind") == "literal")).alias("lit"),
        )
        why = (
            F.when(F.col("n_first") == 0, "no first").when(F.col("n_rest") == 0, "no rest")
            .when((F.col("n_first") > 1) | (F.col("n_rest") > 1), "branches").when(F.col("lit"), "not a node")
        )
        cells, size = stage.write(cells.select("g", "cell", "item", F.when(why.isNull(), F.col("next")).alias("next"), why.alias("why")), "cells", n=F.count(F.lit(1)))
        # (g, node, head, at, cell): cells of a list at most 2^i - 1 links from its head; jump: where 2^i links lead
        started = heads.filter("o_kind <> 'literal'").select("g", "node", "head", F.lit(0).cast("long").alias("at"), F.col("head").alias("cell"))
        reached = stage.write(started, "reached")
        jump = cells.filter("next is not null").select("g", "cell", "next")
        step = 1
        while step <= 2 * size["n"]:
            ahead = reached.join(jump, ["g", "cell"]).select("g", "node", "head", (F.col("at") + step).alias("at"), F.col("next").alias("cell"))
            more, seen = stage.write(ahead, "reached", n=F.count(F.lit(1)))
            if not seen["n"]:
                break
            # a list that meets a cell again is cyclic from there; each cell counts where it comes first
            reached = stage.write(reached.unionByName(more).groupBy("g", "node", "head", "cell").agg(F.min("at").alias("at")).select("g", "node", "head", "at", "cell"), "reached")
            two = jump.select("g", F.col("next").alias("cell"), F.col("cell").alias("from"))
            jump = stage.write(two.join(jump, ["g", "cell"]).select("g", F.col("from").alias("cell"), "next"), "jump")
            step *= 2
        inner = reached.filter("cell <> 'rdf:nil'").join(cells.withColumn("here", F.lit(True)), ["g", "cell"], "left")
        defect = F.when(F.col("here").isNull(), "no first").otherwise(F.col("why"))
        at = F.struct("at", "item")
        ok = defect.isNull()
        by = inner.groupBy("g", "node", "head").agg(
            F.array_sort(F.collect_list(F.when(ok, at))).alias("x"), F.min(F.when(~ok, F.struct("at", defect.alias("defect")))).alias("bad"), F.count(F.lit(1)).alias("n"),
        )
        ends = reached.filter("cell = 'rdf:nil'").select("g", "node", "head", F.lit(True).alias("ends"))
        out = heads.join(by, ["g", "node", "head"], "left").join(ends, ["g", "node", "head"], "left")
        none = F.array().cast("array<string>")
        lost = F.when(F.col("o_kind") == "literal", "not a node").when(F.col("bad").isNotNull(), F.col("bad.defect")).when(F.col("ends").isNull(), "cyclic")
        return out.select("g", "node", "head", F.coalesce(F.transform("x", lambda y: y["item"]), none).alias("items"), lost.alias("defect"))

    @cached_property
    def members(self) -> DataFrame:
        """(g, collection, member, origin): stated, or items of a list without a defect, S36."""
        stated = self.links("skos:member").select("g", F.col("s").alias("collection"), F.col("o").alias("member"), F.lit(0).alias("pass_no"), F.lit(ASSERTED).alias("origin"))
        items = self.member_lists.filter("defect is null").select("g", F.col("node").alias("collection"), F.explode("items").alias("member"))
        return first_wins(stated.unionByName(items.select("*", F.lit(1).alias("pass_no"), F.lit("S36").alias("origin"))), "g", "collection", "member")

    # -- mappings and relations --------------------------------------------------------------------

    @cached_property
    def mappings(self) -> DataFrame:
        """(g, s, p, o, origin), closed under S43, S44 and then S42."""
        stated = self.links(*V.MAPPINGS).select("*", F.lit(0).alias("pass_no"), F.lit(ASSERTED).alias("origin"))
        converse = mapped(F.col("p"), {k: v for k, (v, _) in V.MAPPING_CONVERSE.items()})
        rule = mapped(F.col("p"), {k: r for k, (_, r) in V.MAPPING_CONVERSE.items()})
        turned = stated.select("g", F.col("o").alias("s"), converse.alias("p"), F.col("s").alias("o"), F.lit(1).alias("pass_no"), rule.alias("origin"))
        both = stated.unionByName(turned)
        close = both.filter("p = 'skos:exactMatch'").select("g", "s", F.lit("skos:closeMatch").alias("p"), "o", F.lit(2).alias("pass_no"), F.lit("S42").alias("origin"))
        return first_wins(both.unionByName(close), "g", "s", "p", "o")

    @cached_property
    def relations(self) -> DataFrame:
        """(g, s, p, o, origin): stated, lifted by S41, turned by S23, S25 and S26, and widened by S22."""
        stated = self.links(*V.RELATIONS).select("*", F.lit(0).alias("pass_no"), F.lit(ASSERTED).alias("origin"))
        maps = self.mappings.filter(F.col("p").isin(*V.LIFTED))
        lifted = maps.select("g", "s", mapped(F.col("p"), V.LIFTED).alias("p"), "o", F.lit(1).alias("pass_no"), F.lit("S41").alias("origin"))
        seeds = stated.unionByName(lifted)
        converse = mapped(F.col("p"), {k: v for k, (v, _) in V.RELATION_CONVERSE.items()})
        rule = mapped(F.col("p"), {k: r for k, (_, r) in V.RELATION_CONVERSE.items()})
        turned = seeds.select("g", F.col("o").alias("s"), converse.alias("p"), F.col("s").alias("o"), F.lit(2).alias("pass_no"), rule.alias("origin"))
        both = seeds.unionByName(turned)
        wide = both.filter(F.col("p").isin(*V.TRANSITIVE)).select("g", "s", mapped(F.col("p"), V.TRANSITIVE).alias("p"), "o", F.lit(3).alias("pass_no"), F.lit("S22").alias("origin"))
        return first_wins(both.unionByName(wide), "g", "s", "p", "o")

    # -- classes -----------------------------------------------------------------------------------

    def _class_claims(self) -> DataFrame:
        """(g, node, class, pass_no, place, origin, premise): every ground for a class, with the place of the ground in its pass."""
        parts: list[DataFrame] = []

        def claim(df: DataFrame, node: str, cls: str | Column, pass_no: int, origin: str, premise: Column, place: Column | None = None) -> None:
            cls = F.lit(cls) if isinstance(cls, str) else cls
            place = F.lit("") if place is None else place
            parts.append(df.select("g", F.col(node).alias("node"), cls.alias("class"), F.lit(pass_no).alias("pass_no"), place.alias("place"), F.lit(origin).alias("origin"), premise.alias("premise")))

        def said(s: str, p: str | Column, o: str) -> Column:
            return F.concat_ws(" ", F.col(s), F.lit(p) if isinstance(p, str) else p, F.col(o))

        typed = self.links("rdf:type").filter(F.col("o").isin(*V.CLASSES))
        claim(typed, "s", F.col("o"), 0, ASSERTED, F.lit(None).cast("string"))
        claim(self.top_concepts, "scheme", "skos:ConceptScheme", 1, "S5", said("scheme", "skos:hasTopConcept", "concept"))
        claim(self.top_concepts, "concept", "skos:Concept", 1, "S6", said("scheme", "skos:hasTopConcept", "concept"))
        claim(self.in_scheme, "scheme", "skos:ConceptScheme", 2, "S4", said("node", "skos:inScheme", "scheme"))
        claim(self.links("skos:member"), "s", "skos:Collection", 3, "S31", said("s", "skos:member", "o"))
        listed = self.links("skos:memberList")
        claim(listed, "s", "skos:OrderedCollection", 4, "S33", said("s", "skos:memberList", "o"))
        ordered = typed.filter("o = 'skos:OrderedCollection'").select("g", "s").unionByName(listed.select("g", "s")).distinct()
        claim(ordered, "s", "skos:Collection", 5, "S29", F.concat(F.col("s"), F.lit(" rdf:type skos:OrderedCollection")))
        for pass_no, ps in ((6, (*V.MAPPINGS, "skos:mappingRelation")), (7, (*V.RELATIONS, "skos:semanticRelation"))):
            ends = self.links(*ps)
            at = F.lit(len(ps))
            for i, p in enumerate(ps):
                at = F.when(F.col("p") == p, F.lit(i)).otherwise(at)
            for role, node, rule in ((0, "s", "S19"), (1, "o", "S20")):
                claim(ends, node, "skos:Concept", pass_no, rule, said("s", "skos:semanticRelation", "o"), F.concat_ws("\x01", F.lpad(at.cast("string"), 2, "0"), "s", "o", F.lit(str(role))))
        forms = self.facts.filter("p = 'skosxl:literalForm'").select("g", "s", "o").distinct()
        claim(forms, "s", "skosxl:Label", 8, "S50", said("s", "skosxl:literalForm", "o"))
        xl = self.links(*V.XL_LABELS)
        claim(xl, "o", "skosxl:Label", 9, "S54", said("s", F.col("p"), "o"))
        related = self.links("skosxl:labelRelation")
        claim(related, "s", "skosxl:Label", 10, "S60", said("s", "skosxl:labelRelation", "o"), F.concat_ws("\x01", "s", "o", F.lit("0")))
        claim(related, "o", "skosxl:Label", 10, "S61", said("s", "skosxl:labelRelation", "o"), F.concat_ws("\x01", "s", "o", F.lit("1")))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    @cached_property
    def class_derivations(self) -> DataFrame:
        """(g, node, class, origin, premise): the first ground of each class."""
        won = self._class_claims().groupBy("g", "node", "class").agg(F.min(F.struct("pass_no", "place", "premise", "origin")).alias("w"))
        return won.select("g", "node", "class", F.col("w.origin").alias("origin"), F.col("w.premise").alias("premise"))

    @cached_property
    def classes(self) -> DataFrame:
        """(g, node, class, origin)."""
        return self.class_derivations.drop("premise")

    # -- labels ------------------------------------------------------------------------------------

    @cached_property
    def literal_forms(self) -> DataFrame:
        """(g, label, n_forms, n_plain, text, lang): forms of each label resource; text only if there is exactly one plain form."""
        x = self.facts.filter("p = 'skosxl:literalForm' and o_kind = 'literal'").select("g", F.col("s").alias("label"), "o", language(F.col("o_lang")).alias("lang"), "o_dt").distinct()
        plain = F.col("o_dt").isin(*V.PLAIN)
        one = F.struct(F.col("o").alias("text"), F.col("lang").alias("lang"))
        x = x.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n_forms"), F.sum(plain.cast("int")).alias("n_plain"), F.min(F.when(plain, one)).alias("form"))
        return x.select("g", "label", "n_forms", "n_plain", F.when(F.col("n_plain") == 1, F.col("form.text")).alias("text"), F.when(F.col("n_plain") == 1, F.col("form.lang")).alias("lang"))

    @cached_property
    def label_relations(self) -> DataFrame:
        """(g, s, o, origin), symmetric by S62."""
        x = self.links("skosxl:labelRelation").select("g", "s", "o", F.lit(0).alias("pass_no"), F.lit(ASSERTED).alias("origin"))
        return first_wins(x.unionByName(x.select("g", F.col("o").alias("s"), F.col("s").alias("o"), F.lit(1).alias("pass_no"), F.lit("S62").alias("origin"))), "g", "s", "o")

    @cached_property
    def labels(self) -> DataFrame:
        """(g, node, kind, lang, text, origin): plain literals stated, or reached through a label resource with one plain form (S55 to S57)."""
        x = self.facts.filter(F.col("p").isin(*V.LABELS) & (F.col("o_kind") == "literal") & F.col("o_dt").isin(*V.PLAIN))
        stated = x.select("g", F.col("s").alias("node"), F.col("p").alias("kind"), language(F.col("o_lang")).alias("lang"), F.col("o").alias("text"), F.lit(0).alias("pass_no"), F.lit(ASSERTED).alias("origin"))
        forms = self.literal_forms.filter("n_plain = 1").select("g", F.col("label").alias("o"), "text", "lang")
        via = self.links(*V.XL_LABELS).join(forms, ["g", "o"])
        chained = via.select(
            "g", F.col("s").alias("node"), mapped(F.col("p"), {k: v for k, (v, _) in V.XL_CHAIN.items()}).alias("kind"), "lang", "text",
            F.lit(1).alias("pass_no"), mapped(F.col("p"), {k: r for k, (_, r) in V.XL_CHAIN.items()}).alias("origin"),
        )
        out = first_wins(stated.unionByName(chained), "g", "node", "kind", "lang", "text")
        return out.withColumn("kind", mapped(F.col("kind"), V.LABEL_KINDS))

    @cached_property
    def display_labels(self) -> DataFrame:
        """(g, node, text): the first preferred label by (language, text), else the first alternative one; no tag comes first."""
        rank = F.when(F.col("kind") == "preferred", 0).when(F.col("kind") == "alternative", 1)
        x = self.labels.filter("kind <> 'hidden'").groupBy("g", "node").agg(F.min(F.struct(rank.alias("r"), F.coalesce("lang", F.lit("")).alias("l"), "text")).alias("m"))
        return x.select("g", "node", F.col("m.text").alias("text"))

    def preferred_in(self, tag: str | None) -> DataFrame:
        """(g, node, text): the preferred label in exactly this language, or without one; of several, the first by text."""
        lang = F.col("lang").isNull() if not tag else F.col("lang") == tag.lower()
        return self.labels.filter((F.col("kind") == "preferred") & lang).groupBy("g", "node").agg(F.min("text").alias("text"))

    # -- notes -------------------------------------------------------------------------------------

    @cached_property
    def refinements(self) -> DataFrame:
        """(g, property, kind): properties declared, in one or more steps, to refine a kind of note.  Declarations are few and
        the walk stops at the first SKOS note property of each chain."""
        stage = Stage(self.spark, "refinements")
        sub = stage.write(self.links("rdfs:subPropertyOf").filter("s <> o").select("g", F.col("s").alias("property"), F.col("o").alias("kind")), "declared")
        reached = front = sub
        while True:
            step = front.filter(~F.col("kind").isin(*V.NOTES)).join(sub.select("g", F.col("property").alias("kind"), F.col("kind").alias("next")), ["g", "kind"])
            step = step.select("g", "property", F.col("next").alias("kind")).distinct().join(reached, ["g", "property", "kind"], "left_anti")
            front, seen = stage.write(step, "reached", n=F.count(F.lit(1)))
            if not seen["n"]:
                break
            reached = reached.unionByName(front)
        return reached.filter(F.col("kind").isin(*V.NOTES) & ~F.col("property").isin(*V.NOTES)).distinct()

    @cached_property
    def notes(self) -> DataFrame:
        """(g, node, kind, value, value_kind, lang, datatype, origin): stated, by a refining property (rdfs7), or lifted to ``note`` (S17)."""
        cols = ("g", F.col("s").alias("node"), F.col("p").alias("kind"), F.col("o").alias("value"), F.col("o_kind").alias("value_kind"), language(F.col("o_lang")).alias("lang"), F.col("o_dt").alias("datatype"))
        stated = self.facts.filter(F.col("p").isin(*V.NOTES)).select(*cols, F.lit(0).alias("pass_no"), F.lit(ASSERTED).alias("origin"))
        refined = self.facts.join(self.refinements.withColumnRenamed("property", "p").withColumnRenamed("kind", "_k"), ["g", "p"])
        refined = refined.select(*cols[:2], F.col("_k").alias("kind"), *cols[3:], F.lit(1).alias("pass_no"), F.lit("rdfs7").alias("origin"))
        own = stated.unionByName(refined)
        lifted = own.filter(F.col("kind") != V.NOTE).withColumns({"kind": F.lit(V.NOTE), "pass_no": F.lit(2), "origin": F.lit("S17")})
        return first_wins(own.unionByName(lifted), "g", "node", "kind", "value", "value_kind", "lang", "datatype")

    # -- derivations -------------------------------------------------------------------------------

    @cached_property
    def derivations(self) -> DataFrame:
        """(g, conclusion, rule): every fact that the graph does not state, with the rule that gives it."""

        def of(df: DataFrame, origin: str, *parts: str | Column) -> DataFrame:
            return df.filter(F.col(origin) != ASSERTED).select("g", F.concat_ws(" ", *parts).alias("conclusion"), F.col(origin).alias("rule"))

        return (
            of(self.classes, "origin", "node", F.lit("rdf:type"), "class")
            .unionByName(of(self.top_concepts, "of_origin", "concept", F.lit("skos:topConceptOf"), "scheme"))
            .unionByName(of(self.top_concepts, "has_origin", "scheme", F.lit("skos:hasTopConcept"), "concept"))
            .unionByName(of(self.in_scheme, "origin", "node", F.lit("skos:inScheme"), "scheme"))
            .unionByName(of(self.members, "origin", "collection", F.lit("skos:member"), "member"))
            .unionByName(of(self.mappings, "origin", "s", "p", "o"))
            .unionByName(of(self.relations, "origin", "s", "p", "o"))
            .unionByName(of(self.label_relations, "origin", "s", F.lit("skosxl:labelRelation"), "o"))
            .unionByName(of(self.labels, "origin", "node", "kind", "text"))
            .unionByName(of(self.notes, "origin", "node", "kind", "value"))
        )
