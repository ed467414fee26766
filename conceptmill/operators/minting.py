"""New identifiers: slugs, numbers, patterns and the convention that a vocabulary follows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLUG_CHARS = 96


class MintRefused(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Pattern:
    """Text with exactly one of {n} and {slug}."""

    prefix: str
    placeholder: str
    suffix: str

    @classmethod
    def parse(cls, text: str) -> Pattern:
        found = re.findall(r"\{([^{}]*)\}", text)
        if text.count("{") > len(found):
            raise MintRefused("UnclosedPlaceholder", text)
        if not found:
            raise MintRefused("NoPlaceholder", text)
        if len(found) > 1:
            raise MintRefused("TwoPlaceholders", text)
        if found[0] not in ("n", "slug"):
            raise MintRefused("UnknownPlaceholder", found[0])
        prefix, suffix = text.split("{" + found[0] + "}")
        if re.search(r'[\s<>"{}|\\^`]', prefix + suffix):
            raise MintRefused("NotIriText", text)
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", prefix):
            raise MintRefused("NoScheme", text)
        return cls(prefix, found[0], suffix)

    def __str__(self) -> str:
        return f"{self.prefix}{{{self.placeholder}}}{self.suffix}"

    def fill(self, local: str) -> str:
        return f"{self.prefix}{local}{self.suffix}"

    def local_of(self, iri: Column) -> Column:
        """What stands in the placeholder's place; null for other identifiers."""
        n = len(self.prefix)
        inside = F.substring(iri, F.lit(n + 1), F.char_length(iri) - n - len(self.suffix))
        return F.when(iri.startswith(self.prefix) & iri.endswith(self.suffix) & (F.char_length(iri) > n + len(self.suffix)), inside)


def slug(label: Column, max_chars: int = SLUG_CHARS) -> Column:
    """Lower case, apostrophes dropped, letters and digits kept, anything else one hyphen; cut at a hyphen; null if nothing is left."""
    t = F.regexp_replace(F.lower(label), "['’]", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{Nd}\p{Nl}\p{No}]+", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    cut = F.substring(t, 1, max_chars)
    at_word = F.when(F.substring(t, max_chars + 1, 1) == "-", cut).otherwise(F.when(cut.contains("-"), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut))
    t = F.when(F.char_length(t) > max_chars, F.regexp_replace(at_word, "-+$", "")).otherwise(t)
    return F.when(t != "", t)


def namespace(iri: Column) -> Column:
    """Up to the last '#', or else the last '/'; null without a local part."""
    return F.nullif(F.regexp_extract(iri, r"^(.*#|[^#]*/)[^#/]+\z", 1), F.lit(""))


def local(iri: Column) -> Column:
    return F.nullif(F.regexp_extract(iri, r"^(?:.*#|[^#]*/)([^#/]+)\z", 1), F.lit(""))


def curie(iri: Column, prefixes: dict[str, str]) -> Column:
    out = iri
    for p, ns in prefixes.items():
        out = F.when(iri.startswith(ns), F.concat(F.lit(p + ":"), F.substring(iri, len(ns) + 1, 1 << 30))).otherwise(out)
    return out


def in_use(statements: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """(iri, found_in) of identifiers in any position of any graph that start and end so; the lowest graph of each."""
    parts = F.array(F.col("s"), F.col("p"), F.when(F.col("o_kind") != "literal", F.col("o")))
    seen = statements.select("g", F.explode(parts).alias("iri")).filter(F.col("iri").startswith(prefix) & F.col("iri").endswith(suffix))
    return seen.groupBy("iri").agg(F.min("g").alias("found_in"))


def highest(used: DataFrame, pattern: Pattern) -> DataFrame:
    """One row (number, iri, width): the greatest number in the pattern's place; of equal ones the lowest identifier."""
    t = used.withColumn("l", pattern.local_of(F.col("iri"))).filter(F.col("l").rlike(r"^[0-9]+\z")).withColumn("number", F.col("l").try_cast("long")).filter("number is not null")
    return t.orderBy(F.desc("number"), "iri").limit(1).select("number", "iri", F.char_length("l").alias("width"))


def mint(statements: DataFrame, pattern: Pattern, label: str | None = None) -> str:
    """A new identifier; a number goes one above the highest in use and keeps its zeros in front."""
    spark = statements.sparkSession
    if pattern.placeholder == "slug":
        if label is None:
            raise MintRefused("LabelRequired")
        got = spark.createDataFrame([(label,)], "t string").select(slug(F.col("t"))).collect()[0][0]
        if got is None:
            raise MintRefused("Unusable", label)
        iri = pattern.fill(got)
    else:
        top = highest(in_use(statements, pattern.prefix, pattern.suffix), pattern).collect()
        number = top[0]["number"] + 1 if top else 1
        if number >= 1 << 63:
            raise MintRefused("Exhausted", str(number))
        padded = top and len(str(top[0]["number"])) < top[0]["width"]
        iri = pattern.fill(str(number).zfill(top[0]["width"]) if padded else str(number))
    taken = in_use(statements, iri).filter(F.col("iri") == iri).collect()
    if taken:
        raise MintRefused("Taken", f"{iri} in {taken[0]['found_in']}")
    if re.search(r'[\s<>"{}|\\^`]', iri):
        raise MintRefused("NotAnIri", iri)
    return iri


def namespaces(classes: DataFrame) -> DataFrame:
    """(g, namespace, fixed, n, n_numbered): concepts by namespace and by what stands before trailing digits."""
    c = classes.filter(F.col("class") == "skos:Concept").select("g", F.col("node").alias("iri")).filter(~F.col("iri").startswith("_:"))
    c = c.select("g", namespace(F.col("iri")).alias("namespace"), local(F.col("iri")).alias("l")).filter("namespace is not null")
    numbered = F.col("l").rlike("[0-9]+$")
    return c.groupBy("g", "namespace", F.when(numbered, F.regexp_replace("l", "[0-9]+$", "")).alias("fixed")).agg(F.count(F.lit(1)).alias("n"), F.count_if(numbered).alias("n_numbered"))


def convention(classes: DataFrame) -> DataFrame:
    """(g, namespace, n, concepts, fixed, n_numbered, pattern): the leading namespace of each graph's concepts; the pattern is null unless
    it holds more than half of them, and numbered if more than half of its identifiers are."""
    by = namespaces(classes)
    total = classes.filter(F.col("class") == "skos:Concept").groupBy("g").agg(F.count_distinct("node").alias("concepts"))
    ns = by.groupBy("g", "namespace").agg(
        F.sum("n").alias("n"), F.sum("n_numbered").alias("n_numbered"),
        F.min(F.when(F.col("fixed").isNotNull(), F.struct((-F.col("n")).alias("r"), "fixed"))).alias("lead"),
    )
    first = ns.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("r"), "namespace", "n", "n_numbered", "lead")).alias("x")).select("g", "x.namespace", "x.n", "x.n_numbered", F.col("x.lead.fixed").alias("fixed"))
    out = first.join(total, "g")
    most = F.col("n") * 2 > F.col("concepts")
    numbered = F.col("fixed").isNotNull() & (F.col("n_numbered") * 2 > F.col("n"))
    pattern = F.when(most & numbered, F.concat("namespace", "fixed", F.lit("{n}"))).when(most, F.concat("namespace", F.lit("{slug}")))
    return out.select("g", "namespace", "n", "concepts", F.when(numbered, F.col("fixed")).alias("fixed"), "n_numbered", pattern.alias("pattern"))


def agreed(classes: DataFrame, g: str) -> Pattern:
    """The convention of one graph, refused where there is none: without concepts, without identifiers among them, or without a majority;
    or one that is no pattern."""
    mine = classes.filter((F.col("g") == g) & (F.col("class") == "skos:Concept"))
    if mine.isEmpty():
        raise MintRefused("NoConcepts", g)
    if mine.filter(~F.col("node").startswith("_:")).isEmpty():
        raise MintRefused("NoIris", g)
    row = convention(mine).select("pattern").collect()  # one graph, one row at most
    if not row or row[0]["pattern"] is None:
        raise MintRefused("NoMajority", g)
    try:
        return Pattern.parse(row[0]["pattern"])
    except MintRefused as e:
        raise MintRefused("Unusable", str(e)) from e


def chosen(given: str | None, recorded: str | None, inferred: str | None) -> tuple[str, Pattern]:
    """Given before recorded before inferred; a pattern that cannot be read is refused, not skipped."""
    for name, text in (("given", given), ("recorded", recorded), ("inferred", inferred)):
        if text is not None:
            return name, Pattern.parse(text)
    raise MintRefused("NoConvention")
