"""One consistent form for texts that look alike.

Texts with other than printable ASCII characters are exploded to code points with their positions, joined by
broadcast with the table of decompositions and look-alikes (a part of Unicode, so bounded by it), put in order
of combining class between starters, rebuilt, and recomposed.  Printable ASCII is a fixed point of the
mapping and stays.  Work is one shuffle of code points by text; no Python runs on the executors.

The form tells apart what reads differently: accents, raised and circled signs, and letter case are kept.
``folds`` gives what reads the same with letter case aside.  A capital such as Н reads as a Latin H or as
the capital of н, so a text with such capitals has two folds.

Defined cases: null stays null; an empty text, or one of invisible characters only, becomes empty; repeated rows
keep one row each; all columns pass through, whatever their names; runs of spaces are not merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import Stage
from .lookalikes import compositions, spread_table, two_faced

_PLAIN = r"^[ -~]*\z"
_SEP, _EQ = "\x01", "\x02"


def _literal_map(pairs: dict[str, str]) -> Column:
    """A constant map; Catalyst folds it once."""
    return F.str_to_map(F.lit(_SEP.join(f"{k}{_EQ}{v}" for k, v in pairs.items())), F.lit(_SEP), F.lit(_EQ))


def _char_class(chars: set[str]) -> str:
    """Ranges for a regular expression."""
    points = sorted(map(ord, chars))
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:X}}}-\\x{{{points[j]:X}}}")
        i = j + 1
    return "".join(out)


def _code(c: Column) -> Column:
    return F.ascii(c)


def _hangul(a: Column, b: Column) -> Column:
    """Leading and vowel jamo, or a syllable without final and a final jamo, by the rule of the standard."""
    x, y = _code(a), _code(b)
    lv = F.when(x.between(0x1100, 0x1112) & y.between(0x1161, 0x1175), 0xAC00 + ((x - 0x1100) * 21 + y - 0x1161) * 28)
    lvt = F.when(x.between(0xAC00, 0xD7A3) & ((x - 0xAC00) % 28 == 0) & y.between(0x11A8, 0x11C2), x + y - 0x11A7)
    return F.decode(F.unhex(F.lpad(F.hex(F.coalesce(lv, lvt)), 4, "0")), "UTF-16BE")


def recomposed(text: Column) -> Column:
    """Canonical composition of a text that is decomposed and in canonical order."""
    pairs = compositions()
    marks = {c: seq[0][1] for c, seq in spread_table() if len(seq) == 1 and seq[0][0] == c and seq[0][1]}
    seconds = {p[1] for p in pairs} | {chr(n) for n in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    attached = _char_class(set(marks) | seconds)
    pair_map, class_map = _literal_map(pairs), _literal_map({c: str(k) for c, k in marks.items()})
    joined = lambda a, b: F.coalesce(F.try_element_at(pair_map, F.concat(a, b)), _hangul(a, b))

    def state(done: Column, base: Column, rest: Column, last: Column) -> Column:
        return F.struct(done.alias("done"), base.alias("base"), rest.alias("rest"), last.alias("last"))

    def step(acc: Column, m: Column) -> Column:
        k = F.coalesce(F.try_element_at(class_map, m).cast("int"), F.lit(0))
        free = (acc["rest"] == "") | ((k != 0) & (acc["last"] < k))
        got = F.when(free, joined(acc["base"], m))
        whole = F.concat(acc["done"], acc["base"], acc["rest"])
        return (
            F.when(got.isNotNull(), state(acc["done"], got, acc["rest"], acc["last"]))
            .when(k == 0, state(whole, m, F.lit(""), F.lit(0)))  # a starter that does not join goes on alone
            .otherwise(state(acc["done"], acc["base"], F.concat(acc["rest"], m), k))
        )

    def cluster(c: Column) -> Column:
        start = state(F.lit(""), F.substring(c, 1, 1), F.lit(""), F.lit(0))
        fold = F.aggregate(F.split(F.substring(c, 2, 1 << 30), ""), start, step, lambda acc: F.concat(acc["done"], acc["base"], acc["rest"]))
        return F.when(F.char_length(c) == 1, c).otherwise(fold)

    clusters = F.regexp_extract_all(text, F.lit(f"(?s)([{attached}]|[^{attached}][{attached}]*)"), F.lit(1))
    return F.when(text.rlike(f"[{_char_class(seconds)}]"), F.array_join(F.transform(clusters, cluster), "")).otherwise(text)


def normalized(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` with the consistent form of ``text`` in ``out``."""
    spark = df.sparkSession
    stage = Stage(spark, "normalize")
    rows = stage.write(df.select(F.struct("*").alias("row"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("rid")), "texts")
    exploded = ~F.col("t").rlike(_PLAIN)
    chars = rows.filter(exploded).select("rid", F.posexplode(F.split("t", "")).alias("pos", "ch"))
    seqs = F.broadcast(spark.createDataFrame(spread_table(), "ch string, seq array<struct<c:string,k:int>>"))
    itself = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k")))
    points = chars.join(seqs, "ch", "left").select("rid", "pos", F.posexplode(F.coalesce("seq", itself)).alias("sub", "x"))
    points = points.select("rid", (F.col("pos").cast("long") * 64 + F.col("sub")).alias("at"), F.col("x.c").alias("c"), F.col("x.k").alias("k"))
    up_to = W.partitionBy("rid").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    points = points.withColumn("starter", F.sum((F.col("k") == 0).cast("int")).over(up_to))
    ordered = F.sort_array(F.collect_list(F.struct("starter", "k", "at", "c")))
    rebuilt = points.groupBy("rid").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("f"))
    forms = rebuilt.select("rid", recomposed(F.col("f")).alias("f"))
    # texts that map to themselves do not go through the join
    changed = rows.filter(exploded).join(forms, "rid", "left").select("row.*", F.coalesce("f", F.lit("")).alias(out))
    return rows.filter(F.col("t").isNull() | ~exploded).select("row.*", F.col("t").alias(out)).unionByName(changed)


def folds(df: DataFrame, text: str, out: str = "fold") -> DataFrame:
    """``df`` with a row for each way in which ``text`` reads, letter case aside."""
    small = F.lower(text)
    two = F.col(text).rlike(f"[{_char_class(set(two_faced()))}]")
    both = df.select(F.struct("*").alias("all"), F.explode(F.when(two, F.array(F.col(text), small)).otherwise(F.array(F.col(text)))).alias("_way"))
    return normalized(both, "_way", "_form").select("all.*", F.lower("_form").alias(out)).distinct()
