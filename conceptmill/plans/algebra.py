"""SPARQL algebra on frames.

A solution is a row; variable ``x`` is the column ``v_x``, a struct (k kind, v value, l language or '', d datatype or '').
Unbound is null, and an error in an expression is null too, so three-valued logic comes from SQL.  Every pattern
becomes joins, filters and aggregates that Catalyst plans; only paths of unknown length loop.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.xsd import canonical, trimmed
from ..sources.rdf import expanded, expanded_column, shortened_column
from ..staging import Stage
from .sparql import Query, QueryRefused, parse, variables

TERM = "struct<k:string,v:string,l:string,d:string>"
_INTEGERS = ("xsd:integer", "xsd:int", "xsd:long", "xsd:short", "xsd:byte", "xsd:nonNegativeInteger", "xsd:positiveInteger", "xsd:nonPositiveInteger", "xsd:negativeInteger", "xsd:unsignedInt", "xsd:unsignedLong", "xsd:unsignedShort", "xsd:unsignedByte")
_RANKS = ("xsd:integer", "xsd:decimal", "xsd:float", "xsd:double")


def _term(k: str | Column, v: Column, l: str | Column = "", d: str | Column = "") -> Column:  # noqa: E741
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(k).alias("k"), v.alias("v"), lit(l).alias("l"), lit(d).alias("d"))


def constant(t: tuple) -> Column:
    if t[0] == "iri":
        return _term("iri", F.lit(t[1]))
    return _term("literal", F.lit(t[1]), t[2] or "", t[3])


@dataclass
class Val:
    """A typed intermediate value: term, bool, num (double, rank, integer) or text."""

    kind: str
    cols: tuple[Column, ...]


def number(x: Val) -> tuple[Column, Column, Column]:
    """(double, rank 0 integer to 3 double, exact integer or null)."""
    if x.kind == "num":
        return x.cols  # type: ignore[return-value]
    if x.kind != "term":
        return F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("long")
    t = x.cols[0]
    d, v = t["d"], t["v"]
    v = trimmed(v)
    whole, dec, dbl = d.isin(*_INTEGERS), d == "xsd:decimal", d.isin("xsd:double", "xsd:float")
    exact = F.when(whole & v.rlike(r"^[+-]?[0-9]+\z"), v.try_cast("long"))
    special = F.when(v.isin("INF", "+INF"), float("inf")).when(v == "-INF", float("-inf")).when(v == "NaN", float("nan"))
    spelled = v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    value = F.when(whole, exact.cast("double")).when(spelled & (dbl | (dec & ~F.lower(v).contains("e"))), v.try_cast("double")).when(dbl, special)
    rank = F.when(whole, 0).when(dec, 1).when(d == "xsd:float", 2).when(d == "xsd:double", 3)
    return value, F.when(value.isNotNull(), rank), exact


def term(x: Val) -> Column:
    if x.kind == "term":
        return x.cols[0]
    if x.kind == "bool":
        return F.when(x.cols[0].isNotNull(), _term("literal", x.cols[0].cast("string"), "", "xsd:boolean"))
    if x.kind == "num":
        value, rank, exact = x.cols
        plain = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        shown = F.when(rank == 0, F.coalesce(exact, value.cast("long")).cast("string")).when(rank == 1, plain).otherwise(
            F.when(value == float("inf"), "INF").when(value == float("-inf"), "-INF").otherwise(value.cast("string"))
        )
        return F.when(value.isNotNull() & rank.isNotNull(), _term("literal", shown, "", F.element_at(F.array(*[F.lit(r) for r in _RANKS]), rank + 1)))
    value, lang = x.cols
    tagged = F.coalesce(lang, F.lit(""))
    return F.when(value.isNotNull(), _term("literal", value, tagged, F.when(tagged != "", "rdf:langString").otherwise("xsd:string")))


def truth(x: Val) -> Column:
    """Effective boolean value; null is an error."""
    if x.kind == "bool":
        return x.cols[0]
    if x.kind == "num":
        return (x.cols[0] != 0) & ~F.isnan(x.cols[0])
    if x.kind == "text":
        return F.length(x.cols[0]) > 0
    t = x.cols[0]
    n = number(x)[0]
    return (
        F.when(t["k"] != "literal", F.lit(None).cast("boolean")).when(t["d"] == "xsd:boolean", F.coalesce(canonical(t["v"], "xsd:boolean") == "true", F.lit(False)))
        .when(t["d"].isin("xsd:string", "rdf:langString"), F.length(t["v"]) > 0).when(n.isNotNull(), (n != 0) & ~F.isnan(n))
    )


def text(x: Val) -> Column:
    """The text of a string literal; null for anything else."""
    if x.kind == "text":
        return x.cols[0]
    if x.kind == "term":
        t = x.cols[0]
        return F.when((t["k"] == "literal") & t["d"].isin("xsd:string", "rdf:langString"), t["v"])
    return F.lit(None).cast("string")


def lang(x: Val) -> Column:
    return x.cols[0]["l"] if x.kind == "term" else x.cols[1] if x.kind == "text" else F.lit("")


def _known_kind(*sides: tuple) -> str | None:
    """'num', 'plain' or 'node' if a constant on either side decides how the two are compared."""
    for e in sides:
        if e[0] == "const":
            if e[1][0] == "iri":
                return "node"
            if e[1][3] in (*_INTEGERS, *_RANKS):
                return "num"
            if e[1][3] in ("xsd:string", "rdf:langString"):
                return "plain"
        elif e[0] == "math":
            return "num"
    return None


def compared(o: str, a: Val, b: Val, known: str | None = None) -> Column:
    if a.kind == b.kind == "bool":
        x, y = a.cols[0].cast("int"), b.cols[0].cast("int")
        return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[o]
    (na, _, ia), (nb, _, ib) = number(a), number(b)
    ta, tb = term(a), term(b)
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    f = ops[o]
    exact = ia.isNotNull() & ib.isNotNull()
    numeric = na.isNotNull() & nb.isNotNull()
    nan = F.isnan(na) | F.isnan(nb)
    equality = o in ("=", "!=")
    if known == "num":
        out = F.when(exact, f(ia, ib)).when(numeric, F.when(nan, F.lit(o == "!=")).otherwise(f(na, nb)))
        return out.when(ta.isNotNull() & tb.isNotNull(), F.lit(o == "!=")) if equality else out
    if known == "node" or (known == "plain" and equality):
        return f(ta, tb) if equality else F.lit(None).cast("boolean")
    if known == "plain":
        return F.when((ta["d"] == "xsd:string") & (tb["d"] == "xsd:string"), f(ta["v"], tb["v"]))
    at = lambda t, d: F.when(t["d"] == d, canonical(t["v"], d))
    parts = []
    for d in ("xsd:dateTime", "xsd:date"):
        sec = lambda t, d=d: F.regexp_extract(at(t, d), r"^(-?[0-9]+)", 1).try_cast("decimal(38,9)") + F.coalesce(F.regexp_extract(at(t, d), r"(\.[0-9]+)$", 1).try_cast("decimal(38,9)"), F.lit(0))
        parts.append((at(ta, d).isNotNull() & at(tb, d).isNotNull(), f(sec(ta), sec(tb))))
    plain = (ta["d"] == tb["d"]) & (ta["l"] == tb["l"]) & ta["d"].isin("xsd:string", "rdf:langString")
    boolean = (ta["d"] == "xsd:boolean") & (tb["d"] == "xsd:boolean")
    out = F.when(exact, f(ia, ib)).when(numeric, F.when(nan, F.lit(o == "!=")).otherwise(f(na, nb)))
    for cond, value in parts:
        out = out.when(cond, value)
    out = out.when(boolean, f(canonical(ta["v"], "xsd:boolean"), canonical(tb["v"], "xsd:boolean")))
    if equality:
        return F.when(ta.isNull() | tb.isNull(), F.lit(None).cast("boolean")).otherwise(out.otherwise(f(ta, tb)))
    return out.when(plain & (ta["d"] == "xsd:string"), f(ta["v"], tb["v"]))


def arithmetic(o: str, a: Val, b: Val) -> Val:
    (x, rx, ix), (y, ry, iy) = number(a), number(b)
    rank = F.greatest(rx, ry)
    rank = F.when(rx.isNull() | ry.isNull(), F.lit(None).cast("int")).otherwise(rank)
    if o == "/":
        rank = F.greatest(rank, F.lit(1))
        return Val("num", (F.when((y == 0) & (rank < 2), F.lit(None)).otherwise(F.try_divide(x, y)), F.when(rank.isNotNull(), rank), F.lit(None).cast("long")))
    f = {"+": (lambda p, q: p + q, F.try_add), "-": (lambda p, q: p - q, F.try_subtract), "*": (lambda p, q: p * q, F.try_multiply)}[o]
    exact = f[1](ix, iy)
    both = ix.isNotNull() & iy.isNotNull()
    return Val("num", (F.when(both, exact.cast("double")).otherwise(f[0](x, y)), F.when(both & exact.isNull(), F.lit(None).cast("int")).otherwise(rank), exact))


def call(name: str, a: list[Val]) -> Val:
    none = F.lit("")
    t = term(a[0]) if a else None
    s = text(a[0]) if a else None
    num = number(a[0]) if a else None
    as_text = lambda c, l=none: Val("text", (c, l))  # noqa: E731,E741
    boolean = lambda c: Val("bool", (c,))
    whole = lambda c: Val("num", (c.cast("double"), F.when(c.isNotNull(), 0), c.cast("long")))
    stamp = lambda: F.when(t["d"] == "xsd:dateTime", t["v"])
    second = lambda: text(a[1])
    match name:
        case "str":
            return as_text(F.when(t["k"] == "iri", expanded_column(t["v"])).when(t["k"] == "literal", t["v"]))
        case "lang":
            return as_text(F.when(t["k"] == "literal", t["l"]))
        case "langmatches":
            r = F.lower(second())
            low = F.lower(s)
            return boolean(F.when(r == "*", low != "").otherwise((low == r) | low.startswith(F.concat(r, F.lit("-")))))
        case "datatype":
            return Val("term", (F.when(t["k"] == "literal", _term("iri", t["d"])),))
        case "iri" | "uri":
            return Val("term", (F.when(t["k"] == "iri", t).when(s.isNotNull(), _term("iri", shortened_column(s))),))
        case "bnode":
            return Val("term", (_term("bnode", F.concat(F.lit("_:"), F.replace(F.uuid(), F.lit("-"), F.lit("")))),))
        case "isiri" | "isuri":
            return boolean(t["k"] == "iri")
        case "isblank":
            return boolean(t["k"] == "bnode")
        case "isliteral":
            return boolean(t["k"] == "literal")
        case "isnumeric":
            return boolean(F.when(t.isNotNull(), num[0].isNotNull()))
        case "sameterm":
            return boolean(t == term(a[1]))
        case "strlen":
            return whole(F.char_length(s))
        case "ucase":
            return as_text(F.upper(s), lang(a[0]))
        case "lcase":
            return as_text(F.lower(s), lang(a[0]))
        case "substr":
            start = number(a[1])[0].cast("int")
            size = number(a[2])[0].cast("int") if len(a) > 2 else F.lit(1 << 30)
            skipped = F.least(start - 1, F.lit(0))
            return as_text(F.substring(s, F.greatest(start, F.lit(1)), F.greatest(size + skipped, F.lit(0))), lang(a[0]))
        case "contains":
            return boolean(s.contains(second()))
        case "strstarts":
            return boolean(s.startswith(second()))
        case "strends":
            return boolean(s.endswith(second()))
        case "strbefore":
            at = F.instr(s, second())
            return as_text(F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.when(s.isNotNull(), "")), F.when(at > 0, lang(a[0])).otherwise(none))
        case "strafter":
            at = F.instr(s, second())
            return as_text(F.when(at > 0, F.substring(s, at + F.char_length(second()), F.lit(1 << 30))).otherwise(F.when(s.isNotNull(), "")), F.when(at > 0, lang(a[0])).otherwise(none))
        case "concat":
            parts = [text(x) for x in a]
            out = reduce(lambda x, y: F.concat(x, y), parts, F.lit(""))
            same = reduce(lambda x, y: x & y, [lang(x) == lang(a[0]) for x in a], F.lit(True)) if a else F.lit(False)
            return as_text(out, F.when(same, lang(a[0])).otherwise(none) if a else none)
        case "replace":
            flags = text(a[3]) if len(a) > 3 else F.lit("")
            pattern = F.concat(F.when(flags != "", F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(""), second())
            return as_text(F.regexp_replace(s, pattern, text(a[2])), lang(a[0]))
        case "regex":
            flags = text(a[2]) if len(a) > 2 else F.lit("")
            pattern = F.concat(F.when(flags != "", F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(""), second())
            return boolean(F.regexp_like(s, pattern))
        case "encode_for_uri":
            return as_text(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")))
        case "abs" | "ceil" | "floor" | "round":
            f = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda c: F.floor(c + 0.5)}[name]
            return Val("num", (f(num[0]).cast("double"), num[1], F.abs(num[2]) if name == "abs" else num[2]))
        case "rand":
            return Val("num", (F.rand(), F.lit(3), F.lit(None).cast("long")))
        case "uuid":
            return Val("term", (_term("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),))
        case "struuid":
            return as_text(F.uuid())
        case "now":
            return Val("term", (_term("literal", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "", "xsd:dateTime"),))
        case "year" | "month" | "day" | "hours" | "minutes":
            i = {"year": 1, "month": 2, "day": 3, "hours": 4, "minutes": 5}[name]
            return whole(F.regexp_extract(stamp(), r"^(-?\d+)-(\d\d)-(\d\d)T(\d\d):(\d\d)", i).try_cast("long"))
        case "seconds":
            v = F.regexp_extract(stamp(), r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1).try_cast("double")
            return Val("num", (v, F.when(v.isNotNull(), 1), F.lit(None).cast("long")))
        case "tz":
            return as_text(F.when(stamp().isNotNull(), F.regexp_extract(stamp(), r"(Z|[+-]\d\d:\d\d)$", 1)))
        case "timezone":
            z = F.regexp_extract(stamp(), r"(Z|[+-]\d\d:\d\d)$", 1)
            h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
            body = F.concat(F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
            body = F.when((z == "Z") | ((h == 0) & (m == 0)), "PT0S").otherwise(F.concat(F.when(z.startswith("-"), "-").otherwise(""), body))
            return Val("term", (F.when(z != "", _term("literal", body, "", "xsd:dayTimeDuration")),))
        case "md5":
            return as_text(F.md5(s))
        case "sha1":
            return as_text(F.sha1(s))
        case "sha256" | "sha384" | "sha512":
            return as_text(F.sha2(s, int(name[3:])))
        case "strdt":
            return Val("term", (F.when(s.isNotNull(), _term("literal", s, "", term(a[1])["v"])),))
        case "strlang":
            return Val("term", (F.when(s.isNotNull(), _term("literal", s, second(), "rdf:langString")),))
        case "bound":
            return boolean(t.isNotNull())
        case "if":
            c = truth(a[0])
            return Val("term", (F.when(c, term(a[1])).when(~c, term(a[2])),))
        case "coalesce":
            return Val("term", (F.coalesce(*[term(x) for x in a]),))
    raise QueryRefused("QuerySyntax", f"unknown function {name}")


def cast(datatype: str, x: Val) -> Val:
    t = term(x)
    if datatype == "xsd:string":
        return Val("text", (F.when(t["k"] == "iri", expanded_column(t["v"])).otherwise(t["v"]), F.lit("")))
    if datatype == "xsd:boolean":
        n = number(x)[0]
        return Val("bool", (F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).otherwise(canonical(t["v"], "xsd:boolean") == "true"),))
    n, rank, exact = number(x)
    if datatype in ("xsd:integer", "xsd:decimal", "xsd:double", "xsd:float"):
        value = F.coalesce(n, canonical(t["v"], "xsd:double" if datatype in ("xsd:double", "xsd:float") else datatype).try_cast("double"))
        if datatype == "xsd:integer":
            whole = F.coalesce(exact, canonical(t["v"], "xsd:integer").try_cast("long"), F.when(~F.isnan(value), value.try_cast("long")))
            return Val("num", (whole.cast("double"), F.when(whole.isNotNull(), 0), whole))
        return Val("num", (value, F.when(value.isNotNull(), _RANKS.index(datatype)), F.lit(None).cast("long")))
    if datatype in ("xsd:dateTime", "xsd:date"):
        return Val("term", (F.when(canonical(t["v"], datatype).isNotNull(), _term("literal", t["v"], "", datatype)),))
    raise QueryRefused("QuerySyntax", f"unknown function {datatype}")


def evaluate(e: tuple, env: dict[str, Column]) -> Val:
    kind = e[0]
    if kind == "var":
        return Val("term", (env[e[1]] if e[1] in env else F.lit(None).cast(TERM),))
    if kind == "const":
        return Val("term", (constant(e[1]),))
    if kind == "flag":
        return Val("bool", (F.col(e[1]),))
    if kind in ("and", "or"):
        a, b = truth(evaluate(e[1], env)), truth(evaluate(e[2], env))
        return Val("bool", (a & b if kind == "and" else a | b,))
    if kind == "not":
        return Val("bool", (~truth(evaluate(e[1], env)),))
    if kind == "cmp":
        return Val("bool", (compared(e[1], evaluate(e[2], env), evaluate(e[3], env), _known_kind(e[2], e[3])),))
    if kind == "in":
        x = evaluate(e[1], env)
        return Val("bool", (reduce(lambda a, b: a | b, [compared("=", x, evaluate(y, env), _known_kind(e[1], y)) for y in e[2]], F.lit(False)),))
    if kind == "math":
        return arithmetic(e[1], evaluate(e[2], env), evaluate(e[3], env))
    if kind == "call":
        return call(e[1], [evaluate(x, env) for x in e[2]])
    if kind == "cast":
        return cast(e[1], evaluate(e[2], env))
    if kind == "agg":
        return Val("term", (env[_agg_name(e)],))
    raise QueryRefused("QuerySyntax", f"unexpected {kind}")


def _agg_name(e: tuple) -> str:
    return f"#{abs(hash(repr(e)))}"


def mentioned(e: object) -> set[str]:
    """Variables in an expression."""
    if isinstance(e, tuple):
        if len(e) == 2 and e[0] == "var":
            return {e[1]}
        return set().union(*[mentioned(x) for x in e]) if e else set()
    if isinstance(e, list):
        return set().union(*[mentioned(x) for x in e]) if e else set()
    return set()


# -- solutions ---------------------------------------------------------------------------------------


@dataclass
class Solutions:
    df: DataFrame
    vars: list[str]
    maybe: set[str] = field(default_factory=set)

    @property
    def env(self) -> dict[str, Column]:
        return {v: F.col(f"v_{v}") for v in self.vars}


def _match(a: Solutions, b: Solutions, shared: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Compatible on the shared variables; those that may be unbound match anything."""
    out = F.lit(True)
    for v in shared:
        x, y = left[f"v_{v}"], right[f"r_{v}"]
        same = x == y
        if v in a.maybe or v in b.maybe:
            same = x.isNull() | y.isNull() | same
        out = same if out is None else out & same
    return out


def _renamed(b: Solutions) -> DataFrame:
    return b.df.select(*[F.col(f"v_{v}").alias(f"r_{v}") for v in b.vars])


def join(a: Solutions, b: Solutions, how: str = "inner", conditions: list | None = None) -> Solutions:
    shared = [v for v in a.vars if v in b.vars]
    right = _renamed(b)
    on = _match(a, b, shared, a.df, right)
    both = {v: F.coalesce(F.col(f"v_{v}"), F.col(f"r_{v}")) if v in shared and v in a.maybe else F.col(f"v_{v}") if v in a.vars else F.col(f"r_{v}") for v in dict.fromkeys([*a.vars, *b.vars])}
    for e in conditions or []:
        on = on & F.coalesce(truth(evaluate(e, both)), F.lit(False))
    if how in ("left_semi", "left_anti"):
        return Solutions(a.df.join(right, on, how), a.vars, a.maybe)
    joined = a.df.crossJoin(right) if how == "inner" and not shared and not conditions else a.df.join(right, on, how)
    if how == "left":
        maybe = a.maybe | {v for v in b.vars if v not in a.vars}
    else:
        maybe = {v for v in both if (v not in a.vars or v in a.maybe) and (v not in b.vars or v in b.maybe)}
    return Solutions(joined.select(*[c.alias(f"v_{v}") for v, c in both.items()]), list(both), maybe)


class Dataset:
    """Statements to be asked about; the default graph is the merge of the given graphs, a set."""

    def __init__(self, statements: DataFrame, default: list[str] | None = None, named: list[str] | None = None):
        cols = ("g", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt")
        self.spark: SparkSession = statements.sparkSession
        self.all = statements.select(*cols)
        self.default = self.all if default is None else self.all.filter(F.col("g").isin(default))
        self.named = self.all if named is None else self.all.filter(F.col("g").isin(named))
        self.stage = Stage(self.spark, "sparql")
        self._once = True  # whether a pattern's solutions have to be a set

    # scans
    def scan(self, graph: tuple | None) -> DataFrame:
        if graph is None:
            return self.default.withColumn("g", F.lit(None).cast("string"))
        return self.named.filter(F.col("g") == graph[1]) if graph[0] == "iri" else self.named

    def triple(self, t: tuple, graph: tuple | None) -> Solutions:
        s, p, o = t
        if p[0] not in ("var", "link"):
            return self.path_pattern(s, p, o, graph)
        df = self.scan(graph)
        node = lambda c, k: _term(F.col(k), F.col(c))
        o_term = F.when(F.col("o_kind") == "literal", _term("literal", F.col("o"), F.coalesce("o_lang", F.lit("")), F.col("o_dt"))).otherwise(node("o", "o_kind"))
        parts: list[tuple[str, Column]] = []
        if p[0] == "link":
            df = df.filter(F.col("p") == p[1])
        else:
            parts.append((p[1], _term("iri", F.col("p"))))
        if s[0] == "iri":
            df = df.filter((F.col("s") == s[1]) & (F.col("s_kind") == "iri"))
        elif s[0] == "lit":
            df = df.filter(F.lit(False))
        else:
            parts.append((s[1], node("s", "s_kind")))
        if o[0] == "iri":
            df = df.filter((F.col("o") == o[1]) & (F.col("o_kind") == "iri"))
        elif o[0] == "lit":
            df = df.filter((F.col("o_kind") == "literal") & (F.col("o") == o[1]) & (F.col("o_dt") == o[3]) & (F.coalesce("o_lang", F.lit("")) == (o[2] or "")))
        else:
            parts.append((o[1], o_term))
        if graph is not None and graph[0] == "var":
            parts.append((graph[1], _term("iri", F.col("g"))))
        return self._bind(df, parts)

    def _bind(self, df: DataFrame, parts: list[tuple[str, Column]]) -> Solutions:
        names = list(dict.fromkeys(n for n, _ in parts))
        df = df.select(*[c.alias(f"_{i}") for i, (_, c) in enumerate(parts)]) if parts else df.select(F.lit(1).alias("_one"))
        first: dict[str, int] = {}
        for i, (n, _) in enumerate(parts):
            if n in first:
                df = df.filter(F.col(f"_{i}") == F.col(f"_{first[n]}"))
            else:
                first[n] = i
        if not names:
            return Solutions(df.select("_one").distinct().drop("_one"), [])
        out = df.select(*[F.col(f"_{first[n]}").alias(f"v_{n}") for n in names])
        return Solutions(out.distinct() if self._once else out, names)

    def any_of(self, p: tuple, graph: tuple | None) -> Solutions:
        """A pattern of which only matters whether there is a solution, so repeated ones may stay; sub-selects are sets again."""
        was, self._once = self._once, False
        try:
            return self.pattern(p, graph)
        finally:
            self._once = was

    # paths
    def pairs(self, p: tuple, graph: tuple | None) -> DataFrame:
        """(g, a, b) linked by a path, each once."""
        kind = p[0]
        if kind in ("link", "not"):
            df = self.scan(graph)
            a = _term(F.col("s_kind"), F.col("s"))
            b = F.when(F.col("o_kind") == "literal", _term("literal", F.col("o"), F.coalesce("o_lang", F.lit("")), F.col("o_dt"))).otherwise(_term(F.col("o_kind"), F.col("o")))
            if kind == "link":
                return df.filter(F.col("p") == p[1]).select("g", a.alias("a"), b.alias("b")).distinct()
            out = df.filter(~F.col("p").isin(p[1]) if p[1] else F.lit(True)).select("g", a.alias("a"), b.alias("b"))
            back = df.filter(~F.col("p").isin(p[2])).select("g", b.alias("a"), a.alias("b")) if p[2] else None
            if back is None:
                return out.distinct()
            return (back if not p[1] else out.unionByName(back)).distinct()
        if kind == "inv":
            return self.pairs(p[1], graph).select("g", F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "seq":
            x, y = self.pairs(p[1], graph), self.pairs(p[2], graph).select(F.col("g").alias("h"), F.col("a").alias("m"), F.col("b").alias("c"))
            return x.join(y, x.b.eqNullSafe(y.m) & x.g.eqNullSafe(y.h)).select("g", "a", F.col("c").alias("b")).distinct()
        if kind == "alt":
            return self.pairs(p[1], graph).unionByName(self.pairs(p[2], graph)).distinct()
        if kind == "opt":
            return self.pairs(p[1], graph).unionByName(self.same(graph)).distinct()
        step = self.pairs(p[1], graph)
        out = self.reach(step, step)
        return out if kind == "plus" else out.unionByName(self.same(graph)).distinct()

    def same(self, graph: tuple | None) -> DataFrame:
        """Every node of the graph with itself, for paths of no step."""
        df = self.scan(graph)
        o = F.when(F.col("o_kind") == "literal", _term("literal", F.col("o"), F.coalesce("o_lang", F.lit("")), F.col("o_dt"))).otherwise(_term(F.col("o_kind"), F.col("o")))
        n = df.select("g", F.explode(F.array(_term(F.col("s_kind"), F.col("s")), o)).alias("a")).distinct()
        return n.select("g", "a", F.col("a").alias("b"))

    def reach(self, start: DataFrame, step: DataFrame) -> DataFrame:
        """All pairs from ``start`` on over further steps; a frontier loop, each level written once."""
        step = self.stage.write(step.select(F.col("g").alias("h"), F.col("a").alias("m"), F.col("b").alias("c")), "step")
        front = self.stage.write(start.select("g", "a", "b").distinct(), "front")
        seen = [front]
        parts = [front]
        while True:
            new = front.join(step, front.b.eqNullSafe(step.m) & front.g.eqNullSafe(step.h)).select("g", "a", F.col("c").alias("b")).distinct()
            old = reduce(DataFrame.unionByName, seen).select(F.col("g").alias("x"), F.col("a").alias("y"), F.col("b").alias("z"))
            new = new.join(old, new.g.eqNullSafe(old.x) & (new.a == old.y) & (new.b == old.z), "left_anti")
            front, n = self.stage.write(new, "front", n=F.count(F.lit(1)))
            if not n["n"]:
                return reduce(DataFrame.unionByName, parts)
            parts.append(front)
            seen.append(front)
            if len(seen) > 8:
                seen = [self.stage.write(reduce(DataFrame.unionByName, seen), "seen")]

    def path_pattern(self, s: tuple, p: tuple, o: tuple, graph: tuple | None) -> Solutions:
        const = lambda t: t[0] in ("iri", "lit")
        if p[0] in ("plus", "star") and (const(s) or const(o)):
            if not const(s):  # walk from the bound end
                return self.path_pattern(o, (p[0], ("inv", p[1])), s, graph)
            step = self.pairs(p[1], graph)
            df = self.reach(step.filter(F.col("a") == constant(s)), step)
            if p[0] == "star":
                here = self.spark.range(1).select(F.lit(None).cast("string").alias("g"), constant(s).alias("a"), constant(s).alias("b"))
                if graph is not None:
                    here = self.scan(graph).select("g").distinct().select("g", constant(s).alias("a"), constant(s).alias("b"))
                df = df.unionByName(here).distinct()
        else:
            df = self.pairs(p, graph)
        parts = []
        for t, c in ((s, "a"), (o, "b")):
            if const(t):
                df = df.filter(F.col(c) == constant(t))
            else:
                parts.append((t[1], F.col(c)))
        if graph is not None and graph[0] == "var":
            parts.append((graph[1], _term("iri", F.col("g"))))
        return self._bind(df, parts)

    # patterns
    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), [])

    def pattern(self, p: tuple, graph: tuple | None = None) -> Solutions:
        kind = p[0]
        if kind == "unit":
            return self.unit()
        if kind == "bgp":
            rest = list(p[1])
            out = None
            while rest:
                bound = set(out.vars) if out else set()
                at = next((i for i, t in enumerate(rest) if bound & {x[1] for x in t if x[0] in ("var", "bnode")}), 0)
                t = rest.pop(at)
                one = self.triple(t, graph)
                out = one if out is None else join(out, one)
            return out or self.unit()
        if kind == "join":
            return join(self.pattern(p[1], graph), self.pattern(p[2], graph))
        if kind == "leftjoin":
            return join(self.pattern(p[1], graph), self.pattern(p[2], graph), "left", p[3])
        if kind == "union":
            a, b = self.pattern(p[1], graph), self.pattern(p[2], graph)
            names = list(dict.fromkeys([*a.vars, *b.vars]))
            wide = lambda x: x.df.select(*[(F.col(f"v_{v}") if v in x.vars else F.lit(None).cast(TERM)).alias(f"v_{v}") for v in names])
            return Solutions(wide(a).unionAll(wide(b)), names, a.maybe | b.maybe | (set(a.vars) ^ set(b.vars)))
        if kind == "minus":
            a, b = self.pattern(p[1], graph), self.any_of(p[2], graph)
            shared = [v for v in a.vars if v in b.vars]
            if not shared:
                return a
            right = _renamed(b)
            both = reduce(lambda x, y: x | y, [a.df[f"v_{v}"].isNotNull() & right[f"r_{v}"].isNotNull() for v in shared])
            on = _match(a, b, shared, a.df, right)
            return Solutions(a.df.join(right, on & both if any(v in a.maybe or v in b.maybe for v in shared) else on, "left_anti"), a.vars, a.maybe)
        if kind == "filter":
            return self.filtered(p[1], self.pattern(p[2], graph), graph)
        if kind == "extend":
            a = self.pattern(p[1], graph)
            return Solutions(a.df.withColumn(f"v_{p[2]}", term(evaluate(p[3], a.env))), [*a.vars, p[2]], a.maybe | {p[2]})
        if kind == "values":
            rows = [tuple(None if t is None else ("iri", t[1], "", "") if t[0] == "iri" else ("literal", t[1], t[2] or "", t[3]) for t in r) for r in p[2]]
            df = self.spark.createDataFrame(rows, ", ".join(f"`v_{v}` {TERM}" for v in p[1]))
            return Solutions(df, list(p[1]), {v for i, v in enumerate(p[1]) if any(r[i] is None for r in rows)})
        if kind == "graph":
            return self.pattern(p[2], p[1])
        if kind == "subselect":
            was, self._once = self._once, True
            try:
                return self.select(p[1], graph)
            finally:
                self._once = was
        raise QueryRefused("QuerySyntax", f"unexpected {kind}")

    def filtered(self, e: tuple, a: Solutions, graph: tuple | None) -> Solutions:
        if e[0] == "and":
            return self.filtered(e[2], self.filtered(e[1], a, graph), graph)
        negated = e[0] == "not" and e[1][0] == "exists"
        if e[0] == "exists" or negated:
            inner, outer = (e[1][1] if negated else e[1]), []
            while inner[0] == "filter" and mentioned(inner[1]) - variables(inner[2]):
                outer.append(inner[1])  # a filter on variables from outside is part of the condition
                inner = inner[2]
            return join(a, self.any_of(inner, graph), "left_anti" if negated else "left_semi", outer)
        flags: list[tuple[str, Solutions]] = []

        def lifted(x: object) -> object:
            """EXISTS inside other operators becomes a flag column."""
            if isinstance(x, tuple) and x and x[0] == "exists":
                b = self.any_of(x[1], graph)
                shared = [v for v in a.vars if v in b.vars]
                name = f"f_{len(flags)}"
                flags.append((name, Solutions(b.df.select(*[f"v_{v}" for v in shared]).distinct() if shared else b.df.limit(1).select(), shared, b.maybe)))
                return ("flag", name)
            if isinstance(x, (tuple, list)):
                return type(x)(lifted(y) for y in x)
            return x

        e = lifted(e)  # type: ignore[assignment]
        df = a.df
        for name, b in flags:
            right = _renamed(b).withColumn(name, F.lit(True))
            df = df.join(right, _match(a, b, b.vars, df, right), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(*[f"r_{v}" for v in b.vars])
        df = df.filter(F.coalesce(truth(evaluate(e, a.env)), F.lit(False)))
        return Solutions(df.select(*[f"v_{v}" for v in a.vars]), a.vars, a.maybe)

    # queries
    def select(self, q: Query, graph: tuple | None = None) -> Solutions:
        a = self.pattern(q.pattern, graph)
        env = dict(a.env)
        df = a.df
        if q.aggregated:
            keys = []
            for i, (name, e) in enumerate(q.group):
                keys.append(term(evaluate(e, env)).alias(f"v_{name}" if name else f"k_{i}"))
            aggs: dict[str, Column] = {}
            for e in [x for _, x in q.projection if x] + q.having + [x for x, _ in q.order]:
                for agg in _aggregates(e):
                    aggs[_agg_name(agg)] = self.aggregate(agg, env)
            cols = [c.alias(f"v_{n}") for n, c in aggs.items()]
            df = (df.groupBy(*keys) if keys else df.groupBy()).agg(*(cols or [F.count(F.lit(1)).alias("n")]))
            env = {n: F.col(f"v_{n}") for n, _ in q.group if n} | {n: F.col(f"`v_{n}`") for n in aggs}
            for e in q.having:
                df = df.filter(F.coalesce(truth(evaluate(e, env)), F.lit(False)))
        for name, e in q.projection:
            if e is not None:
                df = df.withColumn(f"v_{name}", term(evaluate(e, env)))
                env[name] = F.col(f"v_{name}")
        names = [n for n, _ in q.projection] or [v for v in a.vars if v in variables(q.pattern)]
        keep = [(env[n] if n in env else F.lit(None).cast(TERM)).alias(f"v_{n}") for n in names]
        order = [k for e, down in q.order for k in _order(evaluate(e, env), down)]
        if q.distinct:
            df = df.select(*keep).distinct()
            env = {n: F.col(f"v_{n}") for n in names}
            order = [k for e, down in q.order for k in _order(evaluate(e, env), down)]
            keep = [F.col(f"v_{n}") for n in names]
        if order:
            df = df.orderBy(*order)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        certain = set() if q.aggregated else {n for n in names if n in a.vars and n not in a.maybe}
        return Solutions(df.select(*keep), names, set(names) - certain)

    def aggregate(self, e: tuple, env: dict[str, Column]) -> Column:
        _, name, distinct, arg, sep = e
        whole = lambda c: term(Val("num", (c.cast("double"), F.lit(0), c.cast("long"))))
        if arg is None:
            return whole(F.count_distinct(F.struct(*env.values())) if distinct else F.count(F.lit(1)))
        x = evaluate(arg, env)
        t = term(x)
        if name == "count":
            return whole(F.count_distinct(t) if distinct else F.count(t))
        if name in ("sum", "avg"):
            value, rank, exact = number(x)
            bad = F.max(t.isNotNull() & value.isNull()) == True  # noqa: E712  an operand that is no number is an error
            key = F.struct(value.alias("v"), rank.alias("r"), exact.alias("i"))
            if distinct:
                got = F.collect_set(F.when(value.isNotNull(), key))
                total, top, n = F.aggregate(got, F.lit(0.0), lambda s, k: s + k["v"]), F.coalesce(F.array_max(F.transform(got, lambda k: k["r"])), F.lit(0)), F.size(got)
                ints = F.aggregate(got, F.lit(0).cast("long"), lambda s, k: s + k["i"])
            else:
                total, top, n, ints = F.coalesce(F.sum(value), F.lit(0.0)), F.coalesce(F.max(rank), F.lit(0)), F.count(value), F.coalesce(F.sum(exact), F.lit(0))
            if name == "sum":
                return F.when(~F.coalesce(bad, F.lit(False)), term(Val("num", (F.when(top == 0, ints.cast("double")).otherwise(total), top, ints))))
            mean = F.when(n == 0, 0.0).otherwise(F.try_divide(total, n))
            return F.when(~F.coalesce(bad, F.lit(False)), term(Val("num", (mean, F.when(n == 0, 0).otherwise(F.greatest(top, F.lit(1))), F.lit(0).cast("long")))))
        if name in ("min", "max"):
            key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_keys(x))], t.alias("t"))
            pick = (F.min if name == "min" else F.max)(F.when(t.isNotNull(), key))
            return pick["t"]
        if name == "sample":
            return F.min(t)
        texts = F.when(t["k"] == "iri", expanded_column(t["v"])).otherwise(t["v"])
        got = F.array_sort((F.collect_set if distinct else F.collect_list)(texts))
        return _term("literal", F.array_join(got, sep), "", "xsd:string")


def _aggregates(e: object) -> list[tuple]:
    if isinstance(e, tuple) and e and e[0] == "agg":
        return [e]
    if isinstance(e, (tuple, list)):
        return [x for y in e for x in _aggregates(y)]
    return []


def _keys(x: Val) -> list[Column]:
    """The order of terms: unbound, blank nodes, IRIs, literals; numbers by value, then by text."""
    t = term(x)
    rank = F.when(t.isNull(), 0).when(t["k"] == "bnode", 1).when(t["k"] == "iri", 2).otherwise(3)
    n = number(x)[0]
    return [rank, n, F.when(t["k"] == "iri", expanded_column(t["v"])).otherwise(t["v"]), t["l"], t["d"]]


def _order(x: Val, down: bool) -> list[Column]:
    return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in _keys(x)]


# -- entry -------------------------------------------------------------------------------------------


def run(statements: DataFrame, text_: str, base: str = "") -> tuple[str, DataFrame]:
    """(form, frame).  SELECT: terms by variable; ASK: one row (answer); CONSTRUCT and DESCRIBE: statements, each once.

    ``statements`` are those of the vocabularies; FROM and FROM NAMED narrow them."""
    q = parse(text_, base)
    given = bool(q.from_ or q.named)
    d = Dataset(statements, q.from_ if given else None, q.named if given else None)
    if q.form == "select":
        out = d.select(q)
        return "select", out.df.select(*[F.col(f"v_{v}").alias(v) for v in out.vars])
    if q.form == "ask":
        found = not d.pattern(q.pattern).df.isEmpty()
        return "ask", d.spark.createDataFrame([(found,)], "answer boolean")
    cols = ("s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt")
    if q.form == "describe":
        iris = [t[1] for t in q.describe if t[0] == "iri"]
        names = [t[1] for t in q.describe if t[0] == "var"]
        wanted = d.spark.createDataFrame([(i,) for i in iris], "s string")
        if names:
            a = d.pattern(q.pattern)
            for v in names:
                wanted = wanted.unionByName(a.df.filter(F.col(f"v_{v}.k") != "literal").select(F.col(f"v_{v}.v").alias("s")))
        return "describe", d.default.join(wanted.distinct(), "s", "left_semi").select(*cols).distinct()
    inner = Query("select", q.pattern, order=q.order, limit=q.limit, offset=q.offset)
    a = d.select(inner)
    row = F.xxhash64(*[F.col(f"v_{v}") for v in a.vars]) if a.vars else F.lit(0)
    parts = []
    for s, p, o in q.template:
        p = ("iri", p[1]) if p[0] == "link" else p
        get = lambda t: F.col(f"v_{t[1]}") if t[0] == "var" and t[1] in a.vars else F.lit(None).cast(TERM) if t[0] == "var" else _term("bnode", F.concat(F.lit(f"_:{t[1].strip('#')}x"), F.hex(row))) if t[0] == "bnode" else constant(t)
        x = a.df.select(get(s).alias("s"), get(p).alias("p"), get(o).alias("o")).filter("s is not null and p is not null and o is not null and s.k <> 'literal' and p.k = 'iri'")
        parts.append(x.select(F.col("s.v").alias("s"), F.col("s.k").alias("s_kind"), F.col("p.v").alias("p"), F.col("o.v").alias("o"), F.col("o.k").alias("o_kind"), F.nullif(F.col("o.l"), F.lit("")).alias("o_lang"), F.col("o.d").alias("o_dt")))
    return "construct", reduce(DataFrame.unionByName, parts).distinct()


def plain(answers: DataFrame) -> DataFrame:
    """Values of terms by variable; unbound is null."""
    return answers.select(*[F.col(c)["v"].alias(c) for c in answers.columns])


def answers(df: DataFrame, cap: int = 100_000, seconds: float = 30.0) -> list:
    """At most ``cap`` rows within ``seconds``; more or longer is refused, never shortened."""
    sc = df.sparkSession.sparkContext
    group = f"sparql-{id(df)}"
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.2):  # again and again, as a job may start after the deadline
                sc.cancelJobGroup(group)

    sc.setJobGroup(group, "query", interruptOnCancel=True)
    threading.Thread(target=watch, daemon=True).start()
    try:
        rows = df.limit(cap + 1).collect()
    except Exception as e:
        if late.is_set():
            raise QueryRefused("QueryTimedOut", f"{seconds} s") from e
        raise
    finally:
        done.set()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if len(rows) > cap:
        raise QueryRefused("QueryTooLarge", f"more than {cap} answers")
    return rows


def serialise(form: str, df: DataFrame, media: str = "json", **bounds) -> str:
    """Answers as json, xml, csv or tsv.  CSV keeps only the values."""
    import json
    from xml.sax.saxutils import escape, quoteattr

    rows = answers(df, **bounds)
    if form == "ask":
        if media == "json":
            return json.dumps({"head": {}, "boolean": rows[0][0]})
        if media == "xml":
            return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{str(rows[0][0]).lower()}</boolean></sparql>'
        raise QueryRefused("AnswerWrite", media)
    names = df.columns
    value = lambda t: expanded(t["v"]) if t["k"] == "iri" else t["v"]
    if media == "json":
        one = lambda t: {"type": {"iri": "uri"}.get(t["k"], t["k"]), "value": value(t)} | ({"xml:lang": t["l"]} if t["l"] else {"datatype": expanded(t["d"])} if t["d"] not in ("", "xsd:string") else {})
        return json.dumps({"head": {"vars": names}, "results": {"bindings": [{n: one(r[n]) for n in names if r[n] is not None} for r in rows]}}, ensure_ascii=False)
    if media == "xml":
        out = ['<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>', *[f"<variable name={quoteattr(n)}/>" for n in names], "</head><results>"]
        for r in rows:
            out.append("<result>")
            for n in names:
                if r[n] is not None:
                    t = r[n]
                    attr = f" xml:lang={quoteattr(t['l'])}" if t["l"] else f" datatype={quoteattr(expanded(t['d']))}" if t["d"] not in ("", "xsd:string") else ""
                    tag = {"iri": "uri", "bnode": "bnode"}.get(t["k"], "literal")
                    out.append(f"<binding name={quoteattr(n)}><{tag}{attr if tag == 'literal' else ''}>{escape(value(t))}</{tag}></binding>")
            out.append("</result>")
        return "".join([*out, "</results></sparql>"])
    if media == "csv":
        quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v
        return "".join(",".join(line) + "\r\n" for line in [names, *[["" if r[n] is None else quote(value(r[n])) for n in names] for r in rows]])
    if media == "tsv":
        esc = lambda v: v.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace('"', '\\"')

        def full(t) -> str:
            if t is None:
                return ""
            if t["k"] == "iri":
                return f"<{value(t)}>"
            if t["k"] == "bnode":
                return t["v"]
            return f'"{esc(t["v"])}"' + (f"@{t['l']}" if t["l"] else f"^^<{expanded(t['d'])}>" if t["d"] not in ("", "xsd:string") else "")

        return "".join("\t".join(line) + "\n" for line in [["?" + n for n in names], *[[full(r[n]) for n in names] for r in rows]])
    raise QueryRefused("AnswerWrite", media)
