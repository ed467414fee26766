"""RDF files to statements and back.

N-Triples and N-Quads are read line by line with JVM expressions and split like any text, so one large file uses the
whole cluster.  Turtle, TriG, RDF/XML and JSON-LD need a parser with state; each file is one task's work, and its statements are
given on in batches while it is read (JSON-LD after it is read).  Files
are written one statement per line wherever the syntax allows, so every partition writes its own file.

Well-known namespaces are written with prefixes inside the store (see ``vocabulary.PREFIXES``).  Triple syntaxes drop the
graph by design.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..vocabulary import PREFIXES

SCHEMA = "g string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dt string"
RDF, XSD = PREFIXES["rdf"], PREFIXES["xsd"]


@dataclass(frozen=True)
class Syntax:
    token: str
    extension: str
    media: str
    quads: bool


# The six syntaxes.
SYNTAXES = (
    Syntax("turtle", "ttl", "text/turtle", False), Syntax("ntriples", "nt", "application/n-triples", False), Syntax("nquads", "nq", "application/n-quads", True),
    Syntax("trig", "trig", "application/trig", True), Syntax("rdfxml", "rdf", "application/rdf+xml", False), Syntax("jsonld", "jsonld", "application/ld+json", True),
)


class SyntaxRefused(ValueError):
    """The text is not in the named syntax."""


def syntax_of(name: str) -> Syntax:
    """By token, file extension or media type."""
    for x in SYNTAXES:
        if name in (x.token, x.extension, x.media) or name.endswith("." + x.extension):
            return x
    raise SyntaxRefused(f"unknown syntax {name}")


def negotiate(accept: str, offered: tuple[str, ...] = tuple(x.media for x in SYNTAXES)) -> str | None:
    """The best offered media type for an Accept header; null if none is acceptable.  Ties go to the more specific range, then to the order offered."""
    best = None
    for i, media in enumerate(offered):
        rank = None
        for part in accept.split(","):
            range_, *params = [x.strip() for x in part.split(";")]
            q = next((float(x[2:]) for x in params if x.startswith("q=") and re.fullmatch(r"[01](\.\d*)?", x[2:])), 1.0)
            specific = 2 if range_ == media else 1 if range_ == media.split("/")[0] + "/*" else 0 if range_ == "*/*" else -1
            if specific >= 0 and (rank is None or specific > rank[1]):
                rank = (q, specific)
        if rank and rank[0] > 0 and (best is None or (rank[0], rank[1], -i) > best[0]):
            best = ((rank[0], rank[1], -i), media)
    return best[1] if best else None


# -- names -------------------------------------------------------------------------------------------


def shortened(iri: str) -> str:
    for p, ns in PREFIXES.items():
        if iri.startswith(ns):
            return f"{p}:{iri[len(ns):]}"
    return iri


def expanded(name: str) -> str:
    p, colon, rest = name.partition(":")
    return PREFIXES[p] + rest if colon and p in PREFIXES else name


def shortened_column(iri: Column) -> Column:
    out = iri
    for p, ns in PREFIXES.items():
        out = F.when(iri.startswith(ns), F.concat(F.lit(p + ":"), F.substring(iri, len(ns) + 1, 1 << 30))).otherwise(out)
    return out


def expanded_column(name: Column) -> Column:
    out = name
    for p, ns in PREFIXES.items():
        out = F.when(name.startswith(p + ":"), F.concat(F.lit(ns), F.substring(name, len(p) + 2, 1 << 30))).otherwise(out)
    return out


# -- N-Triples and N-Quads: JVM expressions ----------------------------------------------------------

_LINE = (
    r'^\s*(?:<([^<>"{}|^`\\\x00-\x20]*)>|(_:[^\s<>"]+))\s*<([^<>"{}|^`\\\x00-\x20]*)>\s*'
    r'(?:<([^<>"{}|^`\\\x00-\x20]*)>|(_:[^\s<>"]+)|"((?:[^"\\\n\r]|\\.)*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>"{}|^`\\\x00-\x20]*)>)?)'
    r"\s*(?:<([^<>\"{}|^`\\\x00-\x20]*)>|(_:[^\s<>\"]+))?\s*\.\s*(?:#.*)?\z"
)


def unescaped(text: Column) -> Column:
    r"""\t, \n, \", \uXXXX and the like, resolved from left to right."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def one(x: Column) -> Column:
        code = F.substring(x, 3, 8)
        wide = F.conv(F.substring(x, 3, 8), 16, 10).cast("long") - 0x10000
        pair = F.concat(F.lpad(F.hex((F.floor(wide / 1024) + 0xD800).cast("long")), 4, "0"), F.lpad(F.hex((wide % 1024 + 0xDC00).cast("long")), 4, "0"))
        simple = F.translate(F.substring(x, 2, 1), 'tnrbf"\'\\', "\t\n\r\b\f\"'\\")
        return (
            F.when(~x.startswith("\\"), x)
            .when(x.startswith("\\u"), F.decode(F.unhex(code), "UTF-16BE"))
            .when(x.startswith("\\U"), F.when(wide < 0, F.decode(F.unhex(F.substring(x, 7, 4)), "UTF-16BE")).otherwise(F.decode(F.unhex(pair), "UTF-16BE")))
            .otherwise(simple)
        )

    return F.when(text.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def read_lines(lines: DataFrame, graph: str | None = None, value: str = "value") -> DataFrame:
    """Statements of N-Triples or N-Quads lines; lines without a graph get ``graph``.  A malformed line fails the read."""
    t = lines.filter(~F.col(value).rlike(r"^\s*(#.*)?\z")).select(F.col(value).alias("t"))
    # one match per line; a matched line holds no line feed, so its groups can be joined by them
    groups = F.split(F.regexp_replace("t", _LINE, "\n".join(f"${i}" for i in range(1, 11))), "\n", -1)
    t = t.select("t", groups.alias("m"))
    t = t.select("t", F.when(F.size("m") == 10, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.substring("t", 1, 200)))).alias("m"))
    part = lambda i: F.col("m")[i - 1]
    some = lambda c: F.nullif(c, F.lit(""))
    s_iri, o_iri = part(1), part(4)
    node = F.col("t").rlike(r'^\s*(?:<[^>]*>|_:\S+)\s*<[^>]*>\s*(?:<|_:)')
    g = F.coalesce(some(part(9)), some(part(10)), F.lit(graph))
    datatype = F.when(node, "").when(part(7) != "", "rdf:langString").when(part(8) != "", shortened_column(unescaped(part(8)))).otherwise("xsd:string")
    return t.select(
        g.alias("g"),
        F.when(part(2) != "", part(2)).otherwise(shortened_column(unescaped(s_iri))).alias("s"),
        F.when(part(2) != "", "bnode").otherwise("iri").alias("s_kind"),
        shortened_column(unescaped(part(3))).alias("p"),
        F.when(~node, unescaped(part(6))).when(part(5) != "", part(5)).otherwise(shortened_column(unescaped(o_iri))).alias("o"),
        F.when(~node, "literal").when(part(5) != "", "bnode").otherwise("iri").alias("o_kind"),
        some(part(7)).alias("o_lang"),
        datatype.alias("o_dt"),
    )


def escaped(text: Column) -> Column:
    for c, e in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def _node(value: Column, kind: Column) -> Column:
    name = F.when(value.startswith("_:"), value).otherwise(F.concat(F.lit("_:"), value))
    return F.when(kind == "bnode", name).otherwise(F.concat(F.lit("<"), expanded_column(value), F.lit(">")))


def line(graphs: bool) -> Column:
    """One statement as N-Triples, or as N-Quads with its graph."""
    text = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))
    literal = (
        F.when(F.coalesce("o_lang", F.lit("")) != "", F.concat(text, F.lit("@"), F.col("o_lang")))
        .when(F.col("o_dt").isin("", "xsd:string", "rdf:langString"), text)
        .otherwise(F.concat(text, F.lit("^^<"), expanded_column(F.col("o_dt")), F.lit(">")))
    )
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(_node(F.col("o"), F.col("o_kind")))
    parts = [_node(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), expanded_column(F.col("p")), F.lit(">")), o]
    if graphs:
        parts.append(F.concat(F.lit("<"), F.col("g"), F.lit(">")))
    return F.concat_ws(" ", *parts, F.lit("."))


# -- Turtle and TriG ---------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""(?P<ws>(?:\s|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
    |(?P<long>"{3}(?:(?:"|"")?(?:[^"\\]|\\.))*"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})|(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<dir>@prefix|@base)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)
    |(?P<num>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<punct>[.;,\[\](){}])
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)|(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)""",
    re.X | re.S,
)
_ESC = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESC.get(m[1], m[1]), text, flags=re.S)


def resolve(base: str, ref: str) -> str:
    from urllib.parse import urljoin

    return ref if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", ref) or not base else (base.split("#")[0] if ref == "" else urljoin(base, ref))


class _Turtle:
    """Recursive descent over tokens, which are read as they are needed; gives (g, s, s_kind, p, o, o_kind, lang, datatype)."""

    def __init__(self, text: str, base: str, scope: str, trig: bool):
        self.base, self.scope, self.trig = base, scope, trig
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple] = []
        self.graph: str | None = None
        self.n = 0
        self.text, self.at = text, 0
        self.ahead: deque[tuple[str, str]] = deque()

    def peek(self, further: int = 0) -> tuple[str, str]:
        while len(self.ahead) <= further:
            if self.at >= len(self.text):
                return "end", ""
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise SyntaxRefused(f"unexpected text at {self.at}: {self.text[self.at : self.at + 30]!r}")
            self.at = m.end()
            if m.lastgroup != "ws":
                self.ahead.append((m.lastgroup, m.group()))
        return self.ahead[further]

    def next(self) -> tuple[str, str]:
        t = self.peek()
        if self.ahead:
            self.ahead.popleft()
        return t

    def want(self, text: str) -> None:
        if self.next()[1] != text:
            raise SyntaxRefused(f"expected {text!r} before {self.peek()[1]!r}")

    def fresh(self) -> tuple[str, str]:
        self.n += 1
        return f"_:{self.scope}b{self.n}", "bnode"

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((self.graph, *s, p, *(o if len(o) == 4 else (*o, None, ""))))

    def done(self) -> Iterator[tuple]:
        """What was emitted since the last time."""
        yield from self.out
        self.out.clear()

    def parse(self) -> Iterator[tuple]:
        """The statements as the text is read; no more than those of one sentence are held."""
        while self.peek()[0] != "end":
            kind, text = self.peek()
            low = text.lower()
            if kind == "dir" or (kind == "word" and low in ("prefix", "base")):
                self.next()
                if low.endswith("prefix"):
                    name = self.next()[1]
                    if not name.endswith(":"):
                        raise SyntaxRefused(f"expected a prefix, not {name!r}")
                    self.prefixes[name[:-1]] = self.iri_text(self.next())
                else:
                    self.base = self.iri_text(self.next())
                if kind == "dir":
                    self.want(".")
            elif self.trig and (text == "{" or low == "graph" or self.peek(1) == ("punct", "{")):
                if low == "graph":
                    self.next()
                self.graph = None if self.peek()[1] == "{" else self.node()[0]
                self.want("{")
                while self.peek()[1] != "}":
                    self.triples()
                    yield from self.done()
                    if self.peek()[1] == ".":
                        self.next()
                    elif self.peek()[1] != "}":
                        raise SyntaxRefused(f"unexpected {self.peek()[1]!r}")
                self.want("}")
                self.graph = None
            else:
                self.triples()
                self.want(".")
                yield from self.done()

    def iri_text(self, token: tuple[str, str]) -> str:
        if token[0] != "iri":
            raise SyntaxRefused(f"expected an IRI, not {token[1]!r}")
        return resolve(self.base, _plain(token[1][1:-1]))

    def node(self) -> tuple[str, str]:
        kind, text = self.next()
        if kind == "iri":
            return shortened(resolve(self.base, _plain(text[1:-1]))), "iri"
        if kind == "name":
            p, _, rest = text.partition(":")
            if p not in self.prefixes:
                raise SyntaxRefused(f"unknown prefix {p!r}")
            return shortened(self.prefixes[p] + re.sub(r"\\(.)", r"\1", rest)), "iri"
        if kind == "bnode":
            return f"_:{self.scope}{text[2:]}", "bnode"
        if text == "[":
            me = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(me)
            self.want("]")
            return me
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.object())
            self.next()
            if not items:
                return "rdf:nil", "iri"
            cells = [self.fresh() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items)):
                self.emit(cell, "rdf:first", item)
                self.emit(cell, "rdf:rest", cells[i + 1] if i + 1 < len(cells) else ("rdf:nil", "iri"))
            return cells[0]
        raise SyntaxRefused(f"unexpected {text!r}")

    def object(self) -> tuple:
        kind, text = self.peek()
        if kind in ("str", "long"):
            self.next()
            value = _plain(text[3:-3] if kind == "long" else text[1:-1])
            kind, text = self.peek()
            if kind == "lang":
                self.next()
                return value, "literal", text[1:], "rdf:langString"
            if kind == "dt":
                self.next()
                return value, "literal", None, self.node()[0]
            return value, "literal", None, "xsd:string"
        if kind == "num":
            self.next()
            return text, "literal", None, "xsd:double" if "e" in text.lower() else "xsd:decimal" if "." in text else "xsd:integer"
        if kind == "word" and text in ("true", "false"):
            self.next()
            return text, "literal", None, "xsd:boolean"
        return self.node()

    def triples(self) -> None:
        bare = self.peek()[1] == "["
        s = self.node()
        if bare and self.peek()[1] in (".", "}"):
            return
        self.predicates(s)

    def predicates(self, s: tuple) -> None:
        while True:
            if self.peek() == ("word", "a"):
                self.next()
                p = "rdf:type"
            else:
                p, kind = self.node()
                if kind != "iri":
                    raise SyntaxRefused("a predicate has to be an IRI")
            while True:
                self.emit(s, p, self.object())
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]", "}"):
                return


# -- RDF/XML -----------------------------------------------------------------------------------------

_XML = "{http://www.w3.org/XML/1998/namespace}"


def _parse_xml(text: str, base: str, scope: str) -> Iterator[tuple]:
    """One description after the other; each is dropped when its statements are given."""
    out: list[tuple] = []
    made = [0]

    def fresh() -> tuple[str, str]:
        made[0] += 1
        return f"_:{scope}b{made[0]}", "bnode"

    def name(tag: str) -> str:
        return shortened(tag[1:].replace("}", "", 1))

    def subject(e: ET.Element, base: str) -> tuple[str, str]:
        if f"{{{RDF}}}about" in e.attrib:
            return shortened(resolve(base, e.attrib[f"{{{RDF}}}about"])), "iri"
        if f"{{{RDF}}}ID" in e.attrib:
            return shortened(resolve(base, "#" + e.attrib[f"{{{RDF}}}ID"])), "iri"
        if f"{{{RDF}}}nodeID" in e.attrib:
            return f"_:{scope}{e.attrib[f'{{{RDF}}}nodeID']}", "bnode"
        return fresh()

    def own(e: ET.Element) -> dict[str, str]:
        return {k: v for k, v in e.attrib.items() if k.startswith("{") and not k.startswith((f"{{{RDF}}}", _XML))}

    def literal(v: str, lang: str | None) -> tuple:
        return (v, "literal", lang, "rdf:langString") if lang else (v, "literal", None, "xsd:string")

    def visit(e: ET.Element, base: str, lang: str | None) -> tuple[str, str]:
        base, lang = e.attrib.get(_XML + "base", base), e.attrib.get(_XML + "lang", lang) or None
        s = subject(e, base)
        if e.tag != f"{{{RDF}}}Description":
            out.append((None, *s, "rdf:type", name(e.tag), "iri", None, ""))
        if f"{{{RDF}}}type" in e.attrib:
            out.append((None, *s, "rdf:type", shortened(resolve(base, e.attrib[f"{{{RDF}}}type"])), "iri", None, ""))
        for k, v in own(e).items():
            out.append((None, *s, name(k), *literal(v, lang)))
        n = 0
        for c in e:
            p = name(c.tag)
            if p == "rdf:li":
                n += 1
                p = f"rdf:_{n}"
            here, tag = c.attrib.get(_XML + "base", base), c.attrib.get(_XML + "lang", lang) or None
            kind = c.attrib.get(f"{{{RDF}}}parseType")
            if f"{{{RDF}}}resource" in c.attrib:
                o: tuple = (shortened(resolve(here, c.attrib[f"{{{RDF}}}resource"])), "iri", None, "")
            elif f"{{{RDF}}}nodeID" in c.attrib:
                o = (f"_:{scope}{c.attrib[f'{{{RDF}}}nodeID']}", "bnode", None, "")
            elif kind == "Collection":
                cells = [(visit(x, here, tag), fresh()) for x in c]
                for i, (item, cell) in enumerate(cells):
                    out.append((None, *cell, "rdf:first", *item, None, ""))
                    out.append((None, *cell, "rdf:rest", *(cells[i + 1][1] if i + 1 < len(cells) else ("rdf:nil", "iri")), None, ""))
                o = (*(cells[0][1] if cells else ("rdf:nil", "iri")), None, "")
            elif kind == "Literal":
                inner = (c.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in c)
                o = (inner, "literal", None, "rdf:XMLLiteral")
            elif kind == "Resource":
                inner_e = ET.Element(f"{{{RDF}}}Description")
                inner_e.extend(list(c))
                o = (*visit(inner_e, here, tag), None, "")
            elif len(c):
                o = (*visit(c[0], here, tag), None, "")
            elif own(c):
                node = fresh()
                out.extend((None, *node, name(k), *literal(v, tag)) for k, v in own(c).items())
                o = (*node, None, "")
            elif f"{{{RDF}}}datatype" in c.attrib:
                o = (c.text or "", "literal", None, shortened(resolve(here, c.attrib[f"{{{RDF}}}datatype"])))
            else:
                o = literal(c.text or "", tag)
            out.append((None, *s, p, *o))
        return s

    root, depth = None, 0
    text = re.sub(r"""^(\s*<\?xml[^>]*?)\s+encoding=("[^"]*"|'[^']*')""", r"\1", text, count=1)  # decoded already
    try:
        for event, e in ET.iterparse(io.BytesIO(text.encode()), events=("start", "end")):
            if event == "start":
                depth += 1
                root = e if root is None else root
                continue
            depth -= 1
            several = root.tag == f"{{{RDF}}}RDF"
            if depth == (1 if several else 0):
                visit(e, root.attrib.get(_XML + "base", base), root.attrib.get(_XML + "lang"))
                yield from out
                out.clear()
                if several:
                    root.remove(e)
    except ET.ParseError as x:
        raise SyntaxRefused(str(x)) from x


# -- JSON-LD -----------------------------------------------------------------------------------------


def _parse_json(text: str, base: str, scope: str) -> list[tuple]:
    """Expanded and simply compacted documents; contexts by reference are refused."""
    out: list[tuple] = []
    made = [0]

    def fresh() -> tuple[str, str]:
        made[0] += 1
        return f"_:{scope}b{made[0]}", "bnode"

    def context(ctx: object, outer: dict) -> dict:
        got = dict(outer)
        for c in ctx if isinstance(ctx, list) else [ctx]:
            if isinstance(c, str):
                raise SyntaxRefused("a context by reference cannot be read")
            for k, v in (c or {}).items():
                got[k] = v
        return got

    def iri(v: str, ctx: dict, vocab: bool) -> str:
        if vocab and v in ctx and not v.startswith("@"):
            t = ctx[v]
            return iri(t if isinstance(t, str) else t.get("@id", v), {k: x for k, x in ctx.items() if k != v}, True)
        p, colon, rest = v.partition(":")
        if colon and p in ctx and not rest.startswith("//"):
            t = ctx[p]
            return (t if isinstance(t, str) else t["@id"]) + rest
        if vocab and not colon and "@vocab" in ctx:
            return ctx["@vocab"] + v
        return v if vocab else resolve(ctx.get("@base", base), v)

    def ref(v: str, ctx: dict) -> tuple[str, str]:
        return (f"_:{scope}{v[2:]}", "bnode") if v.startswith("_:") else (shortened(iri(v, ctx, False)), "iri")

    def value(v: object, term: object, ctx: dict, g: str | None) -> tuple:
        kind = term.get("@type") if isinstance(term, dict) else None
        lang = term.get("@language", ctx.get("@language")) if isinstance(term, dict) else ctx.get("@language")
        if isinstance(v, dict):
            if "@value" in v:
                x = v["@value"]
                text = x if isinstance(x, str) else json.dumps(x)
                if "@language" in v:
                    return text, "literal", v["@language"], "rdf:langString"
                auto = "xsd:boolean" if isinstance(x, bool) else "xsd:integer" if isinstance(x, int) else "xsd:double" if isinstance(x, float) else "xsd:string"
                return text, "literal", None, shortened(iri(v["@type"], ctx, True)) if "@type" in v else auto
            if "@list" in v:
                items = [value(x, term, ctx, g) for x in v["@list"]]
                cells = [fresh() for _ in items]
                for i, (item, cell) in enumerate(zip(items, cells)):
                    out.append((g, *cell, "rdf:first", *item))
                    out.append((g, *cell, "rdf:rest", *(cells[i + 1] if i + 1 < len(cells) else ("rdf:nil", "iri")), None, ""))
                return (*(cells[0] if cells else ("rdf:nil", "iri")), None, "")
            return (*visit(v, ctx, g), None, "")
        if isinstance(v, bool):
            return str(v).lower(), "literal", None, "xsd:boolean"
        if isinstance(v, (int, float)):
            return json.dumps(v), "literal", None, kind and shortened(iri(kind, ctx, True)) or ("xsd:integer" if isinstance(v, int) else "xsd:double")
        if kind == "@id":
            return (*ref(v, ctx), None, "")
        if kind:
            return v, "literal", None, shortened(iri(kind, ctx, True))
        return (v, "literal", lang, "rdf:langString") if lang else (v, "literal", None, "xsd:string")

    def visit(e: dict, ctx: dict, g: str | None) -> tuple[str, str]:
        if "@context" in e:
            ctx = context(e["@context"], ctx)
        id_ = e.get("@id") or next((e[k] for k, v in ctx.items() if v == "@id" and k in e), None)
        s = ref(id_, ctx) if id_ else fresh()
        for k, v in e.items():
            many = v if isinstance(v, list) else [v]
            role = ctx.get(k) if isinstance(ctx.get(k), str) and str(ctx.get(k)).startswith("@") else k
            if role == "@type":
                out.extend((g, *s, "rdf:type", shortened(iri(x, ctx, True)), "iri", None, "") for x in many)
            elif role == "@graph":
                inner = s[0] if id_ else g
                for x in many:
                    visit(x, ctx, inner)
            elif not role.startswith("@"):
                p = iri(k, ctx, True)
                if ":" not in p:
                    continue  # a key without meaning is ignored
                term = ctx.get(k)
                if isinstance(term, dict) and term.get("@container") == "@list" and isinstance(v, list):
                    many = [{"@list": v}]
                if isinstance(term, dict) and term.get("@container") == "@language" and isinstance(v, dict):
                    many = [{"@value": x, "@language": lang} for lang, xs in v.items() for x in (xs if isinstance(xs, list) else [xs])]
                for x in many:
                    if x is not None:
                        out.append((g, *s, shortened(p), *value(x, term, ctx, g)))
        return s

    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise SyntaxRefused(str(e)) from e
    for e in doc if isinstance(doc, list) else [doc]:
        visit(e, {}, None)
    return out


def parse_text(text: str, syntax: str, base: str = "", scope: str = "") -> list[tuple]:
    """Statements of one document, blank nodes named after ``scope``."""
    return list(iter_text(text, syntax, base, scope))


def iter_text(text: str, syntax: str, base: str = "", scope: str = "") -> Iterator[tuple]:
    """The same, one after the other.  JSON-LD is read whole."""
    match syntax_of(syntax).token:
        case "rdfxml":
            return _parse_xml(text, base, scope)
        case "jsonld":
            return iter(_parse_json(text, base, scope))
        case token:
            return _Turtle(text, base, scope, trig=token in ("trig", "nquads")).parse()


#: statements given on at once
_BATCH = 10_000


# -- files -------------------------------------------------------------------------------------------


def read(spark: SparkSession, path: str, syntax: str, graph: str | None = None, base: str | None = None) -> DataFrame:
    """Statements of the files at ``path``, as a set; those without a graph of their own get ``graph``."""
    kind = syntax_of(syntax)
    if kind.token in ("ntriples", "nquads"):
        return read_lines(spark.read.text(path), graph).distinct()
    ship(spark)
    token, at = kind.token, base or graph or ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        for batch in batches:
            for name, text in zip(batch["path"], batch["value"]):
                rows = iter_text(text, token, at, f"{crc32(name.encode()):08x}")
                while some := [(r[0] or graph, *r[1:]) for r in islice(rows, _BATCH)]:
                    yield pd.DataFrame(some, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, SCHEMA).distinct()


def _xml_document(rows: pd.DataFrame) -> str:
    from xml.sax.saxutils import escape, quoteattr

    out = [f"<?xml version='1.0' encoding='utf-8'?>\n<rdf:RDF xmlns:rdf={quoteattr(RDF)}>"]
    for r in rows.itertuples():
        p = expanded(r.p)
        cut = max(p.rfind("#"), p.rfind("/"), p.rfind(":")) + 1
        about = f"rdf:nodeID={quoteattr(r.s.removeprefix('_:'))}" if r.s_kind == "bnode" else f"rdf:about={quoteattr(expanded(r.s))}"
        tag = f"p:{p[cut:]} xmlns:p={quoteattr(p[:cut])}"
        if r.o_kind == "literal":
            attr = f" xml:lang={quoteattr(r.o_lang)}" if r.o_lang else "" if r.o_dt in ("", "xsd:string") else f" rdf:datatype={quoteattr(expanded(r.o_dt))}"
            body = f"<{tag}{attr}>{escape(r.o)}</p:{p[cut:]}>"
        else:
            body = f"<{tag} rdf:nodeID={quoteattr(r.o.removeprefix('_:'))}/>" if r.o_kind == "bnode" else f"<{tag} rdf:resource={quoteattr(expanded(r.o))}/>"
        out.append(f"<rdf:Description {about}>{body}</rdf:Description>")
    return "\n".join([*out, "</rdf:RDF>"])


def _json_document(rows: pd.DataFrame) -> str:
    node = lambda v, k: "_:" + v.removeprefix("_:") if k == "bnode" else expanded(v)
    docs = []
    for r in rows.itertuples():
        if r.o_kind == "literal":
            o = {"@value": r.o} | ({"@language": r.o_lang} if r.o_lang else {} if r.o_dt in ("", "xsd:string") else {"@type": expanded(r.o_dt)})
        else:
            o = {"@id": node(r.o, r.o_kind)}
        one = {"@id": node(r.s, r.s_kind), expanded(r.p): [o]}
        docs.append({"@id": r.g, "@graph": [one]} if r.g else one)
    return json.dumps(docs, ensure_ascii=False)


def write(statements: DataFrame, path: str, syntax: str) -> None:
    """Write to a new folder, a file or more per partition.  Line syntaxes, Turtle and TriG have a statement a line; every RDF/XML
    and JSON-LD file is a whole document."""
    kind = syntax_of(syntax)
    if kind.token in ("ntriples", "nquads", "turtle", "trig"):
        value = line(kind.token == "nquads")
        if kind.token == "trig":
            value = F.concat(F.lit("<"), F.col("g"), F.lit("> { "), value, F.lit(" }"))
        statements.select(value.alias("value")).write.mode("errorifexists").text(path)
        return
    ship(statements.sparkSession)
    build = _xml_document if kind.token == "rdfxml" else _json_document

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": [build(batch)]})

    docs = statements.select("g", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dt").mapInPandas(run, "value string")
    docs.write.mode("errorifexists").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
