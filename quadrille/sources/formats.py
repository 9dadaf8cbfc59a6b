"""Reading and writing of RDF files by format, and conversion from one format to another.

N-Triples and N-Quads are split among the executors. Turtle, TriG, N3 (without formulas), RDF/XML and JSON-LD are trees or
have a state, so one file is read whole; they are written in order of graph and subject, one subject at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import urljoin
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..plans.algebra import RDF, STRING, XSD
from . import ntriples, turtle

#: Media types and file endings of the formats.
FORMATS = {
    "ntriples": ("application/n-triples", "nt"), "nquads": ("application/n-quads", "nq"), "turtle": ("text/turtle", "ttl"), "trig": ("application/trig", "trig"),
    "n3": ("text/n3", "n3"), "rdfxml": ("application/rdf+xml", "rdf", "xml", "owl"), "jsonld": ("application/ld+json", "jsonld", "json"),
}
DATASETS = frozenset({"nquads", "trig", "jsonld"})
XML = "{http://www.w3.org/XML/1998/namespace}"


def format_of(name: str) -> str:
    """A format by its own name, media type, file ending or path."""
    low = name.split(";")[0].strip().lower()
    end = low.rsplit(".", 1)[-1]
    for form, known in FORMATS.items():
        if low == form or low in known or end in known[1:]:
            return form
    raise ValueError(f"unknown format {name!r}")


def literal(lex: str, dt: str | None = None, lang: str | None = None, way: str | None = None) -> tuple:
    if lang:
        return ("lit", lex, RDF + ("dirLangString" if way else "langString"), lang.lower(), way)
    return ("lit", lex, dt or STRING, None, None)


# -- RDF/XML


class _RdfXml:
    def __init__(self, base: str | None, scope: str):
        self.base, self.scope, self.out, self.made = base or "", scope, [], 0

    def blank(self, label: str | None = None) -> tuple:
        self.made += label is None
        return ("bnode", f"{self.scope}{label}" if label else f"{self.scope}x{self.made}")

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def read(self, text: str | bytes) -> list[tuple]:
        root = ElementTree.fromstring(text)
        nodes = list(root) if self.name(root.tag) == RDF + "RDF" else [root]
        base, lang = root.get(XML + "base", self.base), root.get(XML + "lang")
        for node in nodes:
            self.node(node, base, lang)
        return [(None, *x) for x in self.out]

    def node(self, e, base: str, lang: str | None) -> tuple:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        own = lambda n: e.get(f"{{{RDF}}}{n}")
        if own("about") is not None:
            s: tuple = ("iri", urljoin(base, own("about")))
        elif own("ID") is not None:
            s = ("iri", urljoin(base, "#" + own("ID")))
        else:
            s = self.blank(own("nodeID"))
        if self.name(e.tag) != RDF + "Description":
            self.out.append((s, ("iri", RDF + "type"), ("iri", self.name(e.tag))))
        for k, v in e.attrib.items():
            if not k.startswith(XML) and self.name(k) not in {RDF + n for n in ("about", "ID", "nodeID")}:
                kind = ("iri", urljoin(base, v)) if self.name(k) == RDF + "type" else literal(v, lang=lang)
                self.out.append((s, ("iri", self.name(k)), kind))
        self.properties(e, s, base, lang)
        return s

    def properties(self, e, s: tuple, base: str, lang: str | None) -> None:
        items = 0
        for p in e:
            name = self.name(p.tag)
            if name == RDF + "li":
                items += 1
                name = f"{RDF}_{items}"
            b, tongue = p.get(XML + "base", base), p.get(XML + "lang", lang)
            o = self.value(p, b, tongue)
            self.out.append((s, ("iri", name), o))
            if (label := p.get(f"{{{RDF}}}ID")) is not None:
                about = ("iri", urljoin(b, "#" + label))
                for part, x in (("type", ("iri", RDF + "Statement")), ("subject", s), ("predicate", ("iri", name)), ("object", o)):
                    self.out.append((about, ("iri", RDF + part), x))

    def value(self, p, base: str, lang: str | None) -> tuple:
        own = lambda n: p.get(f"{{{RDF}}}{n}")
        kind, children = own("parseType"), list(p)
        if kind == "Resource":
            node = self.blank()
            self.properties(p, node, base, lang)
            return node
        if kind == "Collection":
            items = [self.node(c, base, lang) for c in children]
            head: tuple = ("iri", RDF + "nil")
            for x in reversed(items):
                cell = self.blank()
                self.out += [(cell, ("iri", RDF + "first"), x), (cell, ("iri", RDF + "rest"), head)]
                head = cell
            return head
        if kind is not None:
            inner = escape(p.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in children)
            return literal(inner, RDF + "XMLLiteral")
        if children:
            return self.node(children[0], base, lang)
        more = {k: v for k, v in p.attrib.items() if not k.startswith(XML) and self.name(k) not in {RDF + n for n in ("ID", "resource", "nodeID", "datatype")}}
        if own("resource") is not None or own("nodeID") is not None or more:
            o = ("iri", urljoin(base, own("resource"))) if own("resource") is not None else self.blank(own("nodeID"))
            for k, v in more.items():
                self.out.append((o, ("iri", self.name(k)), ("iri", urljoin(base, v)) if self.name(k) == RDF + "type" else literal(v, lang=lang)))
            return o
        return literal(p.text or "", own("datatype"), None if own("datatype") else lang)


# -- JSON-LD


class _JsonLd:
    """To quads, with contexts in the document; a context by address raises, as nothing is fetched."""

    def __init__(self, base: str | None, scope: str):
        self.base, self.scope, self.out, self.made = base or "", scope, [], 0

    def blank(self, label: str | None = None) -> tuple:
        self.made += label is None
        return ("bnode", f"{self.scope}{label}" if label else f"{self.scope}x{self.made}")

    def read(self, text: str | bytes) -> list[tuple]:
        self.items(json.loads(text), {"@base": self.base}, None)
        return self.out

    def context(self, ctx: dict, new) -> dict:
        for c in new if isinstance(new, list) else [new]:
            if c is None:
                ctx = {"@base": self.base}
            elif isinstance(c, str):
                raise ValueError(f"context {c} is not in the document")
            else:
                ctx = ctx | {k: v for k, v in c.items() if k != "@base"}
                if "@base" in c:
                    ctx["@base"] = urljoin(ctx.get("@base") or "", c["@base"]) if c["@base"] else ""
        return ctx

    def iri(self, x: str, ctx: dict, vocab: bool) -> str | None:
        """The IRI of a term, compact or relative IRI; None where it has none."""
        if x.startswith("@"):
            return x
        d = ctx.get(x, "") if vocab else ""
        found = d.get("@id", "") if isinstance(d, dict) else d
        if found != "" and found != x:
            return found if found is None else self.iri(found, ctx, True)
        if ":" in x:
            prefix, rest = x.split(":", 1)
            if prefix == "_" or rest.startswith("//"):
                return x
            d = ctx.get(prefix)
            head = d.get("@id") if isinstance(d, dict) else d
            return self.iri(head, ctx, True) + rest if head else x
        if vocab:
            return ctx["@vocab"] + x if ctx.get("@vocab") is not None else None
        return urljoin(ctx.get("@base") or "", x)

    def term(self, x: str, ctx: dict, vocab: bool = False) -> tuple | None:
        found = self.iri(x, ctx, vocab)
        return None if found is None else self.blank(found[2:]) if found.startswith("_:") else ("iri", found)

    def items(self, x, ctx: dict, graph: tuple | None) -> None:
        for one in x if isinstance(x, list) else [x]:
            if isinstance(one, dict):
                self.node(one, ctx, graph)

    def node(self, e: dict, ctx: dict, graph: tuple | None) -> tuple:
        ctx = self.context(ctx, e["@context"]) if "@context" in e else ctx
        named = {self.key(k, ctx): (k, v) for k, v in e.items() if k != "@context"}
        only_graph = set(named) <= {"@graph", "@included"}
        s = self.term(named["@id"][1], ctx) if "@id" in named else self.blank()
        if "@graph" in named:
            self.items(named["@graph"][1], ctx, graph if only_graph or ("@id" not in named and graph is None and len(named) == 1) else s)
        if "@included" in named:
            self.items(named["@included"][1], ctx, graph)
        for kind in self.many(named.get("@type", (0, []))[1]):
            self.out.append((graph, s, ("iri", RDF + "type"), self.term(kind, ctx, True) or self.term(kind, ctx)))
        for back, v in (named.get("@reverse", (0, {}))[1]).items():
            for one in self.many(v):
                if p := self.term(back, ctx, True):
                    self.out.append((graph, self.value(one, back, ctx, graph), p, s))
        for name, (k, v) in named.items():
            if name is None or name.startswith("@") or ":" not in name:
                continue
            spec = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            for o in self.values(v, k, spec, ctx, graph):
                self.out.append((graph, o, ("iri", name), s) if "@reverse" in spec else (graph, s, ("iri", name), o))
        return s

    def key(self, k: str, ctx: dict) -> str | None:
        d = ctx.get(k)
        return self.iri(d["@reverse"], ctx, True) if isinstance(d, dict) and "@reverse" in d else self.iri(k, ctx, True)

    @staticmethod
    def many(v) -> list:
        return v if isinstance(v, list) else [] if v is None else [v]

    def values(self, v, k: str, spec: dict, ctx: dict, graph: tuple | None) -> Iterator[tuple]:
        box = self.many(spec.get("@container"))
        if "@list" in box and not (isinstance(v, dict) and "@list" in v):
            v = {"@list": self.many(v)}
        if isinstance(v, dict) and "@language" in box:
            for lang, texts in v.items():
                for text in self.many(texts):
                    yield literal(text, lang=None if lang == "@none" else lang)
            return
        if isinstance(v, dict) and ("@index" in box or "@id" in box):
            v = [{**x, "@id": i} if "@id" in box and isinstance(x, dict) else x for i, xs in v.items() for x in self.many(xs)]
        for one in self.many(v):
            if isinstance(one, dict) and "@set" in one:
                yield from self.values(one["@set"], k, spec, ctx, graph)
            elif (found := self.value(one, k, ctx, graph)) is not None:
                yield found

    def value(self, x, k: str, ctx: dict, graph: tuple | None) -> tuple | None:
        spec = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
        kind = spec.get("@type")
        if isinstance(x, dict):
            inner = {self.iri(n, ctx, True): y for n, y in x.items()}
            if "@value" in inner:
                dt = self.iri(inner["@type"], ctx, True) if inner.get("@type") else None
                return None if inner["@value"] is None else self.scalar(inner["@value"], dt, inner.get("@language"), inner.get("@direction"))
            if "@list" in inner:
                cells = [o for y in self.many(inner["@list"]) if (o := self.value(y, k, ctx, graph)) is not None]
                head: tuple = ("iri", RDF + "nil")
                for o in reversed(cells):
                    cell = self.blank()
                    self.out += [(graph, cell, ("iri", RDF + "first"), o), (graph, cell, ("iri", RDF + "rest"), head)]
                    head = cell
                return head
            return self.node(x, ctx, graph)
        if x is None:
            return None
        if kind in ("@id", "@vocab") and isinstance(x, str):
            return self.term(x, ctx, kind == "@vocab") or self.term(x, ctx)
        dt = self.iri(kind, ctx, True) if kind and not kind.startswith("@") else None
        lang = spec.get("@language", ctx.get("@language")) if isinstance(x, str) and not dt else None
        return self.scalar(x, dt, lang, None)

    @staticmethod
    def scalar(x, dt: str | None, lang: str | None, way: str | None) -> tuple:
        if isinstance(x, bool):
            return literal("true" if x else "false", dt or XSD + "boolean")
        if isinstance(x, float) and (not x.is_integer() or abs(x) >= 1e21 or dt == XSD + "double"):
            head, exponent = f"{x:.15E}".split("E")
            head = head.rstrip("0")
            return literal(f"{head}0E{int(exponent)}" if head.endswith(".") else f"{head}E{int(exponent)}", dt or XSD + "double")
        if isinstance(x, (int, float)):
            return literal(str(int(x)), dt or XSD + "integer")
        return literal(x, dt, lang, way)


# -- reading


def parse(text: str | bytes, form: str, base: str | None = None, rename_blank_nodes: bool = True, without_named_graphs: bool = False) -> list[tuple]:
    """Quads of a document, or of a file object, as plan terms: (graph or None, s, p, o)."""
    if hasattr(text, "read"):
        text = text.read()
    form = format_of(form)
    scope = uuid.uuid4().hex[:8] + "_" if rename_blank_nodes else ""
    if form == "rdfxml":
        quads = _RdfXml(base, scope).read(text)
    elif form == "jsonld":
        quads = _JsonLd(base, scope).read(text)
    else:
        text = text.decode() if isinstance(text, bytes) else text
        if form == "nquads":
            # Each line as a TriG block of its own graph.
            lines = [re.fullmatch(ntriples.LINE, x) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
            if None in lines:
                raise ValueError("not a document of N-Quads")
            text = "\n".join(f"{m[4] or ''} {{ {m[1]} {m[2]} {m[3]} }}" for m in lines)
        quads = turtle.parse(text, base, rename_blank_nodes)
    if without_named_graphs and any(q[0] for q in quads):
        raise ValueError("the document has named graphs")
    return list(dict.fromkeys(quads))


def read(spark: SparkSession, path: str, form: str | None = None, *, graph: str | None = None, base: str | None = None, rename_blank_nodes: bool = True, lenient: bool = False) -> DataFrame:
    """Quads of a file, or of all files of a folder; graph: where triples of the default graph go."""
    form = format_of(form or path)
    if form in ("ntriples", "nquads"):
        return ntriples.read(spark, path, graph=graph, rename_blank_nodes=rename_blank_nodes, lenient=lenient)
    texts = spark.read.text(path, wholetext=True).toLocalIterator()
    found = turtle.frame(spark, [q for r in texts for q in parse(r[0], form, base or path, rename_blank_nodes)])
    return found if graph is None else found.withColumn("g", F.coalesce("g", F.lit(graph)))


# -- writing


def _quads(quads: DataFrame) -> Iterator[tuple]:
    """Rows in order of graph, subject and predicate, as plan terms."""
    p = F.col("p") if dict(quads.dtypes)["p"] == "string" else F.col("p")["lex"]
    g = F.col("g") if "g" in quads.columns else F.lit(None).cast("string")
    rows = quads.select(g.alias("g"), "s", p.alias("p"), "o", t.text_of(F.col("s")).alias("st"), t.text_of(F.col("o")).alias("ot"))
    for r in rows.orderBy(F.col("g").asc_nulls_first(), "st", "p", "ot").toLocalIterator():
        yield r["g"], r["st"], r["p"], r["ot"], r["s"], r["o"]


def _turtle(rows: Iterable[tuple], graphs: bool) -> Iterator[str]:
    for g, in_graph in groupby(rows, key=lambda r: r[0]):
        if g is not None and not graphs:
            raise ValueError("Turtle has no named graphs")
        yield f"<{g}> {{\n" if g is not None else ""
        for s, of_s in groupby(in_graph, key=lambda r: r[1]):
            lines = [f"{'a' if p == RDF + 'type' else f'<{p}>'} " + " , ".join(r[3] for r in of_p) for p, of_p in groupby(of_s, key=lambda r: r[2])]
            yield f"{s} " + " ;\n    ".join(lines) + " .\n"
        yield "}\n" if g is not None else ""


def _rdfxml(rows: Iterable[tuple]) -> Iterator[str]:
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n'
    for _, of_s in groupby(rows, key=lambda r: (r[0], r[1])):
        for i, (g, _, p, _, s, o) in enumerate(of_s):
            if g is not None or s["k"] == t.TRIPLE or o["k"] == t.TRIPLE:
                raise ValueError("RDF/XML has neither named graphs nor quoted triples")
            if i == 0:
                yield f"<rdf:Description rdf:{'about' if s['k'] == t.IRI else 'nodeID'}={quoteattr(s['lex'] if s['k'] == t.IRI else _nc(s['lex']))}>\n"
            space, local = re.fullmatch(r"(?s)(.*?)([^\W\d][\w.\-]*)", p).groups() if re.search(r"[^\W\d][\w.\-]*$", p) else (None, None)
            if not space:
                raise ValueError(f"{p} has no name that XML allows")
            tag = f"<n0:{local} xmlns:n0={quoteattr(space)}"
            if o["k"] != t.LITERAL:
                yield f"  {tag} rdf:{'resource' if o['k'] == t.IRI else 'nodeID'}={quoteattr(o['lex'] if o['k'] == t.IRI else _nc(o['lex']))}/>\n"
            else:
                kind = f" xml:lang={quoteattr(o['lang'])}" if o["lang"] else "" if o["dt"] in (None, STRING) else f" rdf:datatype={quoteattr(o['dt'])}"
                yield f"  {tag}{kind}>{escape(o['lex'])}</n0:{local}>\n"
        yield "</rdf:Description>\n"
    yield "</rdf:RDF>\n"


def _nc(label: str) -> str:
    return "b" + re.sub(r"[^\w.\-]", lambda m: f".{ord(m[0]):x}.", label)


def _json_value(o) -> dict:
    if o["k"] == t.TRIPLE:
        raise ValueError("JSON-LD has no quoted triples")
    if o["k"] != t.LITERAL:
        return {"@id": o["lex"] if o["k"] == t.IRI else f"_:{o['lex']}"}
    out = {"@value": o["lex"]}
    if o["lang"]:
        out |= {"@language": o["lang"]} | ({"@direction": o["dir"]} if o["dir"] else {})
    elif o["dt"] not in (None, STRING):
        out["@type"] = o["dt"]
    return out


def _jsonld(rows: Iterable[tuple]) -> Iterator[str]:
    yield "["
    first = True
    for g, in_graph in groupby(rows, key=lambda r: r[0]):
        nodes = []
        for _, of_s in groupby(in_graph, key=lambda r: r[1]):
            node: dict = {}
            for _, _, p, _, s, o in of_s:
                node.setdefault("@id", _json_value(s)["@id"])
                if p == RDF + "type" and o["k"] != t.LITERAL:
                    node.setdefault("@type", []).append(_json_value(o)["@id"])
                else:
                    node.setdefault(p, []).append(_json_value(o))
            if g is None:
                yield ("" if first else ",") + "\n" + json.dumps(node, ensure_ascii=False)
                first = False
            else:
                nodes.append(node)
        if g is not None:
            yield ("" if first else ",") + "\n" + json.dumps({"@id": g, "@graph": nodes}, ensure_ascii=False)
            first = False
    yield "\n]\n"


def serialize(quads: DataFrame, form: str) -> Iterator[str]:
    """The text of a document, piece by piece; a format without named graphs refuses quads that stand in one."""
    form = format_of(form)
    if form in ("ntriples", "nquads"):
        if form == "ntriples" and "g" in quads.columns and not quads.where("g IS NOT NULL").isEmpty():
            raise ValueError("N-Triples has no named graphs")
        return (r[0] + "\n" for r in ntriples.lines(quads, form == "nquads").toLocalIterator())
    rows = _quads(quads)
    if form == "rdfxml":
        return _rdfxml(rows)
    return _jsonld(rows) if form == "jsonld" else _turtle(rows, form == "trig")


def write(quads: DataFrame, path: str, form: str | None = None) -> None:
    """N-Triples and N-Quads become a folder of files, written by all executors; other formats one file."""
    form = format_of(form or path)
    if form in ("ntriples", "nquads"):
        ntriples.write(quads, path, form == "nquads")
        return
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(serialize(quads, form))


def convert(spark: SparkSession, source: str, target: str, *, from_form: str | None = None, to_form: str | None = None, from_graph: str | None = None, to_graph: str | None = None, lenient: bool = False) -> None:
    """One file to another without a store; from_graph keeps that graph only, to_graph names where triples go."""
    quads = read(spark, source, from_form, lenient=lenient, rename_blank_nodes=False)
    if from_graph is not None:
        quads = quads.where(F.col("g") == from_graph).withColumn("g", F.lit(None).cast("string"))
    if to_graph is not None:
        quads = quads.withColumn("g", F.coalesce("g", F.lit(to_graph)))
    write(quads, target, to_form)
