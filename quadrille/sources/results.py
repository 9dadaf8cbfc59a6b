"""SPARQL results as JSON, XML, CSV and TSV, made row by row from a streamed result, and read back."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from ..functions import terms as t
from ..plans.algebra import STRING
from ..plans.engine import Result

NS = "http://www.w3.org/2005/sparql-results#"


def _json_term(x) -> dict:
    k, lex, dt, lang, way = x
    if k == t.IRI:
        return {"type": "uri", "value": lex}
    if k == t.BNODE:
        return {"type": "bnode", "value": lex}
    if k == t.TRIPLE:
        s, p, o = (_json_term(t.as_row(y)) for y in t.parse_terms(lex)[0][1:])
        return {"type": "triple", "value": {"subject": s, "predicate": p, "object": o}}
    out = {"type": "literal", "value": lex}
    if lang:
        out["xml:lang"] = lang
        if way:
            out["its:dir"] = way
    elif dt != STRING:
        out["datatype"] = dt
    return out


def _turtle_term(x) -> str:
    return {t.IRI: lambda: f"<{x[1]}>", t.BNODE: lambda: f"_:{x[1]}", t.TRIPLE: lambda: x[1]}.get(x[0], lambda: t.canonical(("lit", *x[1:])))()


def serialize(result: Result, form: str) -> Iterator[str]:
    """Pieces of text; form: json, xml, csv or tsv."""
    if result.form == "ask":
        yes = "true" if result.boolean() else "false"
        yield {"json": json.dumps({"head": {}, "boolean": yes == "true"}), "xml": f'<?xml version="1.0"?><sparql xmlns="{NS}"><head/><boolean>{yes}</boolean></sparql>'}.get(form, yes)
        return
    names, rows = result.names, result.df.toLocalIterator()
    if form == "json":
        yield json.dumps({"vars": names}).join(('{"head":', ',"results":{"bindings":['))
        for i, r in enumerate(rows):
            yield ("," if i else "") + json.dumps({n: _json_term(v) for n, v in zip(names, r, strict=True) if v is not None}, ensure_ascii=False)
        yield "]}}"
    elif form == "xml":
        yield f'<?xml version="1.0"?><sparql xmlns="{NS}"><head>' + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head><results>"
        for r in rows:
            yield "<result>" + "".join(f"<binding name={quoteattr(n)}>{_xml_term(v)}</binding>" for n, v in zip(names, r, strict=True) if v is not None) + "</result>"
        yield "</results></sparql>"
    else:
        csv_form = form == "csv"
        yield (",".join(names) + "\r\n") if csv_form else ("\t".join(f"?{n}" for n in names) + "\n")
        for r in rows:
            if csv_form:
                buffer = io.StringIO()
                csv.writer(buffer).writerow(["" if v is None else f"_:{v[1]}" if v[0] == t.BNODE else v[1] for v in r])
                yield buffer.getvalue()
            else:
                yield "\t".join("" if v is None else _turtle_term(v) for v in r) + "\n"


def _xml_term(x) -> str:
    k, lex, dt, lang, _ = x
    if k == t.IRI:
        return f"<uri>{escape(lex)}</uri>"
    if k == t.BNODE:
        return f"<bnode>{escape(lex)}</bnode>"
    if k == t.TRIPLE:
        parts = [t.as_row(y) for y in t.parse_terms(lex)[0][1:]]
        return "<triple>" + "".join(f"<{n}>{_xml_term(y)}</{n}>" for n, y in zip(("subject", "predicate", "object"), parts, strict=True)) + "</triple>"
    tail = f" xml:lang={quoteattr(lang)}" if lang else "" if dt == STRING else f" datatype={quoteattr(dt)}"
    return f"<literal{tail}>{escape(lex)}</literal>"


def parse(text: str, form: str) -> tuple[list[str], list[dict]] | bool:
    """Names and rows (name -> plan term), or a boolean."""
    from ..plans.algebra import RDF

    def lit(lex, lang, dt):
        return ("lit", lex, RDF + "langString" if lang else dt or STRING, lang.lower() if lang else None, None)

    if form == "json":
        doc = json.loads(text)
        if "boolean" in doc:
            return doc["boolean"]

        def term(x: dict) -> tuple:
            if x["type"] == "uri":
                return ("iri", x["value"])
            if x["type"] == "bnode":
                return ("bnode", x["value"])
            if x["type"] == "triple":
                return ("triple", *(term(x["value"][k]) for k in ("subject", "predicate", "object")))
            return lit(x["value"], x.get("xml:lang"), x.get("datatype"))

        return doc["head"]["vars"], [{k: term(v) for k, v in b.items()} for b in doc["results"]["bindings"]]
    if form == "xml":
        root = ElementTree.fromstring(text)
        tag = lambda n: f"{{{NS}}}{n}"
        if (b := root.find(tag("boolean"))) is not None:
            return b.text.strip() == "true"

        def node(x) -> tuple:
            kind = x.tag.split("}")[1]
            if kind == "uri":
                return ("iri", x.text or "")
            if kind == "bnode":
                return ("bnode", x.text or "")
            if kind == "triple":
                return ("triple", *(node(y[0]) for y in x))
            return lit(x.text or "", x.get("{http://www.w3.org/XML/1998/namespace}lang"), x.get("datatype"))

        names = [v.get("name") for v in root.iter(tag("variable"))]
        return names, [{b.get("name"): node(b[0]) for b in r} for r in root.iter(tag("result"))]
    head, *body = text.rstrip("\n").split("\n")
    if not head.startswith("?"):
        return head.strip() == "true"
    names = [n[1:] for n in head.split("\t")]
    from ..plans.sparql import Parser

    def cell(x: str) -> tuple:
        y = Parser(x).term([])
        return ("bnode", y[1][2:]) if y[0] == "var" else y

    return names, [{n: cell(c) for n, c in zip(names, r.split("\t"), strict=True) if c} for r in body]
