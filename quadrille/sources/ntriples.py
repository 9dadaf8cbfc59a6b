"""N-Triples and N-Quads as splittable text: read and written by built-in functions, line by line."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..plans.algebra import RDF, STRING

_IRI, _BNODE, _LIT, _QUOTED = r"<[^<>\"]*>", r"_:[^\s<\"]+", r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9\-]+|\^\^<[^<>]*>)?', r"<<\(.*\)>>"
LINE = rf"^\s*({_QUOTED}|{_IRI}|{_BNODE})\s*({_IRI})\s*({_QUOTED}|{_IRI}|{_BNODE}|{_LIT})\s*({_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"


def _unescape(c: Column) -> Column:
    mark = "﷐"
    out = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    simple = F.replace(out, F.lit(mark), F.lit("\\"))
    # Numeric escapes are rare: they alone are turned in Python, in Arrow batches.
    turn = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else _numeric(x)).astype(object), "string", F.PandasUDFType.SCALAR)
    return F.when(c.rlike(r"\\[uU][0-9A-Fa-f]{4}"), turn(c)).when(c.contains("\\"), simple).otherwise(c)


def _numeric(x: str) -> str:
    from ..plans.sparql import unescape

    return unescape(x)


def parse_term(c: Column, scope: str) -> Column:
    """A term from its text; scope keeps blank nodes of different loads apart."""
    body = _unescape(F.regexp_extract(c, r'(?s)^"((?:[^"\\]|\\.)*)"', 1))
    tag, dt = F.regexp_extract(c, r'"@([A-Za-z0-9\-]+?)(?:--(?:ltr|rtl))?$', 1), F.regexp_extract(c, r'"\^\^<([^<>]*)>$', 1)
    way = F.regexp_extract(c, r"--(ltr|rtl)$", 1)
    literal = F.when(tag != "", F.when(way != "", t.literal(body, RDF + "dirLangString", F.lower(tag), way)).otherwise(t.literal(body, RDF + "langString", F.lower(tag)))).otherwise(t.literal(body, F.when(dt == "", STRING).otherwise(dt)))
    inner = _unescape(F.substring(c, F.lit(2), F.length(c)))
    return (
        F.when(c.startswith("<<("), t.term(t.TRIPLE, F.regexp_replace(c, r"\s+", " ")))
        .when(c.startswith("<"), t.iri(F.rtrim(F.regexp_replace(inner, ">$", ""))))
        .when(c.startswith("_:"), t.term(t.BNODE, F.concat(F.lit(scope), F.substring(c, F.lit(3), F.length(c)))))
        .when(c.startswith('"'), literal)
    )


def read(spark: SparkSession, paths: str | list[str], *, graph: str | None = None, rename_blank_nodes: bool = True, lenient: bool = False) -> DataFrame:
    """Quads of N-Triples or N-Quads files. A line that can't be read is an error, or left out where lenient."""
    return parse_lines(spark.read.text(paths), graph=graph, rename_blank_nodes=rename_blank_nodes, lenient=lenient)


def parse_lines(lines: DataFrame, *, graph: str | None = None, rename_blank_nodes: bool = True, lenient: bool = False) -> DataFrame:
    scope = uuid.uuid4().hex[:8] + "_" if rename_blank_nodes else ""
    line = F.col("value")
    rows = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract(line, LINE, i)
    subject = part(1)
    if lenient:
        rows = rows.where(line.rlike(LINE))
    else:
        subject = F.when(line.rlike(LINE), subject).otherwise(F.raise_error(F.concat(F.lit("no N-Quads line: "), line)).cast("string"))
    g = F.when(part(4) == "", F.lit(graph).cast("string")).otherwise(F.regexp_replace(part(4), "^<|>$", ""))
    return rows.select(g.alias("g"), parse_term(subject, scope).alias("s"), F.regexp_replace(part(2), "^<|>$", "").alias("p"), parse_term(part(3), scope).alias("o"))


def lines(quads: DataFrame, with_graphs: bool = True) -> DataFrame:
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("") if with_graphs and "g" in quads.columns else F.lit("")
    p = F.col("p") if dict(quads.dtypes)["p"] == "string" else F.col("p")["lex"]
    return quads.select(F.concat(t.text_of(F.col("s")), F.lit(" <"), p, F.lit("> "), t.text_of(F.col("o")), graph, F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, with_graphs: bool = True) -> None:
    lines(quads, with_graphs).write.text(path)
