"""Running queries: SELECT, ASK, CONSTRUCT and DESCRIBE over a dataset."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators.paths import cut
from ..sources.dataset import Dataset
from . import algebra as A
from .compiler import Options, PatternCompiler, Rel
from .sparql import parse_query


class TooManyResults(RuntimeError):
    """The result has more rows than the options allow."""


@dataclass
class Result:
    """form: select, ask, construct or describe; df: term columns, or s, p, o of triples; names: variables in order."""

    form: str
    df: DataFrame
    names: list[str]

    def boolean(self) -> bool:
        return bool(self.df.first()[0])

    def decode(self, types: dict[str, str] | None = None) -> DataFrame:
        """Native columns: the text of each term, cast as named in types (bigint, double, timestamp, decimal, ...)."""
        if self.form == "ask":
            return self.df
        types = types or {}
        return self.df.select(*(decode(F.col(f"`{n}`"), types.get(n)).alias(n) for n in self.names))


def decode(c: Column, kind: str | None) -> Column:
    lex = c["lex"]
    if not kind or kind == "string":
        return lex
    if kind == "rounded":  # sums of doubles depend on their order in the last digits
        return F.round(lex.try_cast("double"), 2)
    return t.moment(c) if kind == "timestamp" else lex.try_cast(kind)


def run(dataset: Dataset, text: str, options: Options | None = None, base: str | None = None, prefixes: dict[str, str] | None = None, *, substitutions: dict[str, tuple] | None = None, default_graphs: list | None = None, named_graphs: list | None = None) -> Result:
    """substitutions: terms that take the place of variables; default_graphs, named_graphs: instead of FROM and FROM NAMED."""
    query = parse_query(text, base, prefixes)
    if default_graphs is not None or named_graphs is not None:
        query = replace(query, default_graphs=default_graphs, named_graphs=named_graphs)
    if substitutions:
        query = replace(query, pattern=substituted(query.pattern, substitutions), template=[tuple(_put(x, substitutions, False) for x in q) for q in query.template])
    return run_parsed(dataset, query, options)


def _put(x, terms: dict[str, tuple], expression: bool):
    """x with the terms in place of their variables: plain in patterns, as constants in expressions."""
    if isinstance(x, A.Node):
        return substituted(x, terms)
    if isinstance(x, tuple):
        if len(x) == 2 and x[0] == "var" and x[1] in terms:
            return ("const", terms[x[1]]) if expression else terms[x[1]]
        return tuple(_put(y, terms, expression) for y in x)
    return x


def substituted(node: A.Node, terms: dict[str, tuple]) -> A.Node:
    changed = {f.name: _put(getattr(node, f.name), terms, f.name in ("condition", "value", "keys", "aggregates")) for f in fields(node)}
    if isinstance(node, A.Group):
        changed["keys"] = tuple(k for k in node.keys if k not in terms)
    out = replace(node, **changed)
    if isinstance(node, A.Project) and (named := [n for n in node.names if n in terms]):
        # A variable that is asked for comes back as its term.
        child = out.child
        for n in named:
            child = A.Extend(child, n, ("const", terms[n]))
        out = replace(out, child=child)
    return out


def run_parsed(dataset: Dataset, query: A.Query, options: Options | None = None) -> Result:
    options = options or Options()
    compiler = PatternCompiler(dataset, options, query.default_graphs, query.named_graphs, query.base)
    rel = compiler.compile(query.pattern)
    if options.max_results is not None and query.form == "select":
        # One row more than allowed tells that there are too many, and no more is computed.
        if rel.df.limit(options.max_results + 1).count() > options.max_results:
            raise TooManyResults(f"more than {options.max_results} rows")
    match query.form:
        case "select":
            return Result("select", rel.df, rel.names)
        case "ask":
            found = rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
            return Result("ask", found, ["answer"])
        case "construct":
            return Result("construct", construct(rel, query.template), ["s", "p", "o"])
    return Result("describe", describe(compiler, rel, query.described), ["s", "p", "o"])


def template_row(rel: Rel, x: tuple, row: Column | None) -> Column:
    if x[0] == "var":
        if x[1].startswith("_:"):
            return t.term(t.BNODE, F.concat(F.lit("c"), row, F.lit(f"_{x[1][2:]}")))
        return rel.col(x[1]) if x[1] in rel.names else t.null_term()
    if x[0] == "triple":
        s, p, o = (template_row(rel, y, row) for y in x[1:])
        return F.when(s.isNotNull() & p.isNotNull() & o.isNotNull(), t.term(t.TRIPLE, F.concat(F.lit("<<( "), t.text_of(s), F.lit(" "), t.text_of(p), F.lit(" "), t.text_of(o), F.lit(" )>>"))))
    return t.constant(x)


def instantiate(rel: Rel, template: list) -> DataFrame:
    """Quads (g, s, p, o) of templates (g or None, s, p, o); ill-formed ones are left out."""
    row = None
    if any(isinstance(y, tuple) and y[0] == "var" and y[1].startswith("_:") for q in template for y in q if y):
        # Blank nodes are new for each solution, equal ones too: named by the row's values and its place.
        place = F.monotonically_increasing_id().cast("string")
        row = F.concat(F.substring(F.sha2(F.to_json(F.struct(*(rel.col(n) for n in rel.names))), 256), 1, 24), F.lit("."), place) if rel.names else place
    if not template:
        return rel.df.sparkSession.createDataFrame([], t.QUAD)
    made = []
    for g, s, p, o in template:
        graph = F.lit(None).cast("string") if g is None else F.lit(g[1]) if g[0] == "iri" else rel.col(g[1])["lex"] if g[1] in rel.names else F.lit("")
        needs = F.lit(True) if g is None or g[0] == "iri" else (rel.col(g[1])["k"] == t.IRI) if g[1] in rel.names else F.lit(False)
        a, b, c = (template_row(rel, x, row) for x in (s, p, o))
        ok = needs & a["k"].isin(t.BNODE, t.IRI, t.TRIPLE) & (b["k"] == t.IRI) & c.isNotNull()
        made.append(F.when(ok, F.struct(graph.alias("g"), a.alias("s"), b["lex"].alias("p"), c.alias("o"))))
    return rel.df.select(F.explode(F.array(*made)).alias("q")).where("q IS NOT NULL").select("q.*")


def construct(rel: Rel, template: list) -> DataFrame:
    quads = instantiate(rel, [(None, *x) for x in template])
    return quads.select("s", t.iri(F.col("p")).alias("p"), "o").dropDuplicates()


def describe(compiler: PatternCompiler, rel: Rel, described: list) -> DataFrame:
    """Concise bounded descriptions: the triples of each resource, and of blank nodes that they lead to."""
    spark = compiler.spark
    named = list(dict.fromkeys(x for x in described if x[0] != "var"))
    nodes = spark.createDataFrame([(t.as_row(x),) for x in named], t.T.StructType([t.T.StructField("n", t.TERM)]))
    triple = ["s", t.iri(F.col("p")).alias("p"), "o"]

    def of(nodes: DataFrame) -> DataFrame:
        return compiler.quads(None).join(nodes, F.col("s") == F.col("n")).select(*triple)

    # A resource that is named is looked up by its own subject; only others are looked for among all quads.
    found = [q.where(compiler.equals(F.col("s"), x)).select(*triple) for x in named for q in [compiler.quads(None, x[1] if x[0] == "iri" else None)]]
    given = [rel.df.select(rel.col(x[1]).alias("n")) for x in described if x[0] == "var" and x[1] in rel.names]
    if given:
        others = cut(reduce(DataFrame.union, given).where("n IS NOT NULL").distinct().join(nodes, "n", "left_anti"))
        found.append(of(others))
        nodes = nodes.union(others)
    if not found:
        return compiler.quads(None).where(F.lit(False)).select(*triple)
    total = more = cut(reduce(DataFrame.union, found))
    seen = nodes
    while True:
        blank = more.where(F.col("o")["k"] == t.BNODE).select(F.col("o").alias("n")).distinct()
        frontier = cut(blank.join(seen, "n", "left_anti"))
        if frontier.isEmpty():
            return total.dropDuplicates()
        more = cut(of(frontier))
        total, seen = total.union(more), seen.union(frontier)
