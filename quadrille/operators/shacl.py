"""SHACL Core: shapes are read on the driver (a shapes graph is small), data are checked by joins.

Shapes with sh:targetNode, sh:targetClass or a class of their own name; property shapes with an IRI path and minCount,
maxCount, datatype, nodeKind, class, hasValue and in. A path that is no IRI is left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..plans.algebra import RDF, RDFS, STRING, XSD
from ..sources.dataset import Dataset, distinct
from .paths import cut

SH = "http://www.w3.org/ns/shacl#"
KINDS = {"IRI": (1,), "BlankNode": (0,), "Literal": (2,), "BlankNodeOrIRI": (0, 1), "BlankNodeOrLiteral": (0, 2), "IRIOrLiteral": (1, 2)}
CONSTRAINTS = ("minCount", "maxCount", "datatype", "nodeKind", "class", "hasValue", "in")
REPORT = "focus_node string, path string, source_shape string, source_constraint_component string, severity string, message string, value string"


@dataclass
class Shape:
    name: str
    target_nodes: list = field(default_factory=list)
    target_classes: list = field(default_factory=list)
    properties: list = field(default_factory=list)  # (path or None, constraint, argument)


def compile_shapes(shapes: DataFrame) -> list[Shape]:
    by: dict[tuple, dict[str, list[tuple]]] = {}
    for s, p, o in shapes.select("s", "p", "o").distinct().toLocalIterator():
        by.setdefault(tuple(s), {}).setdefault(p, []).append(tuple(o))
    nested = {o for ps in by.values() for o in ps.get(SH + "property", [])}

    def items(node: tuple) -> list[tuple]:
        out, seen = [], set()
        while node in by and node not in seen:
            seen.add(node)
            out += by[node].get(RDF + "first", [])
            node = by[node].get(RDF + "rest", [(1, RDF + "nil", None, None, None)])[0]
        return out

    def constraints(ps: dict, path: str | None) -> list:
        out = []
        for c in CONSTRAINTS:
            for v in ps.get(SH + c, []):
                out.append((path, c, items(v) if c == "in" else v))
        return out

    found = []
    for node, ps in by.items():
        node_shape = (1, SH + "NodeShape", None, None, None) in ps.get(RDF + "type", [])
        if node in nested or not (node_shape or any(p in ps for p in (SH + "property", SH + "targetNode", SH + "targetClass"))):
            continue
        shape = Shape(node[1], ps.get(SH + "targetNode", []), [c[1] for c in ps.get(SH + "targetClass", [])])
        if any(c[1] == RDFS + "Class" for c in ps.get(RDF + "type", [])):
            shape.target_classes.append(node[1])
        own = ps.get(SH + "path", [])
        shape.properties += constraints(ps, own[0][1] if own and own[0][0] == 1 else None)
        for prop in ps.get(SH + "property", []):
            inner = by.get(prop, {})
            path = inner.get(SH + "path", [])
            if path and path[0][0] == 1:
                shape.properties += constraints(inner, path[0][1])
        found.append(shape)
    return found


def _members(quads: DataFrame, classes: list[str]) -> DataFrame:
    """(node, class) of instances of the classes or of their subclasses."""
    spark = quads.sparkSession
    wanted = spark.createDataFrame([(c, c) for c in classes], "cls string, top string")
    sub = quads.where(F.col("p") == RDFS + "subClassOf").select(F.col("s")["lex"].alias("low"), F.col("o")["lex"].alias("cls")).distinct()
    total = new = cut(wanted)
    while not new.isEmpty():
        new = cut(new.join(sub, "cls").select(F.col("low").alias("cls"), "top").distinct().join(total, ["cls", "top"], "left_anti"))
        total = cut(total.union(new))
    typed = quads.where(F.col("p") == RDF + "type").select(F.col("s").alias("node"), F.col("o")["lex"].alias("cls"))
    return typed.join(total, "cls").select("node", F.col("top").alias("class")).distinct()


def validate(data: Dataset, shapes: DataFrame) -> DataFrame:
    """The report's rows; no rows: the data conform."""
    spark = data.spark
    quads = distinct(data.quads.select("s", "p", "o"), data.most)
    parts: list[DataFrame] = []
    show = lambda c: F.when(c["k"] == t.LITERAL, c["lex"]).otherwise(c["lex"])
    for shape in compile_shapes(shapes):
        nodes = spark.createDataFrame([(n,) for n in shape.target_nodes], t.T.StructType([t.T.StructField("node", t.TERM)]))
        if shape.target_classes:
            nodes = nodes.union(_members(quads, shape.target_classes).select("node"))
        nodes = cut(nodes.distinct())
        for path, kind, arg in shape.properties:
            if path is None:
                values = nodes.withColumn("value", F.col("node"))
            else:
                own = quads.where(F.col("p") == path).select(F.col("s").alias("node"), F.col("o").alias("value"))
                values = nodes.join(own, "node", "left")
            there = values.where("value IS NOT NULL")

            def report(rows: DataFrame, message: Column, value: Column | None = None, path=path, kind=kind, shape=shape) -> DataFrame:
                name = SH + kind[0].upper() + kind[1:] + "ConstraintComponent"
                return rows.select(show(F.col("node")).alias("focus_node"), F.lit(path).cast("string").alias("path"), F.lit(shape.name).alias("source_shape"), F.lit(name).alias("source_constraint_component"), F.lit("Violation").alias("severity"), message.alias("message"), (F.lit(None).cast("string") if value is None else value).alias("value"))

            value = show(F.col("value"))
            if kind in ("minCount", "maxCount"):
                n = values.groupBy("node").agg(F.count("value").alias("n"))
                limit = int(arg[1])
                bad = n.where(F.col("n") < limit if kind == "minCount" else F.col("n") > limit)
                parts.append(report(bad, F.format_string(f"%d values, {kind} is {limit}", "n")))
            elif kind == "datatype":
                parts.append(report(there.where(~F.coalesce(t.is_type(F.col("value"), arg[1]), F.lit(False))), F.lit(f"no {arg[1]}"), value))
            elif kind == "nodeKind":
                parts.append(report(there.where(~F.col("value")["k"].isin(*KINDS[arg[1][len(SH) :]])), F.lit(f"no {arg[1][len(SH):]}"), value))
            elif kind == "class":
                members = _members(quads, [arg[1]]).select(F.col("node").alias("value"))
                parts.append(report(there.join(members, "value", "left_anti"), F.lit(f"not of class {arg[1]}"), value))
            elif kind == "hasValue":
                want = spark.createDataFrame([(arg,)], t.T.StructType([t.T.StructField("value", t.TERM)]))
                has = there.join(want, "value", "left_semi").select("node")
                parts.append(report(nodes.join(has, "node", "left_anti"), F.lit(f"lacks the value {arg[1]}")))
            elif kind == "in":
                allowed = spark.createDataFrame([(x,) for x in arg], t.T.StructType([t.T.StructField("value", t.TERM)]))
                parts.append(report(there.join(allowed, "value", "left_anti"), F.lit("not among the allowed values"), value))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], REPORT)


def report_quads(report: DataFrame) -> DataFrame:
    """A report's rows as RDF: one sh:ValidationReport, and a sh:ValidationResult for each row."""
    spark = report.sparkSession
    text = lambda c: t.literal(F.col(c), STRING)
    # Values and focus nodes are reported by their text: an IRI where it reads as one.
    node = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S*$"), t.iri(F.col(c))).otherwise(text(c))
    numbered = cut(report.withColumn("_n", F.monotonically_increasing_id().cast("string")))
    result, whole = t.term(t.BNODE, F.concat(F.lit("result"), F.col("_n"))), t.term(t.BNODE, F.lit("report"))
    parts = [
        (whole, "result", result), (result, RDF + "type", t.iri(SH + "ValidationResult")), (result, "focusNode", node("focus_node")), (result, "resultPath", t.iri(F.col("path"))),
        (result, "sourceShape", node("source_shape")), (result, "sourceConstraintComponent", t.iri(F.col("source_constraint_component"))),
        (result, "resultSeverity", t.iri(F.concat(F.lit(SH), F.col("severity")))), (result, "resultMessage", text("message")), (result, "value", node("value")),
    ]
    needs = {"resultPath": "path", "value": "value"}
    made = [F.when(F.col(needs[p]).isNotNull() if p in needs else F.lit(True), F.struct(s.alias("s"), F.lit(p if p == RDF + "type" else SH + p).alias("p"), o.alias("o"))) for s, p, o in parts]
    rows = numbered.select(F.explode(F.array(*made)).alias("x")).where("x IS NOT NULL").select("x.*")
    conforms = "true" if numbered.where("severity = 'Violation'").isEmpty() else "false"
    head = spark.range(1).select(F.explode(F.array(
        F.struct(whole.alias("s"), F.lit(RDF + "type").alias("p"), t.iri(SH + "ValidationReport").alias("o")),
        F.struct(whole.alias("s"), F.lit(SH + "conforms").alias("p"), t.literal(F.lit(conforms), XSD + "boolean").alias("o")),
    )).alias("x")).select("x.*")
    return head.union(rows).select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
