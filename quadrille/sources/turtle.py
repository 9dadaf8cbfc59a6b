"""Turtle and TriG on the driver, for files of moderate size; N-Triples and N-Quads are the formats for large data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions import terms as t
from ..plans.sparql import Parser


class _Turtle(Parser):
    def quads_of_document(self) -> list:
        out: list = []
        while self.kind() != "end":
            if self.peek() in ("@prefix", "@base") or self.is_word("PREFIX", "BASE", "VERSION"):
                directive = self.next().lower().lstrip("@")
                if directive == "prefix":
                    name = self.next()
                    self.prefixes[name[:-1]] = self.resolve(self.next()[1:-1])
                elif directive == "base":
                    self.base = self.resolve(self.next()[1:-1])
                else:
                    self.string()
                self.take(".")
            elif self.peek() == "{":
                out += self.block(None)
            elif self.is_word("GRAPH"):
                self.next()
                out += self.block(self.term([]))
            else:
                triples: list = []
                alone = self.peek() in ("[", "<<")
                subject = self.term(triples)
                if self.peek() == "{":
                    out += self.block(subject)
                    continue
                if not (alone and self.peek() == "."):
                    self.property_list(subject, triples)
                self.need(".")
                out += [(None, *x) for x in triples]
        return out

    def block(self, graph: tuple | None) -> list:
        self.need("{")
        triples = self.triples_block()
        self.need("}")
        return [(graph, *x) for x in triples]


def parse(text: str, base: str | None = None, rename_blank_nodes: bool = True) -> list[tuple]:
    """Quads as plan terms: (graph or None, s, p, o); blank nodes are ("bnode", label)."""
    scope = uuid.uuid4().hex[:8] + "_" if rename_blank_nodes else ""

    def own(x: tuple | None) -> tuple | None:
        if x is None:
            return None
        if x[0] == "var":
            return ("bnode", scope + x[1].removeprefix("_:"))
        return ("triple", *(own(y) for y in x[1:])) if x[0] == "triple" else x

    return [tuple(own(x) for x in q) for q in _Turtle(text, base).quads_of_document()]


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Quads of a Turtle or TriG file, read whole."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).toLocalIterator())
    return frame(spark, parse(text, **options))


def frame(spark: SparkSession, quads: list[tuple]) -> DataFrame:
    rows = [(g[1] if g else None, t.as_row(s), p[1], t.as_row(o)) for g, s, p, o in quads]
    return spark.createDataFrame(rows, t.QUAD)
