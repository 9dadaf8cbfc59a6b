"""The store: quads in memory as a DataFrame, or in Parquet partitioned by predicate."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as t
from .operators import fulltext, reasoning, shacl
from .operators import update as updates
from .operators.paths import cut
from .plans import cypher as cypher_text
from .plans.compiler import Options
from .plans.engine import Result, run, run_parsed
from .plans.sparql import parse_update
from .sources import formats, turtle
from .sources.dataset import Dataset, empty_quads


class Store:
    """Mirrors a quad store's interface; every change makes a new version of the quads."""

    def __init__(self, spark: SparkSession, path: str | None = None, reasoning: bool = False, names: cypher_text.Names | None = None):
        self.spark, self.path, self.reasoning, self.names = spark, path, reasoning, names
        self.dataset = Dataset(empty_quads(spark))
        self._inferred: Dataset | None = None
        if path:
            try:
                self.dataset = Dataset(spark.read.schema(t.QUAD).parquet(path))
            except Exception as e:  # no such path yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise

    @classmethod
    def over(cls, dataset: Dataset, **options) -> Store:
        """A store that starts from the quads of a dataset."""
        store = cls(dataset.spark, **options)
        store.dataset = dataset
        return store

    def _set(self, dataset: Dataset) -> None:
        self.dataset, self._inferred = Dataset(cut(dataset.quads), dataset.graphs, dataset.most), None

    def view(self) -> Dataset:
        if not self.reasoning:
            return self.dataset
        if self._inferred is None:
            self._inferred = reasoning.with_same_as(reasoning.with_inferences(self.dataset))
        return self._inferred

    def query(self, text: str, options: Options | None = None, **kw) -> Result:
        return run(self.view(), text, options, **kw)

    def update(self, text: str, options: Options | None = None, base: str | None = None) -> None:
        self._set(updates.apply(self.dataset, parse_update(text, base), options, self.read))

    def cypher(self, text: str, options: Options | None = None) -> Result:
        return run_parsed(self.view(), cypher_text.parse_query(text, self.names), options)

    def cypher_update(self, text: str) -> None:
        self._set(updates.apply(self.dataset, cypher_text.parse_update(text, self.names)))

    def validate(self, shapes: DataFrame) -> DataFrame:
        return shacl.validate(self.view(), shapes)

    def diagnostics(self) -> DataFrame:
        return reasoning.violations(self.dataset)

    def text_search(self, query: str, predicate: str | None = None, limit: int | None = None) -> DataFrame:
        return fulltext.search(self.dataset.quads, query, predicate, limit)

    # -- single quads; a quad is (s, p, o[, graph]) of plan terms

    def add(self, quad: tuple) -> None:
        self.extend([quad])

    def extend(self, quads: Iterable[tuple]) -> None:
        rows = [(q[3] if len(q) > 3 else None, *q[:3]) for q in quads]
        self._set(Dataset(updates.union_distinct(self.dataset.quads, turtle.frame(self.spark, rows)), self.dataset.graphs | {r[0][1] for r in rows if r[0]}))

    bulk_extend = extend

    def remove(self, quad: tuple) -> None:
        row = (quad[3] if len(quad) > 3 else None, *quad[:3])
        self._set(Dataset(updates.without(self.dataset.quads, turtle.frame(self.spark, [row])), self.dataset.graphs))

    def contains(self, quad: tuple) -> bool:
        return not self.quads_for_pattern(*quad[:3], quad[3] if len(quad) > 3 else ("default",)).isEmpty()

    def quads_for_pattern(self, s: tuple | None = None, p: tuple | None = None, o: tuple | None = None, graph: tuple | None = None) -> DataFrame:
        """graph: None for any, ("default",) or an IRI."""
        q = self.dataset.quads if p is None else self.dataset.scan(p[1])
        for c, x in (("s", s), ("o", o)):
            if x is not None:
                q = q.where(F.col(c).eqNullSafe(t.constant(x)))
        if graph is not None:
            q = q.where("g IS NULL") if graph[0] == "default" else q.where(F.col("g") == graph[1])
        return q

    def __len__(self) -> int:
        return self.dataset.quads.count()

    def is_empty(self) -> bool:
        return self.dataset.quads.isEmpty()

    # -- graphs

    def named_graphs(self) -> DataFrame:
        return self.dataset.graph_names()

    def contains_named_graph(self, iri: str) -> bool:
        return not self.named_graphs().where(F.col("g") == iri).isEmpty()

    def add_graph(self, iri: str) -> None:
        self.dataset = Dataset(self.dataset.quads, self.dataset.graphs | {iri})

    def clear_graph(self, iri: str | None) -> None:
        self.update(f"CLEAR SILENT GRAPH <{iri}>" if iri else "CLEAR DEFAULT")

    def remove_graph(self, iri: str) -> None:
        self.update(f"DROP SILENT GRAPH <{iri}>")

    def clear(self) -> None:
        self.update("CLEAR ALL")

    def describe_data_model(self) -> dict:
        q = self.dataset.quads
        from .plans.algebra import RDF

        classes = q.where(F.col("p") == RDF + "type").select(F.col("o")["lex"].alias("c")).distinct()
        return {"triple_count": len(self), "named_graphs": [r[0] for r in self.named_graphs().collect()], "predicates": sorted(r[0] for r in q.select("p").distinct().collect()), "classes": sorted(r[0] for r in classes.collect())}

    # -- files

    def read(self, path: str, form: str | None = None, **options) -> DataFrame:
        return formats.read(self.spark, path, form, **options)

    def load(self, path: str | list[str], form: str | None = None, graph: str | None = None, lenient: bool = False) -> None:
        """Loads one file or many; all of them are read together and added in one step."""
        paths = [path] if isinstance(path, str) else path
        more = reduce(DataFrame.union, [self.read(one, form, graph=graph, lenient=lenient) for one in paths])
        self._set(Dataset(updates.union_distinct(self.dataset.quads, more), self.dataset.graphs | ({graph} if graph else set())))

    bulk_load = load

    def dump(self, path: str, graph: str | None = None, form: str | None = None) -> None:
        """The whole store in a dataset format, N-Quads by default, or one graph ("default" or an IRI) as triples."""
        if graph is None:
            formats.write(self.dataset.quads, path, form or "nquads")
        else:
            formats.write(self.graph(graph), path, form or "ntriples")

    # -- the graph store protocol's operations, for a graph IRI or None, the default graph

    def graph(self, iri: str | None = None) -> DataFrame:
        """GET: the triples of a graph."""
        q = self.dataset.quads
        return q.where("g IS NULL" if iri in (None, "default") else F.col("g") == iri).select("s", "p", "o")

    def put(self, triples: DataFrame, iri: str | None = None) -> None:
        """PUT: the triples replace those of the graph."""
        rest = self.dataset.quads.where("g IS NOT NULL" if iri is None else F.col("g").isNull() | (F.col("g") != iri))
        self._set(Dataset(updates.union_distinct(rest, self._placed(triples, iri)), self.dataset.graphs | ({iri} if iri else set())))

    def post(self, triples: DataFrame, iri: str | None = None) -> None:
        """POST: the triples are added to the graph."""
        self._set(Dataset(updates.union_distinct(self.dataset.quads, self._placed(triples, iri)), self.dataset.graphs | ({iri} if iri else set())))

    def delete(self, iri: str | None = None) -> None:
        """DELETE: the graph goes; a graph that is not there is an error."""
        self.update(f"DROP GRAPH <{iri}>" if iri else "DROP DEFAULT")

    @staticmethod
    def _placed(triples: DataFrame, iri: str | None) -> DataFrame:
        return triples.select(F.lit(iri).cast("string").alias("g"), "s", "p", "o")

    def flush(self, path: str | None = None) -> None:
        """Writes the quads as Parquet, sorted by subject within files, and goes on from there."""
        target = path or self.path
        if not target:
            raise ValueError("a store in memory needs a path")
        # A version is written beside the old one first: its files may be what the quads are read from.
        fresh = f"{target}.{uuid.uuid4().hex}"
        ordered = self.dataset.quads.repartition("p").sortWithinPartitions("p", "s")
        ordered.write.parquet(fresh)
        self.spark.read.schema(t.QUAD).parquet(fresh).write.mode("overwrite").parquet(target)
        self.dataset = Dataset(self.spark.read.schema(t.QUAD).parquet(target), self.dataset.graphs)

    optimize = flush

    def backup(self, path: str) -> None:
        """Quads and the names of registered graphs, which may be empty, side by side."""
        self.dataset.quads.write.parquet(f"{path}/quads")
        self.spark.createDataFrame([(g,) for g in sorted(self.dataset.graphs)], "g string").write.parquet(f"{path}/graphs")

    @classmethod
    def restore(cls, spark: SparkSession, path: str, **options) -> Store:
        names = frozenset(r[0] for r in spark.read.parquet(f"{path}/graphs").collect())
        return cls.over(Dataset(spark.read.schema(t.QUAD).parquet(f"{path}/quads"), names), **options)
