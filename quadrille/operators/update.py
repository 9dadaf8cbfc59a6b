"""SPARQL Update: each operation makes a new version of the quads; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..plans import algebra as A
from ..plans.compiler import Options, PatternCompiler
from ..plans.engine import instantiate
from ..sources.dataset import Dataset, distinct
from .paths import cut


class UpdateError(RuntimeError):
    """An operation that is not SILENT failed."""


def union_distinct(quads: DataFrame, more: DataFrame, most: int | None = None) -> DataFrame:
    """most: no more quads than this in both, if known."""
    return distinct(quads.select("g", "s", "p", "o").union(more.select("g", "s", "p", "o")), most)


def without(quads: DataFrame, gone: DataFrame) -> DataFrame:
    q, d = quads.alias("q"), gone.dropDuplicates().alias("d")
    same = F.col("q.g").eqNullSafe(F.col("d.g")) & (F.col("q.s") == F.col("d.s")) & (F.col("q.p") == F.col("d.p")) & (F.col("q.o") == F.col("d.o"))
    return q.join(d, same, "left_anti")


def apply(dataset: Dataset, updates: list[A.Update], options: Options | None = None, load=None) -> Dataset:
    """Runs operations in order; load(iri) -> quads DataFrame serves LOAD."""
    for u in updates:
        try:
            dataset = one(dataset, u, options or Options(), load)
        except Exception:
            if not u.silent:
                raise
    return dataset


def one(ds: Dataset, u: A.Update, options: Options, load) -> Dataset:
    graphs, most = ds.graphs, ds.most
    spark = ds.spark
    compiler = PatternCompiler(ds, options, u.default_graphs, u.named_graphs)
    match u.kind:
        case "insert_data":
            most = None if most is None else most + len(u.inserts)
            return Dataset(union_distinct(ds.quads, instantiate(compiler.one(), u.inserts), most), graphs | {q[0][1] for q in u.inserts if q[0]}, most)
        case "delete_data":
            return Dataset(without(ds.quads, instantiate(compiler.one(), u.deletes)), graphs, most)
        case "modify":
            rel = compiler.compile(u.pattern)
            rel.df = cut(rel.df)  # evaluated in full, once, before anything changes
            quads = ds.quads
            if u.deletes:
                # Blank nodes of a delete template are variables of their pattern.
                quads = without(quads, instantiate(rel, u.deletes))
            if u.inserts:
                most = None if most is None else most + rel.df.count() * len(u.inserts)
                quads = union_distinct(quads, instantiate(rel, u.inserts), most)
            return Dataset(cut(quads), graphs, most)
        case "load":
            if load is None:
                raise UpdateError(f"nothing can load {u.source}")
            graph = u.target[1] if u.target[0] == "graph" else None
            more = load(u.source).withColumn("g", F.lit(graph).cast("string"))
            return Dataset(union_distinct(ds.quads, more), graphs | ({graph} if graph else set()))
        case "create":
            if u.target[1] in graphs and not u.silent:
                return ds
            return Dataset(ds.quads, graphs | {u.target[1]}, most)
        case "clear" | "drop":
            kind = u.target[0]
            if kind == "default":
                return Dataset(ds.quads.where("g IS NOT NULL"), graphs, most)
            if kind == "named":
                return Dataset(ds.quads.where("g IS NULL"), graphs if u.kind == "clear" else frozenset(), most)
            if kind == "all":
                return Dataset(ds.quads.where(F.lit(False)), graphs if u.kind == "clear" else frozenset(), most)
            g = u.target[1]
            if not u.silent and g not in graphs and ds.quads.where(F.col("g") == g).isEmpty():
                raise UpdateError(f"no graph {g}")
            return Dataset(ds.quads.where(F.col("g").isNull() | (F.col("g") != g)), graphs if u.kind == "clear" else graphs - {g}, most)
    raise UpdateError(f"unknown operation {u.kind}")
