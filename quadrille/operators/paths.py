"""Property paths: pairs (s, o), with the graph g beside them where a query ranges over graphs.

Closures run semi-naively from the side that is bound, a round per step; each round's new pairs are written to a
checkpoint, so a lost executor loses no round. Pairs of a cycle include a node with itself.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder, which the session has to name in spark.checkpoint.dir.

    A session on one machine, as in tests, may leave it unset and gets a temporary one; any other raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quadrille-"))
    done = df.checkpoint()
    # A checkpoint keeps its plan's constraints, also on columns that it dropped; renaming leaves those behind.
    return done.select(*(F.col(f"`{c}`").alias(c) for c in done.columns))


def normalise(path: tuple, inverse: bool = False) -> tuple:
    """Pushes inversion down to the predicates."""
    match path[0]:
        case "iri":
            return ("inv", path) if inverse else path
        case "inv":
            return normalise(path[1], not inverse)
        case "seq":
            a, b = (normalise(x, inverse) for x in path[1:])
            return ("seq", b, a) if inverse else ("seq", a, b)
        case "alt":
            return ("alt", *(normalise(x, inverse) for x in path[1:]))
        case "neg":
            return ("neg", path[2], path[1]) if inverse else path
    return (path[0], normalise(path[1], inverse))


class Paths:
    """scan(predicate) gives rows (keys..., s term, p, o term) of the active graph; keys is ["g"] or [].

    An end that is a variable may have a place, (predicate, "s" or "o"): it is all that is wanted of this end, so pairs outside
    may be left out. What has such a place is a node of the graph.
    """

    def __init__(self, spark, scan, keys: list[str]):
        self.spark, self.scan, self.keys = spark, scan, keys
        self.cols = [*keys, "s", "o"]

    def nodes(self, extra: list[Column]) -> DataFrame:
        q = self.scan(None)
        found = q.select(*self.keys, F.col("s").alias("n")).union(q.select(*self.keys, F.col("o").alias("n")))
        for c in extra:
            if not self.keys:
                found = found.union(q.sparkSession.range(1).select(c.alias("n")))
            else:
                found = found.union(q.select(*self.keys).distinct().select(*self.keys, c.alias("n")))
        return found.distinct()

    def identity(self, s: Column | None, o: Column | None, at: tuple[str, str] | None = None) -> DataFrame:
        fixed = [c for c in (s, o) if c is not None]
        if fixed and not self.keys:
            # A bound end meets itself, whether it is a node of the graph or not; no quad needs to be read.
            one = self.spark.range(1).select(fixed[0].alias("s"), fixed[-1].alias("o"))
            return one.where("s = o")
        if at is not None and not fixed:
            # The nodes of this place and no others are wanted, so no other quads are read.
            n = F.col(at[1])
            return self.scan(at[0]).select(*self.keys, n.alias("s"), n.alias("o")).distinct()
        return self.nodes(fixed).select(*self.keys, F.col("n").alias("s"), F.col("n").alias("o"))

    def pairs(self, path: tuple, s: Column | None = None, o: Column | None = None, at_s: tuple[str, str] | None = None, at_o: tuple[str, str] | None = None) -> DataFrame:
        """s, o: constant ends, which seed closures; at_s, at_o: the places of the others."""
        match path[0]:
            case "iri":
                out = self.scan(path[1]).select(*self.cols)
            case "inv":
                out = self.pairs(path[1], o, s, at_o, at_s).select(*self.keys, F.col("o").alias("s"), F.col("s").alias("o"))
            case "seq":
                a = self.pairs(path[1], s, None, at_s).select(*self.keys, "s", F.col("o").alias("m"))
                b = self.pairs(path[2], None, o, None, at_o).select(*self.keys, F.col("s").alias("m"), "o")
                out = a.join(b, [*self.keys, "m"]).select(*self.cols).distinct()
            case "alt":
                out = self.pairs(path[1], s, o, at_s, at_o).union(self.pairs(path[2], s, o, at_s, at_o)).distinct()
            case "opt":
                out = self.pairs(path[1], s, o, at_s, at_o).union(self.identity(s, o, at_s or at_o)).distinct()
            case "plus":
                out = self.closure(self.pairs(path[1]), s, o)
            case "star":
                out = self.closure(self.pairs(path[1]), s, o).union(self.identity(s, o, at_s or at_o)).distinct()
            case "neg":
                # Subjects that have to be subjects of a predicate tell which quads to read.
                near = lambda at: self.scan(None, like=at[0]) if at is not None and at[1] == "s" else self.scan(None)
                out = near(at_s).where(~F.col("p").isin(*path[1])).select(*self.cols) if path[1] or not path[2] else None
                if path[2]:
                    back = near(at_o).where(~F.col("p").isin(*path[2])).select(*self.keys, F.col("o").alias("s"), F.col("s").alias("o"))
                    out = back if out is None else out.union(back)
                out = out.distinct()
            case _:
                raise ValueError(f"unknown path {path[0]}")
        if s is not None:
            out = out.where(F.col("s") == s)
        if o is not None:
            out = out.where(F.col("o") == o)
        return out

    def closure(self, edges: DataFrame, s: Column | None, o: Column | None) -> DataFrame:
        edges = cut(edges.select(*self.cols).distinct())
        if s is None and o is not None:  # from the bound end backwards
            swap = [*self.keys, F.col("o").alias("s"), F.col("s").alias("o")]
            return self.closure(edges.select(*swap), o, None).select(*swap)
        step = edges.select(*self.keys, F.col("s").alias("m"), F.col("o").alias("n"))
        total = delta = edges if s is None else edges.where(F.col("s") == s)
        rounds = 0
        while not delta.isEmpty():
            found = delta.withColumnRenamed("o", "m").join(step, [*self.keys, "m"])
            found = found.select(*self.keys, "s", F.col("n").alias("o")).distinct()
            # What is known is the union of the rounds' own checkpoints: each pair is written once.
            delta = cut(found.join(total, self.cols, "left_anti"))
            total = total.union(delta)
            rounds += 1
            if rounds % 50 == 0:
                total = cut(total)  # keeps the plan of long chains small
        return total
