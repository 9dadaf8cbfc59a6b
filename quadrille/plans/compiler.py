"""Algebra to DataFrames.

A relation has one term column per variable; a null is unbound. The compiler tracks which variables are surely bound, so
that joins are plain equi-joins wherever that is so; where a shared variable may be unbound, the side that may lack it is
split into its bound and unbound rows, which keeps the bulk an equi-join.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.expressions import Compiler, Context, Value
from ..operators.aggregates import aggregate
from ..operators.paths import Paths, cut, normalise
from ..sources.dataset import Dataset
from . import algebra as A
from .correlate import Correlation, sees_outer


@dataclass
class Rel:
    df: DataFrame
    names: list[str]
    bound: set[str]

    def col(self, name: str) -> Column:
        return F.col(f"`{name}`")


class ServiceError(RuntimeError):
    pass


@dataclass
class Options:
    union_default_graph: bool = False
    unbound_last: bool = False
    max_results: int | None = None
    service: Callable | None = None
    functions: dict[str, Callable] = field(default_factory=dict)
    aggregates: dict[str, Callable] = field(default_factory=dict)


def _expressions(e) -> list:
    """Variables that an expression names, EXISTS patterns included."""
    out: list[str] = []
    if isinstance(e, tuple):
        if len(e) == 2 and e[0] == "var" and isinstance(e[1], str):
            return [e[1]]
        if e and e[0] == "exists":
            return A.variables(e[1])
        for x in e:
            out += _expressions(x)
    return out


def _find_exists(e) -> list:
    if isinstance(e, tuple):
        if e and e[0] == "exists" and isinstance(e[1], A.Node):
            return [e]
        return [y for x in e for y in _find_exists(x)]
    return []


def _volatile(e) -> bool:
    """Does an expression give another value each time, or call what may?"""
    if isinstance(e, tuple):
        if len(e) > 1 and (e[0] == "fn" or e[0] == "call" and e[1] in ("RAND", "UUID", "STRUUID", "BNODE", "NOW")):
            return True
        return any(_volatile(x) for x in e)
    return isinstance(e, list) and any(_volatile(x) for x in e)


def conjuncts(e: tuple) -> list[tuple]:
    return [*conjuncts(e[1]), *conjuncts(e[2])] if e[0] == "and" else [e]


class PatternCompiler:
    def __init__(self, dataset: Dataset, options: Options | None = None, default_graphs: list | None = None, named_graphs: list | None = None, base: str | None = None):
        self.dataset, self.options = dataset, options or Options()
        self.spark = dataset.spark
        self.default_graphs, self.named_graphs = default_graphs, named_graphs
        if default_graphs is None and named_graphs is not None:
            self.default_graphs = []
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.context = Context(base, now, self.options.functions)
        self.graph: tuple | None = None
        self.correlation = Correlation(self)

    # -- scans

    def quads(self, predicate: str | None, subject: str | None = None, like: str | None = None) -> DataFrame:
        """Rows of the active graph: (g, s, p, o) under GRAPH ?g, else (s, p, o); subject: all that is wanted, if known;
        like: a predicate whose subjects are all that is wanted."""
        q = self.dataset.scan(predicate, subject, like)
        if self.graph is None:
            if self.default_graphs is not None:
                q = q.where(F.col("g").isin(*self.default_graphs)) if self.default_graphs else q.where(F.lit(False))
                return q.select("s", "p", "o").dropDuplicates() if len(self.default_graphs) > 1 else q.select("s", "p", "o")
            if self.options.union_default_graph:
                return q.select("s", "p", "o").dropDuplicates()
            return q.where("g IS NULL").select("s", "p", "o")
        if self.graph[0] == "iri":
            if self.named_graphs is not None and self.graph[1] not in self.named_graphs:
                return q.where(F.lit(False)).select("s", "p", "o")
            return q.where(F.col("g") == self.graph[1]).select("s", "p", "o")
        q = q.where("g IS NOT NULL")
        if self.named_graphs is not None:
            q = q.where(F.col("g").isin(*self.named_graphs))
        return q.select("g", "s", "p", "o")

    def one(self) -> Rel:
        return Rel(self.spark.range(1).select(), [], set())

    @staticmethod
    def equals(c: Column, x: tuple) -> Column:
        want = t.constant(x)
        return (c["k"] == want["k"]) & (c["lex"] == want["lex"]) & c["dt"].eqNullSafe(want["dt"]) & c["lang"].eqNullSafe(want["lang"]) & c["dir"].eqNullSafe(want["dir"])

    def triple(self, pattern: tuple) -> Rel:
        s, p, o = pattern
        predicate = p[1] if p[0] == "iri" else None
        q = self.quads(predicate, s[1] if s[0] == "iri" else None)
        extra: list[tuple[Column, tuple]] = []
        cols: dict[str, Column] = {}
        places = [(F.col("s"), s), (t.iri(F.col("p")), p), (F.col("o"), o)]
        if self.graph and self.graph[0] == "var":
            places.append((t.iri(F.col("g")), self.graph))
        while places:
            c, x = places.pop(0)
            if x[0] == "var":
                if x[1] in cols:
                    q = q.where(cols[x[1]] == c)
                else:
                    cols[x[1]] = c
            elif x is p and predicate is not None:
                continue
            elif x[0] == "triple" and _expressions(x):
                extra.append((c, x))
            else:
                q = q.where(self.equals(c, x))
        if not extra:
            return Rel(q.select(*(c.alias(n) for n, c in cols.items())), list(cols), set(cols))
        for i, (c, x) in enumerate(extra):
            q = q.withColumn(f"__q{i}", t.triple_parts(c)).where(f"__q{i} IS NOT NULL")
        rel_cols = dict(cols)
        checks = []
        todo = [(F.col(f"__q{i}")[n], y) for i, (_, x) in enumerate(extra) for n, y in zip("spo", x[1:], strict=True)]
        while todo:
            c, x = todo.pop(0)
            if x[0] == "var":
                if x[1] in rel_cols:
                    checks.append(rel_cols[x[1]] == c)
                else:
                    rel_cols[x[1]] = c
            elif x[0] == "triple" and _expressions(x):
                inner = t.triple_parts(c)
                todo += [(inner[n], y) for n, y in zip("spo", x[1:], strict=True)]
                checks.append(inner.isNotNull())
            else:
                checks.append(self.equals(c, x))
        for check in checks:
            q = q.where(check)
        return Rel(q.select(*(c.alias(n) for n, c in rel_cols.items())), list(rel_cols), set(rel_cols))

    def estimate(self, tr: tuple) -> tuple[float, dict[str, float]]:
        """Estimated rows of a pattern and distinct values of its variables."""
        s, p, o = tr
        size = self.dataset.size(p[1] if p[0] == "iri" else None)
        rows = float(size.rows)
        for x, distinct in ((s, size.subjects), (o, size.objects)):
            if x[0] != "var":
                rows /= max(1, distinct)
        rows = max(rows, 0.1)
        return rows, {x[1]: max(1.0, min(rows, d)) for x, d in ((p, 50), (o, size.objects), (s, size.subjects)) if x[0] == "var"}

    def ordered(self, triples: list[tuple]) -> list[tuple]:
        """The join order of least estimated intermediate rows, by dynamic programming over sets of patterns."""
        if len(triples) < 3:
            return sorted(triples, key=lambda tr: (sum(x[0] == "var" for x in tr), tr[1][0] == "var"))
        stats = [(self.estimate(tr), set(_expressions(tr))) for tr in triples]
        best: dict[int, tuple[float, float, dict[str, float], tuple[int, ...]]] = {1 << i: (e[0], e[0], e[1], (i,)) for i, (e, _) in enumerate(stats)}
        for _ in range(len(triples) - 1):
            grown: dict[int, tuple[float, float, dict[str, float], tuple[int, ...]]] = {}
            for have, (cost, rows, distinct, order) in best.items():
                known = set().union(*(stats[i][1] for i in order))
                rest = [i for i in range(len(triples)) if not have >> i & 1]
                # A pattern that shares a variable comes before one that does not.
                for i in [i for i in rest if stats[i][1] & known] or rest:
                    (r, d), names = stats[i]
                    out = rows * r
                    for n in names & known:
                        out /= max(distinct.get(n, 1.0), d.get(n, 1.0))
                    merged = {n: max(1.0, min(out, distinct.get(n, math.inf), d.get(n, math.inf))) for n in {*distinct, *d}}
                    state = (cost + out, out, merged, (*order, i))
                    if (now := grown.get(have | 1 << i)) is None or state[0] < now[0]:
                        grown[have | 1 << i] = state
            # Of very many patterns only the cheapest beginnings are carried on.
            best = dict(sorted(grown.items(), key=lambda kv: kv[1][0])[:2000])
        return [triples[i] for i in min(best.values(), key=lambda v: v[0])[3]]

    def star(self, triples: list[tuple]) -> Rel | None:
        """Patterns of one subject variable read side by side in one scan, where the dataset can."""
        if self.default_graphs is not None or (self.graph is None and self.options.union_default_graph) or self.graph and self.graph[0] == "var":
            return None
        if len(triples) < 2 or any(tr[1][0] != "iri" or tr[2][0] == "triple" for tr in triples):
            return None
        q = self.dataset.star([tr[1][1] for tr in triples])
        if q is None:
            return None
        if self.graph and self.named_graphs is not None and self.graph[1] not in self.named_graphs:
            q = q.where(F.lit(False))
        q = q.where("g IS NULL") if self.graph is None else q.where(F.col("g") == self.graph[1])
        cols = {triples[0][0][1]: F.col("s")}
        for i, (_, _, o) in enumerate(triples):
            c = F.col(f"o{i}")
            if o[0] != "var":
                q = q.where(self.equals(c, o))
            elif o[1] in cols:
                q = q.where(cols[o[1]] == c)
            else:
                cols[o[1]] = c
        return Rel(q.select(*(c.alias(n) for n, c in cols.items())), list(cols), set(cols))

    def bgp(self, node: A.Bgp) -> Rel:
        left = self.ordered(list(dict.fromkeys(node.triples)))
        if not left:
            return self.graph_unit()
        rel: Rel | None = None
        while left:
            first = left[0]
            group = [tr for tr in left if tr[0] == first[0]] if first[0][0] == "var" else []
            # The largest part of the star around this subject that one scan gives.
            made = None
            while len(group) > 1 and (made := self.star(group)) is None:
                group.pop()
            if made is None:
                group, made = [first], self.triple(first)
            left = [tr for tr in left if tr not in group]
            rel = made if rel is None else self.join(rel, made)
        return rel

    def graph_unit(self) -> Rel:
        if self.graph and self.graph[0] == "var":
            names = self.dataset.graph_names()
            if self.named_graphs is not None:
                names = names.where(F.col("g").isin(*self.named_graphs))
            return Rel(names.select(t.iri(F.col("g")).alias(self.graph[1])), [self.graph[1]], {self.graph[1]})
        return self.one()

    def joined(self, node: A.Node, places: dict[str, list[tuple[str, str]]] | None = None) -> Rel:
        """A tree of joins. Its paths are told where the patterns beside them have the variables: as a path's pairs are joined
        with those, pairs outside of these places need not be made."""
        if places is None:
            places = {}
            for leaf in self.leaves(node):
                if isinstance(leaf, A.Bgp):
                    for s, p, o in leaf.triples:
                        for x, place in ((s, "s"), (o, "o")):
                            if x[0] == "var" and p[0] == "iri":
                                places.setdefault(x[1], []).append((p[1], place))
        if isinstance(node, A.Join):
            return self.join(self.joined(node.left, places), self.joined(node.right, places))
        return self.path(node, places) if isinstance(node, A.Path) else self.compile(node)

    def leaves(self, node: A.Node) -> list[A.Node]:
        return [*self.leaves(node.left), *self.leaves(node.right)] if isinstance(node, A.Join) else [node]

    def path(self, node: A.Path, places: dict[str, list[tuple[str, str]]] | None = None) -> Rel:
        keys = ["g"] if self.graph and self.graph[0] == "var" else []
        ends = [None if x[0] == "var" else t.constant(x) for x in (node.s, node.o)]
        # As a subject a variable is confined the most: objects of a predicate may be many that have none of their own.
        found = [sorted((places or {}).get(x[1], []), key=lambda at: at[1] != "s") if x[0] == "var" else [] for x in (node.s, node.o)]
        pairs = Paths(self.spark, self.quads, keys).pairs(normalise(node.path), *ends, *(x[0] if x else None for x in found))
        cols: dict[str, Column] = {}
        if keys:
            cols[self.graph[1]] = t.iri(F.col("g"))
        for c, x in ((F.col("s"), node.s), (F.col("o"), node.o)):
            if x[0] == "var":
                if x[1] in cols:
                    pairs = pairs.where(cols[x[1]] == c)
                else:
                    cols[x[1]] = c
        return Rel(pairs.select(*(c.alias(n) for n, c in cols.items())), list(cols), set(cols))

    # -- joins

    @staticmethod
    def split(rel: Rel, names: list[str]) -> list[tuple[Rel, set[str]]]:
        """The rows by which of the names are unbound: (rows, unbound names)."""
        if not names:
            return [(rel, set())]
        out = []
        for flags in product((True, False), repeat=len(names)):
            missing = {n for n, f in zip(names, flags, strict=True) if not f}
            df = rel.df
            for n in names:
                df = df.where(rel.col(n).isNull() if n in missing else rel.col(n).isNotNull())
            out.append((Rel(df, rel.names, rel.bound), missing))
        return out

    def join(self, left: Rel, right: Rel) -> Rel:
        shared = [n for n in left.names if n in right.names]
        names = left.names + [n for n in right.names if n not in left.names]
        bound = left.bound | right.bound
        if all(n in left.bound and n in right.bound for n in shared):
            df = left.df.join(right.df, shared) if shared else left.df.crossJoin(right.df)
            return Rel(df.select(*(F.col(f"`{n}`") for n in names)), names, bound)
        parts = []
        for a, gone_a in self.split(left, [n for n in shared if n not in left.bound]):
            for b, gone_b in self.split(right, [n for n in shared if n not in right.bound]):
                keys = [n for n in shared if n not in gone_a and n not in gone_b]
                x, y = a.df, b.df
                for n in shared:
                    if n in keys:
                        continue
                    if n in gone_a:
                        x = x.drop(n)
                    elif n in gone_b:
                        y = y.drop(n)
                    if n in gone_a and n in gone_b:
                        pass
                df = x.join(y, keys) if keys else x.crossJoin(y)
                parts.append(df.select(*(F.col(f"`{n}`") for n in names)))
        return Rel(reduce(DataFrame.union, parts), names, bound)

    def _condition(self, left: Rel, right: Rel, extra: Column | None, marker: str) -> tuple[DataFrame, Column, list[str]]:
        """Right side renamed for a join, with the compatibility condition."""
        shared = [n for n in left.names if n in right.names]
        renamed = right.df.select(*(right.col(n).alias(f"{marker}{n}") for n in right.names))
        condition = F.lit(True)
        for n in shared:
            l, r = F.col(f"`{n}`"), F.col(f"`{marker}{n}`")
            c = l == r
            if n not in left.bound:
                c = c | l.isNull()
            if n not in right.bound:
                c = c | r.isNull()
            condition = condition & c
        return renamed, condition if extra is None else condition & extra, shared

    def merged(self, left: Rel, right: Rel, marker: str) -> dict[str, Column]:
        cols = {n: F.col(f"`{n}`") for n in left.names}
        for n in right.names:
            r = F.col(f"`{marker}{n}`")
            cols[n] = r if n not in cols else (cols[n] if n in left.bound else F.coalesce(cols[n], r))
        return cols

    def left_join(self, left: Rel, right: Rel, condition: tuple | None) -> Rel:
        shared = [n for n in left.names if n in right.names]
        if (condition is not None and _find_exists(condition)) or not all(n in right.bound for n in shared):
            # Where the right side may lack a shared variable, or the condition looks further: join, then add what found nothing.
            rows, row = self.correlation.number(left)
            matched = self.join(rows, right)
            if condition is not None:
                matched = self.filter(matched, condition)
            return self.correlation.otherwise(rows, matched, row)
        m = "__r_"
        cols = self.merged(left, right, m)
        names = list(cols)
        parts = []
        maybe = [n for n in shared if n not in left.bound]
        for part, gone in self.split(left, maybe):
            # Within a part each shared variable is bound, or unbound, on all rows.
            own = Rel(part.df, left.names, left.bound | (set(maybe) - gone))
            extra = None if condition is None else Compiler(self.merged(own, right, m), self.context, {}).value(condition).bool()
            renamed, on, _ = self._condition(Rel(own.df, [n for n in own.names if n not in gone], own.bound), right, extra, m)
            df = own.df.join(renamed, on, "left")
            parts.append(df.select(*(c.alias(n) for n, c in cols.items())))
        return Rel(reduce(DataFrame.union, parts), names, set(left.bound))

    def minus(self, left: Rel, right: Rel) -> Rel:
        shared = [n for n in left.names if n in right.names]
        if not shared:
            return left
        removed = []
        for b, gone_b in self.split(right, [n for n in shared if n not in right.bound]):
            removed.append((b.df, gone_b))
        parts = []
        for a, gone_a in self.split(left, [n for n in shared if n not in left.bound]):
            df = a.df
            for rows, gone_b in removed:
                # Rows that share no bound variable with the left ones remove nothing.
                if keys := [n for n in shared if n not in gone_a and n not in gone_b]:
                    df = df.join(rows.select(*(F.col(f"`{n}`") for n in keys)).distinct(), keys, "left_anti")
            parts.append(df.select(*(left.col(n) for n in left.names)))
        return Rel(reduce(DataFrame.union, parts), left.names, left.bound)

    def semi(self, left: Rel, pattern: A.Node, keep: bool) -> Rel:
        """Rows with (keep) or without a compatible solution of the pattern, whose parts see the row's variables."""
        whole, conditions = pattern, []
        while isinstance(pattern, A.Filter) and not _find_exists(pattern.condition) and not set(_expressions(pattern.condition)) <= set(A.variables(pattern.child)):
            conditions.append(pattern.condition)
            pattern = pattern.child
        if sees_outer(pattern, set(left.names)):
            return self.correlation.matching(left, whole, keep)
        right = self.compile(pattern)
        how = "left_semi" if keep else "left_anti"
        shared = [n for n in left.names if n in right.names]
        if not conditions and all(n in left.bound and n in right.bound for n in shared):
            if not shared:
                # One look decides for all rows.
                found = right.df.limit(1).select(F.lit(1).alias("__one"))
                return Rel(left.df.join(found, F.lit(True), how), left.names, left.bound)
            return Rel(left.df.join(right.df.select(*(right.col(n) for n in shared)), shared, how), left.names, left.bound)
        if not conditions:
            return self.correlation.matching(left, whole, keep)
        parts = [c for e in conditions for c in conjuncts(e)]
        if all(n in left.bound and n in right.bound for n in shared):
            # What the right side alone decides is decided there.
            for c in [c for c in parts if set(_expressions(c)) <= set(right.names)]:
                right = self.filter(right, c)
                parts.remove(c)
            if (best := self.extremes(left, right, shared, parts)) is not None:
                right = best
        m = "__r_"
        extra = None
        for c in parts:
            e = Compiler(self.merged(left, right, m), self.context).value(c).bool()
            extra = e if extra is None else extra & e
        renamed, on, _ = self._condition(left, right, extra, m)
        return Rel(left.df.join(renamed, on, how), left.names, left.bound)

    def extremes(self, left: Rel, right: Rel, shared: list[str], conditions: list[tuple]) -> Rel | None:
        """Of the right side the few rows that decide whether any meets the conditions, where one comparison is all that joins
        the sides beside their shared variables; else None.

        Whether some value exceeds another is told by the greatest. What compares with what depends on the kinds of both:
        so the greatest are kept by the kind of term: for numbers by their exact and their double value, for times by these, and
        by the text, also that of what is no time though its datatype says so.
        """
        mixed = [c for c in conditions if not set(_expressions(c)) <= set(left.names)]
        if len(mixed) != 1 or mixed[0][0] not in ("<", ">", "<=", ">=") or _volatile(mixed[0]):
            return None
        op, a, b = mixed[0]
        own = set(right.names) - set(left.names)
        for e, other, top in ((a, b, op[0] == ">"), (b, a, op[0] == "<")):
            inner, outer = set(_expressions(e)), set(_expressions(other))
            if inner <= set(right.names) and outer <= set(left.names) and inner & own:
                break
        else:
            return None
        v = self.value(right, e)
        term, number = v.term(), v.num()
        real = F.when(number.rank.isNotNull() & ~F.isnan(number.dbl), number.dbl)
        exact = F.when(number.rank <= 2, number.dec)
        names = list(dict.fromkeys([*shared, *(n for n in right.names if n in inner)]))
        # Staged, as values that are computed are used by several aggregates.
        made = right.df.select(F.struct(*(right.col(n) for n in names)).alias("__x"), *(right.col(n).alias(f"__k{i}") for i, n in enumerate(shared)), term.alias("__t"), exact.alias("__v0"), real.alias("__v1"))
        made = made.where("__t IS NOT NULL").withColumn("__v2", t.moment(F.col("__t"))).withColumn("__v3", F.when(F.col("__v0").isNull() & F.col("__v1").isNull(), F.col("__t")["lex"]))
        made = made.withColumn("__v4", F.when(F.col("__v2").isNull(), F.col("__v3")))
        pick = F.max_by if top else F.min_by
        groups = made.groupBy(*(f"__k{i}" for i in range(len(shared))), F.col("__t")["k"], F.col("__t")["dt"], F.col("__t")["lang"])
        rows = groups.agg(F.array(*(pick("__x", f"__v{i}") for i in range(5))).alias("__x")).select(F.explode("__x").alias("__x")).where("__x IS NOT NULL")
        return Rel(rows.select(*(F.col("__x")[n].alias(n) for n in names)), names, right.bound & set(names))

    # -- expressions

    def with_flags(self, rel: Rel, e: tuple) -> tuple[Rel, dict, list[str]]:
        """Adds a boolean column for each EXISTS that stands within an expression; its pattern is evaluated once."""
        flags, added = {}, []
        for i, x in enumerate(_find_exists(e)):
            name = f"__exists{i}"
            rows, row = self.correlation.number(rel)
            found = self.semi(rows, x[1], True).df.select(row, F.lit(True).alias(name))
            df = rows.df.join(found, row, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(row)
            rel = Rel(df, rel.names, rel.bound)
            # A later flag numbers the rows anew and has to keep this one.
            rel.names = [*rel.names, name]
            flags[id(x)] = F.col(name)
            added.append(name)
        return Rel(rel.df, [n for n in rel.names if n not in added], rel.bound), flags, added

    def compiler(self, rel: Rel, flags: dict | None = None) -> Compiler:
        return Compiler({n: rel.col(n) for n in rel.names}, self.context, flags)

    def value(self, rel: Rel, e: tuple) -> Value:
        return self.compiler(rel).value(e)

    def filter(self, rel: Rel, e: tuple) -> Rel:
        for c in conjuncts(e):
            if c[0] == "exists":
                rel = self.semi(rel, c[1], True)
            elif c[0] == "not" and c[1][0] == "exists":
                rel = self.semi(rel, c[1][1], False)
            else:
                made, flags, added = self.with_flags(rel, c)
                bound = set(rel.bound)
                steps: list = []
                condition = Compiler({n: made.col(n) for n in made.names}, self.context, flags, steps).value(c).bool()
                df = self.stepped(made.df, steps).where(condition)
                rel = Rel(df.drop(*added, *(n for n, _ in steps)) if added or steps else df, rel.names, bound | self.surely(c, rel))
        return rel

    @staticmethod
    def stepped(df: DataFrame, steps: list) -> DataFrame:
        for name, c in steps:
            df = df.withColumn(name, c)
        return df

    def staged(self, rel: Rel, es: list) -> tuple[Rel, list[Value]]:
        """Values of some expressions over the relation with the columns that they need added."""
        steps: list = []
        compiler = Compiler({n: rel.col(n) for n in rel.names}, self.context, None, steps)
        values = [None if e is None else compiler.value(e) for e in es]
        return Rel(self.stepped(rel.df, steps), rel.names, rel.bound), values

    @staticmethod
    def surely(c: tuple, rel: Rel) -> set[str]:
        """Variables that a condition, being true, leaves bound."""
        if c[0] == "call" and c[1] == "BOUND":
            return {c[2][0][1]} & set(rel.names)
        if c[0] in ("=", "!=", "<", ">", "<=", ">="):
            return {x[1] for x in c[1:] if x[0] == "var"} & set(rel.names)
        return set()

    # -- nodes

    def compile(self, node: A.Node) -> Rel:
        match node:
            case A.Bgp():
                return self.bgp(node)
            case A.Path():
                return self.path(node)
            case A.Join():
                return self.joined(node)
            case A.LeftJoin():
                return self.left_join(self.compile(node.left), self.compile(node.right), node.condition)
            case A.Lateral():
                return self.correlation.lateral(self.compile(node.left), node.right)
            case A.Filter():
                return self.filter(self.compile(node.child), node.condition)
            case A.Union():
                return self.union(self.compile(node.left), self.compile(node.right))
            case A.Graph():
                return self.in_graph(node)
            case A.Extend():
                return self.extend(self.compile(node.child), node.name, node.value)
            case A.Minus():
                return self.minus(self.compile(node.left), self.compile(node.right))
            case A.Values():
                return self.values(node)
            case A.OrderBy():
                rel = self.compile(node.child)
                simple = all(e[0] == "var" for e, _ in node.keys)
                if simple:
                    return Rel(rel.df.orderBy(*self.order(rel, node.keys)), rel.names, rel.bound)
                rel, values = self.staged(rel, [e for e, _ in node.keys])
                return Rel(rel.df.orderBy(*self.order_values(values, [up for _, up in node.keys])).select(*(rel.col(n) for n in rel.names)), rel.names, rel.bound)
            case A.Project():
                return self.project(self.compile(node.child), node.names)
            case A.Distinct():
                return self.distinct(node)
            case A.Reduced():
                return self.compile(node.child)
            case A.Slice():
                rel = self.compile(node.child)
                df = rel.df.offset(node.offset) if node.offset else rel.df
                return Rel(df if node.limit is None else df.limit(node.limit), rel.names, rel.bound)
            case A.Group():
                return self.group(node)
            case A.Service():
                return self.service(node)
        raise ValueError(f"unknown node {type(node).__name__}")

    def extend(self, rel: Rel, name: str, e: tuple) -> Rel:
        rel, flags, _ = self.with_flags(rel, e)
        steps: list = []
        value = Compiler({n: rel.col(n) for n in rel.names}, self.context, flags, steps).value(e).term()
        rel = Rel(self.stepped(rel.df, steps), rel.names, rel.bound)
        if name in rel.names:
            value = F.coalesce(rel.col(name), value)
        names = rel.names if name in rel.names else [*rel.names, name]
        df = rel.df.select(*(rel.col(n) for n in rel.names if n != name), value.alias(name))
        return Rel(df, names, rel.bound | ({name} if e[0] == "const" else set()))

    def project(self, rel: Rel, names: tuple | list) -> Rel:
        df = rel.df.select(*((rel.col(n) if n in rel.names else t.null_term()).alias(n) for n in names))
        return Rel(df, list(names), rel.bound & set(names))

    def order(self, rel: Rel, keys: tuple) -> list[Column]:
        return self.order_values([self.value(rel, e) for e, _ in keys], [up for _, up in keys])

    def order_values(self, values: list[Value], ups: list[bool]) -> list[Column]:
        out = []
        for v, up in zip(values, ups, strict=True):
            if v.as_term is not None:
                columns = t.sort_key(v.as_term)
            else:
                columns = [v.dbl if v.rank is not None else v.as_text if v.as_text is not None else v.as_bool]
            for c in columns:
                last = self.options.unbound_last
                out.append((c.asc_nulls_last() if last else c.asc_nulls_first()) if up else (c.desc_nulls_first() if last else c.desc_nulls_last()))
        return out

    def distinct(self, node: A.Distinct) -> Rel:
        child = node.child
        if isinstance(child, A.Project) and isinstance(child.child, A.OrderBy):
            ordered = child.child
            rel = self.project(self.compile(ordered.child), child.names)
            rel = Rel(rel.df.dropDuplicates(), rel.names, rel.bound)
            keys = tuple(k for k in ordered.keys if set(_expressions(k[0])) <= set(child.names))
            return Rel(rel.df.orderBy(*self.order(rel, keys)), rel.names, rel.bound) if keys else rel
        rel = self.compile(child)
        return Rel(rel.df.dropDuplicates() if rel.names else rel.df.limit(1), rel.names, rel.bound)

    def union(self, a: Rel, b: Rel) -> Rel:
        names = a.names + [n for n in b.names if n not in a.names]
        return Rel(self.project(a, names).df.union(self.project(b, names).df), names, a.bound & b.bound)

    def values(self, node: A.Values) -> Rel:
        schema = t.T.StructType([t.T.StructField(n, t.TERM) for n in node.names])
        df = self.spark.createDataFrame([tuple(t.as_row(x) for x in r) for r in node.rows], schema)
        bound = {n for i, n in enumerate(node.names) if all(r[i] is not None for r in node.rows)}
        return Rel(df, list(node.names), bound)

    def in_graph(self, node: A.Graph) -> Rel:
        before, self.graph = self.graph, node.name
        try:
            rel = self.compile(node.child)
            if node.name[0] == "var" and node.name[1] not in rel.names:
                rel = self.join(rel, self.graph_unit())
            return rel
        finally:
            self.graph = before

    def group(self, node: A.Group) -> Rel:
        return self.grouped(self.compile(node.child), node)

    def grouped(self, rel: Rel, node: A.Group) -> Rel:
        rel, values = self.staged(rel, [spec[1] for _, spec in node.aggregates])
        row = [rel.col(n) for n in rel.names if not n.startswith("__")]
        columns = [aggregate(spec, v, row, self.options.aggregates).alias(name) for (name, spec), v in zip(node.aggregates, values, strict=True)]
        keys = [(rel.col(k) if k in rel.names else t.null_term()).alias(k) for k in node.keys]
        names = [*node.keys, *(n for n, _ in node.aggregates)]
        if not columns:
            return Rel(rel.df.select(*keys).distinct(), list(node.keys), rel.bound & set(node.keys))
        df = rel.df.groupBy(*keys).agg(*columns)
        return Rel(df.select(*(F.col(f"`{n}`") for n in names)), names, (rel.bound & set(node.keys)) | {n for n, s in node.aggregates if s[0] == "COUNT"})

    def service(self, node: A.Service) -> Rel:
        try:
            if node.name[0] == "var":
                raise ServiceError("SERVICE needs an IRI")
            if self.options.service is None:
                raise ServiceError(f"no handler for {node.name[1]}")
            df = self.options.service(node.name[1], node)
            if node.silent:
                df = cut(df)  # a failure while rows are made is silent too
            names = list(df.columns)
            return Rel(df, names, set())
        except Exception:
            if not node.silent:
                raise
            return self.one()
