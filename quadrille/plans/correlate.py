"""Patterns evaluated for each row of a left side: LATERAL, and EXISTS whose inner parts name outer variables.

The left rows are numbered, and the number travels through the pattern as one more column: filters and expressions see
the row's variables, grouping, DISTINCT, ordering and slices hold within a row. All of it stays joins, aggregates and
windows keyed by the number, so rows are worked on together and spread over the cluster.
"""

from __future__ import annotations

from dataclasses import fields
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.paths import cut
from . import algebra as A

if TYPE_CHECKING:
    from .compiler import PatternCompiler, Rel

ORDER = "__order"
_UNITS = (A.Slice, A.Distinct, A.Reduced, A.OrderBy, A.Project, A.Group)


def mentions(x) -> set[str]:
    """All variables named anywhere, in inner patterns and expressions too."""
    if isinstance(x, A.Node):
        return set().union(*(mentions(getattr(x, f.name)) for f in fields(x)))
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var" and isinstance(x[1], str):
        return {x[1]}
    if isinstance(x, (tuple, list)):
        return set().union(*map(mentions, x))
    return set()


def sees_outer(node: A.Node, outer: set[str]) -> bool:
    """Does a part of the pattern depend on outer variables in another way than by joining with them?"""

    def own(*nodes: A.Node) -> set[str]:
        return set().union(*(A.variables(n) for n in nodes))

    match node:
        case A.Filter():
            return bool((mentions(node.condition) - own(node.child)) & outer) or sees_outer(node.child, outer)
        case A.Extend():
            return bool((mentions(node.value) - own(node.child)) & outer) or sees_outer(node.child, outer)
        case A.LeftJoin():
            deep = bool((mentions(node.condition) - own(node.left, node.right)) & outer)
            return deep or sees_outer(node.left, outer) or sees_outer(node.right, outer)
        case A.Join() | A.Union() | A.Lateral():
            return sees_outer(node.left, outer) or sees_outer(node.right, outer)
        case A.Minus():
            return sees_outer(node.left, outer)
        case A.Graph() | A.Distinct() | A.Reduced():
            return sees_outer(node.child, outer)
        case A.Project():
            return bool((own(node.child) - set(node.names)) & outer) or sees_outer(node.child, outer)
        case A.Group():
            return bool((own(node.child) - set(node.keys)) & outer) or sees_outer(node.child, outer)
        case A.OrderBy():
            return sees_outer(node.child, outer)
        case A.Slice():
            return bool(own(node.child) & outer) or sees_outer(node.child, outer)
    return False


class Correlation:
    def __init__(self, compiler: PatternCompiler):
        self.c = compiler
        self.made = 0

    def number(self, rel: Rel) -> tuple[Rel, str]:
        """The rows with a number each; written down, so that it stays the same wherever it is read."""
        name = f"__row{self.made}"
        self.made += 1
        df = cut(rel.df.select(*(rel.col(n) for n in rel.names)).withColumn(name, F.monotonically_increasing_id()))
        return type(rel)(df, [*rel.names, name], rel.bound | {name}), name

    def lateral(self, left: Rel, right: A.Node) -> Rel:
        rel = self.extended(left, right)
        return self.c.project(rel, [n for n in rel.names if not n.startswith("__")])

    def matching(self, left: Rel, pattern: A.Node, keep: bool) -> Rel:
        """The rows for which the pattern has a solution, or has none."""
        rows, row = self.number(left)
        found = self.extended(rows, pattern).df.select(row).distinct()
        return type(left)(rows.df.join(found, row, "left_semi" if keep else "left_anti").drop(row), left.names, left.bound)

    def otherwise(self, rows: Rel, matched: Rel, row: str) -> Rel:
        """The matched rows, and those of the numbered rows without a match."""
        rest = rows.df.join(matched.df.select(row).distinct(), row, "left_anti")
        rel = self.c.union(matched, type(rows)(rest, rows.names, rows.bound))
        return type(rows)(rel.df, [n for n in rel.names if n != row], rows.bound - {row})

    def extended(self, left: Rel, node: A.Node) -> Rel:
        """The left rows joined with the solutions that the node has for each of them."""
        c = self.c
        if isinstance(node, _UNITS):
            rows, row = self.number(left)
            inner = self.unit(rows, node, row)
            kept = [n for n in left.names if n not in inner.names]
            names = [*kept, *(n for n in inner.names if n not in (row, ORDER))]
            df = rows.df.select(row, *(rows.col(n) for n in kept)).join(inner.df, row)
            return type(left)(df.select(*(F.col(f"`{n}`") for n in names)), names, (left.bound & set(names)) | (inner.bound - {row, ORDER}))
        match node:
            case A.Join():
                return self.extended(self.extended(left, node.left), node.right)
            case A.Lateral():
                return self.extended(self.extended(left, node.left), node.right)
            case A.LeftJoin():
                rows, row = self.number(self.extended(left, node.left))
                matched = self.extended(rows, node.right)
                if node.condition is not None:
                    matched = c.filter(matched, node.condition)
                return self.otherwise(rows, matched, row)
            case A.Minus():
                return c.minus(self.extended(left, node.left), c.compile(node.right))
            case A.Filter():
                return c.filter(self.extended(left, node.child), node.condition)
            case A.Union():
                return c.union(self.extended(left, node.left), self.extended(left, node.right))
            case A.Extend():
                return c.extend(self.extended(left, node.child), node.name, node.value)
            case A.Graph():
                before, c.graph = c.graph, node.name
                try:
                    rel = self.extended(left, node.child)
                    return c.join(rel, c.graph_unit()) if node.name[0] == "var" and node.name[1] not in rel.names else rel
                finally:
                    c.graph = before
        return c.join(left, c.compile(node))

    def unit(self, rows: Rel, node: A.Node, row: str) -> Rel:
        """A sub-query for each row: its solutions beside the row's number, and their order if it has one."""
        c = self.c
        match node:
            case A.Project():
                rel = self.unit(rows, node.child, row)
                extra = [n for n in (row, ORDER) if n in rel.names]
                return c.project(rel, [*(n for n in node.names if n not in extra), *extra])
            case A.Distinct():
                rel = self.unit(rows, node.child, row)
                if ORDER not in rel.names:
                    return type(rel)(rel.df.dropDuplicates(), rel.names, rel.bound)
                names = [n for n in rel.names if n != ORDER]
                return type(rel)(rel.df.groupBy(*(rel.col(n) for n in names)).agg(F.min(ORDER).alias(ORDER)), [*names, ORDER], rel.bound)
            case A.Reduced():
                return self.unit(rows, node.child, row)
            case A.OrderBy():
                rel = self.unit(rows, node.child, row)
                made, values = c.staged(rel, [e for e, _ in node.keys])
                place = F.row_number().over(Window.partitionBy(row).orderBy(*c.order_values(values, [up for _, up in node.keys])))
                names = [n for n in rel.names if n != ORDER]
                return type(rel)(made.df.select(*(rel.col(n) for n in names), place.alias(ORDER)), [*names, ORDER], rel.bound)
            case A.Slice():
                rel = self.unit(rows, node.child, row)
                place = F.row_number().over(Window.partitionBy(row).orderBy(ORDER if ORDER in rel.names else F.lit(0)))
                df = rel.df.withColumn("__n", place).where(F.col("__n") > node.offset)
                df = df if node.limit is None else df.where(F.col("__n") <= node.offset + node.limit)
                return type(rel)(df.drop("__n"), rel.names, rel.bound)
            case A.Group():
                return self.group(rows, node, row)
        return self.extended(rows, node)

    def group(self, rows: Rel, node: A.Group, row: str) -> Rel:
        rel = self.unit(rows, node.child, row)
        keyed = A.Group(node.child, (row, *node.keys), node.aggregates)
        out = self.c.grouped(rel, keyed)
        if node.keys:
            return out
        # Without keys each row has one group, also where nothing matched.
        empty: DataFrame = self.c.grouped(type(rel)(rel.df.where(F.lit(False)), rel.names, rel.bound), node).df
        rest = rows.df.select(row).join(out.df.select(row), row, "left_anti").crossJoin(F.broadcast(empty))
        return type(rel)(out.df.union(rest.select(*(F.col(f"`{n}`") for n in out.names))), out.names, {row} | (out.bound & {n for n, s in node.aggregates if s[0] == "COUNT"}))
