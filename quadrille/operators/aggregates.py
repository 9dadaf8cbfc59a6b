"""SPARQL aggregates as Spark aggregates over number lanes; all but GROUP_CONCAT combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.expressions import Value, number
from ..plans.algebra import XSD
from ..functions.terms import DEC


def _least(x: Column, largest: bool) -> Column:
    """The least or greatest term by value; terms that can't be compared go by kind and text."""
    fields = [c.alias(f"k{i}") for i, c in enumerate(t.sort_key(x))]
    keyed = F.when(x.isNotNull(), F.struct(*fields, x.alias("term")))
    return (F.max(keyed) if largest else F.min(keyed))["term"]


def aggregate(spec: tuple, value: Value | None, row: list[Column], custom: dict) -> Column:
    name, _, distinct, separator = spec
    if name in custom:
        return custom[name](value.term())
    if name == "COUNT":
        if value is None:
            n = F.count_distinct(F.struct(*row)) if distinct and row else F.count(F.lit(1))
        else:
            n = F.count_distinct(value.term()) if distinct else F.count(value.term())
        return t.literal(n.cast("string"), XSD + "integer")
    if name in ("SUM", "AVG"):
        v = value.num()
        lane_dec, lane_dbl = F.when(v.rank <= 2, v.dec), F.when(v.rank.isNotNull(), v.dbl)
        rank = F.coalesce(F.max(v.rank), F.lit(1))
        dec = F.coalesce((F.sum_distinct if distinct else F.sum)(lane_dec).try_cast(DEC), F.when(F.count(lane_dec) == 0, F.lit(0).cast(DEC)))
        dbl = F.coalesce((F.sum_distinct if distinct else F.sum)(lane_dbl), F.lit(0.0))
        if name == "SUM":
            return number(rank, dec, dbl).term()
        n = F.count_distinct(lane_dbl) if distinct else F.count(lane_dbl)
        bad = F.max(F.when(value.term().isNotNull() & v.rank.isNull(), 1))
        mean = number(F.when(rank == 1, 2).otherwise(rank), F.try_divide(dec, n.cast("decimal(20,0)")).try_cast(DEC), F.try_divide(dbl, n)).term()
        return F.when(bad.isNotNull(), t.null_term()).when(n == 0, t.literal("0", XSD + "integer")).otherwise(mean)
    x = value.term()
    if name in ("MIN", "MAX"):
        return _least(x, name == "MAX")
    if name == "SAMPLE":
        return F.first(x, ignorenulls=True)
    if name == "GROUP_CONCAT":
        lex = F.when(x["k"] == t.LITERAL, x["lex"])
        parts = F.sort_array(F.collect_set(lex)) if distinct else F.collect_list(lex)
        return t.literal(F.array_join(parts, separator))
    return t.null_term()
