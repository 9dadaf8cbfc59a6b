"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates in [0, cap] that make the words of
each source meet its target, entropy balancing takes those that diverge least from one copy each. The convex dual has
one multiplier per source, and its solution tilts rates exponentially: rate = min(cap, exp(multiplier * size / scale)).
Newton steps, kept inside a bracket that shrinks every round, find all multipliers at once; gradient and curvature are
sums over a histogram (source, size, documents) that one combinable aggregate over the corpus makes, since documents of
one source and size share a rate. Rates become whole copies by carrying the rounding remainder through the sizes of a
source, so what a source loses at one size it gets back at the next.

Documents of size 0 (null or blank texts) add no words and keep rate 1. A null source is a source of its own, after all
others. Rows that repeat each other are documents of their own. An empty table gives an empty mix; where all sizes are 0,
all targets are 0. Columns that bear the names of the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise

CAP = 3.0
#: Documents of one source and size that are ranked together; rows that repeat key and text fall in one slice.
CELL_ROWS = 500
ROUNDS = 60
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters outside [\\x20\\x09-\\x0D]; 0 for null."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.coalesce(F.size(F.array_remove(F.split(text, " "), "")), F.lit(0)).cast("long")


def capped_targets(sizes: list[tuple[object, int]], weights: Mapping[object, float] | None = None, cap: float = CAP) -> dict[object, float]:
    """Target of each source: total size shared by weight, at most cap times its own size, the excess reshared by weight.

    sizes: (source, size), in order; weights: by source, or 1, 2, 3, repeating, in order of the sources.
    """
    w = {s: float(weights[s] if weights else i % 3 + 1) for i, (s, _) in enumerate(sizes)}
    left, open_, out = float(sum(n for _, n in sizes)), dict(sizes), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = [s for s, n in open_.items() if unit * w[s] > cap * n]
        if not full:
            return out | {s: unit * w[s] for s in open_}
        for s in full:
            out[s] = cap * open_.pop(s)
            left -= out[s]
    return out


def solve(histogram: DataFrame, targets: DataFrame, cap: float = CAP, rounds: int = ROUNDS) -> DataFrame:
    """Adds `rate` to the histogram (source, size, n); targets: (source, target, source_size), joined null-safely.

    A source whose target is cap times its size has no finite multiplier; all its documents get the cap. A source with
    target 0 gets rate 0. Each Newton round is one aggregate over the histogram; the state is one row per source.
    """
    t = targets.select("source", "target", "source_size")
    top = histogram.where("size > 0").groupBy("source").agg(F.max("size").cast("double").alias("scale"))
    state = t.join(top, t.source.eqNullSafe(top.source), "left").select(t.source, "target", "source_size", F.coalesce("scale", F.lit(1.0)).alias("scale"))
    full = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))
    state = state.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "x": F.lit(0.0), "done": full | (F.col("target") <= 0)})
    state = materialise(state, "mix-state")
    positive = histogram.where("size > 0").select(F.col("source").alias("s"), "size", "n")
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            break
        live = positive.join(state.where("not done"), F.col("s").eqNullSafe(F.col("source")))
        u = F.col("size") / F.col("scale")
        free = F.exp(F.col("x") * u)
        words = F.col("n") * F.col("size")
        sums = live.groupBy(F.col("source").alias("s")).agg(
            F.sum(words * F.least(F.lit(cap), free)).alias("value"),
            F.sum(F.when(free < cap, words * u * free).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("value") - F.col("target")
        low, high = F.when(gap < 0, F.col("x")).otherwise(F.col("low")), F.when(gap > 0, F.col("x")).otherwise(F.col("high"))
        newton = F.col("x") - gap / F.col("slope")
        # Outside the bracket, or flat: halve it, or double away from 0 while one side is still open.
        safe = F.when(low.isNull(), F.least(high * 2, F.lit(0.0)) - 1.0).when(high.isNull(), F.greatest(low * 2, F.lit(0.0)) + 1.0).otherwise((low + high) / 2)
        good = (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - F.col("x")) < 50)
        hit = F.abs(gap) <= TOLERANCE * F.col("target")
        now = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        state = materialise(now.select("source", "target", "source_size", "scale", low.alias("low"), high.alias("high"), F.when(F.col("done") | hit, F.col("x")).when(good, newton).otherwise(safe).alias("x"), (F.col("done") | hit).alias("done")), "mix-state")
    rate = F.when(F.col("size") == 0, 1.0).when(full, cap).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(cap), F.exp(F.col("x") * F.col("size") / F.col("scale"))))
    h = histogram.withColumnRenamed("source", "s")
    return h.join(state, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "size", "n", "target", "source_size", rate.alias("rate"))


def _round_source(cells):
    """Whole copies for the sizes of one source, largest first; the words lost or won by rounding pass to the next size.

    One row per distinct size: the table is bounded by the longest document, not by the number of documents.
    """
    cells = cells.sort_values("size", ascending=False).reset_index(drop=True)
    whole, extra, carry = [], [], 0.0
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
        low = math.floor(rate + 1e-9)
        wanted = max(0.0, rate - low) * n
        more = 0 if not size or rate <= 0 else int(min(n if rate > low + 1e-9 else 0, max(0, math.floor(wanted + carry / size + 0.5))))
        carry += (wanted - more) * size
        whole.append(low)
        extra.append(more)
    return cells.assign(whole=whole, extra=extra)


def mixed(documents: DataFrame, *, source: str = "source", text: str = "text", key: str = "doc_id", weights: Mapping[object, float] | None = None, cap: float = CAP, keep_text: bool = True) -> DataFrame:
    """The documents with size, source_size, target, rate and copies (a whole number from 0 to cap).

    The sizes of all sources and their targets pass through the driver, one row per source. Copies depend on the table's
    content alone: within a size, documents are ranked by a hash of key and text, so reruns agree.
    """
    names = ["size", "source_size", "target", "rate", "copies"]
    docs = documents.drop(*names).withColumn("size", word_count(F.col(text)))
    docs = docs.withColumns({"_mix_source": F.col(source), "_mix_rank": F.xxhash64(F.col(key), F.col(text))})
    if not keep_text:
        docs = docs.drop(text)
    histogram = materialise(docs.groupBy(F.col("_mix_source").alias("source"), "size").agg(F.count("*").alias("n")), "mix-histogram")
    sizes = [(r[0], r[1]) for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    sizes.sort(key=lambda r: (r[0] is None, r[0] or ""))
    aims = capped_targets(sizes, weights, cap)
    spark = documents.sparkSession
    targets = spark.createDataFrame([(s, aims[s], n) for s, n in sizes], "source string, target double, source_size long")
    cells = solve(histogram, targets, cap)
    cells = cells.groupBy("source").applyInPandas(_round_source, "source string, size long, n long, target double, source_size long, rate double, whole long, extra long")
    # A cell of many documents is cut into slices by rank. Slices are filled with extra copies in turn, by the running
    # total of their documents, so the cell takes exactly its extras; only the slice at the border has to be ranked.
    cells = materialise(cells.withColumn("slices", F.ceil(F.col("n") / CELL_ROWS)), "mix-cells").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "source_size", "target", "rate", "whole", "extra", "slices")
    docs = docs.join(cells, F.col("_mix_source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))).drop("c_source", "c_size")
    docs = docs.withColumn("_mix_slice", F.pmod(F.col("_mix_rank"), F.col("slices")))
    where = docs.where("extra > 0").groupBy(F.col("_mix_source").alias("s_source"), F.col("size").alias("s_size"), F.col("_mix_slice").alias("s_slice")).agg(F.count("*").alias("_mix_n"), F.max("extra").alias("s_extra"))
    ahead = Window.partitionBy("s_source", "s_size").orderBy("s_slice").rowsBetween(Window.unboundedPreceding, -1)
    where = where.withColumn("_mix_left", F.col("s_extra") - F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0)))
    where = materialise(where.where("_mix_left > 0").drop("s_extra"), "mix-slices")
    same = F.col("_mix_source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("_mix_slice") == F.col("s_slice"))
    docs = docs.join(where, same, "left").drop("s_source", "s_size", "s_slice")
    border = F.col("_mix_left") < F.col("_mix_n")
    place = F.row_number().over(Window.partitionBy("_mix_source", "size", "_mix_slice").orderBy("_mix_rank", F.col(key)))
    ranked = docs.where(border).withColumn("_mix_more", (place <= F.col("_mix_left")).cast("int"))
    filled = docs.where(~F.coalesce(border, F.lit(False))).withColumn("_mix_more", F.col("_mix_left").isNotNull().cast("int"))
    docs = filled.unionByName(ranked)
    copies = F.col("whole") + F.col("_mix_more")
    return docs.withColumn("copies", copies.cast("int")).drop("_mix_source", "_mix_rank", "_mix_slice", "_mix_n", "_mix_left", "_mix_more", "whole", "extra", "slices")
