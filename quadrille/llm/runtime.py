"""Shared folders, materialised steps and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine, as in tests, may leave it
    unset and gets a temporary one; any other raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quadrille-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: its lineage is cut and survives lost executors.

    A plain scan on either side of a later join also lets adaptive execution split hot partitions. The driver's garbage is
    collected then, as Spark deletes the shuffle files of a finished step only when its plan is collected.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that no later step reads."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_holder: tuple[str, Callable[[], None] | None] | None = None


def take_over(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a Python worker starts on an operator's rows: what another operator has cached in it is dropped.

    Workers are reused from task to task, so a cache lives on through the stages of other operators if nobody clears it.
    """
    global _holder
    if _holder and _holder[0] != owner:
        if _holder[1]:
            _holder[1]()
        give_back()
    _holder = (owner, clear)


def give_back() -> None:
    """Returns freed memory to the system, as far as the allocators can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _stars(edges: DataFrame) -> bool:
    """Does every node point at one root, and is no root a child?"""
    n, children = edges.agg(F.count("*"), F.countDistinct("a")).first()
    return n == children and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root) with the least node of each component.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"):
    every step links neighbours to a minimum found by a combinable aggregate, so no neighbour list is ever gathered.
    A round's edges are written to the shared folder. Self loops are kept as single nodes; empty edges give no rows.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = edges.where("a != b")
    for done in range(rounds + 1):
        if _stars(now):
            break
        if done == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = materialise(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialise(small.where("a != b").distinct(), "cc-edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
