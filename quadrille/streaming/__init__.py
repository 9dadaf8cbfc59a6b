"""Quads that arrive as a stream of N-Quads lines: each micro-batch is appended to a store's Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import ntriples


def ingest(lines: DataFrame, target: str, checkpoint: str, lenient: bool = True):
    """Starts appending a streaming text DataFrame (column value) as quads; returns the streaming query.

    A batch that is run again after a failure writes the same quads; readers see a set, so repeats do no harm.
    """

    def write(batch: DataFrame, number: int) -> None:
        ntriples.parse_lines(batch, lenient=lenient, rename_blank_nodes=False).dropDuplicates().write.mode("append").parquet(target)

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def watch(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)
