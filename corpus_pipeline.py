"""A corpus pipeline of five stages; each works on all that its predecessor kept.

quality rules -> near-duplicate removal -> benchmark decontamination -> mixing -> token records. All stages but the last
return the columns of `documents`; the last returns one row per written record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, mixing, near_duplicates, quality, token_records
from quadrille.llm.queries import tokenizer_path
from quadrille.llm.runtime import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the learned verdict rejects: null, empty and very short texts among them.

    Repeated rows are judged alike; an empty table stays empty.
    """
    return quality.judged(docs).where("kept").select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by key, of each component of near duplicates.

    Texts without words are duplicates of nothing but of a row equal in key and text, of which one stays.
    """
    return near_duplicates.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of any test item; null texts hold none, and without items all stay."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, from 0 to 3; a document without words stays once. A null source is one."""
    mix = mixing.mixed(docs)
    return mix.where("copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per record written: copies of a document follow each other; a null text is the end id alone."""
    return token_records.write_and_digest(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_removal", near_duplicate_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL cannot express the learned verdicts, the solver of the mix or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
