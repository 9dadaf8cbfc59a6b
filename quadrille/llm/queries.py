"""The registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fuzzy_lines, html_text, mixing, near_duplicates, oracles, quality, substring, token_counts, token_records, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.without_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.array_join(F.array_sort(F.transform("contamination.item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "contamination.n_words", "contamination.n_hit", "contamination.n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.classes(_table(spark, sf_dir, "documents"))
    plain = lambda c: F.when(F.col(c) != near_duplicates.NO_ID, F.col(c))
    return found.select(plain("id").alias("doc_id"), plain("root.id").alias("class_id"), plain("rep.id").alias("rep_id"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.write_and_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs, keep_text=False).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.scored(docs, model, keep_text=False)
    return found.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.deduplicated(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_html=False)
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.counted(docs, tokenizer_path("piece_bpe_32k.model"), keep_text=False).select("doc_id", "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_quality_rules, op4_jaccard_join, op5_token_records, op6_mix_sources, op7_toxicity, op8_fuzzy_lines, op9_html_text, op10_token_counts)}

ORACLES: dict[str, str] = {"op1_substring_dedup": oracles.SUBSTRING, "op2_decontaminate": oracles.DECONTAMINATE, "op4_jaccard_join": oracles.JACCARD}
