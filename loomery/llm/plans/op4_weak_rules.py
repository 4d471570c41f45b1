"""Quality rules over every whole document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality_rules import base_failed, judge_quality
from ..shared import table

SQL = None  # the verdict comes from expectation-maximisation


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept."""
    judged = judge_quality(table(spark, sf_dir, "documents")).withColumn("base_failed", base_failed())
    kept = (~F.col("base_failed") & F.col("good")).alias("kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", kept)
