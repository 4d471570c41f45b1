"""Co-trained quality scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..cotraining import quality_scores
from ..shared import table

SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_score, metadata_score, quality, kept."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
