"""Token files of every whole document text, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..shared import table
from ..token_files import read_documents, write_token_files

SQL = None
END_ID = 2
VOCABULARY = 49_408


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    docs = table(spark, sf_dir, "documents")
    return read_documents(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, VOCABULARY))
