"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents; the last returns a row for each document written: doc_id, start, n_tokens, ids_crc32.
Extra columns of any type and name pass through to the last stage. Null ids and texts, repeated rows, very long texts, ties and empty tables are allowed
in every stage; each says what it makes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm.minhash import MOST_SENT, near_duplicates
from loomery.llm.mixing import mix_sources
from loomery.llm.positional_index import contamination
from loomery.llm.quality_rules import fit_rules, keep_good
from loomery.llm.shared import free, stash, table
from loomery.llm.token_files import read_documents, write_token_files

END_ID, VOCABULARY = 2, 49_408
#: Copies of one row that are written by one task at most.
MOST_COPIES = 1000


def _sent(few: DataFrame) -> DataFrame:
    """A stash, marked for broadcast if its rows are few enough: then the texts beside it aren't shuffled."""
    return F.broadcast(few) if few.count() <= MOST_SENT else few


def _packed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, source, text and two hashes of the row; no name of an extra column can clash with these."""
    plain = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema]
    nulls = F.concat(*[docs[c].isNull().cast("string") for c in docs.columns])  # the hash passes over nulls
    hashes = [F.xxhash64(F.lit(seed), nulls, *plain).alias(f"h{seed}") for seed in (1, 2)]
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["source"], docs["text"], *hashes)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are too short or repetitive, or whose votes make them more likely bad than good.

    Null and empty texts are too short. Repeated rows and ties are judged alike; null ids don't matter. The rules are read twice, to fit the model and to
    judge, and nothing is written between.
    """
    return keep_good(docs, fit_rules(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id in each group of near-duplicates (five-word shingles, similarity of 0.8 and more).

    An id is one document: of rows that share one, the least text stays (of equal texts, the least row as JSON). Rows without an id are linked with
    nothing and stay, and so do null and empty texts.
    """
    found = near_duplicates(docs, width=5, percent=80)
    known = stash(found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "known")
    free(*found.behind)
    packed = _packed(docs)
    drop, repeated = (known.filter(x).select(F.col("doc_id").alias("k")) for x in ("not kept", "kept and n > 1"))
    kept = packed.join(_sent(drop), F.col("doc_id") == F.col("k"), "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json("row"))
    least = kept.join(repeated, F.col("doc_id") == F.col("k"), "left_semi").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return kept.join(_sent(repeated), F.col("doc_id") == F.col("k"), "left_anti").select("row.*").union(least.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in benchmark passages.

    Rows are known by a hash of all their columns, so rows that share an id are judged one by one. Null and empty texts hold no passage and stay; repeated
    rows go or stay together.
    """
    packed = _packed(docs)
    judged = contamination(packed.select(F.struct("h1", "h2").alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    bad = stash(judged.filter("contaminated").select("key.h1", "key.h2").distinct(), "contaminated")
    free(*judged.behind)
    return packed.join(_sent(bad), ["h1", "h2"], "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources take shares of the words by weight.

    Rows equal in all columns are dealt as one with all their copies. A null source is a source of its own; rows without words count nothing and may
    stay or go. Documents of one size have an order by a hash of the row.
    """
    packed = _packed(docs)
    mixed = mix_sources(packed.select(F.struct("h1", "h2").alias("key"), "source", "text"), id_col="key")
    copies = stash(mixed.groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0").select("key.h1", "key.h2", "copies", "n"), "copies")
    free(*mixed.behind)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / MOST_COPIES)))
    parts = copies.select("h1", "h2", "n", "copies", part.alias("part")).withColumn("times", F.least(F.lit(MOST_COPIES), F.col("copies") - F.col("part") * MOST_COPIES))
    taken = packed.select("row", "h1", "h2").join(parts.filter("n = 1"), ["h1", "h2"]).select("row", "times")
    repeated = stash(parts.filter("n > 1"), "repeated")
    if not repeated.isEmpty():
        few = packed.join(_sent(repeated.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"))
        taken = taken.union(few.join(repeated, ["h1", "h2"]).select("row", "times"))
    times = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return taken.select("row", times.alias("copy")).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back. Null and empty texts are one end id; copies and rows without an id are documents like others."""
    return read_documents(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mix_sources", mixing),
    ("token_output", token_output),
]

#: Votes are weighed by expectation-maximisation and texts are tokenised, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
