"""How far the sources of each language diverge in their terms: DuckDB counts and compares shard by shard, Spark merges sums and rankings.

Terms are runs of A-Z, a-z and non-ASCII characters, A-Z lower-cased. A language keeps the V terms that at least min_docs of its documents hold. A group, (lang,
source), gives each kept term p = 1 + floor(10^9 * (count + 5) / (N + 5 V)), with count its occurrences in the group and N those of all kept terms; a language as a
whole gives q the same way. Two results: for each pair of a language's sources, the sum of |p - p'| over all kept terms; for each group, the terms it has with
p > q, by p - q.

Shards: tokens are counted by group and term in each slice of text, and go by a hash of (lang, term) to a shard. There DuckDB adds them up in one SQL statement, as
they stream in, and keeps the frequent terms, which are written out (so lost executors cost a shard, not the run). N, V and the groups, with their languages'
numbers, are added by Spark joins. A second SQL statement for each shard of the written terms gives partial pair sums and each group's best terms; Spark adds the
sums and ranks. A pair's sum is taken over the terms either source has; all other terms differ by the same |p(0) - p'(0)|, which is added once. So work follows the
terms that are there, and shards follow the distinct terms, which grow more slowly than the text. A hot term or group is counted in its slices before the shuffle.
The groups of a shard's languages come to it as rows of the shuffle: nothing is broadcast. DuckDB runs in the tasks, on one thread, in MEMORY and without a folder.

Null texts have no terms; null langs and sources are '', and so the same as empty ones. Null ids don't matter, repeated rows count each, very long texts are whole;
equal values rank by the item's UTF-8 bytes. A group without terms still has its pairs. Extra columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .shared import stash

#: The memory of a task's DuckDB.
MEMORY = "400MB"
SLICE_BYTES, SHARD_BYTES = 8 << 20, 8 << 20

#: Occurrences and documents of each group's terms; whole: occurrences in the language; lead: one row of each kept term.
COUNT_SQL = """
SELECT lang, source, term, sum(c)::BIGINT AS c, (sum(sum(c)) OVER w)::BIGINT AS whole, source = min(source) OVER w AS lead
FROM counted GROUP BY lang, source, term WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(sum(d)) OVER w >= {min_docs}
"""
# A language without kept terms has no shares; the divisor only has to be sound.
_SHARE = "1 + (1000000000::HUGEINT * ({} + 5)) // greatest({} + 5 * {}::HUGEINT, 1)"
#: Part pair: for each two sources that a term of the shard meets, value (over such terms) and n (their number). Part term: each group's best terms.
COMPARE_SQL = f"""
WITH facts AS (
  SELECT DISTINCT lang, source, n, v, whole_n, ({_SHARE.format(0, "n", "v")})::BIGINT AS zero FROM rows WHERE term IS NULL
), shares AS (
  SELECT r.lang, r.source, r.term, ({_SHARE.format("r.c", "f.n", "f.v")})::BIGINT AS p, ({_SHARE.format("r.whole", "f.whole_n", "f.v")})::BIGINT AS q
  FROM rows r JOIN facts f ON f.lang = r.lang AND f.source = r.source WHERE r.term IS NOT NULL
), pairs AS (
  SELECT x.lang, least(x.source, f.source) AS source, greatest(x.source, f.source) AS item, sum(abs(x.p - coalesce(y.p, f.zero)))::BIGINT AS value, count(*) AS n
  FROM shares x JOIN facts f ON f.lang = x.lang AND f.source <> x.source
  LEFT JOIN shares y ON y.lang = x.lang AND y.term = x.term AND y.source = f.source
  WHERE y.source IS NULL OR x.source < f.source GROUP BY 1, 2, 3
), terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM shares WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {{most}}
)
SELECT 'pair' AS part, lang, source, item, value, n FROM pairs UNION ALL SELECT 'term', lang, source, item, value, 0 FROM terms
"""


def _duck():
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = ''; SET preserve_insertion_order = false")
    return con


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences) and d (documents) of each slice of text, from columns lang, source and text without nulls."""
    letters = words.byte_table(lower=True, keep_alnum_only=True)
    letters[0x30:0x3A] = 0x20

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                flat, n = words.split(part.column("text"), letters)
                if not len(flat):
                    continue
                group, term = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"]), flat.dictionary_encode()
                # A group's number is that of its first document in the slice.
                seen: dict = {}
                number = np.array([seen.setdefault(g, i) for i, g in enumerate(zip(group.field(0).to_pylist(), group.field(1).to_pylist(), strict=True))], np.int64)
                doc, size = np.repeat(np.arange(len(n)), n), np.int64(len(term.dictionary))
                key = term.indices.to_numpy().astype(np.int64)
                in_doc = np.unique(doc * size + key)
                each, c = np.unique(number[doc] * size + key, return_counts=True)
                _, d = np.unique(number[in_doc // size] * size + in_doc % size, return_counts=True)
                owner = pa.array(each // size)
                yield pa.RecordBatch.from_arrays([group.field(0).take(owner), group.field(1).take(owner), term.dictionary.take(pa.array(each % size)), pa.array(c), pa.array(d)], ["lang", "source", "term", "c", "d"])

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, c long, d long")


def _kept_terms(counted: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """lang, source, term, c, whole and lead of the terms that are frequent in a language."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])
        con = _duck()
        con.register("counted", pa.RecordBatchReader.from_batches(kinds, (b.cast(kinds) for b in batches)))
        yield from con.execute(COUNT_SQL.format(min_docs=min_docs)).to_arrow_reader(50_000)

    return counted.repartition(shards, "lang", "term").mapInArrow(keep, "lang string, source string, term string, c long, whole long, lead boolean")


def source_divergence(docs: DataFrame, min_docs: int = 30, most: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: all other sources of each group by distance, and its `most` most typical terms."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    if not shards:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, round((size / SHARD_BYTES) ** 0.6))
    kept = stash(_kept_terms(count_terms(texts), shards, min_docs), "terms")
    n = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count_if("lead").alias("v"))
    groups = texts.select("lang", "source").distinct().join(n, ["lang", "source"], "left").fillna(0, ["n", "v"])
    whole = groups.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("whole_n"))
    facts = stash(groups.drop("v").join(whole, "lang"), "groups")
    none, shard = F.lit(None), F.pmod(F.xxhash64("lang", "term"), F.lit(shards))
    rows = kept.select(shard.alias("shard"), "lang", "source", "term", "c", "whole", *[none.cast("long").alias(c) for c in ("n", "v", "whole_n")])
    heads = facts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "lang", "source", none.cast("string").alias("term"), none.cast("long").alias("c"), none.cast("long").alias("whole"), "n", "v", "whole_n")

    def compare(given: pa.Table) -> pa.Table:
        con = _duck()
        con.register("rows", given)
        out = con.execute(COMPARE_SQL.format(most=most)).to_arrow_reader()
        return out.read_all().select(["part", "lang", "source", "item", "value", "n"])

    parts = stash(rows.unionByName(heads).groupBy("shard").applyInArrow(compare, "part string, lang string, source string, item string, value long, n long"), "parts")
    met = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("n").alias("met"))
    one = facts.withColumn("zero", 1 + F.expr("5000000000 div greatest(n + 5 * v, 1)"))
    a = one.select("lang", "source", "v", F.col("zero").alias("zero_a"))
    b = one.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"))
    both = a.join(b, "lang").filter("source < item").join(met, ["lang", "source", "item"], "left")
    rest = (F.col("v") - F.coalesce("met", F.lit(0))) * F.abs(F.col("zero_a") - F.col("zero_b"))
    value = F.coalesce("value", F.lit(0)) + rest
    pairs = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), value.alias("value")).select("lang", "p.*", F.lit("pair").alias("part"), "value")
    terms = parts.filter("part = 'term'").select("lang", "source", "item", "part", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).unionByName(pairs.withColumn("rank", F.row_number().over(order)))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
