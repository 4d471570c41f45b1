"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources in code-point order (null last) get cyclic weights and share a total by them; no target passes a multiple of its
source's size, and what that frees is shared anew by weight among the rest (water-filling, solved in closed form).

Copies: a document expects target / source_size copies. Within its source, documents lie in a fixed order - by falling size
class, then a hash of id and text - and their expected copies are summed up from the first. One random offset is added, and a document is emitted once for
each integer its interval passes. Since sizes fall along the order, a source's taken size differs from its target by about
one of its largest documents at most.

Expected copies are fixed-point integers, so sums don't depend on how tasks add up. The prefix sum has two levels: a
source is cut into about sqrt(n) buckets, bucket sums are added up in a small table, and rows within their bucket. No task holds a whole source.

Sizes count words (runs of characters other than space and 0x09-0x0D) of whole texts, however long; null and empty texts have size 0, take part and never count. Rows
of equal id and text (repeated rows) are interchangeable and share a bucket; null or repeated ids with other texts don't. Another seed draws other offsets. Nulls in source form a source of their own. Extra columns of any
name are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import words_of
from .shared import stash

#: One expected copy in fixed point.
ONE = 1 << 24


def size_class(size: Column) -> Column:
    """Sizes in steps of an eighth of a power of two, by integer operations: at most 512 classes."""
    bits = F.length(F.bin(size))
    low = F.greatest(bits - 4, F.lit(0))
    return (bits * 8 + (F.call_function("shiftright", size, low) % 8).cast("int")).cast("int")


def hash_hex(seed: str, *values: Column) -> Column:
    """An MD5 in hex, which other engines can compute too."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(v.cast("string"), F.lit("null")) for v in values]))


def leading32(hex_: Column) -> Column:
    """The first 32 bits of a hash."""
    return F.conv(F.substring(hex_, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], total: float, most: float, seed: int = 0) -> DataFrame:
    """source, source_size, target, rate (expected copies, fixed point) and offset: a row for each source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sums.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * total - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    ratio = F.col("cap") / F.col("weight")
    level = ranked.withColumn("level", left / open_weight).withColumn("fits", F.col("level") <= ratio)
    first = F.min(F.when(F.col("fits"), F.struct(ratio, "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE + 0.5)).otherwise(0).cast("long")
    offset = leading32(hash_hex(f"mix{seed or ''}", F.col("source"))) % ONE
    return level.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"), offset.alias("offset"))


def systematic_copies(rows: DataFrame, group: str, expected: str, offset: str, strata: str, key: str) -> DataFrame:
    """Adds copies to rows: within a group, in the order (strata falling, key), by the prefix sums of expected plus offset. key: a hash in hex."""
    keyed = rows.withColumn("h", leading32(F.col(key)))
    n = keyed.groupBy(group, strata).agg(F.ceil(F.sqrt(F.count("*"))).alias("parts"))
    keyed = _join(keyed, n, [group, strata]).withColumn("part", F.shiftright(F.col("h") * F.col("parts"), 32))
    bucket = [group, strata, "part"]
    sums = keyed.groupBy(*bucket).agg(F.sum(expected).alias("bucket_sum"))
    before = Window.partitionBy(group).orderBy(F.col(strata).desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_sum").over(before), F.lit(0))).drop("bucket_sum")
    within = Window.partitionBy(*bucket).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    summed = _join(keyed.withColumn("inner", F.sum(expected).over(within)), sums, bucket)
    end = F.col("bucket_start") + F.col("inner") + F.col(offset)
    copies = F.floor(end / ONE) - F.floor((end - F.col(expected)) / ONE)
    return summed.withColumn("copies", copies).drop("h", "parts", "part", "inner", "bucket_start")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    right = right.select([F.col(k).alias(f"{k}__r") for k in keys] + [c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    return left.join(right, on).drop(*[f"{k}__r" for k in keys])


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), total: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """id, size, source_size, target, copies and taken (copies * size) of every row."""
    size = F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long")
    key = hash_hex("order", F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "sizes")
    targets = source_targets(rows, weights, total, most, seed)
    dealt = _join(rows.withColumn("class", size_class(F.col("size"))), targets, ["source"])
    copied = systematic_copies(dealt, "source", "rate", "offset", "class", "key")
    out = copied.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    out.behind = [rows]
    return out
