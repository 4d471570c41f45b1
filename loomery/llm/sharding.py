"""A uniform shuffle into shards of exact sizes, in DataFrame functions only.

Rows fall into local buckets by a hash. A communication matrix says how many rows of each bucket go to each shard: it is drawn
from the multivariate hypergeometric law that a uniform permutation of all rows would give, row by row, so that its columns sum
to the exact shard sizes (at most one row apart). Within a bucket rows are permuted (ordered by a hash) and cut at the
row's counts; within a shard they are permuted again by another hash, which gives the slots.

The matrix has 4 sqrt(n) rows, one for each bucket, drawn on the driver and written as a table. Both permutations work on parts of about sqrt(n)
rows: buckets, and slices of a shard by ranges of the second hash, whose counts are added up in a small table.

Null ids and texts are allowed (a null text has no bytes); very long texts count by their bytes. Equal rows are interchangeable and get places of their own, but
share a bucket, as their hashes are equal. Extra columns of any name are ignored. An empty table gives an empty result. The same input and seed give the same places.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, stash


def hypergeometric(rnd: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good items are among draws from good + bad. Inversion from the mode outwards: steps grow with the deviation."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    lg = math.lgamma
    pick = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(pick(good, mode) + pick(bad, draws - mode) - pick(good + bad, draws))
    u = rnd.random() - p
    left, right, at_left, at_right = p, p, mode, mode
    while u > 0:
        moved = False
        if at_right < high:
            right *= (good - at_right) * (draws - at_right) / ((at_right + 1) * (bad - draws + at_right + 1))
            at_right, moved = at_right + 1, True
            u -= right
            if u <= 0:
                return at_right
        if at_left > low:
            left *= at_left * (bad - draws + at_left) / ((good - at_left + 1) * (draws - at_left + 1))
            at_left, moved = at_left - 1, True
            u -= left
            if u <= 0:
                return at_left
        if not moved or (right < 1e-300 and left < 1e-300):
            return mode  # rounding ate the rest of the mass
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, as a uniform permutation would deal them."""
    rnd, left, out = random.Random(seed), list(columns), []
    for n in rows:
        pool, need, line = sum(left), n, []
        for j, c in enumerate(left):
            k = hypergeometric(rnd, c, pool - c, need)
            line.append(k)
            pool, need, left[j] = pool - c, need - k, c - k
        out.append(line)
    return out


def shard_uniformly(docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes and 8 more), text_crc32, shard and slot (from 0 without gaps) of every row."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    spark, rows = docs.sparkSession, stash(rows, "rows")
    total = rows.count()
    n_buckets = max(1, 4 * math.isqrt(total))
    n_slices = max(1, 4 * math.isqrt(total // shards))
    hashed = rows.withColumn("h1", F.xxhash64(F.lit(seed), "id", "text_crc32")).withColumn("h2", F.xxhash64(F.lit(seed + 1), "text_crc32", "id"))
    hashed = hashed.withColumn("bucket", F.pmod(F.xxhash64("h1"), F.lit(n_buckets)).cast("int"))
    found = {r.bucket: r["count"] for r in hashed.groupBy("bucket").count().collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([found.get(b, 0) for b in range(n_buckets)], sizes, seed)
    ends = [[sum(line[: j + 1]) for j in range(shards)] for line in matrix]
    # About sqrt(n) rows; a table, so that no plan holds them. Spark broadcasts it while it is small.
    cuts = stash(spark.createDataFrame(list(enumerate(ends)), "bucket int, ends array<long>"), "matrix")
    local = Window.partitionBy("bucket").orderBy("h1", F.col("id").asc_nulls_first(), "text_crc32", "size")
    dealt = hashed.withColumn("place", F.row_number().over(local) - 1).join(cuts, "bucket")
    passed = F.filter("ends", lambda end: end <= F.col("place"))
    dealt = dealt.withColumn("shard", F.size(passed)).withColumn("slice", F.shiftright(F.shiftrightunsigned(F.col("h2"), 33) * n_slices, 31).cast("int"))
    dealt = stash(dealt.drop("bucket", "place", "h1", "ends"), "dealt")
    free(rows, cuts)
    counts = dealt.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "slice").orderBy("h2", F.col("id").asc_nulls_first(), "text_crc32", "size")
    placed = dealt.withColumn("inner", F.row_number().over(inner) - 1).join(starts, ["shard", "slice"])
    slot = (F.col("start") + F.col("inner")).cast("long")
    out = placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot.alias("slot"))
    out.behind = [dealt]
    return out
