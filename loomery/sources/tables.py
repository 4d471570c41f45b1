"""Table access: the driver's Parquet tables, and the views of them that stand in for catalogue and account tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt out by its key, for plans whose rows cost far more than their bytes: a small file of many rows is one or two tasks if it is read as it lies.

    The number of parts is the session's, and stated, as adaptive execution would join parts again by their bytes.
    """
    return read(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


# Who may read what: the column that names a row's owner, or the owned table and key that a row belongs to; public tables belong to nobody.
OWNED = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}
THROUGH = {"lineitem": ("l_orderkey", "orders", "o_orderkey")}
PUBLIC = frozenset({"region", "nation", "part", "supplier"})


class Scope:
    """Tables as one owner may see them: every scan has the owner's predicate, and a table that no policy names can't be read.

    The predicate stands right above the scan, so it is pushed into it. A plan that is given a scope and no path can't leave it out.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, owner):
        if owner is None:
            raise ValueError("a scope needs an owner")
        self._read, self.owner = lambda name: read(spark, sf_dir, name), owner

    def table(self, name: str) -> DataFrame:
        if name in OWNED:
            return self._read(name).filter(F.col(OWNED[name]) == F.lit(self.owner))
        if name in THROUGH:
            own, parent, key = THROUGH[name]
            return self._read(name).join(self.table(parent).select(F.col(key).alias(own)), own, "left_semi")
        if name in PUBLIC:
            return self._read(name)
        raise PermissionError(f"no policy for {name}")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, from part."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.col("p_brand").alias("description"),
        F.lower("p_type").alias("category"),
        F.when(F.col("p_size") <= 5, F.col("p_size")).alias("featured"),
        F.when(F.col("p_size") > 25, F.col("p_size")).alias("popularity_rank"),
        F.col("p_retailprice").alias("popularity_score"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, from customer: the market segment sets the tier; a negative balance stands for an account without billing."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        tier_of_segment().alias("tier"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("sub_"), F.col("c_custkey").cast("string"))).alias("subscription_id"),
        F.when(F.col("c_custkey") % 5 != 0, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).alias("period_start"),
        F.when(F.col("c_custkey") % 5 != 0, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))).alias("period_end"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("canceled")).otherwise(F.lit("active")).alias("status"),
    )


def tier_of_segment():
    s = F.col("c_mktsegment")
    return F.when(s == "MACHINERY", "starter").when(s == "BUILDING", "pro").when(s == "AUTOMOBILE", "scale").when(s == "FURNITURE", "internal").otherwise("free")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, period_start (month) and calls, counted from events."""
    e = read(spark, sf_dir, "events")
    month = F.date_trunc("MONTH", "ts").cast("timestamp_ntz")
    return e.groupBy("user_id", month.alias("period_start")).agg(F.count("*").alias("calls"))


TOOLS_SQL = """SELECT p_partkey AS id, p_name AS name, p_name || ' ' || p_brand AS title, p_brand AS description, lower(p_type) AS category,
  CASE WHEN p_size <= 5 THEN p_size END AS featured, CASE WHEN p_size > 25 THEN p_size END AS popularity_rank, p_retailprice AS popularity_score FROM part"""

SUBS_SQL = """SELECT c_custkey AS user_id,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'starter' WHEN 'BUILDING' THEN 'pro' WHEN 'AUTOMOBILE' THEN 'scale' WHEN 'FURNITURE' THEN 'internal' ELSE 'free' END AS tier,
  CASE WHEN c_custkey % 3 <> 0 THEN 'sub_' || c_custkey END AS subscription_id,
  CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' END AS period_start, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-02-01' END AS period_end,
  CASE WHEN c_custkey % 7 = 0 THEN 'canceled' ELSE 'active' END AS status FROM customer"""

USAGE_SQL = "SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS period_start, count(*) AS calls FROM events GROUP BY ALL"
