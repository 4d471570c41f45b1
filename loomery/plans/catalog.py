"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import category_label, clipped
from ..operators import catalog as C
from ..sources.tables import TOOLS_SQL, read, tools
from .registry import query

LABEL = "array_to_string(list_transform(list_filter(string_split({0}, '-'), lambda p: p <> ''), lambda p: upper(p[1]) || substr(p, 2)), ' ')"
MERGED = "coalesce(featured, popularity_rank, 9007199254740991), coalesce(popularity_score, -1) DESC, title, id"


@query(
    "catalog_search",
    f"""
WITH t AS ({TOOLS_SQL}), h AS (SELECT *, lower(concat_ws(' ', name, title, description, {LABEL.format("category")})) AS hay FROM t), m AS (
  SELECT *, contains(hay, 'red')::INT + contains(hay, 'bolt')::INT + contains(hay, 'brand#1')::INT + contains(hay, 'red')::INT AS matches FROM h)
SELECT id, name, title, category, {LABEL.format("category")} AS category_label, matches FROM m WHERE matches > 0 ORDER BY matches DESC, {MERGED} LIMIT 8""",
)
def catalog_search(spark, d):
    """Scored search: tokenise, match, rank, top 8."""
    return C.search(tools(spark, d), "  red BOLT  Brand#1 red ")


@query("catalog_search_category", f"WITH t AS ({TOOLS_SQL}) SELECT id, name, title, category, {LABEL.format('category')} AS category_label, 0 AS matches FROM t WHERE category = 'promo' ORDER BY {MERGED} LIMIT 20")
def catalog_search_category(spark, d):
    """Search without terms within one category."""
    return C.search(tools(spark, d), None, "promo", 20)


@query(
    "catalog_live_order",
    f"WITH t AS ({TOOLS_SQL}) SELECT id, name, row_number() OVER (ORDER BY featured ASC NULLS LAST, popularity_rank ASC NULLS LAST, popularity_score DESC NULLS LAST, name, id) AS place FROM t WHERE popularity_score IS NOT NULL",
)
def catalog_live_order(spark, d):
    """Every tool's place in the stored four-key order."""
    return C.placed(tools(spark, d).filter("popularity_score is not null")).select("id", "name", "place")


@query(
    "catalog_storefront",
    f"WITH t AS ({TOOLS_SQL}) SELECT id, CASE WHEN (SELECT count(*) FROM t) >= 9 AND id IN (SELECT id FROM t ORDER BY {MERGED} LIMIT 6) THEN 'popular' ELSE 'grid' END AS section FROM t",
)
def catalog_storefront(spark, d):
    """The popular strip and the grid; an unknown facet is no filter."""
    return C.storefront(tools(spark, d), "no such category").select("id", "section")


_RICH = f"SELECT *, ['kw' || id % 7, 'Extra'] AS keywords, CASE WHEN id % 2 = 0 THEN 'seo ' || name END AS seo_description, (id % 50)::INT AS credits_estimate FROM ({TOOLS_SQL})"


@query(
    "catalog_search_full",
    f"""
WITH t AS ({_RICH}), h AS (SELECT *, lower(concat_ws(' ', name, title, description, array_to_string(keywords, ' '), {LABEL.format("category")})) AS hay FROM t), m AS (
  SELECT *, contains(hay, 'kw3')::INT + contains(hay, 'extra')::INT + contains(hay, 'bolt')::INT AS matches FROM h)
SELECT id, name, title, category, {LABEL.format("category")} AS category_label, coalesce(seo_description, description) AS description, credits_estimate, matches FROM m WHERE matches > 0 ORDER BY matches DESC, {MERGED} LIMIT 20""",
)
def catalog_search_full(spark, d):
    """Search that reads keywords too and shows descriptions and credits."""
    i = F.col("id")
    keywords = F.array(F.concat(F.lit("kw"), i % 7), F.lit("Extra"))
    rich = tools(spark, d).withColumns({"keywords": keywords, "seo_description": F.when(i % 2 == 0, F.concat(F.lit("seo "), "name")), "credits_estimate": (i % 50).cast("int")})
    return C.search(rich, "KW3 extra bolt", None, 20)


@query("catalog_popular_top6", f"WITH t AS ({TOOLS_SQL}) SELECT id, title, featured, popularity_rank FROM t ORDER BY {MERGED} LIMIT 6")
def catalog_popular_top6(spark, d):
    """The merged ranking's first six."""
    return C.popular(tools(spark, d)).select("id", "title", "featured", "popularity_rank")


@query(
    "catalog_categories",
    f"""
WITH t AS ({TOOLS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {MERGED}) AS place, count(*) OVER (PARTITION BY category) AS tool_count FROM t),
best AS (SELECT category, row_number() OVER (ORDER BY {MERGED}) AS category_place FROM r WHERE place = 1)
SELECT category, {LABEL.format("category")} AS label, tool_count, category_place::INT AS category_place, place::INT AS place, id FROM r JOIN best USING (category)""",
)
def catalog_categories(spark, d):
    """Tools by category, categories by their best tool."""
    return C.categories(tools(spark, d))


@query("catalog_grid_minus_popular", f"WITH t AS ({TOOLS_SQL}) SELECT id, title FROM t WHERE id NOT IN (SELECT id FROM t ORDER BY {MERGED} LIMIT 6)")
def catalog_grid_minus_popular(spark, d):
    """The grid below the popular strip."""
    return C.grid_without_popular(tools(spark, d)).select("id", "title")


@query("catalog_facets", f"WITH t AS ({TOOLS_SQL}) SELECT category, {LABEL.format('category')} AS label, count(*) AS n FROM t GROUP BY category")
def catalog_facets(spark, d):
    """Distinct categories with counts, for the facet guard."""
    return tools(spark, d).groupBy("category").agg(F.count("*").alias("n")).select("category", category_label(F.col("category")).alias("label"), "n")


@query(
    "category_labels",
    """
WITH s AS (SELECT DISTINCT lower(replace(n_name, '_', '-')) AS slug FROM nation UNION SELECT unnest(['content', 'ecommerce', 'leads', 'search', 'social', '--a--bC-', '']))
SELECT slug, coalesce(map {'content': 'Content extraction', 'ecommerce': 'Ecommerce', 'leads': 'Lead generation', 'search': 'Search', 'social': 'Social'}[slug],
"""
    + LABEL.format("slug")
    + ") AS label FROM s",
)
def category_labels(spark, d):
    """Known labels, else the slug in title case."""
    slugs = read(spark, d, "nation").select(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug")).distinct()
    known = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("content", "ecommerce", "leads", "search", "social", "--a--bC-", "")])).alias("slug"))
    return slugs.union(known).distinct().select("slug", category_label(F.col("slug")).alias("label"))


@query("example_clip", "SELECT doc_id, CASE WHEN length(text) > 48 THEN left(text, 47) || '…' ELSE text END AS example FROM documents")
def example_clip(spark, d):
    """Example values cut at 48 characters."""
    return read(spark, d, "documents").select("doc_id", clipped(F.col("text")).alias("example"))


@query("fk_embed_to_one", "SELECT s_suppkey, s_name, n_name AS nation_name, n_regionkey AS nation_region FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal IS NOT NULL")
def fk_embed_to_one(spark, d):
    """To-one embed, flattened; unmatched rows go."""
    s, n = read(spark, d, "supplier").filter("s_acctbal is not null"), read(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "s_name", F.col("n_name").alias("nation_name"), F.col("n_regionkey").alias("nation_region"))


@query(
    "fk_embed_to_many",
    """
SELECT c_custkey, coalesce(n, 0) AS n_children, o.latest_key AS latest_key, o.latest_status AS latest_status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_status FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""",
)
def fk_embed_to_many(spark, d):
    """To-many embed reduced to its newest element."""
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    got = C.embed_latest(read(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return got.select("c_custkey", "n_children", F.col("latest.o_orderkey").alias("latest_key"), F.col("latest.o_orderstatus").alias("latest_status"))


@query("keys_active_count", "SELECT o_custkey AS user_id, count(*) AS keys, count(*) FILTER (o_orderstatus <> 'F') AS active_keys, count(*) FILTER (o_orderstatus <> 'F') >= 10 AS at_cap FROM orders GROUP BY o_custkey")
def keys_active_count(spark, d):
    """Exact filtered counts against a cap of ten."""
    live = F.count_if(F.col("o_orderstatus") != "F")
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("keys"), live.alias("active_keys")).withColumn("at_cap", F.col("active_keys") >= 10)


_SESSIONS = """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS last_used_at, o_orderdate + INTERVAL 7 DAY AS expires_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS revoked_at, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS deleted_at FROM orders"""


def _sessions(spark, d):
    o = read(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("last_used_at"),
        (F.col("o_orderdate") + F.expr("interval 7 days")).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("deleted_at"),
    )


@query("sessions_active_list", f"WITH s AS ({_SESSIONS}) SELECT id, user_id, last_used_at, row_number() OVER (PARTITION BY user_id ORDER BY last_used_at DESC NULLS FIRST, id) AS place FROM s WHERE revoked_at IS NULL AND deleted_at IS NULL AND expires_at > TIMESTAMP '1999-01-01'")
def sessions_active_list(spark, d):
    """Active sessions, the most recently used first."""
    s = _sessions(spark, d).filter(C.active(F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))))
    place = F.row_number().over(C.Window.partitionBy("user_id").orderBy(F.desc_nulls_first("last_used_at"), "id"))
    return s.select("id", "user_id", "last_used_at", place.cast("long").alias("place"))


@query("semi_revoke_previous", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_revoke_previous(spark, d):
    """Keys of earlier grants, by semi-join."""
    return read(spark, d, "customer").select("c_custkey", "c_name").join(read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("latest_subscription", "SELECT o_custkey AS user_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey")
def latest_subscription(spark, d):
    """One row of several, made deterministic: the newest."""
    return read(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("id"))


@query(
    "sitemap_union",
    """
SELECT url, NULL::TIMESTAMP AS last_modified, f AS change_frequency, p AS priority FROM (VALUES ('/', 'weekly', 1.0::DOUBLE), ('/docs', 'weekly', 0.9), ('/tools', 'daily', 0.9), ('/blog', 'weekly', 0.7)) v(url, f, p)
UNION ALL SELECT '/tools/' || s_suppkey, TIMESTAMP '2024-01-01', 'weekly', CASE WHEN s_nationkey > 0 AND s_nationkey <= 6 THEN 0.85 ELSE 0.75 END FROM supplier
UNION ALL SELECT '/blog/' || lower(n_name), TIMESTAMP '2024-01-01', 'monthly', 0.6 FROM nation""",
)
def sitemap_union(spark, d):
    """Static pages, tools and posts in one list."""
    static = spark.createDataFrame([("/", "weekly", 1.0), ("/docs", "weekly", 0.9), ("/tools", "daily", 0.9), ("/blog", "weekly", 0.7)], "url string, change_frequency string, priority double")
    day = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    t = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), day.alias("validated_at"), F.col("s_nationkey").alias("popularity_rank"))
    p = read(spark, d, "nation").select(F.lower("n_name").alias("slug"), day.alias("published_at"))
    return C.sitemap(static, t, p)
