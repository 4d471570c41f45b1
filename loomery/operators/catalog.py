"""Catalogue operators: search, ranking, grouping, embeds, active lists and the site map."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import category_label
from ..functions.text import WHITE_TEXT

LAST = 2**53 - 1


def merged_rank_key() -> Column:
    """Featured place and popularity rank on one scale."""
    return F.coalesce(F.col("featured").cast("long"), F.col("popularity_rank").cast("long"), F.lit(LAST))


def merged_rank() -> list[Column]:
    """Featured place and popularity rank on one scale, then score, title and id."""
    return [merged_rank_key().asc(), F.coalesce("popularity_score", F.lit(-1.0)).desc(), F.collate("title", "UNICODE").asc(), F.col("id").asc()]


def stored_order() -> list[Column]:
    """Any featured tool first, then rank, score and name; nulls last throughout."""
    return [F.asc_nulls_last("featured"), F.asc_nulls_last("popularity_rank"), F.desc_nulls_last("popularity_score"), F.asc("name"), F.asc("id")]


def live_tools(tools: DataFrame, versions: DataFrame) -> DataFrame:
    """The live tools with the fields of their live version, and their place in the stored order. A tool without such a version isn't shown.

    versions: id and the fields; the tools' own columns win where names clash. Status and the version's presence are filtered before the join.
    """
    v = versions.select(F.col("id").alias("__version"), *[c for c in versions.columns if c != "id" and c not in tools.columns])
    shown = tools.filter((F.col("status") == "live") & F.col("live_version_id").isNotNull()).join(v, F.col("live_version_id") == F.col("__version")).drop("__version")
    return placed(shown)


def _band(score: Column) -> Column:
    """A whole number that never falls as a score falls: 64 bands for each doubling. Without a score the last."""
    return F.coalesce(-F.floor(F.signum(score) * F.log2(F.abs(score) + 1) * 64).cast("long"), F.lit(LAST))


def _places(rows: DataFrame, group: list[str], coarse: dict[str, Column], fine: list[Column]) -> DataFrame:
    """Adds place: within a group, by the coarse keys (ascending, nulls last), then by the fine ones.

    Rows are sorted within a group and its coarse keys only, and the counts of the keys before are added, so no task sorts a whole group, however many rows it has.
    The coarse keys must follow the order of the fine ones.
    """
    keys = list(coarse)
    cut = rows.withColumns(coarse)
    counts = cut.groupBy(*group, *keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(*[F.asc_nulls_last(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate([*group, *keys])], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*fine))
    same = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate([*group, *keys])]
    joined = cut.withColumn("__within", within).join(starts, same)
    return joined.select(*rows.columns, (F.col("__start") + F.col("__within")).alias("place"))


def placed(tools: DataFrame) -> DataFrame:
    """Adds each tool's place in the stored order."""
    coarse = {"__featured": F.col("featured"), "__rank": F.col("popularity_rank"), "__band": _band(F.col("popularity_score"))}
    return _places(tools, [], coarse, [F.desc_nulls_last("popularity_score"), F.asc("name"), F.asc("id")])


def storefront(tools: DataFrame, category: str | None = None, least: int = 9, k: int = 6) -> DataFrame:
    """Tools with their section. A category that the catalogue has shows its tools alone, in the grid; an unknown one counts as none. Without one, a popular
    strip of k comes first from `least` tools on, else all stand in the grid.

    The category and the number of tools are looked up inside the plan, as scalar subqueries: no job runs while it is made.
    """
    strip = popular(tools, k).select(F.col("id").alias("__id"))
    seen = tools.join(F.broadcast(strip), F.col("id") == F.col("__id"), "left").withColumn("__strip", F.col("__id").isNotNull()).drop("__id")
    unknown = F.lit(True)
    if category:
        unknown = tools.filter(F.col("category") == category).agg(F.count("*") == 0).scalar()
        seen = seen.filter((F.col("category") == category) | unknown)
    many = tools.agg(F.count("*") >= least).scalar()
    return seen.withColumn("section", F.when(unknown & many & F.col("__strip"), "popular").otherwise("grid")).drop("__strip")


def search(tools: DataFrame, query: str | None = None, category: str | None = None, limit: int = 8) -> DataFrame:
    """The tools that hold most of the query's terms (repeated terms count again), best first. No query: all tools, score 0.

    Where the catalogue has keywords, they are searched too; where it has a description for search engines, credits, an input schema or examples, the
    result shows them.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    terms = [t for t in re.split(f"[{WHITE_TEXT}]+", (query or "").lower()) if t]
    if category:
        tools = tools.filter(F.col("category") == category)
    has = lambda c: c in tools.columns
    keywords = [F.array_join("keywords", " ")] if has("keywords") else []
    text = F.lower(F.concat_ws(" ", "name", "title", "description", *keywords, category_label(F.col("category"))))
    matches = F.lit(0)
    for t in terms:
        matches = matches + F.contains(text, F.lit(t)).cast("int")
    found = tools.withColumn("matches", matches)
    if terms:
        found = found.filter("matches > 0")
    best = found.orderBy(F.desc("matches"), *merged_rank()).limit(limit)
    shown = [F.coalesce("seo_description", "description").alias("description")] if has("seo_description") else []
    shown += [c for c in ("credits_estimate", "input_schema", "examples") if has(c)]
    return best.select("id", "name", "title", "category", category_label(F.col("category")).alias("category_label"), *shown, "matches")


def popular(tools: DataFrame, k: int = 6) -> DataFrame:
    return tools.orderBy(*merged_rank()).limit(k)


def grid_without_popular(tools: DataFrame, k: int = 6) -> DataFrame:
    """All tools but the popular ones. The k ids are few, so they are broadcast."""
    return tools.join(F.broadcast(popular(tools, k).select("id")), "id", "left_anti")


def categories(tools: DataFrame) -> DataFrame:
    """Each tool with its category's label, size and place among categories, and its own place in the category.

    A category's place follows its best tool. Categories are ranked from one row each; places within a category are counted by rank and band of scores.
    """
    key = F.struct(merged_rank_key().alias("a"), (-F.coalesce("popularity_score", F.lit(-1.0))).alias("b"), F.collate("title", "UNICODE").alias("c"), F.col("id").alias("d"))
    groups = tools.groupBy("category").agg(F.count("*").alias("tool_count"), F.min(key).alias("best"))
    ranked = groups.select("category", "tool_count", F.row_number().over(Window.orderBy("best")).alias("category_place"))
    coarse = {"__first": merged_rank_key(), "__band": _band(F.coalesce("popularity_score", F.lit(-1.0)))}
    out = _places(tools, ["category"], coarse, merged_rank()).select("id", "category", "place").join(ranked, "category")
    return out.select("category", category_label(F.col("category")).alias("label"), "tool_count", "category_place", "place", "id")


def embed_latest(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each parent with its child of the greatest order (a struct, null without children) and the number of its children.

    Children are reduced before the join, so no parent's children are collected.
    """
    latest = F.max_by(F.struct(*fields), F.struct(*order)).alias("latest")
    return parents.join(children.groupBy(key).agg(latest, F.count("*").alias("n_children")), key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def active(as_of: Column, expires: str = "expires_at", revoked: str = "revoked_at", deleted: str = "deleted_at") -> Column:
    """Neither revoked nor deleted, and expiring after as_of."""
    return F.col(revoked).isNull() & F.col(deleted).isNull() & (F.col(expires) > as_of)


def sitemap(static: DataFrame, tools: DataFrame, posts: DataFrame) -> DataFrame:
    """Static pages, tools and posts under one schema: url, last_modified, change_frequency, priority."""
    t = tools.select(
        F.concat(F.lit("/tools/"), F.col("id").cast("string")).alias("url"),
        F.col("validated_at").alias("last_modified"),
        F.lit("weekly").alias("change_frequency"),
        F.when((F.col("popularity_rank") > 0) & (F.col("popularity_rank") <= 6), 0.85).otherwise(0.75).alias("priority"),
    )
    p = posts.select(F.concat(F.lit("/blog/"), F.col("slug")).alias("url"), F.col("published_at").alias("last_modified"), F.lit("monthly").alias("change_frequency"), F.lit(0.6).alias("priority"))
    return static.unionByName(t, allowMissingColumns=True).unionByName(p)
