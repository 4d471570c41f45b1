"""Shapes captured fetch results: pages, JSON bodies, network calls and stream values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_or_text, json_text, truncated


def fetch_result(pages: DataFrame, most: int = 60_000) -> DataFrame:
    """The page's text cut at `most` characters, with the flag and its size in bytes."""
    body, cut = truncated(F.col("html"), most)
    return pages.select("page_id", "url", body.alias("html"), cut.alias("html_truncated"), F.octet_length("html").alias("body_bytes"))


# The fields of a fetched page, in order; content and its flag follow.
PAGE_FIELDS = (
    "status", "final_url", "title", "blocked", "block_reason", "attempts", "transport", "timing_ms", "proxy_used", "cache_status", "content_type", "content_kind", "body_bytes", "body_truncated",
    "headers",
)


def page_result(fetched: DataFrame, key: list[str], markup: bool, most: int = 60_000) -> DataFrame:
    """A fetched page as it is returned: its fields (null where the capture lacks one), then content (html or body_text, empty if there is none) cut at `most` characters."""
    body = F.coalesce(F.col("html" if markup else "body_text"), F.lit(""))
    content, cut = truncated(body, most)
    field = lambda c: F.col(c) if c in fetched.columns else F.lit(None).alias(c)
    return fetched.select(*key, *[field(c) for c in PAGE_FIELDS], content.alias("content"), cut.alias("content_truncated"))


def json_result(rows: DataFrame, body: str, most: int = 60_000) -> DataFrame:
    """The JSON value where the body parses; the text only where it doesn't."""
    value = F.try_parse_json(F.col(body))
    ok = value.isNotNull()
    return rows.withColumn("json_parse_ok", ok).withColumn("json", json_text(F.col(body))).withColumn("body_text", F.when(~ok, F.left(body, F.lit(most))))


def network_calls(calls: Column, include_bodies: bool, most: int = 4000) -> Column:
    """Each captured call with method, url, status and kind; bodies only if asked for, so they are otherwise never read."""

    def one(e: Column) -> Column:
        parts = [e["method"].alias("method"), e["url"].alias("url"), e["status"].alias("status")]
        if include_bodies:
            text, cut = truncated(json_or_text(e["json"], e["body_text"]), most)
            parts += [text.alias("body"), cut.alias("body_truncated")]
        return F.struct(*parts)

    return F.transform(calls, one)


def first_events(events: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` events of each key. Spark keeps no more than that of a key in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return events.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def stream_values(values: Column, most_events: int, most_chars: int) -> Column:
    """The first events of a stream, each value cut."""
    return F.transform(F.slice(values, 1, most_events), lambda v: F.struct(*[x.alias(n) for x, n in zip(truncated(v, most_chars), ("value", "truncated"), strict=True)]))


def cut_bytes(data: Column, most: int) -> Column:
    """The longest start of a UTF-8 text (binary) of at most `most` bytes that splits no character; null if the bytes are no UTF-8 text."""
    # A character has four bytes at most, so one of these ends between two.
    starts = [F.try_validate_utf8(F.substring(data, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    return F.when(F.is_valid_utf8(data.cast("string")), F.coalesce(*starts))


def bounded_values(values: Column, most_events: int, most_bytes: int) -> Column:
    """The first events of a stream (an array of binaries), each with at most most_bytes bytes: value for texts, value_base64 for bytes that are no text, bytes
    (of the whole value) and truncated."""

    def one(v: Column) -> Column:
        text = cut_bytes(v, most_bytes)
        other = F.when(text.isNull(), F.base64(F.substring(v, 1, most_bytes)))
        return F.struct(text.alias("value"), other.alias("value_base64"), F.octet_length(v).alias("bytes"), (F.octet_length(v) > most_bytes).alias("truncated"))

    return F.transform(F.slice(values, 1, most_events), one)
