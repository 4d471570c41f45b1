"""Look-ups in account tables: one row by a key, checked as the plan runs, in a batch form for many keys at once.

A look-up by one key is a filter that reaches the scan, then maybe_one or exactly_one. For many keys the requests are joined to the table, whose rows are counted
by key first (see one_for_each), so that a key with too many rows is an error and not a wrong answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cardinality import exactly_one, maybe_one, one_for_each


def tool_by_name(tools: DataFrame, name: str) -> DataFrame:
    """The tool of a name, if there is one."""
    return maybe_one(tools.filter(F.col("name") == name), f"tool {name}")


def version_by_id(versions: DataFrame, version_id: int) -> DataFrame:
    """The version of an id, which must be there."""
    return exactly_one(versions.filter(F.col("id") == version_id), f"version {version_id}")


def key_by_id(keys: DataFrame, key_id: int, user_id: int) -> DataFrame:
    """A user's own key of an id, if there is one."""
    return maybe_one(keys.filter((F.col("id") == key_id) & (F.col("user_id") == user_id)), f"key {key_id}")


def keys_of_kind(keys: DataFrame, kind: str) -> DataFrame:
    """Each user's keys of a kind, the newest first, with their place."""
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("created_at"), "id")
    return keys.filter(F.col("kind") == kind).withColumn("place", F.row_number().over(order))


def client_names(grants: DataFrame, clients: DataFrame, otherwise: str = "client") -> DataFrame:
    """Grants with their client's name, another where the client is unknown or has none."""
    named = one_for_each(grants, clients.select("client_id", "client_name"), ["client_id"])
    return named.withColumn("client_name", F.coalesce("client_name", F.lit(otherwise)))


def subscription_of(requests: DataFrame, subs: DataFrame, by: str) -> DataFrame:
    """Each request with its subscription by user or by customer; null where there is none, an error where there are several."""
    return one_for_each(requests, subs, [by])


def with_address(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Alerts with the address of their user; an alert whose user has none (or a blank one) can't be sent and goes."""
    known = users.filter(F.trim("email") != "").select("user_id", "email")
    return one_for_each(alerts, known, ["user_id"]).filter("email is not null")


def tagged(events: DataFrame, tag: Column, handlers: dict[str, Column]) -> DataFrame:
    """Events with what the handler of their tag makes of them, and whether one took them: tags without a handler are kept, as received and ignored."""
    chain = None
    for name, value in handlers.items():
        chain = F.when(tag == name, value) if chain is None else chain.when(tag == name, value)
    handled = F.coalesce(tag.isin(*handlers), F.lit(False))
    return events.withColumn("handled", handled).withColumn("outcome", F.lit(None).cast("string") if chain is None else chain)


def shown_texts(tools: DataFrame) -> DataFrame:
    """Title and description to show: those meant for search engines where they aren't blank, else the tool's own."""
    first = lambda a, b: F.coalesce(F.when(F.trim(F.col(a)) != "", F.col(a)), F.col(b))
    return tools.withColumn("shown_title", first("seo_title", "title")).withColumn("shown_description", first("seo_description", "description"))
