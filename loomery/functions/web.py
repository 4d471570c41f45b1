"""Functions on forms, headers, paths, errors and API results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Kinds of response bodies.
CONTENT_KINDS = ("html", "json", "text", "binary", "empty", "unknown")


def lookup(values: dict[str, str], key: Column) -> Column:
    """A constant map's value, null for unknown keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def error_text(code: Column, message: Column, hints: dict[str, str]) -> Column:
    """`code: message`, with the hint of a code that has one."""
    code = F.coalesce(code, F.lit("fetch_failed"))
    hint = lookup(hints, code)
    return F.concat(code, F.lit(": "), F.coalesce(message, F.lit("request failed")), F.coalesce(F.concat(F.lit(" "), hint), F.lit("")))


def outcome(ok: Column, blocked: Column, status: Column) -> Column:
    """api_error where the call itself failed, denied where the target refused, stale_status where a refusing status came with content, else ok."""
    return F.when(~F.coalesce(ok, F.lit(False)), "api_error").when(F.coalesce(blocked, F.lit(False)), "denied").when(status.isin(403, 503), "stale_status").otherwise("ok")


def content_kind(kind: Column) -> Column:
    return F.when(kind.isin(*CONTENT_KINDS), kind).otherwise("unknown")


def form_fields(body: Column, is_json: Column) -> Column:
    """A body of form pairs, or a JSON object, as a map of strings. Of equal names the last counts; a body that doesn't parse gives null."""

    def decode(x: Column) -> Column:
        return F.try_url_decode(x)

    pairs = F.transform(F.filter(F.split(body, "&"), lambda x: x != ""), lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), decode(F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).otherwise("")).alias("v")))
    later = lambda all_, p, i: F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["k"] == p["k"])
    last = F.get(F.transform(F.array(pairs), lambda a: F.filter(a, lambda p, i: p["k"].isNotNull() & ~later(a, p, i))), F.lit(0))
    return F.when(is_json, F.from_json(body, "map<string,string>")).otherwise(F.map_from_entries(last))


def merged_headers(own: Column, caller: Column) -> Column:
    """Two maps in one; the caller's values win."""
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(caller), k))
    return F.coalesce(F.map_concat(kept, caller), own, caller)


def first_of(values: Column) -> Column:
    """The first of a parameter's values, empty without any."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))


def text_params(params: Column) -> Column:
    """Of a map of variants, the entries that are strings."""
    kept = F.map_filter(params, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(kept, lambda _, v: F.try_variant_get(v, "$", "string"))


def set_query(url: Column, name: str, value: Column) -> Column:
    """The URL with a parameter set, before its fragment: the first of that name is replaced, further ones go, else it is added. Blank values set nothing.

    All parameters are written anew, as forms are: a space as +, and an equals sign after each name.
    """
    base, fragment = F.substring_index(url, "#", 1), F.when(F.contains(url, F.lit("#")), F.substr(url, F.instr(url, "#"))).otherwise("")
    path, query = F.substring_index(base, "?", 1), F.when(F.contains(base, F.lit("?")), F.substr(base, F.instr(base, "?") + 1)).otherwise("")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)

    def pair(x: Column) -> Column:
        given = F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).otherwise("")
        return F.struct(decoded(F.substring_index(x, "=", 1)).alias("k"), decoded(given).alias("v"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair)

    def put(all_: Column) -> Column:
        mine = F.array_position(F.transform(all_, lambda p: p["k"]), F.lit(name))
        once = F.filter(all_, lambda p, i: (p["k"] != name) | (i + 1 == mine))
        chosen = F.transform(once, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"] == name, value).otherwise(p["v"]).alias("v")))
        more = F.when(mine == 0, F.array(F.struct(F.lit(name).alias("k"), value.alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
        return F.array_join(F.transform(F.concat(chosen, more), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")

    return F.when(F.coalesce(value, F.lit("")) == "", url).otherwise(F.concat(path, F.lit("?"), let(pairs, put), fragment))


def safe_path(path: Column, otherwise: str = "/keys") -> Column:
    """A path of the same origin, else a fixed one: `//host` would leave."""
    return F.when(path.startswith("/") & ~path.startswith("//"), path).otherwise(otherwise)


def key_prefix(key: Column, n: int = 10) -> Column:
    return F.left(key, F.lit(n))


def epoch_time(seconds: Column) -> Column:
    """Seconds since 1970 as a time; 0 and null are no time."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0))).cast("timestamp_ntz")


def tier_of_price(price: Column, prices: dict[str, str]) -> Column:
    """The tier that a price stands for (prices: by tier), null for unknown ones."""
    return lookup({p: t for t, p in prices.items()}, price)
