"""Schema, manifest and publishing operators: one boolean per rule, verdicts by the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, WHITE_INNER, let, trim

# Names that are taken already, or kept for later.
RESERVED = (
    "search_tools", "run_tool", "fetch_url", "scrape_json", "screenshot_url", "discover_apis", "get_clearance",
    "get_datadome_cookie", "get_usage", "list_sessions", "clear_session", "list_tools", "tool_template",
)
# Output fields to hide (envelope and noise), and those to lead with, in order.
HIDDEN = ("query", "count", "ok", "results", "places", "items", "lat", "lng", "latitude", "longitude", "id", "uuid", "index")
LEADING = ("name", "title", "rating", "reviews", "price", "phone", "website", "email", "address", "url", "snippet", "text", "author", "byline", "category")
# Patterns of a manifest's and a payload's fields (\z: a line end after the last character is no match).
NAME, VERSION, CATEGORY, ENTRY = r"^[a-z][a-z0-9_]{2,63}\z", r"^[0-9]+\.[0-9]+\.[0-9]+\z", r"^[a-z][a-z0-9-]{1,31}\z", r"^src/[^\n\r\x{2028}\x{2029}]+\.(ts|js)\z"
SHA256, DIRECTORY, SLUG, DATE, UUID = r"^[0-9a-f]{64}\z", r"^tools/[A-Za-z0-9._-]+\z", r"^[a-z0-9]+(?:-[a-z0-9]+)*\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", r"(?i)^[0-9a-f-]{36}\z"
# What an inline SVG must not hold. White space is the wide kind, words are ASCII ones.
SVG_BANNED = (
    rf"(?i)<{WHITE}*(script|foreignObject|iframe|object|embed|link|style)(?![A-Za-z0-9_])", rf"(?i){WHITE}on[a-z]+{WHITE}*=", rf"(?i)(?<![A-Za-z0-9_])(?:href|xlink:href|src){WHITE}*=",
    rf"(?i)url\({WHITE}*['\"]?(?!#)",
)
MOST_BUNDLE = 2 * 1024 * 1024


def semver(c: Column) -> Column:
    """A version as an array of numbers, which compares as versions do."""
    return F.transform(F.split(c, r"\."), lambda x: x.try_cast("long"))


def between(length: Column, low: int, high: int) -> Column:
    return F.coalesce(length.between(low, high), F.lit(False))


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that don't hold, in order. A null counts as not holding."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def first_failing(rules: dict[str, Column], otherwise: Column) -> Column:
    """The name of the first rule that doesn't hold, else the other value."""
    out = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return otherwise if out is None else out.otherwise(otherwise)


def safe_svg(c: Column) -> Column:
    """An inline SVG without scripts, handlers, links or outside references."""

    def safe(t: Column) -> Column:
        ok = t.rlike(rf"(?i)^<svg[{WHITE_INNER}>]") & t.rlike(r"(?i)</svg>\z")
        for pattern in SVG_BANNED:
            ok = ok & ~t.rlike(pattern)
        return F.coalesce(ok, F.lit(False))

    return let(trim(c), safe)


def tool_name(path: Column) -> Column:
    """The last part of a directory's path, with underscores for hyphens."""
    return F.replace(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit("_"))


def repo_tool_name(repo: Column) -> Column:
    """The second part of a repository's name (empty without one), with underscores for hyphens."""
    return F.replace(F.coalesce(F.get(F.split(repo, "/"), F.lit(1)), F.lit("")), F.lit("-"), F.lit("_"))


def publish_verdict(existing_version: Column, existing_hash: Column, version: Column, sha: Column) -> Column:
    """Versions only grow: a lower one is rejected; an equal one is a repeat if its content is equal, else a conflict."""
    old, new = semver(existing_version), semver(version)
    return F.when(existing_version.isNull(), "created").when(new < old, "version_not_newer").when((new == old) & (sha != existing_hash), "version_exists").when(new == old, "unchanged").otherwise("updated")


def leading_fields(fields: Column, limit: int = 5) -> Column:
    """Field names to show: hidden ones dropped, leading ones first in their order, then by name."""
    order = F.array(*[F.lit(x) for x in LEADING])
    shown = F.filter(fields, lambda f: ~f.isin(*HIDDEN))
    place = lambda f: F.when(F.array_position(order, f) > 0, F.array_position(order, f)).otherwise(F.lit(len(LEADING) + 1).cast("long"))
    ranked = F.array_sort(F.transform(shown, lambda f: F.struct(place(f).alias("p"), F.collate(f, "UNICODE").alias("by"), f.alias("f"))))
    return F.slice(F.transform(ranked, lambda x: x["f"]), 1, limit)


def schema_fields(schemas: DataFrame, key: str, props: str, required: str) -> DataFrame:
    """A row for each property, and for each member of an object (dotted, required if both are).

    props: map of name to struct(type, items, format, enum, members: map of name to struct(type, format, enum), member_required).
    """

    def kind(p: Column) -> Column:
        enum = F.array_join(F.transform(p["enum"], lambda v: F.concat(F.lit('"'), v, F.lit('"'))), " | ")
        return F.when((p["type"] == "string") & (F.size(p["enum"]) > 0), enum).when((p["type"] == "string") & p["format"].isNotNull(), F.concat(F.lit("string ("), p["format"], F.lit(")"))).otherwise(p["type"])

    top = schemas.select(key, F.col(required).alias("req"), F.explode(props).alias("name", "p"))
    is_array, is_object = F.col("p.type") == "array", F.col("p.type") == "object"
    must = F.array_contains("req", F.col("name"))
    own = top.select(key, "name", F.when(is_array, F.concat("p.items", F.lit("[]"))).when(is_object, "object").otherwise(kind(F.col("p"))).alias("type"), must.alias("required"))
    inner = top.filter(is_object).select(key, "name", must.alias("must"), F.col("p.member_required").alias("member_required"), F.explode("p.members").alias("sub", "m"))
    both = F.col("must") & F.array_contains("member_required", F.col("sub"))
    return own.unionByName(inner.select(key, F.concat_ws(".", "name", "sub").alias("name"), kind(F.col("m")).alias("type"), both.alias("required")))


def number_of(text: Column) -> Column:
    """The number that a form text stands for: decimal, with an exponent, hexadecimal, or Infinity; null for any other text, and for a blank one."""
    t = trim(text)
    decimal = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(decimal, t.try_cast("double")).when(t.rlike(r"^[+-]?Infinity\z"), F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))).when(t.rlike(r"^0[xX][0-9a-fA-F]{1,13}\z"), F.conv(F.substr(t, F.lit(3)), 16, 10).cast("double"))


def coerce(value: Column, kind: Column, items: Column | None = None) -> Column:
    """Form text to a typed value, as a struct with one field set at most.

    Text is trimmed; a blank one, and one that isn't a number where a number is wanted, gives nothing. Arrays are lines that aren't blank, typed by items
    (string if not given); lines that are no numbers are dropped from arrays of numbers.
    """
    items = F.lit("string") if items is None else items
    lines = F.filter(F.transform(F.split(value, "\n"), trim), lambda x: x != "")
    some, number, text = F.when((kind == "array") & (F.size(lines) > 0), lines), kind.isin("number", "integer"), trim(value)
    return F.struct(
        F.when(kind == "boolean", F.coalesce(value == "true", F.lit(False))).alias("as_boolean"),
        F.when(number, number_of(value)).alias("as_number"),
        F.when(~items.isin("number", "integer", "boolean"), some).alias("as_array"),
        F.when(items.isin("number", "integer"), F.filter(F.transform(some, number_of), lambda x: x.isNotNull())).alias("as_numbers"),
        F.when(items == "boolean", F.transform(some, lambda x: x == "true")).alias("as_booleans"),
        F.when((kind == "string") & (text != ""), text).alias("as_string"),
    )


def reconcile(tools: DataFrame, repos: DataFrame, key: str) -> DataFrame:
    """delist where the repository is missing or archived; a lookup without an answer (archived is null) keeps the tool."""
    state = F.when(F.col("known").isNull() | F.coalesce("archived", F.lit(False)), "delist").otherwise("keep")
    return tools.join(repos.withColumn("known", F.lit(True)), key, "left").withColumn("action", state).drop("known")


def newest_version(versions: DataFrame, key: str) -> DataFrame:
    """The greatest version of each key."""
    return versions.groupBy(key).agg(F.max_by(F.struct("version", "sha"), F.struct(semver(F.col("version")).alias("v"), F.col("sha"))).alias("s")).select(key, "s.*")


def ranked_versions(versions: DataFrame, key: str) -> DataFrame:
    return versions.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(semver(F.col("version")).desc(), "sha")))
