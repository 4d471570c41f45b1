"""Validation and publishing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import allowed_redirect
from ..operators import publishing as P
from ..operators.stateful import upsert
from ..sources.tables import read
from .registry import query

_FIELDS = ["query", "zeta", "price", "id", "name", "alpha", "url", "lat", "title", "beta", "rating"]


@query(
    "schema_fields_flatten",
    """
SELECT p_partkey, name, type, required FROM part, LATERAL (VALUES
  ('q', CASE p_size % 3 WHEN 0 THEN '"a" | "b"' WHEN 1 THEN 'string (uri)' ELSE 'string' END, p_size % 2 = 0), ('n', 'integer', true), ('tags', 'string[]', false),
  ('geo', 'object', p_size % 5 = 0), ('geo.lat', 'number', p_size % 5 = 0), ('geo.note', 'string (date)', false)) v(name, type, required)""",
)
def schema_fields_flatten(spark, d):
    """Properties and object members of input schemas, one row each."""
    p = read(spark, d, "part")
    none, text = F.lit(None), "array<string>"
    scalar = lambda t, fmt=none, enum=None: F.struct(F.lit(t).alias("type"), fmt.cast("string").alias("format"), (F.array().cast(text) if enum is None else enum).alias("enum"))
    no_members = F.create_map(F.lit(""), scalar("")).cast("map<string,struct<type:string,format:string,enum:array<string>>>")

    def prop(t, items=None, fmt=none, enum=None, members=None, need=()):
        return F.struct(
            F.lit(t).alias("type"), F.lit(items).cast("string").alias("items"), fmt.cast("string").alias("format"), (F.array().cast(text) if enum is None else enum).alias("enum"),
            F.when(F.lit(members is not None), members if members is not None else no_members).alias("members"), F.array(*[F.lit(x) for x in need]).cast(text).alias("member_required"),
        )

    k = F.col("p_size") % 3
    q = prop("string", fmt=F.when(k == 1, "uri"), enum=F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast(text)))
    geo = prop("object", members=F.create_map(F.lit("lat"), scalar("number"), F.lit("note"), scalar("string", F.lit("date"))), need=("lat",))
    props = F.create_map(F.lit("q"), q, F.lit("n"), prop("integer"), F.lit("tags"), prop("array", items="string"), F.lit("geo"), geo)
    required = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, "q"), F.lit("n"), F.when(F.col("p_size") % 5 == 0, "geo")), lambda x: x.isNotNull())
    return P.schema_fields(p.select("p_partkey", props.alias("props"), required.alias("required")), "p_partkey", "props", "required")


_LEAD = "[" + ", ".join(f"'{x}'" for x in P.LEADING) + "]"


@query(
    "output_fields_rank",
    f"""
SELECT p_partkey, (SELECT list(f ORDER BY coalesce(nullif(list_position({_LEAD}, f), 0), 16), f)[1:5] FROM (SELECT unnest({_FIELDS!r}[1 + p_size % 5:]) AS f) WHERE f NOT IN {P.HIDDEN!r}) AS fields FROM part""",
)
def output_fields_rank(spark, d):
    """The five output fields to show."""
    fields = F.slice(F.array(*[F.lit(x) for x in _FIELDS]), (1 + F.col("p_size") % 5).cast("int"), F.lit(len(_FIELDS)))
    return read(spark, d, "part").select("p_partkey", P.leading_fields(fields).alias("fields"))


@query(
    "manifest_violations",
    r"""
SELECT p_partkey, list_filter([CASE WHEN NOT regexp_matches(replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '_' ELSE ' ' END), '^[a-z][a-z0-9_]{2,63}$') THEN 'name' END,
  CASE WHEN NOT regexp_matches(p_size || '.0.' || CASE WHEN p_size % 7 = 0 THEN 'x' ELSE '1' END, '^\d+\.\d+\.\d+$') THEN 'version' END,
  CASE WHEN NOT length(p_name) BETWEEN 3 AND 80 THEN 'title' END, CASE WHEN NOT length(p_name || ' ' || p_brand) BETWEEN 20 AND 500 THEN 'description' END,
  CASE WHEN NOT regexp_matches(p_type, '^[a-z][a-z0-9-]{1,31}$') THEN 'category' END, CASE WHEN NOT p_size BETWEEN 1 AND 40 THEN 'credits' END,
  CASE WHEN NOT (p_size > 25 OR p_retailprice > 1000) THEN 'popularity' END], lambda x: x IS NOT NULL) AS violations FROM part""",
)
def manifest_violations(spark, d):
    """Which manifest rules each record breaks."""
    size, name = F.col("p_size"), F.col("p_name")
    rules = {
        "name": F.replace(name, F.lit(" "), F.when(size % 2 == 0, "_").otherwise(" ")).rlike(P.NAME),
        "version": F.concat(size, F.lit(".0."), F.when(size % 7 == 0, "x").otherwise("1")).rlike(P.VERSION),
        "title": P.between(F.length(name), 3, 80),
        "description": P.between(F.length(F.concat_ws(" ", name, "p_brand")), 20, 500),
        "category": F.col("p_type").rlike(P.CATEGORY),
        "credits": P.between(size, 1, 40),
        "popularity": (size > 25) | (F.col("p_retailprice") > 1000),
    }
    return read(spark, d, "part").select("p_partkey", P.violations(rules).alias("violations"))


_SVG = """CASE p_size % 8 WHEN 0 THEN ' <svg viewBox="0"><path fill="url(#a)"/></svg> ' WHEN 1 THEN '<svg><script>x</script></svg>' WHEN 2 THEN '<svg onload="x"></svg>' WHEN 3 THEN '<svg><a href="x"/></svg>'
  WHEN 4 THEN '<svg style="fill:url(http://x)"></svg>' WHEN 5 THEN '<svgx></svg>' WHEN 6 THEN '<SVG></SVG>' ELSE '<svg><p fill="url( ''#a)"/></svg>' END"""


@query(
    "svg_safety",
    rf"""
SELECT p_partkey, regexp_matches(t, '(?i)^<svg[\s>]') AND regexp_matches(t, '(?i)</svg>$') AND NOT regexp_matches(t, '(?i)<\s*(script|foreignObject|iframe|object|embed|link|style)\b')
  AND NOT regexp_matches(t, '(?i)\son[a-z]+\s*=') AND NOT regexp_matches(t, '(?i)\b(href|xlink:href|src)\s*=')
  AND len(regexp_extract_all(t, '(?i)url\(')) = len(regexp_extract_all(t, '(?i)url\(#')) AS safe FROM (SELECT p_partkey, trim({_SVG}) AS t FROM part)""",
)
def svg_safety(spark, d):
    """Inline SVGs without active content."""
    k, t = F.col("p_size") % 8, None
    for i, s in enumerate([' <svg viewBox="0"><path fill="url(#a)"/></svg> ', "<svg><script>x</script></svg>", '<svg onload="x"></svg>', '<svg><a href="x"/></svg>', '<svg style="fill:url(http://x)"></svg>', "<svgx></svg>", "<SVG></SVG>"]):
        t = F.when(k == i, s) if t is None else t.when(k == i, s)
    return read(spark, d, "part").select("p_partkey", P.safe_svg(t.otherwise("<svg><p fill=\"url( '#a)\"/></svg>")).alias("safe"))


_VERSIONS = "SELECT l_partkey AS tool_id, (l_linenumber || '.' || l_quantity::INT || '.' || l_suppkey % 12) AS version, md5(l_orderkey::VARCHAR || l_linenumber) AS sha FROM lineitem"
_SEM = "list_transform(string_split({0}, '.'), lambda x: x::BIGINT)"


def _versions(spark, d):
    v = F.concat_ws(".", "l_linenumber", F.col("l_quantity").cast("int"), F.col("l_suppkey") % 12)
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("tool_id"), v.alias("version"), F.md5(F.concat(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("sha"))


@query("semver_latest", f"SELECT tool_id, arg_max(version, ({_SEM.format('version')}, sha)) AS version, arg_max(sha, ({_SEM.format('version')}, sha)) AS sha FROM ({_VERSIONS}) GROUP BY tool_id")
def semver_latest(spark, d):
    """The greatest version of each tool, by number."""
    return P.newest_version(_versions(spark, d), "tool_id")


_EXISTING = "SELECT p_partkey AS tool_id, (4 || '.' || p_size || '.' || p_size % 12) AS live, md5(p_partkey::VARCHAR) AS live_sha FROM part WHERE p_partkey % 10 <> 0"


@query(
    "publish_verdict",
    f"""
SELECT v.tool_id, v.version, v.sha, CASE WHEN live IS NULL THEN 'created' WHEN {_SEM.format("v.version")} < {_SEM.format("live")} THEN 'version_not_newer'
  WHEN {_SEM.format("v.version")} = {_SEM.format("live")} AND sha <> live_sha THEN 'version_exists' WHEN {_SEM.format("v.version")} = {_SEM.format("live")} THEN 'unchanged' ELSE 'updated' END AS verdict
FROM ({_VERSIONS}) v LEFT JOIN ({_EXISTING}) e USING (tool_id)""",
)
def publish_verdict(spark, d):
    """Whether each publish is new, repeated, conflicting or too old."""
    p = read(spark, d, "part").filter("p_partkey % 10 <> 0")
    live = p.select(F.col("p_partkey").alias("tool_id"), F.concat_ws(".", F.lit("4"), "p_size", F.col("p_size") % 12).alias("live"), F.md5(F.col("p_partkey").cast("string")).alias("live_sha"))
    both = _versions(spark, d).join(live, "tool_id", "left")
    return both.select("tool_id", "version", "sha", P.publish_verdict(F.col("live"), F.col("live_sha"), F.col("version"), F.col("sha")).alias("verdict"))


@query(
    "publish_upsert",
    """
WITH n AS (SELECT p_partkey + 1000 AS id, upper(p_name) AS title, p_size % 3 = 0 AS staging FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(p_partkey, id) AS id, CASE WHEN id IS NOT NULL AND NOT (staging AND p_partkey IS NOT NULL) THEN n.title ELSE p_name END AS title, p_type FROM part FULL JOIN n ON p_partkey = id""",
)
def publish_upsert(spark, d):
    """Publishes into the catalogue; a staging publish leaves what the storefront shows."""
    p = read(spark, d, "part")
    tools = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_type")
    new = p.filter("p_partkey % 3 = 0").select((F.col("p_partkey") + 1000).alias("id"), F.upper("p_name").alias("title"), (F.col("p_size") % 3 == 0).alias("staging"))
    # Rows of staging publishes on existing tools bring nothing that may be shown.
    shown = new.join(tools.select("id", F.lit(True).alias("exists")), "id", "left").filter(~(F.col("staging") & F.coalesce("exists", F.lit(False)))).select("id", "title")
    return upsert(tools, shown, ["id"])


_NAME = "CASE n_nationkey % 3 WHEN 0 THEN 'org/list-tools' WHEN 1 THEN 'tools/run-tool' ELSE 'x/' || lower(n_name) END"


@query("reserved_name_check", f"SELECT n_nationkey, replace(split_part({_NAME}, '/', -1), '-', '_') AS name, replace(split_part({_NAME}, '/', -1), '-', '_') IN {P.RESERVED!r} AS reserved FROM nation")
def reserved_name_check(spark, d):
    """Tool names from paths, and whether they are reserved."""
    k = F.col("n_nationkey") % 3
    path = F.when(k == 0, "org/list-tools").when(k == 1, "tools/run-tool").otherwise(F.concat(F.lit("x/"), F.lower("n_name")))
    return read(spark, d, "nation").select("n_nationkey", P.tool_name(path).alias("name")).withColumn("reserved", F.col("name").isin(*P.RESERVED))


@query("publish_validation", "SELECT p_partkey, CASE WHEN p_name IS NULL THEN 'invalid_payload' WHEN p_size % 9 = 0 THEN 'invalid_manifest' WHEN p_type = 'PROMO' THEN 'reserved_name' WHEN p_size > 45 THEN 'bundle_too_large' WHEN p_partkey % 13 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS verdict FROM part")
def publish_validation(spark, d):
    """The first failing step of a publish."""
    size = F.col("p_size")
    rules = {"invalid_payload": F.col("p_name").isNotNull(), "invalid_manifest": size % 9 != 0, "reserved_name": F.col("p_type") != "PROMO", "bundle_too_large": size <= 45, "hash_mismatch": F.col("p_partkey") % 13 != 0}
    return read(spark, d, "part").select("p_partkey", P.first_failing(rules, F.lit("ok")).alias("verdict"))


@query(
    "reconcile_delist",
    """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN 'delist' ELSE 'keep' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def reconcile_delist(spark, d):
    """Tools whose repository is gone or archived."""
    repos = read(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("archived"))
    return P.reconcile(read(spark, d, "documents").select("doc_id"), repos, "doc_id").select("doc_id", "action")


@query(
    "input_coercion",
    r"""
SELECT event_id, CASE WHEN k = 0 THEN v = 'true' END AS as_boolean, CASE WHEN k = 1 THEN try_cast(v AS DOUBLE) END AS as_number,
       CASE WHEN k = 2 THEN list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x)), lambda x: x <> '') END AS as_array, NULL::DOUBLE[] AS as_numbers, NULL::BOOLEAN[] AS as_booleans, CASE WHEN k = 3 THEN v END AS as_string
FROM (SELECT event_id, event_id % 4 AS k, CASE event_id % 4 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'no' END WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'x' ELSE user_id || '.5' END WHEN 2 THEN ' a' || chr(10) || chr(10) || event_type ELSE event_type END AS v FROM events)""",
)
def input_coercion(spark, d):
    """Form texts as booleans, numbers, lists and strings."""
    k, u = F.col("event_id") % 4, F.col("user_id")
    value = F.when(k == 0, F.when(u % 2 == 0, "true").otherwise("no")).when(k == 1, F.when(u % 3 == 0, "x").otherwise(F.concat(u, F.lit(".5")))).when(k == 2, F.concat(F.lit(" a\n\n"), "event_type")).otherwise(F.col("event_type"))
    kind = F.when(k == 0, "boolean").when(k == 1, "number").when(k == 2, "array").otherwise("string")
    return read(spark, d, "events").select("event_id", P.coerce(value, kind).alias("c")).select("event_id", "c.*")


@query(
    "redirect_uri_validation",
    """
WITH g AS (SELECT o_custkey, list(CASE o_orderkey % 9 WHEN 0 THEN 'http://example.org/cb' ELSE 'https://example.org/' || o_orderkey END) AS uris FROM orders GROUP BY o_custkey)
SELECT o_custkey, len(uris) BETWEEN 1 AND 10 AND len(list_filter(uris, lambda u: NOT starts_with(u, 'https://'))) = 0 AS accepted FROM g""",
)
def redirect_uri_validation(spark, d):
    """Clients with one to ten redirect targets, all allowed."""
    uri = F.when(F.col("o_orderkey") % 9 == 0, "http://example.org/cb").otherwise(F.concat(F.lit("https://example.org/"), "o_orderkey"))
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.every(allowed_redirect(uri)).alias("all"))
    return n.select("o_custkey", (F.col("n").between(1, 10) & F.col("all")).alias("accepted"))
