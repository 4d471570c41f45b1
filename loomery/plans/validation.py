"""Schemas, inputs, manifests and publishes as JSON made from table rows. The twins work the answers out from the same columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import manifests as M
from ..operators import publishing as P
from ..operators import schemas as S
from ..operators import validation as A
from ..sources.tables import read, spread
from .registry import query


def _object(properties: dict, required: Column | None = None) -> Column:
    """An object's schema as a struct, its properties in this order."""
    parts = [F.lit("object").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")]
    return F.struct(*parts, *([required.alias("required")] if required is not None else []), F.lit(False).alias("additionalProperties"))


def _prop(**members) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in members.items()])


def _names(*pairs) -> Column:
    """Names whose condition holds."""
    return F.array_compact(F.array(*[F.when(ok, name) if ok is not None else F.lit(name) for name, ok in pairs]))


# Events: inputs and their schemas.

_E = """SELECT *, (props::JSON ->> 'k')::INT AS k, extract(hour FROM ts)::INT AS hour FROM events"""


def _inputs(spark, d):
    """Each event's fields as an input, and a schema whose bounds come from the row too."""
    k, user, kind, hour = F.get_json_object("props", "$.k").cast("int"), F.col("user_id"), F.col("event_type"), F.hour("ts")
    schema = _object(
        {
            "k": _prop(type="integer", minimum=user % 10, maximum=F.lit(90)), "amount": _prop(type="number", minimum=F.lit(5.5)), "kind": _prop(type="string", enum=F.array(F.lit("view"), F.lit("click"), F.lit("purchase")), maxLength=1),
            "site": _prop(type="string", format="uri", maxLength=3), "mail": _prop(type="string", format="email"), "day": _prop(type="string", format="date", minLength=2, maxLength=hour), "live": _prop(type="boolean"),
            "tags": _prop(type="array", items=_prop(type="string", maxLength=5), maxItems=2), "page": _prop(type="integer", default=F.lit(1)),
            "who": _prop(type="object", properties=F.struct(_prop(type="integer", maximum=F.lit(100)).alias("id"), _prop(type="string").alias("name")), required=F.array(F.lit("id"), F.lit("name")), additionalProperties=False),
        },
        F.array(F.lit("k"), F.lit("kind"), F.lit("live"), F.lit("page")),
    )
    given = F.struct(
        F.when(k % 7 != 0, k).alias("k"), F.col("value").alias("amount"), kind.alias("kind"), F.concat(F.when(user % 2 == 0, "https://h.example/").otherwise("no scheme "), kind).alias("site"),
        F.concat(kind, F.when(k % 3 == 0, "@h.example").otherwise("@h")).alias("mail"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(hour != 3, hour > 12).alias("live"),
        F.array_repeat(kind, (k % 4).cast("int")).alias("tags"), F.when(k % 5 == 0, F.struct(user.alias("id"), F.when(hour > 5, kind).alias("name"), F.when(hour == 9, 1).alias("more"))).alias("who"), F.lit(1).alias("unknown"),
    )
    return spread(spark, d, "events", "event_id").select("event_id", F.to_json(schema).alias("schema"), F.to_json(given).alias("given"))


@query(
    "input_validation",
    f"""
WITH e AS ({_E})
SELECT event_id, 'k' AS path, 'required' AS rule FROM e WHERE k % 7 = 0
UNION ALL SELECT event_id, 'k', 'minimum' FROM e WHERE k % 7 <> 0 AND k < user_id % 10 UNION ALL SELECT event_id, 'k', 'maximum' FROM e WHERE k % 7 <> 0 AND k > 90
UNION ALL SELECT event_id, 'amount', 'minimum' FROM e WHERE value < 5.5 UNION ALL SELECT event_id, 'kind', 'enum' FROM e WHERE event_type NOT IN ('view', 'click', 'purchase')
UNION ALL SELECT event_id, 'site', 'uri' FROM e WHERE user_id % 2 <> 0 UNION ALL SELECT event_id, 'mail', 'email' FROM e WHERE k % 3 <> 0
UNION ALL SELECT event_id, 'day', 'maxLength' FROM e WHERE hour < 10 UNION ALL SELECT event_id, 'live', 'required' FROM e WHERE hour = 3
UNION ALL SELECT event_id, 'tags', 'maxItems' FROM e WHERE k % 4 > 2
UNION ALL SELECT event_id, 'tags[' || i || ']', 'maxLength' FROM e, range(0, k % 4) r(i) WHERE length(event_type) > 5
UNION ALL SELECT event_id, 'who.id', 'maximum' FROM e WHERE k % 5 = 0 AND user_id > 100 UNION ALL SELECT event_id, 'who.name', 'required' FROM e WHERE k % 5 = 0 AND hour <= 5
UNION ALL SELECT event_id, 'who.more', 'unknown' FROM e WHERE k % 5 = 0 AND hour = 9""",
)
def input_validation(spark, d):
    """What each event's input breaks of its own schema."""
    return A.checked_inputs(_inputs(spark, d), "event_id", "schema", "given")


@query(
    "input_accepted",
    f"""
WITH e AS ({_E})
SELECT event_id, CASE WHEN k % 7 <> 0 THEN k::VARCHAR END AS k, '1' AS page, '"' || event_type || '"' AS kind, CASE WHEN hour <> 3 THEN (hour > 12)::VARCHAR END AS live,
       8 - (k % 7 = 0)::INT - (hour = 3)::INT + (k % 5 = 0)::INT + 1 AS n FROM e""",
)
def input_accepted(spark, d):
    """Inputs as a tool gets them: unknown names dropped, defaults filled in."""
    a = _inputs(spark, d).select("event_id", A.accepted_input(F.try_parse_json("schema"), F.try_parse_json("given")).alias("a"))
    return a.select("event_id", *[F.try_element_at("a", F.lit(x)).alias(x) for x in ("k", "page", "kind", "live")], F.size("a").alias("n"))


# Parts: schemas.

_P = "SELECT *, lower(p_type) AS low, string_split(p_name, ' ') AS w FROM part"


def _schema(output: bool = False) -> Column:
    """A schema from a part: sound for most rows, with bounds and kinds that its size may spoil."""
    size, low = F.col("p_size"), F.lower("p_type")
    geo = F.struct(_prop(type="number").alias("price"), _prop(type="string", format="date", default=F.col("p_name")).alias("day"))
    props = {
        "brand": _prop(type="string", enum=F.array(F.col("p_brand"), low), default=F.col("p_name"), description=F.col("p_brand")), "size": _prop(type="integer", default=size, minLength=F.lit(-1)),
        "text": _prop(type=F.when(size % 11 == 0, "date").otherwise("string"), minLength=size - 5, format=F.when(size % 13 == 0, low)),
        "geo": _prop(type="object", properties=geo, required=F.array(F.lit("price")), additionalProperties=size % 17 == 0),
        "tags": _prop(type="array", items=_prop(type="number"), minItems=size / 2),
    }
    if output:
        found = F.struct(*[_prop(type="string").alias(n) for n in ("zeta", "url", "id")], _prop(type="string", maxLength=size - 3).alias("alpha"))
        props["found"] = _prop(type="array", items=_prop(type="object", properties=found, additionalProperties=False))
    return F.to_json(_object(props, _names(("size", size % 2 == 0), ("geo", None))))


_SHAPE = """SELECT p_partkey, 'text' AS path, 'type' AS rule FROM p WHERE p_size % 11 = 0 UNION ALL SELECT p_partkey, 'text', 'minLength' FROM p WHERE p_size % 11 <> 0 AND p_size < 5
UNION ALL SELECT p_partkey, 'text', 'format' FROM p WHERE p_size % 11 <> 0 AND p_size % 13 = 0 UNION ALL SELECT p_partkey, 'geo', 'additionalProperties' FROM p WHERE p_size % 17 = 0
UNION ALL SELECT p_partkey, 'tags', 'minItems' FROM p WHERE p_size % 2 = 1"""


@query(
    "schema_shape_faults",
    f"""
WITH p AS ({_P}), f AS ({_SHAPE})
SELECT p_partkey, false AS output, path, rule FROM f UNION ALL SELECT p_partkey, true, path, rule FROM f
UNION ALL SELECT p_partkey, false, 'found.items', 'type' FROM p UNION ALL SELECT p_partkey, true, 'found.items.alpha', 'maxLength' FROM p WHERE p_size < 4""",
)
def schema_shape_faults(spark, d):
    """What of each part's schema is outside the subset, as an input's and as an output's schema."""
    p = spread(spark, d, "part", "p_partkey").select("p_partkey", F.try_parse_json(_schema(output=True)).alias("s"))
    kinds = F.array(*[F.struct(F.lit(o).alias("output"), A.schema_faults(F.col("s"), o).alias("faults")) for o in (False, True)])
    each = p.select("p_partkey", F.explode(kinds).alias("k")).select("p_partkey", "k.output", F.explode("k.faults").alias("f"))
    return each.select("p_partkey", "output", "f.path", "f.rule")


@query(
    "schema_fields_json",
    f"""
WITH p AS ({_P})
SELECT p_partkey, 'brand' AS name, '"' || p_brand || '" | "' || low || '"' AS type, false AS required, '"' || p_name || '"' AS "default", p_brand AS description FROM p
UNION ALL SELECT p_partkey, 'size', 'integer', p_size % 2 = 0, p_size::VARCHAR, NULL FROM p
UNION ALL SELECT p_partkey, 'text', CASE WHEN p_size % 11 = 0 THEN 'date' WHEN p_size % 13 = 0 THEN 'string (' || low || ')' ELSE 'string' END, false, NULL, NULL FROM p
UNION ALL SELECT p_partkey, 'geo', 'object', true, NULL, NULL FROM p UNION ALL SELECT p_partkey, 'geo.price', 'number', true, NULL, NULL FROM p
UNION ALL SELECT p_partkey, 'geo.day', 'string (date)', false, '"' || p_name || '"', NULL FROM p UNION ALL SELECT p_partkey, 'tags', 'number[]', false, NULL, NULL FROM p""",
)
def schema_fields_json(spark, d):
    """Fields of each part's schema, members of objects dotted."""
    return S.fields(spread(spark, d, "part", "p_partkey").select("p_partkey", _schema().alias("schema")), "p_partkey", "schema")


@query(
    "output_names_json",
    f"""
WITH p AS ({_P})
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['url', 'alpha', 'zeta'] ELSE ['text', 'brand', 'geo', 'size', 'tags'] END AS names FROM p""",
)
def output_names_json(spark, d):
    """Names to show: those of the first list of objects, else the schema's own."""
    schema = F.when(F.col("p_size") % 3 == 0, _schema(output=True)).otherwise(_schema())
    return spread(spark, d, "part", "p_partkey").select("p_partkey", P.leading_fields(S.output_names(schema)).alias("names"))


@query(
    "example_values_json",
    f"""
WITH p AS ({_P})
SELECT p_partkey, CASE WHEN length(v) > 48 THEN left(v, 47) || '…' ELSE v END AS value
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'https://' || repeat(p_name, p_size) WHEN 2 THEN p_brand END AS v FROM p)""",
)
def example_values_json(spark, d):
    """A telling value from each part's first example."""
    size = F.col("p_size")
    given = F.struct(
        F.when(size % 4 == 3, size).when(size % 4 == 2, None).alias("max"), F.when(size % 4 == 0, F.col("p_name")).alias("query"), F.when(size % 4 == 1, F.concat(F.lit("https://"), F.expr("repeat(p_name, p_size)"))).alias("url"),
        F.when(size % 4 == 2, F.col("p_brand")).alias("b"), F.when(size % 4 == 2, F.lower("p_type")).alias("c"),
    )
    examples = F.to_json(F.array(F.struct(F.col("p_name").alias("name"), given.alias("input"))))
    return spread(spark, d, "part", "p_partkey").select("p_partkey", S.example_value(examples).alias("value"))


@query(
    "schema_defaults_fill",
    f"""
WITH p AS ({_P})
SELECT p_partkey, ['brand', 'n', 'size'] AS names, ['"' || p_name || '"', p_size::VARCHAR, CASE WHEN p_size % 2 = 0 THEN floor(p_retailprice)::INT::VARCHAR ELSE p_size::VARCHAR END] AS vals FROM p""",
)
def schema_defaults_fill(spark, d):
    """Inputs with the defaults of their schemas."""
    size = F.col("p_size")
    given = F.map_filter(F.create_map(F.lit("n"), size.cast("string"), F.lit("size"), F.when(size % 2 == 0, F.floor("p_retailprice").cast("int").cast("string"))), lambda _, v: v.isNotNull())
    e = spread(spark, d, "part", "p_partkey").select("p_partkey", F.array_sort(F.map_entries(S.with_defaults(given, _schema()))).alias("e"))
    return e.select("p_partkey", F.col("e.key").alias("names"), F.col("e.value").alias("vals"))


@query(
    "tool_sheets",
    f"""
WITH p AS ({_P})
SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '> ' || p_brand || chr(10) || chr(10) || '- Category: ' || low || CASE WHEN p_size > 25 THEN chr(10) || '- Credits: ' || p_size ELSE '' END || chr(10) || chr(10) || '## Inputs' || chr(10) || chr(10)
  || '- `brand` (string): ' || p_brand || chr(10) || '- `size` (integer)' || chr(10) || '- `text` (' || CASE WHEN p_size % 11 = 0 THEN 'date' ELSE 'string' END || ')' || chr(10) || '- `geo` (object)' || chr(10) || '- `tags` (array)' || chr(10) || chr(10)
  || '## Example input' || chr(10) || chr(10) || '```json' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '{{"size":' || p_size || '}}' ELSE '{{}}' END || chr(10) || '```' || chr(10) AS text FROM p""",
)
def tool_sheets(spark, d):
    """A text sheet of each part as a tool."""
    size = F.col("p_size")
    examples = F.when(size % 2 == 0, F.to_json(F.array(F.struct(F.struct(size.alias("size")).alias("input"))))).otherwise("[]")
    sheet = S.tool_sheet(F.col("p_name"), F.col("p_brand"), {"Category": F.lower("p_type"), "Credits": F.when(size > 25, size)}, _schema(), examples)
    return spread(spark, d, "part", "p_partkey").select("p_partkey", sheet.alias("text"))


# Parts: manifests and publishes.


def _manifest() -> Column:
    """A manifest (as a struct) from a part. What is none of its columns keeps the rules."""
    size, name = F.col("p_size"), F.col("p_name")
    rep = lambda n: F.expr(f"repeat(p_name, {n})")
    seo = F.struct(
        rep(3).alias("title"), rep(12).alias("description"), F.expr("repeat(p_name, p_size)").alias("intro"),
        F.transform(F.sequence(F.lit(1), (1 + size % 8).cast("int")), lambda _: F.struct(F.lit("Use").alias("title"), rep(6).alias("description"))).alias("useCases"),
        F.array_repeat(F.struct(F.concat(name, F.lit(" or not?")).alias("question"), rep(5).alias("answer")), 2).alias("faqs"), F.concat(F.split(name, " "), F.array(F.lower("p_type"), F.when(size % 10 == 0, "x").otherwise("xy"))).alias("keywords"),
    )
    rank, score = F.when(size % 4 < 2, size * 400).alias("rank"), F.when(size % 4 == 2, F.col("p_retailprice")).alias("score")
    return F.struct(
        F.replace(name, F.lit(" "), F.when(size % 2 == 0, "_").otherwise(" ")).alias("name"), F.concat(size, F.lit(".0."), F.when(size % 7 == 0, "x").otherwise("1")).alias("version"), name.alias("title"),
        F.concat_ws(" ", name, "p_brand").alias("description"), F.col("p_type").alias("category"), F.struct(F.col("p_brand").alias("label"), F.concat(F.lit("<svg viewBox='0 0 1 1'>"), F.when(size % 9 == 0, "<script>").otherwise("<path/>"), F.lit("</svg>")).alias("svg")).alias("logo"),
        seo.alias("seo"), F.when(size % 5 != 0, F.struct(rank, score)).alias("popularity"), size.alias("creditsEstimate"), F.from_json(_schema(), "variant").alias("inputSchema"),
        F.array(F.struct(name.alias("name"), F.when(size % 6 == 0, F.struct(F.when(size % 12 == 0, F.struct(F.lit(1).alias("a"))).alias("outputMatches"))).alias("expect"))).alias("examples"), F.concat(F.lit("src/"), F.lower("p_type"), F.when(size % 3 == 0, ".py").otherwise(".ts")).alias("entry"),
    )


_BAD = f"""list_filter([CASE WHEN NOT regexp_matches(replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '_' ELSE ' ' END), '^[a-z][a-z0-9_]{{2,63}}$') THEN 'name' END, CASE WHEN p_size % 7 = 0 THEN 'version' END,
  CASE WHEN NOT regexp_matches(p_type, '^[a-z][a-z0-9-]{{1,31}}$') THEN 'category' END, CASE WHEN p_size % 3 = 0 THEN 'entry' END, CASE WHEN NOT length(p_name) BETWEEN 3 AND 80 THEN 'title' END,
  CASE WHEN NOT length(p_name || ' ' || p_brand) BETWEEN 20 AND 500 THEN 'description' END, CASE WHEN NOT length(p_brand) BETWEEN 2 AND 80 THEN 'logo.label' END,
  CASE WHEN NOT length(p_name) * 3 BETWEEN 20 AND 90 THEN 'seo.title' END, CASE WHEN NOT length(p_name) * 12 BETWEEN 80 AND 320 THEN 'seo.description' END, CASE WHEN NOT length(p_name) * p_size BETWEEN 160 AND 1200 THEN 'seo.intro' END,
  CASE WHEN p_size % 9 = 0 THEN 'logo.svg.safe' END, CASE WHEN NOT 1 + p_size % 8 BETWEEN 2 AND 6 OR length(p_name) * 6 NOT BETWEEN 40 AND 320 THEN 'seo.useCases' END,
  CASE WHEN NOT (length(p_name) + 8 BETWEEN 10 AND 140 AND length(p_name) * 5 BETWEEN 40 AND 500) THEN 'seo.faqs' END, CASE WHEN p_size % 10 = 0 THEN 'seo.keywords' END,
  CASE WHEN p_size % 5 <> 0 AND (p_size % 4 = 3 OR (p_size % 4 < 2 AND p_size * 400 NOT BETWEEN 1 AND 10000)) THEN 'popularity' END, CASE WHEN NOT p_size BETWEEN 1 AND 50 THEN 'creditsEstimate' END,
  CASE WHEN p_partkey IN (SELECT p_partkey FROM shape) THEN 'inputSchema' END], lambda x: x IS NOT NULL)"""


@query("manifest_rules_json", f"WITH p AS ({_P}), shape AS ({_SHAPE}) SELECT p_partkey, {_BAD} AS violations FROM p")
def manifest_rules_json(spark, d):
    """Which rules each part's manifest breaks, in their order."""
    m = spread(spark, d, "part", "p_partkey").select("p_partkey", F.try_parse_json(F.to_json(_manifest())).alias("m"))
    return m.select("p_partkey", M.manifest_violations(F.col("m")).alias("violations"))


@query(
    "publish_steps_json",
    f"""
WITH p AS ({_P}), shape AS ({_SHAPE}), b AS (SELECT *, {_BAD} AS bad FROM p)
SELECT p_partkey, CASE WHEN p_size % 23 = 0 OR floor(p_retailprice)::INT % 19 = 0 THEN 'bad_payload' WHEN p_type = 'PROMO' THEN 'ok' WHEN len(bad) > 0 THEN 'invalid_manifest'
  WHEN p_size % 4 = 1 THEN 'name_mismatch' WHEN p_size % 16 = 0 THEN 'missing_bundle' WHEN p_size % 5 = 0 THEN 'sha_mismatch' ELSE 'ok' END AS error FROM b""",
)
def publish_steps_json(spark, d):
    """The first failing step of each part's publish."""
    size, name = F.col("p_size"), F.col("p_name")
    payload = F.struct(
        _manifest().alias("manifest"), F.concat(F.when(size % 23 == 0, "other/").otherwise("acme/"), F.replace(name, F.lit(" "), F.when(size % 4 == 1, "--").otherwise("-"))).alias("repo"),
        F.when(F.floor("p_retailprice").cast("int") % 19 == 0, "beta").when(F.col("p_type") == "PROMO", "delist").otherwise("live").alias("channel"), F.when(size % 16 != 0, F.base64(F.encode(name, "UTF-8"))).alias("bundle_b64"),
        F.sha2(F.when(size % 5 == 0, F.col("p_brand")).otherwise(name), 256).alias("bundle_sha256"),
    )
    p = spread(spark, d, "part", "p_partkey").select("p_partkey", F.try_parse_json(F.to_json(payload)).alias("payload"))
    return p.select("p_partkey", M.publish_error(F.col("payload"), "acme").alias("error"))


# Events: forms, errors and parameters.


@query(
    "form_fields",
    f"""
WITH e AS ({_E})
SELECT event_id, CASE WHEN k % 4 = 0 THEN k ELSE user_id END::VARCHAR AS a, CASE WHEN k % 4 < 3 THEN event_type || ' é+' END AS b, CASE WHEN k % 4 IN (1, 2) THEN '' END AS c FROM e""",
)
def form_fields(spark, d):
    """Form bodies and JSON bodies as maps; of repeated names the last counts."""
    k, b = F.get_json_object("props", "$.k").cast("int"), F.concat("event_type", F.lit(" é+"))
    user = F.col("user_id").cast("string")
    form = F.concat(F.lit("a=first&&b="), F.url_encode(b), F.lit("&c"), F.lit("&%61="), user)
    body = F.when(k % 4 == 0, F.to_json(F.struct(k.cast("string").alias("a"), b.alias("b")))).when(k % 4 == 3, F.concat(F.lit("a="), user)).otherwise(form)
    f = read(spark, d, "events").select("event_id", W.form_fields(body, k % 4 == 0).alias("f"))
    return f.select("event_id", *[F.try_element_at("f", F.lit(x)).alias(x) for x in "abc"])


#: Our own wording; a deployment brings its own.
_HINTS = {"purchase": "Add a plan first.", "signup": "Sign in again."}
_HINT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN ' {v}'" for k, v in _HINTS.items()) + " ELSE '' END"


@query("error_texts", f"WITH e AS ({_E}) SELECT event_id, CASE WHEN k % 9 = 0 THEN 'fetch_failed' ELSE event_type END || ': ' || CASE WHEN k % 4 = 0 THEN 'request failed' ELSE props END || CASE WHEN k % 9 = 0 THEN '' ELSE {_HINT_SQL} END AS text FROM e")
def error_texts(spark, d):
    """Error codes with messages and hints."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select("event_id", W.error_text(F.when(k % 9 != 0, F.col("event_type")), F.when(k % 4 != 0, F.col("props")), _HINTS).alias("text"))


@query("string_params", f"WITH e AS ({_E}) SELECT event_id, list_filter([CASE WHEN k % 3 > 0 THEN 'a' END, 'd', CASE WHEN k % 5 = 0 THEN 'e' END], lambda x: x IS NOT NULL) AS names FROM e")
def string_params(spark, d):
    """Of request parameters, those that are strings."""
    k = F.get_json_object("props", "$.k").cast("int")
    params = F.struct(F.when(k % 3 > 0, F.col("event_type")).alias("a"), F.col("user_id").alias("b"), F.array("event_type").alias("c"), F.col("props").alias("d"), F.when(k % 5 == 0, "").alias("e"))
    m = F.from_json(F.to_json(params), "map<string,variant>")
    return read(spark, d, "events").select("event_id", F.array_sort(F.map_keys(W.text_params(m))).alias("names"))
