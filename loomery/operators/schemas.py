"""Input and output schemas as JSON texts: fields, names to show, defaults and example values.

Properties are read as a map of JSON texts, so their order is that of the text and nothing of a schema is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import clipped
from ..functions.text import let

_MAP, _LIST = "map<string,string>", "array<string>"
# Names of an example's telling inputs, in order.
EXAMPLE_KEYS = ("query", "url", "q", "term")


def properties(schema: Column) -> Column:
    return F.from_json(F.get_json_object(schema, "$.properties"), _MAP)


def required(schema: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), _LIST), F.array().cast(_LIST))


def scalar_type(p: Column) -> Column:
    """A property's type as shown: its choices, its format, or its plain name."""
    kind, fmt, enum = F.get_json_object(p, "$.type"), F.get_json_object(p, "$.format"), F.from_json(F.get_json_object(p, "$.enum"), _LIST)
    choices = F.array_join(F.transform(enum, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), " | ")
    return F.when((kind == "string") & (F.size(enum) > 0), choices).when((kind == "string") & fmt.isNotNull(), F.concat(F.lit("string ("), fmt, F.lit(")"))).otherwise(kind)


def default_of(p: Column) -> Column:
    """A property's default as JSON text, null without one."""
    return F.to_json(F.try_variant_get(F.try_parse_json(p), "$.default", "variant"))


def fields(schemas: DataFrame, key: str, schema: str) -> DataFrame:
    """A row for each property, and for each member of an object (dotted, required if both are): name, type, required, default and description."""
    kind_of, text = lambda p: F.get_json_object(p, "$.type"), lambda p: F.get_json_object(p, "$.description")
    top = schemas.select(key, F.from_json(F.get_json_object(schema, "$.required"), _LIST).alias("req"), F.explode(properties(F.col(schema))).alias("name", "p"))
    own = top.select(key, "req", "name", "p", kind_of("p").alias("kind"))

    def row(name: Column, type_: Column, required_: Column, default: Column, p: Column) -> Column:
        return F.struct(name.alias("name"), type_.alias("type"), required_.alias("required"), default.alias("default"), text(p).alias("description"))

    def of_property(must: Column) -> Column:
        kind, p, name = F.col("kind"), F.col("p"), F.col("name")
        shown = F.when(kind == "array", F.concat(F.get_json_object(p, "$.items.type"), F.lit("[]"))).when(kind == "object", "object").otherwise(scalar_type(p))
        member = lambda e, inner: row(F.concat_ws(".", name, e["key"]), scalar_type(e["value"]), must & F.array_contains(inner, e["key"]), default_of(e["value"]), e["value"])
        members = let(required(p), lambda inner: F.transform(F.map_entries(properties(p)), lambda e: member(e, inner)))
        first = F.array(row(name, shown, must, F.when(~kind.isin("array", "object"), default_of(p)), p))
        return F.when(kind == "object", F.concat(first, F.coalesce(members, F.array()))).otherwise(first)

    must = F.array_contains(F.coalesce("req", F.array().cast(_LIST)), F.col("name"))
    return own.select(key, F.explode(let(must, of_property)).alias("f")).select(key, "f.*")


def output_names(schema: Column) -> Column:
    """The members of the first array of objects, else the properties' own names."""
    entries = F.map_entries(properties(schema))
    lists = F.filter(entries, lambda e: (F.get_json_object(e["value"], "$.type") == "array") & (F.get_json_object(e["value"], "$.items.type") == "object") & F.get_json_object(e["value"], "$.items.properties").isNotNull())
    inner = F.json_object_keys(F.get_json_object(F.get(lists, F.lit(0))["value"], "$.items.properties"))
    return F.coalesce(F.when(F.size(lists) > 0, inner), F.map_keys(properties(schema)), F.array().cast(_LIST))


def example_value(examples: Column) -> Column:
    """A telling string from the first example's input: of the preferred names the first that is set, if it is a string, else the first string there is."""
    given = F.get_json_object(examples, "$[0].input")
    value = lambda k: F.try_variant_get(F.try_parse_json(given), f"$.{k}", "variant")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    set_ = [F.when(~F.is_variant_null(value(k)), value(k)) for k in EXAMPLE_KEYS]
    chosen = F.coalesce(*set_)
    # Entries in the order of the text; JSON texts that start with a quote are strings.
    strings = F.filter(F.json_object_keys(given), lambda k: F.schema_of_variant(F.try_parse_json(F.get(F.map_values(F.map_filter(_raw(given), lambda n, _: n == k)), F.lit(0)))) == "STRING")
    first = F.get(F.map_values(F.map_filter(F.from_json(given, _MAP), lambda n, _: n == F.get(strings, F.lit(0)))), F.lit(0))
    return clipped(F.coalesce(F.when(is_text(chosen), F.try_variant_get(chosen, "$", "string")), first))


def _raw(json: Column) -> Column:
    """An object's values as JSON texts, strings with their quotes."""
    return F.transform_values(F.from_json(F.to_json(F.try_parse_json(json)), "map<string,variant>"), lambda _, v: F.to_json(v))


def with_defaults(given: Column, schema: Column) -> Column:
    """Input values (a map of JSON texts) with the schema's defaults where they are missing. Top level only: members of objects have none."""
    defaults = F.map_filter(F.transform_values(properties(schema), lambda _, p: default_of(p)), lambda _, v: v.isNotNull())
    missing = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(given), k))
    return F.coalesce(F.map_concat(given, missing), given)


def tool_sheet(title: Column, description: Column, facts: dict[str, Column], schema: Column, examples: Column) -> Column:
    """A tool's text sheet: heading, description, facts (blank ones left out), a line for each input, and the first example's input as JSON ({} without one)."""
    kind = lambda p: F.coalesce(F.get_json_object(p, "$.type"), F.lit("unknown"))
    described = lambda p: F.coalesce(F.concat(F.lit(": "), F.get_json_object(p, "$.description")), F.lit(""))
    inputs = F.transform(F.map_entries(properties(schema)), lambda e: F.concat(F.lit("- `"), e["key"], F.lit("` ("), kind(e["value"]), F.lit(")"), described(e["value"])))
    lines = F.array_compact(F.array(*[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"- {name}: "), v.cast("string"))) for name, v in facts.items()]))
    given = F.coalesce(F.get_json_object(examples, "$[0].input"), F.lit("{}"))
    parts = [
        F.concat(F.lit("# "), title), F.concat(F.lit("> "), description), F.array_join(lines, "\n"), F.lit("## Inputs"),
        F.when(F.size(inputs) > 0, F.array_join(inputs, "\n")).otherwise("- none"), F.lit("## Example input"), F.concat(F.lit("```json\n"), given, F.lit("\n```\n")),
    ]
    return F.concat_ws("\n\n", *parts)
