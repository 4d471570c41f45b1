"""Input values against JSON schemas, and JSON schemas against the subset that tools may use.

Both take variants, a schema for each row, and give the broken rules as an array of (path, rule), sorted. Paths: name, name.member, name[2]; '' is the value itself.

Schemas are flat objects of scalars, arrays of scalars and objects of scalars. Values: a string with choices must be one of them; else a uri or email must look like
one, and bounds of length hold only for other strings, so also for those with another format. Numbers and lists have bounds; an integer must be one that a double
holds exactly, else its bounds aren't looked at. Inner objects take no unknown members; unknown names at the top are dropped. JSON's null is a value of no type.
A missing value breaks `required` alone, and not even that where the schema has a default, which is filled in unchecked; members of inner objects have no defaults.
Lengths count UTF-16 units. Rows without a schema or a value have no rules to break: null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import let

FAULTS = "array<struct<path:string,rule:string>>"
# Kinds of scalars and formats of a schema; the shape of a mail address.
NUMBERS, FORMATS = ("number", "integer"), ("uri", "email", "date", "date-time")
EMAIL = r"^(?!\.)(?!.*\.\.)([A-Za-z0-9_'+\-\.]*)[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}\z"
#: A scheme with something after it; web schemes need a host. White space around is passed over, none may stand within a host.
URI = r"^\s*(?i)(?:(?:https?|wss?|ftp):[/\\]*(?:[^\s/?#\\@]*@)?(?:\[[0-9a-f:.]+\]|[^\s/?#\\@:<>^|%\[\]]+)(?::\d{0,5})?(?:[/?#\\].*)?|(?!(?:https?|wss?|ftp|file):)[a-z][a-z0-9+.-]*:.*|file:.*)\z"

Rule = tuple[str, Column]


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def _broken(*rules: Rule) -> Column:
    """Names of the rules that are false; null counts as kept, so an absent bound breaks nothing."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules]))


def _at(path: Column, rules: Column) -> Column:
    return F.transform(rules, lambda r: F.struct(path.alias("path"), r.alias("rule")))


def _one(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _none() -> Column:
    return F.array().cast(FAULTS)


def _scalar(p: Column, v: Column, known_kind: Column | None = None) -> Column:
    """The rules of a scalar's schema p (of the given kind, if that is known) that the value v breaks."""

    def text(s: Column, choices: Column, fmt: Column) -> Column:
        lengths = let(utf16_length(s), lambda k: _broken(("minLength", k >= V.number(p, "minLength")), ("maxLength", k <= V.number(p, "maxLength"))))
        return (
            F.when(F.size(choices) > 0, _broken(("enum", F.coalesce(F.array_contains(choices, s), F.lit(False)))))
            .when(s.isNull(), F.array(F.lit("type")))
            .when(fmt == "uri", _broken(("uri", s.rlike(URI))))
            .when(fmt == "email", _broken(("email", s.rlike(EMAIL))))
            .otherwise(lengths)
        )

    def amount(n: Column, kind: Column) -> Column:
        bounds = _broken(("minimum", n >= V.number(p, "minimum")), ("maximum", n <= V.number(p, "maximum")))
        return F.when(n.isNull(), F.array(F.lit("type"))).when((kind == "integer") & ~V.is_whole(n), F.array(F.lit("integer"))).otherwise(bounds)

    def judged(kind: Column) -> Column:
        of_text = let(V.text(v), lambda s: let(V.strings(p, "enum"), lambda choices: let(V.word(p, "format"), lambda fmt: text(s, choices, fmt))))
        of_number = let(V.number(v), lambda n: amount(n, kind))
        return F.when(kind == "string", of_text).when(kind.isin(*NUMBERS), of_number).when(kind == "boolean", _broken(("type", V.is_flag(v)))).otherwise(F.array().cast("array<string>"))

    return let(V.word(p, "type"), judged) if known_kind is None else judged(known_kind)


def _property(p: Column, v: Column, path: Column) -> Column:
    def array(all_: Column, item: Column) -> Column:
        size = _at(path, _broken(("minItems", F.size(all_) >= V.number(p, "minItems")), ("maxItems", F.size(all_) <= V.number(p, "maxItems"))))
        each = F.flatten(F.transform(all_, lambda x, i: _at(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), _scalar(item, x))))
        return F.when(all_.isNull(), _one(path, "type")).otherwise(F.concat(size, each))

    def object_(own: Column, known: Column, must: Column) -> Column:
        unknown = F.transform(F.filter(F.map_keys(own), lambda k: ~F.map_contains_key(known, k)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown").alias("rule")))
        inner = F.flatten(F.transform(F.map_entries(known), lambda e: _present(own, e, must, F.concat(path, F.lit("."), e["key"]), lambda x: _at(F.concat(path, F.lit("."), e["key"]), _scalar(e["value"], x)))))
        return F.when(own.isNull(), _one(path, "type")).otherwise(F.concat(unknown, inner))

    of_array = let(V.items(v), lambda all_: let(V.member(p, "items"), lambda item: array(all_, item)))
    of_object = let(V.members(v), lambda own: let(V.members(p, "properties"), lambda known: let(_required(p), lambda must: object_(own, known, must))))
    return let(V.word(p, "type"), lambda kind: F.when(kind == "array", of_array).when(kind == "object", of_object).otherwise(_at(path, _scalar(p, v, kind))))


def _required(p: Column) -> Column:
    return F.coalesce(V.strings(p, "required"), F.array().cast("array<string>"))


def _present(values: Column, entry: Column, must: Column, path: Column, check: Callable[[Column], Column]) -> Column:
    there = F.map_contains_key(values, entry["key"])
    missing = F.when(F.array_contains(must, entry["key"]), _one(path, "required")).otherwise(_none())
    return F.when(there, let(F.try_element_at(values, entry["key"]), check)).otherwise(missing)


def input_faults(schema: Column, given: Column) -> Column:
    """What a value breaks of its row's schema."""

    def one(values: Column, e: Column, must: Column) -> Column:
        # A default stands in for a missing value, required or not.
        needed = F.when(V.absent(e["value"], "default"), must).otherwise(F.array().cast("array<string>"))
        return _present(values, e, needed, e["key"], lambda x: _property(e["value"], x, e["key"]))

    # The lambdas below run once for each property, so whatever doesn't depend on it is computed before them.
    def all_(s: Column, values: Column) -> Column:
        each = let(_required(s), lambda must: F.flatten(F.transform(F.map_entries(V.members(s, "properties")), lambda e: one(values, e, must))))
        return F.when(values.isNull(), _one(F.lit(""), "type")).otherwise(each)

    judged = lambda s, v: F.when(s.isNotNull() & v.isNotNull(), F.array_sort(let(V.members(v), lambda values: all_(s, values))))
    return let(schema, lambda s: let(given, lambda v: judged(s, v)))


def accepted_input(schema: Column, given: Column) -> Column:
    """The value's members that the schema knows, with its defaults where they are missing: JSON texts by name."""

    def chosen(values: Column) -> Column:
        return F.transform_values(V.members(schema, "properties"), lambda k, p: F.when(F.map_contains_key(values, k), F.to_json(F.try_element_at(values, k))).otherwise(F.to_json(V.member(p, "default"))))

    return F.map_filter(let(V.members(given), chosen), lambda _, x: x.isNotNull())


def checked_inputs(rows: DataFrame, key: str, schema: str, given: str) -> DataFrame:
    """key, path and rule: a row for each broken rule of each row's value (schema and given are JSON texts; a text that doesn't parse breaks `json`)."""
    s, v = F.try_parse_json(schema), F.try_parse_json(given)
    bad = F.when(F.col(given).isNotNull() & v.isNull(), _one(F.lit(""), "json"))
    return rows.select(key, F.explode(F.coalesce(bad, input_faults(s, v))).alias("f")).select(key, "f.path", "f.rule")


# Schemas themselves.


def _optional(p: Column, name: str, ok: Column) -> Rule:
    return name, V.absent(p, name) | F.coalesce(ok, F.lit(False))


def _described(p: Column) -> Rule:
    return _optional(p, "description", V.text(p, "description").isNotNull())


def _scalar_shape(p: Column, known_kind: Column | None = None) -> Column:
    """The members of a scalar's schema (of the given kind, if that is known) that are none."""
    bound = lambda name: _optional(p, name, V.is_number(p, name))
    text = _broken(
        _described(p), _optional(p, "enum", F.size(V.strings(p, "enum")) > 0), _optional(p, "format", V.word(p, "format").isin(*FORMATS)), _optional(p, "minLength", V.is_whole(V.number(p, "minLength"), 0)),
        _optional(p, "maxLength", V.is_whole(V.number(p, "maxLength"), 1)), _optional(p, "default", V.text(p, "default").isNotNull()),
    )
    amount = _broken(_described(p), bound("minimum"), bound("maximum"), bound("default"))
    flag = _broken(_described(p), _optional(p, "default", V.is_flag(p, "default")))
    judged = lambda kind: F.when(kind == "string", text).when(kind.isin(*NUMBERS), amount).when(kind == "boolean", flag).otherwise(F.array(F.lit("type")))
    return let(V.word(p, "type"), judged) if known_kind is None else judged(known_kind)


def _closed(p: Column, known: Column) -> list[Rule]:
    """Rules of any object's schema with the known members: what it requires is a list of names, and it takes no other members."""
    return [_optional(p, "required", V.strings(p, "required").isNotNull()), ("additionalProperties", ~F.coalesce(V.flag(p, "additionalProperties"), F.lit(True))), ("properties", known.isNotNull())]


def _object_shape(p: Column, path: Column) -> Column:
    """An object of scalars, described, and each of its members."""
    members = lambda known: F.coalesce(F.flatten(F.transform(F.map_entries(known), lambda e: _at(F.concat(path, F.lit("."), e["key"]), _scalar_shape(e["value"])))), _none())
    return let(V.members(p, "properties"), lambda known: F.concat(_at(path, _broken(_described(p), *_closed(p, known))), members(known)))


def _property_shape(p: Column, path: Column, lists_of_objects: bool) -> Column:
    inside = F.concat(path, F.lit(".items"))

    def of_items(item: Column) -> Column:
        scalar = _at(inside, _scalar_shape(item))
        if not lists_of_objects:
            return scalar
        return F.when(V.word(item, "type") == "object", _object_shape(item, inside)).otherwise(scalar)

    def array(item: Column) -> Column:
        sizes = _broken(_described(p), ("items", item.isNotNull()), _optional(p, "minItems", V.is_whole(V.number(p, "minItems"), 0)), _optional(p, "maxItems", V.is_whole(V.number(p, "maxItems"), 1)))
        return F.concat(_at(path, sizes), F.when(item.isNotNull(), of_items(item)).otherwise(_none()))

    of_array, of_object = let(V.member(p, "items"), array), _object_shape(p, path)
    return let(V.word(p, "type"), lambda kind: F.when(kind == "array", of_array).when(kind == "object", of_object).otherwise(_at(path, _scalar_shape(p, kind))))


def schema_faults(schema: Column, output: bool = False) -> Column:
    """What of a schema is outside the subset. Output schemas may also have arrays of objects of scalars."""

    def all_(s: Column, known: Column) -> Column:
        own = _at(F.lit(""), _broken(("type", F.coalesce(V.word(s, "type") == "object", F.lit(False))), *_closed(s, known)))
        each = F.coalesce(F.flatten(F.transform(F.map_entries(known), lambda e: _property_shape(e["value"], e["key"], output))), _none())
        return F.when(s.isNotNull(), F.array_sort(F.concat(own, each)))

    return let(schema, lambda s: let(V.members(s, "properties"), lambda known: all_(s, known)))
