"""Reading JSON values (variants) by kind: a value of another kind than asked for is null, a missing one too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ITSELF = ""


def _path(name: str) -> str:
    return f"$.{name}" if name else "$"


def member(v: Column, name: str = ITSELF) -> Column:
    """The value at a dotted path, or the variant itself. JSON's null is a value."""
    return F.try_variant_get(v, _path(name), "variant") if name else v


def kind(v: Column, name: str = ITSELF) -> Column:
    """OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, VOID (JSON's null), or a number's kind; null where nothing is."""
    return F.schema_of_variant(member(v, name))


def absent(v: Column, name: str) -> Column:
    return member(v, name).isNull()


def text(v: Column, name: str = ITSELF) -> Column:
    return F.when(kind(v, name) == "STRING", F.try_variant_get(v, _path(name), "string"))


def word(v: Column, name: str) -> Column:
    """A text that is only compared with fixed lower-case names: values of other kinds come as texts that are no such name. Costs half of what text does."""
    return F.try_variant_get(v, _path(name), "string")


def is_number(v: Column, name: str = ITSELF) -> Column:
    return F.coalesce(kind(v, name).rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def number(v: Column, name: str = ITSELF) -> Column:
    return F.when(is_number(v, name), F.try_variant_get(v, _path(name), "double"))


def is_flag(v: Column, name: str = ITSELF) -> Column:
    return F.coalesce(kind(v, name) == "BOOLEAN", F.lit(False))


def flag(v: Column, name: str = ITSELF) -> Column:
    return F.when(is_flag(v, name), F.try_variant_get(v, _path(name), "boolean"))


def members(v: Column, name: str = ITSELF) -> Column:
    """An object's values by name. No other kind casts to a map, so none is asked for (naming an object's kind walks all of it)."""
    return F.try_variant_get(v, _path(name), "map<string,variant>")


def items(v: Column, name: str = ITSELF) -> Column:
    """An array's values; no other kind casts to an array."""
    return F.try_variant_get(v, _path(name), "array<variant>")


def strings(v: Column, name: str = ITSELF) -> Column:
    """An array's values if all are strings."""
    return let(items(v, name), lambda all_: F.when(F.forall(all_, lambda x: F.schema_of_variant(x) == "STRING"), F.transform(all_, lambda x: F.try_variant_get(x, "$", "string"))))


def is_whole(n: Column, low: float | None = None, high: float | None = None) -> Column:
    """Whether a number has no fraction and lies within the bounds (within +-(2^53 - 1) in any case)."""
    most = float((1 << 53) - 1)
    return F.coalesce((n == F.floor(n)) & n.between(-most if low is None else low, most if high is None else high), F.lit(False))
