"""Typed reading of JSON held as Variant: what has another type than asked for is null, never cast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANTS = "array<variant>"


def parse(text: Column) -> Column:
    """The JSON of a text without white space around it; null where it is blank or no JSON."""
    return F.try_parse_json(text)


def get(v: Column, *keys: str) -> Column:
    """The value under a path of keys, as Variant."""
    return F.try_variant_get(v, "$" + "".join(f'["{k}"]' for k in keys), "variant")


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(type_of(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(type_of(v).startswith("ARRAY"), F.lit(False))


def has(v: Column, *keys: str) -> Column:
    """The path is there, be it null."""
    return type_of(get(v, *keys)).isNotNull()


def text_of(v: Column) -> Column:
    """A string's text; null for any other type."""
    return F.when(type_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text(v: Column, *keys: str) -> Column:
    return text_of(get(v, *keys))


def filled(v: Column, *keys: str) -> Column:
    """text(), null if empty."""
    return F.nullif(text(v, *keys), F.lit(""))


def first_filled(v: Column, *keys: str) -> Column:
    """The first of some keys that holds a text with characters."""
    return F.coalesce(*[filled(v, k) for k in keys])


def first_text(v: Column, *keys: str) -> Column:
    return F.coalesce(*[text(v, k) for k in keys])


def boolean(v: Column, *keys: str) -> Column:
    x = get(v, *keys)
    return F.when(type_of(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))


def whole(v: Column, *keys: str) -> Column:
    """A whole number that a long holds."""
    x = get(v, *keys)
    return F.when(type_of(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))


def natural(v: Column, *keys: str) -> Column:
    x = whole(v, *keys)
    return F.when(x >= 0, x)


def first_natural(v: Column, *keys: str) -> Column:
    return F.coalesce(*[natural(v, k) for k in keys])


def items(v: Column, *keys: str) -> Column:
    """An array's elements; null for any other type."""
    return F.try_variant_get(get(v, *keys) if keys else v, "$", VARIANTS)


def items_or_none(v: Column, *keys: str) -> Column:
    return F.coalesce(items(v, *keys), F.array().cast(VARIANTS))


def entries(v: Column, *keys: str) -> Column:
    """An object's (key, value) pairs by key; an empty array for any other type."""
    x = get(v, *keys) if keys else v
    some = F.when(type_of(x).startswith("OBJECT"), F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")))
    return F.array_sort(F.coalesce(F.transform(some, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))), F.array().cast("array<struct<key:string,value:string>>")))


def json(v: Column, *keys: str) -> Column:
    """Compact JSON with keys in order; "null" where the path is missing."""
    return F.coalesce(F.to_json(get(v, *keys) if keys else v), F.lit("null"))


def decoded(v: Column, *keys: str) -> Column:
    """JSON of a value; of a string, that of the JSON it holds, if it holds some."""
    x = get(v, *keys)
    inner = text_of(x)
    return F.coalesce(F.to_json(F.try_parse_json(inner)), F.to_json(x))


def quoted(value: Column) -> Column:
    """A text as a JSON string."""
    return F.get(F.transform(F.array(F.to_json(F.array(value))), lambda x: F.substr(x, F.lit(2), F.length(x) - 2)), F.lit(0))


def lines_joined(parts: Column, by: str = "\n") -> Column:
    """Texts that aren't empty or null, joined."""
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), by)


def one_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
