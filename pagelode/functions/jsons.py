"""Tolerant reading of JSON as columns: a field that is missing or of another shape is null, never an error.

Texts are parsed once, parse(text); the functions take the parsed value and a key. Broken text, and text
with a key twice, is null as a whole. A whole number may come as a numeric text, a truth value as the
text "true" or "false". Numbers read as text lose zeros behind the point (1.0 is "1").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.scalars import parse_timestamp


def parse(text: str | Column) -> Column:
    return F.try_parse_json(text)


def _path(key: str) -> str:
    if "'" in key and '"' in key:
        raise ValueError(f"a key can't have both kinds of quotes: {key}")
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


def text_of(value: Column) -> Column:
    """The text of a string, number or truth value; null for objects, arrays and null."""
    kind = F.schema_of_variant(value)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(value, "$", "string"))


def string(value: Column, key: str) -> Column:
    return text_of(F.try_variant_get(value, _path(key), "variant"))


def long(value: Column, key: str) -> Column:
    found = F.trim(string(value, key))
    return F.when(found.rlike(r"^-?\d+$"), found.try_cast("long"))


def integer(value: Column, key: str) -> Column:
    return long(value, key).try_cast("int")


def double(value: Column, key: str) -> Column:
    found = string(value, key)
    return F.when(found.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), found.try_cast("double"))


def boolean(value: Column, key: str) -> Column:
    found = F.lower(string(value, key))
    return F.when(found == "true", True).when(found == "false", False)


def flag(value: Column, key: str) -> Column:
    """Whether the field is true; false if it is anything else or missing."""
    return F.coalesce(boolean(value, key), F.lit(False))


def time(value: Column, key: str) -> Column:
    return parse_timestamp(string(value, key))


def obj(value: Column, key: str) -> Column:
    found = F.try_variant_get(value, _path(key), "variant")
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def array(value: Column, key: str) -> Column:
    """array<variant>; null if the field is no array."""
    return F.try_variant_get(value, _path(key), "array<variant>")


def strings(value: Column, key: str) -> Column:
    """The texts of an array's strings, numbers and truth values; empty if the field is no array."""
    return F.coalesce(F.filter(F.transform(array(value, key), text_of), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def objects(value: Column, key: str) -> Column:
    """The objects of an array, as variants; empty if the field is no array."""
    found = F.filter(array(value, key), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    return F.coalesce(found, F.array().cast("array<variant>"))


def texts(value: Column) -> Column:
    """map<string, string>: an object's fields that have a text, without those that hold objects, arrays or null."""
    every = F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: text_of(v))
    return F.map_filter(every, lambda _, v: v.isNotNull())
