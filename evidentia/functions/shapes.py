"""Shapes of JSON values: what kinds of things they hold, without the things."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import pseudonym


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kind(value: Column) -> Column:
    """The kind of a variant: str, int, float, bool, NoneType, list or dict."""
    name = F.schema_of_variant(value)
    # whole numbers are decimals only where they don't fit a long
    whole = (name == "BIGINT") | name.rlike(r"\ADECIMAL\((?:19|2\d|3\d),0\)\z")
    return (
        F.when(name == "STRING", "str").when(whole, "int").when(name == "BOOLEAN", "bool").when(name == "VOID", "NoneType")
        .when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "dict").when(name.isNotNull(), "float")
    )


def shape(json: Column) -> Column:
    """The sorted keys of an object with the kinds of their values; the kind alone of anything else; null if not JSON."""
    whole = F.try_parse_json(json)
    fields = F.from_json(json, "map<string,variant>")
    listed = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(k, F.lit(":"), kind(F.element_at(fields, k))))
    return F.when(kind(whole) == "dict", F.array_join(listed, ",")).otherwise(kind(whole))


def shape_fingerprint(json: Column, key: bytes) -> Column:
    """shape/ and half of the shape's pseudonym for an object, else the kind."""
    return F.when(kind(F.try_parse_json(json)) == "dict", F.concat(F.lit("shape/"), F.substring(pseudonym("diagnostic", shape(json), key), 1, 32))).otherwise(shape(json))
