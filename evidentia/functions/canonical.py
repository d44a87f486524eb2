"""One JSON text for equal values, its digest, and what parsing hides: keys that an object holds twice."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))  # the quotes keep what is inside


def canonical(value: Column, kind: T.DataType) -> Column:
    """The JSON text of a value of any type: keys sorted by code units, no blanks, nulls told, whole numbers without a point
    and fractions without zeros at their end, instants in microseconds of UTC, bytes in base 64. Numbers that are no
    numbers are strings."""
    if isinstance(kind, T.StructType):
        if len(set(kind.names)) < len(kind.names):
            raise ValueError("a structure holds a name twice")
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical(value.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be", "surrogatepass"))]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical(e["value"], kind.valueType).alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (F.abs(value) < 1e15) & (value == F.floor(value))
        text = F.when(F.isnan(value) | (F.abs(value) == float("inf")), quoted(value.cast("string"))).when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.TimestampType):
        text = quoted(F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.base64(value))
    else:
        text = quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def digest(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical(value, kind), 256)


def canonical_text(text: Column) -> Column:
    """The same for JSON text, whose objects may hold anything; null where it is malformed or ambiguous."""
    return F.to_json(F.try_parse_json(text))


def repeated_keys(text: Column) -> Column:
    """Whether well-formed JSON has an object, at any depth, that holds a key twice: which value counts depends on the
    reader. Null for text that isn't JSON; what follows its first value isn't looked at."""
    sound = F.get_json_object(text, "$").isNotNull()
    return F.when(sound, F.try_parse_json(text).isNull())
