"""Keyed pseudonyms as expressions: HMAC-SHA256 from sha2 and two pads that the driver computes from the key."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: bytes) -> tuple[Column, Column]:
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return tuple(F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Lowercase hex of the HMAC of a string (its UTF-8) or binary column."""
    inner, outer = _pads(key)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def pseudonym(kind: str, value: Column, key: bytes) -> Column:
    """The keyed digest of a value within its kind: equal values of different kinds have different pseudonyms."""
    return hmac_sha256(F.concat(F.lit(f"{kind}/"), value.cast("string")), key)


def public_references(ids: DataFrame, column: str, key: bytes, prefix: str, least: int = 12) -> DataFrame:
    """column, ref: prefix and the shortest start of the id's digest, of least or more digits, that no other id's
    reference shares; only ids that collide grow, one digit at a time and with their group."""
    digests = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_d", hmac_sha256(F.col(column).cast("string"), key))
    # a group that collides at n digits grows to n + 1 together, so an id's length is one more than the longest start
    # that it shares with its nearest neighbours in digest order
    from pyspark.sql import Window

    near = Window.partitionBy(F.substring("_d", 1, least)).orderBy("_d")
    shared = lambda other: F.coalesce(F.size(F.filter(F.sequence(F.lit(least), F.lit(64)), lambda n: F.substring(F.col("_d"), F.lit(1), n) == F.substring(other, F.lit(1), n))), F.lit(0))
    both = digests.withColumns({"_before": F.coalesce(F.lag("_d").over(near), F.lit("")), "_after": F.coalesce(F.lead("_d").over(near), F.lit(""))})
    length = F.lit(least) + F.greatest(shared(F.col("_before")), shared(F.col("_after")))
    return both.select(column, F.concat(F.lit(prefix), F.substring(F.col("_d"), F.lit(1), length)).alias("ref"))


def evidence_id(path: Column) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(path, 256), 1, 16))
