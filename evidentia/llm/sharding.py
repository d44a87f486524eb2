"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, rows are ordered by their place on the Hilbert curve
through that grid, and the order is cut into runs of equal row counts. Rows near each other in all dimensions share a
shard, so a reader that filters on any of them can skip whole files by their minima and maxima.

A number or instant is quantised by quantiles of its column. A string is quantised by the whole string: its distinct
values are counted and summed up in their order, over a range partitioning, and the values at which the sum passes a
share of the rows are the bounds.

The global order needs no single task: a range partitioning on (curve index, doc_id, crc) sorts in parallel, the place
inside a partition comes from monotonically_increasing_id, and only the partitions' row counts (one row each) are
summed up. Only DataFrame functions are used.

Defined cases: a null dimension goes to the lowest cell; a null text has size 1 and a null crc; equal rows and rows
without a doc_id stay, in any order among themselves; an empty table gives no rows; other columns pass through, but one
named like an output (curve, shard, slot) is replaced by it.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

BITS = 5  # per dimension
ACCURACY = 10_000


def _rotate(x: int, by: int, n: int) -> int:
    by %= n
    return ((x >> by) | (x << (n - by))) & ((1 << n) - 1)


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) at state * 2^n + cell, of the Hilbert curve in n dimensions.

    A state is (entry corner, direction); in it a cell's bits, reflected and rotated, are the Gray code of the digit.
    """
    digit, following = [], []
    for entry in range(1 << n):
        for direction in range(n):
            for cell in range(1 << n):
                gray = _rotate(cell ^ entry, direction + 1, n)
                w = gray
                for shift in range(1, n):
                    w ^= gray >> shift
                corner = 0 if w == 0 else (lambda i: i ^ (i >> 1))(2 * ((w - 1) // 2))
                odd = w if w % 2 else max(w - 1, 0)
                turn = 0 if w == 0 else ((~odd & (odd + 1)).bit_length() - 1) % n
                e = entry ^ _rotate(corner, n - (direction + 1) % n, n)
                d = (direction + turn + 1) % n
                digit.append(w)
                following.append(e * n + d)
    return digit, following


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index on the Hilbert curve of a grid cell (one column per dimension, each in 0 .. 2^bits - 1)."""
    n = len(cells)
    digit, following = (F.lit(values) for values in curve_table(n))

    def step(acc: Column, level: Column) -> Column:
        cell = reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.shiftleft(F.call_function("shiftright", c.cast("int"), level).bitwiseAND(F.lit(1)), j) for j, c in enumerate(cells)],
        )
        at = acc["state"] * (1 << n) + cell + 1
        return F.struct(
            F.shiftleft(acc["index"], n).bitwiseOR(F.element_at(digit, at).cast("long")).alias("index"),
            F.element_at(following, at).alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def as_number(c: Column, kind: T.DataType) -> Column:
    """A number in the order of the column."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long") if isinstance(kind, T.IntegralType) else c.cast("double")


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def string_bounds(df: DataFrame, name: str, bits: int) -> list[str]:
    """The values at which 1 / 2^bits, 2 / 2^bits, ... of the rows are passed, one for each share: 2^bits - 1 at most."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(_column(name).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = stored(values.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "values")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = placed.groupBy("part").agg(F.sum("n").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"), F.sum("own").over(Window.partitionBy()).alias("total"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = placed.join(F.broadcast(starts), "part").withColumn("upto", upto)
    passed = F.expr(f"least({(1 << bits) - 1}, upto * {1 << bits} div total) - (upto - n) * {1 << bits} div total")
    found = summed.select("v", passed.alias("k")).where("k > 0").collect()
    return sorted(r["v"] for r in found for _ in range(r["k"]))


def quantised(df: DataFrame, dimensions: list[str], bits: int) -> list[Column]:
    """A cell per dimension: how many of its 2^bits - 1 bounds are below the value, equal ones counted each, so that a
    dimension of few values still spans the grid. Numbers take theirs from one aggregate of mergeable summaries."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds = {d: df.schema[d].dataType for d in dimensions}
    numbers = {d: as_number(_column(d), k) for d, k in kinds.items() if not isinstance(k, T.StringType)}
    found = df.agg(*[F.percentile_approx(x, shares, ACCURACY).alias(f"q{i}") for i, x in enumerate(numbers.values())]).first() if numbers else ()
    bounds = {d: found[i] or [] for i, d in enumerate(numbers)} | {d: string_bounds(df, d, bits) for d in dimensions if d not in numbers}
    return [_bounds_below(numbers.get(d, _column(d)), bounds[d]) for d in dimensions]


def _bounds_below(x: Column, bounds: list) -> Column:
    below = [F.when(x > F.lit(b), k).otherwise(0) for b, k in sorted(Counter(bounds).items())]
    return F.when(x.isNull(), F.lit(0)).otherwise(reduce(lambda a, b: a + b, below, F.lit(0)))


def globally_ranked(df: DataFrame, order: list[str], rank: str = "_rank", total: str = "_total") -> DataFrame:
    """Adds the rank (0, 1, ... in the order of the columns, all rows) and the number of rows, without a task that sees
    all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [_column(c) for c in order]
    sorted_rows = stored(df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_place", 33)
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias(total))
    placed = sorted_rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # as many rows as partitions
    return placed.withColumn(rank, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_place", "_start")


def hilbert_shards(df: DataFrame, dimensions: list[str], n_shards: int, tie: list[str], bits: int = BITS) -> DataFrame:
    """Adds `curve` (Hilbert index), `shard` and `slot` (0, 1, ... inside the shard, in curve order).

    Law `rows`: shard s holds the ranks from ceil(s * n / n_shards), so the counts differ by one at most.
    """
    curve = hilbert_index(quantised(df, dimensions, bits), bits)
    own = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    indexed = df.select(*[_column(c) for c in df.columns if c in own or c in tie], curve.alias("_curve"))
    ranked = globally_ranked(indexed, ["_curve", *tie])
    shard = F.expr(f"_rank * {n_shards} div _total")
    first = F.expr(f"(_shard * _total + {n_shards - 1}) div {n_shards}")
    placed = ranked.withColumn("_shard", shard)
    return placed.select(*[_column(c) for c in own], F.col("_curve").alias("curve"), F.col("_shard").cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"))


def pruning_manifest(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per shard its rows and each dimension's minimum and maximum: what a reader needs to skip shards."""
    bounds = [f(d).alias(f"{p}_{d}") for d in dimensions for p, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *bounds)


def write_shards(df: DataFrame, dimensions: list[str], n_shards: int, tie: list[str], path: str) -> None:
    """Writes the rows to path/shard=.../ in curve order. Each row is carried with its place, so repeated rows and rows
    without a key are written as often as they occur."""
    placed = hilbert_shards(df, dimensions, n_shards, tie)
    placed.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_facts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size (UTF-8 bytes plus 1) and text_crc32 of every document, stored without the texts."""
    text = F.col("text").cast("string")
    return stored(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        ),
        "document-facts",
    )


def op1_hilbert(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    rows = hilbert_shards(document_facts(docs), ["source", "lang", "size"], n_shards, ["doc_id", "text_crc32"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
