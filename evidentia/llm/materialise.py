"""Training-order materialisation.

Sequences are numbered without gaps (0 .. n - 1) and a keyed Feistel permutation with cycle-walking gives each its
global slot: a pseudo-random order that anyone with the key can compute, both ways, without a table. Shards are ranges
of slots; a shard is one run of fixed-stride records, so record r of the training order lies in shard
r div per_shard at byte (r mod per_shard) * stride, and reading can resume anywhere.

A sequence is one window of `length` token ids of a document; the last one of a document is padded. Ids are bytes of
the text (256 values, and PAD for the end) unless a column of ids is given, two bytes each.

The order depends on the documents alone: the same table in other partitions gets the same slots.

Defined cases: a null or empty text has no sequences; rows without a doc_id come first; equal rows have sequences of
their own, next to each other in the index; a long text is a document of many sequences; an empty table gives no rows
and no shards; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Codec
from .common import discarded, shuffles_dropped, slices, stored, stored_at

LENGTH = 512
PER_SHARD = 1 << 18  # records: 256 MB a shard
PER_RUN = 256
MOST_ID = 65_535
PAD = 50256
ROUNDS = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots_of(index: np.ndarray, size: int, key: int, invert: bool = False) -> np.ndarray:
    """The keyed permutation of 0 .. size - 1, for many values at once."""
    value = np.array(index, np.uint64)
    if size < 2:
        return value.astype(np.int64)
    half = np.uint64(((size - 1).bit_length() + 1) // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    outside = np.ones(len(value), bool)
    while outside.any():  # cycle-walking: each value on its own until it is inside
        left, right = value[outside] >> half, value[outside] & mask
        for k in keys[::-1] if invert else keys:
            if invert:
                left, right = right ^ (_mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right ^ k) & mask)
        value[outside] = left << half | right
        outside = value >= np.uint64(size)
    return value.astype(np.int64)


def _permuted(c: Column, size: int, key: int, invert: bool = False) -> Column:
    @F.pandas_udf("long")
    def slot(index):
        import pandas as pd

        return pd.Series(slots_of(index.to_numpy(), size, key, invert))

    return slot(c)


def sequences(docs: DataFrame, path: str | None, length: int = LENGTH) -> DataFrame:
    """doc_id, seq_no, n_tokens and `record`: `length` ids of two bytes, little-endian, padded with PAD; and about the
    document `row` (a number of its own), `digest` (of its text) and `n_records`.

    path: a vocabulary for byte-level BPE of at most 65 536 ids; without it the ids are the bytes of the text.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text"))
    if path and (most := max(Codec.of(path).library.get_vocab(True).values())) > MOST_ID:
        raise ValueError(f"id {most} of the vocabulary doesn't fit two bytes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path) if path else None
        for batch, texts in slices(batches):
            at, numbers, sizes, totals, records = [], [], [], [], []
            full = [i for i, text in enumerate(texts) if text]
            given = [texts[i] for i in full]
            found = codec.encode_all(given) if codec else (np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in given)
            for i, raw in zip(full, found, strict=True):
                n = -(-len(raw) // length)
                padded = np.full(n * length, PAD, "<u2")
                padded[: len(raw)] = raw
                blob = padded.tobytes()
                at += [i] * n
                numbers += range(n)
                sizes += [length] * (n - 1) + [len(raw) - (n - 1) * length]
                totals += [n] * n
                records += [blob[i * 2 * length : (i + 1) * 2 * length] for i in range(n)]
            of_doc = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("row", "doc_id", "digest")]
            own = [pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(records, pa.binary())]
            yield pa.RecordBatch.from_arrays([*of_doc, *own], names=["row", "doc_id", "digest", "seq_no", "n_tokens", "n_records", "record"])

    return rows.mapInArrow(cut, "row long, doc_id long, digest long, seq_no long, n_tokens long, n_records long, record binary")


def in_training_order(made: DataFrame, key: int, per_shard: int = PER_SHARD) -> DataFrame:
    """Adds index, slot, shard and offset (record number inside the shard) to sequences.

    Indexes follow (doc_id, digest of the text, seq_no), whatever the partitions of the input: documents are put in
    order over a range partitioning and the numbers of their records summed up; the records meet their document's first
    index in a join by a number of the row, so no key has more than one text's records. The result is stored, so that
    neither that shuffle nor the records without an index take room beside what is made of it.
    """
    placed, unplaced_at = stored_at(made, "sequences")
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = placed.where("seq_no = 0").select("doc_id", "digest", "row", "n_records")
    order = ["doc_id", "digest", "row"]
    ordered = stored(firsts.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "documents-in-order")
    sums = ordered.groupBy("part").agg(F.sum("n_records").alias("own"))
    size = sums.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sums.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    inside = F.sum("n_records").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = ordered.join(F.broadcast(starts), "part").select("row", (F.col("start") + inside - F.col("n_records")).alias("base"))
    indexed = placed.join(base.hint("merge"), "row").withColumn("index", F.col("base") + F.col("seq_no")).drop("base", "row", "digest", "n_records")

    slotted = indexed.withColumn("slot", _permuted(F.col("index"), size, key)).withColumn("shard", F.expr(f"slot div {per_shard}")).withColumn("offset", F.expr(f"slot % {per_shard}"))
    whole = stored(slotted, "sequences-in-order")
    discarded(made.sparkSession, unplaced_at)
    return whole


def by_slot(ordered: DataFrame) -> DataFrame:
    """The sequences dealt by ranges of slots, in order inside each partition: what shards are written from."""
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartitionByRange(parts, "slot").sortWithinPartitions("slot")


RUN = "run long, first_slot long, data binary, doc_id array<long>, seq_no array<long>, n_tokens array<long>"
OF_RECORD = ("doc_id", "seq_no", "n_tokens")


def shard_runs(ordered: DataFrame, per_shard: int = PER_SHARD, per_run: int = PER_RUN) -> DataFrame:
    """shard, run, first_slot, data: fixed-stride records of consecutive slots of one shard put together; and a list
    each of what OF_RECORD names.

    Rows are dealt by ranges of shard and run, so a partition writes whole runs of per_run records, in order; runs are
    the unit that a reader fetches, at (slot - first_slot) * stride. A run ends where its shard does. Slots have no gaps,
    so the ranges follow from the last one and no sample is drawn.
    """
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard, run = F.expr(f"slot div {per_shard}").alias("shard"), F.expr(f"slot % {per_shard} div {per_run}").alias("run")
    a_shard = -(-per_shard // per_run)  # runs
    last = ordered.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0]
    n_runs = last // per_shard * a_shard + last % per_shard // per_run + 1
    part = F.expr(f"cast((shard * {a_shard} + run) * {parts} div {n_runs} as int)")
    columns = ["shard", "run", "slot", "record", *OF_RECORD]
    dealt = ordered.select(shard, run, "slot", "record", *OF_RECORD).repartitionById(parts, part).select(*columns).sortWithinPartitions("slot")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            shard, run, slot, record, *rest = zip(*held, strict=True)
            whole = [pa.array([shard[0]]), pa.array([run[0]]), pa.array([slot[0]]), pa.array([b"".join(record)], pa.binary())]
            return pa.RecordBatch.from_arrays([*whole, *[pa.array([list(x)], pa.list_(pa.int64())) for x in rest]], names=["shard", "run", "first_slot", "data", *OF_RECORD])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return dealt.mapInArrow(joined, f"shard long, {RUN}")


def write_shards(ordered: DataFrame, path: str, per_shard: int = PER_SHARD, per_run: int = PER_RUN) -> None:
    """Writes the runs as Parquet, a folder per shard; a reader of slots [a, b) opens shards a div per_shard to b div per_shard."""
    with shuffles_dropped(ordered.sparkSession):
        shard_runs(ordered, per_shard, per_run).write.partitionBy("shard").option("compression", "zstd").parquet(path)


def runs_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RUN}, shard long").parquet(path)


def records(runs: DataFrame, length: int = LENGTH) -> DataFrame:
    """slot, record and what OF_RECORD names, of each record of the runs."""
    stride = 2 * length
    each = runs.select("first_slot", "data", F.posexplode(F.arrays_zip(*OF_RECORD)).alias("at", "r"))
    return each.select((F.col("first_slot") + F.col("at")).alias("slot"), F.expr(f"substring(data, at * {stride} + 1, {stride})").alias("record"), *[F.col(f"r.{c}") for c in OF_RECORD])


def n_records(runs: DataFrame) -> int:
    return runs.agg(F.coalesce(F.sum(F.size("doc_id")), F.lit(0))).first()[0]


def index_at(slot: Column, size: int, key: int) -> Column:
    """Which sequence of all `size` lies at a slot: the permutation backwards."""
    return _permuted(slot, size, key, invert=True)


def read_slots(spark: SparkSession, path: str, first: int, last: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """The records of the slots from first to last, in order: resuming needs no other state than a slot."""
    runs = runs_of(spark, path).where((F.col("shard") >= first // per_shard) & (F.col("shard") <= last // per_shard))
    return records(runs, length).where(F.col("slot").between(first, last)).orderBy("slot")
