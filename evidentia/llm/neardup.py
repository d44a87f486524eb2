"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of SHINGLE words. Under each of PERMUTATIONS hash functions both the least
and the greatest value are kept, so one evaluation gives two signature values; ROWS values make a band. Documents that
share a band are candidates, in two steps that never list all pairs of a bucket:

1. every member of a bucket is compared with the bucket's smallest document, on full sets: first with the smallest one
   of all its buckets, and then, where that has not put them into one component, with those of its other buckets;
   confirmed links give components;
2. buckets that still hold several components hand over their documents to an exact join: shingles are ordered by
   how rare they are among these documents, and two documents of different components are compared only if they share
   a shingle so early in both orders that enough of each is left to reach the similarity. Documents of one component
   need no comparison, and the largest component at a shingle is only ever compared with what is outside it.

Equal sets are joined to one class first, which is the node: its smallest doc_id, and a number where one doc_id is the
smallest of several classes (rows with different texts). Each node has its set once, however often its row occurs. Links are confirmed on full sets of 64-bit shingle hashes.

Two texts with similarity of exactly 0.8 share a band with probability 1 - (1 - 0.8^4)^32, that is 1 - 5e-8; above that more.

Defined cases: a text without words (or null) has an empty set, is linked with nothing and is its own component; rows
with one doc_id are linked, whatever their texts, and all stay or go together; a row without doc_id joins no group (component_id null, kept);
an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, slices, stored

SHINGLE = 4
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _RANDOM.integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; with fewer words than width, the whole sequence is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z; \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    total = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        total += codes[k : k + n] * _PLACES[k]
    return np.unique(_mixed(total))


def bands(own: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """A key per band, from least and greatest values under each hash function."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    greatest = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(own), step):
        values = own[None, at : at + step] * _FACTORS[:, None] + _OFFSETS[:, None]
        values ^= values >> np.uint64(32)
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(greatest, values.max(axis=1), out=greatest)
    signature = np.stack([least, greatest], axis=1).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * _PLACES[32 + k] + signature[:, k])
    return keys


def _digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(blake2b(own.tobytes(), digest_size=16).digest(), np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's digest (k1, k2) and its band keys (empty for an empty set)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sizes, first, second, keys = [], [], [], []
            for text in texts:
                own = shingles(text)
                digest = _digest(own)
                sizes.append(len(own))
                first.append(digest[0])
                second.append(digest[1])
                keys.append(bands(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), listed],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(signed, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, the set's digest (k1, k2) and the whole set as `sh`."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            own = [shingles(t).view(np.int64) for t in texts]
            ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            digests = np.array([_digest(o) for o in own])
            listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), listed], names=["doc_id", "k1", "k2", "sh"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "doc_id long, k1 long, k2 long, sh array<long>")


def needed_overlap(a: Column, b: Column) -> Column:
    """The least intersection of sets of these sizes that reaches the similarity."""
    return F.ceil((a + b) * NUM / F.lit(float(NUM + DEN)) - F.lit(1e-9))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of stored pairs whose full sets reach the similarity. A document with many pairs is split."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa")).join(many, "a")
    right = sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    close = both * (NUM + DEN) >= NUM * (F.size("sa") + F.size("sb"))
    possible = F.least(F.size("sa"), F.size("sb")) * DEN >= F.greatest(F.size("sa"), F.size("sb")) * NUM
    return joined(pairs, left, ["a"], "n_pairs").join(right, "b").where(possible).where(close).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable. Rounds of taking the neighbours' least label and then the label's own
    label, until nothing changes; each round is checkpointed. Nodes with many neighbours, and labels that many nodes
    bear, are split."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.count(F.lit(1)).alias("degree")).checkpoint()
    while True:
        near = joined(both, labels.select(F.col("node").alias("b"), "comp", "degree"), ["b"], "degree")
        seen = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(seen, "node").select("node", "comp", "degree", F.least("comp", "near").alias("new")).checkpoint()
        bearers = hooked.groupBy("new").agg(F.count(F.lit(1)).alias("n"))
        above = labels.select(F.col("node").alias("new"), F.col("comp").alias("top")).join(bearers, "new")
        low = F.least("new", "top")
        jumped = joined(hooked, above, ["new"], "n").select("node", low.alias("comp"), "degree", (low < F.col("comp")).alias("changed")).checkpoint()
        labels = jumped.drop("changed")
        if jumped.where("changed").limit(1).count() == 0:
            return labels.drop("degree")


def with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets (cid, band, first) with comp and first_comp, the components of the member and of the
    bucket's least node; a node without a link is its own component."""
    own = labels.select(F.col("node").alias("cid"), "comp")
    found = members.join(own, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    heads = members.groupBy(F.col("first").alias("cid")).agg(F.count(F.lit(1)).alias("n_rows")).join(own, "cid", "left")
    heads = stored(heads.select(F.col("cid").alias("first"), F.coalesce("comp", "cid").alias("first_comp"), "n_rows"), "heads")
    return stored(joined(found, heads, ["first"], "n_rows"), "labelled")


def rare_first_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components among these sets that can reach the similarity: exact, by rare shingles.

    In the order from rare to common, the first shingle that two similar sets share has at most size - overlap others
    before it in either. sets: doc_id, sh; labels: doc_id, comp.
    """
    comps = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("comp_size"))
    sized = sets.join(joined(labels, comps.withColumn("weight", F.col("comp_size")), ["comp"], "weight"), "doc_id")
    listed = sized.select("doc_id", "comp", "comp_size", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    often = listed.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    placed = listed.join(often, "s").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "s")) - 1)
    early = placed.where((F.col("df") > 1) & (F.col("n") - F.col("place") >= F.ceil(F.col("n") * NUM / F.lit(float(DEN)) - F.lit(1e-9)))).drop("df")
    early = stored(early, "early-shingles")
    at = early.groupBy("s").agg(F.max(F.struct("comp_size", "comp")).alias("top"), F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    mixed = stored(at.where("lo <> hi").select("s", F.col("top.comp").alias("top"), "least", "n_rows"), "mixed-shingles")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * NUM / F.lit(float(DEN)) - F.lit(1e-9)))
    able = stored(joined(early, mixed, ["s"], "n_rows").where(F.col("n") - F.col("place") >= needed_overlap(F.col("n"), smallest)), "rare-shingles")
    x, y = able.where("comp <> top").alias("x"), able.alias("y")
    other = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("x.top")) | (F.col("x.doc_id") < F.col("y.doc_id")))
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & other & (left >= needed_overlap(F.col("x.n"), F.col("y.n"))))
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept, a row per document."""
    signed = stored(signatures(docs), "signatures")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("id").orderBy("k1", "k2")).alias("number")
    classes = stored(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")).select("k1", "k2", F.struct("id", number).alias("cid")), "classes")
    firsts = named.join(classes, ["k1", "k2"]).where("doc_id = cid.id")
    banded = stored(firsts.select("cid", F.explode("bands").alias("band")).distinct(), "bands")
    buckets = banded.groupBy("band").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first <> last")
    members = stored(banded.join(buckets.select("band", "first"), "band"), "buckets")

    wanted = classes.join(members.select("cid").distinct(), "cid").select(F.col("cid.id").alias("doc_id"), "k1", "k2", "cid")
    texts = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi")
    once = shingle_sets(texts).join(wanted, ["doc_id", "k1", "k2"]).groupBy("doc_id", "k1", "k2").agg(F.first("cid").alias("cid"), F.first("sh").alias("sh"))
    sets = stored(once.select(F.col("cid").alias("doc_id"), "sh"), "sets")
    # every node meets the least node of its buckets; then those of each bucket that are still in other components
    nearest = stored(members.where("cid <> first").groupBy(F.col("cid").alias("b")).agg(F.min("first").alias("a")).select("a", "b"), "nearest")
    edges = confirmed(nearest, sets).checkpoint()
    labelled = with_components(members, components(edges))
    apart = labelled.where("cid <> first AND comp <> first_comp").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct()
    stars = stored(apart.join(nearest, ["a", "b"], "left_anti"), "stars")
    edges = edges.union(confirmed(stars, sets)).checkpoint()

    labelled = with_components(members, components(edges))
    open_buckets = labelled.where("comp <> first_comp").select("band").distinct()
    open_docs = stored(labelled.join(open_buckets, "band", "left_semi").select(F.col("cid").alias("doc_id"), "comp").distinct(), "open")
    more = confirmed(stored(rare_first_pairs(sets.join(open_docs.select("doc_id"), "doc_id", "left_semi"), open_docs), "rare-pairs"), sets)
    member = named.join(classes, ["k1", "k2"]).select("doc_id", "cid").distinct()
    several = member.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("doc_id", "a")
    same = member.join(several, "doc_id").where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    labels = components(edges.union(more).union(same))

    whole = member.join(labels.select(F.col("node").alias("cid"), "comp"), "cid", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "cid")).getField("id").alias("comp"))
    rows = signed.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    component = F.coalesce("comp", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
