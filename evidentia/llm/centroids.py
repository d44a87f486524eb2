"""Centroid clustering by Lloyd's rounds over differences.

A vector's assignment (its cluster and squared distance) is stored from round to round, and so are the sums and counts
of every cluster, which only the driver holds: clusters times components. A round compares a vector with the centroids
that have changed since the last one; a vector whose own centroid has moved is compared with all. Vectors that change
their cluster are transfers: they subtract themselves from one sum and add themselves to another. A task adds up the
transfers it sees, so that a round sends clusters times components signed numbers per task, however many vectors move.
The centroids that follow are those of Lloyd's algorithm exactly, since an unchanged centroid that was not the nearest
before cannot beat the stored distance. When no centroid changes, the rounds that are left would change nothing.

A state is written before the one it came from is deleted, so a lost executor costs one round's tasks, and two states at
most take room. All is whole numbers: components are floor(SCALE * x), sums are exact, centroids are floor(sum / count).

Defined cases: vectors that are null, have another number of components, or a null or non-finite one, are not kept;
repeated rows are vectors of their own; a vector without vec_id is assigned, but no round starts from it; of several
vectors with one vec_id the start takes the smaller ones first; with fewer vectors than clusters there are as many
clusters as vectors with a vec_id, and without any of these no row; a component beyond LARGEST is an error, since
squared distances might not fit a long; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, stored_at

WIDTH, SCALE = 64, 1024
CLUSTERS, ROUNDS = 8, 10
#: Of floor(SCALE * x): 64 squares of twice this fit a long.
LARGEST = (1 << 27) - 1
STATE = "vec_id long, v array<int>, cluster int, distance long, came_from int"
SLICE = 4096  # vectors compared at once


def quantised(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the whole components, of the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)))  # NaN is greater than all

    def component(e: Column) -> Column:
        return F.when(F.abs(e * scale) <= LARGEST, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))

    kept = vectors.where(F.coalesce((F.size(x) == width) & finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, component).alias("v"))


def starting(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The first centroids: the vectors with the least digests of their ids."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(digest, "v").select("v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([np.square(v - c).sum(axis=1) for c in centroids], axis=1)


def nearest(v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and distance of each vector, given what they were before `changed` (a flag per centroid) moved; cluster -1
    has no stored distance. Ties go to the smaller number."""
    cost = np.full((len(v), len(centroids)), np.iinfo(np.int64).max)
    moved = (cluster < 0) | changed[cluster]
    cost[:, changed] = distances(v, centroids[changed]) if changed.any() else 0
    if moved.any() and not changed.all():
        cost[np.ix_(moved, ~changed)] = distances(v[moved], centroids[~changed])
    stays = np.flatnonzero(~moved)
    cost[stays, cluster[stays]] = distance[stays]
    best = cost.argmin(axis=1)
    return best, cost[np.arange(len(v)), best]


def _components(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The next state: STATE, with the cluster before as came_from."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                before = batch.column("cluster").to_numpy()
                best, far = nearest(_components(batch), before, batch.column("distance").to_numpy(), centroids, changed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(best, pa.int32()), pa.array(far, pa.int64()), pa.array(before, pa.int32())],
                    names=["vec_id", "v", "cluster", "distance", "came_from"],
                )

    return state.mapInArrow(compared, STATE)


def transfers(state: DataFrame, clusters: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster bring to its sums (cluster x component) and counts, as whole numbers."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = np.zeros((clusters, width + 1), np.int64)
        for batch in batches:
            rows = np.column_stack([_components(batch), np.ones(batch.num_rows, np.int64)])
            old = batch.column("came_from").to_numpy()
            np.add.at(net, batch.column("cluster").to_numpy(), rows)
            np.subtract.at(net, old[old >= 0], rows[old >= 0])
        at, of = np.nonzero(net)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(of, pa.int32()), pa.array(net[at, of], pa.int64())], names=["cluster", "component", "net"])

    moved = state.where("cluster <> came_from").select("v", "cluster", "came_from")
    net = moved.mapInArrow(added, "cluster int, component int, net long").groupBy("cluster", "component").agg(F.sum(F.col("net").cast("decimal(38,0)")).alias("net"))
    found = np.zeros((clusters, width + 1), object)
    for r in net.collect():  # clusters x (components + 1) rows at most
        found[r["cluster"], r["component"]] = int(r["net"])
    return found[:, :width], found[:, width]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The state after the last assignment and the centroids (whole numbers) that it was made with."""
    spark = vectors.sparkSession
    start = quantised(vectors, width, scale).select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).cast("long").alias("distance"), F.lit(-1).alias("came_from"))
    centroids = starting(start, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids
    sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
    changed = np.ones(len(centroids), bool)
    state, place = stored_at(assigned(start, centroids, changed), "clusters")
    for _ in range(rounds):
        more, rows = transfers(state, len(centroids), width)
        sums, counts = sums + more, counts + rows
        after = np.array([[s // n for s in own] if n else list(c) for own, n, c in zip(sums, counts, centroids, strict=True)], np.int64)
        changed = (after != centroids).any(axis=1)
        centroids = after
        if not changed.any():
            break
        (state, place), old = stored_at(assigned(state, centroids, changed), "clusters"), place
        discarded(spark, old)
    return state, centroids


def with_inertia(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256; a row per cluster is sent to all tasks."""
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    rows = [(k, s, total, sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    told = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def delta_lloyd(vectors: DataFrame, **options: int) -> DataFrame:
    return with_inertia(*clustered(vectors, **options))

