import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>"


def lloyd(rows, clusters, rounds, seed, width):
    """Plain rounds over whole numbers: (vec_id, cluster, distance) of every kept vector, and the centroids."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in start[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*(v for (_, v), k in zip(kept, own) if k == j))] if j in own else m for j, m in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept] if c else [], c


def points(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 3, (4, width))
    return [(i, [float(np.float32(x)) for x in middle[i % 4] + rng.normal(0, spread, width)]) for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 3, 10])
def test_against_plain_rounds(spark, rounds):
    rows = points(150, 6, 5, 4.0)
    rows += rows[:30] + [(7, rows[3][1]), (None, rows[9][1]), (None, [0.0] * 6)]  # repeated rows, one id twice, no id
    rows += [(900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [1.0] * 5 + [float("-inf")]), (905, [])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS cluster", "3 AS distance").repartition(4)
    found = ce.delta_lloyd(df, clusters=5, rounds=rounds, width=6).collect()
    want, c = lloyd(rows, 5, rounds, 3, 6)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=key) == sorted(want, key=key)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    assert all(r["centroid_sha256"] == digest[r["cluster"]] for r in found)
    assert all(r["cluster_inertia"] == sum(d for _, k, d in want if k == r["cluster"]) and r["inertia"] == sum(d for *_, d in want) for r in found)


def test_ties_and_fewer_vectors_than_clusters(spark):
    rows = [(i, [0.0, 1.0]) for i in range(3)] + [(10, [0.0, -1.0])]
    found = ce.delta_lloyd(spark.createDataFrame(rows, SCHEMA), clusters=8, rounds=4, width=2).collect()
    want, _ = lloyd(rows, 8, 4, 3, 2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found) == sorted(want)


def test_empty_and_too_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ce.delta_lloyd(empty).count() == 0
    assert ce.delta_lloyd(spark.createDataFrame([(None, [1.0] * 64)], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="too large"):
        ce.delta_lloyd(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA)).count()


def test_a_round_compares_changed_centroids_and_moved_owners_only():
    rng = np.random.default_rng(1)
    c, v = rng.integers(-50, 50, (6, 4)), rng.integers(-50, 50, (300, 4))
    full = ce.distances(v, c)
    own, far = full.argmin(axis=1), full.min(axis=1)
    after = c.copy()
    after[[1, 4]] += rng.integers(-9, 9, (2, 4))
    changed = (after != c).any(axis=1)
    best, d = ce.nearest(v, own, far, after, changed)
    want = ce.distances(v, after)
    assert (best == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()
    # what has no reason to be compared keeps its stored distance, whatever that is
    best, d = ce.nearest(v, own, np.zeros_like(far), after, changed)
    stays = ~changed[own]
    assert (best[stays] == own[stays]).all() and (d[stays] == 0).all()


def test_transfers_are_signed(spark):
    state = spark.createDataFrame([(1, [5, 7], 0, 0, 1), (2, [1, 1], 1, 0, 1), (3, [2, -4], 2, 0, -1)], ce.STATE)
    sums, counts = ce.transfers(state, 3, 2)
    assert sums.tolist() == [[5, 7], [-5, -7], [2, -4]] and counts.tolist() == [1, -1, 1]


def test_superseded_states_are_deleted(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(ce, "discarded", lambda session, path: gone.append(path))
    state, _ = ce.clustered(spark.createDataFrame(points(60, 3, 2, 5.0), SCHEMA), clusters=4, rounds=3, width=3)
    assert gone and len(set(gone)) == len(gone)
    assert not any(f.removeprefix("file://").startswith(p.removeprefix("file:")) for p in gone for f in state.inputFiles())
    assert state.where(F.col("cluster") < 0).count() == 0
