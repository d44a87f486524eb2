import random

import numpy as np

from evidentia.llm import neardup
from evidentia.operators import joins


def brute(rows):
    sets = {i: frozenset(neardup.shingles(t).tolist()) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root(a), root(b)))
                comp[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, None), (3, ""), (4, " \n"), (5, "one two"), (6, "One\ttwo"), (7, "one")]
    for i in range(8, 160):  # a large group of near copies, more and less edited
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 9])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"y{rnd.randrange(50)}" for _ in range(30))) for i in range(30)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "one two")], "doc_id long, text string").selectExpr("*", "1 AS comp", "'x' AS bands").repartition(4)
    found = neardup.near_duplicates(docs).collect()
    want = brute(rows)
    assert len(found) == len(rows) + 2
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_split_groups_change_nothing(spark, monkeypatch):
    """Bands that see little leave nearly all to the exact join, whose shingles, hubs and labels are all split."""
    monkeypatch.setattr(joins, "HOT_SHARE", 0.01)
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    monkeypatch.setattr(joins, "SALTS", 3)
    monkeypatch.setattr(neardup, "bands", lambda own: np.array([len(own) % 2 + 1], np.uint64))
    rnd = random.Random(8)
    rows = []
    for i in range(90):  # nine families over one common passage, of several sizes
        words = [f"p{k}" for k in range(40)] + [f"f{i % 9}.{k}" for k in range(20 + 3 * (i % 9))]
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert 5 < len({c for _, c in want.values()}) < 60


def test_bands_meet_at_the_similarity():
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(1000):
        values = np.unique(rng.integers(0, 1 << 63, 120, np.uint64))  # 80 of 100 shared
        rng.shuffle(values)
        a, b = values[:90], np.concatenate([values[:80], values[90:100]])
        met += bool(set(neardup.bands(np.sort(a)).tolist()) & set(neardup.bands(np.sort(b)).tolist()))
    assert met == 1000


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:299_000])), (3, " ".join(words[150_000:]))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 3)}


def test_repeated_rows_keep_their_links(spark):
    base = [f"w{i}" for i in range(103)]  # 100 shingles
    near = base[:95] + [f"b{i}" for i in range(8)]  # shares 92
    rows = [(100, " ".join(base)), (101, " ".join(near))]
    for i in range(1, 25):  # the smallest of each bucket: close to both (88 shared), linked with neither
        rows.append((i, " ".join([*base[: 3 * i], f"z{i}", *base[3 * i + 1 : 95], *(f"y{i}.{k}" for k in range(8))])))
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(4)
    found = neardup.near_duplicates(docs).collect()
    want = brute(rows)
    assert want[101] == (100, 100) and want[100] == (100, 100)
    assert len(found) == 2 * len(rows)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in found)


def test_two_texts_under_one_id(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, two), (7, one + " end"), (8, two + " end"), (9, two), (3, " ".join(f"c{i}" for i in range(60)))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found) == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 5, False)]


def test_signature_estimates():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64))
    assert (neardup.bands(a) == neardup.bands(a.copy())).all()
    assert (neardup.bands(a, step=10) == neardup.bands(a)).all()


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
