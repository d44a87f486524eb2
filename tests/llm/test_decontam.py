import random
import re
from collections import Counter

from pyspark.sql import functions as F

from evidentia.llm import decontam


def brute(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = set()
    for item, text in items:
        own = words(text)
        if not own:
            continue
        n, k = len(own), min(5, len(own))
        bag = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        b = bag(own)
        for doc, t in docs:
            w = words(t)
            for s in range(len(w) - n + 1):
                o = sum((bag(w[s : s + n]) & b).values())
                if 180 * o >= 160 * (n - k + 1):
                    found.add((doc, item))
    return found


def test_against_brute_force(spark):
    rnd = random.Random(2)
    item = lambda n: [f"v{rnd.randrange(60)}" for _ in range(n)]
    items = {i: item(n) for i, n in enumerate([20, 20, 37, 48, 60, 3, 1, 300])}
    docs = []
    for d in range(60):
        w = [f"u{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 900))]
        if d % 2:
            own = list(items[d % 8])
            for _ in range(d % 3):
                own[rnd.choice([0, 1, -1])] = "zz"
            w[len(w) // 2 : len(w) // 2] = own
        docs.append((d, ", ".join(w).upper() if d % 5 else " ".join(w)))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (3, "x y " + " ".join(items[0])), (102, " ".join(items[4] * 3))]
    table = spark.createDataFrame([*docs, (None, "x")], "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS item_id").repartition(3)
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in items.items()], (50, None), (51, "!")], "item_id long, text string")
    want = brute(docs, [(i, " ".join(w)) for i, w in items.items()])
    assert len(want) > 15
    found = {(r["doc_id"], r["item_id"]) for r in decontam.matches(table, bench).collect()}
    assert found == want
    rows = decontam.contaminated(table, bench).collect()
    assert len(rows) == len(docs) + 1
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {d for d, _ in want}


def test_fingerprint_is_the_same_in_parts(spark):
    rnd = random.Random(5)
    texts = {n: " ".join(f"w{rnd.randrange(40)}" for _ in range(n)) for n in (1, 2, 200, 255)}
    df = spark.createDataFrame(list(texts.items()), "n int, text string").withColumn("hw", decontam.word_hashes(F.col("text")))
    short = {r["n"]: r["fp"] for r in df.select("n", decontam.fingerprint(F.col("hw"), F.col("n"), 255).alias("fp")).collect()}
    tripled = df.withColumn("hw", F.concat("hw", "hw", "hw"))  # three times each word: the same majorities
    long = {r["n"]: r["fp"] for r in tripled.select("n", decontam.fingerprint(F.col("hw"), 3 * F.col("n"), 1000).alias("fp")).collect()}
    assert short == long and len(set(short.values())) == 4
    hashes = {r["n"]: r["hw"] for r in df.collect()}
    for n, fp in short.items():
        assert fp == sum(1 << b for b in range(decontam.BITS) if 2 * sum(h >> b & 1 for h in hashes[n]) > n)


def test_recall_just_above_the_similarity(spark):
    rnd = random.Random(9)
    items, docs, want = [], [], set()
    for i in range(150):
        n = rnd.choice([15, 30, 50, 80, 150, 400])
        own = [f"w{rnd.randrange(2000)}" for _ in range(n)]
        items.append((i, " ".join(own)))
        may_differ = (n - 4) - -(-(n - 4) * 160 // 180)  # shingles
        planted, edits = list(own), max(0, may_differ // 5)
        for e in range(edits):
            planted[int((e + 0.5) * n / edits)] = f"x{rnd.randrange(10**6)}"
        for e in range(may_differ - 5 * edits):
            planted[e] = f"y{rnd.randrange(10**6)}"
        around = [f"u{rnd.randrange(5000)}" for _ in range(200)]
        docs.append((i, " ".join(around[:90] + planted + around[90:])))
        want.add((i, i))
    assert brute([docs[k] for k in range(0, 150, 10)], [items[k] for k in range(0, 150, 10)]) == {(k, k) for k in range(0, 150, 10)}
    found = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


def test_shuffled_path(spark, monkeypatch):
    """As many items as no task could be sent: the same result, and nothing is broadcast."""
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rnd = random.Random(4)
        items = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 5, 20, 40])))) for i in range(12)]
        filler = lambda n: " ".join(f"u{rnd.randrange(900)}" for _ in range(n))
        docs = [(i, f"{filler(30)} {items[i % 12][1]} {filler(700)}") for i in range(24)] + [(3, f"{filler(30)} {items[4][1]}"), (None, items[6][1]), (30, None), (31, ""), (32, filler(50))]
        docs += [(100 + i, docs[5][1]) for i in range(40)]  # copies share their hits
        frames = [spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id"))]
        far = decontam.matches(*frames)
        assert "Broadcast" not in far._jdf.queryExecution().executedPlan().toString()
        rows = {tuple(r) for r in far.collect()}
        monkeypatch.undo()
        assert rows == {tuple(r) for r in decontam.matches(*frames).collect()}
        assert {(r[0], r[1]) for r in rows if r[0] is not None} >= {(i, i % 12) for i in range(24)} and any(r[0] is None for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert not decontam.contaminated(docs, items.limit(0)).first()["contaminated"]
