import math
import os
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import kneser_ney as kn
from evidentia.operators import joins


def tokens(text):
    return ["<s>", "<s>", *kn.TOKEN.findall(text), "</s>"]


def brute(texts, asked):
    """Perplexity of a text under interpolated modified Kneser-Ney, from the formulas over plain dictionaries."""
    counts = Counter()
    for t in texts:
        w = tokens(t)
        counts.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    orders = []
    for order in (3, 2, 1):
        n = [sum(c == j for c in counts.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0] + [e if y is not None and n[j] and (e := j - (j + 1) * y * n[j + 1] / n[j]) > 0 else j / 2 for j in (1, 2, 3)]
        total, taken = Counter(), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3)]
        orders.append((dict(counts), d, total, taken))
        counts = Counter(g[1:] for g in counts)
    v = len(orders[-1][0]) + 1

    def p(g, k):
        if not g:
            return 1 / v
        own, d, total, taken = orders[k]
        lower = p(g[1:], k + 1)
        if g[:-1] not in total:
            return lower
        c = own.get(g, 0)
        return max(c - d[min(c, 3)], 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * lower

    w = tokens(asked)
    return math.exp(-sum(math.log(p(tuple(w[i : i + 3]), 0)) for i in range(len(w) - 2)) / (len(w) - 2))


GOOD = ["the cat sat on the mat.", "the dog sat on the log", "a cat and a dog met on the mat", "the mat and the log, a cat", "on the mat the cat sat", "a dog met the cat", "the log and the dog"]


def folds(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"]: r["f"] for r in df.select("text", kn.fold(F.col("text")).alias("f")).collect()}


def expected(spark, rows, trusted):
    """doc_id -> perplexity under the other fold's trusted texts of the language."""
    fold, own = folds(spark, {t for _, t, _ in rows}), defaultdict(list)
    for i, t, lang in rows:
        if i in trusted and t:
            own[lang, fold[t]].append(t)
    return {i: brute(own[lang, 1 - fold[t]], t) if t and own[lang, 1 - fold[t]] else None for i, t, lang in rows}


@pytest.mark.parametrize("hot_share, step", [(joins.HOT_SHARE, kn.STEP), (0.05, 7)])
def test_against_formulas(spark, monkeypatch, hot_share, step):
    monkeypatch.setattr(joins, "HOT_SHARE", hot_share)
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    monkeypatch.setattr(joins, "SALTS", 3)
    asked = ["the cat met the dog", "zzqx#$ kkk", "é the 🙂 log", "Der Der Der Der"]
    rows = [(i, t, "en") for i, t in enumerate(GOOD)] + [(50 + i, t, "de") for i, t in enumerate(GOOD[::-1])] + [(100 + i, t, "en") for i, t in enumerate(asked)]
    trusted = {*range(len(GOOD)), *range(50, 50 + len(GOOD))}
    missing = [(20, None, "en"), (21, "", "en"), (22, "bonjour", "fr"), (23, "x", None)]
    docs = spark.createDataFrame(rows + missing + [(100, asked[0], "en")], "doc_id long, text string, lang string").selectExpr("*", "1 AS m", "2 AS row", "3 AS `key`").repartition(3)
    found = kn.judge(docs, spark.createDataFrame([(i,) for i in [*trusted, 999, None]], "doc_id long")).collect()
    assert len(found) == len(rows) + len(missing) + 1
    by = {r["doc_id"]: r for r in found}
    want = expected(spark, rows, trusted)
    assert set(folds(spark, GOOD).values()) == {0, 1}
    for i, t, lang in rows:
        assert by[i]["perplexity"] == pytest.approx(want[i], rel=1e-9)
        assert by[i]["n_scored"] == len(tokens(t)) - 2
    for lang in ("en", "de"):
        limit = max(want[i] for i, t, x in rows if x == lang and i in trusted)
        assert all(by[i]["threshold"] == pytest.approx(limit, rel=1e-9) and by[i]["kept"] == (by[i]["perplexity"] <= by[i]["threshold"]) for i, t, x in rows if x == lang)
    assert not by[101]["kept"]
    assert all(by[i]["perplexity"] is None and by[i]["kept"] and by[i]["n_scored"] == 0 for i, _, _ in missing)


def test_copies_don_t_vouch_for_a_text(spark):
    """Exact copies of an odd trusted text, and near ones, leave its perplexity high."""
    rng = np.random.default_rng(11)
    odd = " ".join(f"q{x}" for x in rng.integers(0, 999, 60))
    near = [" ".join("other" if k == at else w for k, w in enumerate(odd.split())) for at in (5, 30, 55)]
    least = folds(spark, [odd, *near])
    assert sum(least[n] == least[odd] for n in near) >= 2
    rows = [(i, t, "en") for i, t in enumerate(GOOD)] + [(500, odd, "en")]
    copies = [(600 + i, odd, "en") for i in range(8)] + [(700 + i, n, "en") for i, n in enumerate(near) if least[n] == least[odd]]
    judged = []
    for given in (rows, rows + copies):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
        judged.append({r["doc_id"]: r["perplexity"] for r in kn.judge(docs, docs.select("doc_id")).collect()}[500])
    assert judged[0] == pytest.approx(judged[1], rel=1e-9)
    assert judged[0] > 1.5 * brute([*GOOD, odd], odd)  # what a model that has seen it would say


def test_keys_are_those_of_sql(spark):
    rng = np.random.default_rng(3)
    w = rng.integers(0, 1 << 63, (3, 50), np.uint64) * np.uint64(2) + np.uint64(1)
    df = spark.createDataFrame([tuple(int(x) for x in row) for row in w.view(np.int64).T], "a long, b long, c long")
    found = df.select(F.xxhash64("a").alias("x"), F.xxhash64("a", "b").alias("y"), F.xxhash64("a", "b", "c").alias("z")).collect()
    for k, name in enumerate("xyz"):
        assert [r[name] for r in found] == kn.gram_key(*w[: k + 1]).view(np.int64).tolist()


def test_long_texts_are_taken_in_steps(monkeypatch):
    text = "one two, three\nfour  " * 40 + "x" * 100 + " end"
    whole = [np.concatenate(x) for x in zip(*kn.trigrams(text))]
    monkeypatch.setattr(kn, "STEP", 10)
    steps = list(kn.trigrams(text))
    assert len(steps) > 20 and "".join(kn.pieces(text)) == text
    assert all((np.concatenate(a) == b).all() for a, b in zip(zip(*steps), whole))


def test_grams_move_packed_and_in_rounds(spark):
    """Shuffles and stored tables together stay below the bytes of the texts."""
    rng = np.random.default_rng(5)
    words = np.minimum(rng.zipf(1.3, (500, 400)), 20_000)
    rows = [(i, " ".join(f"word{x}" for x in line), "en") for i, line in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dirs = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), spark.sparkContext.getCheckpointDir().removeprefix("file:")]

    def used():
        total = 0
        for top in dirs:
            for d, _, names in os.walk(top):
                for name in names:
                    try:
                        total += os.lstat(os.path.join(d, name)).st_size
                    except OSError:  # gone meanwhile
                        pass
        return total

    before, peak, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = kn.judge(docs, docs.select("doc_id")).collect()
    finally:
        over.set()
        watcher.join()
    assert len(found) == 500 and all(r["n_scored"] == 401 for r in found)
    size = sum(len(t) for _, t, _ in rows)
    assert 0.02 * size < peak[0] < 0.8 * size, peak[0] / size


def test_every_gram_has_its_turn_once():
    rng = np.random.default_rng(6)
    numbers = kn.Numbers()
    lines = numbers.lines([" ".join(f"w{x}" for x in rng.integers(0, 50, 300)), None, "", "one", "w1 w2 " * 50])
    sizes = [max(0, len(x) - 2) for x in lines]
    own = kn.Slice({"n_buckets": 3, "sizes": sizes, "trusted": [0, 3], "data": kn.pack(np.array(numbers.hashes, np.uint64), np.concatenate(lines))})
    for asked in (own.asked_trigrams, own.asked_bigrams):
        at = np.concatenate([asked(turn)[0] for turn in range(kn.ROUNDS)])
        assert sorted(at) == np.flatnonzero(own.predicted).tolist() and len(at) == sum(sizes)
    values = [np.array([], np.uint64), np.array([0, 1, 255, 256]), np.array([2**64 - 1, 0], np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(kn.unpack(kn.pack(*values)), values))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert kn.judge(docs, docs.select("doc_id")).count() == 0
