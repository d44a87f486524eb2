import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import toxicity as tx
from evidentia.operators import joins

BAD = ["vile", "scumlike", "dreck"]


def text(rng, toxic):
    words = [f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(30, 120))) % 400]
    if toxic:
        for at in rng.integers(0, len(words), 4):
            words[at] = str(rng.choice(BAD))
    return " ".join(words)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, text(rng, i % 6 == 0), int(i % 6 == 0)) for i in range(n)]


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS w", "3 AS n", "4 AS toxic").repartition(4)
    return docs, spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id long, toxic int").selectExpr("*", "5 AS text", "6 AS quality")


def tokens(t):
    return tx.TOKEN.findall(t.lower())


def brute_ratios(texts):
    """word -> log ratio, from the formulas over plain dictionaries."""
    seen = {c: {b for t, x in texts if x == c for b in zip(["<s>", *tokens(t)], tokens(t))} for c in (0, 1)}
    k = {c: Counter(w for _, w in seen[c]) for c in (0, 1)} | {2: Counter(w for _, w in seen[0] | seen[1])}

    def parts(count):
        n = [sum(v == j for v in count.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0] + [g if n[1] and n[j] and (g := j - (j + 1) * y * n[j + 1] / n[j]) > 0 else j / 2 for j in (1, 2, 3)]
        total = sum(count.values())
        return lambda w: max(count[w] - d[min(count[w], 3)], 0) / total, sum(d[min(v, 3)] for v in count.values()) / total

    (ordinary, bo), (toxic, bt), (shared, bs) = parts(k[0]), parts(k[1]), parts(k[2])
    p = {w: shared(w) + bs / (len(k[2]) + 1) for w in k[2]}
    return {w: math.log((toxic(w) + bt * p[w]) / (ordinary(w) + bo * p[w])) - math.log(bt / bo) for w in k[2]}


def test_ratios_against_formulas(spark, monkeypatch):
    monkeypatch.setattr(tx, "MOST_HELD", 50)
    rows = corpus(80, 1)
    rows += rows[:30] * 3  # copies count once
    counted = [(t, c) for _, t, c in rows if not tx.for_weights(tx.words(t, tx._Codes()))]
    assert 0 < len(counted) < len(rows)
    counts = tx.continuation_counts(spark.createDataFrame([(t, c) for _, t, c in rows], "text string, toxic int").repartition(3))
    found = {r["w"]: r["ratio"] for r in tx.log_ratios(counts).collect()}
    want = {int(tx._Codes().of([w]).view(np.int64)[0]): v for w, v in brute_ratios(counted).items()}
    assert found.keys() == want.keys()
    assert all(found[w] == pytest.approx(v, abs=1e-9) for w, v in want.items())


@pytest.mark.parametrize("hot, bits", [(joins.HOT_SHARE, tx.MOST_BITS), (0.05, 64)])
def test_held_out_accuracy(spark, monkeypatch, hot, bits):
    """Also with hot words split, and with a filter so small that it lets everything through."""
    monkeypatch.setattr(joins, "HOT_SHARE", hot)
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    if bits == 64:
        monkeypatch.setattr(tx, "LEAST_BITS", bits)
        monkeypatch.setattr(tx, "MOST_BITS", bits)
    rows = corpus(900, 2)
    docs, labels = frames(spark, rows)
    found = {r["doc_id"]: r for r in tx.scored(docs, labels, F.col("doc_id") < 600).collect()}
    assert len(found) == len(rows)
    judged = [(found[i]["score"] >= 0.7, c) for i, _, c in rows if i >= 600]
    assert sum(p and c for p, c in judged) >= 0.95 * sum(c for _, c in judged)
    assert sum(p and not c for p, c in judged) <= 2
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["n_words"] for i, t, _ in rows[:20]] == [len(tokens(t)) for _, t, _ in rows[:20]]


def test_labels_that_may_not_be_learned_from_change_nothing(spark):
    rows = corpus(300, 3)
    turned = [(i, t, 1 - c if i >= 200 else c) for i, t, c in rows]
    one, two = ({r["doc_id"]: r["score"] for r in tx.scored(*frames(spark, x), F.col("doc_id") < 200).collect()} for x in (rows, turned))
    assert one == two


def test_defined_cases(spark):
    rows = corpus(300, 4)
    docs, labels = frames(spark, rows)
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (None, "vile vile w1"), (1003, "w1 " * 400_000 + "vile"), (1004, rows[0][1]), (0, rows[0][1])]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    labels = labels.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1001, None), (0, 0)], "doc_id long, toxic int"))
    found = tx.scored(docs, labels, F.col("doc_id") < 200).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in found}
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"] and by[1000]["n_words"] == 0
    assert by[None]["strong_words"] == 2 and by[1003]["n_words"] == 400_001 and by[1003]["strong_words"] == 1
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1004)}) == 1


def test_without_both_classes(spark):
    docs, labels = frames(spark, corpus(40, 5))
    assert {r["score"] for r in tx.scored(docs, labels.where("toxic = 1"), F.lit(True)).collect()} == {1.0}
    assert {r["score"] for r in tx.scored(docs, labels.where("false"), F.lit(True)).collect()} == {0.0}
    assert tx.scored(docs.where("false"), labels, F.lit(True)).count() == 0


def test_filter_holds_its_words(spark):
    rng = np.random.default_rng(6)
    own = rng.integers(-(1 << 63), 1 << 63, 5000)
    bits = tx.bloom_filter(spark.createDataFrame([(int(x),) for x in own], "w long").repartition(3), len(own))
    assert tx.may_be_in(bits, own.view(np.uint64)).all()
    assert tx.may_be_in(bits, rng.integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.02


def test_long_texts_in_steps(monkeypatch):
    from evidentia.llm import kneser_ney

    long = "One two, three\nfour " * 50
    whole = tx.words(long, tx._Codes())
    monkeypatch.setattr(kneser_ney, "STEP", 7)
    assert (tx.words(long, tx._Codes()) == whole).all()


def test_likelihoods_of_all_words(spark, monkeypatch):
    """Every word of a text takes part in the comparison of the models, ordinary ones and weak ones too, also where a slice
    holds few documents."""
    monkeypatch.setattr(tx, "SLICE_CHARS", 1500)
    rows = corpus(60, 7) + [(900, "w1", 0), (901, "never_seen", 0), (902, "", 0)]
    docs, _ = frames(spark, rows)
    told = tx.profiles(docs).cache()
    counted = [(t, c) for _, t, c in corpus(80, 1)]
    ratio = brute_ratios(counted)
    table = spark.createDataFrame([(int(tx._Codes().of([w]).view(np.int64)[0]), r) for w, r in ratio.items()], "w long, ratio double")
    found = {r["doc_id"]: r for r in tx.evidence(told, tx.stored(tx.word_ratios(told, table), "answers")).collect()}
    assert len(found) == len(rows) and told.where("of_slice").count() > 3
    for i, t, _ in rows:
        own = [ratio.get(w, 0.0) for w in tokens(t)]
        for k, s in enumerate(tx.SHARES):
            want = sum(math.log(1 - s + s * math.exp(r)) for r in own) / max(1, len(own))
            assert found[i][f"at_{k}"] == pytest.approx(want, rel=1e-9, abs=1e-12)
        assert found[i]["n_words"] == len(own) and found[i]["strong_words"] == sum(r >= 1 for r in own)
    assert found[900]["at_6"] == pytest.approx(ratio["w1"]) and -1 < ratio["w1"] < 1 and ratio["w1"] != 0


def test_numbers_in_planes():
    for own in (np.zeros(0, np.int64), np.array([0, 1, 255, 256, 70_000, 2**32 - 1])):
        assert (tx.of_planes(tx.planes(own)) == own).all()
