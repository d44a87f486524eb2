from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import quality


def brute_repeated(words, width=8):
    grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    covered = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(width)}
    return len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeated(words)


def test_measures():
    text = "é b\n\x0b\nx# $\nx# $\n"
    assert quality.measure(text) == (6, 8, 4, 3, 1, 0, 0)
    assert quality.measure(None) == (0,) * 7


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good), (2, "short"), (3, None), (4, " ".join(["#w%d" % i for i in range(30)])), (4, " ".join(["#w%d" % i for i in range(30)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS failed")
    ledger = quality.ledger(docs).cache()
    kept = {(r["doc_id"], r["k"]) for r in ledger.select("doc_id", quality.passes("v2").alias("k")).collect()}
    assert kept == {(1, True), (2, False), (3, False), (4, False)}
    assert ledger.where(quality.passes("base")).count() == 3
    ablation = {r["rule"]: (r["n_fail"], r["n_only_this"], r["n_docs"]) for r in quality.ablation(ledger, "v2").collect()}
    assert ablation["symbols"] == (2, 2, 5) and ablation["few_words"] == (2, 2, 5)
    assert quality.ledger(docs.limit(0)).count() == 0
