import math
import random

import numpy as np
import pytest

from evidentia.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the other thing happens with that "
FR = "le renard brun saute par dessus le chien paresseux et puis une autre chose arrive avec cela "


def test_mixture(spark):
    train = spark.createDataFrame([(1, EN, "en"), (2, FR, "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["en", "fr"]
    rows = [(1, EN * 3), (2, FR * 3), (3, EN * 3 + FR * 3), (4, None), (5, "12 !!"), (5, "12 !!"), (6, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'zz' AS lang_pred")
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert found[1]["lang_pred"] == "en" and found[1]["languages"] == ["en"]
    assert found[2]["lang_pred"] == "fr"
    assert sorted(found[3]["languages"]) == ["en", "fr"] and 0.3 < found[3]["score"] < 0.7
    assert found[4]["lang_pred"] == found[5]["lang_pred"] == "und" and found[4]["score"] == 0
    assert langid.identify(docs, model).count() == 7
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(docs, langid.fit(train.limit(0))).where("lang_pred = 'und'").count() == 7


def words_of(text, log_p):
    """Each word's log-likelihood under every language: the sum over its letters, found one by one."""
    out, word, padded = [], None, " " + text.lower() + " "
    for i in range(1, len(padded) - 1):
        if not padded[i].isalpha():
            word = None
            continue
        if word is None:
            word = [0.0] * log_p.shape[1]
            out.append(word)
        own = "".join(c if c.isalpha() else " " for c in padded[i - 1 : i + 2])
        bucket = langid.trigrams(own)[0][int(own[0].isalpha())]
        for k in range(len(word)):
            word[k] += float(log_p[bucket, k])
    return out


def em(words, langs):
    """Proportions over these languages and the log-likelihood, by plain sums."""
    share = {k: 1 / len(langs) for k in langs}
    scaled = [[math.exp(x - max(w)) for x in w] for w in words]
    for _ in range(langid.ROUNDS):
        new = dict.fromkeys(langs, 0.0)
        for w in scaled:
            total = sum(share[k] * w[k] for k in langs)
            for k in langs:
                new[k] += share[k] * w[k] / total if total > 0 else 0
        share = {k: v / len(words) for k, v in new.items()}
    return share, sum(math.log(sum(share[k] * w[k] for k in langs) + 1e-30) for w in scaled)


def brute(text, model):
    words = words_of(text, model.log_p)
    if not words:
        return "und", {}
    n = range(len(model.languages))
    full, _ = em(words, list(n))
    ranked = sorted(n, key=lambda k: (-full[k], k))
    best = (-math.inf, None)
    for size in range(1, len(ranked) + 1):
        share, log_l = em(words, sorted(ranked[:size]))
        value = log_l - langid.PENALTY * 0.5 * math.log(max(len(words), 2)) * (size - 1)
        if value <= best[0]:
            break
        best = (value, share)
    top = min(best[1], key=lambda k: (-best[1][k], k))
    return model.languages[top], {model.languages[k]: v for k, v in best[1].items()}


def test_against_plain_expectation_maximisation(spark, monkeypatch):
    rnd = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "abcdijkl"}

    def text(lang, n):
        return " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(2, 9))) for _ in range(n))

    train = spark.createDataFrame([(x, text(x, 300)) for x in letters for _ in range(3)], "lang string, text string")
    model = langid.fit(train.repartition(3))
    docs = []
    for i in range(60):
        parts = [text(x, rnd.randrange(1, 40)) for x in rnd.sample(sorted(letters), rnd.choice([1, 1, 2, 3]))]
        docs.append((i, ", ".join(parts).title() + rnd.choice(["", " 12 3", "!"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for step in (langid.STEP, 20):
        monkeypatch.setattr(langid, "STEP", step)
        found = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
        for i, t in docs:
            pred, shares = brute(t, model)
            assert found[i]["lang_pred"] == pred
            assert dict(zip(found[i]["languages"], found[i]["proportions"])) == pytest.approx(shares, abs=2e-3)
    assert 5 < sum(len(r["languages"]) > 1 for r in found.values())


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "one two, three12four\nfünf " * 30 + "x" * 70
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "STEP", 10)
    parts = list(langid.pieces(text))
    assert "".join(parts) == text and len(parts) > 20 and len(parts[-1]) >= 70
    assert sum(len(langid.trigrams(p)[1]) for p in parts) == len(whole[1])
    assert (np.concatenate([langid.trigrams(p)[0] for p in parts]) == whole[0]).all()


def test_model_counts_and_bound(spark, monkeypatch):
    rows = [(EN, "en"), (EN, "en"), (FR, "fr")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(2))
    counts = {"en": np.bincount(langid.trigrams(EN)[0], minlength=langid.N_BUCKETS) * 2, "fr": np.bincount(langid.trigrams(FR)[0], minlength=langid.N_BUCKETS)}
    seen = ((counts["en"] + counts["fr"]) > 0).sum()
    for k, lang in enumerate(model.languages):
        want = np.log((counts[lang] + langid.SMOOTHING) / (counts[lang].sum() + langid.SMOOTHING * 2 * seen))
        assert np.allclose(model.log_p[:, k], want, atol=1e-4)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_predominant_keeps_columns(spark):
    model = langid.fit(spark.createDataFrame([(EN, "en"), (FR, "fr")], "text string, lang string"))
    rows = [(1, EN), (2, None), (3, "12"), (4, EN + FR), (5, FR)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "'mine' AS _lang_pred", "1.5 AS _score", "doc_id")
    kept = langid.predominant(docs, model, 0.8)
    assert kept.columns == docs.columns and {(r["doc_id"], r["_lang_pred"]) for r in kept.collect()} == {(1, "mine"), (5, "mine")}
