import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import divergence as dv
from evidentia.operators import joins

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, top=200):
    """The audit over dense tables of whole numbers."""
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", la or "", s or "") for _, t, la, s in rows):
        own = Counter(TERM.findall(text.translate(LOWER)))
        docs[lang].update(own.keys())
        groups[lang, source].update(own)
    out = []
    for lang in {la for la, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: c for (la, s), c in groups.items() if la == lang}

        def chances(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: chances(c) for s, c in mine.items()}
        q = chances(sum(mine.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            above = [(-f(p[s][t], q[t]), t.encode()) for t in kept if mine[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def made(n, seed, sources=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["É", "naïve", "日本", "A"]
    rows = []
    for i in range(n):
        s = min(int(rng.geometric(0.5)), sources)
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 40)))
        rows.append((i, text.upper() if i % 5 == 0 else text, ["en", "de", None][i % 3] if i % 7 else "fr", f"s{s}" if i % 11 else None))
    return rows


def found(spark, rows, **set_to):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS n", "3 AS p", "4 AS item").repartition(4)
    return sorted(tuple(r) for r in dv.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("held, hot, cells", [(dv.MOST_HELD, joins.HOT_SHARE, dv.LEAST_CELLS), (5, 0.05, 1 << 16)])
def test_against_dense_tables(spark, monkeypatch, held, hot, cells):
    monkeypatch.setattr(dv, "MOST_HELD", held)
    monkeypatch.setattr(joins, "HOT_SHARE", hot)
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    rows = made(120, 3)
    rows += rows[:20]  # repeated rows count
    rows += [(None, None, None, None), (500, "", "en", "empty"), (501, "zzz yyy", "xx", "a"), (502, "", "xx", "b"), (503, "aa" * 60_000 + " b" * 5000, "en", "s1")]
    assert found(spark, rows) == brute(rows)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    rows = made(60, 9)
    monkeypatch.setattr(dv, "possible", lambda merged, lang, terms: np.ones(len(terms), bool))
    assert found(spark, rows) == brute(rows)


def test_sketch_never_underestimates_and_discards(spark):
    rows = [(i, f"common rare{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]} few{chr(97 + i // 2 % 26)}", "en", "s") for i in range(60)]
    merged = dv.sketch(spark.createDataFrame(rows, SCHEMA).repartition(5))
    docs = Counter(t for _, text, *_ in rows for t in set(dv.terms(text.encode())))
    names = list(docs)
    left = dict(zip(names, dv.possible(merged, b"en", names), strict=True))
    assert all(left[t] for t, n in docs.items() if n >= 3)
    assert sum(left[t] for t, n in docs.items() if n < 3) <= 2
    assert not dv.possible(merged, b"de", names).any()


def test_terms_are_those_of_the_pattern():
    rng = np.random.default_rng(4)
    pool = [*map(chr, range(128)), "é", "É", "日", "🙂", "\x80", " "]
    for _ in range(200):
        text = "".join(rng.choice(pool, 40))
        assert [t.decode() for t in dv.terms(text.encode())] == TERM.findall(text.translate(LOWER))


def test_large_counts_stay_exact(spark):
    row = spark.createDataFrame([(9_000_000_000_000_000, 9_500_000_000_000_000, 12_345)], "n long, total long, kept long")
    assert row.select(dv.chance("n", "total", "kept").alias("p")).first()["p"] == 1 + 10**9 * (9_000_000_000_000_000 + 1) // (9_500_000_000_000_000 + 12_345)


def test_empty(spark):
    assert found(spark, []) == []
