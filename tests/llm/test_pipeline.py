import hashlib
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from evidentia.llm import bpe, pii, queries

from .test_decontam import brute as brute_matches
from .test_neardup import brute as brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rnd = random.Random(11)
    vocab = {"en": ["the", "thing", "with", "other", "that", "ing", "house", "water", "where", "whole"], "fr": ["le", "chose", "avec", "autre", "maison", "que", "leau", "ou", "tout", "été"]}
    text = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + str(rnd.choice(["", "s", "es"])) for _ in range(n))
    rows = []
    for i in range(60):
        lang = rnd.choice(["en", "fr"])
        rows.append([i, text(lang, rnd.randrange(30, 200)), lang, "src", 0])
    item = "a benchmark passage of some words that no other document would ever hold by chance at all"
    rows[5][1] += " " + item.upper()
    for i, copy in ((60, 7), (61, 7), (62, 9)):
        rows.append([i, rows[copy][1], rows[copy][2], "src", 0])
    words = rows[62][1].split()
    words[3] = "edited"
    rows[62][1] = " ".join(words)
    rows[10][1] += " mail und.34@mail7.example.com from 97.51.17.173"
    rows += [[63, None, "en", None, None], [64, "12 34 --", None, "src", 8], [65, "", "fr", "src", 0], [66, "the thing " * 4000, "en", "src", 0]]
    return rows, [(1, item)]


def plain(rows, items):
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = brute_groups([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    leaked = {d for d, _ in brute_matches([(r[0], r[1]) for r in kept if r[0] != 66], items)}
    out = {}
    library = bpe.Codec.of(queries.tokenizer_path()).library
    for r in kept:
        if r[0] not in leaked:
            text = pii.pseudonymised(r[1], queries.PII_KEY)[0]
            ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
            out[r[0]] = (len(ids), ids.tobytes(), hashlib.sha256(text.encode()).hexdigest())
    return out


def test_against_a_plain_program(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain(rows, items)
    assert 5 not in want and 60 not in want and 10 in want and 66 in want
    assert found == want


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the thing with other words", "en", "s", 26)], SCHEMA).selectExpr("*", "'x' AS score", "1 AS kept")
    spark.createDataFrame([(1, "some item text here now then")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_workers_get_few_rows_at_once(spark, monkeypatch):
    """Whole texts go to the workers and back, so the rows of a batch are bounded; a smaller bound of the session stays."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"the thing with {i}", "en", "s", 16) for i in range(40)], SCHEMA).coalesce(1)
    before = spark.conf.get(conf)
    monkeypatch.setattr(corpus_pipeline, "MOST_ROWS", 7)

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "benchmark decontamination":  # without Python workers
                for given, most in (("10000", 7), ("0", 7), ("5", 5)):
                    spark.conf.set(conf, given)
                    stage(spark, docs.limit(0) if name == "near-duplicates" else docs, "")
                    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) == most
    finally:
        spark.conf.set(conf, before)
