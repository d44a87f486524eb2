import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import materialise as m


def test_slots_permute():
    for size in (1, 2, 3, 100, 1025):
        slots = m.slots_of(np.arange(size), size, 7)
        assert sorted(slots) == list(range(size))
        assert (m.slots_of(slots, size, 7, invert=True) == np.arange(size)).all()
    assert (m.slots_of(np.arange(100), 100, 7) != m.slots_of(np.arange(100), 100, 8)).any()


ROWS = [(i, "ab" * i) for i in range(40)] + [(5, "ab" * 5), (5, "other"), (None, "x"), (99, None), (98, ""), (100, "long text " * 300)]


def placed(spark, parts):
    docs = spark.createDataFrame(ROWS[::-1] if parts > 1 else ROWS, "doc_id long, text string").selectExpr("*", "0 AS slot", "1 AS row").repartition(parts)
    return m.in_training_order(m.sequences(docs, None, length=8), 3, 16)


def test_shards(spark, tmp_path):
    ordered = placed(spark, 3).cache()
    found = ordered.toPandas()
    n = len(found)
    assert n == sum(-(-len(t or "") // 8) for _, t in ROWS)
    assert sorted(found["slot"]) == sorted(found["index"]) == list(range(n))
    assert ((found["shard"] * 16 + found["offset"]) == found["slot"]).all()
    texts = {}
    for r in found.sort_values("index").itertuples():
        own = np.frombuffer(r.record, "<u2")
        assert (own[r.n_tokens :] == m.PAD).all()
        assert r.seq_no == 0 or len(list(texts.values())[-1]) == r.seq_no * 8
        texts.setdefault(r.index - r.seq_no, b"")
        texts[r.index - r.seq_no] += bytes(own[: r.n_tokens].astype(np.uint8))
    assert sorted(t.decode() for t in texts.values()) == sorted(t for _, t in ROWS if t)
    path = str(tmp_path / "shards")
    m.write_shards(ordered, path, per_shard=18, per_run=4)
    records = {r["slot"]: r["record"] for r in m.read_slots(spark, path, 10, 61, 8, 18).collect()}
    want = found.set_index("slot")["record"]
    assert records == {s: want[s] for s in range(10, 62)}
    runs = m.runs_of(spark, path)
    assert m.n_records(runs) == n
    back = m.records(runs, 8).withColumn("index", m.index_at(F.col("slot"), n, 3)).collect()
    assert {(r["index"], r["slot"], r["seq_no"], r["n_tokens"]) for r in back} == set(zip(found["index"], found["slot"], found["seq_no"], found["n_tokens"])) and len(back) == n
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in back) == sorted(found["doc_id"].fillna(-1))
    assert [r["slot"] for r in m.by_slot(ordered).select("slot").collect()] == list(range(n))


def test_same_slots_whatever_the_partitions(spark):
    def seen(df):
        return sorted((r["slot"], r["index"], -1 if r["doc_id"] is None else r["doc_id"], r["seq_no"], bytes(r["record"])) for r in df.collect())

    assert seen(placed(spark, 1)) == seen(placed(spark, 7))


def test_wide_vocabularies_are_refused(spark, monkeypatch):
    import public_tokenizers
    import pytest

    monkeypatch.setattr(m, "MOST_ID", 1000)
    with pytest.raises(ValueError):
        m.sequences(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ordered = m.in_training_order(m.sequences(docs, None), 1)
    assert ordered.count() == 0
    m.write_shards(ordered, str(tmp_path / "none"))
    assert m.read_slots(spark, str(tmp_path / "none"), 0, 10).count() == 0


def test_disk_holds_the_records_twice_at_most(spark, tmp_path):
    """Once in order and once as shards: neither shuffles of records nor a copy without an index stay beside them."""
    from pathlib import Path

    from evidentia.llm.common import CLEANUP, shared_folder

    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, rng.bytes(8000).hex()) for i in range(100)], "doc_id long, text string").repartition(3)
    own = Path(shared_folder(spark).removeprefix("file:")) / spark.sparkContext.applicationId

    def kept():
        return [len(list(own.glob(f"sequences-{x}*"))) for x in ("[0-9a-f]", "in-order-")]

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return sum(Path(f).stat().st_size for f in files if f.endswith(".data") and Path(f).exists())

    kept_before, shuffled_before = kept(), shuffled()
    m.write_shards(m.in_training_order(m.sequences(docs, None), 3, 16), str(tmp_path / "shards"), 16, 4)
    assert [a - b for a, b in zip(kept(), kept_before)] == [0, 1]
    assert shuffled() - shuffled_before < 200_000  # of records of 3.2 MB
    assert spark.conf.get(CLEANUP, "false") == "false"
    assert m.read_slots(spark, str(tmp_path / "shards"), 0, 10**6, per_shard=16).count() == 100 * 32
