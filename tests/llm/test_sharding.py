from itertools import product

from pyspark.sql import functions as F

from evidentia.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2)):
        cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), [f"x{i}" for i in range(n)])
        at = cells.withColumn("h", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r["h"] for r in at] == list(range(1 << (n * bits)))
        for a, b in zip(at, at[1:]):
            assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_counts_and_slots(spark):
    rows = [(i, "x" * (i % 7), ["en", "de", None][i % 3], f"src{i % 4}", 0) for i in range(61)]
    rows += [(7, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).repartition(5)
    found = sharding.op1_hilbert(docs, 8).toPandas()
    assert len(found) == 64
    counts = found.groupby("shard")["slot"].apply(sorted)
    assert all(s == list(range(len(s))) for s in counts)
    assert {len(s) for s in counts} == {8}
    assert found[found.doc_id == 1]["size"].tolist() == [2]
    assert found["text_crc32"].isna().sum() == 3
    by_curve = found.sort_values(["shard", "slot"])["curve"].tolist()
    assert by_curve == sorted(by_curve)


def test_empty(spark):
    assert sharding.op1_hilbert(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest(spark):
    docs = spark.createDataFrame([(i, "t" * i, "en", f"s{i % 2}", i) for i in range(16)], SCHEMA)
    sharded = sharding.hilbert_shards(docs, ["source", "n_chars"], 4, ["doc_id"])
    manifest = sharding.pruning_manifest(sharded, ["source", "n_chars"]).collect()
    assert sum(r["n_rows"] for r in manifest) == 16
    assert all(r["min_n_chars"] <= r["max_n_chars"] for r in manifest)


def test_strings_are_told_apart_behind_equal_beginnings(spark):
    names = ["https://a.org/1", "https://a.org/2", "https://b.org", "common-crawl-2020", "common-crawl-2023", "é", "", "z" * 50]
    rows = [(i, names[i % 8]) for i in range(64)] + [(64 + i, names[0]) for i in range(40)] + [(200, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    cells = {(r["source"], r["c"]) for r in df.select("source", sharding.quantised(df, ["source"], 5)[0].alias("c")).collect()}
    by = dict(cells)
    assert len(cells) == 9 and by[None] == 0
    ordered = sorted(names, key=lambda x: x.encode())
    assert [by[x] for x in ordered] == sorted(by[x] for x in names) and len({by[x] for x in names}) == 8
    below = {x: sum(y is not None and y.encode() < x.encode() for _, y in rows) / 104 for x in names}
    assert all(abs(by[x] - 32 * below[x]) <= 1 for x in names)


def test_written_shards_hold_every_row_and_can_be_skipped(spark, tmp_path):
    rows = [(i % 97, f"source-{i * 7 % 10}", i * 13 % 100, f"t{i}") for i in range(800)] + [(1, "source-1", 5, "again")] * 2 + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, text string").selectExpr("*", "7 AS _c0", "8 AS rank", "9 AS n_rows", "'mine' AS slot").repartition(5)
    path = str(tmp_path / "shards")
    sharding.write_shards(df, ["source", "size"], 16, ["doc_id", "text"], path)
    back = spark.read.parquet(path)
    assert sorted(map(repr, (tuple(r) for r in back.select("doc_id", "source", "size", "text").collect()))) == sorted(map(repr, rows))
    assert back.select("_c0", "rank", "n_rows").distinct().collect() == [(7, 8, 9)]
    manifest = sharding.pruning_manifest(back, ["source", "size"]).collect()

    def opened(name, value):
        return sum(r[f"min_{name}"] <= value <= r[f"max_{name}"] for r in manifest)

    # in a random order every one of the 16 shards would be opened
    assert sum(opened("source", f"source-{i}") for i in range(10)) / 10 <= 7
    assert sum(opened("size", i) for i in range(100)) / 100 <= 7
