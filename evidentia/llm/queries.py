"""The operators as queries over the table of documents, and SQL for those that SQL expresses."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontam, divergence, kneser_ney, langid, materialise, neardup, pii, quality, sharding, token_counts, toxicity
from .common import shared_folder, stored, table

BPE_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op1_hilbert(table(spark, sf_dir, "documents"), n_shards=8)


#: For queries and tests; a deployment passes its own.
PII_KEY = b"evidentia-test-key"
ORDER_KEY = 20_240_229


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select(F.col("doc_id").cast("long"), "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, reads them again, and tells of each record where it lies and what it holds."""
    made = materialise.sequences(table(spark, sf_dir, "documents"), tokenizer_path())
    path = f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
    ordered = materialise.in_training_order(made, ORDER_KEY)
    materialise.write_shards(ordered, path)
    runs = materialise.runs_of(spark, path)
    at, size = F.col("slot"), materialise.n_records(runs)
    return materialise.records(runs).select(
        "doc_id", "seq_no", "n_tokens", materialise.index_at(at, size, ORDER_KEY).alias("index"), at,
        F.expr(f"slot div {materialise.PER_SHARD}").alias("shard"), (at % materialise.PER_SHARD).alias("offset"), F.sha2("record", 256).alias("record_sha256"))


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM b
), ig AS (
  SELECT item_id, n, k, gram, count(*) AS c FROM (
    SELECT item_id, n, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM b)) GROUP BY ALL
), dg AS (
  SELECT doc_id, len_w, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT doc_id, w, len(w) AS len_w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, len_w, item_id, n, dg.k, i, gram, c FROM dg JOIN ig USING (k, gram)
), win AS (
  SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(1, i - (n - k)), least(i, len_w - n + 1) + 1)) AS s FROM hit
), o AS (
  SELECT doc_id, item_id, s, n, k, sum(least(x, c)) AS o FROM (
    SELECT win.doc_id, win.item_id, win.s, win.n, win.k, gram, any_value(c) AS c, count(*) AS x
    FROM win JOIN hit ON win.doc_id = hit.doc_id AND win.item_id = hit.item_id AND i BETWEEN s AND s + win.n - win.k GROUP BY ALL) GROUP BY ALL
), m AS (
  SELECT doc_id, item_id, max(o / (2.0 * (n - k + 1) - o)) AS similarity FROM o WHERE 180 * o >= 160 * (n - k + 1) GROUP BY ALL
), p AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items, max(similarity) AS similarity FROM m GROUP BY doc_id)
SELECT d.doc_id, p.items IS NOT NULL AS contaminated, coalesce(len(p.items), 0)::BIGINT AS n_items, coalesce(array_to_string(p.items, ','), '') AS items,
       coalesce(p.similarity, 0.0)::DOUBLE AS similarity
FROM d LEFT JOIN p USING (doc_id)
"""


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored(quality.ledger(table(spark, sf_dir, "documents")), "rule-ledger")
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes("v2").alias("kept"),
        F.col("failed").cast("long").alias("failed_bits"), "n_lines", "n_upper_words",
    )


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return kneser_ney.judge(table(spark, sf_dir, "documents"), trusted)


def op10_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), base AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
  FROM d
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM base WHERE n_words >= 8)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id
), m AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, n_upper_words
  FROM base b LEFT JOIN covered c USING (doc_id)
), r AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper_words > n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept,
       failed_bits, n_lines, n_upper_words FROM r
"""


TOXIC_FROM = 0.7


def op11_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~F.coalesce(held_out(), F.lit(False)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_words", "strong_words")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.delta_lloyd(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3)


def _lloyd_sql(rounds: int = 10, clusters: int = 8, seed: int = 3) -> str:
    """Lloyd's algorithm in plain rounds, a pair of tables each."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL) ORDER BY h, x LIMIT {clusters}
)"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'j': j}}) AS m FROM v, c{k} GROUP BY r
)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT o.j, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (
    SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT j, i, sum(e) AS s, count(*) AS n FROM (SELECT a.m.j AS j, unnest(range(1, 65)) AS i, unnest(x) AS e FROM v JOIN a{k} a USING (r)) GROUP BY j, i) GROUP BY j
  ) n USING (j)
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a.m.j::INTEGER AS cluster, a.m.d::BIGINT AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.j))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.j = a.m.j
"""


OP12_SQL = _lloyd_sql()


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS MATERIALIZED (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v))::BIGINT AS p FROM dense JOIN v USING (lang)
), q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v))::BIGINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL SELECT * FROM (
  SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term) WHERE rank <= 200
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_feistel_pii": op2_feistel_pii,
    "op3_bpe_tree": op3_bpe_tree,
    "op4_training_order": op4_training_order,
    "op5_simhash_decontamination": op5_simhash_decontamination,
    "op6_prefix_token_counts": op6_prefix_token_counts,
    "op7_rule_ledger": op7_rule_ledger,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_language_mixture": op9_language_mixture,
    "op10_minmax_neardup": op10_minmax_neardup,
    "op11_class_kneser_ney": op11_class_kneser_ney,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {"op5_simhash_decontamination": OP5_SQL, "op7_rule_ledger": OP7_SQL, "op10_minmax_neardup": OP10_SQL, "op12_delta_lloyd": OP12_SQL, "op13_source_divergence": OP13_SQL}
