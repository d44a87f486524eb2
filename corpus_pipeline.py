"""A corpus from documents to token ids, in five stages over the columns of `documents`.

Each stage takes the whole of what its predecessor kept. All but the last return the columns of documents; a stage
reads only the columns it names and passes the others on. What goes grows with the documents, so it meets them in a
join that deals both by doc_id, whatever the size.

Defined cases: a null text, or one without a letter, has no language and goes at the first stage; a row without a doc_id
is in no group of copies and holds no passage that could be told of it, and stays; repeated rows stay or go together; an
empty table gives no rows at any stage; further columns, whatever their names, pass through all stages but the last; long
texts are taken whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, decontam, langid, neardup, pii, queries
from evidentia.llm.common import ship_package, stored, table

#: A document goes if no language is found in it, or none that has this share of its words.
LEAST_SHARE = 0.5

#: Rows that a task hands to a Python worker at once. Whole texts go both ways here, and Spark's default of 10,000 holds
#: tens of MB of them in every buffer of executor and worker.
MOST_ROWS = 2000


def prepared(spark: SparkSession) -> None:
    """The session as the stages want it; it stays so, as what a stage returns runs later."""
    ship_package(spark)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= MOST_ROWS:
        spark.conf.set(conf, MOST_ROWS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a predominant language; the model is trained on the labelled documents it is given."""
    prepared(spark)
    model = langid.fit(docs.where(~F.coalesce(queries.held_out(), F.lit(False))))
    return langid.predominant(docs, model, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id."""
    prepared(spark)
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    gone = decontam.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format; n_chars follows the new text."""
    prepared(spark)
    return pii.pseudonymise(docs, queries.PII_KEY).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digests of ids and decoded text."""
    prepared(spark)
    return bpe.encode_documents(docs, queries.tokenizer_path())


STAGES = [
    ("language identification", languages),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", pseudonyms),
    ("byte-pair encoding", token_ids),
]

#: Token ids are beyond SQL; tests/llm/test_pipeline.py holds the rows against a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
