import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import bpe, token_counts
from evidentia.llm.queries import tokenizer_path

PATH = tokenizer_path()
PARTS = ["the", "a", "aaaa", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "!!", "12", "é", "中文", "。", "<|endoftext|>", "<|endo", "text|>", "🙂", "\x1c", "\x85"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=50).map("".join)
REPEATED = st.tuples(st.sampled_from(["a", "ab", " ", "\n", "!", "the", "é"]), st.integers(1, 400)).map(lambda x: x[0] * x[1])


def library(text):
    return bpe.Codec.of(PATH).library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(TEXTS | REPEATED, st.sampled_from([1, 3, 17, 64, 100]))
def test_tree_is_exact(text, leaf):
    codec = bpe.Codec.of(PATH)
    want = library(text)
    assert codec.encode(text).tolist() == want
    assert codec.encode_tree(text, leaf).tolist() == want
    assert codec.decode(np.array(want, np.uint32)) == codec.library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS | REPEATED | st.sampled_from(["a cat, the cat.", " a", "a ", "don't a1 b. é,"]), max_size=6))
def test_all_together(texts):
    assert [ids.tolist() for ids in bpe.Codec.of(PATH).encode_all(texts)] == [library(t) for t in texts]


def test_a_word_is_looked_up_once_for_all_texts(monkeypatch):
    codec, asked = bpe.Codec.of(PATH), []

    class Kept(bpe.Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(codec, "kept", Kept(codec.kept.make))
    texts = ["the cat, and the cat", "a cat and the zqxv"] * 5
    assert [ids.tolist() for ids in codec.encode_all(texts)] == [library(t) for t in texts]
    assert asked.count("the") == asked.count("and") == asked.count("zqxv") == 1


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_every_prefix(text):
    text = text[:60]
    assert token_counts.Prefixes.of(PATH).of_text(text).tolist() == [len(library(text[: i + 1])) for i in range(len(text))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the cat " * 40), (2, None), (3, ""), (4, "a" * 900), (4, "a" * 900), (5, "don't <|endoftext|> stop"), (None, "x y" * 50)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS no").repartition(3)


def test_documents(docs):
    found = bpe.digest_documents(docs, PATH, leaf_chars=50).collect()
    assert len(found) == 7
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in found:
        text = texts[r["doc_id"]]
        ids = library(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digest_documents(docs.limit(0), PATH).count() == 0
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode_documents(docs, PATH, 50).collect()}
    assert ids[4] == library("a" * 900)


def test_counts(docs):
    found = {r["doc_id"]: r for r in token_counts.count_documents(docs, PATH, limit=5).collect()}
    table = token_counts.prefix_counts(token_counts.prefix_table(docs, PATH))
    asked = table.select("doc_id", token_counts.tokens_in(table["counts"], table["n_bytes"]).alias("n"), token_counts.chars_within(table["counts"], 5).alias("fits"))
    for r in asked.collect():
        assert (r["n"], r["fits"]) == (found[r["doc_id"]]["n_tokens"], found[r["doc_id"]]["fits_chars"])
    assert found[2]["n_tokens"] == 0 and not found[2]["over_limit"] and found[1]["over_limit"]
    assert token_counts.count_documents(docs.limit(0), PATH).count() == 0


def test_steps_of_any_width():
    for counts, width in (([1, 2, 129, 3], 1), ([1, 2, 131, 3], 2), ([1, 40_000, 2], 4), ([], 1)):
        found, steps = token_counts.packed(np.array(counts, np.int32))
        assert found == width and token_counts._counts(steps, found).tolist() == counts


def test_repeated_long_rows(spark):
    rows = [(None, "b" * 200)] * 3 + [(None, "c d " * 60), (4, "b" * 200), (4, "b" * 200), (4, "e" * 200)]
    found = bpe.digest_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, leaf_chars=50).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in found) == sorted((str(d), sha(t)) for d, t in rows)


def test_very_long_text(spark):
    text = "the cat sat on the mat " * 30_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = token_counts.count_documents(docs, PATH).first()
    assert (found["n_tokens"], found["n_bytes"], found["over_limit"]) == (len(library(text)), len(text), True)
    assert bpe.digest_documents(docs, PATH).first()["n_tokens"] == len(library(text))
