"""Language identification as a mixture.

Training counts letter trigrams per language over all labelled texts given. A document is then taken as a mixture: each
word comes from one of the languages, with likelihoods from its trigrams, and expectation-maximisation estimates the
document's proportions. Every set of the k likeliest languages is refitted, and the set with the best log-likelihood,
less a penalty per language that grows with the logarithm of the words, is the document's languages.

The model is a table of languages x N_BUCKETS trigram buckets of four bytes (trigrams are hashed into the buckets), so
its size does not depend on the corpus; its counts do. It has MOST_LANGUAGES languages at most, which makes 134 MB in the
driver and in each worker; a corpus with more labels is refused, not cut. A document's words meet in one row, as its
text does; a long text is taken in steps that end where no letter stands.

Defined cases: a text that is null or has no letter, or a model without languages, gives `und` with score 0; equal
rows get equal results; ties go to the language that comes first by name; an empty table gives no rows; only the named
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

N_BUCKETS = 1 << 17
MOST_LANGUAGES = 256
STEP = 1_000_000  # characters
ROUNDS = 12
PENALTY = 2.0  # times half the logarithm of the number of words, per further language
SMOOTHING = 0.05
UNDETERMINED = "und"


class _Letters:
    table: np.ndarray | None = None

    @classmethod
    def of(cls) -> np.ndarray:
        """True where the code point is a letter."""
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each letter's trigram (itself and its neighbours, what is no letter as 0), and the starts of words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _Letters.of()[codes]
    padded = np.zeros(len(codes) + 2, np.uint64)
    padded[1:-1] = np.where(letter, codes, 0)
    mixed = padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[2:] * np.uint64(0x165667B19E3779F9)
    bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)).astype(np.int64)
    before = np.zeros(len(codes), bool)
    before[1:] = letter[:-1]
    starts = (letter & ~before)[letter]
    return bucket[letter], np.flatnonzero(starts)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows with text and lang; each task sends a row for each pair it has seen."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, most_chars=1_000_000):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                buckets, _ = trigrams("\n".join(own))
                if len(buckets):
                    counts[lang] = counts.get(lang, 0) + np.bincount(buckets, minlength=N_BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"]
            )

    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return known.mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket x language


def fit(labelled: DataFrame) -> Model:
    """The counts of a language are packed into one row (N_BUCKETS longs) before they reach the driver, one partition of
    languages after another."""
    counts = stored(trigram_counts(labelled), "trigram-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def packed(rows: pa.Table) -> pa.Table:
        n = np.zeros(N_BUCKETS, np.int64)
        n[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        return pa.table({"lang": rows.column("lang").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    table = np.zeros((N_BUCKETS, len(languages)), np.float32)
    for row in counts.groupBy("lang").applyInArrow(packed, "lang string, n binary").toLocalIterator():
        table[:, languages.index(row["lang"])] = np.frombuffer(row["n"], np.int64)
    seen = max(int((table.sum(axis=1) > 0).sum()), 1)
    totals = table.sum(axis=0, dtype=np.float64) + SMOOTHING * 2 * seen
    table += np.float32(SMOOTHING)
    np.log(table, out=table)
    table -= np.log(totals).astype(np.float32)
    return Model(languages, table)


_NO_LETTER = re.compile(r"[\W\d_]")


def pieces(text: str) -> Iterator[str]:
    """The text in steps of STEP characters and what follows up to the next place without a letter."""
    at = 0
    while at < len(text):
        m = _NO_LETTER.search(text, at + STEP)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def word_likelihoods(text: str, log_p: np.ndarray) -> np.ndarray:
    """Word x language: likelihoods up to a factor per word."""
    parts = []
    for part in pieces(text):
        buckets, starts = trigrams(part)
        if len(starts):
            parts.append(np.add.reduceat(log_p[buckets], starts, axis=0))
    log_l = np.concatenate(parts) if parts else np.zeros((0, log_p.shape[1]), np.float32)
    return np.exp(log_l - log_l.max(axis=1, keepdims=True)) if len(log_l) else log_l


def mixtures(likelihoods: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over documents side by side: proportions (document x language) within the allowed languages, log-likelihoods."""
    sizes = np.diff(np.append(starts, len(likelihoods)))
    doc = np.repeat(np.arange(len(starts)), sizes)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    floor = np.float32(1e-30)
    for _ in range(ROUNDS):
        joint = likelihoods * share[doc]
        joint /= joint.sum(axis=1, keepdims=True) + floor
        share = np.add.reduceat(joint, starts, axis=0) / sizes[:, None].astype(np.float32)
    total = np.add.reduceat(np.log((likelihoods * share[doc]).sum(axis=1) + floor), starts)
    return share, total


SCHEMA = "lang_pred string, score double, languages array<string>, proportions array<double>"


def _judged(texts: list[str | None], languages: list[str], log_p: np.ndarray) -> list[pa.Array]:
    """The columns of SCHEMA for these texts."""
    pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    sets: list[list[str]] = [[] for _ in texts]
    shares: list[list[float]] = [[] for _ in texts]
    found = [word_likelihoods(t or "", log_p) if languages else np.zeros((0, 1)) for t in texts]
    full = [i for i, x in enumerate(found) if len(x)]
    if full:
        likelihoods = np.concatenate([found[i] for i in full])
        sizes = np.array([len(found[i]) for i in full])
        best_share, chosen = best_sets(likelihoods, np.cumsum(sizes) - sizes, sizes)
        for row, i in enumerate(full):
            own = sorted(np.flatnonzero(chosen[row]), key=lambda k: (-best_share[row, k], k))
            pred[i], score[i] = languages[own[0]], min(1.0, float(best_share[row, own[0]]))
            sets[i], shares[i] = [languages[k] for k in own], [float(best_share[row, k]) for k in own]
    return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]


def _chars(model: Model) -> int:
    """Characters of a slice: fewer with many languages, as each word has a likelihood for each."""
    return max(10_000, 4_000_000 // max(4, len(model.languages)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), and the language set with its proportions."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, most_chars=_chars(model)):
            names = ["doc_id", "lang_pred", "score", "languages", "proportions"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_judged(texts, *sent.value)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judged, f"doc_id long, {SCHEMA}")


def predominant(docs: DataFrame, model: Model, least_share: float) -> DataFrame:
    """The rows of the table, whatever its columns, in which one language has at least this share of the words; no join
    brings them together with what was found."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, most_chars=_chars(model)):
            pred, score, *_ = _judged([None if t is None else str(t) for t in texts], *sent.value)
            yield batch.filter(pa.array([p != UNDETERMINED and x >= least_share for p, x in zip(pred.to_pylist(), score.to_pylist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(judged, docs.schema)


def best_sets(likelihoods: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the proportions and members of the language set with the best penalised likelihood.

    The full mixture ranks the languages; sets of the first 1, 2, ... of them are refitted while a larger one gains.
    """
    n_docs, n_langs = len(starts), likelihoods.shape[1]
    full, _ = mixtures(likelihoods, starts, np.ones((n_docs, n_langs), np.float32))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.full(n_docs, -np.inf)
    share, members = np.zeros_like(full), np.zeros(full.shape, bool)
    open_docs = np.arange(n_docs)
    for k in range(1, n_langs + 1):
        allowed = rank[open_docs] < k
        words = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in open_docs]) if len(open_docs) < n_docs else slice(None)
        own_sizes = sizes[open_docs]
        fitted, log_l = mixtures(likelihoods[words], np.cumsum(own_sizes) - own_sizes, allowed.astype(np.float32))
        value = log_l - PENALTY * 0.5 * np.log(np.maximum(own_sizes, 2)) * (k - 1)
        gains = value > best[open_docs]
        at = open_docs[gains]
        best[at], share[at], members[at] = value[gains], fitted[gains], allowed[gains]
        open_docs = at
        if not len(open_docs):
            break
    return share, members
