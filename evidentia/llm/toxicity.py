"""Toxicity by class-conditional Kneser-Ney models.

The labelled texts of either class are counted as bigrams; as in the lower orders of Kneser-Ney, a word's count in a
class is the number of distinct words it follows there, so a passage that is copied a thousand times counts once. The
models of the classes are discounted (modified: three discounts, from counts of counts), and what is discounted goes to
the counts that both classes share, and there to any word:

    p_c(w) = (k_c(w) - D_c) / K_c + b_c p(w)        p(w) = (k(w) - D) / K + b / (V + 1)

so a rare expression is told by what is known of it in both classes together. The ratio of a word that neither class
knows (b_toxic / b_ordinary, the larger class knows more) is taken off, so unknown words speak for neither class.

A document is judged by likelihoods of all its words, none left out. A toxic text is mostly ordinary words, so besides
the plain ratio of the two models it is asked how much likelier the text gets where a share s of its words comes from the
toxic model and the rest from the ordinary one:

    L_s = 1 / n  sum over the words of  log(1 - s + s p_toxic(w) / p_ordinary(w))        s in SHARES; L_1 is the plain ratio

Logistic regression over these turns them into a chance; it learns from labelled texts that the counts haven't seen, from
FIT_ROWS of them at most (a sample by their digest). Texts are dealt to counts or weights by the least hash of their
bigrams, so copies and most near copies stay on one side.

Texts and ratios meet by slices of about SLICE_CHARS characters: a slice numbers its distinct words, these numbers stand
for the words in its documents, and each of its words is looked up once, in a join dealt by word; what is found goes back
to the slice by its number. So a word comes once per slice however often it is used, and no table is sent to all tasks.
A Bloom filter of the labelled ids, MOST_BITS / 8 bytes at most, goes before the join of texts and labels; one that fills
up lets more rows through and changes no result. The tables grow with the texts and are never gathered in one place.

Defined cases: a text without words (or null) gets the score of a text without evidence; where the labelled rows, or
those that the weights are learned from, lack a class, every score is the share of toxic ones among the labelled rows
(0 without any); rows are scored one by one, and repeated rows alike; a doc_id with several labels is toxic if one of
them says so; a null label is none; an empty table gives no rows; long texts are taken in steps that end between words;
only doc_id and text, and toxic of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, slices, stored, stored_at
from .kneser_ney import TOKEN, gram_key, pieces

#: Shares of toxic words whose likelihoods are compared with that of an ordinary text.
SHARES = (0.0003, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: From which log ratio on a word is counted in strong_words, which no score depends on.
LEAST_RATIO = 1.0
SLICE_CHARS = 8_000_000
#: One text in WEIGHT_SHARE is kept from the counts, for the weights of the shares.
WEIGHT_SHARE = 4
FIT_ROWS = 50_000
RIDGE = 0.3
BITS_PER_WORD, LEAST_BITS, MOST_BITS = 12, 1 << 16, 1 << 28
HASHES = 4
BLOCK = 1 << 17  # bits
MOST_HELD = 1_000_000
BEGIN = np.uint64(1)


class _Codes:
    """Hashes of words, remembered while there are not too many."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MOST_HELD:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words(text: str | None, codes: _Codes) -> np.ndarray:
    """Hashes of the text's words and punctuation marks, in lower case."""
    parts = [codes.of(TOKEN.findall(part.lower())) for part in pieces(text or "")]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def for_weights(own: np.ndarray) -> bool:
    """Whether a text with these words is kept from the counts."""
    return len(own) > 0 and int(gram_key(np.concatenate([[BEGIN], own[:-1]]), own).min()) % WEIGHT_SHARE == 0


def bigrams(texts: DataFrame) -> DataFrame:
    """w, u, in_toxic, in_ordinary: the distinct bigrams u w of texts (text, toxic) that the counts may see."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch, own in slices(batches, most_chars=8_000_000):
            pairs: dict[int, list] = {0: [], 1: []}
            for text, toxic in zip(own, batch.column("toxic").to_pylist(), strict=True):
                w = words(text, codes)
                if len(w) and not for_weights(w):
                    pairs[toxic].append((np.concatenate([[BEGIN], w[:-1]]), w))
            for toxic, many in pairs.items():
                if many:
                    u, w = (np.concatenate(x) for x in zip(*many, strict=True))
                    _, at = np.unique(gram_key(u, w), return_index=True)
                    flags = [pa.array(np.full(len(at), toxic == c)) for c in (1, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), pa.array(u[at].view(np.int64)), *flags], names=["w", "u", "in_toxic", "in_ordinary"])

    rows = texts.select("text", "toxic").mapInArrow(found, "w long, u long, in_toxic boolean, in_ordinary boolean")
    return rows.groupBy("w", "u").agg(F.bool_or("in_toxic").alias("in_toxic"), F.bool_or("in_ordinary").alias("in_ordinary"))


def continuation_counts(texts: DataFrame) -> DataFrame:
    """w, toxic, ordinary, shared: how many distinct words w follows in either class and in both together."""
    return bigrams(texts).groupBy("w").agg(F.count_if("in_toxic").alias("toxic"), F.count_if("in_ordinary").alias("ordinary"), F.count(F.lit(1)).alias("shared"))


@dataclass
class Discounted:
    """One of the three distributions: its total count, discounts by count, and the share that is discounted."""

    total: int
    discounts: tuple[float, float, float]
    backoff: float

    def of(self, count: Column) -> Column:
        d1, d2, d3 = self.discounts
        taken = F.when(count == 1, d1).when(count == 2, d2).otherwise(d3)
        return F.greatest(count - taken, F.lit(0.0)) / self.total


def discounted(counts: DataFrame) -> dict[str, Discounted]:
    """The distributions from the counts of counts: one row of figures."""
    names = ("toxic", "ordinary", "shared")
    figures = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in names]
    figures += [F.count_if(F.col(c) == j).alias(f"{c}_{j}") for c in names for j in (1, 2, 3, 4)] + [F.count_if(F.col(c) > 2).alias(f"{c}_more") for c in names]
    r = counts.agg(*figures).first()
    found = {}
    for c in names:
        n = [0, *(r[f"{c}_{j}"] for j in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        guess = [j - (j + 1) * y * n[j + 1] / n[j] if n[1] and n[j] else 0.0 for j in (1, 2, 3)]
        d = tuple(g if g > 0 else j / 2 for j, g in zip((1, 2, 3), guess, strict=True))
        total = int(r[f"{c}_total"])
        found[c] = Discounted(total, d, (d[0] * n[1] + d[1] * n[2] + d[2] * r[f"{c}_more"]) / total if total else 1.0)
    return found


def log_ratios(counts: DataFrame) -> DataFrame:
    """w, ratio: the log ratio of toxic to ordinary likelihood, less that of an unknown word. Empty where a class has no words."""
    by = discounted(counts)
    if not by["toxic"].total or not by["ordinary"].total:
        return counts.select("w", F.lit(0.0).alias("ratio")).where("false")
    n_words = counts.count()
    shared = by["shared"].of(F.col("shared")) + by["shared"].backoff / (n_words + 1)
    chance = {c: by[c].of(F.col(c)) + by[c].backoff * shared for c in ("toxic", "ordinary")}
    return counts.select("w", (F.log(chance["toxic"] / chance["ordinary"]) - F.log(F.lit(by["toxic"].backoff / by["ordinary"].backoff))).alias("ratio"))


def _bits(w: np.ndarray, n_bits: int) -> np.ndarray:
    """Hash x word: the places of words in the filter."""
    step = (w >> np.uint64(32)) | np.uint64(1)
    return np.stack([(w + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - n_bits.bit_length()) for k in range(HASHES)]).astype(np.int64)


def bloom_filter(told: DataFrame, n_words: int) -> np.ndarray:
    """A filter of the words w, a byte per eight places; its blocks are put together by the executors."""
    n_bits = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_PER_WORD * n_words).bit_length()))
    size = min(BLOCK, n_bits)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits(batch.column("w").to_numpy().view(np.uint64), n_bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array((at % size).astype(np.int32))], names=["block", "bit"])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for batch in batches:
            own[batch.column("bit").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    bits = np.zeros(n_bits // 8, np.uint8)
    rows = told.select("w").mapInArrow(placed, "block long, bit int").distinct().groupBy("block").applyInArrow(merged, "block long, bits binary")
    for r in rows.toLocalIterator():
        bits[r["block"] * (size // 8) : (r["block"] + 1) * (size // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits


def may_be_in(bits: np.ndarray, w: np.ndarray) -> np.ndarray:
    at = _bits(w, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def passing(rows: DataFrame, key: Column, bits: np.ndarray) -> DataFrame:
    """The rows whose key, a long, may be in the filter."""
    sent, names = rows.sparkSession.sparkContext.broadcast(bits), rows.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(may_be_in(sent.value, batch.column("_key").to_numpy().view(np.uint64)), pa.bool_()))
            yield found.select(names)

    return rows.withColumn("_key", key).mapInArrow(kept, rows.schema)


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32, all lowest bytes first: the upper ones are mostly nothing and compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(kept: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(kept, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


PROFILE = "slice long, doc_id long, n_words long, weighing boolean, codes binary, n binary, words array<long>, of_slice boolean"


def profiles(docs: DataFrame) -> DataFrame:
    """A row per document: slice, doc_id, n_words, weighing (kept from the counts), its distinct words as numbers of the
    slice (codes) and how often it has each (n). And a row per slice (of_slice): words, by number."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, first = _Codes(), TaskContext.get().partitionId() << 32
        for i, (batch, texts) in enumerate(slices(batches, most_chars=SLICE_CHARS)):
            sizes, weighing, own, counts = [], [], [], []
            for text in texts:
                found = words(text, codes)
                sizes.append(len(found))
                weighing.append(for_weights(found))
                w, n = np.unique(found, return_counts=True)
                own.append(w)
                counts.append(planes(n))
            known, numbers = np.unique(np.concatenate(own), return_inverse=True)
            placed = [planes(x) for x in np.split(numbers, np.cumsum([len(w) for w in own])[:-1])]
            rows = len(texts)
            listed = pa.ListArray.from_arrays(pa.array([0] * (rows + 1) + [len(known)], pa.int32()), pa.array(known.view(np.int64)), mask=pa.array([True] * rows + [False]))
            arrays = [pa.array(np.full(rows + 1, first + i)), pa.array([*batch.column("doc_id").to_pylist(), None], pa.int64()), pa.array([*sizes, None], pa.int64()), pa.array([*weighing, None], pa.bool_()),
                      pa.array([*placed, None], pa.binary()), pa.array([*counts, None], pa.binary()), listed, pa.array([False] * rows + [True])]
            yield pa.RecordBatch.from_arrays(arrays, names=["slice", "doc_id", "n_words", "weighing", "codes", "n", "words", "of_slice"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(told, PROFILE)


def word_ratios(told: DataFrame, ratios: DataFrame) -> DataFrame:
    """slice, code, ratio of the words of the slices in told (profiles) that have a ratio (w, ratio)."""
    asked = told.where("of_slice").select("slice", F.posexplode("words").alias("code", "w"))
    return asked.join(ratios, "w").select("slice", "code", "ratio")


def evidence(told: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, n_words, weighing, strong_words, and per share s of SHARES the mean over the document's words of the log
    likelihood ratio at that share. told: profiles; answers: word_ratios; a word that isn't there has ratio 0."""
    names = [f"at_{k}" for k in range(len(SHARES))]

    def compared(docs: pa.Table, found: pa.Table) -> pa.Table:
        codes, n = ([of_planes(x) for x in docs.column(c).to_pylist()] for c in ("codes", "n"))
        row, code, times = np.repeat(np.arange(len(codes)), [len(x) for x in codes]), np.concatenate(codes), np.concatenate(n)
        ratio = np.zeros(1 + max(code.max(initial=0), found.column("code").to_numpy().max(initial=0)))
        ratio[found.column("code").to_numpy()] = found.column("ratio").to_numpy()
        sizes = docs.column("n_words").to_numpy()

        def summed(value: np.ndarray) -> np.ndarray:
            return np.bincount(row, times * value[code], len(codes))

        # log(1 - s + s e^r) without taking a small difference of large numbers
        means = [pa.array(summed(ratio if s == 1 else np.log1p(s * np.expm1(ratio))) / np.maximum(sizes, 1)) for s in SHARES]
        strong = pa.array(summed(ratio >= LEAST_RATIO).astype(np.int64))
        return pa.table([docs.column("doc_id"), docs.column("n_words"), docs.column("weighing"), strong, *means], names=["doc_id", "n_words", "weighing", "strong_words", *names])

    docs = told.where("NOT of_slice").drop("words", "of_slice")
    schema = "doc_id long, n_words long, weighing boolean, strong_words long, " + ", ".join(f"{c} double" for c in names)
    return docs.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(compared, schema)


def fitted(rows: list[tuple], ridge: float = RIDGE) -> tuple[list[float], float] | None:
    """Weights and the constant of a logistic regression over (likelihood ratio per share ..., toxic), by Newton's method;
    None where a class is missing. The order of the rows doesn't matter."""
    if len({r[-1] for r in rows}) < 2:
        return None
    data = np.array(sorted(rows), float)
    y, x = data[:, -1], data[:, :-1]
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (w[:-1] / scale).tolist(), float(w[-1])


def scored(docs: DataFrame, labels: DataFrame, learned_from: Column) -> DataFrame:
    """doc_id, score, n_words and strong_words, a row per document. labels: doc_id, toxic; learned_from: the condition on
    doc_id under which a label may be learned from."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(learned_from)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = stored(marks, "labels")
    key = F.xxhash64("doc_id")
    # texts without a label don't move
    labelled_ids = bloom_filter(marks.select(key.alias("w")), marks.count())
    training = passing(rows.where(learned_from), key, labelled_ids).join(marks.hint("merge"), "doc_id")
    counts = stored(continuation_counts(training), "continuations")
    ratios = stored(log_ratios(counts), "ratios")
    made, made_at = stored_at(profiles(rows), "profiles", "of_slice")
    answers, answers_at = stored_at(word_ratios(made, ratios), "ratios-of-slices")
    discarded(docs.sparkSession, f"{made_at}/of_slice=true")
    found = stored(evidence(made, answers), "evidence")
    for path in (made_at, answers_at):
        discarded(docs.sparkSession, path)

    at = [f"at_{k}" for k in range(len(SHARES))]
    labelled = found.where(learned_from).join(marks.hint("merge"), "doc_id")
    figures = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("share"), F.count_if("weighing").alias("weighing")).first()
    place = F.pmod(F.xxhash64("doc_id", "n_words", *at), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where("weighing").where(place < min(1.0, FIT_ROWS / max(1, figures["weighing"]))).select(*at, "toxic")
    model = fitted([tuple(r) for r in sample.limit(2 * FIT_ROWS).collect()])
    if model is None:
        score = F.lit(figures["share"] or 0.0)
    else:
        weights, constant = model
        score = 1 / (1 + F.exp(-sum((w * F.col(a) for w, a in zip(weights, at, strict=True)), F.lit(constant))))
    return found.select("doc_id", score.cast("double").alias("score"), "n_words", "strong_words")
