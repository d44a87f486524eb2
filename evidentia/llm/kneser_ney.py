"""Quality by language-model perplexity: interpolated modified Kneser-Ney over words and punctuation marks.

Trusted texts are dealt into two folds, by what they say: copies and nearly all near copies share one. The model of a language and fold counts the trigrams of that fold's trusted
texts; lower orders count distinct predecessors. Every document is scored by the model of its language from the *other*
fold, so no text is judged by a model that has seen it. A document is kept up to a high quantile of the perplexities
that trusted documents of its language reach, which are held out in the same way.

    p(w | u v) = (c(u v w) - D) / c(u v .) + b(u v) p(w | v)        p(w | v), p(w) likewise, over distinct predecessors

What moves is packed. Texts are cut into slices of one language and fold, about HELD tokens in a task at once, which are
stored as numbers of the slice's words. A slice tells each bucket of grams once which grams it has, and how often in its
trusted texts; the bucket adds up what all slices of the language tell it, and answers each slice with the counts of the
other fold's model, in the order in which it was asked:

    trigrams meet by the context u v:  c(u v w), and of u v the sum of its counts and the numbers of counts 1, 2, 3 or more
    bigrams by the bigram v w:         its distinct predecessors; one of the slices that have it trusted gets those of its own
                                       model too, to count them for v as context and w as word
    words by the word:                 the sums of what slices count for them

So counts come back as small whole numbers, and chances are worked out where the texts are. Pairs of words deal grams to
ROUNDS rounds; the shuffles of a round go before the next begins, so that the disk holds a part of the
grams at a time, though every gram is counted and asked for. Nothing passes through the driver but numbers of models.

No key is hot: a slice tells a gram once however often it has it, buckets are ranges of hashes, and their number per
language grows with its tokens.

A discount that the counts of counts leave open, or put at nothing, is half its count, so that no back-off weight is zero.

Words and grams are told apart by 64-bit hashes. A text starts with two marks and ends with one; the end is predicted as well.

Defined cases: a null or empty text, and a language without trusted text in the other fold (null counts as one
language), have no perplexity and are kept; so is a document of a language of which no trusted document has a
perplexity; equal rows get equal results; rows with one doc_id are judged one by one; an empty table gives no rows; long
texts are tokenised in steps that end between words, and each lies in one slice; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, slices, stored, stored_at

TOKEN = re.compile(r"\w+|[^\w\s]")
_BREAK = re.compile(r"\s")
STEP = 1_000_000  # characters of a text taken at once
BEGIN, END = np.uint64(1), np.uint64(2)
FOLDS = 2
QUANTILE = 0.99
MOST_MODELS = 10_000
HELD = 2_000_000  # tokens that a task gathers before the largest of its slices goes
ROUNDS = 16  # of grams; a power of two
MOST_WORDS = 1_000_000  # that a task numbers before all of its slices go
PARTS = 8  # of slices: their tokens are only dealt out part by part
#: Tokens of a language for each bucket of its grams, and for each of the first FIRST_BUCKETS.
BUCKET_TOKENS, FIRST_TOKENS, FIRST_BUCKETS = 8_000_000, 250_000, 12

_P1, _P2, _P4, _P5, _P3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x165667B19E3779F9))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def gram_key(*words: np.ndarray) -> np.ndarray:
    """The same 64-bit xxHash of the words as the SQL function xxhash64 gives over long columns."""
    key: np.ndarray | np.uint64 = np.uint64(42)
    for w in words:
        h = (key + _P5 + np.uint64(8)) ^ (_turned(w * _P2, 31) * _P1)
        h = _turned(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        key = h ^ (h >> np.uint64(32))
    return key


def pieces(text: str) -> Iterator[str]:
    """The text in steps of STEP characters and what follows up to the next white space."""
    at = 0
    while at < len(text):
        m = _BREAK.search(text, at + STEP)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def trigrams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """w1, w2, w3 as hashes, for every token of the text and its end, in steps."""
    before, last = np.array([BEGIN, BEGIN]), np.array([END])
    parts = list(pieces(text))
    for i, part in enumerate(parts):
        words = TOKEN.findall(part)
        codes = {w: word_hash(w) for w in set(words)}
        own = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        line = np.concatenate([before, own, last[i + 1 < len(parts) :]])
        if len(line) > 2:
            yield line[:-2], line[1:-1], line[2:]
        before = line[-2:]


class Numbers:
    """Words of a task by number, from the marks on."""

    def __init__(self) -> None:
        self.of_word: dict[str, int] = {}
        self.hashes = [int(BEGIN), int(END)]

    def of(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int32)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        known = np.empty(len(coded.dictionary), np.int32)
        for i, w in enumerate(coded.dictionary.to_pylist()):
            if w not in self.of_word:
                self.of_word[w] = len(self.hashes)
                self.hashes.append(word_hash(w))
            known[i] = self.of_word[w]
        return known[coded.indices.to_numpy()]

    def lines(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text two marks, its words and the end; nothing without text."""
        found, words, ends = [], [], []
        for text in texts:
            if text and len(text) <= STEP:
                words += TOKEN.findall(text)
            ends.append(len(words))
        short = np.split(self.of(words), ends)
        for text, own in zip(texts, short, strict=False):
            if text and len(text) > STEP:
                own = np.concatenate([self.of(TOKEN.findall(part)) for part in pieces(text)])
            found.append(np.concatenate([[0, 0], own, [1]]).astype(np.int32) if text else own)
        return found


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as a column needs, all lowest ones first: the upper ones are mostly nothing and compress."""
    widths = [max(1, (int(c.max(initial=0)).bit_length() + 7) // 8) for c in columns]
    raw = np.array([len(columns), *map(len, columns), *widths], "<u8").tobytes() + b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes() for c, k in zip(columns, widths, strict=True))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes, widths = np.frombuffer(raw, "<u8", 2 * n, 8).reshape(2, n).tolist()
    columns, at = [], 8 + 16 * n
    for size, k in zip(sizes, widths, strict=True):
        column = np.zeros((size, 8), np.uint8)
        column[:, :k] = np.frombuffer(raw, np.uint8, k * size, at).reshape(k, size).T
        columns.append(column.view("<u8").ravel())
        at += k * size
    return columns


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the number of every place's key."""
    order = np.argsort(keys)
    line = keys[order]
    new = np.append(True, line[1:] != line[:-1])[: len(line)]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return line[new], order[new], of


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences; np.cumsum gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes, so that sorted keys are sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _bounds(buckets: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(buckets, np.arange(n + 1, dtype=np.uint64))


def _count(at: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights, n).astype(np.int64)


SLICE = "slice long, part int, lang string, fold int, n_tokens long, doc_ids array<long>, sizes array<long>, data binary"


def sliced(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, fold, text) in slices of one language and fold: the ids of its rows, their numbers of tokens (the
    end is one; none without text), and packed its words and the lines of all rows as numbers of these."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, numbers = TaskContext.get().partitionId() << 32, 0, Numbers()
        held: dict[tuple, list] = defaultdict(list)
        weight: dict[tuple, int] = defaultdict(int)

        def taken(group: tuple) -> pa.RecordBatch:
            nonlocal made
            del weight[group]
            ids, own = zip(*held.pop(group), strict=True)
            line = np.concatenate(own)
            n = np.bincount(line, minlength=len(numbers.hashes))
            used = np.flatnonzero(n)
            used = used[np.argsort(-n[used], kind="stable")]
            place = np.zeros(len(n), np.int64)
            place[used] = np.arange(len(used))
            sizes = [max(0, len(x) - 2) for x in own]
            row = {"slice": first + made, "part": ((first >> 32) + made) % PARTS, "lang": group[0], "fold": group[1], "n_tokens": sum(sizes), "doc_ids": ids, "sizes": sizes, "data": pack(np.array(numbers.hashes, np.uint64)[used], place[line])}
            made += 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("lang", pa.string()), ("fold", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]))

        for batch, texts in slices(batches, most_chars=STEP):
            if len(numbers.hashes) > MOST_WORDS:
                for group in list(held):
                    yield taken(group)
                numbers = Numbers()
            for doc_id, lang, fold_, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "fold")), numbers.lines(texts), strict=True):
                held[lang, fold_].append((doc_id, own))
                weight[lang, fold_] += 1 + len(own)
            while sum(weight.values()) > HELD:
                yield taken(max(weight, key=weight.__getitem__))
        for group in list(held):
            yield taken(group)

    return docs.select("doc_id", "lang", "fold", "text").mapInArrow(told, SLICE)


class Slice:
    """The lines of a slice, and the grams that it asks for in the order in which buckets are asked. Places are those of a
    line's last word."""

    def __init__(self, row: dict) -> None:
        self.row, self.n, sizes = row, row["n_buckets"], np.array(row["sizes"], np.int64)
        self.words, line = unpack(row["data"])
        self.line = line.astype(np.int64)
        lengths = np.where(sizes > 0, sizes + 2, 0)
        starts = (np.cumsum(lengths) - lengths)[sizes > 0]
        self.predicted = np.ones(len(line), bool)
        self.predicted[starts] = self.predicted[starts + 1] = False
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        trusted = np.zeros(len(sizes), bool)
        trusted[np.array(row["trusted"] or [], np.int64)] = True
        self.trusted = np.repeat(trusted, lengths)
        self.turns = (self.words >> np.uint64(24)).astype(np.uint32)[self.line]

    def _at(self, turn: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dealt = ((x + (y << np.uint32(1))) >> np.uint32(8)) & np.uint32(ROUNDS - 1)
        return np.flatnonzero((dealt == turn) & self.predicted[2:]) + 2

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return self.words[self.line[at]]

    def asked_trigrams(self, turn: int) -> tuple:
        """The places whose context has its turn, and of these the contexts and trigrams: distinct keys, a place of each,
        the number of each place's key. Trigrams are sorted by the bucket of their context, then by key."""
        at = self._at(turn, self.turns[:-2], self.turns[1:-1])
        u, v, w = (self.hashes(at - k) for k in (2, 1, 0))
        uv, _, of_uv = _grouped(gram_key(u, v))
        key, one, of_uvw = _grouped(gram_key(u, v, w))
        order = np.argsort(_bucket(uv[of_uv[one]], self.n), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return at, (uv, of_uv), (key[order], one[order], place[of_uvw])

    def asked_bigrams(self, turn: int) -> tuple:
        """The places whose bigram has its turn; keys, a place of each, the number of each place's key, and whether a trusted text has the key."""
        at = self._at(turn, self.turns[1:-1], self.turns[2:])
        vw, one, of_vw = _grouped(gram_key(self.hashes(at - 1), self.hashes(at)))
        told = np.zeros(len(vw), bool)
        told[of_vw[self.trusted[at]]] = True
        return at, vw, one, of_vw, told

    def messages(self, turn: int) -> Iterator[tuple[int, int, bytes]]:
        """kind, bucket, and packed what is told and asked."""
        at, (uv, of_uv), (uvw, one, of_uvw) = self.asked_trigrams(turn)
        c = _count(of_uvw[self.trusted[at]], len(uvw))
        its_uv = of_uv[one]
        by_uv, by_uvw = (_bounds(_bucket(x, self.n), self.n) for x in (uv, uv[its_uv]))
        for b in range(self.n):
            (i, j), (k, m) = by_uv[b : b + 2], by_uvw[b : b + 2]
            if m > k:
                own = c[k:m]
                yield 3, b, pack(_steps(uv[i:j]), _steps(uvw[k:m]), own, its_uv[k:m][own > 0] - i)
        at, vw, _, of_vw, told = self.asked_bigrams(turn)
        seen = self.trusted[at]
        of_vw, at = of_vw[seen], at[seen]
        learned, one, _ = _grouped(gram_key(*(self.hashes(at - k) for k in (2, 1, 0))))
        its_vw = of_vw[one]
        order = np.argsort(its_vw, kind="stable")
        learned, its_vw = learned[order], its_vw[order]
        by_vw = _bounds(_bucket(vw, self.n), self.n)
        by_learned = np.searchsorted(its_vw, by_vw)
        for b in range(self.n):
            (i, j), (k, m) = by_vw[b : b + 2], by_learned[b : b + 2]
            if j > i:
                yield 2, b, pack(_steps(vw[i:j]), told[i:j], its_vw[k:m] - i, learned[k:m])

    def word_counts(self, answers: dict) -> Iterator[tuple[int, int, bytes]]:
        """kind, bucket, and packed the words that are asked for, with the classes of their bigrams as context and the
        number of bigrams that end in them, of the bigrams that this slice counts."""
        words, place = np.unique(self.words), np.argsort(np.argsort(self.words))
        columns = np.zeros((5, len(words)), np.int64)
        for turn in range(ROUNDS):
            at, _, one, _, told = self.asked_bigrams(turn)
            if told.any():
                c = columns_of(answers, 2, turn, 1, 2)[0]
                own = at[one[told]][c > 0]
                columns[:4] += _classes(place[self.line[own - 1]], c[c > 0], len(words))
                columns[4] += _count(place[self.line[own]], len(words))
        by = _bounds(_bucket(words, self.n), self.n)
        for b, (i, j) in enumerate(zip(by[:-1], by[1:], strict=True)):
            if j > i:
                yield 1, b, pack(_steps(words[i:j]), *columns[:, i:j])


Answers = dict[tuple[int, int], list[list[np.ndarray]]]


def answers_of(found: pa.Table) -> Answers:
    """By kind and turn, in the order of buckets."""
    by: Answers = defaultdict(list)
    for r in sorted(found.select(["kind", "turn", "bucket", "data"]).to_pylist(), key=lambda r: r["bucket"]):
        by[r["kind"], r["turn"]].append(unpack(r["data"]))
    return by


def columns_of(answers: Answers, kind: int, turn: int, first: int, last: int) -> list[np.ndarray]:
    return [np.concatenate(x).astype(np.int64) for x in zip(*(a[first:last] for a in answers[kind, turn]), strict=True)]


MESSAGE = "lang string, kind int, bucket int, slice long, fold int, n_buckets int, data binary"
ANSWER = "what string, lang string, fold int, slice long, kind int, turn int, bucket int, data binary, counts array<long>"


def _as_rows(rows: list[dict], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [tuple(x.split()) for x in schema.split(", ")]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in fields]))


def _messages_of(own: Slice, found: Iterator[tuple[int, int, bytes]]) -> list[dict]:
    shared = {"lang": own.row["lang"], "slice": own.row["slice"], "fold": own.row["fold"], "n_buckets": own.n}
    return [shared | {"kind": kind, "bucket": b, "data": data} for kind, b, data in found]


def messages(tokens: DataFrame, turn: int) -> DataFrame:
    """What slices tell and ask the buckets of trigrams and bigrams at a turn."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Slice(batch.slice(i, 1).to_pylist()[0])
                yield from _as_rows(_messages_of(own, own.messages(turn)), MESSAGE)

    return tokens.where("n_tokens > 0").select("slice", "lang", "fold", "n_buckets", "sizes", "trusted", "data").mapInArrow(told, MESSAGE)


def word_messages(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """What slices tell and ask the buckets of words, after the answers of bigrams."""

    def told(toks: pa.Table, found: pa.Table) -> pa.Table:
        own = Slice(toks.to_pylist()[0])
        return pa.Table.from_batches(_as_rows(_messages_of(own, own.word_counts(answers_of(found))), MESSAGE))

    rows = tokens.where("n_tokens > 0").select("slice", "lang", "fold", "n_buckets", "sizes", "trusted", "data")
    return rows.groupBy("slice").cogroup(answers.where("kind = 2").groupBy("slice")).applyInArrow(told, MESSAGE)


class Known:
    """Sorted keys with whole numbers, of which a key that isn't there has none."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.keys, self.values = keys, values

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys), np.int64) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return [x[at] * there for x in self.values]


def _classes(at: np.ndarray, c: np.ndarray, n: int) -> list[np.ndarray]:
    """Per context: the sum of its counts c, and how many are 1, 2, and more."""
    return [_count(at, n, c), *(_count(at[x], n) for x in (c == 1, c == 2, c > 2))]


def _counts_of(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and over 2, their sum, and their number."""
    return [*(int((c == j).sum()) for j in (1, 2, 3, 4)), int((c > 2).sum()), int(c.sum()), int((c > 0).sum())]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *arrays])


def _trigrams_known(told: list[list[np.ndarray]]) -> tuple[list[Known], np.ndarray]:
    """Trigrams with their counts, contexts with their classes; the counts."""
    uvw, one, at = np.unique(_joined([np.cumsum(x[1])[x[2] > 0] for x in told]), return_index=True, return_inverse=True)
    c = _count(at, len(uvw), _joined([x[2][x[2] > 0] for x in told]).astype(np.int64))
    uv, of = np.unique(_joined([np.cumsum(x[0])[x[3].astype(np.int64)] for x in told])[one], return_inverse=True)
    return [Known(uvw, c), Known(uv, *_classes(of, c, len(uv)))], c


def _bigrams_known(told: list[list[np.ndarray]]) -> tuple[list[Known], np.ndarray, list[np.ndarray]]:
    """Bigrams with the number of their distinct predecessors; these numbers; and for each teller those of the bigrams that
    it has in trusted texts, where it is the first of these."""
    _, one = np.unique(_joined([x[3] for x in told]), return_index=True)
    vw, c = np.unique(_joined([np.cumsum(x[0])[x[2].astype(np.int64)] for x in told])[one], return_counts=True)
    keys = [np.cumsum(x[0])[x[1] > 0] for x in told]
    first = np.zeros(sum(map(len, keys)), np.int64)
    first[np.unique(_joined(keys), return_index=True)[1]] = c
    return [Known(vw, c)], c, np.split(first, np.cumsum([len(x) for x in keys])[:-1])


def answered(asked: DataFrame, turn: int) -> DataFrame:
    """What the buckets of messages answer to slices (what: answer), and count (counts)."""

    def found(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, kind, bucket = (x.as_py() for x in key)
        rows = [r | {"data": unpack(r["data"])} for batch in batches for r in batch.to_pylist()]
        of_fold, first, out = [], {}, []
        shared = {"lang": lang, "kind": kind, "turn": turn, "bucket": bucket}
        for f in range(FOLDS):
            own = [r for r in rows if r["fold"] == f]
            told = [r["data"] for r in own]
            if kind == 3:
                known, c = _trigrams_known(told)
            elif kind == 2:
                known, c, counted = _bigrams_known(told)
                first |= {r["slice"]: x for r, x in zip(own, counted, strict=False)}
            else:
                words, at = np.unique(_joined([np.cumsum(x[0]) for x in told]), return_inverse=True)
                columns = [_count(at, len(words), _joined([x[k] for x in told]).astype(np.int64)) for k in range(1, 6)]
                known, c = [Known(words, *columns)], columns[-1]
            of_fold.append(known)
            if c.any():
                out.append(shared | {"what": "counts", "fold": f, "counts": _counts_of(c)})
        yield from _as_rows(out, ANSWER)
        for r in rows:
            other = of_fold[1 - r["fold"]]
            if kind == 3:
                answer = [*other[0].of(np.cumsum(r["data"][1])), *other[1].of(np.cumsum(r["data"][0]))]
            else:
                answer = other[0].of(np.cumsum(r["data"][0])) + ([first[r["slice"]]] if kind == 2 else [])
            yield from _as_rows([shared | {"what": "answer", "slice": r["slice"], "data": pack(*answer)}], ANSWER)

    return asked.groupBy("lang", "kind", "bucket").applyInArrow(found, ANSWER)


def _per_model(df: DataFrame, few: bool) -> DataFrame:
    """A table of one row per model, sent to all tasks where there are MOST_MODELS at most."""
    return F.broadcast(df) if few else df


def _discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2, and more, from the counts of counts."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else None
    estimates = [j - (j + 1) * y * n[j] / n[j - 1] if y is not None and n[j - 1] else 0.0 for j in (1, 2, 3)]
    return np.array([0.0, *(e if e > 0 else j / 2 for j, e in zip((1, 2, 3), estimates, strict=True))])


def _interpolated(c: np.ndarray, context: list[np.ndarray], n: list[int], lower: np.ndarray) -> np.ndarray:
    """Chances of words with counts c after contexts of these sums and classes; `lower` after contexts that aren't known."""
    d, total = _discounts(n), np.maximum(context[0], 1)
    back = sum(e * x for e, x in zip(d[1:], context[1:], strict=True)) / total
    return np.where(context[0] > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / total + back * lower, lower)


def log_chances(own: Slice, answers: Answers, counts: list[list[int]]) -> np.ndarray:
    """Of every token of a slice. counts: by order, from 1."""
    ends, place = np.flatnonzero(own.predicted), np.argsort(np.argsort(own.words))
    *of_words, c1 = columns_of(answers, 1, 0, 0, 5)
    of_v, c1 = [x[place[own.line[ends - 1]]] for x in of_words], c1[place[own.line[ends]]]
    c2, c3, *of_uv = np.zeros((6, len(own.line)), np.int64)
    for turn in range(ROUNDS):
        at, (_, by_uv), (_, _, by_uvw) = own.asked_trigrams(turn)
        if len(at):
            c3[at], *found = (x[y] for x, y in zip([*columns_of(answers, 3, turn, 0, 1), *columns_of(answers, 3, turn, 1, 5)], [by_uvw, *[by_uv] * 4], strict=True))
            for x, y in zip(of_uv, found, strict=True):
                x[at] = y
        at, _, _, by_vw, _ = own.asked_bigrams(turn)
        if len(at):
            c2[at] = columns_of(answers, 2, turn, 0, 1)[0][by_vw]
    c2, c3, *of_uv = (x[ends] for x in (c2, c3, *of_uv))
    n1, n2, n3 = counts
    of_none = [np.full(len(c1), n) for n in (n1[5], n1[0], n1[1], n1[4])]
    lowest = np.full(len(c1), 1 / (n1[6] + 1))
    return np.log(_interpolated(c3, of_uv, n3, _interpolated(c2, of_v, n2, _interpolated(c1, of_none, n1, lowest))))


SCORED = "doc_id long, lang string, n_scored long, perplexity double"


def perplexities(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, lang, n_scored, perplexity of the rows of slices: tokens with the counts of their models (counts_1 to
    counts_3), and the answers to these slices."""

    def scored(toks: pa.Table, found: pa.Table) -> pa.Table:
        row = toks.to_pylist()[0]
        sizes = np.array(row["sizes"], np.int64)
        counts = [row[f"counts_{k}"] for k in (1, 2, 3)]
        with_model = None not in counts and len(found) > 0
        perplexity = np.zeros(len(sizes))
        if with_model:
            own = Slice(row)
            perplexity = np.exp(-np.bincount(own.doc, log_chances(own, answers_of(found), counts), len(sizes)) / np.maximum(sizes, 1))
        there = (sizes > 0) & with_model
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["lang"]] * len(sizes), pa.string()), pa.array(np.where(there, sizes, 0)), pa.array(perplexity, mask=~there)]
        return pa.table(columns, names=["doc_id", "lang", "n_scored", "perplexity"])

    return tokens.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(scored, SCORED)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def judged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, lang, n_scored, perplexity of docs (doc_id, lang, fold, text), learned from the rows with the ids."""
    spark = docs.sparkSession
    made, made_at = stored_at(sliced(docs), "slices", "part")
    size = F.greatest(F.ceil(F.col("n") / BUCKET_TOKENS), F.least(F.lit(FIRST_BUCKETS), F.ceil(F.col("n") / FIRST_TOKENS)), F.lit(1))
    buckets = made.groupBy("lang").agg(F.sum("n_tokens").alias("n")).select("lang", size.cast("int").alias("n_buckets"))
    buckets = stored(buckets, "buckets")
    few = buckets.limit(MOST_MODELS + 1).count() <= MOST_MODELS
    places = made.select("slice", F.posexplode("doc_ids").alias("place", "doc_id"))
    trusted = stored(places.join(ids.hint("merge"), "doc_id", "left_semi").groupBy("slice").agg(F.collect_list("place").alias("trusted")), "trusted")
    tokens = []
    for k in range(PARTS):
        part = made.where(F.col("part") == k).drop("part").join(trusted.hint("merge"), "slice", "left")
        tokens.append(stored_at(part.join(_per_model(buckets, few), "lang"), "tokens"))
        discarded(spark, f"{made_at}/part={k}")
    whole = _union([t for t, _ in tokens])

    def told(answers: DataFrame, k: int) -> DataFrame:
        of_part = F.expr(f"pmod((slice >> 32) + (slice & 4294967295L), {PARTS}) = {k}")
        return answers.where("what = 'answer'").where(of_part).select("slice", "kind", "turn", "bucket", "data")

    turns = [stored_at(answered(messages(whole, turn), turn), "grams", "what") for turn in range(ROUNDS)]
    of_grams = _union([t for t, _ in turns])
    asked = [stored_at(word_messages(own, told(of_grams, k)), "words-asked") for k, (own, _) in enumerate(tokens)]
    words, words_at = stored_at(answered(_union([t for t, _ in asked]), 0), "words", "what")
    for _, path in asked:
        discarded(spark, path)
    answers = of_grams.unionByName(words)
    sums = [F.sum(F.when(F.col("kind") == k, F.col("counts")[i])).alias(f"n{k}_{i}") for k in (1, 2, 3) for i in range(7)]
    counts = answers.where("what = 'counts'").groupBy("lang", (1 - F.col("fold")).alias("fold")).agg(*sums)
    counts = stored(counts.select("lang", "fold", *[F.array(*[f"n{k}_{i}" for i in range(7)]).alias(f"counts_{k}") for k in (1, 2, 3)]), "counts")
    scored = []
    for k, (own, path) in enumerate(tokens):
        with_counts = own.join(_per_model(counts, few), ["lang", "fold"], "left")
        scored.append(stored(perplexities(with_counts, told(answers, k)), "perplexities"))
        discarded(spark, path)
    for _, path in [*turns, (words, words_at)]:
        discarded(spark, path)
    return _union(scored)


def fold(text: Column) -> Column:
    """The fold of a text: by the least hash of two words in a row, so that copies lie in one fold whatever their ids, and
    near copies nearly always, as often as they share their least pair. A text of one word goes by itself."""
    words = F.split(text, r"\s+")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.xxhash64(a, b))
    least = F.when(F.size(words) > 1, F.array_min(pairs)).otherwise(F.xxhash64(text))
    return F.coalesce(F.pmod(least, F.lit(FOLDS)), F.lit(0))


def judge(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """doc_id, lang, n_scored, perplexity, threshold, kept. trusted_ids: doc_id of the texts to learn from."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    ids = trusted_ids.select(F.col("doc_id").cast("long")).distinct()
    scored = judged(rows.withColumn("fold", fold(F.col("text")).cast("int")), ids)
    # both sides are dealt by doc_id at every size: the ids grow with the documents
    limits = scored.join(ids.hint("merge"), "doc_id", "left_semi").where("perplexity IS NOT NULL").groupBy("lang").agg(F.percentile_approx("perplexity", QUANTILE, 10_000).alias("threshold"))
    few = limits.limit(MOST_MODELS + 1).count() <= MOST_MODELS
    return scored.join(_per_model(limits, few), "lang", "left").select(
        "doc_id", "lang", "n_scored", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept")
    )
