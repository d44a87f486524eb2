"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is cut into leaves of equal length, wherever the cuts fall. Leaves are encoded independently, by as many
tasks as there are leaves; then neighbours are concatenated, pair by pair up a binary tree. At each join only a window
around the cut is encoded again; it grows until both sides agree with it exactly, and then the result is the encoding
of the concatenated text:

* where the pre-tokenizer's splits can be seen on both sides, the window runs from one true split to another;
* inside one unsplit run, the window is re-encoded from token to token, and its seams must stand: a token sequence is
  the BPE encoding of its bytes if and only if each adjacent pair encodes to itself.

The ids are those of the `tokenizers` library for the same file, special tokens inside texts included. A second engine
for the same vocabulary (the rank file beside it) is used for characters up to U+052F, where both split alike; texts
with others go to the library itself.

Defined cases: a null text is an empty one (no ids); equal rows get equal results; an empty table gives no rows; only
doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LEAF_CHARS = 16_384
FIRST_WINDOW = 32
#: Words kept with their ids by a worker; what comes after that is encoded but not kept.
MOST_KEPT = 600_000
#: Fixed value: the pattern by which byte-level BPE of this family splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BEYOND = re.compile("[^\u0000-ԯ‐-‧]")


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary: itself if printable, else the next free from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnsureSplit(Exception):
    """White space meets white space: where the pre-tokenizer splits depends on what follows."""


class Words(dict):
    """What a function gives for words that follow a single space, kept up to a bound."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise UnsureSplit
        made = self.make(word)
        if len(self) < MOST_KEPT and len(word) < 64:
            self[word] = made
        return made


class Codec:
    """A vocabulary with its two engines; one per worker and path."""

    _open: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in self.alphabet.items()}
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.piece: list[bytes] = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.piece[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.piece[i] = token.encode()
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if all(vocab.get("".join(map(self.alphabet.get, t))) == i for t, i in table.items()):
                self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.kept = Words(self._after_space)
        self.pairs: dict[int, bool] = {}

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of a text, special tokens inside it included."""
        if self.fast is None or _BEYOND.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.specials and self.special.search(text):
            parts, at = [], 0
            for m in self.special.finditer(text):
                parts += [self._ordinary(text[at : m.start()]), np.array([self.specials[m[0]]], np.uint32)]
                at = m.end()
            return np.concatenate([*parts, self._ordinary(text[at:])])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> np.ndarray:
        """Splits always fall between a character and white space after it, so words between single spaces can be
        looked up one by one."""
        if not text:
            return np.zeros(0, np.uint32)
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise UnsureSplit
            found = b"".join(map(self.kept.__getitem__, rest))
        except UnsureSplit:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.frombuffer(self._packed(first) + found, np.uint32)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """encode of each text. Words between single spaces are looked up once for all the texts that consist of them."""
        simple = [bool(t) and self.fast is not None and not _BEYOND.search(t) and not (self.specials and self.special.search(t)) for t in texts]
        known = iter(self._word_by_word([t for t, s in zip(texts, simple, strict=True) if s]))
        for text, s in zip(texts, simple, strict=True):
            ids = next(known) if s else None
            yield self.encode(text) if ids is None else ids

    def _word_by_word(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of texts that are not empty, or None where what follows decides on a split."""
        if not texts:
            return []
        listed = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = listed.offsets.to_numpy()
        coded = listed.flatten().dictionary_encode()
        packed, unsure = [], []
        for word in coded.dictionary.to_numpy(zero_copy_only=False):
            try:
                packed.append(self.kept[word])
            except UnsureSplit:
                unsure.append(len(packed))
                packed.append(b"")
        firsts = [t[: t.index(" ")] if " " in t else t for t in texts]
        code = coded.indices.to_numpy().astype(np.int64)
        code[ends[:-1]] = len(packed) + np.arange(len(texts))  # a first word has no space before it
        unsure += [len(packed) + i for i, f in enumerate(firsts) if not f or f[-1].isspace()]
        packed += [self._packed(f) for f in firsts]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        own = size[code]
        until = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat((np.cumsum(size) - size)[code] - until[:-1], own)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(packed), np.uint32)[at]
        wrong = np.zeros(len(texts), bool)
        if unsure:
            odd = np.zeros(len(packed), bool)
            odd[unsure] = True
            wrong = np.logical_or.reduceat(odd[code], ends[:-1])
        starts = until[ends].tolist()
        return [None if w else ids[a:b] for w, a, b in zip(wrong.tolist(), starts, starts[1:])]

    def _after_space(self, word: str) -> bytes:
        """The ids of a word that follows a space. Letters alone are one piece of the pre-tokenizer, and a mark after
        them is another, so neither needs its pattern."""
        if word.isalpha():
            return array("I", self.bpe(b" " + word.encode())).tobytes()
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.kept[word[:-1]] + array("I", self.bpe(word[-1].encode())).tobytes()
        return self._packed(" " + word)

    def _packed(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), np.uint32).tobytes()

    def bpe(self, raw: bytes) -> list[int]:
        """The merges over bytes that no split divides."""
        if self.fast is not None:
            return self.fast._core_bpe.encode_single_piece(raw)
        return [t.id for t in self.library.model.tokenize("".join(map(self.alphabet.get, raw)))]

    def stands(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens encode to themselves."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.bpe(self.piece[left] + self.piece[right]) == [left, right]
            if len(self.pairs) < MOST_KEPT:
                self.pairs[key] = known
        return known

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def splits(self, text: str) -> list[int]:
        """Ends of the pre-tokenizer's pieces that neither end of this stretch of text can have moved."""
        ends = [end for _, (_, end) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return ends[4:-5]  # an end may cut a special token: three false pieces, and white space or an apostrophe beside it

    def _count_for(self, ids: np.ndarray, n_bytes: int, from_end: bool) -> int:
        """How many tokens at one end make up n_bytes."""
        total, n = 0, 0
        for t in ids[::-1] if from_end else ids:
            if total >= n_bytes:
                break
            total += len(self.piece[t])
            n += 1
        assert total == n_bytes
        return n

    def join(self, a: str, a_ids: np.ndarray, b: str, b_ids: np.ndarray) -> np.ndarray:
        """The ids of a + b from those of a and of b."""
        if not a or not b:
            return np.concatenate([a_ids, b_ids])
        size = FIRST_WINDOW
        while True:
            left, right = a[-size:], b[:size]
            start = self._sure_split(left, whole=len(left) == len(a), last=True)
            end = self._sure_split(right, whole=len(right) == len(b), last=False)
            if start is not None and end is not None:
                i = len(a_ids) - self._count_for(a_ids, len(left[start:].encode("utf-8", "surrogatepass")), True)
                j = self._count_for(b_ids, len(right[:end].encode("utf-8", "surrogatepass")), False)
                return np.concatenate([a_ids[:i], self.encode(left[start:] + right[:end]), b_ids[j:]])
            if len(left) == size == len(right) and (found := self._unsplit(left, a_ids, right, b_ids)) is not None:
                return found
            size *= 2

    def _sure_split(self, text: str, whole: bool, last: bool) -> int | None:
        """A place in the window that is a split of the whole text: nearest to the join, or the text's own end."""
        found = list(self.special.finditer(text)) if self.specials else []
        if last:
            base = found[-1].end() if found else 0
            inner = [base + x for x in self.splits(text[base:])]
            return inner[-1] if inner else base if found or whole else None
        limit = found[0].start() if found else len(text)
        inner = [x for x in self.splits(text[:limit]) if not text[x - 1].isspace()]  # white space is split by what follows
        return inner[0] if inner else limit if found or whole else None

    def _unsplit(self, left: str, a_ids: np.ndarray, right: str, b_ids: np.ndarray) -> np.ndarray | None:
        """The join inside one piece that covers the whole window, if its seams stand."""
        if len(self.library.pre_tokenizer.pre_tokenize_str(left + right)) != 1 or self.specials and self.special.search(left + right):
            return None
        room_left, room_right = len(left.encode("utf-8", "surrogatepass")) - 16, len(right.encode("utf-8", "surrogatepass")) - 16
        i, n = len(a_ids), 0
        while i > 0 and n + len(self.piece[a_ids[i - 1]]) <= room_left // 2:
            i -= 1
            n += len(self.piece[a_ids[i]])
        j, n = 0, 0
        while j < len(b_ids) and n + len(self.piece[b_ids[j]]) <= room_right // 2:
            n += len(self.piece[b_ids[j]])
            j += 1
        if i == 0 or j == len(b_ids) or i == len(a_ids) or j == 0:
            return None
        middle = self.bpe(self.decode_bytes(a_ids[i:]) + self.decode_bytes(b_ids[:j]))
        if not self.stands(int(a_ids[i - 1]), middle[0]) or not self.stands(middle[-1], int(b_ids[j])):
            return None
        if len(middle) == 1 and not (self.stands(int(a_ids[i - 1]), middle[0]) and self.stands(middle[0], int(b_ids[j]))):
            return None
        return np.concatenate([a_ids[:i], np.array(middle, np.uint32), b_ids[j:]])

    def concatenated(self, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The ids of the leaves' texts together: neighbours are joined, level by level."""
        while len(leaves) > 1:
            pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
            leaves = [p[0] if len(p) == 1 else (p[0][0] + p[1][0], self.join(p[0][0], p[0][1], p[1][0], p[1][1])) for p in pairs]
        return leaves[0][1] if leaves else np.zeros(0, np.uint32)

    def encode_tree(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        """The whole tree in one place."""
        return self.concatenated([(part, self.encode(part)) for part in (text[i : i + leaf_chars] for i in range(0, len(text), leaf_chars))])


def _digests(codec: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    text = codec.decode(ids).encode("utf-8", "replace")
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The columns of DIGESTS and `ids` (little-endian unsigned 32-bit integers) of every document."""
    return _encoded(docs, path, leaf_chars, f"{DIGESTS}, ids binary", lambda codec, doc_id, ids: (doc_id, *_digests(codec, ids), ids.astype("<u4").tobytes()))


def digest_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; ids are decoded again in the same pass."""
    return _encoded(docs, path, leaf_chars, DIGESTS, lambda codec, doc_id, ids: (doc_id, *_digests(codec, ids)))


def _encoded(docs: DataFrame, path: str, leaf_chars: int, schema: str, result) -> DataFrame:
    """Texts of one leaf are encoded where they lie. Leaves of longer texts are dealt over all tasks, encoded there, and
    meet again by document and text digest, where the tree is put together; what meets is the text of one row."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.char_length("text") > leaf_chars

    def record(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch, texts in slices(batches):
            yield record([result(codec, d, codec.encode(t)) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)])

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch, texts in slices(batches, "leaf"):
            ids = pa.array([codec.encode(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    def whole(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        codec = Codec.of(path)
        leaves = leaves.sort_values("no", kind="stable")
        parts = [(t, np.frombuffer(i, np.uint32)) for t, i in zip(leaves["leaf"], leaves["ids"], strict=True)]
        found = result(codec, None if pd.isna(key[0]) else int(key[0]), codec.concatenated(parts))
        return pd.DataFrame([found] * int(leaves["copies"].iloc[0]), columns=names)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.where(long).select(
        "doc_id", F.xxhash64("text").alias("digest"), F.char_length("text").alias("n"),
        F.explode(F.expr(f"transform(sequence(0, (char_length(text) - 1) div {leaf_chars}), i -> struct(i AS no, substring(text, i * {leaf_chars} + 1, {leaf_chars}) AS leaf))")).alias("part"),
    ).select("doc_id", "digest", "n", "part.no", "part.leaf")
    # equal rows are one until the end; rows without a doc_id are told apart by their texts
    dealt = cut.repartition(parts, "doc_id", "digest", "no").groupBy("doc_id", "digest", "n", "no").agg(F.first("leaf").alias("leaf"), F.count(F.lit(1)).alias("copies"))
    encoded = dealt.mapInArrow(leaf_ids, "doc_id long, digest long, n int, no long, leaf string, copies long, ids binary")
    joined = encoded.groupBy("doc_id", "digest", "n").applyInPandas(whole, schema)
    return rows.where(~long).mapInArrow(short_texts, schema).unionByName(joined)
