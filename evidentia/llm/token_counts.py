"""Token counts for every prefix of a text, by dynamic programming.

The encoding of a prefix ends in exactly one token, and what comes before that token is the encoding of a shorter
prefix; a token t ends the encoding of w[:i] if and only if the last token of w[:i - len(t)] and t encode to
themselves as a pair. So one pass over a word gives the token count of each of its prefixes. Splits of the
pre-tokenizer make counts of words add up, and the table of a word is kept and used again.

The stored table (`prefix_table`, the change of the count at each character, in bytes where these do) answers how many
tokens a truncated text has, and how much of a text fits a budget, without encoding anything again.

Defined cases: a null text is an empty one (0 tokens); equal rows get equal results; a long text is a long row of steps;
an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _BEYOND, MOST_KEPT, Codec, UnsureSplit, Words
from .common import slices, stored

#: The splits for characters up to U+052F, white space spelt out.
_SPLIT = regex.compile(r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\t-\r \x85\xA0\p{L}\p{N}]+|[\t-\r \x85\xA0]+(?![^\t-\r \x85\xA0])|[\t-\r \x85\xA0]+""")

#: White space to Python, not to the pre-tokenizer.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


class Prefixes:
    """Prefix tables of one vocabulary; one per worker and path."""

    _open: dict[str, Prefixes] = {}

    @classmethod
    def of(cls, path: str) -> Prefixes:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        self.codec = Codec.of(path)
        self.token = {piece: i for i, piece in enumerate(self.codec.piece) if piece and i not in self.codec.specials.values()}
        self.trie: dict = {}  # byte -> node, and -1 -> the token that ends here
        for piece, i in self.token.items():
            node = self.trie
            for byte in piece:
                node = node.setdefault(byte, {})
            node[-1] = i
        self.pieces_kept: dict[str, bytes] = {}
        self.words = Words(lambda word: self._word(" " + word))
        self.pairs = self.codec.pairs

    def of_bytes(self, raw: bytes) -> list[int]:
        """Token counts of raw[:1], raw[:2], ... where no split divides raw."""
        pairs, stands, n = self.pairs.get, self.codec.stands, len(raw)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, node = last[start] << 32, self.trie
            for end in range(start + 1, n + 1):
                node = node.get(raw[end - 1])
                if node is None:
                    break
                if last[end] < 0 and (t := node.get(-1)) is not None:
                    ok = start == 0 or pairs(before | t)
                    if ok or ok is None and stands(before >> 32, t):
                        last[end], count[end] = t, count[start] + 1
        return count[1:]

    def of_piece(self, piece: str) -> np.ndarray:
        """Counts at the ends of the characters of one piece of the pre-tokenizer."""
        counts = np.array(self.of_bytes(piece.encode("utf-8", "surrogatepass")), np.int32)
        if piece.isascii():
            return counts
        return counts[np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece]) - 1]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces."""
        if _BEYOND.search(text):
            return [text[start:end] for _, (start, end) in self.codec.library.pre_tokenizer.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def of_stretch(self, text: str) -> np.ndarray:
        """Counts at the ends of the characters of text without special tokens.

        A prefix has the pieces of the text, but for one case: white space at its end is one piece, whatever follows
        in the text, so counts at such ends come from the run of white space as a whole.
        """
        counts, done, at = [], 0, 0
        run, run_base = -1, 0  # where the white space before this piece began, and the count before it
        for piece in self.pieces(text):
            own = self.of_piece(piece)
            shown = own + done
            if piece.isspace() and not _SEPARATORS.search(piece):
                if run < 0:
                    run, run_base = at, done
                else:
                    shown = self.of_piece(text[run : at + len(piece)])[at - run :] + run_base
            else:
                if run >= 0 and piece[0] == " ":
                    shown[0] = int(self.of_piece(text[run : at + 1])[-1]) + run_base
                run = -1
            counts.append(shown)
            done += int(own[-1])
            at += len(piece)
        return np.concatenate(counts) if counts else np.zeros(0, np.int32)

    def of_text(self, text: str) -> np.ndarray:
        """Token counts of text[:1], text[:2], ... as the library gives them for each prefix."""
        if not self.codec.specials or not (specials := list(self.codec.special.finditer(text))):
            return self._ordinary(text)
        found, base, at = [], 0, 0
        for m in specials:
            before = self._ordinary(text[at : m.end() - 1])  # a part of a special token is ordinary text
            found += [before + base, None]
            base += (int(before[m.start() - at - 1]) if m.start() > at else 0) + 1
            found[-1] = np.array([base], np.int32)
            at = m.end()
        return np.concatenate([*found, self._ordinary(text[at:]) + base])

    def _ordinary(self, text: str) -> np.ndarray:
        """Between single spaces, words are looked up; a split falls before each such space."""
        if not text:
            return np.zeros(0, np.int32)
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise UnsureSplit
            found = [self._word(first), *map(self.words.__getitem__, rest)]
        except UnsureSplit:
            return self.of_stretch(text)
        counts, totals = zip(*found, strict=True)
        totals = np.array(totals, np.int32)
        flat = np.frombuffer(b"".join(counts), np.uint8)
        return flat + np.repeat(np.cumsum(totals, dtype=np.int32) - totals, list(map(len, counts)))

    def _word(self, word: str) -> tuple[bytes, int]:
        """Counts for a word without inner white space, a byte each, and the last of them."""
        if len(word) > 100 or _BEYOND.search(word):
            raise UnsureSplit
        counts, done, after_space = bytearray(), 0, False
        for piece in _SPLIT.findall(word):
            if space := piece.isspace():
                if after_space or len(piece) > 1:
                    raise UnsureSplit
            after_space = space
            own = self.pieces_kept.get(piece)
            if own is None:
                raw = piece.encode("utf-8", "surrogatepass")
                own = self.of_bytes(raw)
                if len(raw) != len(piece):
                    own = [c for c, following in zip(own, [*raw[1:], 0], strict=True) if following & 0xC0 != 0x80]
                own = bytes(own)
                if len(self.pieces_kept) < MOST_KEPT:
                    self.pieces_kept[piece] = own
            counts += bytes([c + done for c in own]) if done else own
            done += own[-1]
        return bytes(counts), done


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, width and `steps`: by how much the token count changes at each character, as little-endian
    integers of `width` bytes, the least that hold the text's steps."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes.of(path)
        for batch, texts in slices(batches):
            n_bytes, widths, steps = [], [], []
            for text in texts:
                width, own = packed(prefixes.of_text(text))
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                widths.append(width)
                steps.append(own)
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(widths, pa.int32()), pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "width", "steps"])

    return rows.mapInArrow(counted, "doc_id long, n_bytes long, width int, steps binary")


def packed(counts: np.ndarray) -> tuple[int, bytes]:
    steps = np.diff(counts, prepend=0)
    most = int(np.abs(steps).max()) if len(steps) else 0
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    return width, steps.astype(f"<i{width}").tobytes()


def _counts(steps: bytes, width: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


def prefix_counts(table: DataFrame) -> DataFrame:
    """The table with `counts` for its steps: counts[i] is the token count of the first i + 1 characters."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _counts(batch.column("steps")[i].as_py(), batch.column("width")[i].as_py())
                columns = [batch.column("doc_id").slice(i, 1), batch.column("n_bytes").slice(i, 1), pa.array([own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "counts"])

    return table.mapInArrow(unpacked, "doc_id long, n_bytes long, counts array<long>")


def tokens_in(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first n_chars characters."""
    at = F.least(n_chars, F.size(counts))
    return F.when(at <= 0, F.lit(0)).otherwise(F.element_at(counts, F.greatest(at, F.lit(1)).cast("int"))).cast("long")


def chars_within(counts: Column, budget: int) -> Column:
    """The most characters whose tokens fit the budget (counts may fall again, so the last such prefix is taken)."""
    fits = F.array_position(F.transform(F.reverse(counts), lambda c: c <= budget), F.lit(True))
    return F.when(F.size(counts) == 0, F.lit(0)).when(fits == 0, F.lit(0)).otherwise(F.size(counts) - fits + 1).cast("long")


def count_documents(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fits_chars (the characters that the limit leaves room for), from the
    table of all documents, which is stored once: other limits or lengths need only another look at it."""
    return within(stored(prefix_table(docs, path), "prefix-table"), limit)


def within(table: DataFrame, limit: int) -> DataFrame:
    """The answers of tokens_in (the whole text) and chars_within for every row of a stored prefix_table."""
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, fits = [], []
            for steps, width in zip(batch.column("steps"), batch.column("width").to_pylist(), strict=True):
                counts = _counts(steps.as_buffer(), width)
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                inside = np.flatnonzero(counts <= limit)
                fits.append(int(inside[-1]) + 1 if len(inside) else 0)
            own = [pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *own], names=names)

    return table.mapInArrow(asked, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
