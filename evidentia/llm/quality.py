"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its failure bit and the measurements behind it.
A policy is a named set of bits, so another version, or an ablation, is bit arithmetic over the stored ledger and
never reads a text again.

Defined cases: a null text is an empty one (all measurements 0, rule `few_words` fails); equal rows get equal ledger
rows; an empty table gives an empty ledger; further columns of the input are not carried (the ledger joins by doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in the order of their bits: name -> condition for failure over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
    "shouting": "2 * n_upper_words > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": tuple(RULES),
}

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper_words long"
WINDOW = 8
#: The symbols that count.
SYMBOLS = b"#*$%&|<>"


def policy_mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur at least twice.

    Windows get exact integer names by doubling: names of 2w-windows are the ranks of pairs of names of w-windows.
    """
    n = len(words)
    if n <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    w = 1
    while w < width:
        pair = ids[:-w] * (int(ids.max()) + 1) + ids[w:]
        ids = np.unique(pair, return_inverse=True)[1]
        w *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly at \x20 and \x09-\x0D
    joined = b"".join(words)
    code_points = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    n_lines = n_dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    return (
        len(words), code_points, len(joined) - len(joined.translate(None, SYMBOLS)), n_lines, n_dup,
        repeated_words(words), sum(map(bytes.isupper, words)),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in MEASURES.split(", ")]
    for batch in batches:
        found = [measure(t.as_py()) for t in batch.column("text")]
        cols = list(zip(*found, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *names]
        )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: a bit for each rule of RULES that the document fails."""
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measured, f"doc_id long, {MEASURES}")
    failed = F.lit(0)
    for name, condition in RULES.items():
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measured.withColumn("failed", failed)


def passes(policy: str, failed: Column | str = "failed") -> Column:
    """True where no rule of the policy failed."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (would return without it), and in all."""
    mask = policy_mask(policy)
    own = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.count(F.lit(1)).alias("n_docs")]
    for name in POLICIES[policy]:
        sums += [
            F.count_if(own.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"fails_{name}"),
            F.count_if(own == BIT[name]).alias(f"alone_{name}"),
        ]
    one = ledger_rows.agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"fails_{name}").alias("n_fail"), F.col(f"alone_{name}").alias("n_only_this"), F.col("n_docs"))
        for name in POLICIES[policy]
    ])
    return one.select(F.inline(rows))
