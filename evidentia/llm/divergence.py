"""Source divergence audit: how the terms of a source differ from those of the other sources and of the whole language.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that occur
in at least LEAST_DOCS of its documents. Most terms don't, and to find that out by grouping would move all of them, so a
sketch comes first: each task counts, for every (language, term), the documents it has seen, in ROWS rows of hashed
counters that stop at LEAST_DOCS. Added up over the tasks, a counter is never less than the documents of any term that
falls on it; so a term with a smaller counter in either row is impossible, and its counts never leave the task. Whatever
survives is counted exactly, and the limit is applied to the exact counts.

Sums over all kept terms of a language, for pairs of sources, are never taken term by term where a term is missing.
With p0 for a term that a group doesn't have, and f the divergence of one term,

    sum f(p, q) = sum over shared terms of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]
                + sum over g's terms of f(p, q0) + sum over h's terms of f(p0, q) + (V - V_g - V_h) f(p0, q0)

The first sum is a join of the sparse counts on (language, term), of each pair of sources once. The others depend on the
counts alone, so each group brings one row per distinct count, which meets the other groups of its language; both
sides of that join are dealt over a grid of cells, so no language is one task. What grows with the square of the
sources is the result itself.

The sketch has CELLS_PER_DOC counters per document, up to MOST_CELLS of two bits (ROWS * MOST_CELLS / 4 bytes are sent to
the tasks, 128 MB at most). In a corpus so large that it fills up it discards less; results are the same. Its blocks are
added up by the executors, a block a group, batch by batch. Counts are longs; p is computed in decimals where
SCALE * count exceeds a long.

Defined cases: null text, language or source count as empty; repeated rows are documents of their own; a group without
terms, or a language that keeps none, has its pairs (with value 0 where nothing is kept) and no term rows; an empty table
gives no rows; a long text is taken whole, as bytes; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, slices, stored

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
ROWS = 2
CELLS_PER_DOC, LEAST_CELLS, MOST_CELLS = 64, 1 << 16, 1 << 28
BLOCK = 1 << 16
MOST_HELD = 800_000  # counts that a task holds before it sends them
GRID = 8

#: Bytes of terms, A-Z lower-cased, and a blank for any other byte.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def _cells(lang: bytes, found: list[bytes], bits: int) -> np.ndarray:
    """Sketch row x term: the counter of each term of a language in each row."""
    seed = xxhash.xxh3_64_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in found), np.uint64, len(found))
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([h >> np.uint64(64 - bits), mixed >> np.uint64(64 - bits)]).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    def of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary").alias(name)

    return docs.select(of("lang"), of("source"), of("text"))


def _documents_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, Counter]]:
    """For each language the documents seen of each term; what is held is handed on before it outgrows MOST_HELD, and at
    the end."""
    held: dict[bytes, Counter] = {}
    for batch, texts in slices(batches, most_chars=2_000_000):
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            held.setdefault(lang, Counter()).update(set(terms(text)))
        if sum(map(len, held.values())) > MOST_HELD:
            yield held
            held = {}
    yield held


def sketch(docs: DataFrame) -> list[np.ndarray]:
    """A saturated counter (0 to LEAST_DOCS) per cell and row, of the documents of every (language, term)."""
    cells = max(LEAST_CELLS, min(MOST_CELLS, 1 << (CELLS_PER_DOC * docs.count()).bit_length()))
    bits = cells.bit_length() - 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen in _documents_of_terms(batches):
            for lang, found in seen.items():
                n = np.minimum(np.fromiter(found.values(), np.int64, len(found)), LEAST_DOCS).astype(np.uint8)
                for row, at in enumerate(_cells(lang, list(found), bits)):
                    order = np.argsort(at, kind="stable")
                    at, own = at[order], n[order]
                    blocks, starts = np.unique(at // BLOCK, return_index=True)
                    ends = [*starts, len(at)][1:]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(blocks), row), pa.int32()), pa.array(blocks, pa.int64()),
                            pa.array([(at[i:j] % BLOCK).astype(np.uint16).tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                            pa.array([own[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                        ],
                        names=["row", "block", "at", "n"],
                    )

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.uint8)
        for batch in batches:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                np.minimum(total + np.bincount(np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint8), BLOCK), LEAST_DOCS, out=total, casting="unsafe")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([packed(total)], pa.binary())], names=["row", "block", "n"])

    parts = _rows(docs).mapInArrow(counted, "row int, block long, at binary, n binary")
    merged = [np.zeros(cells // 4, np.uint8) for _ in range(ROWS)]
    for r in parts.groupBy("row", "block").applyInArrow(added, "row int, block long, n binary").toLocalIterator():
        merged[r["row"]][r["block"] * (BLOCK // 4) : (r["block"] + 1) * (BLOCK // 4)] = np.frombuffer(r["n"], np.uint8)
    return merged


def packed(n: np.ndarray) -> bytes:
    """Two bits a counter."""
    a, b, c, d = n.reshape(-1, 4).T
    return (a | b << 2 | c << 4 | d << 6).astype(np.uint8).tobytes()


def possible(merged: list[np.ndarray], lang: bytes, found: list[bytes]) -> np.ndarray:
    """Whether each term can be in LEAST_DOCS documents of the language."""
    bits = (len(merged[0]) * 4).bit_length() - 1
    every = np.ones(len(found), bool)
    for row, at in enumerate(_cells(lang, found, bits)):
        every &= (merged[row][at >> 2] >> (2 * (at & 3)).astype(np.uint8)) & 3 >= LEAST_DOCS
    return every


def term_counts(docs: DataFrame, merged: list[np.ndarray]) -> DataFrame:
    """lang, source, term, n, docs: exact, for all terms that the sketch leaves possible. docs is the number of documents
    of the group with the term."""
    sent = docs.sparkSession.sparkContext.broadcast(merged)

    def handed(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, seen) in held.items():
            names = list(counts)
            at = np.flatnonzero(possible(sent.value, lang, names))
            for i in range(0, len(at), 50_000):
                some = [names[k] for k in at[i : i + 50_000]]
                columns = [pa.repeat(pa.scalar(x.decode()), len(some)) for x in (lang, source)]
                n = [np.fromiter(map(c.__getitem__, some), np.int64, len(some)) for c in (counts, seen)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(some, pa.binary()).cast(pa.string()), *map(pa.array, n)], names=["lang", "source", "term", "n", "docs"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch, texts in slices(batches, most_chars=2_000_000):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                own = terms(text)
                counts.update(own)
                seen.update(set(own))
            if sum(len(c) for c, _ in held.values()) > MOST_HELD:
                yield from handed(held)
                held = {}
        yield from handed(held)

    found = _rows(docs).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chance(n: str, total: str, kept: str) -> Column:
    """p of a term with n of total occurrences among `kept` terms (1 + SCALE where nothing is kept)."""
    whole = f"greatest({total} + {kept}, 1L)"
    large = f"(CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({whole} AS DECIMAL(20, 0))"
    return F.expr(f"1L + CASE WHEN {n} < {(1 << 63) // SCALE - 1}L THEN ({SCALE}L * ({n} + 1)) div {whole} ELSE {large} END")


def apart(p: str, q: str) -> Column:
    """f of two chances."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def rated_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups: lang, source, total, n_terms, kept, p0 and lang_total, a row for every group that occurs. Terms: lang,
    source, term, n, p of the group and q of the language, for every kept term that a group has, with p0."""
    counts = stored(term_counts(docs, sketch(docs)), "term-counts")
    same = Window.partitionBy("lang", "term")
    whole = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(same).alias("n_lang"), F.sum("docs").over(same).alias("in_docs"), F.row_number().over(same.orderBy("source")).alias("at"))
    kept = stored(whole.where(F.col("in_docs") >= LEAST_DOCS).drop("in_docs"), "kept-terms")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("at") == 1).alias("kept"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    filled = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "n_terms", "lang_total", "kept"])
    groups = stored(filled.withColumn("p0", chance("0", "total", "kept")), "groups")
    met = joined(kept.drop("at"), groups.withColumn("weight", F.col("n_terms")), ["lang", "source"], "weight")
    rated = met.select("lang", "source", "term", "n", chance("n", "total", "kept").alias("p"), chance("n_lang", "lang_total", "kept").alias("q"), "p0")
    return groups, stored(rated, "rated-terms")


def source_pairs(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each group from every other source of its language."""
    alike = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("have")).withColumn("lack", F.col("have"))
    # a group's missing terms, as they count for its own chances and for those of another
    missing = groups.select("lang", "source", F.col("p0").alias("p"), (F.col("kept") - F.col("n_terms")).alias("have"), (-F.col("n_terms")).alias("lack"))
    cell = F.pmod(F.xxhash64("source"), F.lit(GRID))
    every = F.sequence(F.lit(0), F.lit(GRID - 1))
    x = alike.unionByName(missing).withColumn("i", cell).withColumn("j", F.explode(every))
    y = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), cell.alias("j")).withColumn("i", F.explode(every))
    met = x.join(y, ["lang", "i", "j"]).where("source <> item")
    ahead = met.select("lang", "source", "item", (F.col("have") * apart("p", "q0")).alias("value"))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("lack") * apart("q0", "p")).alias("value"))

    other = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    shared = rated.select("lang", "term", "source", "p", "p0").join(other, ["lang", "term"]).where("source < item")
    gained = apart("p", "o") - apart("p", "o0") - apart("p0", "o") + apart("p0", "o0")
    returned = apart("o", "p") - apart("o", "p0") - apart("o0", "p") + apart("o0", "p0")
    both = shared.groupBy("lang", "source", "item").agg(F.sum(gained).alias("ahead"), F.sum(returned).alias("back"))
    one = both.select("lang", "source", "item", F.col("ahead").alias("value"))
    two = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    return ahead.union(back).union(one).union(two).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    groups, rated = rated_terms(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    above = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    return ranked(source_pairs(groups, rated), "pair").union(ranked(above, "term").where(F.col("rank") <= TOP))
