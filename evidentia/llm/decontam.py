"""Benchmark decontamination: SimHash fingerprints of windows as long as the items.

1. Words are runs of letters and digits, in lower case. An item of n words and a window of n words have equally many
   shingles of SHINGLE words, so to reach the similarity they must share some of any few of the item's shingles whose
   weight exceeds what may differ. Windows are therefore taken, at every place, around such anchors.
2. Each window gets a SimHash fingerprint of its words, and so does each item. Fingerprints are cut into RADIUS + 1
   blocks; two within RADIUS bits agree in a block at least, so joining on the blocks (and the length) meets every pair
   within the radius.
3. A candidate counts if the weighted similarity of the shingle bags, shared weight over joint weight, is at least
   0.8; weights are the shingles' counts.

Texts are cut into stretches that overlap by an item's length, so no task or row grows with a text. The items' side of
each join is broadcast only if it has MOST_BROADCAST rows at most; beyond that the joins shuffle places, hashes and
fingerprints without what they belong to, which is fetched for hits alone, and every key is split over SALTS tasks, so
that a passage in a third of all documents burdens no single one. DataFrame functions only.

Defined cases: null texts, items without words and empty tables match nothing; items shorter than a shingle count as one
shingle; rows with one doc_id are judged together; equal rows get equal results; only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHINGLE = 5
RADIUS = 15
NUM, DEN = 80, 100
MOST_BROADCAST = 100_000
STRETCH = 512
SALTS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _once(value: Column, use) -> Column:
    """use(value), with the value bound to a variable, so that it is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(hw: Column, k: int) -> Column:
    """Hashes of the k words from each place on; null where there are fewer."""
    return _once(hw, lambda v: F.when(F.size(v) >= k, F.transform(F.sequence(F.lit(0), F.size(v) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(v, i + j) for j in range(k)]))))


WIDTH, FIELDS = 8, 7
BITS = WIDTH * FIELDS  # the sign bit and its byte stay free, so that no sum overflows
MOST_COUNT = (1 << WIDTH) - 1
_ONES = sum(1 << (WIDTH * f) for f in range(FIELDS))


def _counts(hashes: Column) -> Column:
    """How many of the hashes have bit 0, 1, ... BITS - 1 set, for MOST_COUNT hashes at most: bit j + WIDTH * f is counted in
    field f of the long s{j}."""
    ones = F.lit(_ONES).cast("long")
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{j}") for j in range(WIDTH)])
    return F.aggregate(hashes, zero, lambda acc, x: F.struct(*[(acc[f"s{j}"] + F.shiftrightunsigned(x, j).bitwiseAND(ones)).alias(f"s{j}") for j in range(WIDTH)]))


def fingerprint(hashes: Column, n: Column, longest: int) -> Column:
    """The bits, of BITS, that are set in more than half of the n hashes (`longest` at most). More than MOST_COUNT hashes
    are counted in parts."""
    ones = F.lit(_ONES).cast("long")

    def packed(acc: Column) -> Column:
        lift = ones * ((1 << (WIDTH - 1)) - 1 - F.floor(F.least(n, F.lit(MOST_COUNT)) / 2)).cast("long")
        return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftrightunsigned(acc[f"s{j}"] + lift, WIDTH - 1).bitwiseAND(ones), j) for j in range(WIDTH)])

    def summed(parts: Column) -> Column:
        def bit(b: int) -> Column:
            count = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + F.shiftrightunsigned(p[f"s{b % WIDTH}"], b // WIDTH * WIDTH).bitwiseAND(F.lit(MOST_COUNT)))
            return F.when(2 * count > n, F.lit(1 << b).cast("long")).otherwise(0)

        return reduce(lambda a, b: a.bitwiseOR(b), [bit(b) for b in range(BITS)])

    short = _once(_counts(hashes), packed)
    if longest > MOST_COUNT:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(MOST_COUNT)), lambda at: _counts(F.slice(hashes, at, F.lit(MOST_COUNT))))
        short = F.when(n <= MOST_COUNT, short).otherwise(_once(parts, summed))
    return F.coalesce(short, F.lit(0).cast("long"))


def blocks(fp: Column, n_blocks: int) -> list[Column]:
    """The fingerprint's bits in n_blocks runs."""
    ends = [BITS * b // n_blocks for b in range(n_blocks + 1)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") for a, b in zip(ends, ends[1:])]


def bag_overlap(a: Column, b: Column) -> Column:
    """Shared weight of two bags."""

    def shared(own: Column) -> Column:
        return F.aggregate(
            F.array_intersect(own, b), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(own, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))
        )

    return _once(a, shared)


def _few(table: DataFrame) -> bool:
    return table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a table of the items."""
    return rows.join(F.broadcast(table), keys) if _few(table) else _dealt(rows, table, keys)


def _dealt(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The same by a shuffle, with every key split over SALTS tasks."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, first_word (place of the window among the document's words), n_words, similarity."""
    known = items.select(F.col("item_id").cast("long"), word_hashes(F.col("text")).alias("hw")).where(F.size("hw") > 0)
    known = stored(known.withColumn("n", F.size("hw")).withColumn("k", F.least(F.col("n"), F.lit(SHINGLE))), "items")
    shapes = known.agg(F.max("n").alias("longest"), F.collect_set("k").alias("ks")).first()  # a number, and SHINGLE at most
    if shapes["longest"] is None:
        return docs.select(F.col("doc_id").cast("long")).limit(0).selectExpr("doc_id", "0L AS item_id", "0L AS first_word", "0 AS n_words", "0D AS similarity")
    found = [_matches(docs, known.where(F.col("k") == k), k, shapes["longest"], radius) for k in sorted(shapes["ks"])]
    return reduce(DataFrame.unionByName, found)


def _placed(rows: DataFrame, k: int, step: int, longest: int) -> DataFrame:
    """doc_id, tx (the text's digest), at, and the hashes of words (hw) and shingles (sh) of each stretch of the texts."""
    texts = rows.select("doc_id", F.xxhash64("text").alias("tx"), word_hashes(F.col("text")).alias("hw"))
    # outer, and without conditions on what is computed here: those would be computed a second time for the condition
    stretches = texts.select("doc_id", "tx", F.explode_outer(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("hw") - 1, F.lit(0)), F.lit(step)),
        lambda at: F.struct(at.alias("at"), F.slice(F.col("hw"), at + 1, F.lit(step + longest - 1)).alias("hw")),
    )).alias("part")).select("doc_id", "tx", "part.at", "part.hw")
    return stretches.withColumn("sh", _shingles(F.col("hw"), k))


def _far_hits(rows: DataFrame, anchors: DataFrame, k: int, step: int, longest: int) -> DataFrame:
    """What the stretches share with anchors that are too many to be sent to all tasks: places and hashes move alone, and
    meet their stretch, once more made from the text, where there is a hit."""
    places = _placed(rows, k, step, longest).select("tx", "at", F.posexplode_outer("sh").alias("pos", "h")).where("h IS NOT NULL")
    found = stored(_dealt(places, anchors, ["h"]).select("tx", "at", "item_id", "n", "pos").distinct(), "hits")
    whole = rows.withColumn("_tx", F.xxhash64("text")).join(found.select(F.col("tx").alias("_tx")).distinct(), "_tx", "left_semi").drop("_tx")
    return _dealt(_placed(whole, k, step, longest), found, ["tx", "at"])


def _matches(docs: DataFrame, items: DataFrame, k: int, longest: int, radius: int) -> DataFrame:
    hashed = items.withColumn("bag", _shingles(F.col("hw"), k)).withColumn("m", F.size("bag"))
    few = F.col("m") - F.ceil(F.col("m") * (2 * NUM) / F.lit(float(NUM + DEN)) - F.lit(1e-9)) + 1
    anchors = hashed.select("item_id", "n", F.explode(F.slice(F.array_sort("bag"), F.lit(1), few.cast("int"))).alias("h")).distinct()

    step = max(STRETCH, 8 * longest)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    near_by = _few(anchors)
    if near_by:
        placed = _placed(rows, k, step, longest).withColumn("here", F.col("sh"))
        hits = _met(placed.select("doc_id", "tx", "at", "hw", "sh", F.posexplode_outer("here").alias("pos", "h")), anchors, ["h"])
    else:
        hits = _far_hits(rows, anchors, k, step, longest)
    first = F.greatest(F.lit(0), F.col("pos") - (F.col("n") - k))
    near = hits.where(F.size("hw") - first >= F.col("n")).select(
        "doc_id", "tx", "at", "item_id", "n", "pos", first.alias("first"), F.slice("hw", first + 1, 2 * F.col("n") - k).alias("hw"), F.slice("sh", first + 1, 2 * (F.col("n") - k) + 1).alias("sh")
    )
    same_text = Window.partitionBy("doc_id", "tx", "at", "item_id").orderBy("pos")
    before = F.lag("pos").over(same_text)
    skipped = F.greatest(F.lit(0), F.coalesce(before, F.lit(-1)) + 1 - F.col("first"))
    near = near.withColumn("skip", skipped).withColumn("last", F.least(F.col("pos") - F.col("first"), F.size("hw") - F.col("n"))).where("skip <= last")

    windows = near.select("doc_id", "item_id", "n", (F.col("at") + F.col("first")).alias("at"), "hw", "sh", F.explode(F.sequence("skip", "last")).alias("s"))
    windows = windows.withColumn("fp", fingerprint(F.slice("hw", F.col("s") + 1, F.col("n")), F.col("n"), longest)).drop("hw")
    marks = hashed.withColumn("fp", fingerprint(F.col("hw"), F.col("n"), longest)).select("item_id", "fp", "bag")

    own = F.slice("sh", F.col("s") + 1, F.col("n") - k + 1)
    if not near_by:
        return _alike(_far_close(windows, marks, radius), own, k)

    n_blocks = radius + 1
    listed = lambda c: F.array(*blocks(c, n_blocks))
    met = marks.select("item_id", F.col("fp").alias("item_fp"), "bag", F.posexplode(listed(F.col("fp"))).alias("block", "value"))
    probes = windows.select("doc_id", "item_id", "n", "at", "s", "sh", "fp", F.posexplode(listed(F.col("fp"))).alias("block", "value"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = reduce(lambda a, b: a | b, [(F.col("block") > b) & (x == 0) for b, x in enumerate(blocks(differ, n_blocks))])
    close = _met(probes, met, ["item_id", "block", "value"]).where((F.bit_count(differ) <= radius) & ~earlier)
    return _alike(close, own, k)


def _far_close(windows: DataFrame, marks: DataFrame, radius: int) -> DataFrame:
    """The windows within the radius of their item, with its bag: fingerprints move alone, and fetch windows and bags of
    what is left."""
    listed = lambda c: F.array(*blocks(c, radius + 1))
    kept = stored(windows.withColumn("_window", F.monotonically_increasing_id()), "windows")
    items = marks.select("item_id", F.col("fp").alias("item_fp"), F.posexplode(listed(F.col("fp"))).alias("block", "value"))
    probes = kept.select("_window", "item_id", "fp", F.posexplode(listed(F.col("fp"))).alias("block", "value"))
    near = _dealt(probes, items, ["item_id", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return _dealt(kept.join(near.select("_window").distinct(), "_window").drop("_window"), marks.select("item_id", "bag"), ["item_id"])


def _alike(close: DataFrame, own: Column, k: int) -> DataFrame:
    """The windows whose bag of shingles is as similar to the item's as it has to be."""
    shared = close.select("doc_id", "item_id", (F.col("at") + F.col("s")).cast("long").alias("first_word"), F.col("n").alias("n_words"), bag_overlap(own, F.col("bag")).alias("o"))
    m = F.col("n_words") - k + 1
    alike = shared.where(F.col("o") * (NUM + DEN) >= 2 * NUM * m)
    return alike.select("doc_id", "item_id", "first_word", "n_words", (F.col("o") / (2 * m - F.col("o"))).alias("similarity")).distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document: doc_id, contaminated, n_items, items (ascending) and the best similarity (0 without any)."""
    found = matches(docs, items).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
    per_doc = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_list("item_id")).alias("items"), F.max("similarity").alias("similarity")
    )
    rows = docs.select(F.col("doc_id").cast("long")).join(per_doc, "doc_id", "left")
    items_found = F.coalesce("items", F.array().cast("array<long>"))
    return rows.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )
