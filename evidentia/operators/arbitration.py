"""Which of several observations of one thing counts: authority, field by field, conflicts recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that a task of zip_families sorts, about.
ROWS_PER_TASK = 1_000_000


def authority(family: Column, ranks: dict[str, int]) -> Column:
    """The rank of a source family; unknown ones have 0."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, family), F.lit(0)).cast("long")


def select_source(df: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Adds `rank` and `contributes`: only rows of the highest family of their key count towards totals."""
    ranked = df.withColumn("rank", rank)
    best = ranked.groupBy(*keys).agg(F.max("rank").alias("_best"))
    return ranked.join(best, keys).withColumn("contributes", F.col("rank") == F.col("_best")).drop("_best")


def merge_fields(candidates: DataFrame, keys: list[str], fields: dict[str, tuple[str, str, list[str]]]) -> DataFrame:
    """One row per key; each field comes from its own winner. fields: name -> (column, max or min, order of the winners)."""
    picks = []
    for name, (column, how, order) in fields.items():
        by = F.struct(*[F.when(F.col(column).isNotNull(), F.col(c)).alias(f"k{i}") for i, c in enumerate(order)])
        place = F.when(F.col(column).isNotNull(), by)
        picks.append((F.max_by if how == "max" else F.min_by)(F.col(column), place).alias(name))
    return candidates.groupBy(*keys).agg(*picks, F.count(F.lit(1)).alias("candidates"))


def resolve_parents(claims: DataFrame, child: str, parent: str, kind: str) -> DataFrame:
    """One parent per child: an ambiguous claim, or several parents of the deciding kind, leave it open; one confirmed
    parent counts 1.0, else one inferred 0.6."""
    sets = claims.groupBy(child).agg(
        *[f(F.when(F.col(kind) == k, F.col(parent))).alias(f"_{k}_{n}") for k in ("confirmed", "inferred") for n, f in (("lo", F.min), ("hi", F.max))],
        F.max((F.col(kind) == "ambiguous").cast("int")).alias("_open"),
    )
    one = lambda k: F.col(f"_{k}_lo") == F.col(f"_{k}_hi")
    confirmed, several = one("confirmed"), F.col("_confirmed_lo") != F.col("_confirmed_hi")
    state = F.when((F.col("_open") == 1) | F.coalesce(several, F.lit(False)), "ambiguous").when(confirmed, "confirmed").when(one("inferred"), "inferred").otherwise("ambiguous")
    return sets.withColumn("confidence_kind", state).select(
        child, F.when(F.col("confidence_kind") == "confirmed", F.col("_confirmed_lo")).when(F.col("confidence_kind") == "inferred", F.col("_inferred_lo")).alias("parent"),
        "confidence_kind", F.when(F.col("confidence_kind") == "confirmed", 1.0).when(F.col("confidence_kind") == "inferred", 0.6).otherwise(0.0).alias("confidence"),
    )


def boundary(events: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The greatest event of each key by (authority, instant, ...); nulls count as least."""
    return events.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_m")).select(*keys, *[F.col(f"_m.{v}").alias(v) for v in values])


def zip_families(events: DataFrame, keys: list[str], instant: str, family_rank: str, order: list[str], duration: str) -> DataFrame:
    """The same event told by several source families counts once: the i-th of each family at an instant belong
    together, the highest family's row stays, and its duration only if all agree.

    Both steps run on rows dealt once, by key and instant, into partitions of about ROWS_PER_TASK: a task's memory stays the
    same as the events grow."""
    n_tasks = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // ROWS_PER_TASK))
    events = events.repartition(n_tasks, *keys, instant)
    own = Window.partitionBy(*keys, instant, family_rank).orderBy(*order)
    numbered = events.withColumn("_i", F.row_number().over(own))
    group = [*keys, instant, "_i"]
    agreed = F.when(F.min(duration) == F.max(duration), F.min(duration))
    return numbered.groupBy(*group).agg(F.max(family_rank).alias(family_rank), agreed.alias(duration), F.count(F.lit(1)).alias("told")).drop("_i")


def split_inserts(known: DataFrame, arriving: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Each arriving row's outcome: inserted (the first row of a new key), duplicate (the content that its key has) or
    conflicting. Of several rows of a new key the one with the least content digest counts as first; a known key with
    several contents has the one with the least digest."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in content])), 256)
    old = known.groupBy(key).agg(F.min(digest).alias("_old"))
    own = Window.partitionBy(key).orderBy("_new")
    rows = arriving.withColumn("_new", digest).withColumns({"_first": F.first("_new").over(own), "_at": F.row_number().over(own)}).join(old, key, "left")
    inserted = F.col("_old").isNull() & (F.col("_at") == 1)
    same = F.col("_new") == F.coalesce("_old", "_first")
    return rows.withColumn("outcome", F.when(inserted, "inserted").when(same, "duplicate").otherwise("conflicting")).drop("_old", "_new", "_first", "_at")


def unchanged(listing: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """What is new or changed in a listing: rows without exactly one equal row in the stored state."""
    once = state.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return listing.join(once, columns, "left_anti")


def only_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose rows agree on one value, with it."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_hi")).where(F.col(value) == F.col("_hi")).drop("_hi")
