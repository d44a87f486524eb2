"""Numeric facts: a value or nothing, a lower bound, provenance and caveats; and comparisons of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "aggregate_component_unavailable"


def sum_facts(df: DataFrame, keys: list[str], value: str, lower: Column | None = None) -> DataFrame:
    """Per key the sum of facts: null if any value is (then estimated, with a caveat), and a lower bound in any case."""
    least = F.coalesce(F.col(value), F.lit(0).cast("long")) if lower is None else F.coalesce(F.col(value), lower, F.lit(0).cast("long"))
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"), F.sum(value).alias("_sum"), F.sum(least).alias("lower_bound"))
    whole = F.col("_n") == F.col("_known")
    return sums.select(
        *keys, F.when(whole, F.col("_sum")).alias("value"), "lower_bound", F.when(whole, "derived").otherwise("estimated").alias("provenance"),
        F.when(whole, F.array().cast("array<string>")).otherwise(F.array(F.lit(MISSING))).alias("caveats"))


def union_caveats(listed: Column) -> Column:
    """The distinct caveats of a list of lists, in order of first appearance."""
    return F.array_distinct(F.flatten(listed))


def compare(long_form: DataFrame, keys: list[str], metric: str, side: str, value: str) -> DataFrame:
    """baseline and current of each metric side by side: delta, change in hundredths of a percent (not for a zero
    baseline) and a verdict."""
    both = long_form.groupBy(*keys, metric).agg(
        F.max(F.when(F.col(side) == "baseline", F.col(value))).alias("baseline"), F.max(F.when(F.col(side) == "current", F.col(value))).alias("current"))
    delta = F.col("current") - F.col("baseline")
    return both.withColumns({
        "delta": delta, "change_bp": F.when(F.col("baseline") != 0, (delta * 10_000 / F.col("baseline")).cast("long")),
        "verdict": F.when(F.col("baseline").isNull() | F.col("current").isNull(), "unknown").when(F.col("baseline") == 0, "partial").otherwise("comparable")})


def earlier(df: DataFrame, keys: list[str], at: str, ref: str, values: list[str], n: int) -> DataFrame:
    """Adds `_last`: the values of the n latest rows (by at, then ref) that are strictly earlier.

    Each instant keeps its n last rows, and n instants before hold enough of them: no row ever carries its whole history.
    """
    ties = Window.partitionBy(*keys, at).orderBy(F.col(ref).desc())
    kept = df.select(*keys, at, F.struct(ref, *[v for v in values if v != ref]).alias("_v"), F.row_number().over(ties).alias("_back")).where(F.col("_back") <= n)
    instants = kept.groupBy(*keys, at).agg(F.array_sort(F.collect_list("_v")).alias("_own"))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(-n, -1)
    listed = F.flatten(F.collect_list("_own").over(before))
    last = F.slice(listed, F.greatest(F.lit(1), F.size(listed) - n + 1), F.lit(n))
    return df.join(instants.select(*keys, at, last.alias("_last")), [*keys, at])


def trend(df: DataFrame, keys: list[str], at: str, value: str, n: int = 4) -> DataFrame:
    """Adds twice the median of the n latest strictly earlier values (null with fewer), and `warning`: above it."""
    last = F.array_sort(F.transform("_last", lambda x: x[value]))
    low, high = (n - 1) // 2, n // 2
    twice = F.when(F.size("_last") == n, F.get(last, F.lit(low)) + F.get(last, F.lit(high)))
    found = earlier(df, keys, at, value, [value], n).withColumn("twice_median", twice)
    return found.select(*df.columns, "twice_median", F.coalesce(2 * F.col(value) > F.col("twice_median"), F.lit(False)).alias("warning"))


def thresholds(facts: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Adds a boolean per gate (null counts as not passed) and whether all passed."""
    out = facts.withColumns({name: F.coalesce(gate, F.lit(False)) for name, gate in gates.items()})
    passed = F.lit(True)
    for name in gates:
        passed = passed & F.col(name)
    return out.withColumn("passed", passed)


def dangling(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Both sides of a closure: references to nothing, and known things that nothing refers to."""
    refs, ids = references.select(key).distinct(), known.select(key).distinct()
    return refs.join(ids, key, "left_anti").withColumn("problem", F.lit("dangling")).unionByName(ids.join(refs, key, "left_anti").withColumn("problem", F.lit("orphan")))


def page(df: DataFrame, at: str, ref: str, size: int, cursor: tuple | None = None) -> DataFrame:
    """The next page after a cursor (at, ref), latest first, and one row more that tells whether there is another."""
    rows = df
    if cursor is not None:
        c_at, c_ref = F.lit(cursor[0]), F.lit(cursor[1])
        rows = df.where((F.col(at) < c_at) | ((F.col(at) == c_at) & (F.col(ref) > c_ref)))
    return rows.orderBy(F.col(at).desc(), F.col(ref).asc()).limit(size + 1)
