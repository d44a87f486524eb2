"""Labelled half-open intervals [start, end) of a session, and what falls into them. Instants are longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_marks(marks: DataFrame, keys: list[str], at: str, tie: str, label: str) -> DataFrame:
    """An interval from each mark to the next one of its key (open at the last): keys, start, end, label."""
    ordered = Window.partitionBy(*keys).orderBy(at, tie)
    made = marks.select(*keys, F.col(at).alias("start"), F.lead(at).over(ordered).alias("end"), F.col(label).alias("label"))
    return made


def valid(intervals: DataFrame) -> DataFrame:
    """Without those that end at or before their start."""
    return intervals.where("start IS NOT NULL AND (end IS NULL OR end > start)")


def _latest(events: DataFrame, intervals: DataFrame, keys: list[str], place: Column, start: Column, end: Column) -> DataFrame:
    """Adds to each event `_iv`: of the intervals that start at or before it the latest (start, end, label), and how far
    the ones before that reach (`until`, `unending`). One sort over both sides together. Adds `_place` and `_holds` too."""
    known = intervals.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    earlier = Window.partitionBy(*keys).orderBy("_place", "label").rowsBetween(Window.unboundedPreceding, -1)
    marks = known.select(*keys, start.alias("_place"), end.alias("_end"), "label").withColumn("_iv", F.struct(
        F.col("_place").alias("start"), F.col("_end").alias("end"), "label", F.max("_end").over(earlier).alias("until"), F.coalesce(F.bool_or(F.col("_end").isNull()).over(earlier), F.lit(False)).alias("unending")))
    kind = marks.schema["_iv"].dataType
    probes = events.withColumns({"_place": place, "_iv": F.lit(None).cast(kind), "_probe": F.lit(1)})
    lined = marks.select(*[F.col(c) if c in keys else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns], "_place", "_iv", F.lit(0).alias("_probe"))
    so_far = Window.partitionBy(*keys).orderBy("_place", "_probe", F.col("_iv.label")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = probes.unionByName(lined).withColumn("_iv", F.last("_iv", ignorenulls=True).over(so_far)).where("_probe = 1").drop("_probe")
    holds = F.col("_iv").isNotNull() & (F.col("_iv.end").isNull() | (F.col("_place") < F.col("_iv.end")))
    others = F.col("_iv").isNotNull() & (F.col("_iv.unending") | F.coalesce(F.col("_place") < F.col("_iv.until"), F.lit(False)))
    return met.withColumns({"_holds": holds, "_others": others})


def attribute(events: DataFrame, intervals: DataFrame, keys: list[str], at: str, identity: str, bin_width: int) -> DataFrame:
    """Adds `label` of the interval with the greatest (start, label) that holds the event, and `overlap` (several do).

    The latest interval to start answers for nearly all events. Where it has ended while an earlier one has not, the
    event alone is taken to a join over bins of bin_width, with the intervals of its key that earlier ones reach into.
    """
    met = _latest(events, valid(intervals), keys, F.col(at), F.col("start"), F.col("end"))
    answered = met.where("_holds OR NOT _others").select(*events.columns, F.when(F.col("_holds"), F.col("_iv.label")).alias("label"), (F.col("_holds") & F.col("_others")).alias("overlap"))
    return answered.unionByName(_by_bins(met.where("NOT _holds AND _others").select(*events.columns), intervals, keys, at, identity, bin_width))


def _by_bins(events: DataFrame, intervals: DataFrame, keys: list[str], at: str, identity: str, bin_width: int) -> DataFrame:
    """As attribute, by a join of equal keys and bins: an interval appears once per bin it touches, up to its key's last
    event of these."""
    span = events.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    closed = valid(intervals).join(span, keys).withColumns({"_end": F.least(F.coalesce("end", F.col("_last") + 1), F.col("_last") + 1), "_from": F.greatest("start", "_first")}).where("_from < _end")
    bins = F.sequence(F.floor(F.col("_from") / bin_width), F.floor((F.col("_end") - 1) / bin_width))
    cut = closed.select(*keys, "start", "_end", "label", F.explode(bins).alias("_bin"))
    binned = events.withColumn("_bin", F.floor(F.col(at) / bin_width))
    held = binned.join(cut, [*keys, "_bin"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("_end")))
    found = held.groupBy(identity).agg(F.max(F.struct("start", "label")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    return events.join(found, identity, "left").withColumn("label", F.col("_best.label")).withColumn("overlap", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_best", "_n")


def dropped(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, no_start, not_after: how many intervals of a key hold nothing, since their start isn't known, or since they
    end at or before it. intervals: keys, start, end, and the positions start_seq and end_seq where there are any."""
    placed = "start_seq" in intervals.columns
    ends = F.struct("end", *["end_seq"][: int(placed)]) <= F.struct(F.col("start").alias("end"), *[F.col("start_seq").alias("end_seq")][: int(placed)])
    missing = F.col("start").isNull()
    counts = intervals.groupBy(*keys).agg(F.count_if(missing).alias("no_start"), F.count_if(~missing & F.col("end").isNotNull() & ends).alias("not_after"))
    return counts.where("no_start > 0 OR not_after > 0")


def attribute_by_position(deltas: DataFrame, intervals: DataFrame, keys: list[str], at: str, sequence: str, identity: str) -> DataFrame:
    """Adds the label of the first interval that holds (instant, sequence), compared lexicographically; of intervals that
    start at one place the one that ends last counts, then the least label. What `dropped` counts holds nothing.

    intervals: keys, start, start_seq, end, end_seq, label. An interval that ends no later than one before it is never
    the first. Without these, starts and ends grow together, so the first to hold an event is the first that ends after
    it: two sorted passes, however many intervals overlap.
    """
    place = lambda a, b: F.struct(F.col(a).alias("at"), F.col(b).alias("seq"))
    sound = intervals.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).where("start IS NOT NULL")
    made = sound.select(*keys, place("start", "start_seq").alias("_from"), F.when(F.col("end").isNotNull(), place("end", "end_seq")).alias("_to"), "label").where("_to IS NULL OR _to > _from")
    before = Window.partitionBy(*keys).orderBy("_from", F.col("_to").desc_nulls_first(), "label").rowsBetween(Window.unboundedPreceding, -1)
    reach = made.withColumns({"_far": F.max("_to").over(before), "_open": F.coalesce(F.bool_or(F.col("_to").isNull()).over(before), F.lit(False))})
    leading = reach.where(~F.col("_open") & (F.col("_to").isNull() | F.col("_far").isNull() | (F.col("_to") > F.col("_far"))))
    marks = leading.select(*[F.col(c) if c in keys else F.lit(None).cast(deltas.schema[c].dataType).alias(c) for c in deltas.columns], F.col("_to").alias("_place"), F.struct("_from", "label").alias("_iv"), F.lit(1).alias("_mark"))
    probes = deltas.withColumns({"_place": place(at, sequence), "_iv": F.lit(None).cast(marks.schema["_iv"].dataType), "_mark": F.lit(0)})
    # from the last place to the first: the mark passed last is the least end after an event
    downward = Window.partitionBy(*keys).orderBy(F.col("_place").desc_nulls_first(), "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = probes.unionByName(marks).withColumn("_iv", F.last("_iv", ignorenulls=True).over(downward)).where("_mark = 0")
    return met.select(*deltas.columns, F.when(F.col("_place") >= F.col("_iv._from"), F.col("_iv.label")).alias("label"))


def coverage(attributed: DataFrame, keys: list[str], amount: str, labels: list[str]) -> DataFrame:
    """Per key the total, the amount under each label of the vocabulary (zero where there is none), and the rest."""
    parts = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col(amount))), F.lit(0)).alias(f"in_{x}") for x in labels]
    sums = attributed.groupBy(*keys).agg(F.sum(amount).alias("total"), *parts)
    named = sum((F.col(f"in_{x}") for x in labels), F.lit(0).cast("long"))
    return sums.withColumn("unclassified", F.col("total") - named)


def crosstab(attributed: DataFrame, dimensions: list[str]) -> DataFrame:
    return attributed.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, name: str, tie: str) -> DataFrame:
    """Adds to each left row the value of the key's latest right row at or before it: one sort over both sides together,
    so many rows of a key cost no more than their number."""
    probes = left.withColumns({"_value": F.lit(None).cast(right.schema[value].dataType), "_probe": F.lit(1)})
    marks = right.select(*[F.col(c) if c in (*keys, at, tie) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("_value"), F.lit(0).alias("_probe"))
    ordered = Window.partitionBy(*keys).orderBy(at, "_probe", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = probes.unionByName(marks).withColumn(name, F.last("_value", ignorenulls=True).over(ordered))
    return both.where("_probe = 1").drop("_value", "_probe")


def baseline_in_window(starts: DataFrame, snapshots: DataFrame, keys: list[str], start: str, at: str, width: int, value: str, tie: str) -> DataFrame:
    """Per key the value of the latest snapshot in [start, start + width], both ends included; null without any."""
    inside = snapshots.join(starts, keys).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(start) + width))
    found = inside.groupBy(*keys).agg(F.max_by(value, F.struct(at, tie)).alias("baseline"))
    return starts.join(found, keys, "left")


def contribution(total: Column, baseline: Column) -> Column:
    """What is left of a total after its replayed baseline: never negative, and not known without both."""
    left = total - baseline  # greatest() alone would take what is unknown for zero
    return F.when(left.isNotNull(), F.greatest(F.lit(0).cast("long"), left))
