"""Conflicts between observations, deterministic causes over reported ones, and names of tool calls."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalised


def counter_conflict(df: DataFrame, keys: list[str], source: str, order: str, components: list[str]) -> DataFrame:
    """Per key whether its cumulative rows disagree: the greatest row is below another in some component, or a source's
    own counter falls."""
    within = Window.partitionBy(*keys, source).orderBy(order)
    fell = F.lit(False)
    for c in components:
        fell = fell | F.coalesce(F.col(c) < F.lag(c).over(within), F.lit(False))
    top = [F.max(c).alias(f"_t_{c}") for c in components]
    winner = F.max(F.struct(*components)).alias("_w")
    sums = df.withColumn("_fell", fell).groupBy(*keys).agg(*top, winner, F.bool_or("_fell").alias("_any"))
    dominated = F.lit(False)
    for c in components:
        dominated = dominated | (F.col(f"_w.{c}") < F.col(f"_t_{c}"))
    return sums.select(*keys, (F.col("_any") | F.coalesce(dominated, F.lit(False))).alias("conflict"))


def once_per_event(df: DataFrame, key: str, content: list[str], order: list[str]) -> DataFrame:
    """The first row of each event key, how often it was told, and whether its content ever differed."""
    place = F.struct(*order)
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return df.withColumn("_d", digest).groupBy(key).agg(
        *[F.min_by(c, place).alias(c) for c in content], F.count(F.lit(1)).alias("told"), (F.min("_d") != F.max("_d")).alias("conflict"))


def cause(deterministic: Column, reported: Column) -> dict[str, Column]:
    """Deterministic evidence wins; that the model said otherwise is kept as a conflict."""
    conflict = F.coalesce(deterministic != reported, F.lit(False))
    return {
        "cause": F.coalesce(deterministic, reported),
        "provenance": F.when(deterministic.isNotNull(), "derived").when(reported.isNotNull(), "model_reported").otherwise("estimated"), "conflict": conflict,
    }


def tool_family(name: Column) -> Column:
    """The safe name under which a call is counted; unknown for any other."""
    # Tool names that are counted under their own or another name.
    same = ("apply_patch", "exec_command", "file_read", "read_mcp_resource", "view_image")
    return F.when(name.isin("web__run", "web.run"), "web").when(name.startswith("mcp__"), "mcp").when(name.isin("write_file", "file_write"), "file_write").when(name.isin(*same), name).otherwise("unknown")


def patched_files(patch: Column) -> Column:
    """The paths that a patch's headers name, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Update|Add|Delete) File: ([^\n]+)"), 1), lambda p: F.trim(p)))


# What a label may not hold, and the prefixes of references.
REFERENCES = ("task", "hprj", "hcap", "hann", "hreq", "hpay", "hpilot")
PRIVATE = (
    r"[/\\@]",
    r"\.\.",
    r"(?i)\A(?:file|https?):",
    r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}",
    rf"(?i)(?:{'|'.join(REFERENCES)})_v?[0-9a-f]{{8,}}",
    r"(?i)(?:api[_-]?key|secret|password|token|authorization)\s*[:=]",
)


@F.pandas_udf(T.StringType())
def _composed(labels: pd.Series) -> pd.Series:
    def one(value: str | None) -> str | None:
        if value is None:
            return None
        value = unicodedata.normalize("NFC", value)
        return None if any(unicodedata.category(c).startswith("C") for c in value) else value

    return labels.map(one, na_action="ignore")


def label(value: Column) -> Column:
    """A label of 1 to 80 characters in composed form with single spaces; null where it could identify anyone."""
    composed = _composed(value)
    plain = normalised(composed)
    private = reduce(lambda a, b: a | b, [plain.rlike(p) for p in PRIVATE])
    return F.when(F.char_length(composed).between(1, 80) & (plain != "") & ~private, plain)


def changes_after(df: DataFrame, revision: str, after: int) -> DataFrame:
    return df.where(F.col(revision) > after)
