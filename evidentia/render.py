"""Reports as JSON (an expression, on the executors) and as Markdown (for the few rows of a page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 100


def as_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def markdown(df: DataFrame, title: str) -> str:
    """A table of PAGE rows at most, with a note where there are more."""
    rows = df.limit(PAGE + 1).collect()
    cell = lambda v: "unknown" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:PAGE]]
    return "\n".join([*lines, "", f"Only the first {PAGE} rows are shown."] if len(rows) > PAGE else lines) + "\n"
