"""Every fact of a nested report with its path and identity, and whether what is referred to is there, and the other way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical

SEP = "\x1f"


def _step(path: Column, name: Column) -> Column:
    """A JSON pointer one step further."""
    return F.concat(path, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def walked(value: Column, kind: T.DataType, path: Column) -> Column:
    """Array of (path, value) of everything in a value that has no parts; what has none of its parts, or is null, counts
    as a whole."""
    leaf = lambda text: F.array(F.struct(path.alias("path"), text.alias("value")))
    # every part gives a row at least: the value alone tells whether there are parts, which are laid out once
    if isinstance(kind, T.StructType) and kind.fields:
        empty, parts = value.isNull(), F.concat(*[walked(value.getField(f.name), f.dataType, _step(path, F.lit(f.name))) for f in kind.fields])
        return F.when(empty, leaf(F.lit("null"))).otherwise(parts)
    if isinstance(kind, T.ArrayType):
        parts = F.flatten(F.transform(value, lambda x, i: walked(x, kind.elementType, _step(path, i.cast("string")))))
        return F.when(value.isNull(), leaf(F.lit("null"))).when(F.size(value) == 0, leaf(F.lit("[]"))).otherwise(parts)
    if isinstance(kind, T.MapType):
        parts = F.flatten(F.transform(F.map_entries(value), lambda e: walked(e["value"], kind.valueType, _step(path, e["key"].cast("string")))))
        return F.when(value.isNull(), leaf(F.lit("null"))).when(F.size(value) == 0, leaf(F.lit("{}"))).otherwise(parts)
    return leaf(canonical(value, kind))


def evidence_id(*of: Column) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws(SEP, *of), 256), 1, 16))


def registered(reports: DataFrame, task: str, report: str) -> DataFrame:
    """task, path, value (canonical JSON) and evidence_id of every fact of the reports, one row per fact."""
    kind = reports.schema[report].dataType
    rows = reports.select(task, F.explode(walked(F.col(report), kind, F.lit(""))).alias("_f")).select(task, "_f.path", "_f.value")
    return rows.withColumn("evidence_id", evidence_id(F.col(task).cast("string"), F.col("path"), F.col("value")))


def closure(registry: DataFrame, references: DataFrame, task: str) -> DataFrame:
    """task, evidence_id, problem: a reference of a task to what it doesn't have (dangling), a fact of it that nothing refers
    to (orphan), and an identity that several of its facts bear (ambiguous). references: task, evidence_id."""
    key = [task, "evidence_id"]
    own = registry.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    asked = references.select(*key).distinct()
    found = {"dangling": asked.join(own, key, "left_anti"), "orphan": own.join(asked, key, "left_anti"), "ambiguous": own.where("_n > 1")}
    return reduce(DataFrame.unionByName, [df.select(*key).withColumn("problem", F.lit(name)) for name, df in found.items()])


def task_views(registry: DataFrame, references: DataFrame, task: str) -> DataFrame:
    """Per task: facts, references, and how many problems of each kind; closed if there is none. Facts and references of
    an identity are counted together, so either table is read once."""
    key = [task, "evidence_id"]
    both = registry.select(*key, F.lit(1).alias("_own"), F.lit(0).alias("_asked")).unionAll(references.select(*key, F.lit(0).alias("_own"), F.lit(1).alias("_asked")))
    each = both.groupBy(*key).agg(F.sum("_own").alias("_own"), F.max("_asked").alias("_asked"))
    # an identity that is null meets no other
    own, asked = F.col("_own") > 0, F.col("_asked") > 0
    met = own & asked & F.col("evidence_id").isNotNull() & F.col(task).isNotNull()
    rows = each.groupBy(task).agg(
        F.sum("_own").alias("facts"), F.sum("_asked").cast("long").alias("references"), F.count_if(asked & ~met).alias("dangling"), F.count_if(own & ~met).alias("orphan"), F.count_if(F.col("_own") > 1).alias("ambiguous"))
    return rows.withColumn("closed", F.col("dangling") + F.col("orphan") + F.col("ambiguous") == 0)
