"""JSON-lines of agent sessions: {timestamp, type, payload}, one object per line.

Lines are read with their ordinal, parsed against an explicit schema and routed by kind; what cannot be read is a row
of diagnostics that carries no content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import instants
from ..functions.keys import hmac_sha256, pseudonym

# Kinds of lines that are read, and that are known but not read.
READ = {
    "session_meta": None, "turn_context": None,
    "event_msg": ("token_count", "sub_agent_activity", "task_started", "task_complete", "turn_aborted", "mcp_tool_call_end", "patch_apply_end", "web_search_end"),
    "response_item": ("custom_tool_call", "custom_tool_call_output", "function_call", "function_call_output"),
}
IGNORED = {"world_state": None, "event_msg": ("agent_reasoning", "agent_message", "user_message"), "response_item": ("reasoning", "message")}
UNKNOWN_KIND = {"event_msg": "unknown_event_type", "response_item": "unknown_response_type"}

ENVELOPE = "timestamp STRING, type STRING, payload STRING"
USAGE = "info STRUCT<total_token_usage: STRUCT<input_tokens: BIGINT, cached_input_tokens: BIGINT, output_tokens: BIGINT, reasoning_output_tokens: BIGINT, cache_write_input_tokens: BIGINT, total_tokens: BIGINT>, model_context_window: BIGINT>"


#: Lines whose fingerprints make one digest, and digests that make one of the next level.
BLOCK_LINES = 4096
#: Lines of a file that one task fills forward.
CHUNK_LINES = 1 << 16


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    """path, value, the file's size, the split's start, and an id that counts the lines of a split without a gap."""
    text = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")


def _splits(raw: DataFrame) -> DataFrame:
    """A row per split of a file: what to add to a line's id for its number, and the file's number of finished lines. The
    window is over the totals of the splits, not over lines."""
    totals = raw.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("value").cast("long") + 1).alias("_bytes"), F.first("_size").alias("_size"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    unfinished = (F.sum("_bytes").over(whole) > F.col("_size")).cast("long")  # a last line without its newline
    return totals.select(
        "path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_add"), (F.sum("_n").over(whole) - unfinished).alias("_lines"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"))


def lines(spark: SparkSession, folder: str, key: bytes) -> DataFrame:
    """path, ordinal (from 1), line and the keyed fingerprint of its bytes, of all *.jsonl below a folder.

    Files are read line by line, in splits, whatever their size. Lines are numbered in two levels: within its split a
    line's number is its id, and the totals of the splits before it come from a table of one row per split; no file
    meets in one task, and no line moves while that table is small enough to be sent to the tasks. A last line that
    doesn't end in a newline is unfinished and left for later. A line that isn't UTF-8 is null and has its fingerprint
    all the same.
    """
    raw = _raw(spark, folder)
    placed = raw.join(_splits(raw), ["path", "_block"]).withColumn("ordinal", F.col("_id") + F.col("_add")).where("ordinal <= _lines")
    sound = F.when(F.is_valid_utf8("value"), F.col("value"))
    return placed.select("path", "ordinal", sound.alias("line"), hmac_sha256(F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n"))), key).alias("fingerprint"))


def byte_ends(spark: SparkSession, folder: str) -> DataFrame:
    """path, ordinal, end_byte: where each finished line ends in its file, its newline included; a split is the most that
    one task adds up."""
    raw = _raw(spark, folder).withColumn("_long", F.octet_length("value").cast("long") + 1)
    within = Window.partitionBy("path", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = raw.select("path", "_block", "_id", F.sum("_long").over(within).alias("_upto"))
    placed = summed.join(_splits(raw), ["path", "_block"]).withColumn("ordinal", F.col("_id") + F.col("_add")).where("ordinal <= _lines")
    return placed.select("path", "ordinal", (F.col("_before") + F.col("_upto")).alias("end_byte"))


def block_digests(rows: DataFrame) -> DataFrame:
    """path, block, lines, digest: a digest of the fingerprints of every BLOCK_LINES lines. rows: path, ordinal, fingerprint."""
    block = F.expr(f"(ordinal - 1) div {BLOCK_LINES}")
    own = F.array_sort(F.collect_list(F.struct("ordinal", "fingerprint")))
    return rows.groupBy("path", block.alias("block")).agg(F.count(F.lit(1)).alias("lines"), F.sha2(F.array_join(F.transform(own, lambda x: x["fingerprint"]), ""), 256).alias("digest"))


def file_digests(blocks: DataFrame) -> DataFrame:
    """path, lines, digest: digests of digests, level by level, until each file has one."""
    while (blocks.agg(F.max("block")).first()[0] or 0) > 0:
        own = F.array_sort(F.collect_list(F.struct("block", "digest")))
        blocks = blocks.groupBy("path", F.expr(f"block div {BLOCK_LINES}").alias("block")).agg(F.sum("lines").alias("lines"), F.sha2(F.array_join(F.transform(own, lambda x: x["digest"]), ""), 256).alias("digest"))
    return blocks.select("path", "lines", "digest")


def relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_lines, new_lines, relation: how the lines of files (path, ordinal, fingerprint) relate to those known
    before: exact, append, truncate or rewrite; new and gone where one side has none.

    Digests of blocks are compared; lines only where the blocks hold different numbers of lines, once per file.
    """
    a, b = (block_digests(x).select("path", "block", F.col("lines").alias(f"{n}_n"), F.col("digest").alias(f"{n}_d")) for n, x in (("old", old), ("new", new)))
    met = a.join(b, ["path", "block"], "full_outer")
    uneven = met.where("old_n <> new_n").select("path", "block")
    block = F.expr(f"(ordinal - 1) div {BLOCK_LINES}").alias("block")
    in_block = [x.select("path", "ordinal", block, F.col("fingerprint").alias(n)).join(uneven, ["path", "block"]) for n, x in (("_o", old), ("_w", new))]
    torn = in_block[0].join(in_block[1], ["path", "block", "ordinal"]).groupBy("path").agg(F.bool_or(F.col("_o") != F.col("_w")).alias("_torn"))
    sums = met.groupBy("path").agg(
        F.coalesce(F.sum("old_n"), F.lit(0)).alias("old_lines"), F.coalesce(F.sum("new_n"), F.lit(0)).alias("new_lines"),
        F.coalesce(F.bool_or((F.col("old_n") == F.col("new_n")) & (F.col("old_d") != F.col("new_d"))), F.lit(False)).alias("_other"))
    changed = F.col("_other") | F.coalesce("_torn", F.lit(False))
    kind = F.when(F.col("old_lines") == 0, "new").when(F.col("new_lines") == 0, "gone").when(changed, "rewrite").when(F.col("old_lines") == F.col("new_lines"), "exact")
    return sums.join(torn, "path", "left").select("path", "old_lines", "new_lines", kind.when(F.col("new_lines") > F.col("old_lines"), "append").otherwise("truncate").alias("relation"))


def parse(rows: DataFrame) -> DataFrame:
    """Adds the envelope's fields, `route` (type/payload type, ignored, or a kind of diagnostic) and the `quality` of
    its timestamp. A null line is one that could not be decoded."""
    env = F.from_json("line", ENVELOPE)
    kind, payload = F.col("_e.type"), F.col("_e.payload")
    inner = F.get_json_object(payload, "$.type")
    sound = F.ltrim("line").startswith("{") & F.ltrim(payload).startswith("{")
    route = F.when(F.col("line").isNull(), "invalid_encoding").when(~F.coalesce(sound, F.lit(False)), "malformed")
    for table, to in ((READ, None), (IGNORED, "ignored")):
        for name, types in table.items():
            test = kind == name if types is None else (kind == name) & inner.isin(*types)
            route = route.when(test, F.lit(to) if to else F.lit(name) if types is None else F.concat_ws("/", kind, inner))
    for name, to in UNKNOWN_KIND.items():
        route = route.when(kind == name, to)
    parsed = rows.withColumn("_e", env).withColumn("route", route.otherwise("unknown_envelope"))
    stamp = F.col("_e.timestamp")
    return parsed.select(
        *rows.columns, "route", F.when(~F.col("route").isin("malformed", "invalid_encoding"), instants.quality(stamp)).alias("quality"), instants.epoch_ns(stamp).alias("observed_ns"),
        instants.canonical(instants.epoch_ns(stamp)).alias("observed_at"), payload.alias("payload"))


def _count(c: Column) -> Column:
    return F.when(c >= 0, c)


def usage(payload: Column) -> dict[str, Column]:
    """The counters of a token line: whole numbers from zero, all null if more was cached than went in."""
    total = F.from_json(payload, USAGE)["info"]["total_token_usage"]
    names = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens", "cache_write": "cache_write_input_tokens"}
    values = {name: _count(total[field]) for name, field in names.items()}
    valid = total.isNotNull() & ~F.coalesce(values["cached"] > values["input"], F.lit(False))
    found = {name: F.when(valid, v) for name, v in values.items()}
    complete = valid
    for name in ("input", "cached", "output", "reasoning"):
        complete = complete & found[name].isNotNull()
    return found | {"complete": F.coalesce(complete, F.lit(False))}


def session_headers(parsed: DataFrame) -> DataFrame:
    """Per file the meta line that names its session: the longest id that the file name ends in, else the first."""
    meta = parsed.where("route = 'session_meta'").select(
        "path", "ordinal", F.get_json_object("payload", "$.id").alias("id"), F.get_json_object("payload", "$.timestamp").alias("started"),
        F.get_json_object("payload", "$.parent_thread_id").alias("parent"), F.get_json_object("payload", "$.cwd").alias("cwd")).where("id <> ''")
    named = F.col("path").endswith(F.concat(F.lit("-"), F.col("id"), F.lit(".jsonl"))) | F.col("path").endswith(F.concat(F.lit("/"), F.col("id"), F.lit(".jsonl")))
    place = F.struct(named.cast("int"), F.when(named, F.char_length("id")).otherwise(0), -F.col("ordinal"))
    return meta.groupBy("path").agg(F.max_by(F.struct("id", "started", "parent", "cwd", "ordinal"), place).alias("m")).select(
        "path", F.col("m.id").alias("session_id"), F.col("m.started").alias("started"), F.col("m.parent").alias("parent_id"), F.col("m.cwd").alias("cwd"))


def token_snapshots(parsed: DataFrame, headers: DataFrame, key: bytes) -> DataFrame:
    rows = parsed.where("route = 'event_msg/token_count'")
    return rows.select("path", "ordinal", "observed_ns", "fingerprint", *[c.alias(n) for n, c in usage(F.col("payload")).items()]).join(headers, "path").withColumn(
        "event_key", pseudonym("event", F.concat_ws("/", "session_id", "ordinal", "fingerprint"), key))


def relation(old: Column, new: Column) -> Column:
    """As relations, of two lists of fingerprints that are short enough to lie in a row."""
    shared = F.least(F.size(old), F.size(new)).cast("int")
    same = (shared == 0) | (F.slice(old, 1, F.greatest(shared, F.lit(1))) == F.slice(new, 1, F.greatest(shared, F.lit(1))))
    return F.when(~same, "rewrite").when(F.size(old) == F.size(new), "exact").when(F.size(new) > F.size(old), "append").otherwise("truncate")


def filled_forward(parsed: DataFrame) -> DataFrame:
    """Adds the session and turn that hold at each line of its file: within chunks of CHUNK_LINES lines, with what the
    chunks before have told last; a chunk is the most of a file that meets in one task."""
    session = F.when(F.col("route") == "session_meta", F.get_json_object("payload", "$.id"))
    turn = F.when(F.col("route") == "turn_context", F.get_json_object("payload", "$.turn_id"))
    rows = parsed.withColumns({"at_session": session, "at_turn": turn, "_chunk": F.expr(f"(ordinal - 1) div {CHUNK_LINES}")})
    told = rows.where("at_session IS NOT NULL OR at_turn IS NOT NULL").groupBy("path", "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(f"_{c}") for c in ("at_session", "at_turn")])
    every = rows.select("path", "_chunk").distinct().join(told, ["path", "_chunk"], "left")
    before = Window.partitionBy("path").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("path", "_chunk", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in ("at_session", "at_turn")])
    within = Window.partitionBy("path", "_chunk").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(carried, ["path", "_chunk"])
    return met.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_{c}")) for c in ("at_session", "at_turn")}).select(*parsed.columns, "at_session", "at_turn")
