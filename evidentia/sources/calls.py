"""Calls out of session lines: spans of tools, test runs and files. Commands and outputs stay in the lines; what comes out
are keyed digests, classes, states and relative paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import commands, text
from ..functions.keys import pseudonym
from ..operators import calls, resolution

PLACE = ["path", "ordinal"]
# Lines that end a call -> the tool's name and category.
ENDS = {
    "response_item/function_call_output": ("function", "tool"), "response_item/custom_tool_call_output": ("custom_exec", "opaque_exec"), "event_msg/mcp_tool_call_end": ("mcp", "tool"),
    "event_msg/patch_apply_end": ("patch", "tool"), "event_msg/web_search_end": ("web", "web"),
}
STARTS = {"response_item/function_call": None, "response_item/custom_tool_call": ("custom_exec", "opaque_exec")}


def _get(path: str) -> Column:
    return F.get_json_object("payload", path)


def call_lines(rows: DataFrame) -> DataFrame:
    """The lines that start or end a call, with its id, arguments and result. rows: path, ordinal, session_id, at_turn,
    observed_ns, cwd, route, payload."""
    own = rows.where(F.col("route").isin(*STARTS, *ENDS)).withColumn("call_id", _get("$.call_id")).where("call_id IS NOT NULL")
    arguments = _get("$.arguments")
    result = {f"r_{k}": F.when(F.col("route") == "response_item/function_call_output", v) for k, v in text.structured_result(_get("$.output")).items()}
    return own.select(
        "path", "ordinal", "session_id", F.col("at_turn").alias("turn_id"), "observed_ns", "cwd", "route", "payload", "call_id", resolution.tool_family(F.coalesce(_get("$.name"), F.lit(""))).alias("family"),
        *[F.get_json_object(arguments, f"$.{c}").alias(f"a_{c}") for c in ("cmd", "patch", "path", "workdir")], *[v.alias(k) for k, v in result.items()])


def spans(lines: DataFrame, key: bytes) -> DataFrame:
    """session_id, call_key, tool, category, started_ns, finished_ns, state, latency_ms, turn_id, reversed."""
    route = F.col("route")
    tool, category = F.col("family"), F.when(F.col("family") == "web", "web").otherwise("tool")
    for name, (t, c) in (ENDS | {k: v for k, v in STARTS.items() if v}).items():
        tool, category = F.when(route == name, t).otherwise(tool), F.when(route == name, c).otherwise(category)
    wrapper = text.wrapper_outcome(_get("$.output"))
    by_exit = F.when(F.col("r_exit_status") == 0, "success").when(F.col("r_exit_status").isNotNull(), "failed").otherwise("unknown")
    state = F.when(route == "response_item/function_call_output", by_exit).when(route == "response_item/custom_tool_call_output", wrapper["outcome"]).otherwise(text.tool_end_state(_get("$.result"), _get("$.success")))
    latency = F.when(route == "response_item/custom_tool_call_output", wrapper["latency_ms"]).when(route.startswith("event_msg/"), text.duration_ms(_get("$.duration.secs"), _get("$.duration.nanos")))
    told = lines.select(
        "session_id", pseudonym("call", F.col("call_id"), key).alias("call_key"), *PLACE, F.when(route.isin(*STARTS), "start").otherwise("end").alias("kind"), tool.alias("tool"), category.alias("category"),
        F.col("observed_ns").alias("at_ns"), state.alias("state"), latency.alias("latency_ms"), "turn_id")
    return calls.spans(told, ["session_id", "call_key"], PLACE)


def tests(lines: DataFrame, authority: int, key: bytes) -> DataFrame:
    """The commands of calls with their results, as calls.canonical_runs takes them."""
    intent = (F.col("route") == "response_item/function_call") & (F.col("family") == "exec_command") & F.col("a_cmd").isNotNull()
    result = F.col("route") == "response_item/function_call_output"
    told = F.struct("a_cmd", "observed_ns", "turn_id")
    results = F.struct(*[F.col(f"r_{c}").alias(c) for c in ("exit_status", "outcome", "cause", "completeness")], "observed_ns", "turn_id")
    events = lines.where(intent | result).select("session_id", "call_id", *PLACE, F.when(intent, "intent").otherwise("result").alias("kind"), F.when(intent, told).alias("intent"), F.when(result, results).alias("result"))
    # a file's own order counts; what one call id means in another file is another source's word
    found = calls.executions(events, ["session_id", "call_id", "path"], ["ordinal"]).withColumn("command", F.col("intent.a_cmd"))
    return commands.test_command(found, "command").select(
        "session_id", pseudonym("call", F.col("call_id"), key).alias("call_key"), F.lit(authority).cast("long").alias("authority"), pseudonym("source", F.col("path"), key).alias("source"),
        F.col("ordinal").alias("line"), pseudonym("command", F.col("command"), key).alias("command_hash"), (F.col("runner") != "unknown").alias("is_test"), "runner", "scope",
        F.coalesce("result.completeness", F.lit(calls.INTENT_ONLY)).alias("completeness"), "result.exit_status", F.coalesce("result.outcome", F.lit("unknown")).alias("outcome"),
        F.coalesce("result.cause", F.lit("unknown")).alias("cause"), F.coalesce("result.observed_ns", "intent.observed_ns").alias("observed_ns"), F.coalesce("result.turn_id", "intent.turn_id").alias("turn_id"))


def _inside(path: Column) -> Column:
    """A path relative to the session's folder; null for any other."""
    root = F.concat(F.rtrim(F.col("cwd"), F.lit("/")), F.lit("/"))
    own = F.when(path.startswith(root), F.substr(path, F.length(root) + 1)).otherwise(path)
    return text.relative_path(own)


def files(lines: DataFrame, key: bytes) -> DataFrame:
    """session_id, call_key, operation, path, tool, observed_ns, turn_id, source, line: files that calls read or wrote, each
    once per call. What a command or a patch names counts when it has succeeded; then the end tells the instant."""
    access = "array<struct<op:string,path:string>>"
    call = F.col("route") == "response_item/function_call"
    one = lambda op, at: F.array(F.struct(F.lit(op).alias("op"), _inside(at).alias("path")))
    patched = F.transform(resolution.patched_files(F.col("a_patch")), lambda p: F.struct(F.lit("write").alias("op"), _inside(p).alias("path")))
    # a command run in another folder has paths that aren't known
    shell = F.when(F.col("a_workdir").isNull() | (F.col("a_workdir") == F.col("cwd")), commands.shell_files(F.col("a_cmd")))
    ended = F.col("route") == "event_msg/patch_apply_end"
    changes = F.transform(F.json_object_keys(_get("$.changes")), lambda p: F.struct(F.lit("write").alias("op"), _inside(p).alias("path")))
    done = text.tool_end_state(_get("$.result"), _get("$.success")) == "success"
    found = F.when(call & (F.col("family") == "exec_command"), shell).when(call & (F.col("family") == "apply_patch"), patched).when(
        call & F.col("family").isin("view_image", "file_read"), one("read", F.col("a_path"))).when(call & (F.col("family") == "file_write"), one("write", F.col("a_path"))).when(ended & done, changes)
    needs = F.when(call & (F.col("family") == "exec_command"), "response_item/function_call_output").when(call & (F.col("family") == "apply_patch"), "event_msg/patch_apply_end").when(
        call & (F.col("family") == "file_write"), "response_item/function_call_output")
    told = lines.select("session_id", "call_id", *PLACE, "turn_id", "observed_ns", F.when(ended, "apply_patch").otherwise(F.col("family")).alias("tool"), needs.alias("needs"), F.explode(found.cast(access)).alias("a")).where("a.path IS NOT NULL")
    good = F.when(ended, done).otherwise(F.col("r_exit_status") == 0)
    ends = lines.where(F.col("route").isin(*ENDS) & good).groupBy("session_id", "call_id", F.col("route").alias("needs")).agg(F.max(F.struct(*PLACE, "observed_ns", "turn_id")).alias("_end"))
    at_once = told.where("needs IS NULL").withColumn("_end", F.struct(*PLACE, "observed_ns", "turn_id"))
    proved = told.where("needs IS NOT NULL").join(ends, ["session_id", "call_id", "needs"]).select(*at_once.columns)
    rows = at_once.unionByName(proved).groupBy("session_id", "call_id", F.col("a.op").alias("operation"), F.col("a.path").alias("file")).agg(F.min(F.struct("_end", "tool")).alias("_m"))
    return rows.select(
        "session_id", pseudonym("call", F.col("call_id"), key).alias("call_key"), "operation", F.col("file").alias("path"), "_m.tool", "_m._end.observed_ns", "_m._end.turn_id",
        pseudonym("source", F.col("_m._end.path"), key).alias("source"), F.col("_m._end.ordinal").alias("line"))
