"""Event exports: app-server notifications and OpenTelemetry logs, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import instants
from ..functions.canonical import repeated_keys
from ..functions.keys import hmac_sha256, pseudonym
from ..functions.shapes import bound

# Notification method -> kind of event.
METHODS = {
    "thread/started": "session_started", "turn/started": "turn_started", "turn/completed": "turn_completed", "item/started": "item_started",
    "item/completed": "item_completed", "thread/tokenUsage/updated": "tokens", "thread/archived": "session_archived", "thread/unarchived": "session_unarchived",
}
# Methods that have to name a turn, and an item.
OF_TURNS = ("turn/started", "turn/completed", "item/started", "item/completed")
OF_ITEMS = ("item/started", "item/completed")
_TOKENS = "inputTokens: BIGINT, cachedInputTokens: BIGINT, outputTokens: BIGINT, reasoningOutputTokens: BIGINT, totalTokens: BIGINT"
_PARAMS = f"""threadId STRING, turnId STRING, startedAtMs BIGINT, completedAtMs BIGINT, thread STRUCT<id: STRING, createdAt: BIGINT>,
 turn STRUCT<id: STRING, status: STRING, startedAt: BIGINT, completedAt: BIGINT, durationMs: BIGINT>,
 item STRUCT<id: STRING, type: STRING, status: STRING, command: STRING, exitCode: BIGINT, durationMs: BIGINT, aggregatedOutput: STRING>,
 tokenUsage STRUCT<total: STRUCT<{_TOKENS}>, last: STRUCT<{_TOKENS}>>"""
_OTEL = "timeUnixNano STRING, body STRUCT<stringValue: STRING>, attributes ARRAY<STRUCT<key: STRING, value: STRUCT<stringValue: STRING, intValue: STRING, boolValue: BOOLEAN, doubleValue: DOUBLE>>>"


def fingerprint(content: Column, key: bytes) -> Column:
    """What may be kept of content: its keyed digest and sizes."""
    return F.when(content.isNotNull(), F.struct(hmac_sha256(F.concat(F.lit("content/"), content), key).alias("digest"), F.char_length(content).cast("long").alias("characters"), F.octet_length(content).cast("long").alias("utf8_bytes")))


def _count(c: Column) -> Column:
    return F.when(c >= 0, c)


def told_twice(message: Column, outer: str, nested: str) -> Column:
    """An identity that a message (a variant) may tell in two places, as `outer` and as the id of the object `nested`: the
    name, and whether what is told is sound: non-empty strings that agree. An object without an id isn't."""
    kind = lambda v: F.schema_of_variant(v)
    at = lambda path: F.try_variant_get(message, path, "variant")
    name = lambda v: bound(v, lambda x: F.when(kind(x) == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))))

    def judged(x: Column) -> Column:
        flat, whole, outside, inside = x["flat"], x["whole"], x["outside"], x["inside"]
        sound = (flat.isNull() | outside.isNotNull()) & (whole.isNull() | (kind(whole).startswith("OBJECT") & inside.isNotNull())) & (flat.isNull() | whole.isNull() | outside.eqNullSafe(inside))
        return F.struct(F.coalesce(outside, inside).alias("name"), F.coalesce(sound, F.lit(False)).alias("sound"))

    places = F.struct(at(f"$.{outer}").alias("flat"), at(f"$.{nested}").alias("whole"), name(at(f"$.{outer}")).alias("outside"), name(at(f"$.{nested}.id")).alias("inside"))
    return bound(places, judged)


def app_server(rows: DataFrame, key: bytes) -> DataFrame:
    """Events of the lines ({received_at, message} or the bare message): kind, session, turn, item, instant, tokens,
    outcome; `issue` tells why a line gives none: invalid_encoding (a null line), malformed_json, repeated_key,
    unknown_method, missing_session, incoherent_identity (a session or turn told twice, differently, or no string),
    missing_turn, missing_item or invalid_tokens. rows: line and whatever identifies it."""
    wrapped = F.from_json("line", "received_at STRING, message STRING, method STRING, params STRING")
    r = rows.withColumn("_w", wrapped)
    bare = F.col("_w.message").isNull()
    method = F.when(bare, F.col("_w.method")).otherwise(F.get_json_object("_w.message", "$.method"))
    params = F.when(bare, F.col("_w.params")).otherwise(F.get_json_object("_w.message", "$.params"))
    r = r.withColumns({"_method": method, "_params": params})
    params = F.col("_params")
    r = r.withColumn("_p", F.from_json(params, _PARAMS))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair]), F.col("_method"))
    # each in a step of its own: what several columns name is worked out once per row
    r = r.withColumn("_v", F.try_parse_json(params)).withColumns({"_session": told_twice(F.col("_v"), "threadId", "thread"), "_turn": told_twice(F.col("_v"), "turnId", "turn"), "_twice": repeated_keys(F.col("line")), "_kind": kind}).drop("_v")
    session, turn, kind = F.col("_session.name"), F.col("_turn.name"), F.col("_kind")
    at = F.coalesce(
        instants.from_units(F.coalesce("_p.completedAtMs", "_p.startedAtMs"), "ms"), instants.from_units(F.coalesce("_p.turn.completedAt", "_p.turn.startedAt", "_p.thread.createdAt"), "s"), instants.epoch_ns(F.col("_w.received_at")))
    usage = F.col("_p.tokenUsage.total")
    tokens = {"input": usage["inputTokens"], "cached": usage["cachedInputTokens"], "output": usage["outputTokens"], "reasoning": usage["reasoningOutputTokens"]}
    sound = F.coalesce(F.ltrim("line").startswith("{"), F.lit(False))
    issue = F.when(F.col("line").isNull(), "invalid_encoding").when(~sound | F.coalesce("_w.message", "_w.method").isNull(), "malformed_json").when(F.col("_twice").isNull(), "malformed_json").when(F.col("_twice"), "repeated_key").when(
        kind.isNull(), "unknown_method").when(~F.col("_session.sound") | ~F.col("_turn.sound"), "incoherent_identity").when(session.isNull(), "missing_session").when(
        F.col("_method").isin(*OF_TURNS) & turn.isNull(), "missing_turn").when(F.col("_method").isin(*OF_ITEMS) & (F.coalesce("_p.item.id", F.lit("")) == ""), "missing_item").when(
        F.coalesce(tokens["cached"] > tokens["input"], F.lit(False)), "invalid_tokens")
    r, issue = r.withColumn("_issue", issue), F.col("_issue")
    return r.select(
        *rows.columns, issue.alias("issue"), F.when(issue.isNull(), kind).alias("kind"), F.when(issue.isNull(), pseudonym("session", session, key)).alias("session_key"),
        pseudonym("turn", F.when(issue.isNull(), turn), key).alias("turn_key"), pseudonym("call", F.col("_p.item.id"), key).alias("call_key"), F.when(issue.isNull(), at).alias("observed_ns"),
        F.coalesce("_p.turn.status", "_p.item.status").alias("status"), F.col("_p.item.type").alias("item_type"), _count(F.col("_p.item.exitCode")).alias("exit_code"),
        _count(F.coalesce("_p.turn.durationMs", "_p.item.durationMs")).alias("duration_ms"), fingerprint(F.col("_p.item.aggregatedOutput"), key).alias("output"), *[_count(c).alias(n) for n, c in tokens.items()])


def otel(rows: DataFrame, key: bytes) -> DataFrame:
    """Events of log lines: name, session, instant, per-call tokens. A record with a repeated attribute, or with a value
    that is not exactly one scalar, is an issue."""
    r = rows.withColumn("_o", F.from_json("line", _OTEL))
    attributes = F.col("_o.attributes")
    scalars = lambda a: sum((a["value"][f].isNotNull().cast("int") for f in ("stringValue", "intValue", "boolValue", "doubleValue")), F.lit(0))
    text = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"].cast("string"), a["value"]["doubleValue"].cast("string"))
    names = F.transform(attributes, lambda a: a["key"])
    broken = F.size(F.array_distinct(names)) != F.size(names)
    odd = F.exists(attributes, lambda a: scalars(a) != 1)
    entries = F.when(~broken & ~odd, F.map_from_entries(F.transform(attributes, lambda a: F.struct(a["key"], text(a)))))
    r = r.withColumns({"_m": entries, "_issue": F.when(F.col("line").isNull(), "invalid_encoding").when(F.col("_o.body.stringValue").isNull() | repeated_keys(F.col("line")).isNull(), "malformed_json").when(repeated_keys(F.col("line")), "repeated_key").when(broken, "duplicate_attribute").when(odd, "invalid_attribute")})
    value = lambda *keys: F.coalesce(*[F.try_element_at("_m", F.lit(k)) for k in keys])
    number = lambda *keys: _count(F.when(value(*keys).rlike(r"\A\d{1,18}\z"), value(*keys).try_cast("long")))
    session = value("conversation.id", "thread.id", "session.id")
    return r.select(
        *rows.columns, F.coalesce(F.col("_issue"), F.when(session.isNull(), "missing_session")).alias("issue"), F.col("_o.body.stringValue").alias("name"), pseudonym("session", session, key).alias("session_key"),
        F.when(F.col("_o.timeUnixNano").rlike(r"\A\d{1,19}\z"), F.col("_o.timeUnixNano").try_cast("long")).alias("observed_ns"),
        number("input_tokens", "input.token.count", "input_token_count").alias("input"), number("cached_input_tokens", "cached.token.count", "cached_token_count").alias("cached"),
        number("output_tokens", "output.token.count", "output_token_count").alias("output"), number("reasoning_tokens", "reasoning.token.count", "reasoning_token_count").alias("reasoning"))
