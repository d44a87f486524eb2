"""Private or unsafe text: redaction, closed vocabularies, relative paths, outcomes of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import pseudonym
from .shapes import bound

# What makes a note sensitive, as patterns (case is ignored).
SENSITIVE = (
    r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    r"\bauthorization\s*:\s*(?:bearer|basic)\s+\S+",
    r"\bbearer\s+[A-Za-z0-9._~+/=-]+",
    r"\b(?:authorization|cookie|credential|passwd|password|secret|token|api[-_ ]?key|x[-_ ]?auth[-_ ]?token|access[-_ ]?key)\b\s*(?::|=)?\s*\S+",
    r"\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^@\s]+@\S+",
    r"(?<![\w+])(?:\+?\d[\s().-]*){10,15}(?!\w)",
    r"(?<!\w)/(?:Users|home|private|var|etc|tmp|opt|Volumes)(?:/\S*)?",
    r"(?<![\w-])[A-Za-z0-9+/=_-]{20,}(?![\w-])",
)
# The segments that a task family may consist of; names of products are passed to family() as more.
FAMILY_SEGMENTS = (
    "accounting", "analysis", "annotation", "answer", "architecture", "audit", "auth", "block", "browser", "cleanup", "cli", "closeout",
    "core", "docs", "essay", "feature", "fix", "foundation", "hardening", "hooks", "integration", "legacy", "lesson", "local",
    "migration", "monitoring", "multi", "multiple", "quiz", "refactor", "release", "report", "review", "runtime", "service", "services",
    "telemetry", "test", "tests", "tooling", "ui", "unclassified", "workflow",
)
# Words in an output that point to the environment.
INFRASTRUCTURE = ("sandbox", "network", "econn", "timed out", "permission denied")
# The same for results that come as objects.
STRUCTURED_INFRASTRUCTURE = (*INFRASTRUCTURE, "timeout", "connection refused", "could not resolve", "no space left", "resource temporarily unavailable")
# Options that read JSON as try_parse_json does, which has none and drops what holds a text of over 20 million characters.
LONG_TEXTS = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def matches_sensitive(text: Column) -> list[Column]:
    return [text.rlike(f"(?iU){p}") for p in SENSITIVE]


# Characters that count as blanks.
BLANKS = r"[\x00-\x20\x7F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def redacted(note: Column) -> Column:
    clean = normalised(note)
    return F.when((clean == "") | reduce(lambda a, b: a | b, matches_sensitive(clean)), "[redacted]").otherwise(clean)


def family(value: Column, more: tuple[str, ...] = ()) -> Column:
    """The value if it is a short code of public segments, else null."""
    shape = value.rlike(r"\A[a-z][a-z0-9]*(?:[._-][a-z0-9]+){0,7}\z") & (F.char_length(value) <= 80)
    known = F.forall(F.split(value, "[._-]"), lambda s: s.isin(*FAMILY_SEGMENTS, *more))
    return F.when(shape & known, value)


def relative_path(path: Column) -> Column:
    """A path inside the project, cleaned of leading ./; null for absolute, home, drive, URL, parent or control parts."""
    plain = F.regexp_replace(path, r"\A(?:\./)+", "")
    unsafe = path.rlike(r"\A[/~\\]|\A[A-Za-z]:|://|[\x00-\x1F\x7F]|\\") | F.exists(F.split(path, "/"), lambda s: s == "..")
    return F.when(~unsafe & (plain != "") & (plain != "."), plain)


def path_key(path: Column, project_root: str, key: bytes) -> Column:
    """Relative to the project root, or external/ and a keyed digest."""
    root = project_root.rstrip("/") + "/"
    below = F.substr(path, F.lit(len(root) + 1))
    inside = path.startswith(root) & relative_path(below).isNotNull()
    return F.when(inside, below).otherwise(F.concat(F.lit("external/"), F.substring(pseudonym("path", path, key), 1, 20)))


def points_to_infrastructure(text: Column, markers: tuple[str, ...] = INFRASTRUCTURE) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(m) for m in markers])


def structured_outcome(exit_code: Column, diagnostic: Column) -> dict[str, Column]:
    """outcome and cause of a run with a known exit code; unknown without one."""
    infra = points_to_infrastructure(F.substring(diagnostic, 1, 4096))
    return {
        "outcome": F.when(exit_code.isNull(), "unknown").when(exit_code == 0, "success").otherwise("failed"),
        "cause": F.when(exit_code.isNull(), "unknown").when(exit_code == 0, "none").when(infra, "infra_failure").otherwise("product_failure"),
    }


def structured_result(output: Column) -> dict[str, Column]:
    """exit_status, outcome, cause and completeness of a call's output (JSON text): an object whose exit_code is a whole
    number, or a list that holds exactly one object with an exit_code, plain or as the text of an input_text. Several
    such objects in a list are a conflict; anything else has no exit status. Texts tell the cause by their whole length."""
    parsed = lambda t: F.from_json(t, "variant", LONG_TEXTS)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    field = lambda v, name, of: F.try_variant_get(v, f"$.{name}", of)

    def unwrapped(item: Column) -> Column:
        own = F.when(field(item, "type", "string") == "input_text", parsed(field(item, "text", "string"))).otherwise(item)
        return bound(own, lambda v: F.when(kind(v) == "STRING", parsed(F.try_variant_get(v, "$", "string"))).otherwise(v))

    def told(one: Column, several: Column) -> Column:
        code = lambda c: F.when(kind(c).isin("BIGINT", "DECIMAL"), F.try_variant_get(c, "$", "long"))
        said = [bound(field(one, c, "variant"), lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))) for c in ("stdout", "stderr", "message", "output")]
        outcome = lambda status: F.when(status.isNull(), "unknown").when(status == 0, "success").otherwise("failed")
        infra = bound(F.lower(F.concat_ws(" ", *said)), lambda t: points_to_infrastructure(t, STRUCTURED_INFRASTRUCTURE))
        return bound(bound(field(one, "exit_code", "variant"), code), lambda status: F.struct(
            status.alias("exit_status"), outcome(status).alias("outcome"),
            F.when(status.isNull(), "unknown").when(status == 0, "none").when(infra, "infra_failure").otherwise("product_failure").alias("cause"),
            F.when(several, "conflicted").when(status.isNull(), "result_without_exit").otherwise("complete").alias("completeness")))

    def of_list(whole: Column) -> Column:
        with_code = lambda v: kind(v).startswith("OBJECT") & field(v, "exit_code", "variant").isNotNull()
        listed = F.filter(F.transform(F.try_variant_get(whole, "$", "array<variant>"), unwrapped), with_code)
        return bound(listed, lambda x: F.struct(F.when(F.size(x) == 1, F.get(x, F.lit(0))).alias("one"), (F.size(x) > 1).alias("several")))

    def of(whole: Column) -> Column:
        alone = lambda k: F.struct(F.when(k.startswith("OBJECT"), whole).alias("one"), F.lit(False).alias("several"))
        return bound(bound(kind(whole), lambda k: F.when(k.startswith("ARRAY"), of_list(whole)).otherwise(alone(k))), lambda x: told(x["one"], x["several"]))

    result = bound(parsed(output), of)
    return {c: result[c] for c in ("exit_status", "outcome", "cause", "completeness")}


def tool_end_state(result: Column, success: Column) -> Column:
    """How a tool ended, from the texts of its result (JSON or Ok) and its success flag."""
    fine = (result == "Ok") | F.get_json_object(result, "$.Ok").isNotNull() | (success == "true")
    return F.when(F.coalesce(fine, F.lit(False)), "success").when(result.isNotNull() | (success == "false"), "failed").otherwise("unknown")


def duration_ms(secs: Column, nanos: Column) -> Column:
    """Milliseconds of a duration of seconds and nanoseconds; null without either."""
    part = lambda c: F.coalesce(F.when(c.try_cast("long") >= 0, c.try_cast("long")), F.lit(0))
    return F.when(secs.isNotNull() | nanos.isNotNull(), part(secs) * 1000 + F.floor(part(nanos) / 1_000_000))


def wrapper_outcome(text: Column) -> dict[str, Column]:
    """outcome and latency_ms that the text of a tool wrapper tells."""
    lowered = F.lower(text)
    timing = r"(?:wall time|elapsed)\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(milliseconds|ms|seconds|s)"
    number = F.regexp_extract(lowered, timing, 1)
    factor = F.when(F.regexp_extract(lowered, timing, 2).startswith("m"), 1).otherwise(1000)
    failed = lowered.rlike(r"\b(?:failed|error)\b|exit code\s*[1-9]")
    return {
        "outcome": F.when(lowered.contains("script completed"), "success").when(failed, "failed").otherwise("unknown"),
        "latency_ms": F.when(number != "", F.round(number.cast("double") * factor).cast("long")),
    }


# States as they are told, and what they mean for a turn.
STATES = ("in_progress", "completed", "failed", "interrupted", "cancelled", "declined", "success")
BROKEN_OFF = ("interrupted", "cancelled")
STARTS = ("turn_started", "conversation_started", "user_prompt")


def status(value: Column) -> Column:
    """A known state, or unknown."""
    plain = F.replace(value, F.lit("inProgress"), F.lit("in_progress"))
    return F.when(plain.isin(*STATES), plain).otherwise("unknown")


def lifecycle(kind: Column, state: Column) -> Column:
    """What an event does to its turn: started, completed or aborted; null for any other event."""
    return F.when(kind.isin(*STARTS), "started").when(kind == "turn_completed", F.when(state.isin(*BROKEN_OFF), "aborted").otherwise("completed"))
