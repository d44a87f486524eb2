"""Queries over text: pseudonyms, references, redaction, paths, instants, envelopes and commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commands, instants, keys, text
from ..sources import rollout
from .adapters import observations, table

QUERIES, ORACLES = {}, {}
KEY = b"0123456789abcdef-test-key"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _hmac_sql(message: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || ({message})::BLOB)))"


@query(f"SELECT event_id, {_hmac_sql('''concat('user/', user_id)''')} AS user_key, {_hmac_sql('''concat('event/', event_id)''')} AS event_key FROM events")
def pseudonymize(spark, sf_dir):
    return observations(spark, sf_dir).select("event_id", keys.pseudonym("user", F.col("user_id"), KEY).alias("user_key"), keys.pseudonym("event", F.col("event_id"), KEY).alias("event_key"))


@query(f"""WITH d AS (SELECT c_custkey::VARCHAR AS id, {_hmac_sql('c_custkey::VARCHAR')} AS h FROM customer),
s AS (SELECT id, h, n, count(*) OVER (PARTITION BY substr(h, 1, n)) AS c FROM d, (SELECT unnest(range(1, 65)) AS n))
SELECT id, 'task_' || substr(any_value(h), 1, min(n)::INT) AS ref FROM s WHERE c = 1 GROUP BY id""")
def public_refs(spark, sf_dir):
    return keys.public_references(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")), "id", KEY, "task_", least=1)


def _sensitive_sql() -> dict[str, str]:
    """The eight patterns for an engine without looking around: what may not stand beside a match is matched instead."""
    w, blank = r"\p{L}\p{M}\p{N}_", r"\s\p{Z}\x85"
    start, end, some = rf"(?:^|[^{w}])", rf"(?:$|[^{w}])", rf"[^{blank}]+"
    names = "authorization|cookie|credential|passwd|password|secret|token|api[-_ ]?key|x[-_ ]?auth[-_ ]?token|access[-_ ]?key"
    return {
        "email": rf"[{w}][{w}.+-]*@[{w}.-]+\.[A-Za-z]{{2,}}{end}",
        "authorization": rf"{start}authorization[{blank}]*:[{blank}]*(?:bearer|basic)[{blank}]+{some}",
        "bearer": rf"{start}bearer[{blank}]+[A-Za-z0-9._~+/=-]+",
        "secret": rf"{start}(?:{names})(?:[{blank}]*(?::|=)[{blank}]*{some}|[{blank}]+{some}|[^{blank}{w}])",
        "url": rf"{start}[a-z][a-z0-9+.-]*://[^/{blank}:@]+:[^@{blank}]+@{some}",
        "phone": rf"(?:^|[^{w}+])(?:\+?\p{{Nd}}[{blank}().-]*){{10,15}}{end}",
        "path": rf"{start}/(?:Users|home|private|var|etc|tmp|opt|Volumes)",
        "long": rf"(?:^|[^{w}-])[A-Za-z0-9+/=_-]{{20,}}(?:$|[^{w}-])",
    }


_FOUND = {name: f"regexp_matches(t, '(?i){pattern}')" for name, pattern in _sensitive_sql().items()}
_CLEAN = r"trim(regexp_replace(text, '[\x00-\x20\x7F]+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, {', '.join(f'{x} AS {name}' for name, x in _FOUND.items())} FROM (SELECT doc_id, {_CLEAN} AS t FROM documents)")
def redact_text(spark, sf_dir):
    clean = text.normalised(F.col("text"))
    found = dict(zip(("email", "authorization", "bearer", "secret", "url", "phone", "path", "long"), text.matches_sensitive(clean)))
    return table(spark, sf_dir, "documents").select("doc_id", *[x.alias(name) for name, x in found.items()])


@query(f"SELECT conv_id, turn, CASE WHEN t = '' OR {' OR '.join(_FOUND.values())} THEN '[redacted]' ELSE t END AS note FROM (SELECT conv_id, turn, {_CLEAN} AS t FROM conversations)")
def redacted_notes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.redacted(F.col("text")).alias("note"))


@query(r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'docs.review' WHEN 1 THEN lower(replace(p_type, ' ', '_')) WHEN 2 THEN 'Fix-cli' ELSE 'test-ui_fix' || CASE WHEN p_size > 25 THEN '.core' ELSE '..core' END END AS slug FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR (p_partkey % 4 = 3 AND slug NOT LIKE '%..%') THEN slug WHEN p_partkey % 4 = 1 AND
  list_bool_and(list_transform(regexp_split_to_array(slug, '[._-]'), lambda x: x IN ('core', 'test', 'docs'))) THEN slug END AS family FROM s""")
def family_validation(spark, sf_dir):
    tail = F.when(F.col("p_size") > 25, ".core").otherwise("..core")
    slug = F.when(F.col("p_partkey") % 4 == 0, "docs.review").when(F.col("p_partkey") % 4 == 1, F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))).when(
        F.col("p_partkey") % 4 == 2, "Fix-cli").otherwise(F.concat(F.lit("test-ui_fix"), tail))
    return table(spark, sf_dir, "part").select("p_partkey", text.family(slug).alias("family"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN './' ELSE CASE page_id % 4 WHEN 1 THEN '/' ELSE CASE page_id % 4 WHEN 2 THEN '' ELSE '../' END END END || regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 4 IN (1, 3) OR regexp_matches(path, '://|\\|^[A-Za-z]:|^~') OR list_contains(string_split(path, '/'), '..') THEN NULL
  ELSE nullif(nullif(regexp_replace(path, '^(\./)+', ''), ''), '.') END AS path FROM p""")
def relative_path(spark, sf_dir):
    prefix = F.when(F.col("page_id") % 4 == 0, "./").when(F.col("page_id") % 4 == 1, "/").when(F.col("page_id") % 4 == 2, "").otherwise("../")
    path = F.concat(prefix, F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""))
    return table(spark, sf_dir, "pages").select("page_id", text.relative_path(path).alias("path"))


@query(r"""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s, epoch_us(date_trunc('second', ts)) AS us, event_id % 8 AS m FROM events)
SELECT event_id, CASE m WHEN 0 THEN us * 1000 WHEN 1 THEN us * 1000 + 123456789 WHEN 2 THEN us * 1000 + 123400000 WHEN 3 THEN (us - 5400000000) * 1000 WHEN 7 THEN us * 1000 + 500000000 END AS ns,
  CASE m WHEN 0 THEN s || 'Z' WHEN 1 THEN s || '.123456789Z' WHEN 2 THEN s || '.123400Z' WHEN 3 THEN strftime(make_timestamp(us - 5400000000), '%Y-%m-%dT%H:%M:%SZ') WHEN 7 THEN s || '.500000Z' END AS canonical,
  CASE WHEN m IN (0, 1, 2, 3, 7) THEN 'valid' WHEN m = 6 THEN 'missing' ELSE 'invalid' END AS quality FROM t""")
def timestamp_canonical(spark, sf_dir):
    s = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    tails = ["Z", ".123456789Z", ".1234Z", "+01:30", "", "-00:00", None, ".5z"]
    given = F.coalesce(*[F.when(F.col("event_id") % 8 == i, F.concat(s, F.lit(t))) for i, t in enumerate(tails) if t is not None])
    rows = table(spark, sf_dir, "events").select("event_id", given.alias("given"))
    ns = instants.epoch_ns(F.col("given"))
    return rows.select("event_id", ns.alias("ns"), instants.canonical(ns).alias("canonical"), instants.quality(F.col("given")).alias("quality"))


@query("""WITH j AS (SELECT event_id, (props->>'$.k')::BIGINT AS k, event_id % 6 AS m FROM events),
v AS (SELECT event_id, CASE m WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE k END AS input, CASE m WHEN 3 THEN NULL WHEN 4 THEN k + 1 ELSE 1 END AS cached, m, k FROM j)
SELECT event_id, CASE WHEN cached > input THEN NULL ELSE input END AS input, CASE WHEN cached > input THEN NULL ELSE cached END AS cached,
  CASE WHEN cached > input THEN NULL ELSE k END AS output, input IS NOT NULL AND cached IS NOT NULL AND NOT coalesce(cached > input, false) AS complete FROM v""")
def json_usage_parse(spark, sf_dir):
    k, m = F.col("k").cast("string"), F.col("event_id") % 6
    given = F.when(m == 0, "true").when(m == 1, "1.5").when(m == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    cached = F.when(m == 3, "-1").when(m == 4, (F.col("k") + 1).cast("string")).otherwise("1")
    payload = F.concat(F.lit('{"info":{"total_token_usage":{"input_tokens":'), given, F.lit(',"cached_input_tokens":'), cached, F.lit(',"output_tokens":'), k, F.lit(',"reasoning_output_tokens":0}}}'))
    used = rollout.usage(payload)
    return observations(spark, sf_dir).select("event_id", *[used[c].alias(c) for c in ("input", "cached", "output", "complete")])


@query("""SELECT CASE event_id % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'malformed' WHEN 2 THEN 'unknown_envelope' WHEN 3 THEN 'unknown_event_type' WHEN 4 THEN 'ignored' ELSE 'event_msg/' ||
  CASE WHEN event_id % 7 = 5 THEN 'token_count' ELSE 'task_started' END END AS route, CASE WHEN event_id % 7 = 6 THEN 'invalid' WHEN event_id % 7 > 1 THEN 'valid' END AS quality, count(*) AS n FROM events GROUP BY ALL""")
def envelope_dispatch(spark, sf_dir):
    m = F.col("event_id") % 7
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = lambda kind, payload, at=stamp: F.concat(F.lit('{"timestamp":"'), at, F.lit(f'","type":"{kind}","payload":{payload}}}'))
    given = (F.when(m == 0, "{not json").when(m == 1, "[1]").when(m == 2, line("other", "{}")).when(m == 3, line("event_msg", '{"type":"new_thing"}')).when(m == 4, line("world_state", "{}"))
             .when(m == 5, line("event_msg", '{"type":"token_count"}')).otherwise(line("event_msg", '{"type":"task_started"}', F.lit("2024-01-01 00:00"))))
    rows = rollout.parse(table(spark, sf_dir, "events").select(given.alias("line")))
    return rows.groupBy("route", "quality").agg(F.count(F.lit(1)).alias("n"))


# Commands with their class, also asserted in the tests.
COMMANDS = {
    "pytest": "pytest full", "pytest --maxfail 1": "pytest full", "python -m pytest a.py": "pytest targeted", "python -m unittest": "unittest full",
    "./gradlew :module:test": "gradle targeted", "env CI=1 pytest tests/safe.py": "pytest targeted", "sh -c 'go test ./...'": "go full",
    "pytest && npm test": "unknown unknown", "pytest tests/*.py": "unknown unknown", "echo pytest": "unknown unknown", "pytest $(cat t)": "unknown unknown",
    "npm run test:unit": "npm targeted", "cargo test --jobs 4": "cargo full", "uv run -- pytest -k x": "pytest targeted", "npx --yes vitest run src/a.test.ts": "vitest targeted",
    "mvn -q test": "maven full", "xcodebuild test -only-testing:A": "xcode targeted", "swift test": "swift full", "dotnet test --filter X": "dotnet targeted",
}
FILES = {
    "cat a.txt b/c.txt": "read:a.txt read:b/c.txt", "head -n 5 x.md": "read:x.md", "sed -n 1,5p src/a.py": "read:src/a.py", "sed -i s/a/b/ src/a.py": "write:src/a.py",
    "rg needle src/m.py": "read:src/m.py", "cat a.txt > out.txt": "read:a.txt write:out.txt", "cat /etc/passwd": "", "cat ../x": "", "cat a | wc": "", "cat $HOME/a": "",
}


def _sized(command: str) -> str:
    """A command with the row's number in its first file or option value, where it has one."""
    return command.replace("a.", "a{}.", 1)


def _chosen_sql(values: list[str]) -> str:
    return "CASE p_partkey % " + str(len(values)) + "".join(f" WHEN {i} THEN '" + v.replace("'", "''") + "'" for i, v in enumerate(values)) + " END"


def _commands(spark, sf_dir, values: dict[str, str]):
    given = commands.chosen([_sized(c) for c in values], F.col("p_partkey") % len(values))
    # few bytes a row and much work: dealt anew, since the files alone make few tasks
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select("p_partkey", F.replace(given, F.lit("{}"), F.col("p_size").cast("string")).alias("command"))


@query(f"""SELECT p_partkey, split_part(c, ' ', 1) AS runner, split_part(c, ' ', 2) AS scope FROM (SELECT p_partkey, {_chosen_sql(list(COMMANDS.values()))} AS c FROM part)""")
def test_command_classify(spark, sf_dir):
    return commands.test_command(_commands(spark, sf_dir, COMMANDS), "command").select("p_partkey", "runner", "scope")


@query(f"SELECT p_partkey, replace({_chosen_sql([_sized(v) for v in FILES.values()])}, '{{}}', p_size::VARCHAR) AS files FROM part")
def shell_facts(spark, sf_dir):
    files = F.transform(commands.shell_files(F.col("command")), lambda f: F.concat_ws(":", f["op"], f["path"]))
    return _commands(spark, sf_dir, FILES).select("p_partkey", F.concat_ws(" ", files).alias("files"))
