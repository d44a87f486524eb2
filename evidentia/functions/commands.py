"""Literal shell commands: which test runner they start, and which files they read or write.

Everything is an expression over the command: quotes are resolved by patterns, words are laid out one after another,
each with SEP at its end, and a table of patterns says what a runner's command looks like and what narrows its run.
A command that a shell would do more with than split it (operators, expansions, several lines) has no words.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shapes import bound
from .text import relative_path

SEP = "\x1f"
_QUOTED = r"""'[^']*'|"[^"\\]*\""""
_WORD = rf"""(?:[^\s'"\\]|\\.|{_QUOTED})+"""


def laid_out(command: Column) -> Column:
    """The words of one simple command, each followed by SEP; null if it isn't one."""
    bare = F.regexp_replace(command, rf"\\.|{_QUOTED}", "")
    words = F.transform(F.regexp_extract_all(command, F.lit(_WORD), F.lit(0)), lambda w: F.concat(F.regexp_replace(w, r"""'([^']*)'|"([^"\\]*)"|\\(.)""", "$1$2$3"), F.lit(SEP)))
    simple = ~command.rlike(rf"[\r\n*`${SEP}]") & ~bare.rlike(r"""[;|&<>'"\\]""")
    return F.when(simple, F.array_join(words, ""))


def _p(pattern: str) -> str:
    """In the table below a blank is the end of a word and @ a character of a word."""
    return pattern.replace(" ", SEP).replace("@", f"[^{SEP}]")


def _options(*names: str) -> str:
    return rf"(?:\A| )(?:{'|'.join(names)})(?:[=:]@*)? "


_ARGUMENT = r"(?:\A| )(?!-)@+ "
_NEVER = r"(?!)"
_SCRIPT = r"(?:\A| )(?:--grep |-t |--grep=|--testPathPattern=|@*/|@*\.(?:test|spec)\.[jt]s )"

# Runner -> how its command starts, what narrows the run, options whose value is the word after them.
RUNNERS: list[tuple[str, str, str, str]] = [
    ("pytest", r"(?:python[\d.]* -m )?pytest ", f"{_options('-k', '-m', '--keyword', '--mark')}|{_ARGUMENT}", "--maxfail|--junitxml|--tb|--capture"),
    ("unittest", r"python[\d.]* -m unittest ", rf"{_options('-k')}|\A(?!discover )(?:-@* )*(?!-)@+ ", ""),
    ("cargo", "cargo test ", f"{_options('-p', '--package', '--test', '--bench')}|{_ARGUMENT}", "--jobs|--color|--manifest-path|--target"),
    ("go", "go test ", rf"{_options('-run', '-bench', '-list')}|(?:\A| )\./(?!\.\.\. )", ""),
    ("swift", "swift test ", _options("--filter"), ""),
    ("dotnet", "dotnet test ", _options("--filter", "--tests"), ""),
    ("maven", r"(?:mvn|maven) (?=(?:.* )?test )", _options("-Dtest", "-Dtests", "-pl"), ""),
    ("gradle", r"gradlew? (?=(?:.* )?(?!-)(?:@*:)?test )", rf"{_options('--tests')}|\A(?:-@* |(?!(?:@*:)?test )@* )*@*:test ", ""),
    ("xcode", "xcodebuild (?=(?:.* )?test(?:-without-building)? )", _options("-only-testing", "-skip-testing"), ""),
    ("vitest", "vitest (?:run )?", _SCRIPT, ""),
    ("jest", "jest ", _SCRIPT, ""),
    ("playwright", "playwright test ", _SCRIPT, ""),
    *[(name, f"{name} (?:run )?(?=test )", rf"\Atest (?:.* )??{_SCRIPT[8:]}|{_SCRIPT}", "") for name in ("npm", "pnpm", "yarn", "bun")],
    *[(name, f"{name} run (?=test:)", r"\Atest:", "") for name in ("npm", "pnpm", "yarn", "bun")],
]
# Words before another command that do not change what it is.
WRAPPERS = r"(?:env (?:[A-Za-z_]\w*=@* )*|uv run (?:-- (?=@))?|npx (?:(?:-y|--yes|--no-install) )*)"
_FOLDER = r"\A(?:@*/)?"


def test_command(df: DataFrame, command: str) -> DataFrame:
    """Adds `runner` and `scope` (targeted, full, or both unknown) of a command; up to two wrappers are taken off."""
    rows = df.withColumn("_w", laid_out(F.col(command)))
    inner = F.regexp_extract("_w", _p(rf"{_FOLDER}(?i:sh|bash) -c (@*) \z"), 1)
    for _ in range(2):
        rows = rows.withColumn("_w", F.when(F.col("_w").rlike(_p(rf"{_FOLDER}(?i:sh|bash) ")), laid_out(inner)).otherwise(F.regexp_replace("_w", _p(f"{_FOLDER}(?i:{WRAPPERS})"), "")))
    w, found = F.col("_w"), F.lit(None).cast("struct<runner:string,scope:string>")
    for runner, start, narrows, valued in reversed(RUNNERS):
        head = _p(f"{_FOLDER}(?i:{start})")
        rest = F.regexp_replace(w, head, "")
        if valued:
            rest = F.regexp_replace(rest, _p(rf"(?<=\A| )(?:{valued}) @* "), "")
        scope = F.when(rest.rlike(_p(narrows)), "targeted").otherwise("full")
        found = F.when(w.rlike(head), F.struct(F.lit(runner).alias("runner"), scope.alias("scope"))).otherwise(found)
    known = rows.withColumn("_f", found)
    return known.withColumns({c: F.coalesce(F.col(f"_f.{c}"), F.lit("unknown")) for c in ("runner", "scope")}).drop("_w", "_f")


def calls(command: Column, program: str, module: str, subcommands: list[str]) -> Column:
    """Whether a command is a call of the named program (or python -m module) with one of its subcommands, so that an
    observer can leave its own calls out; variables may be set before it."""
    names = "|".join(map(re.escape, subcommands))
    start = _p(rf"\A(?:(?:@*/)?env )?(?:[A-Za-z_]\w*=@* )*(?:@*/)?(?:{re.escape(program)}|python[0-9.]* -m {re.escape(module)}) (?:{names}) ")
    return F.coalesce(laid_out(command).rlike(start), F.lit(False))


# Program -> options whose value is the word after them, and whether its first operand is no file.
READERS = {"cat": ("", False), "head": ("-n|-c", False), "tail": ("-n|-c", False), "sed": ("", True), "rg": ("-g|-e|-m|-A|-B|-C", True)}
_TARGET = r"\s>>?\s*([^\s'\"]+)\s*\z"


def shell_files(command: Column) -> Column:
    """Array of (op, path): the literal operands of cat, head, tail, sed and rg, and one trailing > or >>; empty if
    anything about the command is unclear."""
    none = F.array().cast("array<struct<op:string,path:string>>")
    inside = lambda p: F.when(~p.startswith("-"), relative_path(p))

    def operands(w: Column) -> Column:
        listed = F.lit(None).cast("array<string>")
        for program, (valued, script) in READERS.items():
            rest = F.regexp_replace(w, _p(rf"\A{program} "), "")
            if valued:
                rest = F.regexp_replace(rest, _p(rf"(?<=\A| )(?:{valued}) @* "), "")
            own = F.filter(F.split(F.regexp_replace(rest, f"{SEP}\\z", ""), SEP), lambda x: (x != "") & ~x.startswith("-"))
            listed = F.when(w.startswith(program + SEP), F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(0))) if script else own).otherwise(listed)
        op = F.when(w.rlike(_p(r"\Ased (?:.* )?-i")), "write").otherwise("read")
        return F.transform(listed, lambda p: F.struct(op.alias("op"), inside(p).alias("path")))

    def judged(found: Column) -> Column:
        target = F.regexp_extract(command, _TARGET, 1)
        out = F.when(command.rlike(_TARGET), F.array(F.struct(F.lit("write").alias("op"), inside(target).alias("path")))).otherwise(none)
        every = lambda e: F.when(~F.exists(e, lambda f: f["path"].isNull()), e)
        return F.when(F.size(found) > 0, bound(F.concat(found, out), every))

    files = bound(laid_out(F.regexp_replace(command, _TARGET, "")), lambda w: bound(operands(w), judged))
    return F.coalesce(files, none)


def chosen(values: list[str], at: Column) -> Column:
    """One of some literal values, by its number."""
    return reduce(lambda a, b: F.when(at == b[0], b[1]).otherwise(a), list(enumerate(values)), F.lit(None).cast("string"))
