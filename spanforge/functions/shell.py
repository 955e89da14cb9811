"""What a shell command does: verifies, searches, reads, or anything else. Expressions on Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.paths import base_name, extracted
from spanforge.functions.text import fields, let

# The programs and phrases that decide.
VERIFY = ("go test", "go vet", "npm test", "npm run build", "pnpm test", "pnpm build", "pytest", "make test", "cargo test", "swift test")
SEARCH_PROGRAMS = ("grep", "rg", "ag", "find", "fd", "ls", "tree")
READ_ONLY_PROGRAMS = ("cd", "cat", "head", "tail", "wc", "sort", "uniq", "cut", "awk", "echo", "which", "file", "stat", "du", "pwd", "dirname", "basename", "true")
READ_PROGRAMS = ("cat", "head", "tail", "nl", "sed")
HARMLESS = "2>&1|2>/dev/null|>/dev/null|> /dev/null"
ENV_ASSIGN = "^[A-Za-z_][A-Za-z0-9_]*="


def verifies(command: Column, patterns: Sequence[str] = ()) -> Column:
    """Whether a command holds one of the phrases that stand for tests and builds; blank patterns don't count."""
    lower = F.lower(command)
    phrases = [*VERIFY, *(p.strip().lower() for p in patterns if p.strip())]
    out = F.contains(lower, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(lower, F.lit(p))
    return out


def segments(command: Column) -> Column:
    """array of struct(text, program, args): the parts of a pipeline or list, without leading assignments."""

    none = F.array().cast("array<string>")

    def parsed(text: Column) -> Column:
        def named(words: Column) -> Column:
            program = F.when(F.size(words) > 0, F.lower(base_name(F.get(words, F.lit(0))))).otherwise("")
            return F.struct(text.alias("text"), program.alias("program"), F.when(F.size(words) > 1, F.slice(words, F.lit(2), F.size(words))).otherwise(none).alias("args"))

        def bare(words: Column) -> Column:
            begin = F.array_position(F.transform(words, lambda w: w.rlike(ENV_ASSIGN)), F.lit(False)).cast("int")
            return let(begin, lambda k: F.when(k > 0, F.slice(words, k, F.size(words))).otherwise(none))

        return let(let(fields(text), bare), named)

    return F.transform(F.filter(F.split(command, r"[|;&\n]"), lambda s: s != ""), parsed)


def _redirects(s: Column) -> Column:
    return F.contains(s["text"], F.lit(">"))


def sed_reads(args: Column) -> Column:
    return F.array_contains(args, "-n") & ~F.exists(args, lambda a: F.startswith(a, F.lit("-i")))


def searches(command: Column) -> Column:
    """Whether a command only looks at the tree: read-only programs throughout, and one that searches or lists."""

    def kind(s: Column) -> Column:
        first = F.get(s["args"], F.lit(0))
        listing = s["program"].isin(*SEARCH_PROGRAMS)
        return (
            F.when(_redirects(s), "bad").when(s["program"] == "", "ok")
            .when((s["program"] == "git") & F.coalesce(first.isin("grep", "ls-files"), F.lit(False)), "search")
            .when(listing & (F.contains(s["text"], F.lit("-exec")) | F.contains(s["text"], F.lit("-delete"))), "bad")
            .when(listing, "search").when(s["program"].isin(*READ_ONLY_PROGRAMS), "ok").otherwise("bad")
        )

    kinds = F.transform(segments(F.regexp_replace(command, HARMLESS, " ")), kind)
    return let(kinds, lambda k: F.array_contains(k, "search") & ~F.array_contains(k, "bad"))


def read_paths(command: Column) -> Column:
    """The files that pager-like parts of a command open, sorted."""
    reading = F.filter(segments(command), lambda s: ~_redirects(s) & s["program"].isin(*READ_PROGRAMS) & ((s["program"] != "sed") | sed_reads(s["args"])))

    def files(s: Column) -> Column:
        begin = F.struct(F.lit(False).alias("value"), F.when(s["program"] == "sed", 1).otherwise(0).alias("script"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, arg: Column) -> Column:
            flag = F.startswith(arg, F.lit("-"))
            takes = (s["program"].isin("head", "tail") & arg.isin("-n", "-c")) | ((s["program"] == "sed") & arg.isin("-e", "-f"))
            same = lambda value, script, out: F.struct(value.alias("value"), script.alias("script"), out.alias("out"))
            fits = ~arg.rlike(r"[<>*?$`]")
            return (
                F.when(acc["value"], same(F.lit(False), acc["script"], acc["out"]))
                .when(flag, same(takes, acc["script"], acc["out"]))
                .when(acc["script"] > 0, same(F.lit(False), acc["script"] - 1, acc["out"]))
                .when(fits, same(F.lit(False), acc["script"], F.array_append(acc["out"], arg)))
                .otherwise(acc)
            )

        return F.aggregate(s["args"], begin, step, lambda acc: acc["out"])

    named = F.transform(F.flatten(F.transform(reading, files)), lambda a: extracted(a, True))
    return F.array_sort(F.array_distinct(F.filter(named, lambda p: p.isNotNull())))


def reads(command: Column) -> Column:
    """Whether a command only pages files, and names one."""

    def fits(s: Column) -> Column:
        known = s["program"].isin(*READ_ONLY_PROGRAMS, *READ_PROGRAMS) & ((s["program"] != "sed") | sed_reads(s["args"]))
        return ~_redirects(s) & ((s["program"] == "") | known)

    return (F.size(read_paths(command)) > 0) & F.forall(segments(F.regexp_replace(command, HARMLESS, " ")), fits)
