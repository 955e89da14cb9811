"""Scripts that wrap tool calls: which tools a script calls, the commands it runs, and the patch it applies.

A script is scanned by one pattern that steps over strings, templates and comments, so calls inside them don't count. It is
the only part of classification that column expressions can't say; it runs as an Arrow-batched function, on wrapper rows only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import dropwhile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCAN = re.compile(
    r"""(?P<skip>'(?:\\.|[^'\\])*\\?(?:'|\Z)|"(?:\\.|[^"\\])*\\?(?:"|\Z)|`(?:\\.|[^`\\])*\\?(?:`|\Z)|//[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z))"""
    r"""|(?<![A-Za-z0-9_$])tools\.(?P<name>[A-Za-z0-9_$]+)[ \t\r\n]*\(|(?P<paren>[()])""", re.S)
# How commands and patches are written in a script.
FIELD = re.compile(r"""(?:^|[\s,{])(?:"(cmd|workdir)"|(cmd|workdir))[\t\n\f\r ]*:[\t\n\f\r ]*("(?:\\.|[^"\\])*")""", re.A)
PATCH = re.compile(r"""^[\t ]*(?:const|let|var)[\t ]+patch[\t ]*=[\t ]*("(?:\\.|[^"\\])*")[\t ]*;""", re.M)
RESULT = T.StructType([
    T.StructField("commands", T.ArrayType(T.StructType([T.StructField("command", T.StringType()), T.StructField("workdir", T.StringType())]))),
    T.StructField("tools", T.ArrayType(T.StringType())),
    T.StructField("patch", T.StringType()),
])


def _loaded(literal: str) -> str | None:
    try:
        return json.loads(literal).encode("utf-8", "replace").decode()
    except ValueError:
        return None


def tool_calls(source: str) -> list[tuple[str, int]]:
    """Name and place after the opening parenthesis of every call, nested ones too."""
    return [(m["name"], m.end()) for m in SCAN.finditer(source) if m["name"]]


def _closing(source: str, at: int) -> int | None:
    depth = 1
    for m in SCAN.finditer(source, at):
        if m["skip"]:
            continue
        depth += -1 if m["paren"] == ")" else 1
        if not depth:
            return m.start()
    return None


def arguments(source: str, tool: str) -> list[str]:
    """The arguments of every call of one tool that lies in no other call of it; calls end where one is never closed."""
    out, after = [], 0
    for name, at in tool_calls(source):
        if name != tool or at < after:
            continue
        end = _closing(source, at)
        if end is None:
            break
        out.append(source[at:end])
        after = end + 1
    return out


def static_command(argument: str) -> tuple[str, str] | None:
    """Command and working directory of one call, where they are plain strings.

    A call names its command once: none, or several, is no command. A directory counts if it is the only one. Empty strings before the first
    that says something, and strings that can't be read, don't count.
    """
    values: dict[str, list[str]] = {"cmd": [], "workdir": []}
    for m in FIELD.finditer(argument):
        if (value := _loaded(m[3])) is not None:
            values[m[1] or m[2]].append(value)
    commands, folders = (list(dropwhile(lambda v: not v, found)) for found in values.values())
    return (commands[0], folders[0] if len(folders) == 1 else "") if len(commands) == 1 else None


def unwrap(source: str | None) -> tuple[list[dict], list[str], str]:
    """Commands, names of called tools, and the applied patch of a script."""
    if not source:
        return [], [], ""
    found = [c for a in arguments(source, "exec_command") if (c := static_command(a))]
    patch = ""
    if (m := PATCH.search(source)) and any(a.strip() == "patch" for a in arguments(source, "apply_patch")):
        patch = _loaded(m[1]) or ""
    return [{"command": c, "workdir": w} for c, w in found], [n for n, _ in tool_calls(source)], patch


@F.pandas_udf(RESULT)
def unwrapped(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in sources:
        rows = [unwrap(s) for s in batch]
        yield pd.DataFrame({"commands": [r[0] for r in rows], "tools": [r[1] for r in rows], "patch": [r[2] for r in rows]})
