"""From paired calls and results to classified events: action, touched files, summary.

The input is one row per interaction, in the columns of ``CALLS``; others are carried along. Only rows of wrapper scripts
pass through Python. Touched files are merged inside their row by array functions, so nothing is shuffled, unless
``repo_files`` is given, which takes one join for the weak targets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.paths import NO_LINES, command_paths, extract_paths, patch_paths, path_clean, path_hits, placed_under
from spanforge.functions.shell import read_paths, reads, searches, verifies
from spanforge.functions.text import first_string, let, number_at, string_at, truncate_runes, variant
from spanforge.functions.wrapper import unwrapped

#: tool, input (JSON text), content (the result's text), is_error, cwd.
CALLS = ("tool", "input", "content", "is_error", "cwd")
# The tools by what they do.
READ_TOOLS = ("Read", "read", "view")
EDIT_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit", "write", "edit", "multiedit")
GREP_TOOLS = ("Grep", "grep")
LIST_TOOLS = ("Glob", "LS", "find", "ls", "glob")
TOUCH_RANK = {"edit": 3, "read": 2, "hit": 1}
VERB_LIMIT = 96

CANDIDATE = "array<struct<path:string,touch:string,weak:boolean,lines:array<array<bigint>>,base:string>>"
PLACED = "array<struct<rel:string,scope:string,outside:string,touch:string,weak:boolean,lines:array<array<bigint>>>>"
TARGET = "array<struct<path:string,touch:string,lines:array<array<bigint>>,weak:boolean>>"
OUTSIDE = "array<struct<scope:string,path:string>>"


@dataclass(frozen=True)
class ClassifyOptions:
    """Home and temporary folder for outside touches, and further phrases that stand for verification."""

    home: str = ""
    tmp: str = ""
    verify: Sequence[str] = field(default_factory=tuple)


def rank_touch(touch: Column) -> Column:
    out = F.when(touch == "edit", 3).when(touch == "read", 2).when(touch == "hit", 1)
    return out.otherwise(0)


def tool_family(tool: Column) -> Column:
    """The kind of a tool: read, edit, grep, list, shell, stdin, js; exec_command, exec, apply_patch and view_image are their own; other."""
    families = {"read": READ_TOOLS, "edit": EDIT_TOOLS, "grep": GREP_TOOLS, "list": LIST_TOOLS, "shell": ("Bash", "bash"), "stdin": ("write_stdin",), "js": ("js", "js_repl")}
    out = F.when(tool.isin("exec_command", "exec", "apply_patch", "view_image"), tool)
    for family, tools in families.items():
        out = out.when(tool.isin(*tools), family)
    return out.otherwise("other")


def action_for(family: Column, commands: Column, tools: Column, source: Column, patched: Column, options: ClassifyOptions = ClassifyOptions()) -> Column:
    """The action of a call. commands: of a wrapper script, or the one of a shell; tools, source, patched: of wrapper scripts, empty for others."""
    static = F.when(source == "", True).otherwise((F.size(tools) == F.size(commands)) & F.forall(tools, lambda t: t == "exec_command"))
    every = lambda f: F.forall(commands, lambda c: f(c["command"]))
    run = (
        F.when(patched, "edit").when((F.size(commands) == 0) | ~static, "exec")
        .when(every(lambda c: verifies(c, options.verify)), "verify").when(every(searches), "search").when(every(reads), "read").otherwise("exec")
    )
    return (
        F.when(family == "read", "read").when(family.isin("edit", "apply_patch"), "edit").when(family.isin("grep", "list", "view_image"), "search")
        .when(family.isin("shell", "stdin", "js", "exec_command", "exec"), run).otherwise("other")
    )


def _candidates(paths: Column, touch: str | Column, weak: bool, base: Column | None = None, lines: Column | None = None) -> Column:
    """Candidates of these paths; none where paths is null."""
    touch = F.lit(touch) if isinstance(touch, str) else touch
    found = F.transform(paths, lambda p: F.struct(
        p.alias("path"), touch.alias("touch"), F.lit(weak).alias("weak"), (F.array().cast(NO_LINES) if lines is None else lines).alias("lines"), (F.lit("") if base is None else base).alias("base")))
    return F.coalesce(found.cast(CANDIDATE), F.array().cast(CANDIDATE))


def target_candidates(family: Column, v: Column, content: Column, commands: Column, patch: Column) -> Column:
    """All paths that a call may have touched, in order, as it names them.

    Every kind of text is scanned in one place only, and is null for the tools that don't have it. The path that a search was
    given comes last, as "given".
    """
    offset, limit = number_at(v, "$.offset"), number_at(v, "$.limit")
    empty = F.array().cast(NO_LINES)
    lines = F.when((family != "read") | (offset <= 0), empty).otherwise(F.array(F.array(offset, F.when(limit <= 0, offset).otherwise(offset + limit - 1))))
    path, file_path = string_at(v, "$.path"), string_at(v, "$.file_path")
    named = F.when(family == "read", F.array(file_path, path)).when(family == "edit", F.array(file_path, string_at(v, "$.notebook_path"), path)).when(family == "view_image", F.array(path))
    # Commands, where they run, and the text in which they and their output name paths.
    command = F.when(family == "shell", first_string(v, "command")).when(family == "exec_command", first_string(v, "cmd", "command"))
    workdir = F.when(family == "exec_command", first_string(v, "workdir")).otherwise("")
    called = lambda c, w, text: F.struct(c.alias("command"), w.alias("workdir"), text.alias("text"))
    calls = F.when(family == "exec", F.transform(commands, lambda c: called(c["command"], c["workdir"], c["command"]))).when(command.isNotNull(), F.array(called(command, workdir, F.concat(command, F.lit("\n"), content))))
    ran = F.flatten(F.transform(calls, lambda c: F.concat(
        _candidates(read_paths(c["command"]), "read", True, c["workdir"]), _candidates(command_paths(c["command"]), "hit", True, c["workdir"]), _candidates(extract_paths(c["text"]), "hit", True, c["workdir"]))))
    text = F.when(family == "exec", content).when(family == "js", F.concat(first_string(v, "code", "script", "_raw"), F.lit("\n"), content))
    hits = F.transform(path_hits(F.when(family.isin("grep", "list", "exec_command", "exec"), content)), lambda h: F.struct(
        h["path"].alias("path"), F.lit("hit").alias("touch"), family.isin("exec_command", "exec").alias("weak"), F.when(family == "list", empty).otherwise(h["lines"]).alias("lines"), workdir.alias("base")))
    patched = patch_paths(F.when(family == "exec", patch).when(family == "apply_patch", first_string(v, "patch", "input", "_raw")))
    none = F.array().cast(CANDIDATE)
    return F.concat(
        _candidates(F.filter(named, lambda p: p.isNotNull()), F.when(family == "edit", "edit").otherwise("read"), False, lines=lines),
        F.coalesce(ran.cast(CANDIDATE), none), _candidates(extract_paths(text), "hit", True), F.coalesce(hits.cast(CANDIDATE), none), _candidates(patched, "edit", False),
        _candidates(F.when(family.isin("grep", "list") & path.isNotNull(), F.array(path)), "given", True))


def settled(found: Column) -> Column:
    """Placed candidates, where the path that a search was given counts, as a hit, only if nothing else lies inside."""
    inside = F.exists(found, lambda x: x["rel"].isNotNull() & (x["touch"] != "given"))
    kept = F.filter(found, lambda x: (x["touch"] != "given") | ~inside)
    return F.transform(kept, lambda x: x.withField("touch", F.when(x["touch"] == "given", "hit").otherwise(x["touch"]))).cast(PLACED)


def placed(candidates: Column, cwd: Column, options: ClassifyOptions = ClassifyOptions()) -> Column:
    """Candidates relative to the working directory, or outside of it; those that are no paths go."""
    def place(root: Column) -> Column:
        found = F.transform(candidates, lambda c: F.struct(placed_under(c["path"], root, c["base"], options.home, options.tmp).alias("at"), c.alias("c")))
        return F.transform(F.filter(found, lambda x: x["at"].isNotNull()), lambda x: F.struct(
            x["at"]["rel"].alias("rel"), x["at"]["scope"].alias("scope"), x["at"]["outside"].alias("outside"), x["c"]["touch"].alias("touch"), x["c"]["weak"].alias("weak"), x["c"]["lines"].alias("lines"))).cast(PLACED)

    return let(F.when(cwd != "", path_clean(cwd)), place)


def merge_targets(found: Column) -> Column:
    """One target for each path, in the order of first touches: the strongest touch, all lines, the first's weakness."""
    inside = F.filter(found, lambda x: x["rel"].isNotNull())
    numbered = F.array_sort(F.transform(inside, lambda x, i: F.struct(
        x["rel"].alias("path"), i.alias("i"), rank_touch(x["touch"]).alias("rank"), x["lines"].alias("lines"), x["weak"].alias("weak"))))
    kind = "array<struct<path:string,i:int,rank:int,lines:array<array<bigint>>,weak:boolean>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(last["path"].alias("path"), last["i"].alias("i"), F.greatest(last["rank"], x["rank"]).alias("rank"), F.concat(last["lines"], x["lines"]).alias("lines"), last["weak"].alias("weak"))
        return F.when(last["path"] == x["path"], F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), one)).otherwise(F.array_append(acc, x))

    merged = F.aggregate(numbered, F.array().cast(kind), step)
    by_place = F.array_sort(F.transform(merged, lambda x: F.struct(x["i"].alias("i"), x.alias("x"))))
    touch = lambda r: F.when(r == 3, "edit").when(r == 2, "read").when(r == 1, "hit").otherwise("other")
    return F.transform(by_place, lambda y: F.struct(
        y["x"]["path"].alias("path"), touch(y["x"]["rank"]).alias("touch"), y["x"]["lines"].alias("lines"), y["x"]["weak"].alias("weak"))).cast(TARGET)


def outside_touches(found: Column) -> Column:
    """Every touch outside the working directory, repeats included."""
    return F.transform(F.filter(found, lambda x: x["outside"].isNotNull()), lambda x: F.struct(x["scope"].alias("scope"), x["outside"].alias("path"))).cast(OUTSIDE)


def summary_for(tool: Column, v: Column, source: Column, commands: Column, tools: Column, n_targets: Column, n_outside: Column, is_error: Column) -> Column:
    """A line that says what a call did."""
    description, command = string_at(v, "$.description"), first_string(v, "command", "cmd")
    named, calls = F.size(tools), F.size(commands)
    primary = F.when(calls > 0, F.get(commands, F.lit(0))["command"]).otherwise(F.get(tools, F.lit(0)))
    more = F.when(named > 0, named - 1).otherwise(calls - 1)
    suffix = F.when(more == 1, " (+1 more tool call)").when(more > 1, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more tool calls)"))).otherwise("")
    room = F.lit(VERB_LIMIT) - F.length(suffix)
    wrapped = F.concat(F.when(F.length(primary) <= room, primary).otherwise(F.concat(F.left(primary, room - 3), F.lit("..."))), suffix)
    plain = F.when(F.coalesce(description != "", F.lit(False)), description).otherwise(tool)
    verb = F.when(command != "", truncate_runes(command, VERB_LIMIT, "...")).when((tool == "exec") & ((calls > 0) | (named > 0)), wrapped).otherwise(plain)
    return F.concat(verb, F.lit(" -> "), n_targets.cast("string"), F.lit(" targets, "), n_outside.cast("string"), F.lit(" outside"), F.when(is_error, " error").otherwise(""))


def _with_scripts(calls: DataFrame, split: bool) -> DataFrame:
    """Columns __source, __commands, __tools, __patch: what wrapper scripts do; empty for all other rows.

    split: whether other rows go past Python, which reads calls twice. Without it, Python gets a null for each of them."""
    v = F.col("__v")
    sources = [F.when(F.coalesce(string_at(v, f"$.{k}") != "", F.lit(False)), string_at(v, f"$.{k}")) for k in ("_raw", "code", "script")]
    is_script = F.col("tool").eqNullSafe("exec")
    none = F.array().cast("array<struct<command:string,workdir:string>>")
    if not split:
        calls = calls.withColumn("__source", F.when(is_script, F.coalesce(*sources, F.lit("")))).withColumn("__u", unwrapped("__source"))
        direct = first_string(v, "cmd", "command")
        one = F.when(is_script & (direct != ""), F.array(F.struct(direct.alias("command"), first_string(v, "workdir").alias("workdir")))).otherwise(none)
        commands = F.when(F.coalesce("__source", F.lit("")) == "", one).otherwise(F.col("__u.commands"))
        return calls.select("*", commands.alias("__commands"), F.col("__u.tools").alias("__tools"), F.col("__u.patch").alias("__patch")).withColumn("__source", F.coalesce("__source", F.lit(""))).drop("__u")
    plain = calls.where(~is_script).select("*", F.lit("").alias("__source"), none.alias("__commands"), F.array().cast("array<string>").alias("__tools"), F.lit("").alias("__patch"))
    direct = first_string(v, "cmd", "command")
    one = F.when(direct != "", F.array(F.struct(direct.alias("command"), first_string(v, "workdir").alias("workdir")))).otherwise(none)
    scripts = calls.where(is_script).withColumn("__source", F.coalesce(*sources, F.lit("")))
    scripts = scripts.withColumn("__u", unwrapped("__source"))
    scripts = scripts.select("*", F.when(F.col("__source") == "", one).otherwise(F.col("__u.commands")).alias("__commands"), F.col("__u.tools").alias("__tools"), F.col("__u.patch").alias("__patch")).drop("__u")
    return plain.unionByName(scripts)


def build_events(calls: DataFrame, options: ClassifyOptions = ClassifyOptions(), repo_files: DataFrame | None = None, key: Sequence[str] = ("session_key", "seq"), scripts: bool = True, split: bool = True, recurring: bool = False) -> DataFrame:
    """calls with action, targets, outside, result_bytes and summary.

    repo_files (cwd, path): if given, weak targets that it lacks go. scripts: whether wrapper scripts may occur; without
    them the plan is free of Python. split: False for streams, whose rows must be read once. recurring: calls that are equal in
    all of ``CALLS`` are classified once, at the cost of a shuffle of different calls and a join by their digests.
    """
    if recurring:
        return _once_each(calls, options, repo_files, scripts)
    base = calls.withColumn("__v", variant(F.col("input")))
    if scripts:
        base = _with_scripts(base, split)
    else:
        base = base.select("*", F.lit("").alias("__source"), F.array().cast("array<struct<command:string,workdir:string>>").alias("__commands"), F.array().cast("array<string>").alias("__tools"), F.lit("").alias("__patch"))
    v, tool, content, cwd = F.col("__v"), F.col("tool"), F.coalesce("content", F.lit("")), F.coalesce("cwd", F.lit(""))
    family = F.col("__family")
    base = base.withColumn("__family", tool_family(tool))
    base = base.withColumn("__found", placed(target_candidates(family, v, content, F.col("__commands"), F.col("__patch")), cwd, options))
    base = base.withColumn("__found", settled(F.col("__found")))
    if repo_files is not None:
        base = _existing(base, repo_files, key)
    shell = first_string(v, "command", "cmd", "code", "chars", "script", "_raw")
    one = F.array(F.struct(shell.alias("command"), F.lit("").alias("workdir")))
    base = base.withColumn("__ran", F.when(family.isin("shell", "stdin", "js", "exec_command"), one).otherwise(F.col("__commands")))
    base = base.withColumns({
        "targets": merge_targets(F.col("__found")), "outside": outside_touches(F.col("__found")),
        "action": action_for(family, F.col("__ran"), F.col("__tools"), F.col("__source"), (family == "exec") & (F.size(patch_paths(F.col("__patch"))) > 0), options),
        "result_bytes": F.octet_length(content)})
    base = base.withColumn("summary", summary_for(tool, v, F.col("__source"), F.col("__commands"), F.col("__tools"), F.size("targets"), F.size("outside"), F.coalesce("is_error", F.lit(False))))
    return base.drop("__v", "__source", "__commands", "__tools", "__patch", "__family", "__found", "__ran")


def _once_each(calls: DataFrame, options: ClassifyOptions, repo_files: DataFrame | None, scripts: bool) -> DataFrame:
    """build_events for calls that recur: what an event says depends on ``CALLS`` alone."""
    digest = F.sha2(F.to_json(F.struct(*CALLS)), 256)  # fields that are null are left out
    different = calls.select(digest.alias("__call"), *CALLS).distinct()
    events = build_events(different, options, repo_files, key=("__call",), scripts=scripts, split=False)
    made = [c for c in events.columns if c not in different.columns]
    rest = [c for c in calls.columns if c not in CALLS]
    joined = calls.select(*rest, digest.alias("__call")).join(events, "__call")
    return joined.select(*calls.columns, *made)


def _existing(base: DataFrame, repo_files: DataFrame, key: Sequence[str]) -> DataFrame:
    """base without the weak targets that repo_files does not have; one join on (cwd, path), and one back on the key."""
    weak = base.select(*key, "cwd", F.explode("__found").alias("x")).where(F.col("x.weak") & F.col("x.rel").isNotNull()).select(*key, F.col("cwd"), F.col("x.rel").alias("path")).distinct()
    there = weak.join(repo_files.select("cwd", "path").distinct(), ["cwd", "path"], "left_semi").groupBy(*key).agg(F.collect_set("path").alias("__there"))
    joined = base.join(there, list(key), "left")
    have = F.coalesce("__there", F.array().cast("array<string>"))
    pairs = F.arrays_zip(F.col("__found").alias("x"), F.array_repeat(have, F.size("__found")).alias("have"))
    kept = F.transform(F.filter(pairs, lambda p: ~p["x"]["weak"] | p["x"]["rel"].isNull() | F.array_contains(p["have"], p["x"]["rel"])), lambda p: p["x"])
    return joined.withColumn("__found", kept).drop("__there")
