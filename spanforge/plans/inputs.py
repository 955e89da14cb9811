"""Session-log shaped inputs made from the driver's tables, by expressions that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.session import table

#: Commands with the action that they stand for and the files that they read, worked out by hand.
COMMANDS: list[tuple[str, str, str]] = [
    ("go test ./...", "verify", ""),
    ("grep -rn login src/main.go", "search", ""),
    ("cat src/login.go", "read", "src/login.go"),
    ("ls -la | wc -l", "search", ""),
    ("sed -n '1,20p' pkg/a.go", "read", "pkg/a.go"),
    ("sed -i 's/a/b/' pkg/a.go", "exec", ""),
    ("rm -rf build", "exec", ""),
    ("find . -name '*.go' -delete", "exec", ""),
    ("git grep TODO", "search", ""),
    ("FOO=1 pytest -q tests/test_a.py", "verify", ""),
    ("head -n 5 README.md", "read", "README.md"),
    ("cat a.txt > b.txt", "exec", ""),
    ("cat f.txt 2>/dev/null", "exec", ""),
    ("rg pattern 2>&1 | head", "search", ""),
    ("npm run build", "verify", ""),
    ("python script.py", "exec", ""),
    ("tail -c 10 log/app.log; cat notes.md", "read", "log/app.log,notes.md"),
    ("echo hi", "exec", ""),
    ("cd src && ls", "search", ""),
    ("git ls-files && rm x", "exec", ""),
]
PATHS: list[tuple[str, str]] = [
    # path, what it is in /work/app with home /home/joe: the relative path, scope:path outside, or nothing
    ("src/a.go", "src/a.go"), ("/work/app/src/b.go", "src/b.go"), ("./x/../y.txt", "y.txt"), ("../up.txt", ""), ("/work/app", "other:/work/app"),
    ("/work/application/z.go", "other:/work/application/z.go"), ("/home/joe/notes.md", "home:/home/joe/notes.md"), ("/tmp/scratch.log", "tmp:/tmp/scratch.log"),
    ("https://example.com/a.go", ""), ("'quoted/file.py'", "quoted/file.py"), (".", ""), ("/etc//hosts", "other:/etc/hosts"), ("", ""), ("/work/app/..x/f", "other:/work/app/..x/f"),
]
OUTPUTS: list[tuple[str, bool]] = [
    ('{"exit_code": 0, "output": "x"}', False), ('{"exit_code": 2}', True), ('{"metadata": {"exit_code": 1}}', True), ('{"timed_out": true}', True), ('{"timed_out": false}', False),
    ("apply_patch verification failed: no such file", True), ("Script completed\nExit code: 1", False), ("script failed\n", True), ("Exit code: 0\nOutput:\nok", False),
    ("Process exited with code 3\nOutput:\nbad", True), ("fine\nOutput:\nExit code: 1", False), ("x\n Aborted by user \n", True), ("", False), ("plain text", False),
]


def picked(values: list, by: Column) -> Column:
    """The value of a list that a number picks."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))


def instant(number: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(number.cast("timestamp"))


def conversation_sessions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, events and marks: users' turns are marks, the others are events, one minute apart."""
    turns = table(spark, folder, "conversations").withColumn("session_key", F.col("conv_id").cast("string"))
    ts = F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seq = F.coalesce(F.sum(F.when(F.col("role") != "user", 1).otherwise(0)).over(w), F.lit(0))
    rows = turns.withColumn("ts", ts).withColumn("seq", seq)
    sessions = turns.select("session_key").distinct().select(
        "session_key", F.concat(F.lit("c"), F.col("session_key")).alias("session_id"), F.lit("claude-code").alias("harness"), F.lit("2024-01-01T00:00:00Z").alias("started_at"))
    marks = rows.where(F.col("role") == "user").select("session_key", "seq", "ts", F.lit("user-message").alias("type"), F.col("text").alias("note"), F.col("turn").alias("mark_pos"))
    none = F.array().cast("array<struct<scope:string,path:string>>")
    no_targets = F.array().cast("array<struct<path:string,touch:string,lines:array<array<bigint>>,weak:boolean>>")
    events = rows.where(F.col("role") != "user").select(
        "session_key", "seq", "ts", F.lit("Bash").alias("tool"), F.lit("exec").alias("action"), no_targets.alias("targets"), none.alias("outside"),
        F.octet_length("text").alias("result_bytes"), (F.length("text") % 7 == 0).alias("is_error"), F.left("text", F.lit(40)).alias("summary"))
    return sessions, events, marks


def event_items(spark: SparkSession, folder: str) -> DataFrame:
    """Calls (views) and results (clicks) by user, paired by the number in their props; ids recur."""
    rows = table(spark, folder, "events").where(F.col("event_type").isin("view", "click"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(
        F.col("user_id").cast("string").alias("session_key"), F.row_number().over(w).cast("long").alias("pos"), F.when(F.col("event_type") == "view", "call").otherwise("result").alias("kind"),
        (F.get_json_object("props", "$.k").cast("int") % 8).cast("string").alias("call_id"), F.lit("Read").alias("tool"), F.col("event_id").cast("string").alias("input"), F.lit("").alias("ts"), F.lit("/work").alias("cwd"),
        F.col("event_id").cast("string").alias("content"), (F.col("value") > 50).alias("is_error"))
