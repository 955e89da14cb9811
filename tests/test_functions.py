import pytest
from pyspark.sql import functions as F

from spanforge.functions import paths as P
from spanforge.functions import shell as S
from spanforge.functions import text as X
from spanforge.functions.wrapper import unwrap


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_path_clean(spark):
    cases = {"a//b/./c": "a/b/c", "/../x": "/x", "a/..": ".", "": ".", "../a": "../a", "/": "/", "a/b/../../..": "..", "./x/": "x"}
    assert values(spark, list(cases), P.path_clean) == list(cases.values())


def test_base_name(spark):
    cases = {"/usr/bin/git": "git", "git": "git", "a/b/": "b", "": ".", "//": "/"}
    assert values(spark, list(cases), P.base_name) == list(cases.values())


def test_extracted(spark):
    cases = {"'a/src/x.go'": "src/x.go", "b/y.py,": "y.py", "./z": "z", "http://h/x.go": None, "--flag": None, "(k.txt)": "k.txt", "": None}
    assert values(spark, list(cases), lambda c: P.extracted(c, True)) == list(cases.values())
    assert values(spark, ["top.go", "a/b.go"], lambda c: P.extracted(c, False)) == [None, None]
    assert values(spark, ["x/top.go"], lambda c: P.extracted(c, False)) == ["x/top.go"]


def test_normalize_with_base_and_home(spark):
    at = lambda c: P.normalize_path(c, F.lit("/w/app"), F.lit("/w/app/sub"), home="/home/joe")
    got = values(spark, ["x.go", "/w/app/y.go", "../up", "/home/joe/n", "/tmpfoo/x", "a\nb", "/w/app"], at)
    assert [tuple(g) if g else None for g in got] == [
        ("sub/x.go", None, None), ("y.go", None, None), None, (None, "home", "/home/joe/n"), (None, "tmp", "/tmpfoo/x"), None, (None, "other", "/w/app")]
    outside = values(spark, ["x.go"], lambda c: P.normalize_path(c, F.lit("/w/app"), F.lit("/elsewhere")))
    assert tuple(outside[0]) == (None, "other", "/elsewhere/x.go")


def test_adjacent_paths_share_a_delimiter(spark):
    assert values(spark, ["x/b.go y/d.go z/f.go"], P.extract_paths) == [["x/b.go", "z/f.go"]]


def test_path_hits(spark):
    got = values(spark, ["m/a.go:3: x\nm/a.go:9: y\nn/b.go:99999999999999999999\nk.py:0"], P.path_hits)[0]
    assert [(h["path"], h["lines"]) for h in got] == [("m/a.go", [[3, 3], [9, 9]]), ("n/b.go", [])]


@pytest.mark.parametrize("patterns, command, want", [((), "GO TEST ./x", True), ((), "go build", False), (("  Just Check ",), "just check now", True), ((" ", ""), "ls", False)])
def test_verifies(spark, patterns, command, want):
    assert values(spark, [command], lambda c: S.verifies(c, patterns)) == [want]


def test_read_paths_flags_and_assignments(spark):
    cases = {
        "head -n 3 a.txt b.txt": ["a.txt", "b.txt"], "X=1 Y=2 cat z.md": ["z.md"], "sed -n -e '1p' s.txt": [], "sed '1p' q.txt": [], "cat *.go $HOME/x 'q r.txt'": ["q", "r.txt"], "nl < f": ["f"],
        "cat a > b": [], "/bin/CAT up.txt": ["up.txt"], "": [],
    }
    assert values(spark, list(cases), S.read_paths) == list(cases.values())


def test_strict_time_and_text(spark):
    cases = {"2024-01-02T03:04:05Z": "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.120+01:00": "2024-01-02T02:04:05.12Z", "2026": None, "2024-01-02 03:04:05": None, "2024-01-02T03:04:05Z ": None}
    assert values(spark, list(cases), lambda c: X.rfc3339(X.parse_time(c))) == list(cases.values())
    assert values(spark, [0, -5, 1, 1500], X.millis_text, "long") == ["", "", "1970-01-01T00:00:00.001Z", "1970-01-01T00:00:01.5Z"]


def test_trim_truncate_injected(spark):
    assert values(spark, ["  a \n"], X.trim_space) == ["a"]
    assert values(spark, ["äbcdef", "abc"], lambda c: X.truncate_runes(c, 4, "…")) == ["äbc…", "abc"]
    assert values(spark, [" <env>x</env>\n", "# AGENTS.md instructions for x", "<a> b", "hi"], X.injected) == [True, True, False, False]


def test_content_text(spark):
    cases = ['"s"', "null", '[{"text":"a"},{"content":"b"},3,{"text":1}]', '{"b":1,"a":"<x>"}']
    assert values(spark, cases, lambda c: X.content_text(X.variant(c))) == ["s", "", "a\nb", '{"a":"\\u003cx\\u003e","b":1}']


def test_first_string_takes_strings_only(spark):
    assert values(spark, ['{"a":1,"b":"x"}', '{"a":"","b":"x"}', "{}"], lambda c: X.first_string(X.variant(c), "a", "b")) == ["x", "", ""]


def test_unwrap():
    source = 'const a = await tools.exec_command({"cmd": "ls -la", workdir: "/w"});\n// tools.exec_command({cmd: "no"})\nconst s = "tools.other(1)"; tools.view(1); mytools.exec_command({cmd:"no"})'
    commands, tools, patch = unwrap(source)
    assert commands == [{"command": "ls -la", "workdir": "/w"}] and tools == ["exec_command", "view"] and patch == ""
    assert unwrap('tools.exec_command({cmd: "a", cmd: "b"})')[0] == []
    assert unwrap('tools.exec_command({cmd: "a", workdir: "x", workdir: "y"})')[0] == [{"command": "a", "workdir": ""}]
    assert unwrap('tools.exec_command({cmd: "a"')[0] == []
    assert unwrap('  const patch = "*** Add File: n.go\\n";\nawait tools.apply_patch(patch)')[2] == "*** Add File: n.go\n"
    assert unwrap('const patch = "*** Add File: n.go\\n";')[2] == "" and unwrap(None) == ([], [], "")
