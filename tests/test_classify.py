"""Calls of every family of tools, classified."""

import json

import pytest

from spanforge.operators.classify import ClassifyOptions, build_events

SCRIPT = 'await tools.exec_command({cmd: "cat src/login.go", workdir: "/work/app/sub"});'
PATCH = "*** Begin Patch\n*** Update File: src/a.go\n*** Add File: /tmp/x.txt\n"
#: tool, input, content, then the action, targets and outside touches, worked out by hand for /work/app and /home/joe.
CALLS = [
    ("Read", {"file_path": "h.go", "offset": 3, "limit": 5}, "x/y.go", "read", "h.go:read:3-7", ""),
    ("Write", {"file_path": "/work/app/f.go", "notebook_path": "n.ipynb"}, "", "edit", "f.go:edit:,n.ipynb:edit:", ""),
    ("Grep", {"path": "src"}, "src/b.go:3: x\nsrc/b.go:9: y\n", "search", "src/b.go:hit:3-3+9-9", ""),
    ("Grep", {"path": "src/p.go"}, "nothing", "search", "src/p.go:hit:", ""),
    ("Grep", {"path": "src/p.go"}, "/home/joe/t.md:4", "search", "src/p.go:hit:", "home:/home/joe/t.md"),
    ("Glob", {"path": "src"}, "src/b.go:3", "search", "src/b.go:hit:", ""),
    ("Bash", {"command": "cat src/login.go"}, "see lib/z.py", "read", "src/login.go:read:,lib/z.py:hit:", ""),
    ("Bash", {"command": "FOO=1 pytest -q tests/test_a.py"}, "", "verify", "tests/test_a.py:hit:", ""),
    ("exec_command", {"cmd": "ls", "workdir": "/work/app/w"}, "k/b.go:7", "search", "w/k/b.go:hit:7-7", ""),
    ("js", {"code": "fs.read('src/zz.js')"}, "", "exec", "src/zz.js:hit:", ""),
    ("exec", {"code": SCRIPT}, "", "read", "sub/src/login.go:read:", ""),
    ("exec", {"cmd": "rm -rf build/x.go"}, "", "exec", "build/x.go:hit:", ""),
    ("apply_patch", {"_raw": PATCH}, "", "edit", "src/a.go:edit:", "tmp:/tmp/x.txt"),
    ("view_image", {"path": "a/i.png"}, "", "search", "a/i.png:read:", ""),
    ("view_image", {}, "", "search", "", ""),
    ("Mystery", {"path": "src/p.go"}, "src/b.go:3", "other", "", ""),
    (None, {"path": "src/p.go"}, None, "other", "", ""),
]


@pytest.mark.parametrize("split", [True, False])
def test_families(spark, split):
    rows = [(k, t, json.dumps(i), c, False, "/work/app") for k, (t, i, c, *_) in enumerate(CALLS)]
    calls = spark.createDataFrame(rows, "seq long, tool string, input string, content string, is_error boolean, cwd string")
    got = {r["seq"]: r for r in build_events(calls, ClassifyOptions(home="/home/joe"), key=("seq",), split=split).collect()}
    shown = lambda t: f"{t['path']}:{t['touch']}:" + "+".join(f"{a}-{b}" for a, b in t["lines"])
    for k, (_, _, _, action, targets, outside) in enumerate(CALLS):
        r = got[k]
        assert (r["action"], ",".join(map(shown, r["targets"])), ",".join(f"{o['scope']}:{o['path']}" for o in r["outside"])) == (action, targets, outside), CALLS[k]


def test_equal_calls_are_classified_once(spark):
    """Calls that recur give what each gives alone; null and empty fields make different calls."""
    rows = [(0, "Bash", '{"command": "cat a.go"}', "a.go:3: x", False, "/w"), (1, "Bash", '{"command": "cat a.go"}', "a.go:3: x", None, "/w"), (2, "Bash", '{"command": "cat a.go"}', None, False, "/w"), (3, "Bash", '{"command": "cat a.go"}', "", False, "/w"),
            (4, "exec", '{"code": "await tools.exec_command({cmd: \\"ls\\"})"}', "", False, None), (5, "exec", '{"cmd": "ls"}', "", False, "/w"), (6, "apply_patch", '{"patch": "*** Add File: b.go\\n"}', "", True, "/w")]
    calls = spark.createDataFrame([(10 * n + r[0], *r[1:]) for n in range(50) for r in rows], "event_id long, tool string, input string, content string, is_error boolean, cwd string")
    alone, once = build_events(calls, key=("event_id",), split=False), build_events(calls, key=("event_id",), recurring=True)
    assert alone.columns == once.columns
    got, expected = once.collect(), alone.collect()
    assert len(got) == len(rows) * 50 and sorted(map(repr, got)) == sorted(map(repr, expected))
