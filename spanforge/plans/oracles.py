"""DuckDB SQL of the registered queries, written from the rules rather than from the Spark expressions."""

from __future__ import annotations

from spanforge.functions.paths import COMMAND_PATH, PATH_LINE, PATH_ONLY
from spanforge.functions.shell import READ_ONLY_PROGRAMS, SEARCH_PROGRAMS, VERIFY
from spanforge.plans.inputs import COMMANDS, OUTPUTS, PATHS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A table of fixed rows, numbered from 0 in column i."""
    cell = lambda v: ("true" if v else "false") if isinstance(v, bool) else text(v)
    return "(VALUES " + ", ".join("(" + ", ".join([str(i), *(cell(v) for v in row)]) + ")" for i, row in enumerate(rows)) + f") AS v(i, {names})"


def in_list(items: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(text, items)) + ")"


_SPANS = """
WITH rows AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_key, turn, role, text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn % 60 AS BIGINT)) AS start_time,
         count(*) FILTER (WHERE role <> 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seq
  FROM conversations
),
line AS (
  SELECT *, role <> 'user' AS is_event,
         row_number() OVER (PARTITION BY session_key ORDER BY seq, role <> 'user', turn) AS place,
         substr(sha256('trace:' || session_key), 1, 32) AS trace_id
  FROM rows
),
spans AS (
  SELECT *, substr(sha256('span:' || trace_id || ':' || (place - 1)), 1, 16) AS span_id FROM line
),
turned AS (
  SELECT *, last_value(CASE WHEN NOT is_event THEN span_id END IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_id FROM spans
),
ended AS (
  SELECT t.*,
         (SELECT arg_min(x.start_time, x.place) FROM spans x WHERE x.session_key = t.session_key AND x.start_time > t.start_time) AS next_later,
         (SELECT arg_max(c.start_time, c.place) FROM turned c WHERE c.session_key = t.session_key AND c.turn_id = t.span_id AND c.is_event) AS last_child
  FROM turned t
),
final AS (
  SELECT session_key, place, trace_id, span_id, CASE WHEN is_event THEN coalesce(turn_id, '') ELSE '' END AS parent_span_id,
         CASE WHEN is_event THEN substr(text, 1, 40) WHEN length(text) <= 128 THEN text ELSE substr(text, 1, 127) || '…' END AS name,
         0 AS kind, epoch_us(start_time) AS start_us,
         epoch_us(coalesce(CASE WHEN NOT is_event THEN last_child END, next_later, start_time)) AS end_us,
         CASE WHEN is_event AND length(text) % 7 = 0 THEN 2 ELSE 1 END AS status,
         CASE WHEN is_event AND length(text) % 7 = 0 THEN substr(text, 1, 40) ELSE '' END AS status_msg, is_event, strlen(text) AS result_bytes
  FROM ended
)
"""

_SEGMENTS = r"""
WITH c AS (
  SELECT event_id, command, regexp_replace(command, '2>&1|2>/dev/null|>/dev/null|> /dev/null', ' ', 'g') AS cleaned
  FROM (SELECT e.event_id, v.command FROM events e JOIN {commands} ON v.i = e.event_id % {n})
),
segs AS (
  SELECT event_id, command, unnest(list_filter(regexp_split_to_array(cleaned, '[|;&\n]'), lambda s: s <> '')) AS s FROM c
),
words AS (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS w FROM segs),
bare AS (SELECT *, CASE WHEN len(w) > 0 AND regexp_matches(w[1], '^[A-Za-z_][A-Za-z0-9_]*=') THEN w[2:] ELSE w END AS f FROM words),
kinds AS (
  SELECT event_id, command, CASE
    WHEN contains(s, '>') THEN 'bad' WHEN len(f) = 0 THEN 'ok'
    WHEN f[1] = 'git' AND f[2] IN ('grep', 'ls-files') THEN 'search'
    WHEN f[1] IN {search} AND (contains(s, '-exec') OR contains(s, '-delete')) THEN 'bad'
    WHEN f[1] IN {search} THEN 'search' WHEN f[1] IN {readonly} THEN 'ok' ELSE 'bad' END AS kind
  FROM bare
)
SELECT c.event_id, c.command, {verify} AS verifies,
       coalesce(bool_or(kind = 'search') AND NOT bool_or(kind = 'bad'), false) AS searches, any_value(v.action) IN ('read') AS reads
FROM c LEFT JOIN kinds k ON k.event_id = c.event_id JOIN {commands} ON v.command = c.command
GROUP BY c.event_id, c.command
"""

_EXTRACT = r"""
WITH t AS (SELECT page_id, 'see ' || url || ' src/main.go:12 and lib/a.py lib/b.py: ' || substr(html, 1, 4000) AS text FROM pages),
raw AS (
  SELECT page_id, 0 AS command, unnest(regexp_extract_all(text, {only}, 1)) AS p FROM t
  UNION ALL SELECT page_id, 1, unnest(regexp_extract_all(text, {command}, 1)) FROM t
),
trimmed AS (SELECT page_id, command, trim(trim(p, '"'' ,;:()[]{{}}')) AS p FROM raw),
cut AS (SELECT page_id, command, regexp_replace(regexp_replace(regexp_replace(p, '^a/', ''), '^b/', ''), '^[.]/', '') AS p FROM trimmed),
kept AS (
  SELECT DISTINCT page_id, command, p FROM cut
  WHERE p <> '' AND NOT contains(p, '://') AND NOT starts_with(p, '--') AND NOT starts_with(p, '++') AND (command = 1 OR contains(p, '/'))
)
SELECT t.page_id, coalesce(string_agg(p, chr(10) ORDER BY p) FILTER (WHERE command = 0), '') AS paths, coalesce(string_agg(p, chr(10) ORDER BY p) FILTER (WHERE command = 1), '') AS command_paths
FROM t LEFT JOIN kept USING (page_id) GROUP BY t.page_id
"""

_ITEMS = """
WITH items AS (
  SELECT CAST(user_id AS VARCHAR) AS session_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type = 'view' AS is_call,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS VARCHAR) AS call_id, CAST(event_id AS VARCHAR) AS event_id, value > 50 AS is_error
  FROM events WHERE event_type IN ('view', 'click')
)"""

_MARKS = """
WITH rows AS (SELECT user_id AS session_key, event_id, epoch_us(ts) AS pos, event_type = 'error' AS is_mark FROM events),
ev AS (SELECT session_key, pos, row_number() OVER (PARTITION BY session_key ORDER BY pos, event_id) - 1 AS seq FROM rows WHERE NOT is_mark),
marks AS (SELECT m.session_key, m.event_id, (SELECT count(*) FROM ev WHERE ev.session_key = m.session_key AND ev.pos < m.pos) AS seq FROM rows m WHERE is_mark)
"""

_SESSIONS = """
WITH s AS (
  SELECT 'codex-' || substr(sha256('codex' || chr(0) || '/s/' || o_orderkey), 1, 24) AS session_key, '/home/joe' || CASE WHEN o_orderkey % 3 = 0 THEN 'y' ELSE '' END || '/p' || (o_orderkey % 5) AS cwd,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts, o_orderdate, o_orderkey
  FROM orders
)"""

_NODES = """
nodes AS (
  SELECT CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey // 10 AS VARCHAR) END AS parent_id, lpad(CAST(c_custkey % 97 AS VARCHAR), 3, '0') AS started_at FROM customer
)"""

_commands = values([(c, a, r) for c, a, r in COMMANDS], "command, action, reads")

SQL: dict[str, str] = {
    "trace_spans": _SPANS + "SELECT session_key, place, trace_id, span_id, parent_span_id, name, kind, start_us, end_us, status, status_msg FROM final",
    "trace_turns": _SPANS + "SELECT session_key, count(*) FILTER (WHERE NOT is_event) AS n_turns, count(*) AS n_spans, count(*) FILTER (WHERE parent_span_id <> '') AS n_children, CAST(count(*) FILTER (WHERE status = 2) AS BIGINT) AS n_errors FROM final GROUP BY session_key",
    "trace_export": "SELECT CAST(conv_id AS VARCHAR) AS session_key, substr(sha256('trace:' || conv_id), 1, 32) AS trace_id, count(*) AS n_spans FROM conversations GROUP BY conv_id",
    # Whole JSON: fields in their order, empty ones left out, three characters of markup as escapes.
    "trace_files": _SPANS + """,
        texts AS (
          SELECT *, to_json(name) AS name_json, to_json(status_msg) AS msg_json, strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') AS start_text, strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%SZ') AS end_text FROM final
        ),
        lines AS (
          SELECT session_key, place, trace_id, '{"traceId":"' || trace_id || '","spanId":"' || span_id || '",' || CASE WHEN parent_span_id <> '' THEN '"parentSpanId":"' || parent_span_id || '",' ELSE '' END || '"name":' || name_json
            || ',"kind":0,"startTime":"' || start_text || '","endTime":"' || end_text || '","attributes":{'
            || CASE WHEN is_event THEN '"agent.result.bytes":' || result_bytes || ',"agent.session.id":"c' || session_key || '","agent.tool.action":"exec","agent.tool.name":"Bash"'
               ELSE '"agent.session.harness":"claude-code","agent.session.id":"c' || session_key || '","agent.turn.type":"user-message"' END
            || '},"status":' || status || CASE WHEN status_msg <> '' THEN ',"statusMsg":' || msg_json ELSE '' END || '}' AS line
          FROM texts
        )
        SELECT session_key, replace(replace(replace('{"traceId":"' || any_value(trace_id) || '","session":{"key":"' || session_key || '","id":"c' || session_key || '","harness":"claude-code","startedAt":"2024-01-01T00:00:00Z"},"spans":['
            || string_agg(line, ',' ORDER BY place) || ']}', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS json
        FROM lines GROUP BY session_key""",
    "span_end_times": """
        WITH r AS (SELECT user_id, event_id, epoch_us(ts) - (event_id % 7) * 3600000000 AS start_us FROM events)
        SELECT a.event_id, a.start_us, coalesce((SELECT arg_min(b.start_us, b.event_id) FROM r b WHERE b.user_id = a.user_id AND b.start_us > a.start_us), -1) AS next_us FROM r a""",
    "command_kinds": _SEGMENTS.format(commands=_commands, n=len(COMMANDS), search=in_list(SEARCH_PROGRAMS), readonly=in_list(READ_ONLY_PROGRAMS), verify="(" + " OR ".join(f"contains(lower(c.command), {text(p)})" for p in VERIFY) + ")"),
    "command_read_paths": f"SELECT event_id, v.reads AS paths FROM events JOIN {_commands} ON v.i = event_id % {len(COMMANDS)}",
    "action_for": f"""
        SELECT event_id, tool, CASE tool WHEN 'Read' THEN 'read' WHEN 'Grep' THEN 'search' WHEN 'Edit' THEN 'edit' WHEN 'Mystery' THEN 'other' ELSE action END AS action,
               command || ' -> ' || CASE WHEN tool = 'Bash' THEN {{n}} ELSE 0 END || ' targets, 0 outside' AS summary
        FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Mystery' ELSE 'Bash' END AS tool, v.*
              FROM events JOIN {_commands} ON v.i = event_id % {len(COMMANDS)})""",
    "extract_paths": _EXTRACT.replace("substr(html, 1, 4000)", "html").format(only=text(PATH_ONLY), command=text(COMMAND_PATH)),
    "path_line_hits": f"""
        WITH t AS (SELECT event_id, 'src/a.go:' || event_id || ':x' || chr(10) || '(pkg/b.py:0) ''c.txt:12'' src/a.go:7 lib/d.rs' AS text FROM events),
        hits AS (
          SELECT event_id, p, list(n || '-' || n ORDER BY i) AS lines
          FROM (SELECT event_id, unnest(regexp_extract_all(text, {text(PATH_LINE)}, 1)) AS p, unnest(regexp_extract_all(text, {text(PATH_LINE)}, 2)) AS n, unnest(range(len(regexp_extract_all(text, {text(PATH_LINE)}, 1)))) AS i FROM t)
          WHERE CAST(n AS BIGINT) > 0 GROUP BY event_id, p
        ),
        bare AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(text, {text(PATH_ONLY)}, 1)) AS p FROM t)
        SELECT event_id, string_agg(p || ':' || coalesce(array_to_string(lines, '+'), ''), ',' ORDER BY p) AS hits
        FROM (SELECT event_id, p, lines FROM hits UNION ALL SELECT event_id, p, NULL FROM bare WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.event_id = bare.event_id AND h.p = bare.p))
        GROUP BY event_id""",
    "patch_files": "SELECT o_orderkey, 'lib/' || o_orderstatus || '.go,new.txt,src/' || o_orderkey || '.go' AS paths FROM orders",
    "normalize_paths": f"SELECT event_id, v.path, v.placed FROM events JOIN {values(PATHS, 'path, placed')} ON v.i = event_id % {len(PATHS)}",
    "target_merge": """
        WITH l AS (
          SELECT l_orderkey, 'p' || (l_partkey % 3) AS path, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rank, l_partkey,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem
        ),
        m AS (SELECT l_orderkey, path, min(i) AS i, max(rank) AS rank, string_agg(CAST(l_partkey AS VARCHAR), '+' ORDER BY i) AS lines FROM l GROUP BY l_orderkey, path)
        SELECT l_orderkey, string_agg(path || ':' || CASE rank WHEN 3 THEN 'edit' WHEN 2 THEN 'read' ELSE 'hit' END || ':' || lines, ',' ORDER BY i) AS targets FROM m GROUP BY l_orderkey""",
    "truncated_notes": "SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 1999) || '…' END AS note, CASE WHEN length(text) <= 96 THEN text ELSE substr(text, 1, 93) || '...' END AS verb FROM documents",
    "content_to_string": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || role ELSE '' END AS content FROM conversations",
    "injected_messages": """
        SELECT id, source, starts_with(t, '# AGENTS.md instructions') OR (starts_with(t, '<') AND ends_with(t, '>')) AS injected
        FROM (SELECT page_id AS id, 'page' AS source, trim(html, chr(9) || chr(10) || chr(13) || ' ') AS t FROM pages
              UNION ALL SELECT conv_id * 1000 + turn, 'turn', trim(text, chr(9) || chr(10) || chr(13) || ' ') FROM conversations)""",
    "pair_latest": _ITEMS + """,
        marked AS (
          SELECT *, lag(is_call) OVER w AS prev_call, lag(event_id) OVER w AS prev_event, lead(is_call) OVER w AS next_call, min(CASE WHEN is_call THEN pos END) OVER (PARTITION BY session_key, call_id) AS first_pos
          FROM items WINDOW w AS (PARTITION BY session_key, call_id ORDER BY pos)
        ),
        got AS (
          SELECT session_key, pos, 0 AS unanswered, call_id, prev_event AS call_event, event_id AS result_event, is_error FROM marked WHERE NOT is_call AND prev_call
          UNION ALL SELECT session_key, first_pos, 1, call_id, event_id, '', false FROM marked WHERE is_call AND next_call IS NULL
        )
        SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY unanswered, pos) - 1 AS seq, CAST(unanswered AS BIGINT) AS unanswered, call_id, call_event, result_event, is_error FROM got""",
    "pair_first": _ITEMS + """,
        calls AS (SELECT session_key, call_id, min(pos) AS pos, arg_min(event_id, pos) AS call_event FROM items WHERE is_call GROUP BY session_key, call_id),
        results AS (SELECT c.session_key, c.call_id, arg_min(i.event_id, i.pos) AS result_event, arg_min(i.is_error, i.pos) AS is_error FROM calls c JOIN items i ON i.session_key = c.session_key AND i.call_id = c.call_id AND NOT i.is_call AND i.pos > c.pos GROUP BY c.session_key, c.call_id)
        SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY pos) - 1 AS seq, result_event IS NOT NULL AS answered, call_id, call_event, coalesce(result_event, '') AS result_event, coalesce(is_error, false) AS is_error
        FROM calls LEFT JOIN results USING (session_key, call_id)""",
    "mark_seq": _MARKS + "SELECT session_key, event_id, seq FROM marks",
    "mark_ride": _MARKS + """,
        views AS (SELECT ev.session_key, ev.seq FROM (SELECT user_id AS session_key, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS seq FROM events WHERE event_type <> 'error') ev WHERE event_type = 'view')
        SELECT session_key, event_id, seq, coalesce((SELECT min(ev.seq) FROM ev WHERE ev.session_key = marks.session_key AND ev.seq >= marks.seq), -1) AS event_seq,
               coalesce((SELECT min(views.seq) FROM views WHERE views.session_key = marks.session_key AND views.seq >= marks.seq), -1) AS view_seq FROM marks""",
    "session_meta": """
        SELECT user_id, arg_min('/w/' || event_id, (ts, event_id)) FILTER (WHERE event_type = 'view') AS cwd, coalesce(arg_max('t' || event_id, (ts, event_id)) FILTER (WHERE event_type = 'signup'), 'untitled') AS title,
               bool_or(event_type = 'error') AS is_sidechain, count(*) AS n_lines FROM events GROUP BY user_id""",
    "session_filter": _SESSIONS + "SELECT session_key, cwd, ts AS started_at FROM s WHERE starts_with(cwd, '/home/joe/') AND o_orderkey % 11 <> 0 AND date_trunc('second', o_orderdate) >= TIMESTAMP '1995-01-01'",
    "session_order": _SESSIONS + """
        SELECT session_key, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ts END AS ended_at,
               row_number() OVER (ORDER BY CASE WHEN o_orderkey % 13 <> 0 THEN date_trunc('second', o_orderdate) END DESC NULLS LAST, session_key) AS position FROM s""",
    "session_keys": "SELECT doc_id, 'h-' || lang || '-' || substr(sha256('h-' || lang || chr(0) || '/x/' || source || '/' || doc_id), 1, 24) AS session_key FROM documents",
    "user_messages": "SELECT conv_id, turn, length(text) AS n_chars FROM conversations WHERE role = 'user'",
    "strict_times": "SELECT event_id, CASE WHEN event_id % 4 > 1 THEN epoch_us(ts) - 3600000000 ELSE -1 END AS us FROM events",
    "idle_sessions": "SELECT user_id AS session_key, epoch_us(max(ts)) AS last_us, (SELECT epoch_us(max(ts)) FROM events) - epoch_us(max(ts)) > 3600000000 AS idle FROM events GROUP BY user_id",
    "session_gaps": """
        WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
        n AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT user_id, min(us) AS from_us, max(us) AS to_us, count(*) AS n FROM n GROUP BY user_id, island""",
    "agent_children": "WITH" + _NODES + "SELECT parent_id, string_agg(session_id, ',' ORDER BY started_at, session_id) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id",
    # A script's action is that of all its commands, if they agree; files that are read lie under the call's folder.
    "script_actions": f"""
        WITH calls AS (
            SELECT event_id, k, v.action, v.reads FROM (SELECT event_id, unnest(range(event_id % 4 + 1)) AS k FROM events) e
            JOIN {values([(a, r) for _, a, r in COMMANDS], "action, reads")} ON v.i = (e.event_id // CAST(4 * pow(7, k) AS BIGINT)) % {len(COMMANDS)}
        ),
        files AS (SELECT DISTINCT event_id, CASE WHEN event_id % 3 = 0 THEN 'sub/' ELSE '' END || unnest(string_split(reads, ',')) AS path FROM calls WHERE reads <> ''),
        listed AS (SELECT event_id, string_agg(path, ',' ORDER BY path) AS reads FROM files GROUP BY event_id)
        SELECT event_id, CASE WHEN event_id % 11 <> 0 AND count(DISTINCT action) = 1 THEN min(action) ELSE 'exec' END AS action, coalesce(any_value(listed.reads), '') AS reads
        FROM calls LEFT JOIN listed USING (event_id) GROUP BY event_id""",
    "agent_depths": "WITH RECURSIVE" + _NODES + """,
        d AS (SELECT session_id, session_id AS root_id, 0 AS depth FROM nodes WHERE parent_id IS NULL
              UNION ALL SELECT n.session_id, d.root_id, d.depth + 1 FROM nodes n JOIN d ON n.parent_id = d.session_id)
        SELECT session_id, root_id, depth FROM d""",
    "watermarks": """
        WITH r AS (SELECT user_id, event_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS open FROM events)
        SELECT user_id AS session_key, coalesce(max(CASE WHEN open = 0 THEN event_id * 100 END), -1) AS watermark FROM r GROUP BY user_id""",
    "output_failed": f"SELECT event_id, v.failed FROM events JOIN {values(OUTPUTS, 'output, failed')} ON v.i = event_id % {len(OUTPUTS)}",
    "classified_targets": """
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' ELSE 'search' END AS action,
               CASE event_id % 3 WHEN 0 THEN 'sub/src/login.go:read' WHEN 1 THEN 'src/a.go:edit' ELSE 'src/b.go:hit' END AS targets,
               CASE event_id % 3 WHEN 1 THEN 'tmp:/tmp/x.txt' ELSE '' END AS outside,
               CASE event_id % 3 WHEN 0 THEN 'cat src/login.go -> 1 targets, 0 outside' WHEN 1 THEN 'apply_patch -> 1 targets, 1 outside' ELSE 'grep -n x src/b.go -> 1 targets, 0 outside' END AS summary
        FROM events""",
}
# Files that each command names, counted by hand: what a shell call has as targets.
_NAMED = [0, 1, 1, 0, 1, 1, 0, 0, 0, 1, 1, 2, 1, 0, 0, 1, 2, 0, 0, 0]
SQL["action_for"] = SQL["action_for"].replace("{n}", "[" + ", ".join(map(str, _NAMED)) + "][i + 1]")
