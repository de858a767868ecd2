"""The same results in plain SQL, for comparison."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Conversations and events as numbered logs.
_TALK = """
talk AS (
  SELECT 'conv-' || conv_id AS file_path, conv_id, turn, role, text,
         row_number() OVER w AS seq,
         CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS prompt_index,
         strftime(TIMESTAMP '2025-01-01' + to_seconds(turn), '%Y-%m-%dT%H:%M:%SZ') AS stamp
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)"""
_ACT = """
act AS (
  SELECT 'user-' || user_id AS file_path, event_id, event_type, value, props, k,
         row_number() OVER w AS seq,
         CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT)
           AS prompt_index,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp,
         CASE WHEN k % 2 = 0 THEN 'c' || (k % 4) END AS call_id,
         CASE event_type
           WHEN 'signup' THEN 'user_message'
           WHEN 'click' THEN 'function_call'
           WHEN 'purchase' THEN 'function_call_output'
           WHEN 'view' THEN CASE WHEN k % 10 <> 9 THEN 'token_count' END
           ELSE CASE WHEN k % 4 <= 1 THEN 'agent_reasoning'
                     WHEN k % 4 = 2 THEN 'turn_aborted' ELSE 'agent_message' END
         END AS payload_type,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'response_item'
              WHEN event_type = 'view' AND k % 10 = 9 THEN 'turn_context'
              ELSE 'event_msg' END AS log_type,
         CASE WHEN k % 5 = 0 THEN 'update_plan' ELSE 'tool' || (k % 3) END AS name
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
)"""
_MEMBERS = "prompt_index > 0 AND event_type <> 'signup'"

ORACLES["first_session_file"] = """
SELECT file_path FROM (
  SELECT DISTINCT conv_id,
    concat_ws('/', '/logs', 2021 + conv_id % 4, 1 + conv_id % 12, 1 + conv_id % 28,
              'conv-' || conv_id || '.jsonl') AS file_path,
    CAST(2021 + conv_id % 4 AS VARCHAR) AS y, CAST(1 + conv_id % 12 AS VARCHAR) AS m,
    CAST(1 + conv_id % 28 AS VARCHAR) AS d, 'conv-' || conv_id || '.jsonl' AS f
  FROM conversations)
ORDER BY y, m, d, f LIMIT 1
"""
ORACLES["limited_session_files"] = """
SELECT 'conv-' || conv_id AS file_path, count(*) AS n_lines FROM conversations
WHERE 'conv-' || conv_id IN (
  SELECT DISTINCT 'conv-' || conv_id AS f FROM conversations ORDER BY f LIMIT 2)
GROUP BY ALL
"""
ORACLES["jsonl_load"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
         generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT 'doc-' || doc_id AS file_path, max(n) AS n_lines,
       count(*) FILTER (WHERE trim(body) <> '') AS n_events,
       min(n) FILTER (WHERE trim(body) <> '' AND (doc_id + n - 1) % 13 = 5) AS first_bad_line
FROM lines GROUP BY doc_id
"""

_FLAWED = """
flawed AS (
  SELECT 'user-' || user_id AS file_path, event_id, event_id % 7 AS flaw,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event_index,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp,
         CASE event_id % 7
           WHEN 0 THEN 'Event must be a JSON object.'
           WHEN 1 THEN 'Event ''type'' must be a non-empty string.'
           WHEN 2 THEN 'Event ''timestamp'' must be a string or null.'
           WHEN 3 THEN 'Event ''payload'' must be a JSON object.' END AS event_error,
         CASE event_id % 7
           WHEN 1 THEN '{"type": " ", "n": ' || event_id || '}'
           WHEN 2 THEN '{"type": "x", "timestamp": ' || event_id || '}'
           WHEN 3 THEN '{"type": "event_msg", "timestamp": "'
             || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '", "payload": "p' || event_id || '"}'
         END AS event_text
  FROM events)"""
ORACLES["event_validation"] = f"WITH {_FLAWED} SELECT file_path, event_index, event_error FROM flawed"
ORACLES["event_normalization"] = f"""
WITH {_FLAWED} SELECT file_path, event_index,
  '{{"type": "event_msg", "timestamp": "' || stamp || '", ' || CASE flaw
    WHEN 4 THEN '"payload": {{}}, "metadata": {{}}}}'
    WHEN 5 THEN '"payload": {{}}}}'
    ELSE '"payload": {{"n": ' || event_id || '}}}}' END AS raw_json
FROM flawed WHERE event_error IS NULL
"""
ORACLES["dead_letter_errors"] = f"""
WITH {_FLAWED} SELECT file_path, event_index AS line_number, 'WARNING' AS severity,
  'invalid_event' AS code, event_error AS message, 'CONTINUE' AS recommended_action,
  '{{"event": ' || event_text || '}}' AS context
FROM flawed WHERE event_error IS NOT NULL
"""
ORACLES["serialized_errors"] = f"""
WITH {_FLAWED} SELECT file_path, event_index AS line_number,
  '{{"severity":"WARNING","code":"invalid_event","message":"' || event_error
  || '","recommended_action":"CONTINUE","file_path":"' || file_path || '","line_number":'
  || event_index || ',"context":' || coalesce('{{"event": ' || event_text || '}}', 'null')
  || '}}' AS error_json
FROM flawed WHERE event_error IS NOT NULL
"""
ORACLES["error_preview"] = f"""
WITH {_FLAWED}, numbered AS (
  SELECT file_path, event_error, count(*) OVER (PARTITION BY file_path) AS n,
         row_number() OVER (PARTITION BY file_path ORDER BY event_index) AS i
  FROM flawed WHERE event_error IS NOT NULL)
SELECT DISTINCT file_path, 0 AS line_no, 'errors: ' || n AS text FROM numbered
UNION ALL SELECT file_path, i, '  - WARNING/invalid_event: ' || event_error
FROM numbered WHERE i <= 3
UNION ALL SELECT DISTINCT file_path, 4, '  - ... ' || (n - 3) || ' more' FROM numbered WHERE n > 3
"""
ORACLES["atomic_files"] = """
WITH e AS (
  SELECT 'user-' || user_id AS file_path, event_type = 'view' AND event_id % 97 = 3 AS bad,
         sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY event_id) AS p
  FROM events)
SELECT file_path, count(*) AS n_events FROM e GROUP BY file_path
HAVING NOT bool_or(bad AND p > 0)
"""

_SECRETS = """
secrets AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN '  Sk-' || text
    WHEN 1 THEN text || chr(10) || '-----BEGIN KEY'
    WHEN 2 THEN md5(text) || md5(lang)
    WHEN 3 THEN substr(md5(text) || md5(lang), 2)
    WHEN 4 THEN 'BEARER ' || text ELSE text END AS text,
    doc_id % 6 IN (0, 1, 2, 4) AS is_secret
  FROM documents)"""
ORACLES["secret_strings"] = f"WITH {_SECRETS} SELECT doc_id, is_secret FROM secrets"
ORACLES["scrubbed_strings"] = f"""
WITH {_SECRETS} SELECT doc_id, CASE WHEN is_secret THEN '[redacted]' ELSE text END AS scrubbed
FROM secrets
"""
ORACLES["sensitive_keys"] = """
SELECT doc_id, '{"api_key_backup": "keep", "Password": "[redacted]", "deep": {"SECRET": {"a": '
  || '["[redacted]", null, "[redacted]", {"b": "[redacted]"}]}}, "doc": {"note": '
  || CAST(to_json(text) AS VARCHAR) || '}}' AS raw_json
FROM documents
"""
ORACLES["deep_sanitize"] = f"""
WITH {_SECRETS} SELECT doc_id, '{{"type": "response_item", "payload": {{"type": "message", "content": '
  || '[{{"type": "input_text", "text": '
  || CASE WHEN is_secret THEN '"[redacted]"' ELSE CAST(to_json(text) AS VARCHAR) END
  || '}}]}}}}' AS raw_json
FROM secrets
"""

ORACLES["prompt_groups"] = f"""
WITH {_TALK} SELECT file_path, seq, prompt_index, role = 'user' AS is_anchor FROM talk
"""
ORACLES["prompt_groups_activity"] = f"""
WITH {_ACT} SELECT file_path, event_id, prompt_index FROM act
"""
ORACLES["session_prelude"] = f"""
WITH {_ACT} SELECT file_path, seq, log_type AS event_type, payload_type, stamp AS timestamp
FROM act WHERE prompt_index = 0
"""
ORACLES["prompts"] = f"""
WITH {_TALK} SELECT file_path, prompt_index, seq, stamp AS timestamp, text AS message
FROM talk WHERE role = 'user'
"""
_ENV = """
env AS (
  SELECT *, turn BETWEEN 1 AND 2 AND (conv_id + turn) % 3 <> 0 AS described,
    CASE WHEN conv_id % 4 <> 0 THEN '/w/' || turn END AS env_cwd,
    CASE WHEN turn = 1 THEN 'full' END AS env_mode
  FROM talk)"""
ORACLES["session_rows"] = f"""
WITH {_TALK}, {_ENV}, folded AS (
  SELECT file_path, conv_id,
    max(CASE WHEN turn = 0 THEN stamp END) AS first_stamp,
    bool_or(described) AS has_env,
    coalesce(arg_max(env_cwd, turn) FILTER (described AND env_cwd IS NOT NULL),
             CASE WHEN conv_id % 3 <> 0 THEN '/home/' || conv_id END) AS cwd,
    max(turn) FILTER (described) AS last_env
  FROM env GROUP BY file_path, conv_id)
SELECT file_path, CASE WHEN conv_id % 5 <> 0 THEN 's' || conv_id END AS session_id,
  CASE WHEN conv_id % 2 = 0 THEN 'p' || conv_id ELSE first_stamp END AS session_timestamp,
  cwd, CASE WHEN has_env THEN 'never' END AS approval_policy,
  CASE WHEN last_env = 1 THEN 'full' END AS sandbox_mode,
  CASE WHEN has_env THEN 'on' END AS network_access
FROM folded
"""
ORACLES["environment_contexts"] = f"""
WITH {_TALK}, {_ENV} SELECT file_path, seq,
  CASE WHEN described THEN env_cwd END AS cwd,
  CASE WHEN described THEN 'never' END AS approval_policy,
  CASE WHEN described THEN env_mode END AS sandbox_mode,
  CASE WHEN described THEN 'on' END AS network_access
FROM env WHERE turn BETWEEN 1 AND 2
"""
_SYSTEM_LINE = """'{"timestamp":"' || stamp || '","type":"response_item","payload":{"type":"message",'
    || '"role":"system","content":[{"type":"input_text","text":'
    || CAST(to_json(text) AS VARCHAR) || '}]}}'"""
_ANSWER_LINE = """'{"timestamp":"' || stamp || '","type":"event_msg","payload":{"type":"agent_message",'
    || '"message":' || CAST(to_json(text) AS VARCHAR) || '}}'"""
ORACLES["session_documents"] = f"""
WITH {_TALK}, p AS (
  SELECT file_path, seq, CASE role WHEN 'system' THEN {_SYSTEM_LINE} ELSE {_ANSWER_LINE} END AS line
  FROM talk WHERE prompt_index = 0)
SELECT t.file_path,
  '{{"events": [' || coalesce(string_agg(line, ', ' ORDER BY p.seq), '') || ']}}' AS raw_json,
  CAST(CASE WHEN count(line) > 0 THEN 1 ELSE 0 END AS BIGINT) AS prelude_parts
FROM (SELECT DISTINCT file_path FROM talk) t LEFT JOIN p ON p.file_path = t.file_path
GROUP BY t.file_path
"""
ORACLES["tag_values"] = """
SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN trim('a<cwd>b ' || text) WHEN 2 THEN trim(text) END AS cwd
FROM documents
"""

ORACLES["base_events"] = f"""
WITH {_ACT} SELECT file_path, prompt_index, seq, stamp AS timestamp, payload_type AS event_type,
  CASE WHEN event_type = 'error' AND k % 8 = 0 THEN 'tool' ELSE 'other' END AS category,
  CASE WHEN event_type = 'error' AND k % 8 = 1 THEN 'high' ELSE 'medium' END AS priority,
  CAST(NULL AS VARCHAR) AS session_id
FROM act WHERE {_MEMBERS} AND log_type = 'event_msg'
"""
ORACLES["base_event_documents"] = f"""
WITH {_TALK} SELECT file_path, seq,
  '{{"type":"agent_message","message":' || CAST(to_json(text) AS VARCHAR) || '}}' AS data,
  {_ANSWER_LINE} AS raw_json
FROM talk WHERE prompt_index > 0 AND role = 'assistant'
"""
ORACLES["token_messages"] = f"""
WITH {_ACT} SELECT file_path, prompt_index, seq, stamp AS timestamp,
  value AS primary_used_percent, k AS primary_window_minutes,
  CAST(CASE WHEN k % 3 = 0 OR k = 0 THEN k ELSE k * 1000 END AS VARCHAR) AS primary_resets,
  CAST(CASE WHEN k % 2 = 1 THEN k END AS DOUBLE) AS secondary_used_percent,
  CAST(NULL AS BIGINT) AS secondary_window_minutes,
  CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) END AS secondary_resets
FROM act WHERE {_MEMBERS} AND payload_type = 'token_count'
"""
ORACLES["turn_context_messages"] = f"""
WITH {_ACT} SELECT file_path, prompt_index, seq, stamp AS timestamp, '/w/' || k AS cwd,
  'never' AS approval_policy, CASE WHEN k % 20 = 9 THEN 'read-only' END AS sandbox_mode,
  CASE WHEN k % 20 = 9 THEN '1' ELSE '0' END AS network_access,
  '/tmp, /r' || k AS writable_roots
FROM act WHERE {_MEMBERS} AND log_type = 'turn_context'
"""
ORACLES["agent_reasoning_messages"] = f"""
WITH {_ACT} SELECT file_path, prompt_index, seq, stamp AS timestamp,
  CASE WHEN k % 4 <= 1 THEN 'event_msg' WHEN k % 4 = 2 THEN 'turn_aborted'
       ELSE 'agent_message' END AS source,
  CASE WHEN k % 4 <= 1 THEN 'note ' || k WHEN k % 4 = 2 THEN 'content ' || k END AS text
FROM act WHERE {_MEMBERS} AND event_type = 'error'
"""
ORACLES["function_plan_messages"] = f"""
WITH {_ACT} SELECT file_path, prompt_index, seq, stamp AS timestamp, name, props AS arguments
FROM act WHERE {_MEMBERS} AND event_type = 'click' AND name = 'update_plan'
"""
ORACLES["tool_calls"] = f"""
WITH {_ACT} SELECT file_path, prompt_index, seq, stamp AS timestamp, name, call_id,
  props AS arguments
FROM act WHERE {_MEMBERS} AND event_type = 'click' AND name <> 'update_plan'
"""

# Call matching: ids by lag; the waiting line by a recursion that follows its length
# row by row.
_STEPS = f"""
steps AS (
  SELECT file_path, prompt_index, seq, event_type = 'click' AS is_call, call_id AS match_id
  FROM act WHERE {_MEMBERS} AND (event_type = 'purchase'
                                 OR (event_type = 'click' AND name <> 'update_plan'))),
matched AS (
  SELECT *, CASE WHEN NOT is_call AND match_id IS NOT NULL AND lag(is_call) OVER w
                 THEN lag(seq) OVER w END AS call_seq
  FROM steps WINDOW w AS (PARTITION BY file_path, prompt_index, match_id ORDER BY seq))"""
_LINE = """
rest AS (
  SELECT *, row_number() OVER (PARTITION BY file_path, prompt_index ORDER BY seq) AS n
  FROM matched WHERE (is_call AND match_id IS NULL) OR (NOT is_call AND call_seq IS NULL)),
walk AS (
  SELECT file_path, prompt_index, seq, n, is_call, NOT is_call AS is_stub,
         CAST(1 AS BIGINT) AS waiting
  FROM rest WHERE n = 1
  UNION ALL
  SELECT r.file_path, r.prompt_index, r.seq, r.n, r.is_call, NOT r.is_call AND w.waiting = 0,
         CAST(CASE WHEN r.is_call THEN w.waiting + 1 WHEN w.waiting > 0 THEN w.waiting - 1
                   ELSE 1 END AS BIGINT)
  FROM walk w JOIN rest r ON r.file_path = w.file_path AND r.prompt_index = w.prompt_index
                         AND r.n = w.n + 1),
line AS (
  SELECT file_path, prompt_index, seq, is_call, is_stub,
    CASE WHEN is_call OR is_stub THEN row_number() OVER (
      PARTITION BY file_path, prompt_index, is_call OR is_stub ORDER BY seq) END AS enter_no,
    CASE WHEN NOT (is_call OR is_stub) THEN row_number() OVER (
      PARTITION BY file_path, prompt_index, is_call OR is_stub ORDER BY seq) END AS take_no
  FROM walk)"""
_CALLS = f"{_ACT}, {_STEPS}, {_LINE}"
ORACLES["call_id_matches"] = f"WITH {_ACT}, {_STEPS} SELECT * FROM matched"
ORACLES["call_waiting_line"] = f"WITH RECURSIVE {_CALLS} SELECT * FROM line"
_PAIRS = """
pairs AS (
  SELECT e.file_path, e.prompt_index, e.seq, CASE WHEN e.is_call THEN e.seq END AS call_seq,
         coalesce(t.seq, CASE WHEN e.is_stub THEN e.seq END) AS output_seq
  FROM line e LEFT JOIN line t ON t.file_path = e.file_path
    AND t.prompt_index = e.prompt_index AND t.take_no = e.enter_no
  WHERE e.enter_no IS NOT NULL
  UNION ALL
  SELECT c.file_path, c.prompt_index, c.seq, c.seq, o.seq
  FROM matched c LEFT JOIN matched o ON o.file_path = c.file_path AND o.call_seq = c.seq
  WHERE c.is_call AND c.match_id IS NOT NULL)"""
ORACLES["function_calls"] = f"""
WITH RECURSIVE {_CALLS}, {_PAIRS}
SELECT p.file_path, p.prompt_index, p.seq, c.stamp AS call_timestamp,
  o.stamp AS output_timestamp, c.name, c.call_id, c.props AS arguments,
  'out ' || o.event_id AS output
FROM pairs p LEFT JOIN act c ON c.file_path = p.file_path AND c.seq = p.call_seq
LEFT JOIN act o ON o.file_path = p.file_path AND o.seq = p.output_seq
"""

ORACLES["growing_calls"] = f"""
WITH RECURSIVE {_CALLS}, {_PAIRS}
SELECT file_path, prompt_index, seq AS row_seq, call_seq, output_seq FROM pairs
"""
ORACLES["calls_in_context"] = f"""
WITH {_ACT}, contexts AS (SELECT file_path, seq, k FROM act WHERE log_type = 'turn_context')
SELECT c.file_path, c.prompt_index, c.seq, c.name, c.call_id, x.seq AS context_seq,
  '/w/' || x.k AS cwd, CASE WHEN x.seq IS NOT NULL THEN 'never' END AS approval_policy,
  CASE WHEN x.k % 20 = 9 THEN 'read-only' END AS sandbox_mode
FROM (SELECT * FROM act WHERE {_MEMBERS} AND event_type = 'click' AND name <> 'update_plan') c
ASOF LEFT JOIN contexts x ON c.file_path = x.file_path AND c.seq >= x.seq
"""
ORACLES["event_rollup"] = f"""
WITH {_ACT} SELECT substr(stamp, 1, 10) AS day, file_path,
  CASE grouping(substr(stamp, 1, 10), file_path) WHEN 0 THEN 'file' WHEN 1 THEN 'day' ELSE 'all' END AS level,
  count(*) AS events, count(*) FILTER (event_type = 'signup') AS prompts,
  count(*) FILTER (event_type = 'click') AS calls, count(*) FILTER (event_type = 'purchase') AS outputs,
  count(*) FILTER (log_type = 'turn_context') AS contexts
FROM act GROUP BY ROLLUP (substr(stamp, 1, 10), file_path)
"""

ORACLES["prompt_template"] = """
WITH cut AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines,
    list_position(list_transform(string_split(text, chr(10)),
                                 lambda x: starts_with(trim(x), '## ')), true) AS stop
  FROM documents),
kept AS (
  SELECT *, list_filter(list_transform(CASE WHEN stop IS NULL THEN lines ELSE lines[1:stop - 1] END,
                                       lambda x: rtrim(x)), lambda x: x <> '') AS body FROM cut)
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS active_file,
  'tab ' || doc_id || chr(10) || 'plain.py' AS open_tabs,
  nullif(trim(array_to_string(body, chr(10))), '') AS my_request
FROM kept
"""
_MARKED = """
t0 AS (
  SELECT doc_id, text || ' Mail A' || doc_id || '@Example.org or bearer  tok' || doc_id
    || '-abcdef [redact' || chr(10) || 'pw' || CASE WHEN doc_id % 2 = 0 THEN '=1' ELSE '' END
    || '] see C:\\dir\\' || doc_id || ' and [long note of ' || doc_id || '] in /var/log/'
    || doc_id AS t FROM documents)"""
# The patterns of the default rules.
_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "i"),
    "bearer_token": (r"bearer\s+[A-Za-z0-9._-]{8,}", "i"),
    "file_paths": (r"(?:[A-Za-z]:\\[^\s]+|/[^\s]+)", "i"),
    "bracketed_troubleshooting": (r"\[[^\]]{8,}\]", "i"),
    "inline_marker": (r"\[redact\s+(?P<content>.+?)\]", "is"),
}


def _rule_chain(names: list[str], keep: str, start: str = "t0") -> tuple[str, str, str]:
    """CTEs that apply rules one after the other; the last name; the count columns."""
    steps, last, counts = [], start, []
    for n, name in enumerate(names, 1):
        pattern, flags = _PATTERNS[name]
        steps.append(
            f"{start}_{n} AS (SELECT {keep}{''.join(', ' + c for c in counts)}, "
            f"CAST(len(regexp_extract_all(t, '{pattern}', 0, '{flags}')) AS BIGINT) AS n_{name}, "
            f"regexp_replace(t, '{pattern}', '<REDACTED>', 'g{flags}') AS t FROM {last})"
        )
        last = f"{start}_{n}"
        counts.append(f"n_{name}")
    return ",\n".join(steps), last, ", ".join(counts)


_chain, _last, _counts = _rule_chain(list(_PATTERNS), "doc_id")
ORACLES["rule_redaction"] = (
    f"WITH {_MARKED}, {_chain} SELECT doc_id, t AS redacted, {_counts} FROM {_last}"
)
ORACLES["literal_rules"] = r"""
WITH a AS (SELECT doc_id, '(the. ' || text AS t FROM documents),
b AS (SELECT doc_id, len(regexp_extract_all(t, '\(the\.', 0, 'i')) AS n1,
             regexp_replace(t, '\(the\.', '$1\\', 'gi') AS t FROM a),
c AS (SELECT doc_id, n1, len(regexp_extract_all(t, 'the', 0, 'i')) AS n2,
             regexp_replace(t, 'the', '<REDACTED>', 'gi') AS t FROM b),
d AS (SELECT doc_id, n1, n2,
             len(regexp_extract_all(t, 'Que(?:[^\pL\pN_]|$)')) AS n3,
             regexp_replace(t, 'Que([^\pL\pN_]|$)', '<REDACTED>\1', 'g') AS t FROM c)
SELECT doc_id, t AS redacted, rule_id, CAST(n AS BIGINT) AS n FROM (
  SELECT doc_id, t, 'braces' AS rule_id, n1 AS n FROM d
  UNION ALL SELECT doc_id, t, 'word', n2 FROM d
  UNION ALL SELECT doc_id, t, 'exact', n3 FROM d)
WHERE n > 0
"""
_user, _user_last, _user_counts = _rule_chain(list(_PATTERNS), "file_path", "u0")
_agent, _agent_last, _agent_counts = _rule_chain(list(_PATTERNS)[:3], "file_path", "a0")
ORACLES["rule_totals"] = f"""
WITH {_TALK}, mixed AS (
  SELECT file_path, role, prompt_index,
         text || ' u' || conv_id || '@mail.org [long note of ' || conv_id || ']' AS t FROM talk),
u0 AS (SELECT file_path, t FROM mixed WHERE role = 'user'),
a0 AS (SELECT file_path, t FROM mixed WHERE role <> 'user' AND prompt_index > 0),
{_user}, {_agent}, agent AS (
  SELECT *, len(regexp_extract_all(t, '[aeiou]{{3}}', 0, 'i')) AS n_vowels FROM {_agent_last}),
counts AS (
  {" UNION ALL ".join(f"SELECT '{n}' AS rule_id, n_{n} AS n FROM {_user_last}" for n in _PATTERNS)}
  UNION ALL
  {" UNION ALL ".join(f"SELECT '{n}', n_{n} FROM agent" for n in [*list(_PATTERNS)[:3], "vowels"])})
SELECT rule_id, CAST(sum(n) AS BIGINT) AS matches FROM counts GROUP BY rule_id HAVING sum(n) > 0
"""

_SAID = "'key' || conv_id || ' ' || replace(text, chr(10), ' ')"
_INGESTED = f"""
{_TALK}, said AS (
  SELECT file_path, conv_id, seq, prompt_index, stamp, role = 'user' AS asked,
    CASE role WHEN 'user' THEN '## Active file: a' || conv_id || '.py' || chr(10)
      || '## My request for Codex:' || chr(10) || {_SAID} || ' [redact pw' || conv_id || 'x] end'
      ELSE {_SAID} || ' end' END AS t FROM talk),
hidden AS (
  SELECT *, regexp_replace(t, 'key[0-9]+', '<KEY>', 'gi') AS told FROM said),
kept AS (
  SELECT *, regexp_replace(told, '\\[redact [a-z0-9]+\\]', '<MARK>', 'gi') AS message,
    '{{"type": "' || CASE WHEN asked THEN 'user_message", "message": ' ELSE 'agent_reasoning", "text": ' END
      || CAST(to_json(told) AS VARCHAR) || '}}' AS data FROM hidden),
whole AS (
  SELECT *, '{{"timestamp": "' || stamp || '", "type": "event_msg", "payload": ' || data
    || '}}' AS raw FROM kept),
first AS (SELECT *, CASE WHEN prompt_index = 1 THEN conv_id % 5 END AS fifth FROM whole WHERE asked)"""
ORACLES["ingest_redaction"] = f"""
WITH {_INGESTED}
SELECT file_path, seq AS place, 'prompts.message' AS stored,
  CASE WHEN fifth = 0 THEN '<MANUAL>' ELSE message END AS text FROM first
UNION ALL SELECT file_path, seq, 'prompts.active_file', '<FILE>' FROM first
UNION ALL SELECT file_path, seq, 'prompts.my_request', CASE WHEN fifth = 1 THEN '<MINE>'
  ELSE split_part(message, chr(10), 3) END FROM first
UNION ALL SELECT file_path, seq, 'prompts.raw_json', raw FROM first
UNION ALL SELECT file_path, seq, 'events.data', data FROM whole WHERE NOT asked AND prompt_index > 0
UNION ALL SELECT file_path, seq, 'events.raw_json', raw FROM whole WHERE NOT asked AND prompt_index > 0
UNION ALL SELECT file_path, seq, 'agent_reasoning_messages.text', told FROM whole
  WHERE NOT asked AND prompt_index > 0
UNION ALL SELECT file_path, seq, 'agent_reasoning_messages.raw_json', raw FROM whole
  WHERE NOT asked AND prompt_index > 0
UNION ALL SELECT file_path, 0, 'prelude_parts.events_json', string_agg(raw, ', ' ORDER BY seq)
  FROM whole WHERE prompt_index = 0 GROUP BY file_path
"""

_REQUESTS = """
requests AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN 'conv-' || (doc_id % 100) END AS file_path,
    CASE WHEN doc_id % 11 <> 0 THEN 1 + doc_id % 3 END AS prompt_index,
    CASE WHEN doc_id % 17 = 0 THEN 'page' WHEN doc_id % 3 = 0 THEN 'prompt'
         WHEN doc_id % 3 = 1 THEN 'field' ELSE 'global' END AS scope,
    CASE WHEN doc_id % 3 <> 1 OR doc_id % 5 <= 1 THEN NULL ELSE 'message' END AS field_path,
    CASE WHEN doc_id % 19 = 0 THEN '' ELSE '<' || doc_id || '>' END AS replacement_text,
    CASE WHEN doc_id % 2 = 1 THEN 'why ' || source END AS reason, lang AS actor,
    doc_id % 37 AS day,
    CASE WHEN doc_id % 17 = 0 THEN 'Invalid scope ''page''.'
         WHEN doc_id % 3 = 1 AND doc_id % 5 = 1 THEN 'field_path cannot be blank when provided.'
         WHEN doc_id % 3 = 1 AND doc_id % 5 = 0 THEN 'field_path is required when scope=''field''.'
         WHEN doc_id % 19 = 0 THEN 'replacement_text must be a non-empty string.' END AS error
  FROM documents),
redaction AS (SELECT * FROM requests WHERE error IS NULL)"""
ORACLES["redaction_create"] = f"""
WITH {_REQUESTS} SELECT id, file_path, prompt_index, scope, field_path, replacement_text, reason,
  actor, error FROM requests
"""
ORACLES["redaction_get"] = f"""
WITH {_REQUESTS} SELECT id, file_path, prompt_index, scope, field_path, replacement_text, reason,
  actor FROM redaction WHERE id = 2
"""
ORACLES["redaction_list"] = f"""
WITH {_REQUESTS} SELECT id, file_path, prompt_index, replacement_text FROM redaction
WHERE scope = 'global' ORDER BY day DESC, id DESC
"""
ORACLES["redaction_update"] = f"""
WITH {_REQUESTS}, patch AS (
  SELECT doc_id, toxic = 1 AS to_field, quality = 1 AS better, doc_id % 7 = 0 AS blanked,
         NOT (toxic <> 1 AND doc_id % 23 = 0)
           AND (toxic = 1 OR quality = 1 OR doc_id % 7 = 0) AS ok
  FROM labels)
SELECT id, CASE WHEN ok AND to_field THEN 'field' ELSE scope END AS scope, field_path,
  CASE WHEN ok AND better THEN 'better' ELSE replacement_text END AS replacement_text,
  CASE WHEN ok AND blanked THEN NULL ELSE reason END AS reason, actor,
  coalesce(ok, false) AS updated
FROM redaction LEFT JOIN patch ON doc_id = id
"""
ORACLES["redaction_delete"] = f"""
WITH {_REQUESTS} SELECT id, scope FROM redaction WHERE id NOT IN (SELECT doc_id FROM labels)
"""
ORACLES["manual_redactions"] = f"""
WITH {_TALK}, {_REQUESTS}, aimed AS (
  SELECT *, unnest(CASE scope WHEN 'prompt' THEN ['message'] WHEN 'field' THEN [field_path]
                              ELSE ['message', 'my_request'] END) AS col FROM redaction),
hit AS (
  SELECT t.file_path, t.prompt_index, col,
         arg_max(replacement_text, struct_pack(d := day, i := id)) AS new
  FROM talk t JOIN aimed a
    ON (a.file_path = t.file_path AND a.prompt_index = t.prompt_index)
    OR (a.file_path IS NULL AND a.scope <> 'prompt')
  WHERE t.role = 'user' GROUP BY ALL)
SELECT t.file_path, t.prompt_index, coalesce(m.new, t.text) AS message, r.new AS my_request
FROM talk t
LEFT JOIN hit m ON m.file_path = t.file_path AND m.prompt_index = t.prompt_index AND m.col = 'message'
LEFT JOIN hit r ON r.file_path = t.file_path AND r.prompt_index = t.prompt_index
  AND r.col = 'my_request'
WHERE t.role = 'user'
"""

_SUMMARY = f"""
{_CALLS}, {_PAIRS}, counted AS (
  SELECT file_path, count(*) AS n FROM pairs GROUP BY file_path),
summaries AS (
  SELECT a.file_path, count(*) FILTER (event_type = 'signup') AS prompts,
    count(*) FILTER ({_MEMBERS} AND payload_type = 'token_count') AS token_messages,
    count(*) FILTER ({_MEMBERS} AND log_type = 'turn_context') AS turn_context_messages,
    count(*) FILTER ({_MEMBERS} AND event_type = 'error') AS agent_reasoning_messages,
    count(*) FILTER ({_MEMBERS} AND event_type = 'click' AND name = 'update_plan')
      AS function_plan_messages,
    coalesce(max(c.n), 0) AS function_calls, CAST(0 AS BIGINT) AS errors
  FROM act a LEFT JOIN counted c ON c.file_path = a.file_path GROUP BY a.file_path)"""
ORACLES["session_summaries"] = f"WITH RECURSIVE {_SUMMARY} SELECT * FROM summaries"
ORACLES["summary_totals"] = f"""
WITH RECURSIVE {_SUMMARY} SELECT count(*) AS files_processed,
  {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (
      "prompts", "token_messages", "turn_context_messages", "agent_reasoning_messages",
      "function_plan_messages", "function_calls", "errors"))}
FROM summaries
"""
ORACLES["summary_error_lists"] = f"""
WITH {_FLAWED} SELECT file_path, count(*) FILTER (event_error IS NOT NULL) AS errors,
  coalesce(string_agg(CAST(event_index AS VARCHAR), ',' ORDER BY event_index)
    FILTER (event_error IS NOT NULL), '') AS lines
FROM flawed GROUP BY file_path
"""
ORACLES["summary_error_parts"] = f"""
WITH {_FLAWED}, wrong AS (
  SELECT file_path, event_index,
    (row_number() OVER (PARTITION BY file_path ORDER BY event_index) - 1) // 10 AS part
  FROM flawed WHERE event_error IS NOT NULL)
SELECT file_path, part, string_agg(CAST(event_index AS VARCHAR), ',' ORDER BY event_index) AS lines
FROM wrong GROUP BY file_path, part
"""
_ALL = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
ORACLES["table_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _ALL
)
ORACLES["max_ids"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, greatest(coalesce(max({k}), 0), 1) AS max_id FROM {t}"
    for t, k in (
        ("orders", "o_orderkey"),
        ("customer", "c_custkey"),
        ("events", "event_id"),
        ("documents", "doc_id"),
        ("pages", "page_id"),
    )
)
ORACLES["replaced_files"] = """
SELECT 'cust-' || o_custkey AS file_path, o_orderkey,
  CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS message
FROM orders
"""
ORACLES["refreshed_files"] = """
SELECT 'cust-' || c_custkey AS file_path, c_custkey % 3 = 0 AS refreshed
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
"""
ORACLES["file_ids"] = """
SELECT file_path, row_number() OVER (ORDER BY file_path) AS file_id
FROM (SELECT DISTINCT 'user-' || user_id AS file_path FROM events)
"""
_COPIED = {
    "files": "SELECT DISTINCT user_id FROM events",
    "sessions": "SELECT DISTINCT user_id FROM events",
    "prompts": f"WITH {_ACT} SELECT * FROM act WHERE event_type = 'signup'",
    "redactions": f"WITH {_REQUESTS} SELECT * FROM redaction",
    **{
        name: ORACLES[name]
        for name in (
            "token_messages turn_context_messages agent_reasoning_messages "
            "function_plan_messages function_calls"
        ).split()
    },
    "events": ORACLES["base_events"],
}
ORACLES["table_copy"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS source_rows, count(*) AS target_rows FROM ({rows})"
    for t, rows in _COPIED.items()
)


def _short(text: str, limit: int) -> str:
    keep = str(limit - 3) if limit >= 3 else f"greatest(length({text}) - {3 - limit}, 0)"
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} "
        f"ELSE rtrim(substr({text}, 1, {keep}), ' ' || chr(10)) || '...' END"
    )


ORACLES["shortened_texts"] = f"""
WITH d AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS t FROM documents)
SELECT doc_id, {_short("t", 120)} AS short_120, {_short("t", 500)} AS short_500,
  {_short("t", 2)} AS short_2
FROM d
"""
ORACLES["event_descriptions"] = f"""
WITH {_ACT} SELECT file_path, seq,
  log_type || coalesce(' (' || payload_type || ')', '') || ' @ ' || stamp || CASE
    WHEN log_type = 'turn_context' THEN chr(10) || '    cwd: /w/' || k
    WHEN payload_type = 'token_count' THEN
      chr(10) || '    primary: ' || value || '% used of ' || k || ' min window, resets '
      || CASE WHEN k % 3 = 0 THEN k ELSE k * 1000 END
      || CASE WHEN k % 2 = 1 THEN chr(10) || '    secondary: ' || k
           || '% used of None min window, resets ' || k ELSE '' END
    WHEN payload_type = 'function_call' THEN
      chr(10) || '    function: ' || name || chr(10) || '    args: ' || props
    WHEN payload_type = 'function_call_output' THEN chr(10) || '    output: out ' || event_id
    WHEN payload_type = 'agent_reasoning' AND k % 4 = 0 THEN chr(10) || '    reasoning: note ' || k
    WHEN payload_type = 'turn_aborted' THEN chr(10) || '    reason: interrupted'
    WHEN payload_type = 'agent_message' THEN chr(10) || '    message: note ' || k
    ELSE '' END AS description
FROM act
"""


def _indented(text: str, prefix: str) -> str:
    """Prefix on each line that is not blank."""
    return (
        f"array_to_string(list_transform(string_split({text}, chr(10)), "
        f"lambda x: CASE WHEN trim(x) = '' THEN x ELSE '{prefix}' || x END), chr(10))"
    )


_SHORT = _short("trim(text, ' ' || chr(10))", 500)
_REPORT = f"""
{_TALK}, said AS (SELECT *, {_SHORT} AS short FROM talk),
groups AS (
  SELECT file_path, prompt_index, count(*) FILTER (role <> 'user') AS n,
         min(seq) FILTER (role = 'user') AS anchor FROM talk GROUP BY ALL),
entries AS (
  SELECT DISTINCT file_path, 0 AS prompt_index, 0 AS seq, 0 AS part,
         'Session file: ' || file_path AS text FROM talk
  UNION ALL SELECT file_path, 0, 0, 1, '' FROM groups WHERE prompt_index = 0
  UNION ALL SELECT file_path, 0, 0, 2, '-- Session Prelude --' FROM groups WHERE prompt_index = 0
  UNION ALL SELECT file_path, 0, 4611686018427387904, 0,
                   chr(10) || 'No user messages found in session.'
  FROM groups GROUP BY file_path HAVING max(prompt_index) = 0
  UNION ALL SELECT file_path, prompt_index, seq, 0,
                   chr(10) || '== Prompt ' || prompt_index || ' @ ' || stamp || ' =='
  FROM said WHERE role = 'user'
  UNION ALL SELECT file_path, prompt_index, seq, 1, {_indented("short", "  ")}
  FROM said WHERE role = 'user'
  UNION ALL SELECT file_path, prompt_index, anchor, 2,
    CASE WHEN n = 0 THEN '  (No subsequent events recorded.)' ELSE '  -- Following events --' END
  FROM groups WHERE prompt_index > 0
  UNION ALL SELECT file_path, prompt_index, seq, 2, {{events}}
  FROM said WHERE role <> 'user')"""
_shown = _indented(
    "CASE role WHEN 'system' THEN 'response_item (message) @ ' ELSE 'event_msg (agent_message) @ ' END"
    " || stamp || chr(10) || " + _indented("short", "    message: "),
    "@",
)
_REPORT = _REPORT.replace(
    "{events}",
    f"CASE WHEN prompt_index > 0 THEN {_shown.replace('@' + chr(39) + ' || x', '    ' + chr(39) + ' || x')} "
    f"ELSE {_shown.replace('@' + chr(39) + ' || x', '  ' + chr(39) + ' || x')} END",
)
ORACLES["session_report"] = f"WITH {_REPORT} SELECT * FROM entries"
ORACLES["session_report_texts"] = f"""
WITH {_REPORT} SELECT file_path, seq // 16384 AS part,
  string_agg(text, chr(10) ORDER BY prompt_index, seq, entries.part) AS text
FROM entries GROUP BY ALL
"""

_STRICT = """
strict AS (
  SELECT 'conv-' || conv_id AS file_path, conv_id, turn, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq,
    strftime(TIMESTAMP '2025-01-01' + to_seconds(turn), '%Y-%m-%dT%H:%M:%S') AS stamp,
    TIMESTAMP '2025-01-01' + to_seconds(turn) - CASE WHEN conv_id % 2 = 1
      THEN INTERVAL '5399.5 seconds' ELSE INTERVAL '0 seconds' END AS instant,
    turn = 0 AND conv_id % 13 = 10 AS is_blank,
    conv_id % 10 = 3 AND turn = 2 AS is_broken,
    CASE WHEN conv_id % 10 = 7 AND turn = 3 THEN 'unknown'
         WHEN turn % 4 = 1 THEN CASE WHEN role = 'user' THEN 'user_message' ELSE 'ai_response' END
         WHEN turn % 4 = 2 THEN 'tool_call' WHEN turn % 4 = 3 THEN 'tool_result'
         ELSE 'user_message' END AS kind
  FROM conversations),
checked AS (
  SELECT *, CASE WHEN turn = 0 THEN conv_id % 13 <> 11 ELSE kind <> 'unknown' END AS is_valid,
    stamp || CASE WHEN conv_id % 2 = 0 THEN '+00:00' ELSE '.500000+01:30' END AS timestamp_text
  FROM strict),
failures AS (
  SELECT file_path, min(seq) AS line_number FROM checked
  WHERE NOT is_blank AND (is_broken OR NOT is_valid) GROUP BY file_path),
good AS (
  SELECT c.*, 's' || conv_id AS session_id FROM checked c LEFT JOIN failures f USING (file_path)
  WHERE conv_id % 13 NOT IN (10, 11, 12) AND turn > 0
    AND (line_number IS NULL OR seq < line_number))"""
ORACLES["log_metadata"] = f"""
WITH {_STRICT}, first AS (
  SELECT *, CASE conv_id % 13 WHEN 10 THEN 'Empty log file'
    WHEN 11 THEN 'Invalid timestamp format: Invalid isoformat string: ''yesterday'''
    WHEN 12 THEN 'Missing or invalid session ID' END AS error
  FROM checked WHERE seq = 1)
SELECT file_path, CASE WHEN error IS NULL THEN 'codex' END AS agent_type,
  CASE WHEN error IS NULL THEN 's' || conv_id END AS session_id,
  CASE WHEN error IS NULL THEN CAST(instant AS VARCHAR) END AS timestamp,
  CASE WHEN error IS NULL THEN '/w/' || conv_id END AS workspace_path,
  CAST(NULL AS VARCHAR) AS version, error
FROM first
"""
ORACLES["strict_validation"] = f"""
WITH {_STRICT} SELECT file_path, seq, is_valid FROM checked WHERE NOT is_blank AND NOT is_broken
"""
ORACLES["strict_failures"] = f"""
WITH {_STRICT} SELECT f.file_path, f.line_number,
  CASE WHEN is_broken THEN 'Invalid JSON' ELSE 'Event failed validation' END AS error
FROM failures f JOIN checked c ON c.file_path = f.file_path AND c.seq = f.line_number
"""
ORACLES["strict_messages"] = f"""
WITH {_STRICT} SELECT file_path, seq, 'codex' AS agent_type,
  CAST(instant AS VARCHAR) AS timestamp, timestamp_text, kind AS event_type,
  CASE kind WHEN 'user_message' THEN 1 ELSE 2 END AS event_category, 1 AS priority, session_id,
  text AS content, kind = 'user_message' AS is_user
FROM good WHERE kind IN ('user_message', 'ai_response')
"""
ORACLES["strict_actions"] = f"""
WITH {_STRICT} SELECT file_path, seq, 'codex' AS agent_type, timestamp_text,
  'action.' || kind AS event_type, CASE kind WHEN 'tool_call' THEN 4 ELSE 5 END AS event_category,
  2 AS priority, session_id, kind AS action_type, 'tool' || (conv_id % 3) AS tool_name,
  CASE WHEN turn % 4 = 2 THEN '{{"turn":' || turn || '}}' END AS parameters,
  CASE WHEN turn % 4 = 3 THEN 'ok ' || turn END AS result
FROM good WHERE kind IN ('tool_call', 'tool_result')
"""
ORACLES["event_records"] = f"""
WITH {_STRICT} SELECT file_path, seq, timestamp_text,
  CASE WHEN kind LIKE 'tool%' THEN 'action.' || kind ELSE kind END AS event_type,
  CASE kind WHEN 'user_message' THEN 1 WHEN 'ai_response' THEN 2 WHEN 'tool_call' THEN 4
    ELSE 5 END AS event_category,
  session_id, CASE WHEN kind LIKE 'tool%' THEN 'tool' || (conv_id % 3) ELSE text END AS body
FROM good
"""

ORACLES["rule_records"] = """
WITH r AS (
  SELECT CAST(doc_id AS INTEGER) AS position, doc_id AS d,
    CASE WHEN doc_id % 13 <> 0 THEN 'r' || doc_id % 400 END AS id,
    CASE WHEN doc_id % 17 <> 0 THEN CASE doc_id % 4 WHEN 0 THEN 'regex' WHEN 1 THEN 'literal'
      WHEN 2 THEN 'marker' ELSE 'glob' END END AS type,
    CASE WHEN doc_id % 19 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(9)
      ELSE CAST(doc_id AS VARCHAR) END END AS pattern,
    CASE WHEN doc_id % 3 = 0 THEN 'global' WHEN doc_id % 3 = 2 THEN 'field'
      WHEN doc_id % 2 = 0 THEN 'page' ELSE 'prompt' END AS scope,
    CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS replacement,
    doc_id % 6 NOT IN (0, 1) AS enabled,
    CASE WHEN doc_id % 2 = 1 THEN trim('why ' || source) END AS reason,
    nullif(trim(lang), '') AS actor, doc_id % 5 <> 1 AS ignore_case, doc_id % 5 = 2 AS dotall
  FROM documents)
SELECT * EXCLUDE (d), CASE
  WHEN id IS NULL THEN 'Missing key ''id''.' WHEN type IS NULL THEN 'Missing key ''type''.'
  WHEN pattern IS NULL THEN 'Missing key ''pattern''.'
  WHEN type = 'glob' THEN 'Unknown type ''glob''.'
  WHEN d % 5 = 0 THEN 'The pattern is empty.'
  WHEN scope = 'page' THEN 'Unknown scope ''page''.'
  WHEN row_number() OVER (PARTITION BY id ORDER BY position) > 1
    THEN concat('Repeated id ', chr(39), id, chr(39), '.') END AS error
FROM r
"""
