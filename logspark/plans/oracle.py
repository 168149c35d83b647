"""DuckDB SQL twins of the registered queries (the correctness oracle).

The SQL is written independently of the Spark expressions: JSON through
DuckDB's json_* functions, the HTTP status patterns in their original RE2
dialect, substring rules as ``contains``.  Only the fixed rule tables are
shared, because they are data, not logic.
"""

from __future__ import annotations

from logspark.functions import rules as R
from logspark.sources import adapters as AD

# Unicode White_Space in RE2 syntax
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
NWS = r"[^\t\n\x0B\f\r\x{85}\p{Z}]"


def lit(s) -> str:
    """SQL literal; control characters are spliced in with chr()."""
    if s is None:
        return "NULL"
    if isinstance(s, (int, float)):
        return repr(s)
    parts, buf = [], ""
    for ch in s:
        if ch in "\n\t\r":
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")" if words else "TRUE"


def first_of(col: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {lit(p)}) THEN {lit(v)}" for p, v in pairs) + " END"


def case_index(expr: str, values) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values) if v is not None) + " END"


def raw_logs_sql(events: str = "events") -> str:
    d = "CAST(floor(value * 20) AS BIGINT)"
    g, k = "(event_id // 8)", "json_extract_string(props, '$.k')"
    words = f"([{', '.join(lit(w) for w in AD.RULE_WORDS)}])[{g} % {len(AD.RULE_WORDS)} + 1]"
    body = (
        "CASE WHEN event_id % 8 IN (3, 5) THEN props "
        f"WHEN event_id % 8 = 7 THEN CASE {g} % 16 "
        f"WHEN 2 THEN '{{\"k\":0,\"k\":' || {k} || '}}' "
        f"WHEN 5 THEN '{{\"duration_ms\":' || {d} || ',\"user_id\":' || user_id || '}}' "
        f"WHEN 6 THEN '{{\"elapsed_ms\":\"' || {d} || '\"}}' "
        "WHEN 7 THEN '{\"service\":\"' || event_type || '-desk\"}' "
        f"WHEN 9 THEN '{{\"bytes\":' || {d} || ',\"status\":' || (user_id % 600) || '}}' "
        + " ".join(f"WHEN {i} THEN {lit(b)}" for i, b in enumerate(AD.BODY_CYCLE) if b is not None) + " END END"
    )
    return f"""SELECT event_id AS id, ts AS created_at,
  CASE WHEN event_id % 2 = 0 THEN event_type || ' ' || event_id || ': ' || {words}
       WHEN event_id % 8 = 1 THEN event_type || ' returned ' || ({g} % 500 + 100)
       WHEN event_id % 8 = 3 THEN '[' || event_type || '] user ' || user_id
       WHEN event_id % 8 = 5 THEN event_type || ': step ' || {k} || ' of user ' || user_id
       WHEN {g} % 16 = 0 THEN '' ELSE event_type || ' ' || event_id END AS title,
  {case_index(f'{g} % 7', AD.SEVERITY_CYCLE)} AS severity,
  CASE WHEN {g} % 3 = 0 THEN 'api' WHEN {g} % 3 = 1 AND {g} % 2 = 0 THEN 'unknown' END AS source,
  {case_index(f'{g} % 5', AD.COLOR_CYCLE)} AS color,
  CASE WHEN {g} % 4 = 0 THEN 'props ' || props WHEN {g} % 4 = 1 THEN '' END AS description,
  {body} AS body
FROM {events}"""


def access_logs_sql(events: str = "events") -> str:
    statuses = ", ".join(str(s) for s in AD.ACCESS_STATUS_CYCLE)
    return f"""SELECT event_id AS id, '/api/' || event_type AS path,
  CAST(([{statuses}])[event_id % 9 + 1] AS INTEGER) AS status,
  CAST(floor(value * 20) AS BIGINT) AS duration_ms, ts
FROM {events}"""


def document_logs_sql(documents: str = "documents", created_at: str = "2024-01-15 00:00:00") -> str:
    return f"""SELECT doc_id AS id, TIMESTAMP '{created_at}' AS created_at,
  'document from ' || coalesce(source, 'unknown') AS title,
  CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS color,
  text AS description, CAST(NULL AS VARCHAR) AS body
FROM {documents}"""


def conversation_logs_sql(created_at: str = "2024-01-15 00:00:00") -> str:
    return f"""SELECT conv_id * 1000 + turn AS id, TIMESTAMP '{created_at}' AS created_at,
  role || ' turn ' || turn AS title,
  CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS color,
  text AS description, CAST(NULL AS VARCHAR) AS body
FROM conversations"""


#: A JSON object in its stored form: white space gone, the last of equal keys
#: (the two shapes of the adapter that have such keys, by pattern),
#: whole numbers without a fraction, and the escapes of the stored text.
CANONICAL = r"""replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(CAST(json(body) AS VARCHAR), '"(?:k":0,("k":)|a":1,("a":))', '\1\2'), '([0-9])\.0([,}\]])', '\1\2', 'g'),
  '<', '\u003c'), '>', '\u003e'), '&', '\u0026'), chr(8232), '\u2028'), chr(8233), '\u2029')"""


def _duration_sql(body: str = "body") -> str:
    arms = []
    for k in R.DURATION_FIELDS:
        p = f"'$.{k}'"
        v = (f"CASE WHEN json_type({body}, {p}) IN ('BIGINT','UBIGINT','HUGEINT','DOUBLE') "
             f"THEN TRY_CAST(trunc(CAST(json_extract({body}, {p}) AS DOUBLE)) AS BIGINT) "
             f"WHEN json_type({body}, {p}) = 'VARCHAR' AND regexp_full_match(json_extract_string({body}, {p}), '[+-]?[0-9]+') "
             f"THEN TRY_CAST(json_extract_string({body}, {p}) AS BIGINT) END")
        arms.append(f"CASE WHEN ({v}) > 0 THEN ({v}) END")
    return "coalesce(" + ", ".join(arms) + ")"


def _category_sql(tl: str = "text_lower") -> str:
    parts = [f"WHEN {any_of(tl, R.SECURITY_PATTERNS)} THEN 'security'"]
    for name, words in R.CATEGORY_WORDS:
        parts.append(f"WHEN {any_of(tl, words)} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'general' END"


def _keywords_sql(tl: str = "text_lower") -> str:
    groups = (("error", R.ERROR_KEYWORDS), ("warning", R.WARNING_KEYWORDS),
              ("success", R.SUCCESS_KEYWORDS), ("debug", R.DEBUG_KEYWORDS))
    return "CASE " + " ".join(f"WHEN {any_of(tl, w)} THEN '{s}'" for s, w in groups) + " ELSE 'info' END"


def _http_code_sql(t: str = "text") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {lit(p)}, 1), '')"
                                   for p in R.HTTP_STATUS_REGEXES_RE2) + ")"


def _level_sql(d: str) -> str:
    levels = dict(R.LEVEL_SEVERITY)
    arms = " ".join(f"WHEN {d} < {b} THEN '{levels[lv]}'" for b, lv in R.DURATION_LEVELS)
    return f"CASE {arms} ELSE '{levels[R.DURATION_TOP_LEVEL]}' END"


def _smart_source_sql(tl: str = "text_lower") -> str:
    arms = []
    for name, anys, alls, nones in R.SOURCE_RULES:
        cond = [any_of(tl, anys)] if anys else []
        cond += [f"contains({tl}, {lit(w)})" for w in alls]
        cond += [f"NOT contains({tl}, {lit(w)})" for w in nones]
        value = f"'{name}'"
        if name == "database-service":
            value = ("CASE " + " ".join(f"WHEN contains({tl}, '{w}') THEN '{e}'"
                                        for w, e in R.DATABASE_SOURCE_REFINEMENT) + f" ELSE '{name}' END")
        arms.append(f"WHEN {' AND '.join(cond)} THEN {value}")
    return "CASE " + " ".join(arms) + " END"


def _prefix_source_sql(t: str = "title") -> str:
    head = f"split_part({t}, ':', 1)"
    name = f"regexp_replace({head}, '^{WS}+|{WS}+$', '', 'g')"
    bracket = f"CASE WHEN starts_with({t}, '[') THEN nullif(regexp_extract({t}, '^\\[([^\\]]+)\\]', 1), '') END"
    colon = (f"CASE WHEN contains({t}, ':') AND strlen({head}) > 0 AND strlen({head}) < 20 "
             f"AND {name} <> '' AND NOT contains({name}, ' ') THEN {name} END")
    return f"lower(coalesce({bracket}, {colon}))"


def _body_source_sql(body: str = "body") -> str:
    arms = [f"CASE WHEN json_type({body}, '$.{k}') = 'VARCHAR' THEN nullif(json_extract_string({body}, '$.{k}'), '') END"
            for k in R.SOURCE_BODY_FIELDS]
    return "coalesce(" + ", ".join(arms) + ")"


def _service_token_sql(tl: str = "text_lower") -> str:
    tok = f"nullif(regexp_extract(' ' || {tl}, '{WS}({NWS}*[-_]service{NWS}*)', 1), '')"
    return f"trim({tok}, {lit(R.SERVICE_TOKEN_TRIM)})"


def enriched_ctes(raw_sql: str) -> str:
    """CTEs ``raw``, ``norm``, ``accepted``, ``rejected``, ``txt``, ``verdicts``
    and ``logs`` (the stored LOGS shape) over a flat raw-record query."""
    colors = ", ".join(f"'{c}'" for c in R.COLORS)
    stack = any_of("text_lower", [m.lower() for m in R.STACK_MARKERS])
    http_map = "CASE code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in R.HTTP_STATUS_SEVERITY) + " END"
    return f"""raw AS ({raw_sql}),
raw_typed AS (SELECT *, CASE WHEN json_valid(body) THEN json_type(body) END AS body_type FROM raw),
norm AS (
  SELECT id, created_at, title,
    coalesce(nullif(severity, ''), 'info') AS severity,
    nullif(source, '') AS source,
    CASE WHEN lower(color) IN ({colors}) THEN lower(color) END AS color,
    nullif(description, '') AS description,
    body AS body_raw,
    CASE WHEN title IS NULL OR title = '' THEN 'title is required'
         WHEN body IS NOT NULL AND coalesce(body_type NOT IN ('OBJECT', 'NULL'), true)
         THEN 'body must be a JSON object' END AS reject_reason,
    CASE WHEN body_type = 'OBJECT'
         THEN {CANONICAL}
         ELSE '{{}}' END AS body
  FROM raw_typed),
accepted AS (SELECT * EXCLUDE (reject_reason, body_raw) FROM norm WHERE reject_reason IS NULL),
rejected AS (SELECT id, created_at, title, reject_reason AS reason FROM norm WHERE reject_reason IS NOT NULL),
txt0 AS (
  SELECT *, title || coalesce(' ' || description, '') || CASE WHEN body <> '{{}}' THEN ' ' || body ELSE '' END AS text
  FROM accepted),
txt AS (
  SELECT *, lower(text) AS text_lower, {_duration_sql('body')} AS duration_ms FROM txt0),
steps AS (
  SELECT *,
    {_category_sql()} AS base_category,
    {any_of('text_lower', R.SECURITY_PATTERNS)} AS s_security,
    {first_of('text_lower', R.BUSINESS_PATTERNS)} AS s_business,
    {first_of('text_lower', R.PERFORMANCE_PATTERNS)} AS s_perf,
    {_http_code_sql()} AS code,
    {stack} AS s_stack,
    {first_of('text_lower', R.DATABASE_PATTERNS)} AS s_db,
    {first_of('text', R.SYSTEM_ERROR_CODES)} AS s_sys,
    {_keywords_sql()} AS s_kw,
    coalesce(nullif(source, ''), {_body_source_sql('body')}, {_prefix_source_sql('title')},
             {_smart_source_sql()}, {_service_token_sql()}) AS inferred_source
  FROM txt),
steps2 AS (SELECT *, {http_map} AS s_http FROM steps),
verdicts AS (
  SELECT *,
    CASE WHEN s_security THEN 'critical' WHEN s_business IS NOT NULL THEN s_business
         WHEN s_perf IS NOT NULL THEN s_perf WHEN duration_ms IS NOT NULL THEN {_level_sql('duration_ms')}
         WHEN s_http IS NOT NULL THEN s_http WHEN s_stack THEN 'error'
         WHEN s_db IS NOT NULL THEN s_db WHEN s_sys IS NOT NULL THEN s_sys ELSE s_kw END AS v_severity,
    CASE WHEN s_security THEN 'security' WHEN s_business IS NOT NULL THEN 'business'
         WHEN s_perf IS NOT NULL OR duration_ms IS NOT NULL THEN 'performance'
         WHEN s_http IS NOT NULL THEN 'http' WHEN s_stack THEN base_category
         WHEN s_db IS NOT NULL THEN 'database' WHEN s_sys IS NOT NULL THEN 'system' ELSE base_category END AS v_category,
    CASE WHEN s_security THEN 'security' WHEN s_business IS NOT NULL THEN 'business'
         WHEN s_perf IS NOT NULL THEN 'performance' WHEN duration_ms IS NOT NULL THEN 'duration'
         WHEN s_http IS NOT NULL THEN 'http_status' WHEN s_stack THEN 'stack_trace'
         WHEN s_db IS NOT NULL THEN 'database' WHEN s_sys IS NOT NULL THEN 'system_code' ELSE 'keywords' END AS v_rule
  FROM steps2),
logs AS (
  SELECT id, title, severity, source, color, description, body,
    CASE WHEN severity = 'info' AND v_severity <> 'info' THEN v_severity END AS derived_severity,
    CASE WHEN source IS NULL THEN inferred_source END AS derived_source,
    v_category AS derived_category,
    created_at, CAST(created_at AS DATE) AS log_date
  FROM verdicts)"""


def with_logs(select_sql: str, raw_sql: str | None = None) -> str:
    """``WITH <enrichment CTEs> <select_sql>`` over the events adapter."""
    return f"WITH {enriched_ctes(raw_sql or raw_logs_sql())}\n{select_sql}"
