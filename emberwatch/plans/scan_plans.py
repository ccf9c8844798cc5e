"""Queries and oracles of the scan, taint and verdict operators (L, T, U, V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.rules import (
    BASH_RULES, BASH_WORDS, MULTI_RULES, PYTHON_WORDS, SECRET_NAME, SENSITIVE_PATHS, is_secret_name,
    is_sensitive_path, severity_rank,
)
from emberwatch.functions.text import LINE_BREAK_RE, STRIP_CHARS
from emberwatch.operators.line_scan import (
    bash_findings, detect_language, multi_findings, numbered_lines, pick_languages,
)
from emberwatch.operators.policy import Policy, attach_policies, fan_out_policies, normalise_policy
from emberwatch.operators.scan import extract, finding_rows, judge, scan, scan_commands, severity_counts
from emberwatch.operators.taint import candidate_rows, edge_rows
from emberwatch.operators.taint_graph import earliest_taint, firing_uses
from emberwatch.plans.corpus import (
    EXPECTED, EXPECTED_EXTRA, TEMPLATES, expected_sql, quoted, snippets, snippets_sql,
)
from emberwatch.sources.sinks import with_report
from emberwatch.sources.tables import spread, table

ALL = Policy(min_severity="INFO")
FINDING_COLUMNS = "snippet_id, pos, line, col, severity, leak_type, message, code_snippet, tainted_var"


def _findings(spark: SparkSession, sf: str, policy: Policy = ALL) -> DataFrame:
    return finding_rows(scan(snippets(spark, sf), policy), "snippet_id").drop("sev_rank")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def _listed(where: str = "TRUE", rows=None) -> str:
    return f"{_with(expected_sql(rows))} SELECT {FINDING_COLUMNS} FROM expected WHERE {where}"


def _renumbered(where: str) -> str:
    columns = FINDING_COLUMNS.replace("pos", "row_number() OVER (PARTITION BY snippet_id ORDER BY pos) AS pos")
    return f"{_with(expected_sql())} SELECT {columns} FROM expected WHERE {where}"


# ---- L: line rules -------------------------------------------------------------------------------

def _detected(column: str) -> str:
    def words(items):
        return " OR ".join(f"contains({column}, {quoted(w)})" for w in items)

    return f"CASE WHEN {words(PYTHON_WORDS)} THEN 'python' WHEN {words(BASH_WORDS)} THEN 'bash' ELSE 'unknown' END"


def _lines_sql(source: str, key: str, text: str) -> str:
    """CTE ``lines(key, line, text)`` with Python's line breaks and stripping."""
    pieces = f"regexp_split_to_array({text}, {quoted(LINE_BREAK_RE)})"
    return (
        f"pieces AS (SELECT {key}, CASE WHEN {pieces}[-1] = '' THEN {pieces}[:-2] ELSE {pieces} END AS p FROM {source}),\n"
        f"lines AS (SELECT {key}, i AS line, trim(p[i], {quoted(STRIP_CHARS)}) AS text "
        f"FROM (SELECT {key}, p, unnest(range(1, len(p) + 1)) AS i FROM pieces))"
    )


def l1(spark, sf):
    return snippets(spark, sf).select("snippet_id", detect_language(F.col("code")).alias("language"))


def l2(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    lines = numbered_lines(F.col("text"))
    return docs.select(
        "doc_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x["text"] == "")).cast("bigint").alias("n_blank"),
        F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["text"])).alias("n_chars"),
    )


L2_SQL = f"""{_with(_lines_sql("documents", "doc_id", "text"))}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (text = '') AS n_blank,
       CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines GROUP BY doc_id"""


def _hits(df, hits):
    rows = df.select("snippet_id", F.inline(hits))
    return rows.select("snippet_id", "line", "severity", "leak_type", "message", "code_snippet")


def l3(spark, sf):
    shell = snippets(spark, sf).filter(detect_language(F.col("code")) == "bash")
    return _hits(shell, bash_findings(F.col("code")))


def _rules_sql(rules) -> str:
    rows = ", ".join(
        f"({quoted(r.pattern)}, {quoted(r.severity)}, {quoted(r.lang)}, "
        f"{quoted(r.message if r.lang == 'bash' else f'[{r.lang}] {r.message}')})" for r in rules
    )
    return f"rules(pattern, severity, lang, message) AS (VALUES {rows})"


def _rule_hits_sql(rules, shell: bool, where: str) -> str:
    source = f"(SELECT snippet_id, code FROM snippets WHERE {where})"
    skip = "AND text <> '' AND NOT starts_with(text, '#')" if shell else ""
    return (
        f"{_with(snippets_sql(), _lines_sql(source, 'snippet_id', 'code'), _rules_sql(rules))}\n"
        f"SELECT snippet_id, line, severity, 'char_extraction' AS leak_type, message, text AS code_snippet "
        f"FROM lines JOIN rules ON regexp_matches(text, pattern) {skip}"
    )


def l4(spark, sf):
    return _hits(snippets(spark, sf), multi_findings(F.col("code")))


def l4_go(spark, sf):
    only_go = pick_languages(multi_findings(F.col("code")), F.array(F.lit("go")))
    return _hits(snippets(spark, sf), only_go)


def l5(spark, sf):
    found = finding_rows(scan_commands(snippets(spark, sf), ALL), "snippet_id")
    return found.filter(F.startswith("message", F.lit("[embedded python]"))).drop("sev_rank")


def l6(spark, sf):
    docs = spread(table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    hits = F.filter(numbered_lines(F.col("text")), lambda x: is_secret_name(x["text"]))
    return docs.select("doc_id", F.size(hits).cast("bigint").alias("n_secret_lines"))


L6_SQL = f"""{_with(_lines_sql("documents", "doc_id", "text"))}
SELECT doc_id, count(*) FILTER (regexp_matches(text, {quoted('(?i)' + SECRET_NAME)})) AS n_secret_lines
FROM lines GROUP BY doc_id"""

_PATH = """CASE CAST(event_id % 9 AS INT) WHEN 0 THEN concat('/proc/', CAST(user_id AS VARCHAR(20)), '/environ')
WHEN 1 THEN '/proc/self/cmdline' WHEN 2 THEN concat('conf/app', CAST(user_id AS VARCHAR(20)), '.env')
WHEN 3 THEN concat('/home/u', CAST(user_id AS VARCHAR(20)), '/.ssh/id') WHEN 4 THEN '/etc/master.passwd'
WHEN 5 THEN '/var/lib/secrets.json' WHEN 6 THEN '/var/lib/secrets.json.bak'
WHEN 7 THEN '/proc/self/maps' ELSE concat('/tmp/', CAST(event_id AS VARCHAR(20)), '.txt') END"""


def l7(spark, sf):
    paths = table(spark, sf, "events", "event_id", "user_id").selectExpr("event_id", f"{_PATH} AS path")
    return paths.select("event_id", "path", is_sensitive_path(F.col("path")).alias("sensitive"))


_ANY_PATH = " OR ".join(f"regexp_matches(path, {quoted(p)})" for p in SENSITIVE_PATHS)
L7_SQL = f"SELECT event_id, path, {_ANY_PATH} AS sensitive FROM (SELECT event_id, {_PATH} AS path FROM events)"


def l8(spark, sf):
    return _findings(spark, sf, Policy())


def l9(spark, sf):
    return finding_rows(scan_commands(snippets(spark, sf), Policy()), "snippet_id").drop("sev_rank")


# ---- T: taint ------------------------------------------------------------------------------------

_BINDINGS = [1, 7, 3, 5, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3, 4, 2, 6, 6, 2, 0, 2, 2, 0]
_BROKEN = {6, 24}
# slot, kind, target, origin
_SOURCES = [
    (0, "assign", "secret", "subscript"), (0, "assign", "secret", "name"), (1, "assign", "tok", "call"),
    (2, "assign", "proc", "call"), (3, "assign", "password", "name"), (4, "assign", "api_key", "name"),
    (15, "assign", "row", "method"), (16, "assign", "data", "function"), (16, "assign", "raw", "method"),
    (18, "loop", "ln", "method"), (19, "assign", "auth", "name"), (20, "assign", "k", "call"),
    (22, "assign", "secret", "name"), (23, "assign", "secret", "name"),
]
# slot, kind, target, source name
_FLOWS = [
    (0, "assign", "secret", "os"), (1, "assign", "tok", "os"), (1, "assign", "n", "tok"), (1, "assign", "first", "tok"),
    (1, "assign", "part", "tok"), (1, "assign", "dyn", "tok"), (1, "assign", "neg", "tok"),
    (2, "assign", "proc", "subprocess"), (2, "assign", "out", "proc"), (2, "loop", "line", "out"),
    (3, "assign", "a", "password"), (3, "assign", "a", "base64"), (3, "assign", "h", "hashlib"),
    (3, "assign", "x", "password"), (4, "assign", "h", "api_key"), (4, "assign", "t", "api_key"),
    (4, "comprehension", "c", "api_key"), (4, "comprehension", "c", "api_key"),
    (15, "assign", "row", "cur"), (15, "assign", "a", "row"), (15, "assign", "b", "row"), (15, "assign", "x", "row"),
    (16, "assign", "raw", "f"), (17, "assign", "v", "os"), (17, "assign", "w", "os"),
    (18, "loop", "ln", "sys"), (18, "comprehension", "x", "ln"), (18, "comprehension", "y", "x"),
    (18, "comprehension", "q", "vals"), (19, "assign", "u", "auth"), (19, "assign", "m", "u"), (19, "assign", "r", "u"),
    (19, "assign", "g", "m"), (19, "assign", "g", "obj"), (19, "assign", "y", "g"), (20, "assign", "k", "os"),
    (22, "assign", "n", "secret"), (23, "assign", "t", "secret"),
]
# slot, kind, role, name
_CANDIDATES = [
    (0, "subscript", "value", "os"), (1, "subscript", "value", "tok"), (1, "subscript", "value", "tok"),
    (1, "subscript", "value", "tok"), (1, "subscript", "value", "tok"), (2, "compare", "left", "line"),
    (2, "fstring", "part", "line"), (4, "subscript", "value", "api_key"), (16, "compare", "right", "data"),
    (16, "compare", "right", "raw"), (16, "compare", "right", "data"), (19, "subscript", "value", "g"),
    (21, "subscript", "value", "custom"),
]


def _per_slot(columns: str, rows, where: str = "TRUE") -> str:
    values = ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    picked = columns.partition(", ")[2]
    return (
        f"WITH listed({columns}) AS (VALUES {values}) SELECT event_id AS snippet_id, {picked} "
        f"FROM events JOIN listed ON event_id % {len(TEMPLATES)} = slot WHERE {where}"
    )


def _python(spark, sf):
    return extract(snippets(spark, sf), follow=False).filter("language = 'python'")


def t1(spark, sf):
    fact = F.get("_facts", F.lit(0))
    bindings = F.filter(fact["visits"], lambda v: v["kind"].isin("assign", "loop", "comprehension"))
    return _python(spark, sf).select(
        "snippet_id", fact["ok"].alias("parsed"), F.size(bindings).cast("bigint").alias("n_bindings")
    )


T1_SQL = _per_slot(
    "slot, parsed, n_bindings",
    [(i, i not in _BROKEN, n) for i, n in enumerate(_BINDINGS) if i < 7 or i > 14],
)


def _sources(*origins):
    def query(spark, sf):
        edges = edge_rows(_python(spark, sf)).filter(F.col("src").isNull() & F.col("origin").isin(*origins))
        return edges.select("snippet_id", "kind", "target", "origin")

    names = ", ".join(quoted(o) for o in origins)
    return query, _per_slot("slot, kind, target, origin", _SOURCES, f"origin IN ({names})")


def _flows(kind):
    def query(spark, sf):
        edges = edge_rows(_python(spark, sf)).filter(F.col("src").isNotNull() & (F.col("kind") == kind))
        return edges.select("snippet_id", "target", "src")

    return query, _per_slot("slot, target, src", [(s, t, n) for s, k, t, n in _FLOWS if k == kind])


def t7(spark, sf):
    return _findings(spark, sf, Policy(min_severity="INFO", extra_sources=("custom",)))


def t11(spark, sf):
    rows = candidate_rows(_python(spark, sf)).filter(F.col("kind").isin("compare", "fstring", "subscript"))
    return rows.select("snippet_id", "kind", "role", "cand")


_EDGES = """SELECT l_suppkey AS snippet_id, l_orderkey * 10 + l_linenumber AS seq,
concat('v', CAST(l_partkey % 50 AS VARCHAR(20))) AS target,
CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND l_partkey % 11 = 0 THEN NULL
ELSE concat('v', CAST(l_orderkey % 50 AS VARCHAR(20))) END AS src FROM lineitem"""
_USES = """SELECT l_suppkey AS snippet_id, l_orderkey * 10 + l_linenumber AS seq, l_partkey AS sub, pos AS cand_pos,
concat('v', CAST(CASE WHEN pos = 1 THEN l_orderkey % 61 ELSE l_partkey % 53 END AS VARCHAR(20))) AS cand
FROM lineitem CROSS JOIN (VALUES (1), (2)) AS p(pos)"""


def _edge_table(spark, sf):
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return lines.selectExpr(
        "l_suppkey AS snippet_id", "l_orderkey * 10 + l_linenumber AS seq", "concat('v', l_partkey % 50) AS target",
        "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND l_partkey % 11 = 0 THEN NULL "
        "ELSE concat('v', l_orderkey % 50) END AS src",
    )


def t12(spark, sf):
    return earliest_taint(_edge_table(spark, sf))


_TAINT_CTE = f"""WITH RECURSIVE edges AS ({_EDGES}),
arrivals(snippet_id, name, seq) AS (
  SELECT snippet_id, target, seq FROM edges WHERE src IS NULL
  UNION SELECT e.snippet_id, e.target, e.seq FROM arrivals a JOIN edges e
    ON e.snippet_id = a.snippet_id AND e.src = a.name AND a.seq < e.seq),
taints AS (SELECT snippet_id, name, min(seq) AS seq FROM arrivals GROUP BY snippet_id, name)"""
T12_SQL = f"{_TAINT_CTE} SELECT snippet_id, name, seq FROM taints"


def t13(spark, sf):
    names = scan(snippets(spark, sf), ALL).select("snippet_id", F.array_join("tainted_vars", ",").alias("tainted"))
    return names


def t14(spark, sf):
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    candidates = F.array(
        F.struct(F.lit(1).alias("cand_pos"), F.expr("concat('v', l_orderkey % 61)").alias("cand")),
        F.struct(F.lit(2).alias("cand_pos"), F.expr("concat('v', l_partkey % 53)").alias("cand")),
    )
    uses = lines.select(
        F.col("l_suppkey").alias("snippet_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq"),
        F.col("l_partkey").alias("sub"), F.inline(candidates),
    ).withColumn("label", F.col("cand"))
    return firing_uses(uses, earliest_taint(_edge_table(spark, sf))).select("snippet_id", "seq", "sub", "label")


T14_SQL = f"""{_TAINT_CTE}, uses AS ({_USES})
SELECT u.snippet_id, u.seq, u.sub, arg_min(u.cand, u.cand_pos) AS label FROM uses u
JOIN taints t ON t.snippet_id = u.snippet_id AND t.name = u.cand AND t.seq < u.seq GROUP BY u.snippet_id, u.seq, u.sub"""


# ---- U: use rules --------------------------------------------------------------------------------

_USE_FILTERS = {
    "U1_U3_subscripts": ("message", "^(Indexing|Slicing|Dynamic)"),
    "U4_U5_comparisons": ("leak_type", "^comparison_leak$"),
    "U6_U11_builtins": ("message", r"^(ord|len|hex|oct|bin|repr|hash|type)\(\)"),
    "U12_U16_methods": ("message", "^'"),
    "U17_encoding_calls": ("message", r"^[a-z0-9]+\.[a-z0-9_]+\(\) on tainted"),
    "U18_U19_iteration": ("leak_type", "^iteration_over_secret$"),
    "U20_U21_output_sinks": ("leak_type", "^indirect_output$"),
    "U22_format_strings": ("leak_type", "^format_string_leak$"),
}


def _use(column, pattern):
    return lambda spark, sf: _findings(spark, sf).filter(F.rlike(column, F.lit(pattern)))


# ---- V: policies and verdicts --------------------------------------------------------------------

_SEVERITY = """CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'MEDIUM'
WHEN 'view' THEN 'LOW' ELSE 'DEBUG' END"""


def v1(spark, sf):
    named = table(spark, sf, "events", "event_id", "event_type").selectExpr("event_id", f"{_SEVERITY} AS severity")
    return named.withColumn("sev_rank", severity_rank(F.col("severity")))


V1_SQL = f"""SELECT event_id, severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2
WHEN 'LOW' THEN 1 ELSE 0 END AS sev_rank FROM (SELECT event_id, {_SEVERITY} AS severity FROM events)"""

_VERDICT = """verdicts AS (SELECT event_id AS snippet_id, count(pos) AS n_findings,
max(sev_rank) AS top, CASE max(sev_rank) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END
AS max_severity FROM events LEFT JOIN expected ON snippet_id = event_id AND {keep} GROUP BY event_id)"""


def _verdicts(policy: Policy):
    return lambda spark, sf: scan(snippets(spark, sf), policy).select(
        "snippet_id", "n_findings", "max_severity", "blocked"
    )


def _verdict_sql(keep: str, blocks: bool = True) -> str:
    blocked = "coalesce(top >= 3, FALSE)" if blocks else "FALSE"
    return (
        f"{_with(expected_sql(), _VERDICT.format(keep=keep))} "
        f"SELECT snippet_id, n_findings, max_severity, {blocked} AS blocked FROM verdicts"
    )


_SETTINGS = {
    "enabled": "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'FALSE' WHEN 2 THEN 'off' WHEN 3 THEN 'yes' ELSE '0' END",
    "min_severity": "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN 'LOUD' ELSE 'Info' END",
    "mode": "CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'WARN' WHEN 1 THEN 'log' WHEN 2 THEN 'panic' ELSE NULL END",
    "languages": "CASE CAST(user_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' Go, python ,cobol' "
                 "WHEN 3 THEN 'cobol' ELSE 'js,JS,,bash' END",
    "extra_sources": "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' A , B,,A' "
                     "ELSE concat('V', CAST(user_id AS VARCHAR(20))) END",
}
_SETTING_COLUMNS = ", ".join(f"{sql} AS {name}" for name, sql in _SETTINGS.items())


def v5(spark, sf):
    settings = table(spark, sf, "events", "event_id", "user_id").selectExpr(
        "event_id", *[f"{sql} AS {name}" for name, sql in _SETTINGS.items()]
    )
    policy = normalise_policy(*[F.col(c) for c in _SETTINGS])
    p = settings.select("event_id", policy.alias("p"))
    return p.select(
        "event_id", "p.enabled", "p.min_rank", "p.mode",
        F.array_join(F.sort_array("p.languages"), ",").alias("languages"),
        F.array_join(F.sort_array("p.extra_sources"), ",").alias("extra_sources"),
    )


V5_SQL = f"""WITH s AS (SELECT event_id, {_SETTING_COLUMNS} FROM events)
SELECT event_id, lower(coalesce(enabled, 'true')) NOT IN ('false', '0', 'no', 'off') AS enabled,
CASE upper(coalesce(min_severity, 'MEDIUM')) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 WHEN 'INFO' THEN 0
 ELSE 2 END AS min_rank,
CASE WHEN lower(mode) IN ('block', 'warn', 'log') THEN lower(mode) ELSE 'block' END AS mode,
CASE WHEN trim(coalesce(languages, '')) = '' THEN 'bash,go,js,python,ruby' ELSE coalesce(array_to_string(list_sort(list_distinct(
 list_filter(list_transform(string_split(languages, ','), lambda x: lower(trim(x))),
 lambda x: x IN ('python', 'bash', 'js', 'ruby', 'go')))), ','), '') END AS languages,
coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(extra_sources, ','), lambda x: trim(x)),
 lambda x: x <> ''))), ','), '') AS extra_sources FROM s"""


def v8(spark, sf):
    return severity_counts(scan(snippets(spark, sf), ALL), "snippet_id")


V8_SQL = f"""{_with(expected_sql())} SELECT event_id AS snippet_id, count(pos) AS n_findings,
count(pos) FILTER (severity = 'CRITICAL') AS n_critical, count(pos) FILTER (severity = 'HIGH') AS n_high,
count(pos) FILTER (severity = 'MEDIUM') AS n_medium, count(pos) FILTER (severity = 'LOW') AS n_low
FROM events LEFT JOIN expected ON snippet_id = event_id GROUP BY event_id"""


def v9(spark, sf):
    return with_report(scan(snippets(spark, sf), ALL)).select("snippet_id", "report")


_NL = "chr(10)"
V9_SQL = f"""{_with(snippets_sql(), expected_sql())},
bodies AS (SELECT snippet_id, count(*) AS n, max(sev_rank) AS top,
  string_agg({_NL} || '[' || pos || '] [' || severity || '] L' || line || ':' || col || ' (' || leak_type || ') ' || message
    || CASE WHEN code_snippet <> '' THEN {_NL} || '    Code: ' || code_snippet ELSE '' END, {_NL} ORDER BY pos) AS body
  FROM expected GROUP BY snippet_id)
SELECT s.snippet_id, CASE WHEN n IS NULL THEN 'No side-channel exfiltration patterns detected.' ELSE
  repeat('=', 60) || {_NL} || 'SIDE-CHANNEL EXFILTRATION SCAN REPORT' || {_NL} || repeat('=', 60) || {_NL}
  || 'Findings: ' || n || {_NL} || 'Max Severity: '
  || CASE top WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END || {_NL}
  || 'Verdict: ' || CASE WHEN top >= 3 THEN 'BLOCK' ELSE 'WARN' END || {_NL}
  || CASE WHEN tainted <> '' THEN 'Tainted Variables: ' || replace(tainted, ',', ', ') || {_NL} ELSE '' END
  || repeat('-', 60) || {_NL} || body || {_NL} || {_NL} || repeat('=', 60) END AS report
FROM snippets s LEFT JOIN bodies b ON b.snippet_id = s.snippet_id"""

_REGION_POLICY = {
    "enabled": "CASE r_regionkey WHEN 0 THEN 'no' ELSE 'true' END",
    "min_severity": "CASE r_regionkey WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'INFO' ELSE 'HIGH' END",
    "mode": "CASE r_regionkey WHEN 3 THEN 'warn' ELSE 'block' END",
    "languages": "CASE r_regionkey WHEN 4 THEN 'js,bash' ELSE '' END",
    "extra_sources": "CASE r_regionkey WHEN 2 THEN 'custom' ELSE '' END",
}


def v10(spark, sf):
    settings = table(spark, sf, "region", "r_regionkey").selectExpr(
        "CAST(r_regionkey AS BIGINT) AS policy_id", *[f"{sql} AS {name}" for name, sql in _REGION_POLICY.items()]
    )
    policies = settings.select("policy_id", normalise_policy(*[F.col(c) for c in _REGION_POLICY]).alias("policy"))
    requests = snippets(spark, sf).withColumn("policy_id", F.col("user_id") % 6)
    scanned = scan(attach_policies(requests, policies))
    return scanned.select("snippet_id", "policy_id", "n_findings", "max_severity", "blocked")


V10_SQL = f"""{_with(expected_sql(EXPECTED + EXPECTED_EXTRA))},
judged AS (SELECT event_id, user_id % 6 AS policy_id, pos, sev_rank, severity FROM events LEFT JOIN expected e
 ON e.snippet_id = event_id AND CASE CAST(user_id % 6 AS INT) WHEN 0 THEN FALSE WHEN 1 THEN sev_rank >= 4 WHEN 2 THEN TRUE
 WHEN 3 THEN sev_rank >= 3 WHEN 4 THEN sev_rank >= 3 AND (slot BETWEEN 7 AND 10 OR slot = 11) ELSE sev_rank >= 2 END
 AND (slot <> 21 OR user_id % 6 = 2))
SELECT event_id AS snippet_id, policy_id, count(pos) AS n_findings,
CASE max(sev_rank) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS max_severity,
policy_id <> 3 AND coalesce(max(sev_rank) >= 3, FALSE) AS blocked FROM judged GROUP BY event_id, policy_id"""


def v10_compare(spark, sf):
    """Three policies over one corpus: how many snippets each would block."""
    choices = {"default": Policy(), "strict": Policy(min_severity="LOW"), "shell_only": Policy(languages=("bash",))}
    judged = judge(fan_out_policies(extract(snippets(spark, sf)), choices))
    return judged.groupBy("policy_id").agg(
        F.count_if("blocked").alias("n_blocked"), F.sum("n_findings").alias("n_findings")
    )


V10_COMPARE_SQL = f"""{_with(expected_sql())},
policies(policy_id, floor, shell) AS (VALUES ('default', 2, FALSE), ('strict', 1, FALSE), ('shell_only', 2, TRUE)),
judged AS (SELECT policy_id, snippet_id, count(*) AS n, max(sev_rank) AS top FROM expected, policies
 WHERE sev_rank >= floor AND (NOT shell OR slot BETWEEN 7 AND 10) GROUP BY policy_id, snippet_id)
SELECT policy_id, count(*) FILTER (top >= 3) AS n_blocked, CAST(sum(n) AS BIGINT) AS n_findings FROM judged GROUP BY policy_id"""

_t2, _t2_sql = _sources("call")
_t3, _t3_sql = _sources("method")
_t4, _t4_sql = _sources("function")
_t5, _t5_sql = _sources("subscript")
_t6, _t6_sql = _sources("name")
_t8, _t8_sql = _flows("assign")
_t9, _t9_sql = _flows("loop")
_t10, _t10_sql = _flows("comprehension")

QUERIES = {
    "L1_language_detection": (l1, f"{_with(snippets_sql())} SELECT snippet_id, {_detected('code')} AS language FROM snippets"),
    "L2_numbered_lines": (l2, L2_SQL),
    "L3_shell_rules": (l3, _rule_hits_sql(BASH_RULES, True, f"{_detected('code')} = 'bash'")),
    "L4_other_language_rules": (l4, _rule_hits_sql(MULTI_RULES, False, "TRUE")),
    "L4_rules_for_go": (l4_go, _rule_hits_sql(MULTI_RULES, False, "TRUE") + " AND contains(lang, 'go')"),
    "L5_embedded_python": (l5, _listed("slot = 10")),
    "L6_secret_names": (l6, L6_SQL),
    "L7_sensitive_paths": (l7, L7_SQL),
    "L8_combined_scan": (l8, _renumbered("sev_rank >= 2")),
    "L9_command_scan": (l9, _renumbered("sev_rank >= 2 AND slot BETWEEN 7 AND 13")),
    "T1_facts": (t1, T1_SQL),
    "T2_call_sources": (_t2, _t2_sql),
    "T3_method_sources": (_t3, _t3_sql),
    "T4_function_sources": (_t4, _t4_sql),
    "T5_subscript_sources": (_t5, _t5_sql),
    "T6_secret_name_sources": (_t6, _t6_sql),
    "T7_policy_sources": (t7, _listed(rows=EXPECTED + EXPECTED_EXTRA)),
    "T8_assignment_flow": (_t8, _t8_sql),
    "T9_loop_flow": (_t9, _t9_sql),
    "T10_comprehension_flow": (_t10, _t10_sql),
    "T11_candidates": (t11, _per_slot("slot, kind, role, cand", _CANDIDATES)),
    "T12_earliest_taint": (t12, T12_SQL),
    "T13_tainted_names": (t13, f"{_with(snippets_sql())} SELECT snippet_id, tainted FROM snippets"),
    "T14_firing_uses": (t14, T14_SQL),
    **{
        name: (_use(column, pattern), _listed(f"regexp_matches({column}, {quoted(pattern)})"))
        for name, (column, pattern) in _USE_FILTERS.items()
    },
    "V1_severity_rank": (v1, V1_SQL),
    "V2_max_severity": (_verdicts(ALL), _verdict_sql("TRUE")),
    "V3_threshold": (_verdicts(Policy(min_severity="HIGH")), _verdict_sql("sev_rank >= 3")),
    "V4_warn_mode": (_verdicts(Policy(mode="warn")), _verdict_sql("sev_rank >= 2", blocks=False)),
    "V5_policy_settings": (v5, V5_SQL),
    "V6_one_language": (_verdicts(Policy(languages=("js",))), _verdict_sql("sev_rank >= 2 AND slot = 11")),
    "V7_disabled_policy": (_verdicts(Policy(enabled=False)), _verdict_sql("FALSE")),
    "V8_finding_counts": (v8, V8_SQL),
    "V9_S7_report": (v9, V9_SQL),
    "V10_policy_per_snippet": (v10, V10_SQL),
    "V10_policy_comparison": (v10_compare, V10_COMPARE_SQL),
}
