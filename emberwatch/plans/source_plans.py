"""Queries and oracles of the snippet and settings sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.rules import BASH_RULES, MULTI_RULES
from emberwatch.functions.text import split_lines
from emberwatch.operators.policy import Policy
from emberwatch.operators.scan import scan
from emberwatch.plans.corpus import quoted
from emberwatch.plans.scan_plans import _detected, _lines_sql, _rules_sql
from emberwatch.sources.readers import env_lines, env_settings, numbered_document_lines, override_settings
from emberwatch.sources.tables import spread, table


def s1(spark, sf):
    """Whole pages as snippets of unknown language."""
    pages = spread(table(spark, sf, "pages", "page_id", "html"), "page_id")
    code = pages.select("page_id", F.col("html").alias("code"), F.lit("auto").alias("language"))
    return scan(code, Policy(min_severity="INFO")).select("page_id", "language", "n_findings")


S1_SQL = f"""WITH found AS (SELECT page_id, html, {_detected('html')} AS language FROM pages),
{_lines_sql('found', 'page_id', 'html')}, {_rules_sql(BASH_RULES + MULTI_RULES)},
hits AS (SELECT l.page_id, count(*) AS n FROM lines l JOIN found f ON f.page_id = l.page_id JOIN rules ON regexp_matches(l.text, pattern)
 AND (lang <> 'bash' OR (language = 'bash' AND text <> '' AND NOT starts_with(text, '#'))) GROUP BY l.page_id)
SELECT f.page_id, language, coalesce(n, 0) AS n_findings FROM found f LEFT JOIN hits h ON h.page_id = f.page_id"""

# Settings files of users, one line per event.
_LINE = """CASE CAST(event_id % 6 AS INT) WHEN 0 THEN concat('  KEY', CAST(event_id % 4 AS VARCHAR(20)), ' = ', event_type, '  ')
WHEN 1 THEN concat('# KEY1=', event_type) WHEN 2 THEN concat('KEY', CAST(event_id % 4 AS VARCHAR(20)), '=') WHEN 3 THEN 'no setting'
WHEN 4 THEN concat('URL=a=b#', CAST(event_id AS VARCHAR(20))) ELSE '=nothing' END"""


def _settings_lines(spark, sf):
    return table(spark, sf, "events", "event_id", "user_id", "event_type").select(
        F.col("user_id").alias("path"), F.col("event_id").alias("line"), F.expr(_LINE).alias("value")
    )


def _settings(keep):
    def query(spark, sf):
        return env_settings(env_lines(_settings_lines(spark, sf)), keep=keep)

    order = "arg_max(value, line)" if keep == "last" else "coalesce(arg_min(value, line) FILTER (value <> ''), '')"
    return query, f"WITH {_PAIRS} SELECT path, key, {order} AS value FROM pairs GROUP BY path, key"


_PAIRS = f"""pairs AS (SELECT path, line, trim(regexp_extract(t, '^([^#=]+)=(.*)', 1)) AS key, trim(regexp_extract(t, '^([^#=]+)=(.*)', 2)) AS value
FROM (SELECT user_id AS path, event_id AS line, trim({_LINE}) AS t FROM events) WHERE regexp_matches(t, '^[^#=]+='))"""


def s5_override(spark, sf):
    """Process settings, named after regions, over those of the files."""
    settings = env_settings(env_lines(_settings_lines(spark, sf)))
    env = table(spark, sf, "region", "r_regionkey", "r_name").selectExpr(
        "concat('KEY', r_regionkey) AS key", "CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END AS env_value"
    )
    return override_settings(settings, env)


S5_OVERRIDE_SQL = f"""WITH {_PAIRS}, settings AS (SELECT path, key, coalesce(arg_min(value, line) FILTER (value <> ''), '') AS value FROM pairs GROUP BY path, key),
env AS (SELECT 'KEY' || r_regionkey AS key, CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END AS env_value FROM region)
SELECT path, s.key, coalesce(nullif(env_value, ''), value) AS value FROM settings s LEFT JOIN env ON env.key = s.key"""


def s5_documents(spark, sf):
    """Setting lines hidden in documents: digests only, as the values may be secrets."""
    docs = spread(table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    pairs = env_lines(numbered_document_lines(docs, split_lines(F.col("text"))))
    return pairs.select("path", (F.col("line") + 1).cast("bigint").alias("line"), "key", F.md5("value").alias("digest"))


S5_DOCUMENTS_SQL = f"""WITH {_lines_sql('documents', 'doc_id', 'text')}
SELECT doc_id AS path, line, trim(regexp_extract(text, '^([^#=]+)=(.*)', 1)) AS key, md5(trim(regexp_extract(text, '^([^#=]+)=(.*)', 2))) AS digest
FROM lines WHERE regexp_matches(text, {quoted('^[^#=]+=')})"""

QUERIES = {
    "S1_pages_as_snippets": (s1, S1_SQL),
    "S5_settings_first": _settings("first_nonempty"),
    "S5_settings_last": _settings("last"),
    "S5_settings_overridden": (s5_override, S5_OVERRIDE_SQL),
    "S5_settings_in_documents": (s5_documents, S5_DOCUMENTS_SQL),
}
