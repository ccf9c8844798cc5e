"""Language detection and line rules (L1-L5), kept inside the snippet's own row.

Lines, rule hits and findings are array columns, so a corpus is scanned in one narrow pass: no
shuffle, however uneven the snippets or their copies are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.rules import (
    BASH_RULES, BASH_WORDS, EMBEDDED_PYTHON, MULTI_RULES, PYTHON_WORDS, SEVERITY_RANK, LineRule,
)
from emberwatch.functions.text import contains_any, split_lines, strip, unicode_regex

FINDING = (
    "struct<part:int,at_line:int,stage:int,item:int,seq:int,sub:bigint,"
    "line:int,col:int,severity:string,sev_rank:int,leak_type:string,"
    "message:string,code_snippet:string,tainted_var:string,lang:string>"
)
FINDINGS = f"array<{FINDING}>"

BASH_NEEDLES = sorted({n for r in BASH_RULES for n in r.needles} | {"python"})
MULTI_NEEDLES = sorted({n for r in MULTI_RULES for n in r.needles})


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def detect_language(code: Column) -> Column:
    """L1: Python words first, then shell words, else ``unknown``."""
    return (
        F.when(contains_any(code, PYTHON_WORDS), "python")
        .when(contains_any(code, BASH_WORDS), "bash")
        .otherwise("unknown")
    )


def numbered_lines(code: Column) -> Column:
    """L2: ``array<struct<line, text>>`` of stripped lines, numbered from 1."""
    return F.transform(
        split_lines(code),
        lambda text, i: F.struct((i + 1).cast("int").alias("line"), strip(text).alias("text")),
    )


def command_lines(code: Column) -> Column:
    """L2 for shell text: blank and comment lines are skipped but still counted."""
    return F.filter(numbered_lines(code), lambda x: (x["text"] != "") & ~F.startswith(x["text"], F.lit("#")))


def _rule_table(rules: list[LineRule]) -> Column:
    """What rules report, as one literal array indexed by rule."""
    rows = [
        {
            "severity": r.severity, "sev_rank": SEVERITY_RANK[r.severity], "lang": r.lang,
            "message": r.message if r.lang == "bash" else f"[{r.lang}] {r.message}",
        }
        for r in rules
    ]
    return F.from_json(
        F.lit(json.dumps(rows)), "array<struct<severity:string,sev_rank:int,lang:string,message:string>>"
    )


def _matching_rules(text: Column, rules: list[LineRule]) -> Column:
    """Indexes of the rules a line matches; each pattern is a literal, compiled once per task."""
    hits = [
        F.when(contains_any(text, r.needles) & F.rlike(text, F.lit(unicode_regex(r.pattern))), F.lit(i))
        for i, r in enumerate(rules)
    ]
    return F.array_compact(F.array(*hits))


def _apply_rules(lines: Column, rules: list[LineRule], needles: list[str], part: int) -> Column:
    candidates = F.filter(lines, lambda x: contains_any(x["text"], needles))
    matched = F.filter(
        F.transform(candidates, lambda x: F.struct(x.alias("at"), _matching_rules(x["text"], rules).alias("rules"))),
        lambda x: F.size(x["rules"]) > 0,
    )

    def finding(index: Column, at: Column) -> Column:
        rule = F.get(_rule_table(rules), index)
        fields = {
            "part": F.lit(part), "at_line": at["line"], "stage": F.lit(0), "item": index,
            "seq": F.lit(0), "sub": F.lit(0).cast("bigint"), "line": at["line"], "col": F.lit(0),
            "severity": rule["severity"], "sev_rank": rule["sev_rank"], "leak_type": F.lit("char_extraction"),
            "message": rule["message"], "code_snippet": at["text"], "tainted_var": F.lit(""), "lang": rule["lang"],
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return F.flatten(F.transform(matched, lambda x: F.transform(x["rules"], lambda i: finding(i, x["at"]))))


def bash_findings(code: Column) -> Column:
    """L3: one finding per rule and line, in line order; a text without any needle is not split."""
    return F.when(
        contains_any(code, BASH_NEEDLES), _apply_rules(command_lines(code), BASH_RULES, BASH_NEEDLES, 0)
    ).otherwise(no_findings())


def multi_findings(code: Column) -> Column:
    """L4: hits of every js/ruby/go rule; a policy picks its languages from ``lang`` later."""
    return F.when(
        contains_any(code, MULTI_NEEDLES), _apply_rules(numbered_lines(code), MULTI_RULES, MULTI_NEEDLES, 1)
    ).otherwise(no_findings())


def pick_languages(findings: Column, languages: Column) -> Column:
    """L4 gating: a ``ruby/go`` rule counts if either language is enabled."""
    return F.filter(findings, lambda f: F.arrays_overlap(F.split(f["lang"], "/"), languages))


def embedded_python(code: Column) -> Column:
    """``array<struct<line, item, body>>`` of Python passed to an interpreter on shell lines."""
    candidates = F.filter(command_lines(code), lambda x: F.contains(x["text"], F.lit("python")))
    per_line = F.transform(
        candidates,
        lambda x: F.transform(
            F.regexp_extract_all(x["text"], F.lit(unicode_regex(EMBEDDED_PYTHON)), F.lit(1)),
            lambda body, i: F.struct(x["line"].alias("line"), i.cast("int").alias("item"), body.alias("body")),
        ),
    )
    return F.when(F.contains(code, F.lit("python")), F.flatten(per_line)).otherwise(
        F.array().cast("array<struct<line:int,item:int,body:string>>")
    )
