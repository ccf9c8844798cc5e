"""Combined scan (L8, L9): rules and facts once per snippet, then the policy's verdict.

``extract`` holds all work that no policy changes; ``judge`` is cheap column work on its arrays.
Both keep one row per snippet, so a scan needs no shuffle from source to verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.line_scan import (
    FINDINGS, bash_findings, detect_language, embedded_python, multi_findings, pick_languages,
)
from emberwatch.operators.policy import Policy, count_severity, is_blocked, max_severity, meets_threshold
from emberwatch.operators.taint import mentions_any, traceable, use_findings
from emberwatch.operators.taint_facts import extract_facts
from emberwatch.operators.taint_fold import trace

_NO_NAMES = "array<string>"


def _no_names() -> Column:
    return F.array().cast(_NO_NAMES)


def extract(snippets: DataFrame, languages: Column | None = None, follow: bool = True) -> DataFrame:
    """Add ``language``, rule hits, parsed facts and their taint to ``snippets(code, language, ...)``.

    ``languages`` limits what is parsed and matched (a column, so it may differ per row); pass the
    union of what the policies to be judged enable, or nothing for all. Without ``follow`` the facts
    are stated only, not traced; ``judge`` needs them traced.
    """
    code = F.coalesce(F.col("code"), F.lit(""))
    resolved = F.when(F.col("language") == "auto", detect_language(code)).otherwise(F.col("language"))
    routed = snippets.withColumn("language", resolved)
    python = F.col("language") == "python"
    bash = F.col("language") == "bash"
    if languages is not None:
        python = python & F.array_contains(languages, "python")
        bash = bash & F.array_contains(languages, "bash")
    no_bodies = F.array().cast("array<struct<line:int,item:int,body:string>>")
    lines = routed.withColumns({
        "_rule_hits": F.when(bash, bash_findings(code)).otherwise(F.array().cast(FINDINGS)),
        "_multi_hits": multi_findings(code),
        "_bodies": F.when(bash, embedded_python(code)).otherwise(no_bodies),
    })
    texts = F.when(python, F.array(code)).otherwise(F.transform("_bodies", lambda b: b["body"]))
    # The one-element explode keeps the optimiser from merging the lambdas above into the UDF call,
    # where Spark 4.1 fails to extract it; it neither adds nor drops rows.
    fenced = lines.withColumn("_texts", F.explode(F.array(texts)))
    # Parsed texts with the place their findings belong to: the snippet itself (line 0), or the
    # Python bodies on its shell lines.
    whole = F.array(F.struct(F.lit(0).alias("line"), F.lit(0).alias("item")))
    stated = fenced.withColumns({
        "_facts": extract_facts(F.col("_texts")),
        "_places": F.when(python, whole).otherwise(F.transform("_bodies", lambda b: F.struct(b["line"], b["item"]))),
    }).drop("_texts", "_bodies")
    return _traced(stated, F.col("_facts"), F.transform("_facts", lambda _: _no_names()), "_own") if follow else stated


def _traced(stated: DataFrame, facts: Column, extra: Column, prefix: str) -> DataFrame:
    """Add the traces of ``facts``, with ``extra`` names tainted before all, and the findings of their uses."""
    # As for the facts: lambdas may not be merged into the call.
    fenced = stated.withColumn("_asked", F.explode(F.array(traceable(facts, extra)))).withColumn(f"{prefix}_traces", trace(F.col("_asked")))
    found = F.transform(
        F.arrays_zip(facts.alias("fact"), F.col("_places").alias("place"), F.col(f"{prefix}_traces").alias("trace")),
        lambda t: use_findings(t["fact"]["names"], t["fact"]["visits"], t["trace"]["leaks"], t["place"]),
    )
    return fenced.withColumn(f"{prefix}_uses", F.flatten(found)).drop("_asked")


def judge(extracted: DataFrame) -> DataFrame:
    """Findings, tainted names and verdict per row of ``extract`` output with a ``policy`` column.

    Adds ``parsed``, ``findings`` (in reporting order), ``tainted_vars`` (sorted), ``n_findings``,
    ``max_severity``, ``blocked``; a disabled policy gives an empty result (V7).
    """
    policy = F.col("policy")
    enabled = policy["enabled"]
    langs = policy["languages"]
    python = enabled & (F.col("language") == "python") & F.array_contains(langs, "python")
    bash = enabled & (F.col("language") == "bash") & F.array_contains(langs, "bash")
    nothing = F.array().cast(FINDINGS)
    # Extra names count in the snippet itself, not in bodies on shell lines (L5). Only where they occur are
    # facts traced again; elsewhere the trace without them is the policy's as well.
    facts = F.col("_facts")
    parsed = F.get(facts, F.lit(0))["ok"]
    extra = F.when(python & parsed, policy["extra_sources"]).otherwise(_no_names())
    named = F.when(mentions_any(facts, extra), facts).otherwise(F.slice(facts, 1, 0))
    traced = _traced(extracted.withColumns({"_extra": extra, "_named": named}), F.col("_named"), F.transform("_named", lambda _: F.col("_extra")), "_again")
    again = F.size("_named") > 0
    found = F.concat(
        F.when(again, F.col("_again_uses")).when(python | bash, F.col("_own_uses")).otherwise(nothing),
        F.when(bash, F.col("_rule_hits")).otherwise(nothing),
        F.when(enabled, pick_languages(F.col("_multi_hits"), langs)).otherwise(nothing),
    )
    own = F.get(F.when(again, F.col("_again_traces")).otherwise(F.col("_own_traces")), F.lit(0))
    tainted = F.transform(own["tainted"], lambda n: F.get(F.get(facts, F.lit(0))["names"], n))
    own_names = F.when(python, F.sort_array(F.array_union(F.col("_extra"), tainted)))
    judged = traced.withColumns({
        # False where a Python text was not taken by the parser: no findings then means not looked at.
        "parsed": ~(python | bash) | F.forall(facts, lambda fact: fact["ok"]),
        "findings": F.sort_array(meets_threshold(found, policy["min_rank"])),
        "tainted_vars": F.coalesce(own_names, _no_names()),
    }).drop(
        "_rule_hits", "_multi_hits", "_places", "_facts", "_named", "_extra", "_own_traces", "_own_uses", "_again_traces", "_again_uses"
    )
    return judged.withColumns({
        "n_findings": F.size("findings").cast("bigint"),
        "max_severity": max_severity(F.col("findings")),
        "blocked": is_blocked(F.col("findings"), policy["mode"]),
    })


def scan(snippets: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Scan ``snippets(code, language, ...)`` under one policy, or under each row's ``policy``."""
    ruled = snippets if policy is None else snippets.withColumn("policy", policy.column())
    gate = F.when(F.col("policy.enabled"), F.col("policy.languages")).otherwise(_no_names())
    return judge(extract(ruled, gate))


def scan_commands(commands: DataFrame, policy: Policy | None = None) -> DataFrame:
    """As ``scan`` for shell commands; the language is not guessed."""
    return scan(commands.withColumn("language", F.lit("bash")), policy)


def finding_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row per finding, with its place in the snippet's list."""
    fields = ["line", "col", "severity", "sev_rank", "leak_type", "message", "code_snippet", "tainted_var"]
    # The outer form: for the inner one Spark infers a filter that computes the findings twice.
    exploded = scanned.select(*keys, F.posexplode_outer("findings").alias("pos", "f")).filter("pos IS NOT NULL")
    return exploded.select(*keys, (F.col("pos") + 1).alias("pos"), *[F.col(f"f.{c}").alias(c) for c in fields])


def severity_counts(scanned: DataFrame, *keys: str) -> DataFrame:
    """V8: findings per snippet, in total and by severity, zero where there are none."""
    return scanned.select(
        *keys, "n_findings",
        *[count_severity(F.col("findings"), s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
