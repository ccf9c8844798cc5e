"""Policies and verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.rules import LANGUAGES, SEVERITY_RANK, severity_name, severity_rank
from emberwatch.functions.text import strip

POLICY = "struct<enabled:boolean,min_rank:int,mode:string,languages:array<string>,extra_sources:array<string>>"

# Spellings that switch a policy off, and the known modes.
OFF_WORDS = ["false", "0", "no", "off"]
MODES = ["block", "warn", "log"]


@dataclass(frozen=True)
class Policy:
    """Scan settings of one caller; the defaults are the scanner's own."""

    enabled: bool = True
    min_severity: str = "MEDIUM"
    mode: str = "block"
    languages: tuple[str, ...] = tuple(LANGUAGES)
    extra_sources: tuple[str, ...] = field(default_factory=tuple)

    def column(self) -> Column:
        def names(values):
            return F.array(*[F.lit(v) for v in values]).cast("array<string>")

        return F.struct(
            F.lit(self.enabled).alias("enabled"),
            F.lit(SEVERITY_RANK.get(self.min_severity, 0)).alias("min_rank"),
            F.lit(self.mode).alias("mode"),
            names(self.languages).alias("languages"),
            names(self.extra_sources).alias("extra_sources"),
        ).cast(POLICY)


def _listed(text: Column) -> Column:
    """Trimmed, non-blank entries of a comma list."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def normalise_policy(
    enabled: Column, min_severity: Column, mode: Column, languages: Column, extra_sources: Column
) -> Column:
    """V5: a policy struct from setting strings; NULL means unset."""
    switch = F.lower(F.coalesce(enabled, F.lit("true")))
    severity = F.upper(F.coalesce(min_severity, F.lit("MEDIUM")))
    how = F.lower(F.coalesce(mode, F.lit("block")))
    known = F.array(*[F.lit(x) for x in LANGUAGES])
    wanted = F.transform(_listed(F.coalesce(languages, F.lit(""))), F.lower)
    return F.struct(
        (~switch.isin(OFF_WORDS)).alias("enabled"),
        F.when(severity.isin(list(SEVERITY_RANK)), severity_rank(severity))
        .otherwise(SEVERITY_RANK["MEDIUM"]).alias("min_rank"),
        F.when(how.isin(MODES), how).otherwise("block").alias("mode"),
        F.when(strip(F.coalesce(languages, F.lit(""))) == "", known)
        .otherwise(F.array_intersect(known, wanted)).alias("languages"),
        F.array_distinct(_listed(F.coalesce(extra_sources, F.lit("")))).alias("extra_sources"),
    ).cast(POLICY)


def meets_threshold(findings: Column, min_rank: Column) -> Column:
    """V3: findings at or above the policy's rank."""
    return F.filter(findings, lambda f: f["sev_rank"] >= min_rank)


def max_severity(findings: Column) -> Column:
    """V2: highest severity in a findings array; NULL if it is empty."""
    return severity_name(F.array_max(F.transform(findings, lambda f: f["sev_rank"])))


def is_blocked(findings: Column, mode: Column) -> Column:
    """V4: block mode with a CRITICAL or HIGH finding left after the threshold."""
    return (mode == "block") & F.exists(findings, lambda f: f["sev_rank"] >= SEVERITY_RANK["HIGH"])


def count_severity(findings: Column, severity: str) -> Column:
    """V8: number of findings of one severity."""
    return F.size(F.filter(findings, lambda f: f["severity"] == severity)).cast("bigint")


def attach_policies(snippets: DataFrame, policies: DataFrame, key: str = "policy_id") -> DataFrame:
    """Every snippet under the policy it names; a missing one means the defaults.

    ``policies`` has ``key`` and a ``policy`` struct. The join side is left to the optimiser, which
    broadcasts it only below its size threshold.
    """
    joined = snippets.join(policies.select(key, "policy"), key, "left")
    return joined.withColumn("policy", F.coalesce(F.col("policy"), Policy().column()))


def fan_out_policies(snippets: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """Every snippet under each of a few policies given by the caller.

    One output row per snippet and policy is what is asked for. Call it on ``scan.extract`` output,
    so that rules and parsing run once per snippet, whatever the number of policies.
    """
    rows = F.array(*[
        F.struct(F.lit(name).alias("policy_id"), policy.column().alias("policy")) for name, policy in policies.items()
    ])
    named = snippets.withColumn("_p", F.explode(rows))
    return named.withColumn("policy_id", F.col("_p.policy_id")).withColumn("policy", F.col("_p.policy")).drop("_p")
