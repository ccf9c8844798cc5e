"""V9: the text report of one snippet, built in its own row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording and rulers of the report.
_CLEAN = "No side-channel exfiltration patterns detected."
_TITLE = "SIDE-CHANNEL EXFILTRATION SCAN REPORT"
_WIDTH = 60


def finding_line(f: Column) -> Column:
    """``[SEVERITY] Lline:col (type) message`` of one finding."""
    return F.concat(
        F.lit("["), f["severity"], F.lit("] L"), f["line"].cast("string"), F.lit(":"), f["col"].cast("string"),
        F.lit(" ("), f["leak_type"], F.lit(") "), f["message"],
    )


def report(findings: Column, severity: Column, blocked: Column, tainted_vars: Column) -> Column:
    """Report text: counts, verdict, names and the numbered findings with their code."""
    ruler = F.lit("=" * _WIDTH)
    numbered = F.transform(
        findings,
        lambda f, i: F.concat(
            F.lit("\n["), (i + 1).cast("string"), F.lit("] "), finding_line(f),
            F.when(f["code_snippet"] != "", F.concat(F.lit("\n    Code: "), f["code_snippet"])).otherwise(""),
        ),
    )
    text = F.concat_ws(
        "\n",
        ruler, F.lit(_TITLE), ruler,
        F.concat(F.lit("Findings: "), F.size(findings).cast("string")),
        F.concat(F.lit("Max Severity: "), F.coalesce(severity, F.lit("NONE"))),
        F.concat(F.lit("Verdict: "), F.when(blocked, "BLOCK").otherwise("WARN")),
        F.when(F.size(tainted_vars) > 0, F.concat(F.lit("Tainted Variables: "), F.array_join(tainted_vars, ", "))),
        F.lit("-" * _WIDTH),
        numbered,
        F.concat(F.lit("\n"), ruler),
    )
    return F.when(F.size(findings) == 0, _CLEAN).otherwise(text)
