"""Failure events to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import SECOND, contains_any, strip
from emberwatch.operators.bursts import episodes, sliding_count
from emberwatch.operators.thinning import thin

# Alerting thresholds.
COOLDOWN_SECONDS = 60
BURST_WINDOW_SECONDS = 10
BURST_THRESHOLD = 10
EXCERPT_CHARS = 300

# Labels of alerting codes and, in order of precedence, of exception classes.
CODE_LABELS = {
    "429": "🚦 Rate Limit",
    "401": "🔑 Auth Failure",
    "402": "💳 Quota Exceeded",
    "403": "🔒 Permission Denied",
}
OTHER_CODE_LABEL = "💥 Provider Error ({code})"
CLASS_LABELS = [
    ("RateLimitError", "🚦 Rate Limit"),
    ("AuthenticationError", "🔑 Auth Failure"),
    ("PermissionDeniedError", "🔒 Permission Denied"),
    ("BudgetExceededError", "💳 Budget Exceeded"),
    ("InternalServerError", "💥 Provider 500"),
    ("ServiceUnavailableError", "⚠️ Provider 503"),
    ("BadGatewayError", "⚠️ Provider 502"),
]

# Texts that mark a failed authentication.
AUTH_FAILURE_MARKS = ["401", "Unauthorized", "AuthenticationError", "Forbidden by auth provider"]


def first_set(*values: Column) -> Column:
    """First value that is neither NULL, empty nor zero (``0`` counts as unset in the source)."""
    texts = [v.cast("string") for v in values]
    return F.coalesce(*[F.when(~t.isin("", "0"), t) for t in texts])


def normalise_failures(raw: DataFrame) -> DataFrame:
    """Nested failure records (``slo``, ``model``, ``exc``) to flat columns with their defaults."""
    info, exc = F.col("slo.error_information"), F.col("exc")
    empty = F.lit("")
    return raw.select(
        "event_id", "ts",
        F.coalesce(first_set(info["error_code"], exc["status_code"]), empty).alias("error_code"),
        F.coalesce(first_set(info["error_class"], exc["cls"]), empty).alias("error_class"),
        F.coalesce(first_set(info["llm_provider"], exc["llm_provider"]), empty).alias("provider"),
        F.coalesce(_non_empty(F.col("slo.error_str")), exc["text"], empty).alias("error_str"),
        F.coalesce(_non_empty(F.col("slo.model")), _non_empty(F.col("model")), F.lit("unknown")).alias("model"),
        exc["cls"].alias("exception_class"),
    )


def _non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def _lookup(labels: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key)


def code_label(code: Column) -> Column:
    """Label of an alerting code, or NULL.

    Codes from 500 on are told by their digits, so no integer width limits them.
    """
    before, after = OTHER_CODE_LABEL.split("{code}")
    server_side = F.rlike(code, F.lit(r"^0*([5-9][0-9]{2}|[1-9][0-9]{3,})\z"))
    return F.coalesce(_lookup(CODE_LABELS, code), F.when(server_side, F.concat(F.lit(before), code, F.lit(after))))


def class_label(exception_class: Column, bases: dict[str, list[str]] | None = None) -> Column:
    """Label of the first listed class the exception is, or derives from (``bases``: class → bases)."""
    labels = dict(CLASS_LABELS)
    for derived, parents in (bases or {}).items():
        for name, label in CLASS_LABELS:
            if name in parents or name == derived:
                labels[derived] = label
                break
    return _lookup(labels, exception_class)


def classify(failures: DataFrame, bases: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``label`` and ``fingerprint``; a NULL label is not alertable."""
    labelled = failures.withColumn(
        "label", F.coalesce(code_label(F.col("error_code")), class_label(F.col("exception_class"), bases))
    )
    return labelled.withColumn("fingerprint", F.concat_ws(":", "error_class", "error_code", "model"))


def alertable(classified: DataFrame) -> DataFrame:
    """Failures that count for bursts and alerts."""
    return classified.filter(F.col("label").isNotNull())


def excerpt(text: Column) -> Column:
    """The first characters, stripped, with an ellipsis if the text was longer."""
    cut = strip(F.substring(text, 1, EXCERPT_CHARS))
    return F.when(F.length(text) > EXCERPT_CHARS, F.concat(cut, F.lit("…"))).otherwise(cut)


def body(label: Column, model: Column, provider: Column, error_class: Column, short: Column) -> Column:
    """Alert text; lines of empty fields are left out."""

    def line(before: str, value: Column, after: str = "") -> Column:
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("<b>"), label, F.lit("</b>")),
        F.concat(F.lit("<b>Model:</b> <code>"), model, F.lit("</code>")),
        line("<b>Provider:</b> ", provider),
        line("<b>Class:</b> ", error_class),
        line("\n<pre>", short, "</pre>"),
    )


def is_auth_failure(status: Column, text: Column) -> Column:
    """A 401, or a text that says so."""
    return F.coalesce(status == 401, F.lit(False)) | F.coalesce(contains_any(text, AUTH_FAILURE_MARKS), F.lit(False))


def alerts(classified: DataFrame, at: str = "at_us", cooldown_seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Alertable failures left after the cooldown of their fingerprint."""
    return thin(alertable(classified), ["fingerprint"], at, "event_id", cooldown_seconds * SECOND)


def alert_points(classified: DataFrame, at: str = "at_us", cooldown_seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """``fingerprint``, time and id of the alerts alone."""
    live = alertable(classified).select("fingerprint", at, "event_id")
    return thin(live, ["fingerprint"], at, "event_id", cooldown_seconds * SECOND)


def burst_counts(
    classified: DataFrame, at: str = "at_us", window_seconds: int = BURST_WINDOW_SECONDS, threshold: int = BURST_THRESHOLD
) -> DataFrame:
    """Alertable failures with the count of their window and the burst flag."""
    counted = sliding_count(alertable(classified), at, "event_id", window_seconds * SECOND)
    return counted.withColumn("is_burst", F.col("window_count") >= threshold)


def burst_signals(counted: DataFrame, at: str = "at_us", rearm_seconds: int = BURST_WINDOW_SECONDS) -> DataFrame:
    """One stop signal per burst episode."""
    reason = F.concat(F.col("error_class"), F.lit(" ("), F.col("error_code"), F.lit(")"))
    return episodes(
        counted.filter("is_burst").select(at, "event_id", "window_count", reason.alias("reason")),
        at, "event_id", rearm_seconds * SECOND,
    )
