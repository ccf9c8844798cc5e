"""Request-log enrichment: aliases, endpoints, headers and credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import SECOND
from emberwatch.operators.carry import carry_last
from emberwatch.operators.thinning import kept_points, thin

# Fixed value: how long before expiry a credential is renewed.
REFRESH_SKEW_SECONDS = 300
_HOUR = 3600 * SECOND


def _listed(rows: DataFrame, order: str | None, value: str) -> str:
    """The column that tells which row is listed last: ``order``, else ``pos`` if there is one, else the value itself."""
    return order or ("pos" if "pos" in rows.columns else value)


def resolve_aliases(requests: DataFrame, aliases: DataFrame, order: str | None = None) -> DataFrame:
    """Add ``resolved_model``. The join side is the optimiser's choice by size, here and below.

    An alias that is listed again counts by its last row, by ``order`` or the place ``pos``, so requests are never multiplied.
    """
    order = _listed(aliases, order, "target")
    targets = aliases.groupBy(F.col("alias").alias("model")).agg(F.max_by("target", order).alias("target"))
    return requests.join(targets, "model", "left").withColumn("resolved_model", F.coalesce("target", "model")).drop("target")


def in_family(model: Column, resolved_model: Column, prefix: str) -> Column:
    """R2: a model of one provider family, by its own name or that of its alias target."""
    return F.startswith(model, F.lit(prefix)) | F.startswith(resolved_model, F.lit(prefix))


def correct_endpoints(requests: DataFrame, catalog: DataFrame, order: str | None = None) -> DataFrame:
    """Replace a base that is set but differs from the catalog's; add ``corrected``.

    A model that is listed again counts by its last row with a name and a base, by ``order`` or the place ``pos``.
    """
    order = _listed(catalog, order, "api_base")
    right = catalog.filter(F.col("model_name").isNotNull() & F.col("api_base").isNotNull()).groupBy(
        F.col("model_name").alias("model")
    ).agg(F.max_by("api_base", order).alias("_base"))
    joined = requests.join(right, "model", "left")
    wrong = F.coalesce((F.col("api_base") != "") & (F.col("api_base") != F.col("_base")), F.lit(False))
    return (
        joined.withColumn("corrected", wrong)
        .withColumn("api_base", F.when(F.col("corrected"), F.col("_base")).otherwise(F.col("api_base")))
        .drop("_base")
    )


def issued_headers(headers: Column, token: Column) -> Column:
    """Headers of a credential without the key header, with the (hashed) bearer token."""
    bearer = F.concat(F.lit("Bearer sha256:"), F.sha2(token, 256))
    kept = F.map_filter(headers, lambda name, _: ~name.isin("x-api-key", "Authorization"))
    return F.map_concat(kept, F.create_map(F.lit("Authorization"), bearer))


def inject_headers(request_headers: Column, injected: Column) -> Column:
    """Merge into possibly missing request headers; the injected value wins."""
    base = F.coalesce(request_headers, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda name, _: ~F.map_contains_key(injected, name)), injected)


def credentials_in_force(
    requests: DataFrame, credentials: DataFrame, keys: list[str], at: str = "at_us", block_us: int = _HOUR,
    tie: str = "request_id", order: str | None = None,
) -> DataFrame:
    """As-of join, the last credential of the provider issued at or before each request, as the struct ``credential``.

    Both logs are put on one time line and the credential is carried forward in time blocks, so a
    provider with most of the traffic is spread over many tasks. Of a request only ``keys``, ``at`` and ``tie`` are put there; the
    rest of its row is joined last. ``credentials`` has ``keys``, ``issued_at`` and any further columns; of those issued in one
    microsecond the one of the greatest ``order`` counts, or, without it, of the greatest row as JSON. Requests without a time have none.
    """
    rest = F.struct(*[c for c in credentials.columns if c not in keys])
    issued = credentials.groupBy(*keys, F.col("issued_at").alias(at)).agg(F.max_by(rest, F.col(order) if order else F.to_json(rest)).alias("_issued"))
    # A credential issued at the very time of a request is in force for it.
    asked = requests.select(*keys, at, tie).distinct()
    timeline = asked.withColumn("_turn", F.lit(1)).unionByName(issued.withColumn("_turn", F.lit(0)), allowMissingColumns=True)
    carried = carry_last(timeline, keys, at, "_turn", F.col("_issued"), "credential", block_us, include_current=True)
    found = carried.filter("_turn = 1").select(*[F.col(c).alias(f"_{c}") for c in (*keys, at, tie)], "credential")
    same = [requests[c].eqNullSafe(found[f"_{c}"]) for c in (*keys, at, tie)]
    return requests.join(found, same, "left").select(*requests.columns, "credential")


def credential_state(now: Column, expires_at: Column, skew_us: int = REFRESH_SKEW_SECONDS * SECOND) -> Column:
    """``fresh``, ``due`` for renewal but valid, or ``expired`` (also when there is none)."""
    return (
        F.when(now < expires_at - skew_us, "fresh").when(now < expires_at, "due").otherwise("expired")
    )


def refresh_points(
    requests: DataFrame, invalidations: DataFrame | None, keys: list[str], ttl_us: int | Column,
    at: str = "at_us", tie: str = "request_id", skew_us: int = REFRESH_SKEW_SECONDS * SECOND, longest_us: int | None = None,
) -> DataFrame:
    """Requests that renew the credential; the others reuse it.

    A request renews if it comes ``ttl - skew`` or more after the last renewal, or after an
    invalidation (E12 events) that followed it. ``ttl_us`` may be a column, the lifetime of what the request is given if it
    renews, none longer than ``longest_us``.
    """
    longest = None if longest_us is None else longest_us - skew_us
    return thin(requests, keys, at, tie, ttl_us - skew_us, resets=invalidations, longest_us=longest)


def renewals(
    requests: DataFrame, invalidations: DataFrame | None, keys: list[str], lifetime_us: Column, longest_us: int, succeeds: Column,
    at: str = "at_us", tie: str = "request_id", skew_us: int = REFRESH_SKEW_SECONDS * SECOND,
) -> DataFrame:
    """``requests`` with the ``outcome`` of each: ``cached`` if the credential in hand is not due, else ``refreshed``, or, if
    renewing fails, ``stale-ok`` while it is valid and ``error`` after that.

    ``succeeds`` tells of each request whether it would be given a credential if it asked for one, ``lifetime_us`` for how long, longer
    than the skew and no longer than ``longest_us``. A failed attempt changes nothing, so the renewals are the requests kept by thinning
    among those that would succeed. An invalidation leaves no credential from the next microsecond on. Requests are ordered by ``at`` and
    ``tie``, which tell one from the other; without a time they are left out.
    """
    asked = requests.where(F.col(at).isNotNull()).withColumns({"_life": lifetime_us.cast("bigint"), "_good": F.coalesce(succeeds, F.lit(False))})
    given = kept_points(asked.where("_good"), keys, at, tie, F.col("_life") - skew_us, invalidations, longest_us=longest_us - skew_us)
    same = [asked[c].eqNullSafe(given[c]) for c in (*keys, at, tie)]
    marked = asked.join(given.withColumn("_renews", F.lit(True)), same, "left").select(*[asked[c] for c in asked.columns], "_renews")
    marked = marked.withColumns({"_order": F.struct(F.lit(0).alias("reset"), F.col(tie).alias("tie")), "_expires": F.when(F.col("_renews"), F.col(at) + F.col("_life"))})
    if invalidations is not None:
        nobody = F.lit(None).cast(requests.schema[tie].dataType)
        ends = invalidations.where(F.col(at).isNotNull()).select(
            *keys, at, F.struct(F.lit(1).alias("reset"), nobody.alias("tie")).alias("_order"), F.lit(0).cast("bigint").alias("_expires")
        )
        marked = marked.unionByName(ends, allowMissingColumns=True)
    held = carry_last(marked, keys, at, "_order", F.col("_expires"), "_held", longest_us)
    until = F.coalesce("_held", F.lit(0))
    outcome = F.when(F.col("_renews"), "refreshed").when(F.col(at) < until - skew_us, "cached").when(F.col(at) < until, "stale-ok").otherwise("error")
    return held.where("_order.reset = 0").withColumn("outcome", outcome).select(*requests.columns, "outcome")


def refresh_outcome(succeeded: Column, now: Column, expires_at: Column) -> Column:
    """A failed renewal keeps a credential that is still valid, else the request fails."""
    return F.when(succeeded, "refreshed").when(now < expires_at, "stale-ok").otherwise("error")
