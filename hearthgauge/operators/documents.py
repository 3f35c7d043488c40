"""Saved documents and catalogues: versions, migration, merging, coverage, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The first version whose documents hold current data of each kind; older ones are marked legacy
CURRENT, OLDEST, MOST_SAVED = 8, 2, 3
LEGACY_BEFORE = {"risk": 3, "life": 4, "community": 5, "accident": 6, "library": 7, "market": 8}
READINESS_KEYS = ("adapterVersion", "attemptedAt", "reason", "recordCount", "matchingRates", "excluded", "locationMethods", "duplicateCoordinateRate")


def legacy_flags(version: Column, stored: dict[str, Column] | None = None) -> dict[str, Column]:
    """Legacy flag of each kind for a stored version (null: a bare list); flags already stored win."""
    v = F.coalesce(version, F.lit(OLDEST))
    return {kind: F.coalesce(*([stored[kind]] if stored and kind in stored else []), v < first) for kind, first in LEGACY_BEFORE.items()}


def migrate(saved: DataFrame, version: str = "version") -> DataFrame:
    """`saved` of the versions known, with a flag legacy_<kind> for each kind and the current version; others go.

    A flag that is stored with a document stays; one of the current version that has none is not legacy.
    """
    known = saved.where(F.col(version).isNull() | F.col(version).between(OLDEST, CURRENT))
    stored = {k: F.col(f"legacy_{k}") for k in LEGACY_BEFORE if f"legacy_{k}" in saved.columns}
    return known.withColumns({f"legacy_{k}": c for k, c in legacy_flags(F.col(version), stored).items()}).withColumn("version_now", F.lit(CURRENT))


def parse_saved(text: Column, item: str) -> Column:
    """Items (array of `item`, a DDL struct) of a saved text: a bare JSON list, or an envelope with schemaVersion; null if neither."""
    bare = F.from_json(text, f"array<{item}>")
    envelope = F.from_json(text, f"struct<schemaVersion:int,properties:array<{item}>>")
    listed = F.regexp_extract(text, "^\\s*(.)", 1) == "["
    return F.when(listed, bare).when(envelope["schemaVersion"].between(OLDEST, CURRENT), envelope["properties"])


def save_item(saved: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """`saved` with `new`; raises if there would be more than MOST_SAVED."""
    out = saved.unionByName(new)
    if out.limit(MOST_SAVED + 1).count() > MOST_SAVED:
        raise ValueError(f"at most {MOST_SAVED} can be saved")
    return out.orderBy(order)


def delete_item(saved: DataFrame, key: str, value: object) -> DataFrame:
    """`saved` without the items of one key."""
    return saved.where(~F.col(key).eqNullSafe(F.lit(value)))


def failed_sources(states: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """`states` (id, status, attempted_at, message, and values) after a run in which the sources of `failures` (id, message) failed.

    A failed source keeps the values of its last good run; one never seen has the status and nothing else.
    """
    values = [c for c in states.columns if c not in ("id", "status", "attempted_at", "message")]
    gone = failures.select("id", F.col("message").alias("__m"), F.lit(True).alias("__failed"))
    out = states.join(gone, "id", "full_outer")
    kept = lambda c, new: F.when(F.col("__failed"), new).otherwise(F.col(c)).alias(c)
    return out.select("id", kept("status", F.lit("failed")), kept("attempted_at", now), kept("message", F.col("__m")), *values)


def merge_readiness(previous: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All sources of either; the new entry of a source wins."""
    values = [c for c in previous.columns if c != key]
    p, n = previous.select(key, F.struct(*values).alias("p")), new.select(key, F.struct(*values).alias("n"))
    return p.join(n, key, "full_outer").select(key, F.coalesce("n", "p").alias("v")).select(key, "v.*")


def describe_sources(descriptors: DataFrame, states: DataFrame, readiness: DataFrame) -> DataFrame:
    """Descriptors with their state, and with a readiness entry for blocked candidates only."""
    out = descriptors.join(states, "id", "left").join(readiness.withColumnRenamed("id", "__r").withColumn("__has", F.lit(True)), (F.col("id") == F.col("__r")) & (F.col("status") == "unavailable") & F.col("id").isin("market", "park"), "left")
    return out.withColumn("has_readiness", F.coalesce("__has", F.lit(False))).drop("__r", "__has")


def runtime_status(states: DataFrame, district: str) -> DataFrame:
    """`states` (status, districts) as they hold for one district: a source that doesn't cover it is unavailable; no list covers all."""
    outside = (F.size("districts") > 0) & ~F.array_contains("districts", district)
    return states.withColumn("runtime_status", F.when(outside, "unavailable").otherwise(F.col("status")))


def latest_update(states: DataFrame, group: list[str], fallback: Column) -> DataFrame:
    """The latest successful date of each group, else the catalogue's."""
    return states.groupBy(*group).agg(F.max(F.when(F.col("status") == "official", F.col("updated_at"))).alias("__u"), F.max(fallback).alias("__f")).select(*group, F.coalesce("__u", "__f").alias("updated_at"))


def unchanged(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """`now` with `skip`: its source has the digest of the last good run."""
    return now.join(before.select(key, F.col(digest).alias("__d")), key, "left").withColumn("skip", F.coalesce(F.col(digest) == F.col("__d"), F.lit(False))).drop("__d")


def seasons(start: Column, end: Column) -> Column:
    """Quarters from `start` to `end` as `<ROC year>S<quarter>`."""
    first = F.trunc(start, "quarter")
    return F.transform(F.sequence(first, end, F.expr("interval 3 months")), lambda d: F.concat((F.year(d) - 1911).cast("string"), F.lit("S"), F.quarter(d).cast("string")))


def retention(dates: Column, now: Column, years: int = 5) -> Column:
    """Whether a date is not before the rolling window of `years` (of 365.25 days) that ends `now`; later ones stay."""
    return dates >= F.date_sub(now, int(years * 365.25))
