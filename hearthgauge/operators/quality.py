"""Reject cascades, funnels, rates, gates and the evidence behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class GateError(ValueError):
    """A quality gate isn't met."""


def cascade(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds; null if none does. A condition that is null doesn't hold."""
    (name, condition), *rest = reasons
    return reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rest, F.when(condition, F.lit(name)))


def funnel(rows: DataFrame, group: list[str], reason: str, before_eligible: list[str], after: list[str]) -> DataFrame:
    """Per group: seen, eligible, matched, and a count for each reason; one aggregation that combines before its shuffle."""
    r = F.col(reason)
    early = F.coalesce(r.isin(*before_eligible), F.lit(False))
    return rows.groupBy(*group).agg(F.count("*").alias("seen"), F.count_if(~early).alias("eligible"), F.count_if(r.isNull()).alias("matched"), *(F.count_if(F.coalesce(r == x, F.lit(False))).alias(f"excluded_{x}") for x in [*before_eligible, *after]))


def rates(rows: DataFrame, group: str, matched: Column, eligible: Column) -> DataFrame:
    """Match rate of each group and of all (group null) in one pass; 0 where nothing is eligible."""
    ok, base = F.count_if(matched & eligible), F.count_if(eligible)
    return rows.rollup(group).agg(base.alias("eligible"), ok.alias("matched")).withColumn("rate", F.when(F.col("eligible") > 0, F.col("matched") / F.col("eligible")).otherwise(F.lit(0.0)))


def failing(stats: DataFrame, least: float) -> DataFrame:
    """Groups with eligible rows whose match rate is below `least`."""
    return stats.where((F.col("eligible") > 0) & (F.col("matched") / F.col("eligible") < least))


def reconciled(rows: DataFrame, reason: str) -> DataFrame:
    """One row: raw, accepted, excluded, and whether they add up."""
    return rows.agg(F.count("*").alias("raw_rows"), F.count_if(F.col(reason).isNull()).alias("accepted"), F.count(reason).alias("excluded")).withColumn("reconciled", F.col("raw_rows") == F.col("accepted") + F.col("excluded"))


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def require(df: DataFrame, what: str) -> None:
    """Raises GateError with the first rows of `df` unless it is empty."""
    if bad := df.limit(5).collect():
        raise GateError(f"{what}: {bad}")


def drop_check(now: DataFrame, before: DataFrame, key: str, most: float = 0.1) -> DataFrame:
    """Sources whose record_count fell by more than `most` against the last good one."""
    b = before.select(key, F.col("record_count").alias("previous_count"))
    return now.join(b, key).where(F.col("record_count") < F.col("previous_count") * (1 - most))


def presence(rows: DataFrame, group: list[str], column: str, values: list[str]) -> DataFrame:
    """Groups that lack one of `values`."""
    return rows.groupBy(*group).agg(F.collect_set(column).alias("__v")).where(F.size(F.array_intersect("__v", F.array(*map(F.lit, values)))) < len(values)).drop("__v")


def latest_samples(samples: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last sample of each key."""
    columns = [c for c in samples.columns if c not in (*key, order)]
    return samples.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("__v")).select(*key, *(F.col(f"__v.{c}").alias(c) for c in columns))


def evaluate_audit(samples: DataFrame, group: str, ident: str, order: str, each: int, kinds: str, least_kinds: int) -> DataFrame:
    """Per group: matched, mismatched, distinct kinds, and whether the manual audit passes (last sample of an id counts)."""
    last = latest_samples(samples, [group, ident], order)
    own = last.groupBy(group).agg(F.count_if(F.col("result") == "matched").alias("matched"), F.count_if(F.col("result") == "mismatch").alias("mismatched"), F.count_distinct(F.when(F.col("result") == "matched", F.col(kinds))).alias("kinds"))
    return own.withColumn("passed", (F.col("matched") >= each) & (F.col("mismatched") == 0) & (F.col("kinds") >= least_kinds))


def resolve_evidence(points: DataFrame, matches: DataFrame, key: list[str], category: str, known: list[str], by: list[str] | None = None) -> DataFrame:
    """Per point: unconfirmed without a match, blocked with several or an unknown class, else resolved with its class.

    by: columns that points and matches share, in place of the key, where points of one place have one row of matches.
    """
    by = by or key
    n = matches.groupBy(*by).agg(F.count("*").alias("n_matches"), F.min(category).alias("category"))
    out = points.select(*key, *(c for c in by if c not in key)).join(n, by, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    state = F.when(F.col("n_matches") == 0, "unconfirmed").when(F.col("n_matches") > 1, "blocked").when(F.col("category").isin(*known), "resolved").otherwise("blocked")
    return out.select(*key, "n_matches", state.alias("evidence"), F.when(state == "resolved", F.col("category")).alias("category"))


def fields_equal(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Per key of both: whether each field is equal, and all of them."""
    x, y = a.select(*key, F.struct(*fields).alias("x")), b.select(*key, F.struct(*fields).alias("y"))
    each = {f"{f}_equal": F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")) for f in fields}
    out = x.join(y, key).withColumns(each).drop("x", "y")
    return out.withColumn("all_equal", reduce(lambda p, q: p & q, (F.col(c) for c in each)))


def promotable(catalog: DataFrame, prerequisites: list[str]) -> DataFrame:
    """`catalog` (id, status, automated_passed, manual_passed, error) with `next_status`.

    official if both gates passed and, for rail, all prerequisites are official; a failed match rate makes a source
    unavailable, another error failed.
    """
    ready = catalog.where(F.col("id").isin(*prerequisites)).agg((F.count_if(F.col("status") == "official") == len(prerequisites)).alias("__ready"))
    gates = F.col("automated_passed") & F.col("manual_passed") & (F.col("__ready") | (F.col("id") != "rail"))
    error = F.when(F.contains("error", F.lit("match rate")), "unavailable").when(F.col("error").isNotNull(), "failed")
    # ready is one row, so this is a lookup and no product of tables
    return catalog.join(F.broadcast(ready)).withColumn("next_status", F.coalesce(error, F.when(gates, "official").otherwise("unavailable"))).drop("__ready")
