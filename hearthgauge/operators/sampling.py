"""Samples for manual audits: by strata, then filled up; always by a given order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def stratified(rows: DataFrame, strata: str, order: str, each: int, total: int, reserve: int, group: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """Rows with `role`: primary or reserve. In each group: `each` rows of each of `values` (default: all strata), filled
    up to `total` in `order` (unique in a group), then `reserve` further rows.

    Only the first rows of each stratum and of each group can be chosen; those are cut out first, by limits that hold
    before the shuffle, so what is then ranked is small for any size of the input.
    """
    group = group or []
    most = total + reserve
    first = top_per_group(rows, group, order, most) if group else rows.orderBy(order).limit(most)
    small = first.unionByName(top_per_group(rows, [*group, strata], order, each)).dropDuplicates([*group, order])
    ranked = small.withColumn("__s", F.row_number().over(Window.partitionBy(*group, strata).orderBy(order)))
    picked = (F.col("__s") <= each) & (F.col(strata).isin(*values) if values else F.lit(True))
    placed = ranked.withColumn("__p", F.row_number().over(Window.partitionBy(*group).orderBy(F.when(picked, 0).otherwise(1), order)))
    primary = placed.withColumn("__primary", F.col("__p") <= total)
    after = primary.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__primary").orderBy(order)))
    role = F.when(F.col("__primary"), "primary").when(F.col("__r") <= reserve, "reserve")
    return after.withColumn("role", role).where(F.col("role").isNotNull()).drop("__s", "__p", "__primary", "__r")


def top_per_group(rows: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """The first `n` rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def prioritised(rows: DataFrame, group: list[str], quotas: list[tuple[str, int]], order: str, total: int) -> DataFrame:
    """Rows with `slot`: for each (condition, n) in turn the first n rows in `order` (unique in a group) that meet it and
    aren't taken yet, then others up to `total`.

    A quota takes none but the first rows that meet it, as many as it and those before it ask for; those are cut out by
    limits that hold before the shuffle. The turns are then taken inside one small array a group.
    """
    asked, cuts = 0, []
    for condition, n in quotas:
        asked += n
        cuts.append(top_per_group(rows.where(condition), group, order, asked))
    small = reduce(DataFrame.unionByName, cuts, top_per_group(rows, group, order, asked + total)).dropDuplicates([*group, order])
    meets = F.array(*(F.coalesce(F.expr(condition), F.lit(False)) for condition, _ in quotas))
    row = F.struct(F.col(order).alias("o"), meets.alias("meets"), F.lit(len(quotas)).alias("slot"), F.struct(*rows.columns).alias("row"))
    held = small.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("__a"))
    held = held.withColumn("__a", F.transform("__a", lambda x: x["r"]))
    for k, (_, n) in enumerate(quotas):
        free = F.filter(_free("__a", k, len(quotas)), lambda i: i.isNotNull())
        held = held.withColumn("__t", F.slice(free, 1, n)).withColumn("__a", _taken("__a", k))
    best = F.slice(F.array_sort(F.transform("__a", lambda x: F.struct(x["slot"].alias("slot"), x["o"].alias("o"), x["row"].alias("row")))), 1, total)
    return held.select(F.explode(best).alias("x")).select("x.row.*", "x.slot")


def _free(rows: str, k: int, none: int) -> Column:
    """The places of rows that meet condition k and have no slot; null for the others."""
    return F.transform(rows, lambda x, i: F.when(x["meets"][k] & (x["slot"] == none), i))


def _taken(rows: str, k: int) -> Column:
    """`rows` with slot k at the places of column __t."""
    slot = lambda x, i: F.when(F.array_contains("__t", i), F.lit(k)).otherwise(x["slot"])
    return F.transform(rows, lambda x, i: F.struct(x["o"].alias("o"), x["meets"].alias("meets"), slot(x, i).alias("slot"), x["row"].alias("row")))


def different_second(rows: DataFrame, group: list[str], category: str, order: str) -> DataFrame:
    """The first row of each group, and the first after it of another category."""
    first = rows.groupBy(*group).agg(F.min_by(category, order).alias("__c"))
    marked = rows.join(first, group).withColumn("__same", F.col(category) == F.col("__c"))
    return marked.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__same").orderBy(order))).where("__r = 1").drop("__r", "__c", "__same")


def first_by_kind(rows: DataFrame, kind: str, order: str, limits: dict[str, int | None]) -> DataFrame:
    """The first rows, by `order`, of each kind named in `limits`, as many as it says (None: all of them); others go.

    The largest limit is a constant, so a task keeps no more rows of a kind than that before the shuffle.
    """
    bounded = {k: n for k, n in limits.items() if n is not None}
    whole = rows.where(F.col(kind).isin([k for k, n in limits.items() if n is None]))
    if not bounded:
        return whole
    ranked = rows.where(F.col(kind).isin(list(bounded))).withColumn("__rn", F.row_number().over(Window.partitionBy(kind).orderBy(order))).where(F.col("__rn") <= max(bounded.values()))
    own = F.coalesce(*(F.when(F.col(kind) == k, F.lit(n)) for k, n in bounded.items()))
    return whole.unionByName(ranked.where(F.col("__rn") <= own).drop("__rn"))
