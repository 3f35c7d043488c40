"""Deduplication policies. Order is always given; nothing relies on the order of a DataFrame."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import METRES_LAT, METRES_LON, planar
from ..sources.scratch import Scratch


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """`rows` with is_duplicate: false on the first row of each key."""
    return rows.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def last_wins(rows: DataFrame, keys: list[str], columns: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key, as an aggregation that combines before its shuffle."""
    value = F.max_by(F.struct(*columns), F.struct(*order)).alias("__v")
    return rows.groupBy(*keys).agg(value).select(*keys, *(F.col(f"__v.{c}").alias(c) for c in columns))


def merged_or_conflicting(rows: DataFrame, keys: list[str], order: str, metres: float) -> DataFrame:
    """`rows` with `outcome`: accepted (first of a key), mergedDuplicate within `metres` of that, or conflictingDuplicate."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(order, "lat", "lon")).alias("__f"))
    near = planar(F.col("lat"), F.col("lon"), F.col("__f.lat"), F.col("__f.lon")) <= metres
    return rows.join(first, keys).withColumn("outcome", F.when(F.col(order) == F.col(f"__f.{order}"), "accepted").when(near, "mergedDuplicate").otherwise("conflictingDuplicate")).drop("__f")


def greedy_unique(rows: DataFrame, group: list[str], ident: str, order: str, places: int = 7) -> DataFrame:
    """`rows` with `outcome`: accepted, duplicateId or duplicateCoordinate, in `order` (unique) within `group`.

    Only accepted rows claim their id and coordinate (rounded to `places`), so each outcome depends on those before it.
    That order is kept by rounds instead of one task a group: rows that are the first undecided ones of both their id
    and their coordinate are accepted at once, and what shares either with them is decided. Rounds are as many as the
    longest chain of rows that decide each other; each is written to the shared folder.
    """
    scratch = Scratch(rows.sparkSession, "greedy-unique")
    spot = [F.round("lat", places).alias("__la"), F.round("lon", places).alias("__lo")]
    by_id, by_spot = [*group, ident], [*group, "__la", "__lo"]
    undecided = scratch.save(rows.select(*group, ident, order, *spot), "0")
    accepted, k = [], 0
    while not undecided.isEmpty():
        first_id, first_spot = undecided.groupBy(*by_id).agg(F.min(order).alias(order)), undecided.groupBy(*by_spot).agg(F.min(order).alias(order))
        new = scratch.save(undecided.join(first_id, [*by_id, order], "left_semi").join(first_spot, [*by_spot, order], "left_semi"), f"accepted-{k}")
        k += 1
        undecided = scratch.save(undecided.join(new.select(*by_id), by_id, "left_anti").join(new.select(*by_spot), by_spot, "left_anti"), str(k))
        accepted.append(new)
    if not accepted:
        return rows.withColumn("outcome", F.lit("accepted"))
    own = reduce(DataFrame.unionByName, accepted).select(*by_id, F.col(order).alias("__first"))
    claimed = rows.join(own, by_id, "left")
    outcome = F.when(F.col(order) == F.col("__first"), "accepted").when(F.col("__first") < F.col(order), "duplicateId").otherwise("duplicateCoordinate")
    return claimed.select(*rows.columns, outcome.alias("outcome"))


def greedy_merge(rows: DataFrame, group: list[str], order: str, code: str, metres: float) -> DataFrame:
    """Clusters of `rows` (lat, lon) of one group: in `order`, a row joins the first cluster whose first row is within
    `metres`, else begins one. Returns group, lat, lon of the first row, codes (sorted distinct) and n.

    Rows at one coordinate end in one cluster, that of the first of them, so they are combined first. Cells are so small
    that all coordinates of one are within reach of each other, so a cell has one first row at most, and a coordinate
    meets those of the 25 cells around it. First rows are found in rounds: the earliest undecided coordinate of a cell
    begins a cluster if no earlier undecided one is within reach, and all within its reach are decided. So no task holds
    a group's coordinates; rounds are as many as the longest chain of cells that decide each other, and each is written
    to the shared folder. Rows without a coordinate are one cluster. Ties in `order` go by coordinate.
    """
    scratch = Scratch(rows.sparkSession, "greedy-merge")
    side = max(metres, 1e-3) / math.sqrt(2) * (1 - 1e-9)
    cell = {"__i": F.floor(F.col("lat") * METRES_LAT / side), "__j": F.floor(F.col("lon") * METRES_LON / side)}
    combined = rows.groupBy(*group, "lat", "lon").agg(F.min(order).alias("__first"), F.collect_set(code).alias("__codes"), F.count("*").alias("__n"))
    spots = scratch.save(combined.select(F.struct(*group).alias("__g"), F.struct("__first", "lat", "lon").alias("__o"), "lat", "lon", *(v.alias(k) for k, v in cell.items()), "__codes", "__n"), "spots")
    steps = F.array(*(F.lit(k) for k in range(-2, 3)))

    def reached(first: DataFrame, found: DataFrame) -> DataFrame:
        """`found` beside each of `first` (__g, __by: order and coordinate, cell) within reach of it."""
        dealt = first.withColumn("__i", F.explode(F.transform(steps, lambda k: F.col("__i") + k))).withColumn("__j", F.explode(F.transform(steps, lambda k: F.col("__j") + k)))
        return found.join(dealt, ["__g", "__i", "__j"]).where(planar(F.col("lat"), F.col("lon"), F.col("__by.lat"), F.col("__by.lon")) <= metres)

    left, found, k = scratch.save(spots.where("lat IS NOT NULL AND lon IS NOT NULL").drop("__codes", "__n"), "left-0"), [], 0
    while not left.isEmpty():
        first = left.groupBy("__g", "__i", "__j").agg(F.min("__o").alias("__by"))
        waits = reached(first, left).where(F.col("__o") < F.col("__by")).select("__g", "__by").distinct()
        found.append(scratch.save(first.join(waits, ["__g", "__by"], "left_anti"), f"first-{k}"))
        gone = reached(found[-1], left).select("__g", "__o").distinct()
        k += 1
        left = scratch.save(left.join(gone, ["__g", "__o"], "left_anti"), f"left-{k}")
        scratch.drop(f"left-{k - 1}")
    alone = spots.where("lat IS NULL OR lon IS NULL").select("__g", "__o", F.col("__o").alias("__by"))
    joined = reduce(DataFrame.unionByName, found).transform(reached, spots).groupBy("__g", "__o").agg(F.min("__by").alias("__by")).unionByName(alone) if found else alone
    clusters = spots.join(joined, ["__g", "__o"]).groupBy("__g", "__by").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__codes")))).alias("codes"), F.sum("__n").alias("n"))
    return clusters.select(*(F.col(f"__g.{c}").alias(c) for c in group), F.col("__by.lat").alias("lat"), F.col("__by.lon").alias("lon"), "codes", "n")


def duplicate_coordinate_rate(rows: DataFrame, places: int = 7) -> DataFrame:
    """One row: rows, duplicates (beyond the first of a coordinate) and their rate."""
    spots = rows.groupBy(F.round("lat", places).alias("la"), F.round("lon", places).alias("lo")).agg(F.count("*").alias("n"))
    return spots.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates")).withColumn("rate", F.col("duplicates") / F.nullif("rows", F.lit(0)))
