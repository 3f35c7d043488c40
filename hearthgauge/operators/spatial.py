"""Spatial joins: radius by grid cells, points in polygons by an edge table, nearest within a group."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.geo import METRES_LAT, haversine, segment_distance
from ..sources.scratch import Scratch


def _cells(radius: float, most_lat: float) -> float:
    """Degrees a cell needs so that points within `radius` lie in neighbouring cells, up to latitude `most_lat`."""
    return radius / (111000.0 * math.cos(math.radians(most_lat))) * 1.001


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None, most_lat: float = 60.0, extra: Column | None = None) -> DataFrame:
    """Pairs of a row of `left` and one of `right` (both with lat, lon) at most `radius` metres apart, with `distance`.

    Columns of `left` other than `on` must not occur in `right`. Each left row is dealt to the nine cells around it and
    meets the right rows of those cells in an equi-join, so no pair beyond neighbouring cells is made; `on` columns
    join it. `extra` is a further condition on both sides' columns, tested before the distance. The cell holds the
    rows of a place, so a crowded one is the unit of skew; the join is one that Spark splits. Null coordinates meet nothing.
    """
    size, on = _cells(radius, most_lat), on or []
    near = lambda c: F.floor(F.col(c) / size)
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    a = left.withColumns({"__i": F.explode(F.transform(around, lambda k: near("lat") + k))}).withColumn("__j", F.explode(F.transform(around, lambda k: near("lon") + k)))
    b = right.withColumns({"__i": near("lat"), "__j": near("lon")}).withColumnsRenamed({"lat": "__lat", "lon": "__lon"})
    met = a.join(b, [*on, "__i", "__j"])
    met = met.where(extra) if extra is not None else met
    return met.withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))).where(F.col("distance") <= radius).withColumnsRenamed({"__lat": "right_lat", "__lon": "right_lon"}).drop("__i", "__j")


def places(rows: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Each coordinate of `rows` once (and value of `on`), as many rows share an address; null coordinates are none."""
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL").select(*(on or []), "lat", "lon").distinct()


def edge_table(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, x1, y1, x2, y2) of `rings` (array of rings, array<struct<lon, lat>>, open or closed)."""
    ring = polygons.select(*keys, F.explode("rings").alias("ring"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: F.struct(F.col("ring")[i].alias("a"), F.col("ring")[(i + 1) % F.size("ring")].alias("b")))
    edges = ring.where(F.size("ring") >= 3).select(*keys, F.explode(pairs).alias("e"))
    return edges.select(*keys, F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))


def with_bounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons as one row each: keys, edges (array), and the bounding box."""
    return edges.groupBy(*keys).agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north")
    )


def inside(lat: Column, lon: Column, edges: Column) -> Column:
    """Whether a point is in a polygon given by all its rings' edges: an odd number of crossings (holes cancel), or on an edge."""
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    cross = lambda e: (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
    on = lambda e: (cross(e) == 0) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.exists(edges, on) | odd


def _boxes(west: Column, south: Column, east: Column, north: Column, cell: float) -> Column:
    grid = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return F.flatten(F.transform(grid(south, north), lambda i: F.transform(grid(west, east), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, on: list[str] | None = None, cell: float = 0.05) -> DataFrame:
    """Pairs of a point (lat, lon) and a polygon (west, south, east, north, edges; see with_bounds) that holds it.

    Polygons are dealt to the grid cells their boxes touch, points to their one cell; they meet by cell (and `on`),
    then the box and the crossings decide. All matches are returned, so 0, 1 and many stay distinct.
    """
    on = on or []
    dealt = polygons.withColumn("__c", F.explode(_boxes(F.col("west"), F.col("south"), F.col("east"), F.col("north"), cell)))
    placed = points.withColumn("__c", F.struct(F.floor(F.col("lat") / cell).alias("i"), F.floor(F.col("lon") / cell).alias("j")))
    met = placed.join(dealt, [*on, "__c"]).where(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    return met.where(inside(F.col("lat"), F.col("lon"), F.col("edges"))).drop("__c", "west", "south", "east", "north", "edges")


def first_match(points: DataFrame, matches: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """`points` with `values` of the match of smallest `order`; null where nothing matched."""
    best = matches.groupBy(*key).agg(F.min_by(F.struct(*values), F.col(order)).alias("__m"))
    return points.join(best, key, "left").select(*points.columns, *(F.col(f"__m.{v}").alias(v) for v in values))


def nearest(left: DataFrame, right: DataFrame, group: list[str], key: list[str], category: str, order: str, values: list[str], cell: float = 250.0, levels: int = 18) -> DataFrame:
    """Per row of `left` (key, lat, lon) and category of `right` in its group: distance and `values` of the nearest there.

    The answer looks at the whole group (a district) and not beyond it, ties by `order`. Cells of `cell` metres, and of
    twice the size on each of `levels`, tell how far each place has to look: on the first level on which its cell or one
    beside it holds a row of the category, that row is less than two cells off either way, so all that can be nearer is
    in the cells around as many as that distance spans (three, and more of longitude where degrees are short). So each
    row meets, once, those of the cells that fit what is around it, and no group meets itself; the last levels are wider
    than the Earth, so every row has its answer. What places have to look at is worked out for occupied cells, not rows.
    Null coordinates have no nearest. Nothing is written. For latitudes up to 75 degrees; the date line is a border.
    Rows at one coordinate of a group share an answer, and of the rows of a category there only the first can be one, so
    it is places that meet. What is dealt to cells is many times its table, which Spark's estimate does not see: those
    joins are merges, so that no such side is collected by the driver.
    """
    size = _cells(cell, 60.0)
    spot = [*group, "lat", "lon"]
    first = right.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(*group, category, "lat", "lon").agg(F.min(F.struct(order, *values)).alias("__v"))
    asking, first = (x.withColumns({"__i": F.floor(F.col("lat") / size), "__j": F.floor(F.col("lon") / size)}) for x in (places(left, group), first))
    there = first.select(*group, category, "__v", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "__i", "__j")
    place = ["__k", "__a", "__b"]

    def on_level(df: DataFrame, level: Column) -> DataFrame:
        """`df` with the cell that holds its own on a level: cells of one level are made of four of the one below."""
        up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__k"))).cast("bigint")
        return df.withColumn("__k", level).withColumns({"__a": up("__i"), "__b": up("__j")})

    def beside(df: DataFrame, high: Column, wide: Column) -> DataFrame:
        """`df` once for its own cell and each of those up to `high` and `wide` cells from it."""
        around = lambda c, n: F.explode(F.sequence(F.col(c) - n, F.col(c) + n))
        return df.withColumn("__a", around("__a", high)).withColumn("__b", around("__b", wide))

    def spans(lat: Column, side: Column) -> tuple[Column, Column]:
        """Cells of `side` degrees, of latitude and of longitude, that may hold what is nearer than two cells each way."""
        shrink = F.cos(F.radians(F.least(F.abs(lat) + side * 4, F.lit(89.0))))
        slack = F.when(side <= 0.1, 1.001).otherwise(1.1)
        wide = F.least(F.ceil(2 * slack * F.sqrt(1 + 1 / (shrink * shrink))), F.ceil(360 / side) + 1)
        return F.when(side <= 0.1, 3).otherwise(4).cast("bigint"), F.when(side > 5, F.ceil(360 / side) + 1).otherwise(wide).cast("bigint")

    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    occupied = on_level(first.select(*group, category, "__i", "__j").distinct(), every).select(*group, category, *place).distinct()
    reached = beside(occupied, F.lit(1).cast("bigint"), F.lit(1).cast("bigint")).distinct()
    cells = on_level(asking.select(*group, "__i", "__j").distinct(), every)
    looks = cells.join(reached.hint("merge"), [*group, *place]).groupBy(*group, category, "__i", "__j").agg(F.min("__k").alias("__k"))
    own = on_level(asking.join(looks.hint("merge"), [*group, "__i", "__j"]), F.col("__k")).drop("__i", "__j")
    asked = beside(own, *spans(F.col("lat"), size * F.pow(F.lit(2.0), F.col("__k"))))
    dealt = on_level(there, every).drop("__i", "__j")
    met = asked.join(dealt.hint("merge"), [*group, category, *place]).withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")))
    best = met.groupBy(*spot, category).agg(F.min(F.struct("distance", "__v")).alias("m"))
    found = left.select(*spot, *(k for k in key if k not in spot)).join(best, spot)
    return found.select(*key, category, F.col("m.distance").alias("distance"), *(F.col(f"m.__v.{v}").alias(v) for v in values))


def in_own_polygon(points: DataFrame, polygons: DataFrame, on: list[str], tolerance: float = 0.0) -> DataFrame:
    """`points` with `matches`: whether each lies in the polygon of its own key, or at most `tolerance` metres beside it."""
    joined = points.join(polygons.select(*on, "edges"), on, "left")
    lat, lon = F.col("lat"), F.col("lon")
    beside = F.array_min(F.transform("edges", lambda e: segment_distance(lat, lon, e["y1"], e["x1"], e["y2"], e["x2"])))
    hit = inside(lat, lon, F.col("edges")) | (beside <= tolerance if tolerance else F.lit(False))
    return joined.withColumn("boundary_distance", beside).withColumn("matches", F.coalesce(hit, F.lit(False))).drop("edges")


def _grid(row, steps: int) -> tuple:
    """Points (column, row, lon, lat, metres from the edge) of a `steps` by `steps` grid over a polygon's box that are
    inside it, by column, then row. Edges are taken 64 at a time, so memory doesn't grow with a polygon."""
    k = np.arange(1, steps + 1)
    xi, yi = np.repeat(k, steps), np.tile(k, steps)
    lon, lat = row.west + (row.east - row.west) * xi / (steps + 1), row.south + (row.north - row.south) * yi / (steps + 1)
    edges = [np.asarray(c, float)[:, None] for c in (row.x1, row.y1, row.x2, row.y2)]
    parts = [[c[at : at + 64] for c in edges] for at in range(0, len(edges[0]), 64)]
    odd, on = np.zeros(len(lon), bool), np.zeros(len(lon), bool)
    for x1, y1, x2, y2 in parts:
        odd ^= np.logical_xor.reduce(((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1))
        level = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) == 0
        on |= np.any(level & (lon >= np.minimum(x1, x2)) & (lon <= np.maximum(x1, x2)) & (lat >= np.minimum(y1, y2)) & (lat <= np.maximum(y1, y2)), axis=0)
    xi, yi, lon, lat = (v[odd | on] for v in (xi, yi, lon, lat))
    kx, nearest2 = np.cos(np.radians(lat)) * METRES_LAT, np.full(len(lon), np.inf)
    for x1, y1, x2, y2 in parts:
        ax, ay = (x1 - lon) * kx, (y1 - lat) * METRES_LAT
        dx, dy = (x2 - lon) * kx - ax, (y2 - lat) * METRES_LAT - ay
        length2 = dx * dx + dy * dy
        t = np.where(length2 > 0, np.clip(-(ax * dx + ay * dy) / length2, 0.0, 1.0), 0.0)
        nearest2 = np.fmin(nearest2, np.fmin.reduce((ax + t * dx) ** 2 + (ay + t * dy) ** 2))
    return xi, yi, lon, lat, np.sqrt(nearest2)


def _grid_points(polygons: DataFrame, keep: list[str], steps: int, least: float, best: bool) -> DataFrame:
    """Rows (keep, xi, yi, lon, lat, d) of the grid points inside each polygon at least `least` metres from its edge; of
    each polygon the one that is farthest, if `best`."""
    own = polygons.select(*keep, "west", "east", "south", "north", *(F.col(f"edges.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    schema = StructType([*own.select(*keep).schema, *(StructField(n, IntegerType()) for n in ("xi", "yi")), *(StructField(n, DoubleType()) for n in ("lon", "lat", "d"))])

    def frame(batch, rows, found):
        columns = dict(zip(("xi", "yi", "lon", "lat", "d"), map(np.concatenate, zip(*found, strict=True)), strict=True))
        return batch[keep].iloc[np.repeat(rows, [len(f[0]) for f in found])].assign(**columns)

    def points(batches):
        for batch in batches:
            rows, found = [], []
            for at, row in enumerate(batch.itertuples(index=False)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    grid = _grid(row, steps)
                micro = np.rint(grid[-1] * 1e6) / 1e6
                kept = np.flatnonzero((grid[-1] if best else micro) >= least)
                kept = kept[[micro[kept].argmax()]] if best and len(kept) else kept
                rows.append(at)
                found.append([v[kept] for v in grid])
                if len(rows) == (1000 if best else 50):
                    yield frame(batch, rows, found)
                    rows, found = [], []
            if rows:
                yield frame(batch, rows, found)

    return own.mapInPandas(points, schema)


def outside_polygons(points: DataFrame, polygons: DataFrame, on: list[str], cell: float = 0.05) -> DataFrame:
    """`points` that no polygon (see points_in_polygons) of theirs holds; a point is done with at the first that does."""
    dealt = polygons.select(*(F.col(c).alias(f"__{c}") for c in on), "west", "south", "east", "north", "edges", F.explode(_boxes(F.col("west"), F.col("south"), F.col("east"), F.col("north"), cell)).alias("__c"))
    lat, lon = F.col("lat"), F.col("lon")
    placed = F.struct(F.floor(lat / cell).alias("i"), F.floor(lon / cell).alias("j")) == F.col("__c")
    box = lat.between(F.col("south"), F.col("north")) & lon.between(F.col("west"), F.col("east"))
    return points.join(dealt, reduce(lambda a, b: a & b, [*(F.col(c) == F.col(f"__{c}") for c in on), placed, box, inside(lat, lon, F.col("edges"))]), "left_anti")


def interior_point(polygons: DataFrame, key: list[str], steps: int = 39, least: float = 20.0, excluded: DataFrame | None = None, on: list[str] | None = None, cell: float = 0.01) -> DataFrame:
    """Per polygon: the point of a `steps` by `steps` grid over its box, inside it and at least `least` metres from its
    edge, that is farthest from the edge; ties, to a micrometre, take the first by column, then row.

    excluded: polygons (`on` and the columns of with_bounds) in which the point must not be, and from whose edges it is
    to be as far as from its own; a polygon is held against those with its values of `on`. They may be many, so grid
    points are rows then, meet the excluded polygons by cell of `cell` degrees until one holds them, and those left meet
    the edges in the cells that are nearer than their own.
    """
    # few bytes with much work each: dealt over all cores, which adaptive execution would not do for their size
    polygons = polygons.repartition(2 * polygons.sparkSession.sparkContext.defaultParallelism, *key)
    spots = _grid_points(polygons, [*key, *(c for c in on or [] if c not in key)], steps, least, excluded is None)
    if excluded is not None:
        place, wide = [*key, "xi", "yi"], 5 * cell
        others = excluded.select(*on, "west", "south", "east", "north", "edges")
        free = outside_polygons(spots.repartition(*key, "xi", "yi"), others, on, cell)
        up = F.col("d") / METRES_LAT * 1.001
        side = up / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
        reach = free.withColumn("__c", F.explode(_boxes(F.col("lon") - side, F.col("lat") - up, F.col("lon") + side, F.col("lat") + up, wide)))
        edges = others.select(*on, F.explode("edges").alias("e")).select(*on, "e.*")
        edges = edges.withColumn("__c", F.explode(_boxes(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), wide)))
        beside = segment_distance(F.col("lat"), F.col("lon"), F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
        near = reach.join(edges, [*on, "__c"]).withColumn("beside", beside).where(F.col("beside") < F.col("d")).groupBy(*place).agg(F.min("beside").alias("beside"))
        spots = free.join(near, place, "left").withColumn("d", F.coalesce("beside", "d")).where(F.round("d", 6) >= least)
    best = spots.groupBy(*key).agg(F.min(F.struct((-F.round("d", 6)).alias("r"), "xi", "yi", "lon", "lat", "d")).alias("m"))
    return best.select(*key, F.col("m.lon").alias("lon"), F.col("m.lat").alias("lat"), F.col("m.d").alias("edge_distance"))


def ordered(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """`df` with `ord`, the place of each row among those of its keys in the given order."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
