"""Polygon overlay on segments: clipping, make-valid and simplification as joins, with even-odd polygons in and out.

Coordinates are whole numbers of 10^-PLACES degrees while segments are worked on. Segments are cut at every point where
they meet others of their key until none crosses another; then the parity of the segments above the middle of one tells
what lies on its two sides, and the boundary of a result is where the two sides differ. Finding meetings and counting
what lies above are joins by key and cell, with cells made so that a key has about as many as it has segments: the
segments of one large polygon are spread over tasks as those of many small ones are. Only the rings of a result are put
together in one task a polygon, in linear time, since a polygon is one row.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import Scratch
from .spatial import _boxes, edge_table

PLACES = 7
#: The columns in which segments are counted lean a little, so that none has a side that runs along them.
LEAN = 1.234567e-4
#: Rounds of cutting; each moves a segment by half a unit at most, so two or three are usual.
MOST_ROUNDS = 12
#: Segments in a column of the count, about.
IN_COLUMN = 8

SEGMENT = ["x1", "y1", "x2", "y2"]
RINGS = "rings array<array<struct<lon:double,lat:double>>>"


def segments(polygons: DataFrame, keys: list[str], side: str, places: int = PLACES) -> DataFrame:
    """(keys, x1, y1, x2, y2, a, b) of the rings' edges in whole units, from the smaller end to the larger; a or b is 1.

    Rings of fewer than three points, edges without length and those with a null or infinite coordinate give none.
    """
    whole = [F.round(F.col(c) * 10.0**places) for c in SEGMENT]
    edges = edge_table(polygons, keys).select(*keys, *(w.alias(c) for w, c in zip(whole, SEGMENT, strict=True)))
    fine = edges.where(" AND ".join(f"abs({c}) < 1e12" for c in SEGMENT))
    return _canonical(fine, keys).withColumns({"a": F.lit(int(side == "a")), "b": F.lit(int(side == "b"))}).where("x1 <> x2 OR y1 <> y2")


def _canonical(edges: DataFrame, keys: list[str], *more: str) -> DataFrame:
    one, two = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    held = edges.select(*keys, F.least(one, two).alias("p"), F.greatest(one, two).alias("q"), *more)
    return held.select(*keys, F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"), *more)


def _odd(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Each segment once; a and b say whether it occurs an odd number of times on that side. Even ones cancel."""
    summed = parts.groupBy(*keys, *SEGMENT).agg((F.sum("a") % 2).alias("a"), (F.sum("b") % 2).alias("b"))
    return summed.where("a + b > 0")


def _in_cells(parts: DataFrame, keys: list[str]) -> DataFrame:
    """`parts` with `cell`, once for each cell that a segment passes within a unit; a key has some as many cells as segments."""
    size = parts.groupBy(*keys).agg(F.greatest(F.max("x2") - F.min("x1"), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")), F.lit(1.0)).alias("w"), F.count("*").alias("n"))
    size = size.select(*keys, F.greatest(F.col("w") / F.ceil(F.sqrt(F.greatest("n", F.lit(1)))), F.lit(4.0)).alias("__s"))
    sized = parts.join(size, keys) if keys else parts.crossJoin(F.broadcast(size))  # without keys that is one row
    s, x1, y1, x2, y2 = (F.col(c) for c in ("__s", *SEGMENT))
    columns = F.sequence(F.floor((x1 - 1) / s), F.floor((x2 + 1) / s))

    def rows(i: Column) -> Column:
        at = lambda x: F.when(x2 == x1, y1).otherwise(y1 + (y2 - y1) * (F.least(F.greatest(x, x1), x2) - x1) / F.nullif(x2 - x1, F.lit(0.0)))
        ya, yb = at(i * s - 1), F.when(x2 == x1, y2).otherwise(at((i + 1) * s + 1))
        return F.transform(F.sequence(F.floor((F.least(ya, yb) - 1) / s), F.floor((F.greatest(ya, yb) + 1) / s)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return sized.withColumn("cell", F.explode(F.flatten(F.transform(columns, rows)))).drop("__s")


def _meetings(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, points): the points within a segment at which others of its key meet it."""
    dealt = _in_cells(parts.select(*keys, *SEGMENT), keys)
    other = dealt.withColumnsRenamed({c: f"o{c}" for c in SEGMENT})
    x1, y1, x2, y2, ox1, oy1, ox2, oy2 = (F.col(c) for c in (*SEGMENT, *(f"o{c}" for c in SEGMENT)))
    near = (ox1 <= x2 + 1) & (ox2 >= x1 - 1) & (F.least(oy1, oy2) <= F.greatest(y1, y2) + 1) & (F.greatest(oy1, oy2) >= F.least(y1, y2) - 1)
    met = dealt.join(other, [*keys, "cell"]).where(near & ((x1 != ox1) | (y1 != oy1) | (x2 != ox2) | (y2 != oy2)))
    rx, ry, sx, sy, qx, qy = x2 - x1, y2 - y1, ox2 - ox1, oy2 - oy1, ox1 - x1, oy1 - y1
    turn = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t, u = (qx * sy - qy * sx) / turn, (qx * ry - qy * rx) / turn
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    crossing = F.when(t.between(0, 1) & u.between(0, 1), point(F.round(x1 + t * rx), F.round(y1 + t * ry)))
    length2 = rx * rx + ry * ry

    def beside(x: Column, y: Column) -> Column:
        along, off = (x - x1) * rx + (y - y1) * ry, F.abs((x - x1) * ry - (y - y1) * rx)
        return F.when((along > 0) & (along < length2) & (4 * off * off <= length2), point(x, y))

    points = F.filter(F.array(crossing, beside(ox1, oy1), beside(ox2, oy2)), lambda p: p.isNotNull() & ((p["x"] != x1) | (p["y"] != y1)) & ((p["x"] != x2) | (p["y"] != y2)))
    found = met.select(*keys, *SEGMENT, F.explode(points).alias("p"))
    return found.groupBy(*keys, *SEGMENT).agg(F.collect_set("p").alias("points"))


def noded(parts: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """`parts` (keys, segment, a, b) cut where they meet, so that they share end points only; equal ones cancel in pairs.

    A segment's points are rounded to whole units and it is bent through them, which may make it meet another; so this
    goes round until nothing meets. Ends never move, so a ring stays closed.
    """
    now = scratch.save(_odd(parts, keys), f"{name}-0")
    for k in range(1, MOST_ROUNDS + 1):
        cuts = scratch.save(_meetings(now, keys), f"{name}-cuts-{k}")
        if cuts.isEmpty():
            scratch.drop(f"{name}-cuts-{k}")
            return now
        p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
        along = F.transform("points", lambda o: F.struct(((o["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (o["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))).alias("t"), o.alias("o")))
        line = F.when(F.col("points").isNull(), F.array(p, q)).otherwise(F.concat(F.array(p), F.transform(F.array_sort(along), lambda o: o["o"]), F.array(q)))
        pieces = F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda i: F.struct(F.get("line", i).alias("p"), F.get("line", i + 1).alias("q")))
        cut = now.join(cuts, [*keys, *SEGMENT], "left").withColumn("line", line).select(*keys, F.explode(pieces).alias("e"), "a", "b")
        parts = cut.select(*keys, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"), "a", "b")
        now = scratch.save(_odd(_canonical(parts, keys, "a", "b"), keys), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        scratch.drop(f"{name}-cuts-{k}")
    raise ValueError(f"segments still meet after {MOST_ROUNDS} rounds")


def boundary(parts: DataFrame, keys: list[str], kept) -> DataFrame:
    """(keys, px, py, qx, qy): the segments of noded `parts` on whose two sides kept(in a, in b) differs, with what is
    kept on their left."""
    u, span = (lambda x, y: F.col(x) + LEAN * F.col(y)), F.col("__hi") - F.col("__lo")
    leaning = parts.withColumns({"u1": u("x1", "y1"), "u2": u("x2", "y2")})
    stats = leaning.groupBy(*keys).agg(F.min(F.least("u1", "u2")).alias("__lo"), F.max(F.greatest("u1", "u2")).alias("__hi"), F.ceil(F.count("*") / IN_COLUMN).alias("__n"))
    placed = leaning.join(stats, keys).withColumns({"low": F.least("u1", "u2"), "high": F.greatest("u1", "u2"), "mid": (F.col("u1") + F.col("u2")) / 2, "height": (F.col("y1") + F.col("y2")) / 2})
    column = lambda c: F.least(F.floor((F.col(c) - F.col("__lo")) / span * F.col("__n")), F.col("__n") - 1).cast("long")
    o = F.col
    over = placed.withColumn("col", F.explode(F.sequence(column("low"), column("high")))).select(*keys, "col", *(o(c).alias(f"o{c}") for c in (*SEGMENT, "u1", "u2", "low", "high", "a", "b")))
    at = o("oy1") + (o("oy2") - o("oy1")) * (o("mid") - o("ou1")) / (o("ou2") - o("ou1"))
    itself = (o("x1") == o("ox1")) & (o("y1") == o("oy1")) & (o("x2") == o("ox2")) & (o("y2") == o("oy2"))
    middles = placed.withColumn("col", column("mid")).alias("m")
    same = [o(f"m.{k}").eqNullSafe(o(f"o.{k}")) for k in keys]
    above = middles.join(over.alias("o"), [*same, o("m.col") == o("o.col"), o("olow") <= o("mid"), o("mid") < o("ohigh"), ~itself, at > o("height")], "left")
    own = [o(f"m.{k}").alias(k) for k in keys]
    counted = above.groupBy(*own, *SEGMENT, "a", "b", (o("u1") < o("u2")).alias("rising")).agg((F.coalesce(F.sum("oa"), F.lit(0)) % 2).alias("up_a"), (F.coalesce(F.sum("ob"), F.lit(0)) % 2).alias("up_b"))
    up = kept(o("up_a") == 1, o("up_b") == 1)
    down = kept((o("up_a") + o("a")) % 2 == 1, (o("up_b") + o("b")) % 2 == 1)
    edge = counted.withColumns({"up": up, "down": down}).where("up <> down")
    forward = o("up") == o("rising")  # the left of what runs to higher u is above it
    pick = lambda c, d: F.when(forward, o(c)).otherwise(o(d))
    return edge.select(*keys, pick("x1", "x2").alias("px"), pick("y1", "y2").alias("py"), pick("x2", "x1").alias("qx"), pick("y2", "y1").alias("qy"))


def link_rings(edges: list[dict]) -> list[list[tuple[float, float]]]:
    """Rings of directed edges (px, py, qx, qy) with the inside on their left. Where several go on from a point, the
    sharpest turn to the left is taken, so rings touch but never cross. Points on a straight line are left out."""
    out = defaultdict(list)
    for e in sorted(edges, key=lambda e: (e["px"], e["py"], e["qx"], e["qy"])):
        out[e["px"], e["py"]].append((e["qx"], e["qy"]))
    rings = []
    for first in [*out]:
        while out[first]:
            ring, p, q = [first], first, out[first].pop()
            while q != first:
                ring.append(q)
                back = math.atan2(p[1] - q[1], p[0] - q[0])
                ways = out[q]
                k = min(range(len(ways)), key=lambda k: (back - math.atan2(ways[k][1] - q[1], ways[k][0] - q[0])) % (2 * math.pi))
                p, q = q, ways.pop(k)
            n = len(ring)
            turns = [(ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) - (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0]) for i in range(n)]
            if len(kept := [x for x, t in zip(ring, turns, strict=True) if t]) >= 3:
                rings.append(kept)
    return rings


def _as_polygons(edges: DataFrame, keys: list[str], places: int) -> DataFrame:
    """(keys, area in square degrees, rings) of directed boundary edges. Rings round what is inside run against the
    clock, holes with it, and the first point is not repeated."""
    unit = 10.0**places
    area = F.sum((F.col("px") - F.col("ox")) * (F.col("qy") - F.col("oy")) - (F.col("qx") - F.col("ox")) * (F.col("py") - F.col("oy"))) / 2 / unit**2
    origin = edges.groupBy(*keys).agg(F.min("px").alias("ox"), F.min("py").alias("oy"))
    grouped = edges.join(origin, keys).groupBy(*keys).agg(area.alias("area"), F.collect_list(F.struct("px", "py", "qx", "qy")).alias("edges"))
    made = StructType([*(grouped.schema[k] for k in keys), *StructType.fromDDL(f"area double, {RINGS}").fields])
    arrow = to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            rings = [[[{"lon": x / unit, "lat": y / unit} for x, y in ring] for ring in link_rings(e)] for e in batch.column(len(keys) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rings, arrow.field("rings").type)], schema=arrow)

    return grouped.mapInArrow(run, made)


def make_valid(polygons: DataFrame, keys: list[str], places: int = PLACES) -> DataFrame:
    """(keys, area, rings) of what `polygons` (keys, rings) hold by even-odd, as rings that neither cross themselves nor
    each other. Polygons of one key are one; what has no area, or null rings, has no row. Repeated rings cancel in pairs."""
    scratch = Scratch(polygons.sparkSession, "valid")
    parts = noded(segments(polygons, keys, "a", places), keys, scratch, "parts")
    return _as_polygons(boundary(parts, keys, lambda a, b: a), keys, places)


def _boxed(parts: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return parts.groupBy(*keys).agg(F.min("x1").alias(f"{prefix}w"), F.max("x2").alias(f"{prefix}e"), F.min(low).alias(f"{prefix}s"), F.max(high).alias(f"{prefix}n"))


def clip(layers: DataFrame, districts: DataFrame, layer_keys: list[str], district_keys: list[str], cell: float = 0.05, places: int = PLACES) -> DataFrame:
    """(layer_keys, district_keys, area, rings): what each polygon of `layers` and each of `districts` (keys, rings; the
    key names differ) have in common. Pairs that share no area have no row.

    Boxes meet by the cells they touch, each pair in one of them. A pair gets only those segments of the one that can lie
    above or beside the box of the other, as the parity above a middle needs no more; so a long border is not copied for
    every small polygon in it.
    """
    scratch = Scratch(layers.sparkSession, "clip")
    unit = 10.0**places
    own = {"a": (layers, layer_keys), "b": (districts, district_keys)}
    edges = {s: scratch.save(segments(p, k, s, places), f"edges-{s}") for s, (p, k) in own.items()}
    boxes = {s: _boxed(edges[s], k, s) for s, (_, k) in own.items()}
    for s in own:
        boxes[s] = boxes[s].withColumn("__c", F.explode(_boxes(*(F.col(s + d) / unit for d in "wsen"), cell)))
    c = F.col
    overlap = (c("aw") < c("be")) & (c("bw") < c("ae")) & (c("as") < c("bn")) & (c("bs") < c("an"))
    corner = F.struct(F.floor(F.greatest("as", "bs") / unit / cell).alias("i"), F.floor(F.greatest("aw", "bw") / unit / cell).alias("j"))
    pairs = scratch.save(boxes["a"].join(boxes["b"], "__c").where(overlap & (c("__c") == corner)).drop("__c"), "pairs")
    keys = [*layer_keys, *district_keys]
    lean = 2 * LEAN * (F.greatest("an", "bn") - F.least("as", "bs")) + 2

    def near(s: str, other: str) -> DataFrame:
        beside = (c("x2") >= c(f"{other}w") - lean) & (c("x1") <= c(f"{other}e") + lean) & (F.greatest("y1", "y2") >= c(f"{other}s"))
        return edges[s].join(pairs, own[s][1]).where(beside).select(*keys, *SEGMENT, "a", "b")

    parts = noded(near("a", "b").unionByName(near("b", "a")), keys, scratch, "parts")
    return _as_polygons(boundary(parts, keys, lambda a, b: a & b), keys, places)


# ---- simplification


def thinned(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line without the points that lie within `tolerance` of what stays; its ends stay, and of a closed one the point
    farthest from its end."""
    points, keep, todo = np.array(line), {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        if j < i + 2:
            continue
        d, middle = points[j] - points[i], points[i + 1 : j] - points[i]
        length2 = float(d @ d)
        t = np.clip(middle @ d / length2, 0, 1)[:, None] if length2 else np.zeros((len(middle), 1))
        off = np.hypot(*(middle - t * d).T)
        k = int(off.argmax())
        if off[k] > tolerance or not length2:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [line[k] for k in sorted(keep)]


def _thin(arcs: DataFrame, tolerance: float) -> DataFrame:
    made = StructType([arcs.schema["arc"], *StructType.fromDDL("line array<struct<x:double,y:double>>").fields])
    arrow = to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            lines = [thinned([(p["x"], p["y"]) for p in line], tolerance) for line in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"x": x, "y": y} for x, y in line] for line in lines], arrow.field(1).type)], schema=arrow)

    return arcs.select("arc", "line").mapInArrow(run, made)


def _crossed(lines: DataFrame) -> DataFrame:
    """Arcs of which a segment crosses, touches or covers one of its own or another arc other than at a common end."""
    pieces = F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda i: F.struct(F.get("line", i).alias("p"), F.get("line", i + 1).alias("q")))
    flat = lines.where(F.size("line") >= 2).select("arc", F.explode(pieces).alias("e")).select("arc", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    parts = _canonical(flat, ["arc"])
    hit = _meetings(parts, []).select(*SEGMENT)
    twice = parts.groupBy(*SEGMENT).count().where("count > 1").select(*SEGMENT)
    return parts.join(hit.unionByName(twice).distinct(), SEGMENT).select("arc").distinct()


def simplify(polygons: DataFrame, keys: list[str], tolerance: float, places: int = PLACES) -> DataFrame:
    """(keys, rings) of `polygons` (keys, rings, valid as make_valid gives them) with fewer points: each point that goes
    is within `tolerance` degrees of the new line, and no lines cross that did not.

    Rings are cut into arcs at the points where three or more lines meet, and each arc is thinned once, whichever
    polygons it borders; so neighbours that shared their points before still meet. Arcs whose new lines cross others
    get their old points back, round by round, and a ring whose lines would fall together does so as well. An arc is one
    row. Null rings have no row.
    """
    scratch = Scratch(polygons.sparkSession, "simplify")
    unit = 10.0**places
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    whole = lambda r: F.transform(r, lambda p: point(F.round(p["lon"] * unit), F.round(p["lat"] * unit)))
    closed = lambda r: F.when(r[0] == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    ring = polygons.select(*keys, F.posexplode("rings").alias("ring", "r")).select(*keys, "ring", closed(whole(F.col("r"))).alias("r")).where(F.size("r") >= 3)
    rings = scratch.save(ring, "rings")
    steps = F.transform(F.col("r"), lambda p, i: F.struct(p.alias("p"), F.get("r", (i + 1) % F.size("r")).alias("q")))
    steps = rings.select(F.explode(steps).alias("s"))
    ends = steps.select(F.col("s.p").alias("p"), F.col("s.q").alias("q")).union(steps.select(F.col("s.q").alias("p"), F.col("s.p").alias("q")))
    nodes = ends.groupBy("p").agg(F.count_distinct("q").alias("n")).where("n <> 2").select("p", F.lit(True).alias("node"))
    # the places of each ring's nodes, or of its smallest point where it has none
    spots = rings.select(*keys, "ring", F.posexplode("r").alias("i", "p")).join(nodes, "p", "left")
    placed = spots.groupBy(*keys, "ring").agg(F.sort_array(F.collect_list(F.when(F.col("node"), F.col("i")))).alias("at"), F.min_by("i", "p").alias("least"))
    cut = rings.join(placed, [*keys, "ring"]).withColumn("at", F.when(F.size("at") == 0, F.array("least")).otherwise(F.col("at")))
    twice = F.concat("r", "r", F.slice("r", 1, 1))
    spans = F.transform(F.col("at"), lambda a, k: F.slice(F.col("twice"), a + 1, F.when(k + 1 < F.size("at"), F.get("at", k + 1) - a).otherwise(F.size("r") - a + F.get("at", F.lit(0))) + 1))
    arcs = cut.withColumn("twice", twice).select(*keys, "ring", F.posexplode(spans).alias("k", "line"))
    turned = F.reverse("line")
    arcs = arcs.withColumn("back", turned < F.col("line")).withColumn("line", F.when(F.col("back"), turned).otherwise(F.col("line")))
    named = scratch.save(arcs.withColumn("arc", F.struct(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.size("line").alias("n"))), "arcs")
    old = scratch.save(named.groupBy("arc").agg(F.first("line").alias("line")), "old")
    lines = scratch.save(_thin(old, tolerance * unit), "lines-0")
    k = 0
    while True:
        bad = scratch.save(_crossed(lines).withColumn("bad", F.lit(True)), f"bad-{k}")
        left = bad.join(lines.join(old.withColumnRenamed("line", "was"), "arc").where("line <> was"), "arc", "left_semi")
        if left.isEmpty():  # what still meets did so before
            break
        k += 1
        lines = scratch.save(lines.join(bad, "arc", "left").join(old.withColumnRenamed("line", "was"), "arc").select("arc", F.when(F.col("bad"), F.col("was")).otherwise(F.col("line")).alias("line")), f"lines-{k}")
    back = named.select(*keys, "ring", "k", "arc", "back").join(lines, "arc")
    part = F.when(F.col("back"), F.reverse("line")).otherwise(F.col("line"))
    part = F.transform(F.slice(part, F.lit(1), F.size("line") - 1), lambda p: F.struct((p["x"] / unit).alias("lon"), (p["y"] / unit).alias("lat")))
    whole_rings = back.groupBy(*keys, "ring").agg(F.sort_array(F.collect_list(F.struct("k", part.alias("part")))).alias("parts"))
    lined = whole_rings.select(*keys, "ring", F.flatten(F.transform("parts", lambda x: x["part"])).alias("r")).where(F.size("r") >= 3)
    return lined.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ring", "r"))).alias("rs")).select(*keys, F.transform("rs", lambda x: x["r"]).alias("rings"))


def area(rings: Column) -> Column:
    """Area in square degrees of the rings of a valid polygon, holes taken off (they run the other way round)."""
    ring = lambda r: F.aggregate(F.transform(r, lambda p, i: (p["lon"] - r[0]["lon"]) * (F.get(r, (i + 1) % F.size(r))["lat"] - r[0]["lat"]) - (F.get(r, (i + 1) % F.size(r))["lon"] - r[0]["lon"]) * (p["lat"] - r[0]["lat"])), F.lit(0.0), lambda s, x: s + x) / 2
    return F.aggregate(F.transform(rings, ring), F.lit(0.0), lambda s, x: s + x)
