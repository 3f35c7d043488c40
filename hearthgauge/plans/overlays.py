"""Registered queries over polygons that are made of table rows.

Corners lie on a lattice of 10^-4 degrees, so areas are whole numbers of its squares and SQL has them from widths and heights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import overlay as O
from . import roles as R
from .queries import query



def _ring(*points: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('lon', 121.45D + ({x}) * 1e-4D, 'lat', 24.95D + ({y}) * 1e-4D)" for x, y in points) + ")"


def _box(w: str, s: str, e: str, n: str) -> str:
    return _ring((w, s), (e, s), (e, n), (w, n))


def squares(area: Column) -> Column:
    """Square degrees as squares of the lattice."""
    return F.round(area * 1e8).cast("long")


_BOX = {"w": "s_suppkey * 7919 % 900", "s": "s_suppkey * 104729 % 900", "e": "s_suppkey * 7919 % 900 + 30 + s_suppkey * 37 % 170", "n": "s_suppkey * 104729 % 900 + 30 + s_suppkey * 53 % 170"}
_BOXES = "SELECT s_suppkey AS layer, " + ", ".join(f"{e} AS {k}" for k, e in _BOX.items()) + " FROM supplier"
_NATIONS = "SELECT n_nationkey AS district, n_nationkey % 5 * 200 AS dw, n_nationkey // 5 * 200 AS ds FROM nation"


def supplier_shapes(spark: SparkSession, d: str, kinds: str) -> DataFrame:
    """(layer, rings); `kinds` gives the rings from w, s, e and n."""
    boxes = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("layer"), *(F.expr(f"CAST({e} AS BIGINT)").alias(k) for k, e in _BOX.items()))
    return boxes.select("layer", F.expr(kinds).alias("rings"))


def nation_shapes(spark: SparkSession, d: str) -> DataFrame:
    boxes = R.table(spark, d, "nation").selectExpr("n_nationkey AS district", "CAST(n_nationkey % 5 * 200 AS BIGINT) AS w", "CAST(n_nationkey DIV 5 * 200 AS BIGINT) AS s")
    return boxes.select("district", F.expr(f"array({_box('w', 's', 'w + 200', 's + 200')})").alias("rings"))


_CORNER = _ring(("w", "s"), ("e", "s"), ("e", "s + 10"), ("w + 10", "s + 10"), ("w + 10", "n"), ("w", "n"))
_OVERLAP = "greatest(0, least({0}, dw + 200) - greatest({1}, dw)) * greatest(0, least({2}, ds + 200) - greatest({3}, ds))"


@query(f"""WITH a AS ({_BOXES}), d AS ({_NATIONS}),
p AS (SELECT layer, district, {_OVERLAP.format('e', 'w', 'n', 's')} - CASE layer % 3 WHEN 0 THEN 0 WHEN 1 THEN {_OVERLAP.format('e - 10', 'w + 10', 'n - 10', 's + 10')} ELSE {_OVERLAP.format('e', 'w + 10', 'n', 's + 10')} END AS squares FROM a, d)
SELECT layer, district, squares::BIGINT AS squares, squares::BIGINT AS ring_squares FROM p WHERE squares > 0""")
def layer_clip(spark: SparkSession, d: str) -> DataFrame:
    """Hazard areas (boxes, boxes with a hole, corners) cut at the borders of districts."""
    layers = supplier_shapes(spark, d, f"CASE layer % 3 WHEN 0 THEN array({_box('w', 's', 'e', 'n')}) WHEN 1 THEN array({_box('w', 's', 'e', 'n')}, {_box('w + 10', 's + 10', 'e - 10', 'n - 10')}) ELSE array({_CORNER}) END")
    out = O.clip(layers, nation_shapes(spark, d), ["layer"], ["district"])
    return out.select("layer", "district", squares(F.col("area")).alias("squares"), squares(O.area(F.col("rings"))).alias("ring_squares"))


@query(f"""WITH a AS (SELECT *, (e - w) AS x, (n - s) AS y, layer % 4 AS kind FROM ({_BOXES}))
SELECT layer, CASE kind WHEN 0 THEN x * y WHEN 1 THEN 2 * x * y ELSE 4 * x * y - 4 * (x - 10) * (y - 10) END::BIGINT AS half_squares, CASE kind WHEN 1 THEN 1 ELSE 2 END::BIGINT AS n_rings FROM a WHERE kind <> 2""")
def valid_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Bow-ties, rings given three times and twice, and boxes that overlap, as valid rings."""
    bow = _ring(("w", "s"), ("e", "n"), ("e", "s"), ("w", "n"))
    box, moved = _box("w", "s", "e", "n"), _box("w + 10", "s + 10", "e + 10", "n + 10")
    out = O.make_valid(supplier_shapes(spark, d, f"CASE layer % 4 WHEN 0 THEN array({bow}) WHEN 1 THEN array({box}, {box}, {box}) WHEN 2 THEN array({box}, {box}) ELSE array({box}, {moved}) END"), ["layer"])
    return out.select("layer", squares(2 * O.area(F.col("rings"))).alias("half_squares"), F.size("rings").cast("long").alias("n_rings"))


#: How far the middle of a border between lattice corners is moved up, or to the right; more than 3 stays.
_UP, _RIGHT = "({i} * 3 + ({j}) * 5) % 7", "CASE WHEN {i} = 10 THEN 0 ELSE (({i}) * 5 + {j} * 3) % 7 END"
_SIDES = {"bottom": _UP.format(i="i", j="j"), "top": _UP.format(i="i", j="j + 1"), "left_side": _RIGHT.format(i="i", j="j"), "right_side": _RIGHT.format(i="(i + 1)", j="j")}


@query(f"""WITH c AS (SELECT s_suppkey, s_suppkey % 10 AS i, s_suppkey // 10 AS j FROM supplier),
m AS (SELECT s_suppkey, {', '.join(f'{e} AS {k}' for k, e in _SIDES.items())} FROM c),
k AS (SELECT s_suppkey, {', '.join(f'CASE WHEN {k} > 3 THEN {k} ELSE 0 END AS {k}' for k in _SIDES)} FROM m)
SELECT s_suppkey, (4 + {' + '.join(f'({k} > 0)::INT' for k in _SIDES)})::BIGINT AS n_points, (40000 - 100 * bottom + 100 * top - 100 * left_side + 100 * right_side)::BIGINT AS squares FROM k""")
def simplified_districts(spark: SparkSession, d: str) -> DataFrame:
    """A grid of districts whose shared borders are bent in the middle, thinned so that neighbours still meet."""
    cells = R.table(spark, d, "supplier").selectExpr("s_suppkey", "CAST(s_suppkey % 10 AS BIGINT) AS i", "CAST(s_suppkey DIV 10 AS BIGINT) AS j")
    sided = cells.select("*", *(F.expr(e).alias(k) for k, e in _SIDES.items()))
    x, y = "i * 200", "j * 200"
    ring = _ring((x, y), (f"{x} + 100", f"{y} + bottom"), (f"{x} + 200", y), (f"{x} + 200 + right_side", f"{y} + 100"), (f"{x} + 200", f"{y} + 200"), (f"{x} + 100", f"{y} + 200 + top"), (x, f"{y} + 200"), (f"{x} + left_side", f"{y} + 100"))
    out = O.simplify(sided.select("s_suppkey", F.expr(f"array({ring})").alias("rings")), ["s_suppkey"], 3.5e-4)
    return out.select("s_suppkey", F.size(F.col("rings")[0]).cast("long").alias("n_points"), squares(O.area(F.col("rings"))).alias("squares"))
