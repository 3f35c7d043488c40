import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hearthgauge.operators import overlay

POLYGON = "id long, rings array<array<struct<lon:double,lat:double>>>, area string, cell int"


def made(spark, shapes, name="id"):
    rows = [(k, rings and [[{"lon": float(x), "lat": float(y)} for x, y in r] for r in rings], "x", 1) for k, rings in shapes.items()]
    return spark.createDataFrame(rows, POLYGON.replace("id ", f"{name} ", 1))


def plain(rings):
    return [[(p["lon"], p["lat"]) for p in r] for r in rings]


def holds(rings, x, y):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def size(rings):
    return sum(x1 * y2 - x2 * y1 for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True)) / 2


def edges(rings):
    return [e for r in rings for e in zip(r, r[1:] + r[:1], strict=True)]


def cross(a, b):
    """Whether two edges have more in common than end points."""
    (p, q), (r, s) = a, b
    side = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
    e = 1e-13
    if {p, q} == {r, s}:
        return True
    d1, d2, d3, d4 = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
    return d1 * d2 < 0 and d3 * d4 < 0 and min(map(abs, (d1, d2, d3, d4))) > e


def valid(rings):
    return not any(cross(a, b) for a, b in combinations(edges(rings), 2))


def scribble(rng, n, west=0.0, south=0.0, wide=1.0):
    return [(west + wide * round(rng.random(), 3), south + wide * round(rng.random(), 3)) for _ in range(n)]


def points(rng, n, low=0.0, high=1.0):
    return [(low + (high - low) * rng.random(), low + (high - low) * rng.random()) for _ in range(n)]


BOX = [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_bow_ties_repeated_and_touching_rings_become_valid(spark):
    shapes = {1: [[(0, 0), (1, 1), (1, 0), (0, 1)]], 2: [BOX, BOX], 3: [BOX, [(1, 0), (2, 0), (2, 1), (1, 1)]], 4: [BOX, [(0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2)]], 5: [BOX + BOX[:1]], 6: None, 7: [[(0, 0), (1, 1)]], 8: [], 9: [[(0, 0), (0.5, 0), (1, 0), (0.5, 0)]], 10: [[(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (1, 0), (1, 1), (0, 1)]]}
    out = {r.id: r for r in overlay.make_valid(made(spark, shapes), ["id"]).collect()}
    assert {k: round(r.area, 9) for k, r in out.items()} == {1: 0.5, 3: 2.0, 4: 1 + 2.25 - 0.5, 5: 1.0, 10: 3.0}
    assert len(out[1].rings) == 2 and len(out[3].rings) == 1 and len(out[3].rings[0]) == 4
    for r in out.values():
        assert valid(plain(r.rings)) and abs(size(plain(r.rings)) - r.area) < 1e-9


@pytest.mark.parametrize("seed", range(2))
def test_valid_polygons_hold_the_same_points(spark, seed):
    rng = random.Random(seed)
    shapes = {k: [scribble(rng, rng.randrange(3, 14)) for _ in range(rng.randrange(1, 4))] for k in range(12)}
    out = {r.id: plain(r.rings) for r in overlay.make_valid(made(spark, shapes), ["id"]).collect()}
    spots = points(rng, 1000)
    for k, rings in shapes.items():
        assert valid(out[k])
        assert sum(holds(rings, *p) != holds(out[k], *p) for p in spots) == 0


def test_pieces_of_layers_are_what_both_hold(spark):
    rng = random.Random(4)
    layers = {k: [scribble(rng, rng.randrange(3, 10), 0.2 * (k % 4), 0.2 * (k % 3), 0.4)] for k in range(12)}
    layers |= {20: [BOX, [(0.3, 0.3), (0.7, 0.3), (0.7, 0.7), (0.3, 0.7)]], 21: [[(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.2)]], 22: [[(5, 5), (6, 5), (6, 6)]], 23: None}
    cuts = [(0, 0), (0.5, 0.1), (1, 0), (1.1, 0.45), (0.55, 0.5), (-0.1, 0.55), (0, 1), (0.45, 0.95), (1, 1)]
    a, b, c, d, e, f, g, h, i = cuts
    districts = {0: [[a, b, e, f]], 1: [[b, c, d, e]], 2: [[f, e, h, g]], 3: [[e, d, i, h]], 9: [[(7, 7), (8, 7), (8, 8)]]}
    out = overlay.clip(made(spark, layers), made(spark, districts, "district").drop("area", "cell"), ["id"], ["district"], cell=0.3).collect()
    got = {(r.id, r.district): plain(r.rings) for r in out}
    assert len(got) == len(out)
    spots = points(rng, 1500, -0.1, 1.1)
    for k, rings in layers.items():
        for n, own in districts.items():
            there = got.get((k, n), [])
            assert valid(there)
            assert not rings or all((holds(rings, *p) and holds(own, *p)) == holds(there, *p) for p in spots)
    whole = {r.id: r.area for r in overlay.clip(made(spark, layers), spark.createDataFrame([(0, [[{"lon": float(x), "lat": float(y)} for x, y in [a, b, c, d, i, h, g, f]]])], "all_of_it long, rings array<array<struct<lon:double,lat:double>>>"), ["id"], ["all_of_it"]).collect()}
    for k, total in whole.items():
        assert abs(total - sum(r.area for r in out if r.id == k)) < 1e-6


def test_an_inner_polygon_and_shared_borders(spark):
    layers = {1: [[(0.2, 0.2), (0.4, 0.2), (0.4, 0.4)]], 2: [BOX], 3: [[(1, 0), (2, 0), (2, 1), (1, 1)]], 4: [[(-1, -1), (3, -1), (3, 3), (-1, 3)]]}
    out = {r.id: round(r.area, 9) for r in overlay.clip(made(spark, layers), made(spark, {1: [BOX]}, "district").drop("area", "cell"), ["id"], ["district"]).collect()}
    assert out == {1: 0.02, 2: 1.0, 4: 1.0}
    empty = made(spark, layers).limit(0)
    assert overlay.clip(empty, made(spark, {1: [BOX]}, "district"), ["id"], ["district"]).count() == 0
    assert overlay.make_valid(empty, ["id"]).count() == 0 and overlay.simplify(empty, ["id"], 0.1).count() == 0


def wiggle(p, q, rng, n, by):
    """Points from p to q (without q), off the line by `by` at most, the same whichever end is first."""
    flip = p > q
    a, b = (q, p) if flip else (p, q)
    draw = random.Random(repr((a, b)))
    line = [a, *((a[0] + (b[0] - a[0]) * k / n + draw.uniform(-by, by), a[1] + (b[1] - a[1]) * k / n + draw.uniform(-by, by)) for k in range(1, n)), b]
    line = [(round(x, 7), round(y, 7)) for x, y in line]
    return (line[::-1] if flip else line)[:-1]


def test_simplified_neighbours_still_meet(spark):
    rng, by = random.Random(1), 0.004
    corners = lambda i, j: [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
    shapes = {3 * i + j: [[p for a, b in edges([corners(i, j)]) for p in wiggle(a, b, rng, 30, by)]] for i in range(3) for j in range(3)}
    out = {r.id: plain(r.rings) for r in overlay.simplify(made(spark, shapes), ["id"], 0.01).collect()}
    assert out.keys() == shapes.keys() and all(4 <= len(r[0]) <= 8 for r in out.values())
    shared = [frozenset(e) for k in out for e in edges(out[k])]
    assert sum(shared.count(e) == 2 for e in set(shared)) == 12 and abs(sum(size(r) for r in out.values()) - 9) < 0.2
    assert not any(cross(a, b) for (_, r), (_, s) in combinations(out.items(), 2) for a in edges(r) for b in edges(s) if set(a) != set(b))
    for k, rings in shapes.items():  # each old point is within the tolerance of a new line
        for x, y in rings[0]:
            assert min(distance((x, y), e) for e in edges(out[k])) <= 0.01 + 1e-7


def distance(p, e):
    (x1, y1), (x2, y2) = e
    dx, dy = x2 - x1, y2 - y1
    t = max(0, min(1, ((p[0] - x1) * dx + (p[1] - y1) * dy) / (dx * dx + dy * dy)))
    return ((p[0] - x1 - t * dx) ** 2 + (p[1] - y1 - t * dy) ** 2) ** 0.5


def test_lines_that_would_cross_keep_their_points(spark):
    bump = [(0, 0), (2, 0), (2, 0.3), (1.02, 0.3), (1, 0.9), (0.98, 0.3), (0, 0.3)]  # its top is in a notch of the other
    notch = [(0, 0.5), (0.9, 0.5), (1, 1), (1.1, 0.5), (2, 0.5), (2, 2), (0, 2)]
    out = {r.id: plain(r.rings) for r in overlay.simplify(made(spark, {1: [bump], 2: [notch]}), ["id"], 0.55).collect()}
    assert not any(cross(a, b) for a in edges(out[1][:1]) for b in edges(out[2]))
    assert all(valid(r) for r in out.values()) and (1, 0.9) in out[1][0] and (1, 1) in out[2][0]
    alone = overlay.simplify(made(spark, {2: [notch]}), ["id"], 0.55).first()
    assert len(alone.rings[0]) == 4


def test_area_of_valid_rings(spark):
    df = overlay.make_valid(made(spark, {1: [BOX, [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]]}), ["id"])
    assert df.select(F.round(overlay.area(F.col("rings")), 9).alias("a"), F.round("area", 9).alias("b")).collect() == [(0.75, 0.75)]
