"""The index kept by a stream equals the index of all rows at once, for any order in which files come."""

import itertools
import random

import numpy as np
import pytest

from hearthgauge.functions.geo import METRES_LAT, METRES_LON
from hearthgauge.operators.lookup import ambiguity_index
from hearthgauge.streaming import address_index as X

SCHEMA = "district string, address string, ord long, lat double, lon double"


def at(x, y):
    return 25.0 + x / METRES_LAT, 121.5 + y / METRES_LON


def row(address, order, x, y, district="d"):
    return (district, address, order, *at(x, y))


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, tmp, files, tolerance=100.0):
    """The index after each of `files` has come in a run of its own."""
    for k, rows in enumerate(files):
        write(spark, tmp / "in", f"f{k}", rows)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp}/in/*")
        q = X.follow(X.index_changes(stream, ["district", "address"], "ord", tolerance), f"{tmp}/out", f"{tmp}/checkpoint")
        q.awaitTermination(120)
        assert q.exception() is None
    return result(X.current_index(spark.read.parquet(f"{tmp}/out"), ["district", "address"]))


def result(df):
    return sorted((r.district, r.address, r.lat, r.lon, r.is_ambiguous, r.n) for r in df.collect())


def batch(spark, files, tolerance=100.0):
    return result(ambiguity_index(spark.createDataFrame([r for f in files for r in f], SCHEMA), ["district", "address"], "ord", tolerance))


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_any_order_of_files(spark, tmp_path, order):
    rnd = random.Random(7)
    rows = [row(f"a{rnd.randrange(40)}", k, rnd.uniform(-70, 70), rnd.uniform(-70, 70), rnd.choice("de")) for k in range(300)]
    # two far apart, then a first one between them: ambiguous until it comes
    rows += [row("between", 1001, 0, 0), row("between", 1002, 150, 0), row("between", 1000, 75, 0)]
    rows += [row("settled", 2001, 0, 0), row("settled", 2002, 500, 0), row("settled", 2000, 250, 0)]
    rows += [row("same", 3000 + k, 5, 5) for k in range(50)]
    files = [[r for k, r in enumerate(rows) if k % 3 == f] for f in order]
    got = run(spark, tmp_path, files)
    assert got == batch(spark, files)
    flags = {r[1]: r[4] for r in got}
    assert (flags["between"], flags["settled"], flags["same"]) == (False, True, False)
    assert {True, False} == {r[4] for r in got if r[1].startswith("a")}


def test_a_hot_key_keeps_a_small_state(spark, tmp_path):
    rnd = random.Random(3)
    files = [[row("hot", k * 5000 + i, rnd.gauss(0, 15), rnd.gauss(0, 15)) for i in range(5000)] for k in (1, 0)]
    assert run(spark, tmp_path, files) == batch(spark, files)
    kept = next(X.combined(["address"])(iter([spark.createDataFrame(files[0], SCHEMA).toPandas()])))
    assert len(kept) < 60 and kept["n"].sum() == 5000


def test_odd_rows(spark, tmp_path):
    good = [row("a", 2, 0, 0), row("a", 1, 300, 0)]
    odd = [(None, "a", 1, 25.0, 121.5), ("d", None, 1, 25.0, 121.5), ("d", "a", None, 25.0, 121.5), ("d", "a", 0, None, 121.5), ("d", "a", 0, 25.0, float("nan"))]
    assert run(spark, tmp_path, [odd, good]) == [("d", "a", *at(300, 0), True, 2)]


def test_equal_order_takes_the_smallest_coordinate_and_repeats_count(spark, tmp_path):
    files = [[row("a", 1, 10, 0)], [row("a", 1, -10, 0), row("a", 1, -10, 0)]]
    assert run(spark, tmp_path, files) == [("d", "a", *at(-10, 0), False, 3)]


def test_hull_keeps_what_can_be_farthest():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 200):
        for spots in (rnd.normal(0, 1e-4, (n, 2)), np.round(rnd.normal(0, 2, (n, 2))) * 1e-5, np.outer(np.arange(n), [1e-5, 2e-5])):
            lat, lon = 25 + spots[:, 0], 121 + spots[:, 1]
            kept = X.hull(lat, lon)
            for a, o in 25 + rnd.normal(0, 1e-3, (20, 2)) * [1, 1] + [0, 96]:
                assert X.metres(lat, lon, a, o).max() == X.metres(lat[kept], lon[kept], a, o).max()
