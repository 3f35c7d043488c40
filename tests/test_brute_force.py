"""Operators that SQL does not express, against plain loops over the same rows."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hearthgauge.functions import geo, names, scalars as S
from hearthgauge.operators import analysis as A, dedupe as D, documents as M, quality as Q, release as E, sampling as W, spatial as G, validity as V
from hearthgauge.plans import queries as P
from hearthgauge.sources import sinks

SF = "/root/testdata/sf0.01"


def points(n, seed, spots=6):
    rng = random.Random(seed)
    return [("ab"[rng.randrange(2)], f"i{rng.randrange(n // 2)}", k, 25 + rng.randrange(spots) / 1000, 121 + rng.randrange(spots) / 1000) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_unique(spark, seed):
    rows = points(80, seed)
    ids, spots, want = set(), set(), {}
    for g, i, k, la, lo in rows:
        if (g, i) in ids:
            want[k] = "duplicateId"
        elif (g, round(la, 7), round(lo, 7)) in spots:
            want[k] = "duplicateCoordinate"
        else:
            want[k] = "accepted"
            ids.add((g, i))
            spots.add((g, round(la, 7), round(lo, 7)))
    df = spark.createDataFrame(rows, "g string, ident string, ord int, lat double, lon double")
    assert {r.ord: r.outcome for r in D.greedy_unique(df, ["g"], "ident", "ord").collect()} == want and set(want.values()) == {"accepted", "duplicateId", "duplicateCoordinate"}


def merged(rows, metres):
    clusters = []
    for g, i, _, la, lo in sorted(rows, key=lambda r: r[2]):
        for c in clusters:
            if c[0] == g and math.hypot((la - c[1]) * geo.METRES_LAT, (lo - c[2]) * geo.METRES_LON) <= metres:
                c[3].append(i)
                break
        else:
            clusters.append([g, la, lo, [i]])
    return sorted((c[0], c[1], c[2], tuple(sorted(set(c[3]))), len(c[3])) for c in clusters)


def test_greedy_merge(spark):
    rows = points(120, 3, 40)
    df = spark.createDataFrame(rows, "g string, ident string, ord int, lat double, lon double")
    got = sorted((r.g, r.lat, r.lon, tuple(r.codes), r.n) for r in D.greedy_merge(df, ["g"], "ord", "ident", 900.0).collect())
    assert got == merged(rows, 900.0) and 4 < len(got) < 100


def test_merge_queries(spark):
    rows = [(r.brand, str(r.ord), r.ord, r.lat, r.lon) for r in P.R.facilities(spark, SF).collect()]
    got = sorted((r.brand, r.n, r.codes) for r in P.rail_merge(spark, SF).collect())
    assert got == sorted((c[0], c[4], ",".join(c[3])) for c in merged(rows, 1500.0))
    schools = [((r.district, r.brand), str(r.ord), r.ord, r.lat, r.lon) for r in P.R.facilities(spark, SF).where("category = 'school'").collect()]
    got = sorted((r.district, r.brand, r.n, r.codes) for r in P.campus_merge(spark, SF).collect())
    assert got == sorted((*c[0], c[4], "+".join(c[3])) for c in merged(schools, 3000.0))


def test_interior_points(spark):
    got = {r.ord: r for r in P.interior_points(spark, SF).collect()}
    shapes = {r.ord: [[(p.lon, p.lat) for p in ring] for ring in r.rings] for r in P.R.polygons(spark, SF).collect()}
    assert len(shapes) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    for o, rings in shapes.items():
        edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        xs, ys = [p[0] for ring in rings for p in ring], [p[1] for ring in rings for p in ring]

        def distance(lon, lat, a, b):
            k = math.cos(math.radians(lat))
            ax, ay, bx, by = (a[0] - lon) * k * 111000, (a[1] - lat) * 111000, (b[0] - lon) * k * 111000, (b[1] - lat) * 111000
            t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))

        best = 0.0
        for i in range(1, 40):
            for j in range(1, 40):
                lon, lat = min(xs) + (max(xs) - min(xs)) * i / 40, min(ys) + (max(ys) - min(ys)) * j / 40
                odd = sum((a[1] > lat) != (b[1] > lat) and lon < (b[0] - a[0]) * (lat - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2
                d = min(distance(lon, lat, a, b) for a, b in edges)
                if odd and d >= 20:
                    best = max(best, d)
        assert abs(got[o].edge_distance - best) < 0.01
        assert abs(min(distance(got[o].lon, got[o].lat, a, b) for a, b in edges) - best) < 1


def test_projection_has_the_scale_of_its_meridian(spark):
    # on the central meridian a metre of northing is a metre of meridian arc over k0, by Simpson's rule
    rows = spark.range(1).select(*geo.twd97_to_wgs84(F.lit(250000.0), F.lit(2770000.0)), *geo.twd97_to_wgs84(F.lit(300000.0), F.lit(2770000.0))).first()
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    end, n = math.radians(rows[1]), 2000
    arc = sum((1 if k in (0, n) else 4 if k % 2 else 2) * a * (1 - e2) / (1 - e2 * math.sin(end * k / n) ** 2) ** 1.5 for k in range(n + 1)) * end / n / 3
    assert rows[0] == 121.0 and abs(arc * 0.9999 - 2770000.0) < 0.02
    width = 50000 / (0.9999 * a / math.sqrt(1 - e2 * math.sin(math.radians(rows[3])) ** 2) * math.cos(math.radians(rows[3])))
    assert abs(math.degrees(width) - (rows[2] - 121.0)) < 2e-5
    assert P.projected_points(spark, SF).where("inside").count() == spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_normal_addresses(spark):
    got = {r.p_partkey: r.address for r in P.normalize_text_nfkc(spark, SF).collect()}
    sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert got == {k: f"信義路{n}號之3" for k, n in sizes.items()}


def test_address_forms():
    assert names.address_forms("板橋區和平里中山路２段十二號", "板橋區") == ["板橋區和平里中山路２段十二號", "板橋區中山路2段十二號", "板橋區中山路2段12號", "板橋區中山路二段12號"]
    assert [names.in_digits(x) for x in ("十", "二十", "十五", "三十二", "一〇三", "兩")] == ["10", "20", "15", "32", "103", "2"]
    assert names.address_forms("中山路3、5號", "")[-1] == "中山路3號" and names.address_forms(None, "x") == [""]


@pytest.mark.parametrize("seed", [4, 5])
def test_prioritised(spark, seed):
    rng = random.Random(seed)
    rows = [("gh"[rng.randrange(2)], k, rng.randrange(4), rng.randrange(3) or None) for k in range(60)]
    quotas = [("a = 1", 2), ("a = 1 OR b = 2", 2), ("b = 1", 1), ("a = 9", 3)]
    tests = [lambda r: r[2] == 1, lambda r: r[2] == 1 or r[3] == 2, lambda r: r[3] == 1, lambda r: False]
    want = set()
    for g in "gh":
        left, taken = [r for r in rows if r[0] == g], []
        for k, (test, (_, n)) in enumerate(zip(tests, quotas, strict=True)):
            hit = [r for r in left if test(r)][:n]
            taken += [(k, r) for r in hit]
            left = [r for r in left if r not in hit]
        taken += [(4, r) for r in left]
        want |= {(*r, k) for k, r in sorted(taken, key=lambda x: (x[0], x[1][1]))[:8]}
    got = W.prioritised(spark.createDataFrame(rows, "g string, id int, a int, b int"), ["g"], quotas, "id", 8)
    assert {tuple(r) for r in got.collect()} == want
    assert W.prioritised(got.where("false").drop("slot"), ["g"], quotas, "id", 8).count() == 0


def test_full_analysis_parts(spark):
    # the document's parts are those of the queries that have SQL
    small = "/root/testdata/sf0.001"
    whole = {r.property_id: r for r in P.full_analysis(spark, small).collect()}
    price = {r.property_id: r for r in P.price_analysis(spark, small).collect()}
    counts = {r.property_id: r for r in P.accident_summary(spark, small).collect()}
    years = {r.property_id: r.n_years for r in P.price_trend_chart(spark, small).collect()}
    assert set(whole) == set(price) == set(counts)
    for k, r in whole.items():
        accidents = json.loads(r.accidents)
        assert r.sample_count == price[k].sample_count and (r.n_years or 0) == years.get(k, 0)
        assert (accidents["total"], accidents["a1"], accidents["a2"]) == (counts[k].total, counts[k].a1, counts[k].a2)
        assert r.n_checks >= 3 and 0 <= r.completeness <= 100


def test_catalogue_and_promotion(spark):
    rows = [("rail", "official", True, True, None), ("metro", "official", True, True, None), ("park", "official", True, False, None), ("market", "official", True, True, "match rate 0.8"), ("bus", "official", True, True, "HTTP 500")]
    catalog = spark.createDataFrame(rows, "id string, status string, automated_passed boolean, manual_passed boolean, error string")
    assert {r.id: r.next_status for r in Q.promotable(catalog, ["metro"]).collect()} == {"rail": "official", "metro": "official", "park": "unavailable", "market": "unavailable", "bus": "failed"}
    assert {r.id: r.next_status for r in Q.promotable(catalog, ["metro", "flood"]).collect()}["rail"] == "unavailable"
    a, b = (spark.createDataFrame(x, "id int, v int, w string") for x in ([(1, 1, None), (2, 2, "x")], [(1, 1, None), (2, 3, "x"), (3, 0, "")]))
    assert sorted((r.id, r.v_equal, r.w_equal, r.all_equal) for r in Q.fields_equal(a, b, ["id"], ["v", "w"]).collect()) == [(1, True, True, True), (2, False, True, False)]
    states = spark.createDataFrame([("a", "official", ["x"]), ("b", "official", []), ("c", "stale", ["y", "x"]), ("d", "official", ["y"])], "id string, status string, districts array<string>")
    assert {r.id: r.runtime_status for r in M.runtime_status(states, "x").collect()} == {"a": "official", "b": "official", "c": "stale", "d": "unavailable"}
    about = spark.createDataFrame([("market",), ("park",), ("rail",)], "id string")
    state = spark.createDataFrame([("market", "unavailable"), ("park", "official"), ("rail", "unavailable")], "id string, status string")
    ready = spark.createDataFrame([("market", "low"), ("park", "x"), ("rail", "y")], "id string, reason string")
    assert {r.id: (r.has_readiness, r.reason) for r in M.describe_sources(about, state, ready).collect()} == {"market": (True, "low"), "park": (False, None), "rail": (False, None)}
    saved = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    assert [r.k for r in M.save_item(saved, saved.limit(1).withColumn("k", F.lit(0)), "k", "k").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        M.save_item(saved.union(saved), saved, "k", "k")


def test_texts_and_shapes(spark):
    one = spark.range(1)
    items = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(c).alias("checked")) for t, c in (("x", True), ("y", False))))
    assert one.select(A.checklist_text(F.lit("T"), items, "end")).first()[0] == "T\n☑ x\n☐ y\nend"
    assert one.select(names.address_list(F.lit("甲路1號(後棟)\n乙路2號；甲路1號"), F.lit("乙區"))).first()[0] == ["甲路1號", "乙路2號"]
    assert one.select(names.first_filled(F.lit("  "), F.lit(None).cast("string"), F.lit(" z "))).first()[0] == "z"
    text = spark.createDataFrame([(121.5, 25.0, "n", "02")], "lon double, lat double, name string, phone string").select(sinks.to_geojson(["name"])).first()[0]
    assert "phone" not in text and '"coordinates":[121.5,25.0]' in text
    ring = F.array(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((121.0, 25.0), (121.1, 25.0), (121.1, 25.1)))))
    assert one.select(geo.coordinates_valid(ring, 120.0, 24.0, 122.0, 26.0), geo.coordinates_valid(ring, 121.05, 24.0, 122.0, 26.0)).first()[:] == (True, False)
    got = one.select(S.presented_count(F.lit(0), F.lit("failed"), F.lit(False)), S.presented_count(F.lit(0), F.lit("stale"), F.lit(False))).first()
    assert got[:] == ("資料不足", "0")


def test_validity_of_odd_records(spark):
    with pytest.raises(Q.GateError):
        V.latest_school_year(spark.createDataFrame([("115",), ("114",)], "`學年度` string"))
    assert V.latest_school_year(spark.createDataFrame([("114",), ("113",), (None,), ("",)], "`學年度` string")).count() == 3
    nothing = spark.createDataFrame([], "id string, lat double, lon double, address string, reason string, stoplocationid string, showlon string, longitude string, showlat string, latitude string, ord int")
    assert V.duplicate_stop_ratio(V.bus(nothing.drop("id", "lat", "lon", "reason"), ["x"], "ord")).first()[:] == (0, 0, 0, 0.0, True)
    assert not E.rail_gate(nothing, 0).first().passed
    stops = [("a", "x", "121.5", "25.0", 3), ("a", "q", "121.5", "25.0", 1), ("a", "x", "121.5", "25.0", 2), (None, "x", "1", "1", 0), ("b", None, None, None, 5)]
    rows = spark.createDataFrame(stops, "stoplocationid string, address string, showlon string, showlat string, ord int").withColumns({"longitude": F.lit(""), "latitude": F.lit("")})
    assert {r.ord: r.reason for r in V.bus(rows, ["x"], "ord").collect()} == {0: "blankId", 1: "invalidOrUnassigned", 2: None, 3: "duplicate", 5: "invalidOrUnassigned"}
    forms = spark.createDataFrame([("a", True, "1", "1", "0", "3", "2", False, "", "")], "address string, location_confirmed boolean, total_price string, area_ping string, age string, floor string, total_floors string, has_parking boolean, parking_price string, parking_area_ping string")
    assert V.property_form(forms).count() == 0 and V.property_form(forms.withColumn("floor", F.lit("2"))).count() == 1
