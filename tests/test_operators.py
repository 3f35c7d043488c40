import random
import time

import pytest
from pyspark.sql import functions as F

from hearthgauge.operators import analysis as A, dedupe as D, documents as M, lookup as J, quality as Q, sampling as W, spatial as G

SQUARE = [[{"lon": 121.0, "lat": 25.0}, {"lon": 121.1, "lat": 25.0}, {"lon": 121.1, "lat": 25.1}, {"lon": 121.0, "lat": 25.1}]]
HOLE = [{"lon": 121.04, "lat": 25.04}, {"lon": 121.06, "lat": 25.04}, {"lon": 121.06, "lat": 25.06}, {"lon": 121.04, "lat": 25.06}]


def shapes(spark):
    rows = spark.createDataFrame([(1, "a", [*SQUARE, HOLE]), (2, "b", SQUARE)], "ord int, level string, rings array<array<struct<lon:double,lat:double>>>")
    return G.with_bounds(G.edge_table(rows, ["ord", "level"]), ["ord", "level"])


def test_points_in_polygons(spark):
    p = spark.createDataFrame([(1, 25.05, 121.05), (2, 25.02, 121.02), (3, 25.0, 121.05), (4, 26.0, 121.0), (5, None, 121.0)], "id int, lat double, lon double")
    found = G.points_in_polygons(p, shapes(spark))
    assert sorted((r.id, r.ord) for r in found.collect()) == [(1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    first = {r.id: r.level for r in G.first_match(p, found, ["id"], "ord", ["level"]).collect()}
    assert first == {1: "b", 2: "a", 3: "a", 4: None, 5: None}


def test_radius_join_equals_all_pairs(spark):
    rng = random.Random(3)
    pts = [(k, 25 + rng.random() / 50, 121.5 + rng.random() / 50) for k in range(80)]
    a = spark.createDataFrame(pts[:40], "id int, lat double, lon double")
    b = spark.createDataFrame(pts[40:], "other int, lat double, lon double")
    got = {(r.id, r.other) for r in G.radius_join(a, b, 700).collect()}
    every = a.join(b.withColumnsRenamed({"lat": "la", "lon": "lo"})).where(A.haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")) <= 700)
    assert got == {(r.id, r.other) for r in every.collect()} and got


def test_boundary_tolerance(spark):
    poly = shapes(spark).where("ord = 2").withColumn("district", F.lit("d"))
    p = spark.createDataFrame([(1, "d", 25.05, 121.1001), (2, "d", 25.05, 121.1004), (3, "d", 25.05, 121.05)], "id int, district string, lat double, lon double")
    got = {r.id: r.matches for r in G.in_own_polygon(p, poly, ["district"], 20.0).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_ambiguity_and_lookup(spark):
    rows = spark.createDataFrame([("a", 1, 25.0, 121.0), ("a", 2, 25.0001, 121.0), ("b", 1, 25.0, 121.0), ("b", 2, 25.01, 121.0), ("b", 3, 25.0, 121.0)], "k string, ord int, lat double, lon double")
    index = J.ambiguity_index(rows, ["k"], "ord", 100.0)
    assert {r.k: r.is_ambiguous for r in index.collect()} == {"a": False, "b": True}
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    assert {r.id: r.match_status for r in J.lookup(q, index, ["k"]).collect()} == {1: "matched", 2: "ambiguous", 3: "unmatched", 4: "unmatched"}


def test_variants_need_one_place(spark):
    index = spark.createDataFrame([("x", 25.0, 121.0, False), ("y", 25.0, 121.0, False), ("z", 25.1, 121.0, False), ("w", 25.0, 121.0, True)], "k string, lat double, lon double, is_ambiguous boolean")
    rows = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "z"]), (3, ["x", "w"]), (4, ["q"])], "id int, v array<string>")
    got = {r.id: r.match_status for r in J.lookup_variants(rows, index, ["id"], [], "v", "k").collect()}
    assert got == {1: "matched", 2: "ambiguous", 3: "ambiguous", 4: "unmatched"}


def test_greedy_feedback_and_order(spark):
    rows = [(1, "a", 25.0), (2, "b", 25.0), (3, "b", 25.1), (4, "a", 25.2)]
    expected = {1: "accepted", 2: "duplicateCoordinate", 3: "accepted", 4: "duplicateId"}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([("g", o, i, la, 121.0) for o, i, la in rows], "g string, ord int, ident string, lat double, lon double")
        assert {r.ord: r.outcome for r in D.greedy_unique(df, ["g"], "ident", "ord").collect()} == expected


def test_rail_merge(spark):
    rows = [("s", "1001", 25.0005, 121.0), ("s", "1000", 25.0, 121.0), ("t", "1002", 25.0, 121.0)]
    df = spark.createDataFrame(rows, "name string, code string, lat double, lon double")
    assert sorted(r.codes for r in D.greedy_merge(df, ["name"], "code", "code", 150.0).collect()) == [["1000", "1001"], ["1002"]]


def test_last_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, ord int, v string")
    assert {r.id: r.v for r in D.last_wins(df, ["id"], ["v"], ["ord"]).collect()} == {1: "b", 2: "c"}
    assert sum(r.is_duplicate for r in D.first_wins(df, ["id"], ["ord"]).collect()) == 1


def test_cascade_funnel_rates(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", None)], "g string, v int")
    reason = Q.cascade([("one", F.col("v") == 1), ("small", F.col("v") < 3)])
    rows = df.withColumn("reason", reason)
    f = {r.g: (r.seen, r.eligible, r.matched, r.excluded_one, r.excluded_small) for r in Q.funnel(rows, ["g"], "reason", ["one"], ["small"]).collect()}
    assert f == {"x": (2, 1, 0, 1, 1), "y": (2, 2, 2, 0, 0)}
    rate = {r.g: r.rate for r in Q.rates(rows, "g", F.col("reason").isNull(), F.lit(True)).collect()}
    assert rate == {"x": 0.0, "y": 1.0, None: 0.5}
    assert Q.reconciled(rows, "reason").first().reconciled
    with pytest.raises(Q.GateError):
        Q.require(rows, "must be empty")
    Q.require(rows.where("false"), "must be empty")


def test_stratified_sample_ignores_input_order(spark):
    rows = [(k, "abc"[k % 3]) for k in range(60)]
    out = []
    for _ in range(2):
        random.shuffle(rows)
        got = W.stratified(spark.createDataFrame(rows, "id int, kind string"), "kind", "id", 3, 10, 20)
        out.append(sorted((r.id, r.role) for r in got.collect()))
    assert out[0] == out[1] and sum(r == "primary" for _, r in out[0]) == 10 and len(out[0]) == 30


def test_migration(spark):
    saved = spark.createDataFrame([(1, None), (2, 2), (3, 3), (7, 7), (8, 8), (9, 9)], "id int, version int")
    got = {r.id: [r[f"legacy_{k}"] for k in M.LEGACY_BEFORE] for r in M.migrate(saved).collect()}
    assert got[1] == got[2] == [True] * 6 and got[3] == [False] + [True] * 5 and got[7] == [False] * 5 + [True] and got[8] == [False] * 6 and 9 not in got
    text = spark.createDataFrame([('[{"id":"a"}]',), ('{"schemaVersion":3,"properties":[{"id":"b"}]}',), ('{"schemaVersion":99,"properties":[]}',), ("x",)], "t string")
    assert [r[0] and [x.id for x in r[0]] for r in text.select(M.parse_saved(F.col("t"), "struct<id:string>")).collect()] == [["a"], ["b"], None, None]


def test_checklist_and_completeness(spark):
    items = A.checklist(F.lit("priority"), F.lit("low"), F.lit(True), F.lit(None).cast("double"), F.lit(0))
    row = spark.range(1).select(items.alias("i"), A.priority_actions(items).alias("p"), A.completeness(F.lit(True), *[F.lit(False)] * 5).alias("c")).first()
    assert [x.id for x in row.i] == ["flood", "repair", "fund", "license", "price"] and len(row.p) == 3 and row.c == 17


def test_merge_and_upsert(spark):
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "id int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "id int, v string")
    assert sorted(map(tuple, M.merge_readiness(old, new).collect())) == [(1, "o"), (2, "n"), (3, "n")]
    assert sorted(map(tuple, J.upsert(old, new, ["id"], False).collect())) == [(1, "o"), (2, "o"), (3, "n")]


def test_interior_point_keeps_off_excluded_polygons(spark):
    zone = shapes(spark).where("ord = 2").withColumn("part", F.lit("p"))
    box = lambda w, e: [[{"lon": w, "lat": 25.0}, {"lon": e, "lat": 25.0}, {"lon": e, "lat": 25.1}, {"lon": w, "lat": 25.1}]]
    held = spark.createDataFrame([("p", 1, box(121.0, 121.05)), ("p", 2, box(121.04, 121.06)), ("other", 3, box(121.06, 121.1))], "part string, ord int, rings array<array<struct<lon:double,lat:double>>>")
    excluded = G.with_bounds(G.edge_table(held, ["part", "ord"]), ["part", "ord"]).withColumn("lat", F.lit(0.0))
    free, kept = G.interior_point(zone, ["ord"]).first(), G.interior_point(zone, ["ord"], excluded=excluded, on=["part"]).first()
    assert (round(free.lon, 6), round(free.lat, 6)) == (121.05, 25.05) or abs(free.edge_distance - 0.05 * 111000 * 0.9058) < 30
    assert abs(kept.lon - 121.08) < 0.0026 and kept.edge_distance < free.edge_distance
    whole = excluded.withColumn("part", F.lit("p"))
    assert G.interior_point(zone, ["ord"], excluded=whole, on=["part"]).isEmpty()
    none = G.interior_point(zone, ["ord"], excluded=excluded.where("false"), on=["part"]).first()
    assert none == free


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(11)
    spots = lambda n, lat, wide: [(lat + rng.gauss(0, wide), 121.5 + rng.gauss(0, wide * 2)) for _ in range(n)]
    left = [(k, g, *p) for g, (lat, wide) in enumerate([(25.0, 0.02), (60.0, 0.05), (25.0, 3.0), (-70.0, 0.3), (40.0, 8.0)]) for k, p in enumerate(spots(40, lat, wide), 100 * g)]
    right = [(k, g, f"c{k % 3}", *p) for g, (lat, wide) in enumerate([(25.0, 0.02), (60.0, 0.05), (25.5, 3.0), (-70.0, 0.3), (30.0, 8.0)]) for k, p in enumerate(spots(30, lat, wide), 1000 * g)]
    # a far row alone of its kind, a tie at one coordinate, rows without a coordinate
    right += [(7, 0, "far", -10.0, 20.0), (9001, 1, "tie", 60.0, 121.5), (9000, 1, "tie", 60.0, 121.5), (1, 0, "c0", None, 121.0), (2, 9, "c0", 25.0, 121.0)]
    left += [(999, 0, None, 121.0), (998, 8, 25.0, 121.0)]
    a = spark.createDataFrame(left, "id int, g int, lat double, lon double")
    b = spark.createDataFrame(right, "o int, g int, kind string, lat double, lon double")
    got = {(r.id, r.kind): (r.o, round(r.distance, 3)) for r in G.nearest(a, b.withColumn("name", F.col("o")), ["g"], ["id"], "kind", "o", ["name"]).withColumnRenamed("name", "o").collect()}
    every = a.join(b.withColumnsRenamed({"lat": "la", "lon": "lo"}), "g").withColumn("m", A.haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))).where("m IS NOT NULL")
    want = {(r.id, r.kind): (r.x.o, round(r.x.m, 3)) for r in every.groupBy("id", "kind").agg(F.min(F.struct("m", "o")).alias("x")).collect()}
    assert got == want and len(want) == 5 * 40 * 3 + 40 + 40


def test_lookup_by_several_addresses(spark):
    index = spark.createDataFrame([("大安區", "和平路1號", 25.0, 121.0, False), ("大安區", "和平路2號", 25.0, 121.0, False), ("大安區", "和平路3號", 25.1, 121.0, False), ("大安區", "和平路4號", 25.2, 121.0, True)], "district string, address string, lat double, lon double, is_ambiguous boolean")
    cases = [("和平路１號", None, "matched"), ("和平路1號", "大安區龍泉里和平路2號", "matched"), ("和平路1號", "和平路3號", "ambiguous"), ("和平路4號", "和平路1號", "ambiguous"), ("和平路9號", "", "unmatched"), (None, None, "unmatched"), ("和平路9號", "臺北市大安區和平路三號", "matched")]
    rows = spark.createDataFrame([(k, "大安區", a, b) for k, (a, b, _) in enumerate(cases)] + [(99, None, "和平路1號", None)], "id int, district string, raw string, simple string")
    got = {r.id: (r.match_status, r.matched_lat) for r in J.lookup_addresses(rows, index, ["id"], ["raw", "simple"], F.lit("臺北市"), "district").collect()}
    assert {k: s for k, (s, _) in got.items()} == {**{k: s for k, (*_, s) in enumerate(cases)}, 99: "unmatched"}
    assert got[0][1] == 25.0 and got[6][1] == 25.1 and got[2][1] is None


def test_nearest_broadcasts_no_side_dealt_to_cells(spark):
    left = spark.range(4000).select("id", F.lit("g").alias("g"), (25 + F.col("id") % 4 / 1000).alias("lat"), F.lit(121.5).alias("lon"))
    right = spark.range(3000).select(F.col("id").alias("o"), F.lit("g").alias("g"), F.lit("c").alias("kind"), (25 + F.col("id") % 3 / 1000).alias("lat"), F.lit(121.5).alias("lon"))
    out = G.nearest(left, right.withColumn("name", F.col("o")), ["g"], ["id"], "kind", "o", ["name"])
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "BroadcastHashJoin" in x and "__k#" in x] and [x for x in plan if "SortMergeJoin" in x and "__k#" in x]
    got = out.collect()
    assert len(got) == 4000 and {(r.id % 4, r.name, round(r.distance)) for r in got} == {(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 2, 111)}


@pytest.fixture
def crowded(spark):
    """2,000 properties and 2,000 rows of two places in a district, 111 m apart."""
    one = lambda key: spark.range(2000).select(F.col("id").alias(key), F.lit(1).alias("district"), (25 + F.col("id") % 2 / 1000).alias("lat"), F.lit(121.5).alias("lon"))
    lost = spark.createDataFrame([(2000, 1, None, 121.5), (2001, 2, 25.0, 121.5)], "property_id long, district int, lat double, lon double")
    return one("property_id").unionByName(lost), one("ord").drop("ord").withColumn("k", F.monotonically_increasing_id())


def met(df) -> int:
    """Rows that the joins of an executed frame gave, but for the one that gives its rows back."""
    df.collect()
    plan, seen = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plan.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            plan.append(p.plan())
            continue
        if "Join" in p.nodeName():
            seen.append(p.metrics().apply("numOutputRows").value())
        plan += [p.children().apply(k) for k in range(p.children().size())]
    return max(seen)


def test_radius_counts_by_place(spark, crowded):
    properties, rows = crowded
    out = A.radius_counts(properties, rows.withColumn("category", F.when(F.col("k") % 2 == 0, "bus").otherwise("park")), 500)
    assert met(out) <= 2002
    assert {(r.n_bus + r.n_park, r.n_park == r.facility_count) for r in out.where("property_id < 2000").collect()} == {(2000, True)}
    assert {(r.n_bus, r.facility_count) for r in out.where("property_id >= 2000").collect()} == {(0, 0)}


def test_school_levels_by_place(spark, crowded):
    properties, rows = crowded
    out = A.school_levels(properties, rows.withColumn("levels", F.when(F.col("k") % 2 == 0, F.array(F.lit("junior"), F.lit("senior"))).otherwise(F.array(F.lit("junior")))), 500)
    assert met(out) <= 2002
    assert {(r.junior > r.senior > 0, r.junior, r.special) for r in out.where("property_id < 2000").collect()} == {(True, 2000, 0)}


@pytest.fixture
def crowded_tables(spark, tmp_path):
    """Tables of sf0.001 with its customers ten times and its suppliers a hundred times."""
    from hearthgauge.plans import roles as R

    small = "/root/testdata/sf0.001"
    for name in ("nation", "region"):
        R.table(spark, small, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = R.table(spark, small, "supplier").crossJoin(spark.range(100).withColumnRenamed("id", "copy"))
    rows.withColumn("s_suppkey", F.col("s_suppkey") + F.col("copy") * 1000).drop("copy").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = R.table(spark, small, "customer").crossJoin(spark.range(10).withColumnRenamed("id", "copy"))
    rows.withColumn("c_custkey", F.col("c_custkey") + F.col("copy") * 10000).drop("copy").write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["pip_first_match", "pip_district_cardinality", "evidence_resolve"])
def test_polygons_meet_places(spark, crowded_tables, name):
    from hearthgauge.plans import queries as P

    out = P.QUERIES[name](spark, crowded_tables)
    n = spark.read.parquet(f"{crowded_tables}/customer.parquet").count()
    assert out.count() == n and met(out) <= n
    copies = out.withColumn("k", F.col("property_id") % 10000).drop("property_id").distinct()
    assert copies.count() == n // 10 and copies.select(*copies.columns[:-1]).distinct().count() > 1


@pytest.fixture
def priced(spark, crowded):
    """The crowded properties, with 8 sales at each place and 4 years of sale."""
    terms = {"total_price": F.lit(100.0), "area_ping": F.lit(10.0), "parking_price": F.lit(0.0), "parking_area_ping": F.lit(0.0)}
    properties = crowded[0].withColumns({"p_age": F.lit(5), "p_type": F.lit("t"), **terms})
    sales = spark.range(16).select(F.lit(1).alias("district"), (25 + F.col("id") % 2 / 1000).alias("lat"), F.lit(121.5).alias("lon"), F.lit(9).alias("age"), F.lit("t").alias("building_type"), F.lit(False).alias("special"), F.make_date(F.lit(2000) + (F.col("id") % 4).cast("int"), F.lit(1), F.lit(1)).alias("date"), *(c.alias(n) for n, c in terms.items()))
    return properties, sales.withColumn("total_price", F.col("total_price") + F.monotonically_increasing_id() % 2)


def test_comparable_radius_meets_questions(priced):
    out = A.comparable_radius(*priced)
    assert met(out) <= 2002
    assert {(r.radius_used, r.n, round(r.farthest)) for r in out.collect()} == {(500, 16, 111)} and out.count() == 2000


@pytest.mark.parametrize("name", ["price_analysis", "price_trend", "price_trend_arrays"])
def test_prices_meet_questions(priced, name):
    properties, sales = priced
    out = getattr(A, name)(properties, sales)
    rows = 8000 if name == "price_trend" else 2002
    assert met(out) <= rows
    got = {r.property_id: r for r in out.collect()} if name != "price_trend" else {}
    if name == "price_analysis":
        assert {(r.sample_count, r.median, r.q1, r.q3) for k, r in got.items() if k < 2000} == {(16, 10.05, 10.0, 10.1)}
        assert {(r.sample_count, r.insufficient, r.radius_used) for k, r in got.items() if k >= 2000} == {(0, True, 1000)} and len(got) == 2002
    elif name == "price_trend":
        assert {(r.year, r.sample_count) for r in out.collect()} == {(y, 4) for y in range(2000, 2004)} and out.count() == 8000
    else:
        assert {(len(r.trend), tuple(r.low_sample_years)) for r in got.values()} == {(4, (2000, 2001, 2002, 2003))} and len(got) == 2000


def test_price_and_trend_is_both(priced):
    properties, sales = priced
    own, price = A.price_and_trend(properties, sales), A.price_analysis(properties, sales)
    assert met(own) <= 2002
    assert sorted(map(tuple, own.drop("trend").collect())) == sorted(map(tuple, price.collect()))
    trends = {r.property_id: r.trend for r in A.price_trend_arrays(properties, sales).collect()}
    assert {r.property_id: r.trend for r in own.where("trend IS NOT NULL").collect()} == trends and len(trends) == 2000


def test_interior_points_of_many_polygons(spark):
    rows = spark.range(3000).select(F.col("id").alias("ord"), F.array(F.array(*(F.struct((121.5 + F.col("id") * 1e-4 + x).alias("lon"), (25 + F.col("id") % 7 * 1e-4 + y).alias("lat")) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.008), (0.0, 0.008))))).alias("rings"))
    began = time.monotonic()
    got = G.interior_point(G.with_bounds(G.edge_table(rows, ["ord"]), ["ord"]), ["ord"]).collect()
    assert time.monotonic() - began < 40
    assert len(got) == 3000 and all(abs(r.lat - 25 - r.ord % 7 * 1e-4 - 0.004) < 1e-9 and abs(r.edge_distance - 0.004 * 111000) < 1e-5 for r in got)


def test_covered_grid_points_meet_one_polygon(spark):
    zone = shapes(spark).where("ord = 2").withColumn("part", F.lit("p"))
    free = zone.withColumns({"ord": F.lit(3), "part": F.lit("q")})
    out = G.interior_point(zone.unionByName(free), ["ord"], excluded=zone.drop("ord").crossJoin(spark.range(2000)), on=["part"])
    assert met(out) <= 2000 and [r.ord for r in out.collect()] == [3]


@pytest.mark.parametrize("name", ["price_trend", "price_trend_chart", "price_analysis"])
def test_prices_leave_little_on_disk(spark, monkeypatch, name):
    """Joins of sales deal keys and whole numbers only, and their shuffle files and tables are gone once sales are written."""
    from hearthgauge.plans import queries as P
    from hearthgauge.sources import scratch as T

    saved, save = {}, T.Scratch.save
    monkeypatch.setattr(T.Scratch, "save", lambda self, df, what, *a, **b: saved.setdefault(f"{self.root}/{what}", df) and save(self, df, what, *a, **b))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: map(spark._jvm.java.io.File, blocks.getAllFiles().mkString("\n").split("\n"))
    sizes = lambda: {f.getPath(): f.length() for f in files() if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        there = sizes()
        P.QUERIES[name](spark, "/root/testdata/sf0.001")
        left = lambda: sum(n for f, n in sizes().items() if f not in there)
        until = time.monotonic() + 10
        while left() > 5000 and time.monotonic() < until:
            time.sleep(0.2)
        assert left() <= 5000
        dealt = {kind for path, df in saved.items() if not path.endswith("/asked") for kind in dealt_types(df)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get(T.SHUFFLES_GO) == "false"
    assert "bigint" in dealt and dealt <= {"bigint", "int", "string"}
    kept = [p for p in saved if spark._jvm.java.io.File(p.removeprefix("file://")).exists()]
    assert sorted(p.rsplit("/", 1)[1] for p in kept) == ["asked", "sales"]


def dealt_types(df) -> set:
    """Types of the columns that the plan of a frame shuffles."""
    plan, seen = [df._jdf.queryExecution().executedPlan()], set()
    while plan:
        p = plan.pop()
        plan += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.children().apply(k) for k in range(p.children().size())]
        if p.nodeName() == "Exchange":
            seen |= {p.output().apply(k).dataType().simpleString() for k in range(p.output().size())}
    return seen
