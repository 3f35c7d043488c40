import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthgauge.functions import geo, names, scalars as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


L = F.lit


def test_unit_prices(spark):
    price = lambda *a: S.unit_price(*map(L, map(float, a)))
    assert one(spark, price(20e6, 40, 0, 0), price(20e6, 40, 2e6, 0), price(20e6, 40, 2e6, 10), price(1e6, 5, 0, 6), S.unit_price_or_null(L(1e6), L(5.0), L(0.0), L(6.0))) == (500000.0, 450000.0, 600000.0, 0.0, None)
    assert one(spark, S.unit_price(L(10.0), L(2.0), L(-5.0), L(None).cast("double")))[0] == 5.0


def test_unit_cents_are_unit_prices(spark):
    rows = spark.createDataFrame([(20e6, 40.0, 2e6, 10.0), (10.0, 3.0, None, None), (1e6, 5.0, 0.0, 6.0), (-7.0, 3.0, -1.0, 0.0), (None, 3.0, 0.0, 0.0), (5.0, None, 0.0, 0.0), (0.125, 1.0, 0.0, 0.0), (1e12, 0.37, 1.0, 0.01)], "a double, b double, c double, d double")
    got = rows.select(S.unit_price(*map(F.col, "abcd")).alias("u"), S.unit_cents(*map(F.col, "abcd")).alias("n")).collect()
    assert [r.u for r in got] == [r.n if r.n is None else r.n / 100 for r in got] and got[1].n == 333 and got[2].n == 0 and got[4].n is None


def test_rounding_goes_half_up(spark):
    assert one(spark, S.half_up(L(-2.5), 0), S.half_up(L(2.5), 0), S.half_up(L(0.125), 2)) == (-2.0, 3.0, 0.13)


def test_dates(spark):
    d = lambda t: S.roc_date(L(t))
    assert one(spark, d("1130229"), d("1120229"), d("991231"), d("113/07/05"), d("12345"), d(None), d("1131301")) == (dt.date(2024, 2, 29), None, dt.date(2010, 12, 31), dt.date(2024, 7, 5), None, None, None)
    w = lambda t, y: S.western_date(L(t), L(y))
    assert one(spark, w("20240105", 2024), w("20240105", 2023), w("20240230", 2024), w("2024015", 2024)) == (dt.date(2024, 1, 5), None, None, None)


def test_areas_types_floors(spark):
    assert one(spark, S.sqm_to_ping(L(33.05785)), S.sqm_to_ping(L(-1.0)), S.sqm_to_ping(L(float("nan")))) == (10.0, 0.0, 0.0)
    assert one(spark, S.building_type(L("住宅大樓 (11層含以上有電梯)")), S.building_type(L("公寓(5樓含以下無電梯)")), S.building_type(L("其他"))) == ("highrise", "apartment", None)
    f = lambda t: S.floor_number(L(t))
    assert one(spark, f("十二層"), f("三層"), f("二十一層"), f("地下一層"), f("一層,二層"), f(""), f(None), f("7層")) == (12, 3, 21, 0, 0, 0, 0, 7)
    c = lambda t: S.chinese_number(L(t))
    assert one(spark, c("十"), c("十五"), c("四十"), c("105"), c("百"), c("兩")) == (10, 15, 40, 105, None, 2)


def test_special_and_levels(spark):
    assert one(spark, S.special_transaction(L("親友、員工間交易")), S.special_transaction(L("一般")), S.special_transaction(L(None).cast("string"))) == (True, False, False)
    assert one(spark, S.depth_level(L("0.3-0.5")), S.depth_level(L(">3.0")), S.depth_level(L("?")), S.liquefaction_level(L("3"))) == ("attention", "priority", None, "low")
    assert one(spark, S.disaster_level(L("low"), L("unknown")), S.disaster_level(L("attention"), L("unknown"), L("priority")), S.disaster_level(L("low"), L("attention"))) == ("unknown", "priority", "attention")
    assert one(spark, S.price_level(L(True), L(False), L(8.0)), S.price_level(L(True), L(False), L(-20.5)), S.price_level(L(True), L(False), L(20.1)), S.price_level(L(False), L(False), L(1.0))) == ("low", "attention", "priority", "unknown")
    assert one(spark, S.scenario_hours(L("24h-500")), S.scenario_millimetres(L("24h-500")), S.scenario_hours(L("x"))) == (24, 500, 0)


def test_identifiers_and_numbers(spark):
    a, b = one(spark, S.stable_id(L(" a"), L(None).cast("string"), L("c　")), S.stable_id(L("a"), L(""), L("c")))
    assert a == b and len(a) == 24
    assert one(spark, S.number_text(L(2e7)), S.number_text(L(2.5))) == ("20000000", "2.5")
    j = lambda t: S.js_number(L(t))
    assert one(spark, j(""), j(" 12 "), j("0x10"), j("1e3"), j("1,000"), j("abc"), j(".5")) == (0.0, 12.0, 16.0, 1000.0, None, None, 0.5)


def test_presentation(spark):
    assert one(spark, S.distance_text(L(1234.0)), S.distance_text(L(99.6)), S.distance_text(L(None).cast("double"))) == ("1.2 公里", "100 公尺", "資料不足")
    assert one(spark, S.local_date_text(L("2026-07-21T20:00:00.000Z")), S.local_date_text(L("")), S.local_date_text(L("x"))) == ("2026/07/22", "日期不明", "x")
    assert one(spark, S.presented_count(L(0), L("official"), L(False)), S.presented_count(L(0), L("failed"), L(False)), S.presented_count(L(0), L("official"), L(True))) == ("0", "資料不足", "舊快照")


def test_names(spark):
    a = lambda t, d="": names.normal_address(names.nfkc(L(t)), L(""), L(d))
    assert one(spark, a("臺北市大安區信義路３號－２", "大安區"), a("信義路3號之2五樓"), a(None)) == ("信義路3號之2", "信義路3號之2", "")
    assert one(spark, names.market_name(L("臺北市公有台南市場(1)(BOT)")), names.place_name(L("台北 (東)")), names.park_type(L("大安公園廣場")), names.rail_name(L("臺北-環島")), names.metro_name(L("{中山,Zhongshan}"))) == ("臺南市場一", "臺北東", "plaza", "臺北", "中山")
    assert one(spark, *names.lat_lon(L(" 25.01 121.5 ")), *names.lat_lon(L("x 1 2"))) == (25.01, 121.5, None, None)
    assert names.address_forms("信義路二段十二巷3、5號", "大安區")[-1] == "信義路二段12巷3號"


def test_geometry(spark):
    d, same = one(spark, geo.haversine(L(25.0), L(121.0), L(25.0), L(121.01)), geo.planar(L(25.0), L(121.0), L(25.0), L(121.0)))
    assert 1007 < d < 1009 and same == 0
    lon, lat = one(spark, *geo.twd97_to_wgs84(L(250000.0), L(2770000.0)))
    assert lon == 121.0 and lat == pytest.approx(25.0387, abs=5e-3)
    assert one(spark, *geo.twd97_to_wgs84(L(float("nan")), L(1.0))) == (None, None)
    assert one(spark, geo.segment_distance(L(0.001), L(0.5), L(0.0), L(0.0), L(0.0), L(1.0)))[0] == pytest.approx(111.0, abs=0.01)
