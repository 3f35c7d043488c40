"""Registered queries over raw records: validity by source, published schemas, and the gates of a release.

The raw records are made of the test tables by expressions that Spark and DuckDB read alike, so each query and its SQL
start from the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import projections as P, release as E, validity as V
from . import roles as R
from .queries import cuts, query

#: The five known districts of the test records; the others are unknown.
DISTRICTS = ["區0", "區1", "區2", "區3", "區4"]
_KNOWN = ", ".join(f"'{x}'" for x in DISTRICTS)


def raw(spark: SparkSession, d: str, table: str, fields: dict[str, str]) -> DataFrame:
    return R.table(spark, d, table).select(*(F.expr(e).alias(n) for n, e in fields.items()))


def raw_sql(table: str, fields: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in fields.items()) + f" FROM {table}"


def _pick(key: str, *values: str) -> str:
    *first, last = values
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(first)) + f" ELSE {last} END"


# ---- sales -------------------------------------------------------------------------------------------------

_MONTH, _DAY = "lpad(CAST(month(l_shipdate) AS VARCHAR(2)), 2, '0')", "lpad(CAST(day(l_shipdate) AS VARCHAR(2)), 2, '0')"
SALE = {
    "編號": "concat('S', l_orderkey, '-', l_linenumber)",
    "鄉鎮市區": "concat(' 區', l_suppkey % 6)",
    "交易標的": "CASE WHEN l_linenumber = 7 THEN '土地' ELSE '房地(土地+建物)+車位' END",
    "建物型態": _pick("l_partkey", "'公寓(5樓含以下無電梯)'", "'華廈(10層含以下有電梯)'", "'住宅大樓(11層含以上有電梯)'", "'店面'"),
    "主要用途": "CASE WHEN l_suppkey % 7 = 0 THEN '商業用' ELSE '住家用' END",
    "交易年月日": f"CASE WHEN l_orderkey % 19 = 0 THEN '0871332' ELSE concat(year(l_shipdate) - 1911, {_MONTH}, {_DAY}) END",
    "總價元": "CASE WHEN l_quantity = 1 THEN '0' ELSE concat('', CAST(floor(l_extendedprice) AS BIGINT)) END",
    "建物移轉總面積平方公尺": "concat(CAST(floor(l_quantity) AS BIGINT), '.5')",
    "建築完成年月": "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat(50 + l_partkey % 30, '0101') END",
    "車位總價元": "CASE WHEN l_linenumber = 2 THEN '500000' ELSE '' END",
    "車位移轉總面積平方公尺": "CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 2 THEN '12.5' ELSE '0' END",
    "移轉層次": _pick("l_linenumber", "'五層'", "'十二層'", "'地下一層'", "'三層，陽台'", "'二層，三層'"),
    "備註": "CASE WHEN l_returnflag = 'R' THEN '親友間交易' ELSE '' END",
    "address": "concat('路', l_partkey % 50, '號')",
    "match_status": "CASE WHEN l_suppkey % 17 = 0 THEN 'ambiguous' WHEN l_suppkey % 13 = 0 THEN 'unmatched' ELSE 'matched' END",
    "lat": "CAST(24.95 AS DOUBLE) + ((l_partkey * 7919) % 4000) * CAST(0.0001 AS DOUBLE)",
    "lon": "CAST(121.45 AS DOUBLE) + ((l_partkey * 104729) % 1000) * CAST(0.0001 AS DOUBLE)",
}
_SALES = f"""raw AS ({raw_sql('lineitem', SALE)}),
p AS (SELECT *, trim("鄉鎮市區") AS district_label, CASE WHEN contains("建物型態", '公寓') THEN 'apartment' WHEN contains("建物型態", '華廈') THEN 'mansion' WHEN contains("建物型態", '住宅大樓') THEN 'highrise' END AS building_type,
  try_strptime((left("交易年月日", length("交易年月日") - 4)::INT + 1911)::VARCHAR || right("交易年月日", 4), '%Y%m%d')::DATE AS date, "總價元"::DOUBLE AS total_price, floor("建物移轉總面積平方公尺"::DOUBLE / 3.305785::DOUBLE * 100 + 0.5) / 100 AS area_ping,
  CASE WHEN "建築完成年月" <> '' THEN ((left("建築完成年月", 2)::INT + 1911)::VARCHAR || '-01-01')::DATE END AS built FROM raw WHERE trim("鄉鎮市區") IN ({_KNOWN})),
a AS (SELECT *, CASE WHEN built IS NOT NULL THEN greatest(0, floor(date_diff('day', built, date) / 365.25::DOUBLE))::INT END AS age FROM p),
sales AS (SELECT *, CASE WHEN "交易標的" = '土地' THEN 'nonResidentialTarget' WHEN building_type IS NULL OR "主要用途" <> '住家用' THEN 'unsupportedBuilding' WHEN date IS NULL OR date < DATE '1996-01-01' THEN 'outsideWindow'
  WHEN total_price <= 0 OR age IS NULL OR age > 200 THEN 'invalidCoreFields' WHEN match_status = 'ambiguous' THEN 'ambiguousAddress' WHEN match_status = 'unmatched' THEN 'unmatchedAddress'
  WHEN NOT (lat BETWEEN 24.65 AND 25.32 AND lon BETWEEN 121.28 AND 122.02) THEN 'outOfBounds' END AS reason FROM a)"""
_SALE_ID = """substring(sha256(concat_ws('|', "編號", date::VARCHAR, district_label, address, total_price::BIGINT::VARCHAR, "建物移轉總面積平方公尺", "移轉層次")), 1, 24)"""


def sale_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.sales(raw(spark, d, "lineitem", SALE), DISTRICTS, F.lit("1996-01-01").cast("date"))


@query(f"WITH {_SALES} SELECT district_label, reason, count(*)::BIGINT AS n FROM sales GROUP BY ALL")
def sale_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return sale_rows(spark, d).groupBy("district_label", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_SALES}, m AS (SELECT *, CASE WHEN "車位總價元" = '' THEN 0.0 ELSE "車位總價元"::DOUBLE END AS parking_price, floor("車位移轉總面積平方公尺"::DOUBLE / 3.305785::DOUBLE * 100 + 0.5) / 100 AS parking_area_ping FROM sales WHERE reason IS NULL)
SELECT {_SALE_ID} AS id, date::VARCHAR AS date, lat AS latitude, lon AS longitude, total_price, area_ping, age, building_type, CASE "移轉層次" WHEN '五層' THEN 5 WHEN '十二層' THEN 12 WHEN '三層，陽台' THEN 3 ELSE 0 END::INT AS floor,
  "備註" <> '' AS special_transaction, parking_price, parking_area_ping, parking_price > 0 AND parking_area_ping <= 0 AS unit_price_approximate, {R.unit_price_sql()} AS unit_price FROM m""")
def sale_projection(spark: SparkSession, d: str) -> DataFrame:
    return P.transactions(sale_rows(spark, d)).withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {_SALES} SELECT {_SALE_ID} AS id, 'taipei' AS city, district_label, address, date::VARCHAR AS date, total_price, "建物移轉總面積平方公尺"::DOUBLE AS area_square_meters, building_type,
  CASE WHEN "車位總價元" = '' THEN 0.0 ELSE "車位總價元"::DOUBLE END AS parking_price, "車位移轉總面積平方公尺"::DOUBLE AS parking_area_square_meters, "移轉層次" AS floor FROM sales WHERE reason IS NULL""")
def sale_audit_projection(spark: SparkSession, d: str) -> DataFrame:
    return P.audit_records(sale_rows(spark, d), "taipei").withColumn("date", F.col("date").cast("string"))


# ---- accidents ---------------------------------------------------------------------------------------------

ACCIDENT = {
    "發生年度": "CASE WHEN event_id % 97 = 0 THEN '2020' ELSE concat('', 2023 + user_id % 3) END",
    "發生日期": "CASE WHEN event_id % 89 = 0 THEN '20230230' ELSE concat(2023 + user_id % 3, lpad(CAST(month(ts) AS VARCHAR(2)), 2, '0'), '/', lpad(CAST(1 + day(ts) % 28 AS VARCHAR(2)), 2, '0')) END",
    "發生時間": "concat(' ', event_id % 24, '  時')",
    "事故類別名稱": "CASE event_type WHEN 'error' THEN ' a1 ' WHEN 'purchase' THEN 'A2' WHEN 'click' THEN 'A3' ELSE 'A2' END",
    "處理單位名稱警局層": "concat('局', user_id % 5)",
    "發生地點": "concat('路口', event_id)",
    "經度": "CASE WHEN event_id % 83 = 0 THEN '' ELSE concat('121.', 100000 + event_id % 800000) END",
    "緯度": "concat('25.', 100000 + event_id % 200000)",
    "expected_year": "CAST(2023 + user_id % 3 AS INT)",
    "expected_severity": "CASE event_type WHEN 'error' THEN 'A1' ELSE 'A2' END",
}
_ACCIDENTS = f"""raw AS ({raw_sql('events', ACCIDENT)}),
x AS (SELECT *, try_strptime(replace("發生日期", '/', ''), '%Y%m%d')::DATE AS date, upper(trim("事故類別名稱")) AS severity FROM raw),
accidents AS (SELECT *, CASE WHEN "發生年度" <> expected_year::VARCHAR OR date IS NULL OR year(date) <> expected_year THEN 'invalidDate' WHEN severity NOT IN ('A1', 'A2') OR severity <> expected_severity THEN 'invalidSeverity'
  WHEN "經度" = '' THEN 'invalidCoordinate' END AS reason FROM x)"""


def accident_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.accidents(raw(spark, d, "events", ACCIDENT))


@query(f"WITH {_ACCIDENTS} SELECT expected_year, reason, count(*)::BIGINT AS n FROM accidents GROUP BY ALL")
def accident_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return accident_rows(spark, d).groupBy("expected_year", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_ACCIDENTS} SELECT substring(sha256(concat_ws('|', expected_year::VARCHAR, date::VARCHAR, regexp_replace(trim("發生時間"), ' +', ' ', 'g'), severity, "處理單位名稱警局層", "發生地點", "經度", "緯度")), 1, 24) AS id, severity, "經度"::DOUBLE AS lon, "緯度"::DOUBLE AS lat FROM accidents WHERE reason IS NULL""")
def accident_projection(spark: SparkSession, d: str) -> DataFrame:
    return accident_rows(spark, d).where("reason IS NULL").select("id", "severity", "lon", "lat")


@query(f"WITH {_ACCIDENTS} SELECT expected_year, count(*)::BIGINT AS raw_rows, count(reason)::BIGINT AS major, {cuts('count(reason) / count(*)', 6)} AS rate, count(reason) / count(*) <= 0.2 AS passed FROM accidents GROUP BY 1")
def accident_major_exclusions(spark: SparkSession, d: str) -> DataFrame:
    out = E.major_exclusions(accident_rows(spark, d), "expected_year", ["invalidDate", "invalidSeverity", "invalidCoordinate"], 0.2)
    return out.withColumn("rate", S.half_up(F.col("rate"), 6))


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return E.repeated_ids(R.table(spark, d, "events"), "user_id")


# ---- facilities --------------------------------------------------------------------------------------------

PARKING = {
    "id": "CASE WHEN p_partkey % 23 = 0 THEN '' ELSE concat('P', p_partkey) END",
    "name": "CASE WHEN p_partkey % 29 = 0 THEN '  ' ELSE p_name END",
    "area": "concat('區', p_partkey % 6)",
    "totalcar": _pick("p_size", "'0'", "concat(p_size, '.7')", "'abc'", "concat('', p_size)"),
    "tw97x": "CASE WHEN p_partkey % 31 = 0 THEN 'x' ELSE concat('', 300000 + p_partkey) END",
    "tw97y": "concat('', 2770000 + p_partkey)",
}
_CAR = "CASE p_size % 4 WHEN 1 THEN p_size WHEN 3 THEN p_size ELSE 0 END"


@query(f"SELECT CASE WHEN p_partkey % 23 = 0 OR p_partkey % 29 = 0 OR p_partkey % 6 = 5 OR {_CAR} <= 0 OR p_partkey % 31 = 0 THEN 'invalidCoreFields' END AS reason, count(*)::BIGINT AS n, sum({_CAR})::BIGINT AS capacity FROM part GROUP BY 1")
def parking_validity(spark: SparkSession, d: str) -> DataFrame:
    out = V.parking(raw(spark, d, "part", PARKING), DISTRICTS)
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"))


HOSPITAL = {
    "hosp_id": "CASE WHEN p_partkey % 19 = 0 THEN '' ELSE concat('H', p_partkey) END",
    "hosp_name": "p_name",
    "area": "concat('區', p_partkey % 6)",
    "hosp_addr": _pick("p_size", "'中山路3號'", "'中山路3、5號'", "'中山路3號5號'", "'中山路3號及民生路一段'", "'中山路三號及二樓'", "''"),
}


@query("SELECT CASE WHEN p_partkey % 19 = 0 OR p_partkey % 6 = 5 THEN 'invalidCoreFields' WHEN p_size % 6 IN (1, 2, 3) THEN 'multipleAddress' END AS reason, count(*)::BIGINT AS n FROM part GROUP BY 1")
def hospital_validity(spark: SparkSession, d: str) -> DataFrame:
    return V.hospitals(raw(spark, d, "part", HOSPITAL), DISTRICTS).groupBy("reason").agg(F.count("*").alias("n"))


SCHOOL = {
    "學年度": "CASE WHEN p_partkey % 9 = 0 THEN '113' WHEN p_partkey % 9 = 1 THEN '' ELSE '114' END",
    "縣市名稱": _pick("p_size", "'臺北市'", "'新北市'", "'台北市'", "'桃園市'"),
    "地址": _pick("p_partkey", "'[106]臺北市區0和平里3鄰路1號'", "'[220]新北市區1幸褔路2號'", "'臺北市區2路'", "'臺北市區9路4號'", "'臺北市區3永安里路5號12鄰'"),
    "學校名稱": "CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_name END",
}


@query("""WITH s AS (SELECT p_partkey, p_size, p_partkey % 5 AS k FROM part WHERE p_partkey % 9 <> 0 AND p_size % 4 <> 3)
SELECT CASE WHEN p_size % 4 = 1 THEN 'new-taipei' ELSE 'taipei' END AS city, ['區0', '區1', '區2', NULL, '區3'][k + 1] AS district, ['臺北市區0路1號', '新北市區1幸福路2號', '臺北市區2路', NULL, '臺北市區3路5號'][k + 1] AS simple_address,
  CASE WHEN k IN (2, 3) OR p_partkey % 37 = 0 THEN 'invalidCoreFields' END AS reason, count(*)::BIGINT AS n FROM s GROUP BY ALL""")
def school_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = V.latest_school_year(raw(spark, d, "part", SCHOOL))
    out = V.schools(rows, DISTRICTS).withColumn("simple_address", F.when(F.col("district").isNotNull(), F.col("simple_address")))
    return out.groupBy("city", "district", "simple_address", "reason").agg(F.count("*").alias("n"))


PARK = {
    "seqno": "CASE WHEN p_partkey % 41 = 0 THEN '' ELSE concat('', p_partkey) END",
    "area": "concat('區', p_partkey % 6)",
    "name": "p_name",
    "address": _pick("p_size", "'板橋市中山路3號'", "'中山路3號旁'", "'中山路口3號'", "'福德段3地號'", "'中山路3號前20公尺'", "'中山路'", "'民生路7號'"),
}


@query("SELECT CASE WHEN p_partkey % 41 = 0 OR p_partkey % 6 = 5 OR p_size % 7 IN (1, 2, 3, 4, 5) THEN 'invalidCoreFields' END AS reason, count(*)::BIGINT AS n, count(DISTINCT CASE p_size % 7 WHEN 0 THEN '中山路3號' ELSE p_size % 7 || '' END)::BIGINT AS places FROM part GROUP BY 1")
def park_validity(spark: SparkSession, d: str) -> DataFrame:
    return V.parks(raw(spark, d, "part", PARK), DISTRICTS).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"))


_KINDS = _pick("p_size", "' 國民小學'", "'鄰里公園'", "'國民小學附設'", "'高中職'", "'醫院'", "'廣場'")


@query("SELECT CASE p_size % 6 WHEN 0 THEN 'school' WHEN 3 THEN 'school' WHEN 1 THEN 'park' WHEN 5 THEN 'park' END AS use, count(*)::BIGINT AS n FROM part GROUP BY 1")
def landmark_filter(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "part", {"kind": _KINDS}).groupBy(V.landmark_use(F.col("kind")).alias("use")).agg(F.count("*").alias("n"))


_MARKETS = _pick("p_size", "'早市'", "'黃昏市場'", "'公有市場(超市)'", "'午市'", "'夜市'", "'早市兼批發'", "'百貨'")


@query("SELECT p_size % 7 IN (0, 1, 3) AS included, count(*)::BIGINT AS n FROM part GROUP BY 1")
def market_inclusion(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "part", {"kind": _MARKETS}).groupBy(V.is_traditional_market(F.col("kind")).alias("included")).agg(F.count("*").alias("n"))


MARKET = {
    "id": "p_partkey",
    "key": "concat('市場', p_partkey % 40)",
    "address_district": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('區', p_partkey % 5) END",
    "address_lat": "CAST(25.0 AS DOUBLE) + (p_partkey % 7) * CAST(0.0001 AS DOUBLE)",
    "address_lon": "CAST(121.5 AS DOUBLE)",
    "place_district": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat('區', (p_partkey + CASE WHEN p_partkey % 53 = 0 THEN 1 ELSE 0 END) % 5) END",
    "official_lat": "CAST(25.0 AS DOUBLE) + (p_partkey % 31) * CAST(0.0001 AS DOUBLE)",
    "official_lon": "CAST(121.5 AS DOUBLE)",
    "city": _pick("p_partkey", "'taipei'", "'new-taipei'"),
    "ownership": _pick("p_size", "'public'", "'private'"),
}
_STALLS = "stalls AS (SELECT '市場' || (s_suppkey % 60) AS key, sum(s_suppkey % 3)::BIGINT AS fresh_stalls FROM supplier GROUP BY 1)"


def markets(spark: SparkSession, d: str) -> DataFrame:
    stalls = R.table(spark, d, "supplier").groupBy(F.concat(F.lit("市場"), (F.col("s_suppkey") % 60).cast("string")).alias("key")).agg(F.sum(F.col("s_suppkey") % 3).alias("fresh_stalls"))
    return E.located_markets(raw(spark, d, "part", MARKET), stalls, "key")


_LOCATED = f"""raw AS ({raw_sql('part', MARKET)}), {_STALLS},
located AS (SELECT raw.*, CASE WHEN coalesce(fresh_stalls, 0) <= 0 THEN 'noFreshFoodStalls' WHEN address_district IS NULL AND place_district IS NULL THEN 'unmatchedAddress' END AS reason FROM raw LEFT JOIN stalls USING (key)),
m AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN address_district IS NOT NULL THEN 'address' ELSE 'official-coordinate-fallback' END END AS location_method FROM located)"""


@query(f"WITH {_LOCATED} SELECT reason, location_method, count(*)::BIGINT AS n, {cuts('sum(CASE WHEN reason IS NULL THEN CASE WHEN address_district IS NOT NULL THEN address_lat ELSE official_lat END END)', 4)} AS total_lat FROM m GROUP BY ALL")
def public_market_location(spark: SparkSession, d: str) -> DataFrame:
    return markets(spark, d).groupBy("reason", "location_method").agg(F.count("*").alias("n"), S.half_up(F.sum("lat"), 4).alias("total_lat"))


@query(f"WITH raw AS ({raw_sql('part', MARKET)}) SELECT id FROM raw WHERE address_district IS NOT NULL AND place_district IS NOT NULL AND (address_district <> place_district OR sqrt(pow((address_lat - official_lat) * 111000, 2) + pow((address_lon - official_lon) * 101000, 2)) > 150)")
def market_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return E.matched_conflicts(raw(spark, d, "part", MARKET)).select("id")


@query(f"""WITH {_LOCATED}, s AS (SELECT id, CASE WHEN city = 'new-taipei' THEN 'new-taipei' ELSE ownership END AS stratum, city = 'taipei' AND ownership = 'public' AND location_method = 'official-coordinate-fallback' AS fb FROM m WHERE reason IS NULL),
f AS (SELECT *, coalesce(fb AND id = (SELECT min(id) FROM s WHERE fb), false) AS front FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY front DESC, id) AS place FROM f)
SELECT id, stratum, place::INT AS place FROM r WHERE place <= CASE stratum WHEN 'public' THEN 3 WHEN 'private' THEN 2 ELSE 5 END""")
def market_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.market_sample(markets(spark, d).where("reason IS NULL")).select("id", "stratum", "place")


# ---- transport ---------------------------------------------------------------------------------------------

STOP = {
    "ord": "event_id",
    "stoplocationid": "CASE WHEN event_id % 61 = 0 THEN '' ELSE concat('B', user_id) END",
    "address": "concat('新北市區', user_id % 6, '路')",
    "showlon": "CASE WHEN event_id % 3 = 0 THEN '' ELSE '121.5' END",
    "longitude": "CASE WHEN event_id % 9 = 0 THEN '119.0' ELSE '121.6' END",
    "showlat": "'25.0'",
    "latitude": "''",
}
_STOPS = """s AS (SELECT event_id AS ord, event_id % 61 = 0 AS blank, user_id, user_id % 6 = 5 OR event_id % 9 = 0 AS bad FROM events),
f AS (SELECT user_id, min(ord) AS first FROM s WHERE NOT blank AND NOT bad GROUP BY 1),
stops AS (SELECT s.*, CASE WHEN blank THEN 'blankId' WHEN ord > first THEN 'duplicate' WHEN bad THEN 'invalidOrUnassigned' END AS reason FROM s LEFT JOIN f USING (user_id))"""


@query(f"WITH {_STOPS} SELECT reason, count(*)::BIGINT AS n FROM stops GROUP BY 1")
def bus_validity(spark: SparkSession, d: str) -> DataFrame:
    return V.bus(raw(spark, d, "events", STOP), DISTRICTS, "ord").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_STOPS}, c AS (SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason = 'invalidOrUnassigned') AS invalid FROM stops) SELECT n::BIGINT AS n, accepted::BIGINT AS accepted, invalid::BIGINT AS invalid, {cuts('(n - accepted - invalid) / n', 6)} AS duplicate_ratio, (n - accepted - invalid) / n BETWEEN 0 AND 0.99 AS passed FROM c")
def bus_duplicate_ratio(spark: SparkSession, d: str) -> DataFrame:
    return V.duplicate_stop_ratio(V.bus(raw(spark, d, "events", STOP), DISTRICTS, "ord")).withColumn("duplicate_ratio", S.half_up(F.col("duplicate_ratio"), 6))


METRO = {
    "ord": "p_partkey",
    "StationID": "concat('''', 'M', p_partkey % 150)",
    "StationName": "CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('{站', p_partkey % 150, ',Zh}') END",
    "StationAddress": "concat('''臺北市區', p_partkey % 6, '路1號')",
    "StationPosition": _pick("p_size", "'(121.5 , 25.0)'", "'121.51,25.01'", "'none'", "'119.0, 25.0'"),
}


@query("""WITH s AS (SELECT p_partkey AS ord, p_partkey % 150 AS k, p_partkey % 6 = 5 OR p_size % 4 IN (2, 3) AS bad, p_size FROM part), f AS (SELECT k, min(ord) AS first FROM s WHERE NOT bad GROUP BY 1)
SELECT CASE WHEN ord > first THEN 'duplicate' WHEN bad THEN 'invalidOrUnassigned' END AS reason, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN p_size % 4 = 0 THEN 'M' || k ELSE '站' || k END)::BIGINT AS n_names FROM s LEFT JOIN f USING (k) GROUP BY 1""")
def metro_validity(spark: SparkSession, d: str) -> DataFrame:
    return V.metro(raw(spark, d, "part", METRO), DISTRICTS, "ord").groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


RAIL = {
    "stationCode": "concat('', s_suppkey)",
    "stationName": "CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE concat('站', s_suppkey, '-環島') END",
    "stationAddrTw": _pick("s_suppkey", "'新北市區1路'", "'臺北市區2路'", "'基隆市區3路'", "'臺中市路'"),
    "gps": "CASE WHEN s_suppkey % 11 = 0 THEN '25.0' ELSE concat('25.', 10000 + s_suppkey, ' 121.5') END",
    "in_district": "s_suppkey % 17 <> 0",
}
_RAIL = "CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 11 = 0 OR s_suppkey % 17 = 0 OR s_suppkey % 4 = 3 THEN CASE WHEN s_suppkey % 4 < 2 THEN 'invalid' ELSE 'elsewhere' END END"


@query(f"SELECT {_RAIL} AS reason, count(*)::BIGINT AS n, min(CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE '站' || s_suppkey END) AS first_name FROM supplier GROUP BY 1")
def rail_validity(spark: SparkSession, d: str) -> DataFrame:
    return V.rail(raw(spark, d, "supplier", RAIL), DISTRICTS).groupBy("reason").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query(f"SELECT count(*)::BIGINT AS stations, count(*)::BIGINT AS points, count(*) >= 25 AS passed FROM supplier WHERE {_RAIL} IS NULL")
def rail_gate(spark: SparkSession, d: str) -> DataFrame:
    return E.rail_gate(V.rail(raw(spark, d, "supplier", RAIL), DISTRICTS).where("reason IS NULL"), 0)


# ---- forms, features, labels -------------------------------------------------------------------------------

FORM = {
    "id": "c_custkey",
    "address": "CASE WHEN c_custkey % 23 = 0 THEN '  ' ELSE concat(' ', c_name, ' ') END",
    "location_confirmed": "c_custkey % 19 <> 0",
    "total_price": _pick("c_custkey", "'12000000'", "'9.5e6'", "'0'", "'x'", "'800'"),
    "area_ping": "concat(10 + c_custkey % 40, '.5')",
    "age": "CASE WHEN c_custkey % 29 = 0 THEN '' ELSE concat('', c_custkey % 50) END",
    "floor": "concat('', 1 + c_custkey % 12)",
    "total_floors": "concat('', 3 + c_custkey % 11)",
    "has_parking": "c_custkey % 2 = 0",
    "parking_price": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '500000' END",
    "parking_area_ping": "'2.5'",
}
_FORM_OK = "c_custkey % 23 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 5 NOT IN (2, 3) AND c_custkey % 29 <> 0 AND 1 + c_custkey % 12 <= 3 + c_custkey % 11"


@query(f"""SELECT c_custkey AS id, c_name AS address, CASE c_custkey % 5 WHEN 0 THEN 12000000 WHEN 1 THEN 9500000 ELSE 800 END::DOUBLE AS total_price, 10.5::DOUBLE + c_custkey % 40 AS area_ping, (1 + c_custkey % 12)::DOUBLE AS floor,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 500000 ELSE 0 END::DOUBLE AS parking_price, CASE WHEN c_custkey % 2 = 0 THEN 2.5 ELSE 0 END::DOUBLE AS parking_area_ping FROM customer WHERE {_FORM_OK}""")
def property_form(spark: SparkSession, d: str) -> DataFrame:
    return V.property_form(raw(spark, d, "customer", FORM)).select("id", "address", "total_price", "area_ping", "floor", "parking_price", "parking_area_ping")


@query(f"""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '12000000' WHEN 1 THEN '9500000' ELSE '800' END AS total_price, (10 + c_custkey % 40)::VARCHAR || '.5' AS area_ping, (1 + c_custkey % 12)::VARCHAR AS floor,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN '500000' ELSE '' END AS parking_price, CASE WHEN c_custkey % 2 = 0 THEN '2.5' ELSE '' END AS parking_area_ping FROM customer WHERE {_FORM_OK}""")
def property_draft(spark: SparkSession, d: str) -> DataFrame:
    return V.property_draft(V.property_form(raw(spark, d, "customer", FORM))).select("id", "total_price", "area_ping", "floor", "parking_price", "parking_area_ping")


@query(f"""WITH {R.FACILITIES} SELECT ord::VARCHAR AS raw_id, 'c' || (ord % 2) AS city, '區' || district AS district, trim(name) AS name, substring(sha256('parking|c' || (ord % 2) || '|' || ord), 1, 24) AS id, p_size::INT AS capacity, lon, lat FROM facilities WHERE category = 'parking'""")
def facility_features(spark: SparkSession, d: str) -> DataFrame:
    f = R.facilities(spark, d).where("category = 'parking'").join(R.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), "p_size"), "ord")
    rows = f.withColumns({"city": F.concat(F.lit("c"), (F.col("ord") % 2).cast("string")), "district": F.concat(F.lit("區"), F.col("district").cast("string")), "name": F.concat(F.lit(" "), "name"), "reason": F.lit(None).cast("string")})
    out = P.features(rows, "parking", "ord", {"facilityType": F.lit("offstreet-parking"), "carCapacity": F.col("p_size")})
    p, at = "feature.properties", F.col("feature.geometry.coordinates")
    return out.select("raw_id", "city", "district", "name", F.col(f"{p}.id").alias("id"), F.col(f"{p}.carCapacity").alias("capacity"), at[0].alias("lon"), at[1].alias("lat"))


_RISK = {"risk_type": "CASE ord % 3 WHEN 0 THEN 'liquefaction' ELSE 'flood' END", "scenario": "CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 2 = 0 THEN '6h-150' ELSE '24h-500' END", "name": "CASE WHEN ord % 4 = 1 THEN concat('area ', ord) END"}
_RISKS = "(SELECT ord, district, " + ", ".join(f"{e} AS {n}" for n, e in _RISK.items()) + " FROM (SELECT s_suppkey AS ord, s_suppkey % 5 AS district FROM supplier))"


def risks(spark: SparkSession, d: str) -> DataFrame:
    return R.polygons(spark, d).withColumns({n: F.expr(e) for n, e in _RISK.items()}).withColumn("city", F.col("district") % 2)


@query(f"SELECT ord, risk_type, coalesce(name, CASE risk_type WHEN 'flood' THEN '淹水潛勢' ELSE '土壤液化潛勢' END) AS name, 'official' AS source_type, false AS coverage_confirmed FROM {_RISKS}")
def risk_projection(spark: SparkSession, d: str) -> DataFrame:
    return P.risk_features(risks(spark, d)).select("ord", "risk_type", "name", "source_type", "coverage_confirmed")


_SCENARIOS = "[" + ", ".join(f"'{s}'" for s in S.FLOOD_SCENARIOS) + "]"


@query(f"""WITH k AS (SELECT * FROM {_RISKS}),
f AS (SELECT (r_regionkey % 2) || '/' || r_regionkey || '/risks/' || unnest(list_concat(list_transform({_SCENARIOS}, lambda s: 'flood-' || s), ['liquefaction'])) || '.geojson' AS file FROM region),
n AS (SELECT (district % 2) || '/' || district || '/risks/' || CASE risk_type WHEN 'flood' THEN 'flood-' || scenario ELSE 'liquefaction' END || '.geojson' AS file, count(*) AS n FROM k GROUP BY 1)
SELECT file, coalesce(n, 0)::BIGINT AS n_features FROM f LEFT JOIN n USING (file)""")
def risk_files(spark: SparkSession, d: str) -> DataFrame:
    return P.risk_files(risks(spark, d), R.districts(spark, d), list(S.FLOOD_SCENARIOS))


@query(f"WITH {R.FACILITIES} SELECT district, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) FILTER (category IN ('metro', 'park'))::BIGINT AS n_visible FROM facilities GROUP BY 1")
def facility_categories(spark: SparkSession, d: str) -> DataFrame:
    f = R.facilities(spark, d)
    n = P.visible(f, ["metro", "park"]).groupBy("district").agg(F.count("*").alias("n"))
    return P.categories_present(f, ["district"]).join(n, "district", "left").select("district", F.array_join("categories", ",").alias("categories"), F.coalesce("n", F.lit(0)).alias("n_visible"))


_GAPS = {"actual-price": "價格", "flood": "淹水", "metro": "交通", "bus": "交通", "park": "公園"}
_IDS = "[" + ", ".join(f"'{k}'" for k in _GAPS) + "]"


@query(f"""WITH s AS (SELECT user_id % 50 AS grp, {_IDS}[event_id % 5 + 1] AS id, CASE event_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'stale' WHEN 2 THEN 'failed' ELSE NULL END AS status FROM events),
g AS (SELECT grp, list(DISTINCT CASE id WHEN 'actual-price' THEN '價格' WHEN 'flood' THEN '淹水' WHEN 'park' THEN '公園' ELSE '交通' END) FILTER (status IS NULL OR status = 'failed') AS v FROM s GROUP BY 1)
SELECT grp::BIGINT AS grp, array_to_string(list_filter(['價格', '淹水', '交通', '公園'], lambda x: coalesce(list_contains(v, x), false)), '、') AS gaps FROM g""")
def gap_labels(spark: SparkSession, d: str) -> DataFrame:
    e = R.table(spark, d, "events")
    ident = F.element_at(F.array(*map(F.lit, _GAPS)), (F.col("event_id") % 5 + 1).cast("int"))
    status = F.when(F.col("event_id") % 4 == 0, "official").when(F.col("event_id") % 4 == 1, "stale").when(F.col("event_id") % 4 == 2, "failed")
    rows = e.select((F.col("user_id") % 50).alias("grp"), ident.alias("id"), status.alias("status"))
    return P.distinct_labels(rows, ["grp"], _GAPS).select("grp", F.array_join("gaps", "、").alias("gaps"))


@query(r"""WITH c AS (SELECT c_custkey, c_acctbal * 1000 AS v FROM customer), s AS (SELECT *, CASE WHEN v < 0 THEN '-' ELSE '' END AS sign, abs(v) AS a FROM c),
k AS (SELECT *, CASE WHEN a >= 9999.5 THEN 10000 ELSE 1 END AS unit FROM s), t AS (SELECT *, floor(a / unit * 10 + 0.5) / 10 AS q FROM k)
SELECT c_custkey, CASE WHEN floor(a + 0.5) > 0 THEN sign ELSE '' END || '$' || format('{:,}', floor(a + 0.5)::BIGINT) AS full_text,
 sign || '$' || regexp_replace(format('{:,.1f}', q), '\.0$', '') || CASE WHEN unit = 10000 THEN '萬' ELSE '' END AS short_text, format('{:.1f}', floor(v / 1e6 * 10 + 0.5) / 10) || '%' AS percent FROM t""")
def money_texts(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("c_acctbal") * 1000
    return R.table(spark, d, "customer").select("c_custkey", P.currency_text(v).alias("full_text"), P.compact_currency_text(v).alias("short_text"), P.percent_text(v / 1e6).alias("percent"))


# ---- gates -------------------------------------------------------------------------------------------------

SAMPLE = {
    "id": "concat('', event_id)",
    "city": _pick("event_id", "'taipei'", "'new-taipei'"),
    "source": _pick("user_id", "'flood'", "'liquefaction'"),
    "result": "CASE WHEN event_id % 7 = 0 THEN 'mismatch' ELSE 'matched' END",
    "case_type": _pick("user_id", "'red'", "'high'", "'yellow'", "'medium'", "'unknown'", "'low'", "'red'", "'uncovered'"),
    "expected_category": "concat('k', user_id % 3)",
    "observed_category": "CASE WHEN event_id % 11 = 0 THEN 'other' ELSE concat('k', user_id % 3) END",
    "verification_method": _pick("event_id", "'official-map'", "'official-raw-offline'", "'guess'"),
    "latitude": "CAST(25 AS DOUBLE) + CAST(0.5 AS DOUBLE)",
    "longitude": "CASE WHEN event_id % 13 = 0 THEN CAST(121.123456 AS DOUBLE) ELSE CAST(121.5 AS DOUBLE) END",
}
_FINE = f"fine AS (SELECT DISTINCT city, id, source, case_type, expected_category FROM ({raw_sql('events', SAMPLE)}) WHERE result = 'matched' AND observed_category = expected_category AND verification_method <> 'guess' AND longitude = 121.5)"


@query(f"""WITH {_FINE}, c AS (SELECT unnest(['flood', 'liquefaction']) AS source), cities AS (SELECT unnest(['taipei', 'new-taipei']) AS city),
n AS (SELECT source, city, count(*) AS n, CASE source WHEN 'flood' THEN count(DISTINCT expected_category) FILTER (case_type = 'red') >= 2 AND count(*) FILTER (case_type = 'yellow') >= 2 AND bool_or(case_type = 'unknown')
  ELSE bool_or(case_type = 'high') AND bool_or(case_type = 'medium') AND bool_or(case_type = 'low') AND bool_or(case_type = 'uncovered') END AS ok FROM fine GROUP BY source, city)
SELECT source, city, coalesce(n, 0)::BIGINT AS n, coalesce(n >= 5 AND ok, false) AS passed FROM c CROSS JOIN cities LEFT JOIN n USING (source, city)""")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    samples = raw(spark, d, "events", SAMPLE)
    one = lambda source: E.risk_coverage(samples, source).withColumn("source", F.lit(source))
    return one("flood").unionByName(one("liquefaction"))


_A, _B, _C = "a" * 64, "b" * 64, "c" * 64
EVIDENCE = {
    "id": "event_id",
    "source": _pick("user_id", "'school'", "'park'", "'rail'"),
    "city": _pick("event_id", "'taipei'", "'new-taipei'"),
    "source_sha256": f"CASE WHEN event_id % 17 = 0 THEN NULL ELSE '{_A}' END",
    "query_output_sha256": f"CASE WHEN event_id % 19 = 0 THEN 'XYZ' ELSE '{_C}' END",
    "location_method": _pick("event_id", "'address'", "'ntpc-landmark-exact'", "CAST(NULL AS VARCHAR(9))"),
    "landmark_sha256": f"CASE WHEN event_id % 5 = 0 THEN '{_B}' END",
    "address_index_sha256": f"CASE WHEN event_id % 4 = 0 THEN '{_A}' WHEN event_id % 4 = 1 THEN '{_B}' END",
}


@query(f"""WITH s AS ({raw_sql('events', EVIDENCE)}), b AS (SELECT *, coalesce(source_sha256 = '{_A}', false) AND query_output_sha256 <> 'XYZ' AS same, coalesce(location_method = 'ntpc-landmark-exact', false) AS lm, coalesce(landmark_sha256 = '{_B}', false) AS lh,
  coalesce(address_index_sha256 = CASE city WHEN 'taipei' THEN '{_A}' ELSE '{_B}' END, false) AS ix FROM s)
SELECT id, source FROM b WHERE NOT (same AND CASE source WHEN 'rail' THEN true WHEN 'school' THEN ix AND (NOT lm OR lh) ELSE city = 'taipei' OR ix OR (lm AND lh) END)""")
def evidence_binding(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "events", EVIDENCE)
    one = lambda source: E.unbound_evidence(rows, source, _A, {"taipei": _A, "new-taipei": _B}, _B).select("id", "source")
    return one("school").unionByName(one("park")).unionByName(one("rail"))


ENTRY = {
    "result": _pick("event_id", "'matched'", "'mismatch'", "'inconclusive'", "'other'"),
    "attempts": "CAST(user_id % 3 AS INT)",
    "observed": _pick("user_id", "'x'", "'y'", "''"),
    "expected_category": "'x'",
    "boundary_distance": "CAST(user_id % 60 AS DOUBLE)",
    "verification_method": _pick("event_id", "CAST(NULL AS VARCHAR(9))", "'official-map'", "'guess'", "'official-map'", "'official-map'"),
    "k": "CAST(event_id % 5 AS INT)",
}


@query(f"""WITH e AS ({raw_sql('events', ENTRY)}), x AS (SELECT CASE WHEN result = 'other' THEN 'unknownResult' WHEN result = 'inconclusive' THEN CASE WHEN attempts < 2 THEN 'tooFewAttempts' END
  WHEN result = 'mismatch' AND k IN (0, 4) THEN 'mismatchWithoutFields' WHEN k = 2 THEN 'unknownField' WHEN result = 'matched' AND k NOT IN (0, 4) THEN 'matchedWithFields' END AS price_error,
 CASE WHEN result IN ('other', 'inconclusive') THEN 'unknownResult' WHEN observed = '' THEN 'nothingObserved' WHEN boundary_distance < 20 THEN 'nearBoundary' WHEN result = 'matched' AND observed <> 'x' THEN 'observedDiffers'
  WHEN result = 'mismatch' AND observed = 'x' THEN 'observedEqual' WHEN verification_method = 'guess' THEN 'unknownVerification' END AS risk_error FROM e)
SELECT price_error, risk_error, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def audit_entry_errors(spark: SparkSession, d: str) -> DataFrame:
    fields = F.expr("CASE k WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('date') WHEN 2 THEN array('date', 'colour') WHEN 3 THEN array('floor', 'area') END")
    rows = raw(spark, d, "events", ENTRY).withColumn("mismatch_fields", fields)
    return rows.groupBy(E.price_record_error().alias("price_error"), E.risk_record_error().alias("risk_error")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id % 4 AS source, event_id % 997 AS id, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT s_suppkey % 4 AS source, s_suppkey % 50 AS id, s_suppkey FROM supplier) SELECT s_suppkey, event_id FROM s JOIN c USING (source, id) WHERE n = 1""")
def audit_candidate_lookup(spark: SparkSession, d: str) -> DataFrame:
    samples = R.table(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("source"), (F.col("s_suppkey") % 50).alias("id"), "s_suppkey")
    candidates = R.table(spark, d, "events").select((F.col("user_id") % 4).alias("source"), (F.col("event_id") % 997).alias("id"), "event_id")
    return E.candidates_of(samples, candidates).select("s_suppkey", "candidate.event_id")


READY = {
    "source_id": _pick("c_custkey", "'market'", "'park'", "'rail'"),
    "id": "CASE WHEN c_custkey % 17 = 0 THEN 'other' WHEN c_custkey % 3 = 0 THEN 'market' WHEN c_custkey % 3 = 1 THEN 'park' ELSE 'rail' END",
    "status": _pick("c_custkey", "'blocked'", "'ready'"),
    "checked_at": "'2026-01-01'",
    "adapter_version": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'v1' END",
    "rate_taipei": "CAST(1 AS DOUBLE)",
    "rate_new_taipei": "CASE WHEN c_custkey % 13 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END",
    "rate_overall": "CAST(0.75 AS DOUBLE)",
    "blocked_reason": "CASE WHEN c_custkey % 4 = 0 THEN 'low' END",
    "count": "CASE WHEN c_custkey % 11 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END",
    "extra": "c_custkey % 19 = 0",
}


@query(f"""WITH r AS ({raw_sql('customer', READY)}) SELECT CASE WHEN source_id = 'rail' THEN 'unknownSource' WHEN extra THEN 'unknownField' WHEN id <> source_id OR adapter_version IS NULL THEN 'invalidField' WHEN status = 'blocked' AND blocked_reason IS NULL THEN 'blockedWithoutReason'
  WHEN status = 'ready' AND blocked_reason IS NOT NULL THEN 'readyWithReason' WHEN rate_new_taipei > 1 THEN 'invalidRate' WHEN "count" = 1.5 THEN 'invalidCount' END AS error, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def readiness_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "customer", READY)
    keys = F.when(F.col("extra"), F.array(F.lit("id"), F.lit("owner"))).otherwise(F.array(F.lit("id"), F.lit("status")))
    rows = rows.withColumns({"excluded": F.create_map(F.lit("invalid"), F.col("count")), "location_methods": F.create_map(F.lit("address"), F.lit(3.0)), "keys": keys})
    return rows.groupBy(E.readiness_error().alias("error")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS source FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0")
def stale_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"))
    made = s.select("source", F.when(F.col("source") % 5 == 0, "r1").otherwise("r2").alias("generated_at"), F.concat(F.lit("h"), "source").alias("dataset_sha256"))
    held = s.where("source % 7 <> 0").select("source", F.when(F.col("source") % 11 == 0, "other").otherwise(F.concat(F.lit("h"), "source")).alias("dataset_sha256"))
    return E.stale_candidates(made, F.lit("r2"), held).select("source")


FEATURE = {
    "file": _pick("p_partkey", "'t/d/facilities/x.geojson'", "'t/d/accidents/2023.json'", "'t/d/risks/flood.geojson'", "'t/d/boundary.geojson'"),
    "has_geometry": "p_partkey % 43 <> 0",
    "lon": "CASE WHEN p_partkey % 47 = 0 THEN CAST(120 AS DOUBLE) ELSE CAST(121.5 AS DOUBLE) END",
    "lat": "CAST(25 AS DOUBLE)",
    "category": _pick("p_size", "'park'", "'library'", "'market'", "'school'", "'metro'"),
    "kind": _pick("p_size", "'park'", "'public-library'", "'traditional-market'"),
    "severity": _pick("p_size", "'A1'", "'A2'", "'A3'", "'A1'"),
    "level": _pick("p_size", "'low'", "'priority'", "'severe'"),
    "phone": "p_partkey % 20 = 0",
}


@query(f"""WITH f AS ({raw_sql('part', FEATURE)}) SELECT CASE WHEN NOT has_geometry OR lon = 120 THEN 'invalidGeometry' WHEN contains(file, '/accidents/') THEN CASE WHEN severity = 'A3' THEN 'invalidAccident' END
 WHEN contains(file, '/risks/') THEN CASE WHEN level = 'severe' THEN 'invalidRisk' END WHEN NOT contains(file, '/facilities/') THEN NULL WHEN phone THEN 'forbiddenField' WHEN category = 'school' THEN 'invalidSchool'
 WHEN category = 'park' AND kind <> 'park' THEN 'invalidPark' WHEN category = 'library' AND kind <> 'public-library' THEN 'invalidLibrary' WHEN category = 'market' AND kind <> 'traditional-market' THEN 'invalidMarket' END AS error, count(*)::BIGINT AS n FROM f GROUP BY 1""")
def published_feature_errors(spark: SparkSession, d: str) -> DataFrame:
    def pairs(**values):
        return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))))

    c = F.col
    facility = pairs(id="i", name="n", category=c("category"), facilityType=c("kind"), parkType=c("kind"), marketOwnership="public", schoolLevels="[]")
    facility = F.when(c("phone"), F.map_concat(facility, pairs(phone="02"))).otherwise(facility)
    accident = pairs(id="i", date="2023-05-06", year="2023", severity=c("severity"))
    risk = pairs(riskType="flood", level=c("level"), officialCategory="0.5-1.0")
    held = F.when(F.contains("file", F.lit("accidents")), accident).when(F.contains("file", F.lit("risks")), risk).otherwise(facility)
    return raw(spark, d, "part", FEATURE).withColumn("properties", held).groupBy(E.feature_error().alias("error")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT ['flood', 'rail', 'school', 'other'][p_partkey % 4 + 1] AS source, 'f' || p_partkey AS file, p_partkey FROM part), n AS (SELECT source, count(*) AS n FROM l GROUP BY 1)
SELECT source, file, CASE WHEN p_partkey % 29 = 0 THEN 'missing' ELSE 'tooLarge' END AS error FROM l WHERE p_partkey % 29 = 0 OR p_partkey % 31 = 0 UNION ALL SELECT source, NULL, 'fileCount' FROM n WHERE n <> CASE source WHEN 'flood' THEN 50 WHEN 'rail' THEN 41 WHEN 'school' THEN 41 ELSE n END""")
def published_file_errors(spark: SparkSession, d: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("flood", "rail", "school", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    listed = R.table(spark, d, "part").select(source.alias("source"), F.concat(F.lit("f"), "p_partkey").alias("file"), "p_partkey")
    present = listed.where("p_partkey % 29 <> 0").select("file", F.when(F.col("p_partkey") % 31 == 0, 6_000_000).otherwise(1000).alias("bytes"))
    return E.file_errors(listed.drop("p_partkey"), present, E.FILE_COUNTS | {"flood": 50})


@query("SELECT n_nationkey, 'missing' AS error FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 100 + n_nationkey, 'unknown' FROM nation WHERE n_nationkey % 8 = 1")
def uncovered_districts(spark: SparkSession, d: str) -> DataFrame:
    n = R.table(spark, d, "nation").select("n_nationkey")
    listed = n.where("n_nationkey % 6 <> 0").unionByName(n.where("n_nationkey % 8 = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey")))
    return E.uncovered_districts(listed, n, "n_nationkey")
