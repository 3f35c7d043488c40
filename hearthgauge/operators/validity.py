"""Which raw records of a source are usable, and the reason for each that is not. Column expressions only.

Field names are those of the published files. A record's first failing rule names its reason; null means usable.
Texts that need NFKC are expected in that form (names.nfkc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, names, scalars as S
from .lookup import label_in_text
from .quality import GateError, cascade

# Fixed values
SALE_TARGET, DWELLING = "房地(土地+建物)", "住家用"
SCHOOL_YEAR = 114
SCHOOL_LANDMARKS = ("國民小學", "國民中學", "高中職", "完全中學", "教育研究機構")
PARK_LANDMARKS = "公園|綠地|廣場"
TRADITIONAL, OTHER_MARKETS = ("早", "午市", "黃昏", "公有市場"), ("超市", "批發", "夜市")
DESCRIPTIVE_PLACE = "地號|路口|橋下|旁|對面|斜對面|周邊|前(?:[0-9]+公尺)?|巷內|巷底"
NUMERALS = "0-9零〇一二兩三四五六七八九十"
CITY_LABELS = {"taipei": ("臺北市", "台北市"), "new-taipei": ("新北市",)}


def text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def number(name: str) -> Column:
    """A field as ECMAScript reads it: blank is 0, what is no number is null."""
    return S.js_number(text(name))


def filled(value: Column) -> Column:
    return S.strip(F.coalesce(value, F.lit(""))) != ""


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def sales(rows: DataFrame, districts: list[str], since: Column) -> DataFrame:
    """Sales of known districts (others go uncounted) with district_label, building_type, date, total_price, area_ping,
    age and reason. `rows` has the raw fields beside match_status, lat and lon of the address lookup."""
    sold, built = S.roc_date(text("交易年月日")), S.roc_date(text("建築完成年月"))
    parsed = rows.withColumn("district_label", S.strip(text("鄉鎮市區"))).where(F.col("district_label").isin(*districts)).withColumns({
        "building_type": S.building_type(text("建物型態")),
        "date": sold,
        "total_price": number("總價元"),
        "area_ping": S.sqm_to_ping(number("建物移轉總面積平方公尺")),
        "age": F.when(built.isNotNull(), S.age_years(sold, built)),
    })
    c = F.col
    return parsed.withColumn("reason", cascade([
        ("nonResidentialTarget", ~F.startswith(text("交易標的"), F.lit(SALE_TARGET))),
        ("unsupportedBuilding", c("building_type").isNull() | ~F.contains(text("主要用途"), F.lit(DWELLING))),
        ("outsideWindow", c("date").isNull() | (c("date") < since)),
        ("invalidCoreFields", ~sure((c("total_price") > 0) & (c("area_ping") > 0) & (c("age") <= 200))),
        ("ambiguousAddress", c("match_status") == "ambiguous"),
        ("unmatchedAddress", ~sure(c("match_status") == "matched")),
        ("outOfBounds", ~S.in_study_area(c("lat"), c("lon"))),
    ]))


def accidents(rows: DataFrame) -> DataFrame:
    """Accident records with date, severity, lat, lon (6 places), id and reason; `rows` has expected_year and expected_severity."""
    clean = lambda name: S.strip(F.regexp_replace(text(name), f"{S.WHITE}+", " "))
    year, lon, lat = F.col("expected_year"), S.half_up(number("經度"), 6), S.half_up(number("緯度"), 6)
    date, severity = S.western_date(text("發生日期"), year), F.upper(clean("事故類別名稱"))
    reason = cascade([
        ("invalidDate", ~sure(number("發生年度") == year) | date.isNull()),
        ("invalidSeverity", ~severity.isin("A1", "A2") | (severity != F.col("expected_severity"))),
        ("invalidCoordinate", ~sure(number("經度").between(118, 123) & number("緯度").between(20, 27))),
    ])
    ident = S.stable_id(year, date, clean("發生時間"), severity, clean("處理單位名稱警局層"), clean("發生地點"), F.format_string("%.6f", lon), F.format_string("%.6f", lat))
    return rows.withColumns({"date": date, "severity": severity, "lat": lat, "lon": lon, "reason": reason}).withColumn("id", F.when(F.col("reason").isNull(), ident))


def parking(rows: DataFrame, districts: list[str]) -> DataFrame:
    """Car parks with lon, lat, capacity and reason. Field names differ between cities in case only."""
    lon, lat = geo.twd97_to_wgs84(number("tw97x"), number("tw97y"))
    capacity = number("totalcar")
    core = filled(text("id")) & filled(text("name")) & S.strip(text("area")).isin(*districts) & sure(capacity > 0) & lon.isNotNull() & lat.isNotNull()
    return rows.withColumns({"lon": lon, "lat": lat, "capacity": F.floor(capacity).cast("int"), "reason": F.when(~core, "invalidCoreFields")})


def several_addresses(address: Column) -> Column:
    """Whether an NFKC address names more than one place: two house numbers, numbers with a separator, or a further road."""
    first = F.when(F.contains(address, F.lit("號")), F.concat(F.substring_index(address, "號", 1), F.lit("號"))).otherwise("")
    return (F.regexp_count(address, F.lit("號")) > 1) | first.rlike(f"[{NUMERALS}][、．.,，][{NUMERALS}]") | address.rlike("號及.*(?:路|街|大道)")


def hospitals(rows: DataFrame, districts: list[str]) -> DataFrame:
    core = filled(text("hosp_id")) & filled(text("hosp_name")) & S.strip(text("area")).isin(*districts)
    return rows.withColumn("reason", cascade([("invalidCoreFields", ~core), ("multipleAddress", several_addresses(text("hosp_addr")))]))


def city_of(label: Column) -> Column:
    """The city that a label names; null for any other."""
    return F.coalesce(*(F.when(F.contains(label, F.lit(x)), F.lit(city)) for city, labels in CITY_LABELS.items() for x in labels))


def latest_school_year(rows: DataFrame, expected: int = SCHOOL_YEAR) -> DataFrame:
    """Rows of the latest school year, those without one included; GateError if that is not the expected one."""
    year = number("學年度")
    latest = rows.agg(F.max(F.when(filled(text("學年度")) & (year == F.floor(year)), year)).alias("y")).first()["y"]
    if latest is not None and int(latest) != expected:
        raise GateError(f"the latest school year is {int(latest)}, not {expected}")
    return rows.where(~filled(text("學年度")) | (year == expected))


def school_address(address: Column, district: Column) -> Column:
    """An NFKC address without its village and neighbourhood, and one letter put right."""
    village = F.regexp_replace(address, F.concat(F.lit("^(.*?)"), district, F.lit("[^路街大道]{1,8}里(?:[0-9]+鄰)?")), F.concat(F.lit("$1"), district))
    return F.translate(F.regexp_replace(F.coalesce(village, address), "[0-9]+鄰", ""), "褔", "福")


def schools(rows: DataFrame, districts: list[str]) -> DataFrame:
    """Schools of the two cities (others go uncounted) with city, district, address, simple_address and reason."""
    address = F.regexp_replace(text("地址"), "^\\[[^\\]]+\\]", "")
    own = rows.withColumn("city", city_of(text("縣市名稱"))).where("city IS NOT NULL").withColumn("address", address).withColumn("district", label_in_text(F.col("address"), districts))
    core = F.col("district").isNotNull() & filled(text("學校名稱")) & F.contains("address", F.lit("號"))
    return own.withColumns({"simple_address": school_address(F.col("address"), F.col("district")), "reason": F.when(~core, "invalidCoreFields")})


def parks(rows: DataFrame, districts: list[str]) -> DataFrame:
    """Parks with address, district and reason; a place that is only described is none."""
    address = F.regexp_replace(text("address"), "^板橋市", "")
    district = label_in_text(F.concat(text("area"), text("address")), districts)
    core = filled(text("seqno")) & filled(text("name")) & district.isNotNull() & F.contains(address, F.lit("號")) & ~address.rlike(DESCRIPTIVE_PLACE)
    return rows.withColumns({"place": address, "district": district, "reason": F.when(~core, "invalidCoreFields")})


def landmark_use(kind: Column) -> Column:
    """What a landmark of a type can locate: school, park or nothing (null)."""
    return F.when(S.strip(kind).isin(*SCHOOL_LANDMARKS), "school").when(kind.rlike(PARK_LANDMARKS), "park")


def is_traditional_market(kind: Column) -> Column:
    any_of = lambda labels: F.greatest(*(F.contains(kind, F.lit(x)) for x in labels))
    return any_of(TRADITIONAL) & ~any_of(OTHER_MARKETS)


def first_valid(rows: DataFrame, ident: str, order: str, invalid: Column) -> DataFrame:
    """`rows` with reason: blankId, duplicate (after the first valid row of an id in `order`) or invalidOrUnassigned."""
    marked = rows.withColumn("__invalid", sure(invalid))
    first = marked.where(~F.col("__invalid") & filled(F.col(ident))).groupBy(ident).agg(F.min(order).alias("__first"))
    joined = marked.join(first, ident, "left")
    reason = cascade([("blankId", ~filled(F.col(ident))), ("duplicate", sure(F.col(order) > F.col("__first"))), ("invalidOrUnassigned", F.col("__invalid"))])
    return joined.withColumn("reason", reason).drop("__invalid", "__first")


def metro(rows: DataFrame, districts: list[str], order: str) -> DataFrame:
    """Metro stations with id, name, district, lon, lat and reason."""
    quote = lambda name: F.regexp_replace(text(name), "^'", "")
    pattern = f"([0-9.]+){S.WHITE}*,{S.WHITE}*([0-9.]+)"
    lon, lat = (F.regexp_extract(text("StationPosition"), pattern, k).try_cast("double") for k in (1, 2))
    own = rows.withColumns({"id": quote("StationID"), "district": label_in_text(quote("StationAddress"), districts), "lon": lon, "lat": lat})
    named = own.withColumn("name", F.coalesce(F.nullif(names.metro_name(text("StationName")), F.lit("")), F.col("id")))
    return first_valid(named, "id", order, F.col("district").isNull() | ~S.in_study_area(F.col("lat"), F.col("lon")))


def bus(rows: DataFrame, districts: list[str], order: str) -> DataFrame:
    """Bus stops with id, district, lon, lat and reason; the shown coordinate comes before the other."""
    shown = lambda a, b: F.when(text(a) != "", number(a)).otherwise(number(b))
    own = rows.withColumns({"id": text("stoplocationid"), "district": label_in_text(text("address"), districts), "lon": shown("showlon", "longitude"), "lat": shown("showlat", "latitude")})
    return first_valid(own, "id", order, F.col("district").isNull() | ~S.in_study_area(F.col("lat"), F.col("lon")))


def duplicate_stop_ratio(stops: DataFrame) -> DataFrame:
    """One row: n, accepted, invalid, the share of neither, and whether that is from 0 to 0.99. No rows: a share of 0."""
    own = stops.agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason") == "invalidOrUnassigned").alias("invalid"))
    ratio = F.when(F.col("n") > 0, (F.col("n") - F.col("accepted") - F.col("invalid")) / F.col("n")).otherwise(F.lit(0.0))
    return own.withColumn("duplicate_ratio", ratio).withColumn("passed", F.col("duplicate_ratio").between(0, 0.99))


def rail(rows: DataFrame, districts: list[str]) -> DataFrame:
    """Rail stations with name, district, lon, lat and reason: invalid, or elsewhere where the address is in neither city.
    `rows` has in_district: whether the point lies in its district's boundary, or close to it."""
    lat, lon = names.lat_lon(text("gps"))
    own = rows.withColumns({"name": names.rail_name(text("stationName")), "district": label_in_text(text("stationAddrTw"), districts), "lat": lat, "lon": lon})
    core = filled(text("stationCode")) & filled(F.col("name")) & F.col("district").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & sure(F.col("in_district"))
    return own.withColumn("reason", F.when(~core, F.when(city_of(text("stationAddrTw")).isNotNull(), "invalid").otherwise("elsewhere")))


def property_form(forms: DataFrame) -> DataFrame:
    """Typed properties of form rows (texts) that are complete: an address that was confirmed, positive price, area,
    floors, an age, and a floor not above the top."""
    positive = lambda name: filled(text(name)) & sure(number(name) > 0)
    fine = filled(text("address")) & sure(F.col("location_confirmed")) & positive("total_price") & positive("area_ping") & filled(text("age")) & sure(number("age") >= 0)
    fine = fine & positive("floor") & positive("total_floors") & sure(number("floor") <= number("total_floors"))
    extra = lambda name: F.when(sure(F.col("has_parking")) & (text(name) != ""), number(name)).otherwise(F.lit(0.0))
    typed = {name: number(name) for name in ("total_price", "area_ping", "age", "floor", "total_floors")}
    return forms.where(fine).withColumns({"address": S.strip(text("address")), **typed, "parking_price": extra("parking_price"), "parking_area_ping": extra("parking_area_ping")})


def property_draft(properties: DataFrame) -> DataFrame:
    """Properties as form rows again: numbers as texts, no parking as blank ones, the place confirmed."""
    as_text = lambda name: S.number_text(F.col(name).cast("double"))
    blank = lambda name: F.when(F.coalesce(F.col(name), F.lit(0.0)) != 0, as_text(name)).otherwise("")
    numbers = {name: as_text(name) for name in ("total_price", "area_ping", "age", "floor", "total_floors")}
    return properties.withColumns({**numbers, "parking_price": blank("parking_price"), "parking_area_ping": blank("parking_area_ping"), "location_confirmed": F.lit(True)})
