"""Usable records in the published schemas, and how numbers are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from .validity import number, text

# Fixed values
RISK_NAMES = {"flood": "淹水潛勢", "liquefaction": "土壤液化潛勢"}


def _sale_id() -> Column:
    return S.stable_id(text("編號"), F.col("date"), F.col("district_label"), F.col("address"), S.number_text(F.col("total_price")), text("建物移轉總面積平方公尺"), text("移轉層次"))


def transactions(sales: DataFrame) -> DataFrame:
    """Matched sales (see validity.sales; address: its normal form) as published."""
    own = sales.where("reason IS NULL")
    price, area = F.greatest(F.lit(0.0), F.coalesce(number("車位總價元"), F.lit(0.0))), S.sqm_to_ping(number("車位移轉總面積平方公尺"))
    c = F.col
    return own.withColumns({"parking_price": price, "parking_area_ping": area}).select(
        _sale_id().alias("id"), "date", c("lat").alias("latitude"), c("lon").alias("longitude"), "total_price", "area_ping", "age", "building_type",
        S.floor_number(text("移轉層次")).alias("floor"), S.special_transaction(text("備註")).alias("special_transaction"), "parking_price", "parking_area_ping",
        ((c("parking_price") > 0) & (c("parking_area_ping") <= 0)).alias("unit_price_approximate"),
        S.unit_price(c("total_price"), c("area_ping"), c("parking_price"), c("parking_area_ping")).alias("unit_price"),
    )


def audit_records(sales: DataFrame, city: str) -> DataFrame:
    """Matched sales as auditors compare them with the register: square metres, and the address."""
    price = F.greatest(F.lit(0.0), F.coalesce(number("車位總價元"), F.lit(0.0)))
    return sales.where("reason IS NULL").select(
        _sale_id().alias("id"), F.lit(city).alias("city"), "district_label", "address", "date", "total_price", number("建物移轉總面積平方公尺").alias("area_square_meters"), "building_type",
        price.alias("parking_price"), F.coalesce(number("車位移轉總面積平方公尺"), F.lit(0.0)).alias("parking_area_square_meters"), text("移轉層次").alias("floor"),
    )


def features(rows: DataFrame, source: str, raw_id: str, properties: dict[str, Column]) -> DataFrame:
    """Usable points as features: raw_id, city, district, name, and feature (properties, geometry as lon and lat).

    A feature's id comes from the source, the city and the record's own id; `properties` are a source's further ones,
    such as facilityType, carCapacity, schoolLevels, parkType or marketOwnership.
    """
    own = rows.where("reason IS NULL")
    name, raw = S.strip(text("name")), text(raw_id)
    held = F.struct(S.stable_id(F.lit(source), F.col("city"), raw).alias("id"), name.alias("name"), F.lit(source).alias("category"), *(v.alias(k) for k, v in properties.items()))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return own.select(raw.alias("raw_id"), "city", "district", name.alias("name"), F.struct(F.lit("Feature").alias("type"), held.alias("properties"), geometry.alias("geometry")).alias("feature"))


def risk_features(rows: DataFrame) -> DataFrame:
    """Risk polygons with name, source_type and coverage_confirmed, as given or else by default; without a shape none."""
    given = lambda column, default: F.coalesce(F.col(column), default) if column in rows.columns else default
    name = F.when(F.col("risk_type") == "flood", RISK_NAMES["flood"]).otherwise(RISK_NAMES["liquefaction"])
    defaults = {"name": name, "source_type": F.lit("official"), "coverage_confirmed": F.lit(False)}
    return rows.where("rings IS NOT NULL").withColumns({k: given(k, v) for k, v in defaults.items()})


def risk_files(risks: DataFrame, districts: DataFrame, scenarios: list[str]) -> DataFrame:
    """(file, n_features) of every published risk file, empty ones too: each district's flood file by scenario, and its
    liquefaction file. `risks`: city, district, risk_type, scenario (null for liquefaction)."""
    folder = F.concat_ws("/", F.col("city").cast("string"), F.col("district").cast("string"), F.lit("risks"))
    flood = districts.withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios)))).select(F.concat(folder, F.lit("/flood-"), "scenario", F.lit(".geojson")).alias("file"))
    every = flood.unionByName(districts.select(F.concat(folder, F.lit("/liquefaction.geojson")).alias("file")))
    kind = F.when(F.col("risk_type") == "flood", F.concat(F.lit("flood-"), "scenario")).otherwise("liquefaction")
    held = risks.groupBy(F.concat(folder, F.lit("/"), kind, F.lit(".geojson")).alias("file")).agg(F.count("*").alias("n"))
    return every.join(held, "file", "left").select("file", F.coalesce("n", F.lit(0)).cast("long").alias("n_features"))


def categories_present(facilities: DataFrame, group: list[str]) -> DataFrame:
    """Distinct categories of each group, in order."""
    return facilities.groupBy(*group).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def visible(facilities: DataFrame, categories: list[str]) -> DataFrame:
    """The points of the layers that are switched on."""
    return facilities.where(F.col("category").isin(*categories))


def distinct_labels(sources: DataFrame, group: list[str], labels: dict[str, str]) -> DataFrame:
    """Per group of source rows (id, status): the labels of unavailable ones, each once, in the order of `labels`."""
    order = list(dict.fromkeys(labels.values()))
    label = F.coalesce(*(F.when(F.col("id") == k, F.lit(v)) for k, v in labels.items()))
    gone = ~F.coalesce(F.col("status").isin("official", "stale"), F.lit(False))
    held = sources.groupBy(*group).agg(F.collect_set(F.when(gone, label)).alias("__v"))
    return held.withColumn("gaps", F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains("__v", x))).drop("__v")


def currency_text(value: Column) -> Column:
    """Whole dollars with separators, halves away from zero."""
    whole = F.floor(F.abs(value) + 0.5)
    return F.concat(F.when((value < 0) & (whole > 0), "-").otherwise(""), F.lit("$"), F.format_number(whole, 0))


def compact_currency_text(value: Column) -> Column:
    """Dollars in units of ten thousand or a hundred million, with one place where it isn't zero."""
    size = F.abs(value)
    short = lambda unit: F.regexp_replace(F.format_number(S.half_up(size / unit, 1), 1), "\\.0$", "")
    amount = F.when(size >= 99_999_500, F.concat(short(100_000_000), F.lit("億"))).when(size >= 9_999.5, F.concat(short(10_000), F.lit("萬"))).otherwise(short(1))
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), amount)


def percent_text(value: Column) -> Column:
    """One place and a sign of per cent; no value is not enough data."""
    return F.when(value.isNull(), "資料不足").otherwise(F.concat(F.format_string("%.1f", S.half_up(value, 1)), F.lit("%")))
