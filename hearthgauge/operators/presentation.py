"""Results and source states as the texts that are shown: comparison table, overview of what is known, states of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import distance_text
from .analysis import LIFE
from .projections import currency_text, percent_text

# Fixed values
STATUS_LABELS = {"official": "正式資料", "stale": "資料過期", "failed": "最近更新失敗", "unavailable": "尚未接入"}
LEVEL_LABELS = {"low": "目前未發現顯著異常", "attention": "建議進一步確認", "priority": "優先查證", "unknown": "資料不足或無法判定"}
QUALITY_LABELS = {"official": "全部正式", "mixed": "混合來源"}
MISSING, OLD_SNAPSHOT, NO_GAP = "資料不足", "舊快照，請重新查詢", "無"
#: The rows of life facilities: label, unit of the count, and the kind whose legacy flag hides them.
LIFE_ROWS = {
    "medical": ("醫院", "間", "life"),
    "parking": ("路外停車場", "處", "life"),
    "school": ("學校", "處校園", "community"),
    "park": ("公園綠地", "處", "community"),
    "market": ("傳統零售市場", "處", "market"),
    "library": ("公共圖書館", "間", "library"),
}


def _label(key: Column, labels: dict[str, str], other: str) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in labels.items()), F.lit(other))


def usable(status: Column) -> Column:
    """Whether a source's state lets its values be shown."""
    return F.coalesce(status.isin("official", "stale"), F.lit(False))


def status_text(status: Column, audit: Column | None = None, done: Column | None = None, needed: Column | None = None) -> Column:
    """A source's state as shown; of an unavailable one, how far its manual audit (passed, pending or another word) is.

    No state counts as unavailable, no audit says nothing, and no number of samples needed leaves the count out.
    """
    state = F.coalesce(status, F.lit("unavailable"))
    plain = _label(state, STATUS_LABELS, STATUS_LABELS["unavailable"])
    if audit is None:
        return plain
    counted = F.coalesce(needed, F.lit(0)) > 0
    of = F.concat(F.coalesce(done, F.lit(0)).cast("string"), F.lit("/"), needed.cast("string"))
    passed = F.when(counted, F.concat(F.lit("人工驗收通過 "), of, F.lit("，等待正式發布"))).otherwise("人工驗收通過，等待正式發布")
    pending = F.when(counted, F.concat(F.lit("等待人工驗收 "), of)).otherwise("等待人工驗收")
    held = (state == "unavailable") & audit.isNotNull()
    return F.when(held & (audit == "passed"), passed).when(held & (audit == "pending"), pending).otherwise(plain)


def record_count_text(status: Column, count: Column) -> Column:
    """A source's number of records with separators, where the source is usable."""
    return F.when(usable(status), F.format_number(count, 0)).otherwise(MISSING)


def known_hazards(flood: Column, liquefaction: Column) -> Column:
    """How many of the two hazard levels are known."""
    return sum(((level != "unknown").cast("int") for level in (flood, liquefaction)), F.lit(0))


def _facility(kind: str) -> Column:
    name, unit, snapshot = LIFE_ROWS[kind]
    own = F.col("facilities")[kind]
    text = F.concat(F.format_number(own["count"], 0), F.lit(f" {unit}；最近 "), F.coalesce(own["name"], F.lit(MISSING)), F.lit("（"), distance_text(own["distance"]), F.lit("）"))
    return F.when(F.col(f"legacy_{snapshot}"), OLD_SNAPSHOT).when(~usable(F.col("sources")[kind]), MISSING).otherwise(text)


def comparison_texts() -> dict[str, Column]:
    """The rows of the comparison of saved results, in order; see `comparison_table` for the columns they read."""
    c = F.col
    source = lambda ident: usable(c("sources")[ident])
    number = lambda flags: sum((f.cast("int") for f in flags), F.lit(0)).cast("string")
    samples = c("sample_count").cast("string")
    life = {LIFE_ROWS[k][0]: _facility(k) for k in LIFE}
    happened = c("accidents")
    accident = F.concat(F.format_number(happened["total"], 0), F.lit(" 件（A1 "), happened["a1"].cast("string"), F.lit("／A2 "), happened["a2"].cast("string"), F.lit("）"))
    flood = F.concat(_label(c("flood"), LEVEL_LABELS, MISSING), F.lit("（"), c("flood_hours").cast("string"), F.lit("h/"), c("flood_mm").cast("string"), F.lit("mm）"))
    price_known = source("actual-price") & ~c("insufficient")
    return {
        "總物件價格": currency_text(c("total_price")),
        "換算單價": F.concat(currency_text(c("unit_price")), F.lit("/坪")),
        "與附近行情差異": percent_text(c("difference_percent")),
        "價格樣本數": F.concat(samples, F.lit(" 筆")),
        "價格判定": F.concat(samples, F.when(price_known, " 筆，可判定").otherwise(" 筆，無法判定")),
        "淹水潛勢": F.when(c("legacy_risk"), OLD_SNAPSHOT).otherwise(flood),
        "土壤液化潛勢": F.when(c("legacy_risk"), OLD_SNAPSHOT).otherwise(_label(c("liquefaction"), LEVEL_LABELS, MISSING)),
        "災害資料": F.concat(F.lit("已知 "), known_hazards(c("flood"), c("liquefaction")).cast("string"), F.lit("/2 項")),
        "捷運距離": distance_text(c("nearest_metro")),
        "交通資料": F.concat(F.lit("可用 "), number(map(source, ("metro", "rail", "bus", "accidents"))), F.lit("/4 來源")),
        **life,
        "生活機能資料": F.concat(F.lit("可用 "), number(map(source, LIFE)), F.lit("/6 類")),
        "交通事故狀況": F.when(c("legacy_accident"), OLD_SNAPSHOT).when(source("accidents"), accident).otherwise(MISSING),
        "資料品質": F.when(c("historic"), "歷史 Demo（不與正式結果混用）").otherwise(_label(c("data_quality"), QUALITY_LABELS, MISSING)),
        "待確認事項": F.concat(F.size(F.filter("checks", lambda x: ~x)).cast("string"), F.lit(" 項")),
        "資料缺口": F.when(F.size("gaps") > 0, F.array_join("gaps", "、")).otherwise(NO_GAP),
    }


def comparison_table(saved: DataFrame, key: str, keys: list) -> DataFrame:
    """(ord, metric, a column for each of `keys`): the texts of saved results beside one another, every metric a row.

    saved holds `key` and total_price, unit_price, difference_percent, sample_count, insufficient, flood, flood_hours,
    flood_mm, liquefaction, nearest_metro, sources (map of id to status; the city's buses are `bus`), facilities (map of
    kind to struct of count, name, distance), accidents (struct of total, a1, a2), data_quality, historic, checks (array of
    whether each is done), gaps (array of texts), and legacy_risk, _life, _community, _market, _library and _accident.
    """
    rows = comparison_texts()
    shown = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(m).alias("metric"), t.alias("text")) for k, (m, t) in enumerate(rows.items())))
    long = saved.where(F.col(key).isin(*keys)).select(F.col(key).alias("__k"), F.inline(shown))
    return long.groupBy("ord", "metric").pivot("__k", keys).agg(F.first("text"))
