"""Scalar rules as Column expressions: numbers, dates, levels, identifiers. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values
SQM_PER_PING = 3.305785
BUILDING_TYPES = {"公寓(5樓含以下無電梯)": "apartment", "華廈(10層含以下有電梯)": "mansion", "住宅大樓(11層含以上有電梯)": "highrise"}
SPECIAL_NOTES = "親友|員工|共有人|特殊關係|急買急賣|法院拍賣|債務抵償|毛胚屋|瑕疵|增建|違建|畸零地|政府機關|協議價購|包含公共設施保留地"
DEPTH_LEVELS = {"0.3-0.5": "attention", "0.5-1.0": "priority", "1.0-2.0": "priority", "2.0-3.0": "priority", ">3.0": "priority"}
LIQUEFACTION_LEVELS = {"1": "priority", "2": "attention", "3": "low", "高": "priority", "中": "attention", "低": "low"}
FLOOD_SCENARIOS = ("6h-150", "6h-250", "6h-350", "12h-200", "12h-300", "12h-400", "24h-200", "24h-350", "24h-500", "24h-650")
STUDY_AREA = {"latitude": (24.65, 25.32), "longitude": (121.28, 122.02)}
LEVEL_RANK = {"priority": 0, "attention": 1, "unknown": 2, "low": 3}
# White space of ECMAScript: what its trim and \s take
WHITE = "[\\x09-\\x0D\\x20\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


WHITE_LETTERS = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def half_up(value: Column, places: int) -> Column:
    """Rounded to `places`, halves towards positive infinity."""
    k = 10**places
    return F.floor(value * k + 0.5) / k


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_LETTERS))


def roc_date(text: Column) -> Column:
    """Date of 6 or 7 digits whose year counts from 1911; null if there is no such day."""

    def day(digits: Column) -> Column:
        year = F.left(digits, F.length(digits) - 4).try_cast("int") + 1911
        return F.when(F.length(digits).between(6, 7), F.try_to_date(F.concat(year.cast("string"), F.right(digits, F.lit(4))), "yyyyMMdd"))

    return let(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^0-9]", ""), day)


def western_date(text: Column, year: Column) -> Column:
    """Date of 8 digits in the expected year, else null."""
    day = let(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^0-9]", ""), lambda digits: F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd")))
    return let(day, lambda d: F.when(F.year(d) == year, d))


def age_years(sold: Column, completed: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.datediff(sold, completed) / 365.25).cast("int"))


def sqm_to_ping(area: Column) -> Column:
    usable = lambda a: (a > 0) & ~F.isnan(a) & (a < F.lit(float("inf")))
    return let(area, lambda a: F.when(usable(a), half_up(a / SQM_PER_PING, 2)).otherwise(F.lit(0.0)))


def _without_parking(total: Column, area: Column, parking_price: Column, parking_area: Column) -> tuple[Column, Column]:
    floor0 = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    return total - floor0(parking_price), area - floor0(parking_area)


def unit_price(total: Column, area: Column, parking_price: Column, parking_area: Column, empty: Column | None = None) -> Column:
    """Price of an area unit without parking, 2 places; `empty` (0 by default) where no area is left."""
    price, net = _without_parking(total, area, parking_price, parking_area)
    return F.when(net > 0, half_up(price / net, 2)).otherwise(F.lit(0.0) if empty is None else empty)


def unit_cents(total: Column, area: Column, parking_price: Column, parking_area: Column) -> Column:
    """`unit_price` in hundredths: a whole number, of which less is written than of a fraction."""
    price, net = _without_parking(total, area, parking_price, parking_area)
    return F.when(net > 0, F.floor(price / net * 100 + 0.5).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def unit_price_or_null(total: Column, area: Column, parking_price: Column, parking_area: Column) -> Column:
    return unit_price(total, area, parking_price, parking_area, F.lit(None).cast("double"))


def difference_percent(own: Column, median: Column) -> Column:
    return F.when(median != 0, (own - median) / median * 100)


def building_type(text: Column) -> Column:
    plain = F.regexp_replace(text, f"{WHITE}+", "")
    return F.coalesce(*(F.when(F.contains(plain, F.lit(label)), F.lit(name)) for label, name in BUILDING_TYPES.items()))


def chinese_number(text: Column) -> Column:
    """Digits, or a Chinese numeral up to 99; null for anything else."""
    t = F.translate(strip(text), "零〇一二兩三四五六七八九", "001223456789")
    tens, ones = F.regexp_extract(t, "([0-9]?)十", 1), F.regexp_extract(t, "十([0-9]?)", 1)
    formed = F.when(tens == "", F.lit(1)).otherwise(tens.try_cast("int")) * 10 + F.when(ones == "", F.lit(0)).otherwise(ones.try_cast("int"))
    single = strip(text).rlike("^([0-9]+|.)$")
    return F.when(t.rlike("^[0-9]?十[0-9]?$"), formed).when(single & t.rlike("^[0-9]+$"), t.try_cast("int"))


def floor_number(text: Column) -> Column:
    """The one storey named in an NFKC text, else 0."""
    named = F.regexp_extract_all(text, F.lit("([0-9零〇一二兩三四五六七八九十]+)層"), F.lit(1))
    other = F.coalesce(text, F.lit("")).rlike("地下|夾層|屋頂|見其他登記事項")
    return F.when(text.isNull() | (text == "") | other | (F.size(named) != 1), F.lit(0)).otherwise(F.coalesce(chinese_number(F.try_element_at(named, F.lit(1))), F.lit(0)))


def special_transaction(note: Column) -> Column:
    return F.coalesce(note, F.lit("")).rlike(SPECIAL_NOTES)


def number_text(value: Column) -> Column:
    """A double as text: whole numbers without a point or an exponent."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def stable_id(*fields: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the trimmed fields, joined by bars; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(strip(f.cast("string")), F.lit("")) for f in fields)), 256), 1, 24)


def composite_hash(*hashes: Column) -> Column:
    return F.sha2(F.concat_ws(":", *(F.coalesce(h, F.lit("")) for h in hashes)), 256)


def in_study_area(latitude: Column, longitude: Column) -> Column:
    return F.coalesce(latitude.between(*STUDY_AREA["latitude"]) & longitude.between(*STUDY_AREA["longitude"]), F.lit(False))


def js_number(text: Column) -> Column:
    """Number of a text as ECMAScript reads it: blank is 0, hexadecimal is taken, anything else that is none is null."""

    def value(t: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(t, "^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("double")
        decimal = t.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$")
        return F.when(t == "", F.lit(0.0)).when(decimal, t.try_cast("double")).when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexadecimal)

    return let(strip(text), value)


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(next(iter(values.values())))))


def depth_level(depth: Column) -> Column:
    return _mapped(depth, DEPTH_LEVELS)


def liquefaction_level(category: Column) -> Column:
    return _mapped(category.cast("string"), LIQUEFACTION_LEVELS)


def scenario_hours(scenario: Column, hours: Column | None = None) -> Column:
    own = F.coalesce(F.regexp_extract(scenario, "^([0-9]+)h", 1).try_cast("int"), F.lit(0))
    return own if hours is None else F.coalesce(hours, own)


def scenario_millimetres(scenario: Column, rainfall: Column | None = None) -> Column:
    own = F.coalesce(F.regexp_extract(scenario, "-([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return own if rainfall is None else F.coalesce(rainfall, own)


def price_level(available: Column, insufficient: Column, percent: Column) -> Column:
    p = F.coalesce(percent, F.lit(0.0))
    return F.when(~available | insufficient, F.lit("unknown")).when(p > 20, F.lit("priority")).when((p > 8) | (p < -20), F.lit("attention")).otherwise(F.lit("low"))


def disaster_level(*levels: Column) -> Column:
    """The gravest of several levels; an unknown one outranks attention."""
    any_of = lambda x: reduce(lambda a, b: a | b, (level == x for level in levels))
    return F.when(any_of("priority"), "priority").when(any_of("unknown"), "unknown").when(any_of("attention"), "attention").otherwise("low")


def level_rank(level: Column) -> Column:
    return reduce(lambda c, kv: c.when(level == kv[0], kv[1]), list(LEVEL_RANK.items())[1:], F.when(level == "priority", 0))


def confidence_band(n: Column) -> Column:
    return F.when(n < 5, "low").when(n < 10, "medium-low").otherwise("medium")


def availability(n: Column, total: int) -> Column:
    return F.when(n == total, "official").when(n > 0, "partial").otherwise("unavailable")


def distance_text(metres: Column) -> Column:
    km = half_up(metres / 1000, 1)
    return F.when(metres.isNull(), "資料不足").when(metres >= 1000, F.concat(F.format_string("%.1f", km), F.lit(" 公里"))).otherwise(F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" 公尺")))


def local_date_text(stamp: Column) -> Column:
    """Day of a UTC timestamp text in Taipei; blank: unknown, unreadable: as it is."""
    t = F.try_to_timestamp(stamp)
    there = F.from_utc_timestamp(F.to_utc_timestamp(t, F.current_timezone()), "Asia/Taipei")
    return F.when(F.coalesce(strip(stamp), F.lit("")) == "", "日期不明").when(t.isNull(), stamp).otherwise(F.date_format(there, "yyyy/MM/dd"))


def presented_count(count: Column, status: Column, legacy: Column) -> Column:
    """A count as shown: unknown is not zero, so only official and stale sources show theirs."""
    return F.when(legacy, "舊快照").when(status.isin("official", "stale"), count.cast("string")).otherwise("資料不足")
