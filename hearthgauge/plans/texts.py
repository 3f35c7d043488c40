"""Registered queries over texts and shown results.

Texts are put together from the columns of a row, and the SQL computes a rule's value from the text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo, names, scalars as S
from ..operators import analysis as A, documents as M, presentation as T, quality as Q, sampling as W
from ..streaming import events as E
from . import roles as R
from .queries import query
from .records import _pick


def literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def some(key: str, *texts: str | None) -> str:
    """One of the texts for each row; further calls mix the key by other numbers, so that texts meet in all ways."""
    return _pick(key, *map(literal, texts))


def computed(name: str, table: str, key: str, text: str, rule: Callable[[Column], Column], sql: str, before: str = "") -> None:
    """Registers `rule` over `text`, an expression of a table's row; `sql` computes its value from the text alone."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return R.table(spark, d, table).select(F.col(key).alias("id"), F.expr(text).alias("text")).select("id", rule(F.col("text")).alias("value"))

    run.__name__ = name
    query(f"WITH t AS (SELECT {key} AS id, {text} AS text FROM {table}){before} SELECT id, {sql} AS value FROM {'t' if not before else 'u'}")(run)


_DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))"
_O, _P, _C, _S = "o_orderkey", "p_partkey", "c_custkey", "s_suppkey"
_WHITE = "[\\s　]"

computed(
    "western_date_texts", "orders", _O,
    _pick("(o_custkey * 7 % 11)", _DAY, f"replace({_DAY}, '-', '')", f"replace({_DAY}, '-', '/')", f"concat(substr({_DAY}, 1, 4), '0229')", f"substr({_DAY}, 1, 7)", "''", "NULL", f"concat('at ', {_DAY})", f"concat({_DAY}, '1')"),
    lambda t: S.western_date(t, F.lit(1996)).cast("string"),
    "CASE WHEN length(g) = 8 AND left(g, 4) = '1996' THEN strftime(try_strptime(g, '%Y%m%d'), '%Y-%m-%d') END",
    ", u AS (SELECT id, regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') AS g FROM t)",
)
computed(
    "local_dates", "orders", _O,
    _pick("(o_custkey * 5 % 13)", *[f"concat({_DAY}, 'T', lpad(CAST(o_orderkey % 24 AS VARCHAR(2)), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS VARCHAR(2)), 2, '0'), ':00Z')"] * 5, "''", "NULL", "'  '", "concat('soon ', o_orderkey)"),
    S.local_date_text,
    "CASE WHEN trim(coalesce(text, '')) = '' THEN '日期不明' ELSE coalesce(strftime(try_strptime(text, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 8 HOUR, '%Y/%m/%d'), text) END",
)
computed(
    "building_types", "part", _P,
    f"concat({some('p_partkey', '公寓', '華廈', '住宅大樓', '店面')}, {some('(p_partkey * 7 % 11)', '(', ' (', '(　', '（')}, {some('(p_partkey * 5 % 13)', '5樓含以下無電梯', '10層含以下有電梯', '11層含以上有電梯', '店鋪')}, {some('(p_partkey * 3 % 7)', ')', ') ', ' )', '')})",
    S.building_type,
    "CASE WHEN contains(g, '公寓(5樓含以下無電梯)') THEN 'apartment' WHEN contains(g, '華廈(10層含以下有電梯)') THEN 'mansion' WHEN contains(g, '住宅大樓(11層含以上有電梯)') THEN 'highrise' END",
    f", u AS (SELECT id, regexp_replace(text, '{_WHITE}+', '', 'g') AS g FROM t)",
)

_NUMERAL = f"concat({some('(c_custkey * 7 % 11)', '', '一', '二', '兩', '九', '〇', '4', '百', ' ')}, {some('c_custkey', '十', '', '十', '')}, {some('(c_custkey * 5 % 13)', '', '零', '三', '五', '六', '七', '八', '8', '17', ' ', '四')})"


def _number(text: str) -> str:
    """SQL of a numeral's number: by what stands before and behind the ten, or letter by letter."""
    g = f"translate(trim({text}), '零〇一二兩三四五六七八九', '001223456789')"
    side = lambda k, none: f"coalesce(nullif(split_part({g}, '十', {k}), '')::INT, {none})"
    return f"CASE WHEN regexp_full_match({g}, '[0-9]?十[0-9]?') THEN {side(1, 1)} * 10 + {side(2, 0)} WHEN regexp_full_match(trim({text}), '[0-9]+|.') AND regexp_full_match({g}, '[0-9]+') THEN {g}::INT END"


computed("chinese_numbers", "customer", _C, _NUMERAL, lambda t: S.chinese_number(t).cast("string"), f"({_number('text')})::VARCHAR")
computed(
    "floor_numbers", "customer", _C,
    f"CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN '' ELSE concat({some('(c_custkey * 3 % 17)', '', '', '', '地下', '')}, {_NUMERAL}, '層', {some('(c_custkey * 11 % 19)', '', '', '，陽台', '，三層', '，屋頂', '，見其他登記事項', '夾層', '，5')}) END",
    S.floor_number,
    f"CASE WHEN coalesce(text, '') = '' OR regexp_matches(text, '地下|夾層|屋頂|見其他登記事項') OR len(g) <> 1 THEN 0 ELSE coalesce({_number('g[1]')}, 0) END::INT",
    ", u AS (SELECT id, text, regexp_extract_all(text, '([0-9零〇一二兩三四五六七八九十]+)層', 1) AS g FROM t)",
)
computed(
    "place_names", "part", _P,
    f"CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE concat({some('p_partkey', '台北(市)立', '臺北市立 ', '【台大】', '新北　市[三重]', '')}, p_brand, {some('(p_partkey * 3 % 7)', ' 國小', '　醫院', '（台）', '')}) END",
    names.place_name,
    f"regexp_replace(replace(coalesce(text, ''), '台', '臺'), '[()（）\\[\\]【】]|{_WHITE}', '', 'g')",
)
computed(
    "market_names", "part", _P,
    f"CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE concat({some('p_partkey', '台北市公有', '臺北市公有', '', '新')}, p_brand, {some('(p_partkey * 3 % 7)', '市場', '中繼市場', ' 市場臨時攤棚')}, {some('(p_partkey * 7 % 11)', '(1)', '(2)', '（BOT）', '(104)', '(2樓)', '（店鋪）', '', '(12345)', '(3)')}) END",
    names.market_name,
    f"regexp_replace(replace(replace(regexp_replace(g, '[（(]([0-9]{{2,4}}|BOT|店鋪|臨時攤棚|[12]樓)[）)]', '', 'g'), '臨時攤棚', ''), '中繼', ''), '[()（）\\[\\]【】]|{_WHITE}', '', 'g')",
    ", u AS (SELECT id, replace(replace(regexp_replace(replace(coalesce(text, ''), '台', '臺'), '^臺北市公有', ''), '(1)', '一'), '(2)', '二') AS g FROM t)",
)
_TRIMMED = "trim({}, concat(' 　', chr(9)))"
computed("rail_names", "supplier", _S, f"concat({some('s_suppkey', '', ' ', '　')}, s_name, {some('(s_suppkey * 3 % 7)', '-環島', '', '-環島 ', '-環島線', '-環島-環島')})", names.rail_name, f"regexp_replace({_TRIMMED.format('text')}, '-環島$', '')")
computed("metro_names", "supplier", _S, f"concat({some('s_suppkey', '{', '', '{ ', 'x{')}, s_name, {some('(s_suppkey * 3 % 7)', ',Taipei}', '}', ' }b,{c}', '')})", names.metro_name, _TRIMMED.format("regexp_extract(text, '\\{([^,}]+)', 1)"))
computed("park_types", "part", _P, f"concat(p_brand, {some('p_partkey', '森林公園', '廣場公園', '綠地', '行道樹', '綠地廣場', '公園綠地')})", names.park_type, "CASE WHEN text LIKE '%廣場%' THEN 'plaza' WHEN text LIKE '%綠地%' THEN 'green-space' WHEN text LIKE '%公園%' THEN 'park' END")
_DEGREES = f"{_WHITE}*(-?[0-9]+(?:\\.[0-9]+)?){_WHITE}+(-?[0-9]+(?:\\.[0-9]+)?){_WHITE}*"
computed(
    "lat_lon_texts", "part", _P,
    f"concat({some('p_partkey', '', ' ', '　', '-', '')}, p_partkey % 90, {some('(p_partkey * 3 % 7)', '', '.25', '.5', '.')}, {some('(p_partkey * 7 % 11)', ' ', '  ', '　', ',', ' N')}, p_partkey % 180, {some('(p_partkey * 5 % 13)', '.75', '', ' ', ' 1', '.125')})",
    lambda t: F.concat_ws(";", *(c.cast("string") for c in names.lat_lon(t))),
    f"CASE WHEN regexp_full_match(text, '{_DEGREES}') THEN regexp_extract(text, '{_DEGREES}', 1)::DOUBLE || ';' || regexp_extract(text, '{_DEGREES}', 2)::DOUBLE ELSE '' END",
)
_PART = "concat('第', {}, '路', c_custkey % 90, '號')"
computed(
    "address_lists", "customer", _C,
    f"CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE concat({_PART.format('c_nationkey')}, {some('(c_custkey * 3 % 7)', '（後棟）', '', '(a;b)', ' ')}, {_pick('(c_custkey * 7 % 11)', 'chr(10)', literal('；'), literal('、'), literal(' ; '), 'concat(chr(13), chr(10))')}, {_PART.format('c_custkey % 3')}, {some('c_custkey', '', '、大安區', '；', '；大安區西')}) END",
    lambda t: F.array_join(names.address_list(t, F.lit("大安區")), "|"),
    "array_to_string(list_filter(g, lambda x, i: x <> '' AND x <> '大安區' AND list_position(g, x) = i), '|')",
    f", u AS (SELECT id, list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '[(（][^)）]*[)）]', '', 'g'), '[\\r\\n;；、]+'), lambda x: {_TRIMMED.format('x')}) AS g FROM t)",
)


def _sections(x: str) -> str:
    for digit, numeral in names.SECTIONS.items():
        x = f"replace({x}, '{digit}段', '{numeral}段')"
    return x


_NUM, _UNIT = "[零〇一二兩三四五六七八九十]", f"[{names.COUNTED}]"
_SPLIT = f"^(.*?)({_NUM}+)({_UNIT}.*)$"
_IN_DIGITS = "CASE WHEN NOT contains(m, '十') OR regexp_full_match(m, '[^十]?十[^十]?') THEN " + f"coalesce(CASE WHEN contains(m, '十') THEN ({_number('m')})::VARCHAR END, translate(m, '零〇一二兩三四五六七八九', '001223456789')) ELSE m END"
computed(
    "address_variant_lists", "customer", _C,
    f"CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE concat('大安區', {some('(c_custkey * 3 % 7)', '龍泉里', '', '新龍泉里', '里')}, '復興路', {some('c_custkey', '', '3段', '四段', '13段')}, {some('(c_custkey * 7 % 11)', '十五', '二十', '五', '12', '二三', '十', '一十二', '二十十')}, {some('(c_custkey * 5 % 13)', '號', '號之3', '巷5號', '之1、14號', '，8號')}) END",
    lambda t: F.array_join(names.address_variants(t, F.lit("大安區")), "|"),
    "array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), '|')",
    f""", a AS (SELECT id, coalesce(text, '') AS f0, regexp_replace(coalesce(text, ''), '大安區{names.VILLAGE}', '大安區') AS f1 FROM t),
b AS (SELECT *, regexp_extract(replace(f1, '，', ','), '{_SPLIT}', 2) AS m, regexp_matches(f1, '{_NUM}{_UNIT}') AS has, replace(f1, '，', ',') AS n1, replace(f1, '，', ',') AS n FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(n, '{_NUM}{_UNIT}') THEN regexp_extract(n, '{_SPLIT}', 1) || {_IN_DIGITS} || regexp_extract(n, '{_SPLIT}', 3) ELSE n END AS f2 FROM b), e AS (SELECT *, {_sections('f2')} AS f3 FROM c),
u AS (SELECT id, [f0, n1, f2, f3, regexp_replace(f3, '([0-9]+(?:之[0-9]+)?)[、．.,，;；].*$', '\\1號')] AS g FROM e)""",
)
computed("first_filled_texts", "customer", _C, _pick(_C, "' '", "''", "NULL", "concat(' ', c_name, ' ')", "concat('　', c_name)", "c_name"), lambda t: names.first_filled(t, F.lit(" - ")), f"coalesce(nullif({_TRIMMED.format('text')}, ''), '-')")
_WIDE = "'０１２３４５６７８９ＡＢ　', '0123456789AB '"
computed(
    "nfkc_texts", "part", _P,
    f"CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE concat(translate(CAST(p_partkey AS VARCHAR(20)), '0123456789', '０１２３４５６７８９'), {some('p_partkey', '　', 'ﬁ', '㈱', 'ＡＢ', '臺')}, p_brand) END",
    names.nfkc,
    f"replace(replace(translate(text, {_WIDE}), 'ﬁ', 'fi'), '㈱', '(株)')",
)
computed(
    "address_keys", "part", _P,
    f"CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE concat({some('p_partkey', '臺北市', '台北市', '', '新北市')}, {some('(p_partkey * 3 % 7)', '大安區', '', '大安區大安區')}, '和平路', {some('(p_partkey * 7 % 11)', '一段', '(雙)', '', '（內）')}, {some('(p_partkey * 5 % 13)', '', ' ', ', ')}, p_partkey % 500, {some('(p_partkey * 11 % 17)', '號', '-3號', '號之2', '', '號, 5號')}, {some('(p_partkey * 13 % 19)', '五樓', '', '　3樓')}) END",
    lambda t: names.normal_address(t, F.lit("臺北市"), F.lit("大安區")),
    "CASE WHEN g LIKE '%_號%' THEN regexp_extract(g, '^(.+?號(?:之[0-9]+)?)', 1) ELSE g END",
    f", u AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[臺台]北市|新北市', '', 'g'), '大安區', ''), '[()（）內單雙]', '', 'g'), '[－–—-]([0-9]+)', '之\\1', 'g'), '[,.，、]|{_WHITE}', '', 'g') AS g FROM t)",
)


# ---- shown values ------------------------------------------------------------------------------------------

_METRES = "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 2500 AS DOUBLE) + 0.5 END"
_DISTANCE = "CASE WHEN {m} IS NULL THEN '資料不足' WHEN {m} >= 1000 THEN format('{{:.1f}}', floor({m} / 100 + 0.5) / 10) || ' 公里' ELSE floor({m} + 0.5)::BIGINT || ' 公尺' END"


@query(f"WITH c AS (SELECT c_custkey AS id, {_METRES} AS m FROM customer) SELECT id, {_DISTANCE.format(m='m')} AS value FROM c")
def distance_texts(spark: SparkSession, d: str) -> DataFrame:
    return R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.distance_text(F.expr(_METRES)).alias("value"))


_STATUS = "CASE {k} % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'stale' WHEN 2 THEN 'failed' WHEN 3 THEN 'unavailable' END"
_AUDIT = "CASE c_custkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' END"
_NEEDED = "CASE WHEN c_custkey % 3 = 0 THEN 60 END"


@query(f"""WITH c AS (SELECT c_custkey AS id, {_STATUS.format(k='c_custkey')} AS status, {_AUDIT} AS audit, {_NEEDED} AS needed, c_custkey % 7 AS n, c_custkey % 6 = 0 AS legacy FROM customer)
SELECT id, CASE WHEN coalesce(status, 'unavailable') = 'unavailable' AND audit = 'passed' AND needed IS NOT NULL THEN '人工驗收通過 ' || n || '/60，等待正式發布' WHEN coalesce(status, 'unavailable') = 'unavailable' AND audit = 'passed' THEN '人工驗收通過，等待正式發布'
  WHEN coalesce(status, 'unavailable') = 'unavailable' AND audit = 'pending' AND needed IS NOT NULL THEN '等待人工驗收 ' || n || '/60' WHEN coalesce(status, 'unavailable') = 'unavailable' AND audit = 'pending' THEN '等待人工驗收'
  WHEN status = 'official' THEN '正式資料' WHEN status = 'stale' THEN '資料過期' WHEN status = 'failed' THEN '最近更新失敗' ELSE '尚未接入' END AS state,
 CASE WHEN status IN ('official', 'stale') THEN format('{{:,}}', id * 1000) ELSE '資料不足' END AS records, CASE WHEN legacy THEN '舊快照' WHEN status IN ('official', 'stale') THEN n::VARCHAR ELSE '資料不足' END AS shown FROM c""")
def source_texts(spark: SparkSession, d: str) -> DataFrame:
    k, status = F.col("c_custkey"), F.expr(_STATUS.format(k="c_custkey"))
    state = T.status_text(status, F.expr(_AUDIT), k % 7, F.expr(_NEEDED))
    return R.table(spark, d, "customer").select(k.alias("id"), state.alias("state"), T.record_count_text(status, k * 1000).alias("records"), S.presented_count(k % 7, status, k % 6 == 0).alias("shown"))


_SPOT = {"lat": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(24.6 AS DOUBLE) + (c_custkey % 80) * CAST(0.01 AS DOUBLE) END", "lon": "CAST(121.2 AS DOUBLE) + (c_custkey % 90) * CAST(0.01 AS DOUBLE)"}


@query(f"WITH c AS (SELECT c_custkey AS id, {_SPOT['lat']} AS lat, {_SPOT['lon']} AS lon FROM customer) SELECT id, coalesce(lat >= 24.65::DOUBLE AND lat <= 25.32::DOUBLE AND lon >= 121.28::DOUBLE AND lon <= 122.02::DOUBLE, false) AS inside FROM c")
def study_area(spark: SparkSession, d: str) -> DataFrame:
    return R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.in_study_area(F.expr(_SPOT["lat"]), F.expr(_SPOT["lon"])).alias("inside"))


@query("SELECT p_partkey AS id, p_size <= 40 AND p_partkey % 50 <= 30 AS valid FROM part")
def ring_coordinates(spark: SparkSession, d: str) -> DataFrame:
    point = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    rings = F.array(F.array(point(F.lit(0), F.lit(0)), point(F.col("p_size"), F.lit(1))), F.array(point(F.lit(2), F.col("p_partkey") % 50)))
    return R.table(spark, d, "part").select(F.col("p_partkey").alias("id"), geo.coordinates_valid(rings, 0, 0, 40, 30).alias("valid"))


_LEVEL = ["priority", "attention", "unknown", "low"]


@query("""WITH c AS (SELECT c_custkey AS id, unnest(range(0, 5)) AS k FROM customer), i AS (SELECT id, k, (id + k) % 3 = 0 AS checked, 'q' || ((id + k) % 7) AS text FROM c),
a AS (SELECT id, string_agg(CASE WHEN checked THEN '☑ ' ELSE '☐ ' END || text, chr(10) ORDER BY k) AS body FROM i GROUP BY 1),
t AS (SELECT id, string_agg(text, '|' ORDER BY k) AS first FROM (SELECT * FROM i WHERE NOT checked QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) <= 3) GROUP BY 1)
SELECT a.id, 'Title ' || a.id || chr(10) || body || chr(10) || 'end' AS text, first AS actions FROM a JOIN t USING (id)""")
def checklist_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    items = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(((k + i) % 3 == 0).alias("checked"), F.concat(F.lit("q"), ((k + i) % 7).cast("string")).alias("text")))
    return R.table(spark, d, "customer").select(k.alias("id"), A.checklist_text(F.concat(F.lit("Title "), k.cast("string")), items, "end").alias("text"), F.array_join(A.priority_actions(items), "|").alias("actions"))


@query("SELECT c_custkey AS id, (c_custkey % 4 <> 2)::INT + (c_custkey % 3 <> 2)::INT AS known, CASE (c_custkey % 4 <> 2)::INT + (c_custkey % 3 <> 2)::INT WHEN 2 THEN 'official' WHEN 1 THEN 'partial' ELSE 'unavailable' END AS hazards FROM customer")
def hazard_availability(spark: SparkSession, d: str) -> DataFrame:
    level = lambda m: F.element_at(F.array(*map(F.lit, _LEVEL)), (F.col("c_custkey") % m + 1).cast("int"))
    n = T.known_hazards(level(4), level(3))
    return R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), n.alias("known"), A.availability(n, 2).alias("hazards"))


# ---- the comparison of saved results -----------------------------------------------------------------------

_KEYS = [1, 2, 3]
_LIFE_SQL = {"medical": ("醫院", "間", 5), "parking": ("路外停車場", "處", 5), "school": ("學校", "處校園", 6), "park": ("公園綠地", "處", 6), "market": ("傳統零售市場", "處", 7), "library": ("公共圖書館", "間", 8)}
_IDS = ["actual-price", "metro", "rail", "bus", "accidents", *_LIFE_SQL]
_LEVEL_SQL = "CASE {x} WHEN 0 THEN '優先查證' WHEN 1 THEN '建議進一步確認' WHEN 2 THEN '資料不足或無法判定' ELSE '目前未發現顯著異常' END"


def _on(ident: str) -> str:
    return f"((k + {_IDS.index(ident)}) % 5 < 2)"


def _life_sql(kind: str) -> str:
    label, unit, legacy = _LIFE_SQL[kind]
    n = _IDS.index(kind)
    shown = f"format('{{:,}}', k * {n} * 100) || ' {unit}；最近 ' || CASE WHEN k % 2 = 0 THEN '資料不足' ELSE 'N' || k END || '（' || {_DISTANCE.format(m=f'(k * {n} * 50.0)')} || '）'"
    return f"WHEN '{label}' THEN CASE WHEN k % {legacy} = 0 THEN '舊快照，請重新查詢' WHEN NOT {_on(kind)} THEN '資料不足' ELSE {shown} END"


_METRICS = ["總物件價格", "換算單價", "與附近行情差異", "價格樣本數", "價格判定", "淹水潛勢", "土壤液化潛勢", "災害資料", "捷運距離", "交通資料", *(v[0] for v in _LIFE_SQL.values()), "生活機能資料", "交通事故狀況", "資料品質", "待確認事項", "資料缺口"]
_SUM = lambda ids: " + ".join(f"{_on(i)}::INT" for i in ids)
_COMPARISON = f"""WITH s AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey <= 3), m AS (SELECT unnest(range(0, {len(_METRICS)})) AS ord, unnest([{', '.join(map(literal, _METRICS))}]) AS metric),
t AS (SELECT k, ord, metric, CASE metric
 WHEN '總物件價格' THEN '$' || format('{{:,}}', floor(abs(v) * 1000 + 0.5)::BIGINT) WHEN '換算單價' THEN '$' || format('{{:,}}', floor(abs(v) * 10 + 0.5)::BIGINT) || '/坪'
 WHEN '與附近行情差異' THEN CASE WHEN k = 3 THEN '資料不足' ELSE format('{{:.1f}}', k * 1.5) || '%' END WHEN '價格樣本數' THEN k * 4 || ' 筆' WHEN '價格判定' THEN k * 4 || CASE WHEN {_on('actual-price')} AND k <> 1 THEN ' 筆，可判定' ELSE ' 筆，無法判定' END
 WHEN '淹水潛勢' THEN CASE WHEN k % 3 = 0 THEN '舊快照，請重新查詢' ELSE {_LEVEL_SQL.format(x='k % 4')} || '（24h/' || k * 100 || 'mm）' END WHEN '土壤液化潛勢' THEN CASE WHEN k % 3 = 0 THEN '舊快照，請重新查詢' ELSE {_LEVEL_SQL.format(x='(k + 1) % 4')} END
 WHEN '災害資料' THEN '已知 ' || ((k % 4 <> 2)::INT + ((k + 1) % 4 <> 2)::INT) || '/2 項' WHEN '捷運距離' THEN {_DISTANCE.format(m='(k * 600.0)')} WHEN '交通資料' THEN '可用 ' || ({_SUM(['metro', 'rail', 'bus', 'accidents'])}) || '/4 來源'
 {' '.join(map(_life_sql, _LIFE_SQL))} WHEN '生活機能資料' THEN '可用 ' || ({_SUM(_LIFE_SQL)}) || '/6 類'
 WHEN '交通事故狀況' THEN CASE WHEN k % 9 = 0 THEN '舊快照，請重新查詢' WHEN {_on('accidents')} THEN format('{{:,}}', k * 1500) || ' 件（A1 ' || k || '／A2 ' || k * 1499 || '）' ELSE '資料不足' END
 WHEN '資料品質' THEN CASE k WHEN 1 THEN '全部正式' WHEN 2 THEN '混合來源' ELSE '歷史 Demo（不與正式結果混用）' END WHEN '待確認事項' THEN (2 - (k % 2)) || ' 項' ELSE CASE WHEN k = 1 THEN '無' ELSE 'g1、g2' END END AS text FROM s, m)
SELECT ord::INT AS ord, metric, max(text) FILTER (k = 1) AS p1, max(text) FILTER (k = 2) AS p2, max(text) FILTER (k = 3) AS p3 FROM t GROUP BY 1, 2"""


@query(_COMPARISON)
def comparison_texts(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("s_suppkey"), F.abs("s_acctbal")
    level = lambda n: F.element_at(F.array(*map(F.lit, _LEVEL)), ((k + n) % 4 + 1).cast("int"))
    state = {i: F.when((k + n) % 5 < 2, F.when((k + n) % 5 == 0, "official").otherwise("stale")).otherwise("failed") for n, i in enumerate(_IDS)}
    place = lambda n: F.struct((k * n * 100).alias("count"), F.when(k % 2 == 1, F.concat(F.lit("N"), k.cast("string"))).alias("name"), (k * n * 50.0).alias("distance"))
    saved = R.table(spark, d, "supplier").select(
        k.alias("id"), (v * 1000).alias("total_price"), (v * 10).alias("unit_price"), F.when(k != 3, k * 1.5).alias("difference_percent"), (k * 4).alias("sample_count"), (k == 1).alias("insufficient"),
        level(0).alias("flood"), F.lit(24).alias("flood_hours"), (k * 100).alias("flood_mm"), level(1).alias("liquefaction"), (k * 600.0).alias("nearest_metro"),
        F.create_map(*(x for i, s in state.items() for x in (F.lit(i), s))).alias("sources"), F.create_map(*(x for i in _LIFE_SQL for x in (F.lit(i), place(_IDS.index(i))))).alias("facilities"),
        F.struct((k * 1500).alias("total"), k.alias("a1"), (k * 1499).alias("a2")).alias("accidents"), F.when(k == 1, "official").otherwise("mixed").alias("data_quality"), (k == 3).alias("historic"),
        F.array(F.lit(False), k % 2 == 1).alias("checks"), F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("g1"), F.lit("g2"))).alias("gaps"),
        *((k % n == 0).alias(f"legacy_{x}") for x, n in (("risk", 3), ("life", 5), ("community", 6), ("market", 7), ("library", 8), ("accident", 9))),
    )
    return T.comparison_table(saved, "id", _KEYS).withColumnsRenamed({"1": "p1", "2": "p2", "3": "p3"})


# ---- sources -----------------------------------------------------------------------------------------------

_RUN = "CASE s_suppkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'unavailable' ELSE 'stale' END"


@query(f"SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 > 0 AND s_nationkey % 3 <> 1 THEN 'unavailable' ELSE {_RUN} END AS runtime_status FROM supplier")
def runtime_statuses(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey") % 3
    held = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    rows = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_RUN).alias("status"), held.alias("districts"))
    return M.runtime_status(rows, "a").select("id", "runtime_status")


@query(f"""WITH f AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT -1), st AS (SELECT s_suppkey AS id, {_RUN} AS status, s_acctbal AS balance FROM supplier)
SELECT coalesce(st.id, f.id) AS id, CASE WHEN f.id IS NOT NULL THEN 'failed' ELSE status END AS status, CASE WHEN f.id IS NOT NULL THEN 'today' ELSE 'before' END AS attempted_at, CASE WHEN f.id IS NOT NULL THEN 'no answer' END AS message, balance FROM st FULL JOIN f ON st.id = f.id""")
def failed_sources_keep_values(spark: SparkSession, d: str) -> DataFrame:
    s = R.table(spark, d, "supplier")
    states = s.select(F.col("s_suppkey").alias("id"), F.expr(_RUN).alias("status"), F.lit("before").alias("attempted_at"), F.lit(None).cast("string").alias("message"), F.col("s_acctbal").alias("balance"))
    never = spark.range(1).select(F.lit(-1).cast(s.schema["s_suppkey"].dataType).alias("id"))
    failures = s.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("id")).unionByName(never).withColumn("message", F.lit("no answer"))
    return M.failed_sources(states, failures, F.lit("today"))


_SOURCE = "concat('s', r_regionkey)"
_CATALOG = {"status": "CASE WHEN r_regionkey < 2 THEN 'official' ELSE 'unavailable' END", "automated_passed": "r_regionkey <> 3", "manual_passed": "r_regionkey <> 1", "error": "CASE r_regionkey WHEN 0 THEN 'match rate 0.5' WHEN 4 THEN 'no answer' END"}
_CATALOG_SQL = ", ".join(f"{e} AS {n}" for n, e in _CATALOG.items())


@query(f"""WITH c AS (SELECT CASE r_regionkey WHEN 2 THEN 'rail' ELSE {_SOURCE} END AS id, {_CATALOG_SQL} FROM region)
SELECT *, CASE WHEN error LIKE '%match rate%' THEN 'unavailable' WHEN error IS NOT NULL THEN 'failed' WHEN automated_passed AND manual_passed THEN 'official' ELSE 'unavailable' END AS next_status FROM c""")
def promotion(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("r_regionkey") == 2, "rail").otherwise(F.expr(_SOURCE))
    return Q.promotable(R.table(spark, d, "region").select(own.alias("id"), *(F.expr(e).alias(n) for n, e in _CATALOG.items())), ["s0", "s1"])


@query("""WITH d AS (SELECT unnest(['market', 'park', 'metro', 'rail']) AS id), s AS (SELECT unnest(['market', 'park', 'metro']) AS id, unnest(['unavailable', 'official', 'unavailable']) AS status)
SELECT r_regionkey, d.id, status, CASE WHEN d.id = 'market' THEN r_regionkey ELSE -1 END AS n, d.id = 'market' AS has_readiness FROM region, d LEFT JOIN s ON s.id = d.id""")
def described_sources(spark: SparkSession, d: str) -> DataFrame:
    region = R.table(spark, d, "region")
    out = []
    for ident in ("market", "park", "metro", "rail"):
        one = region.select("r_regionkey", F.lit(ident).alias("id"))
        state = spark.range(1).select(F.lit(ident).alias("id"), F.lit("official" if ident == "park" else "unavailable").alias("status"))
        ready = spark.range(1).select(F.lit(ident).alias("id"), F.lit(ident).alias("__k"))
        out.append((one, state.where(F.col("id") != "rail"), ready))
    descriptors, states, readiness = out[0]
    for one, state, ready in out[1:]:
        descriptors, states, readiness = descriptors.unionByName(one), states.unionByName(state), readiness.unionByName(ready)
    described = M.describe_sources(descriptors, states, readiness)
    return described.select("r_regionkey", "id", "status", F.when(F.col("__k") == "market", F.col("r_regionkey")).otherwise(-1).alias("n"), "has_readiness")


@query("""SELECT s_suppkey AS id, true AS name_equal, s_suppkey % 3 <> 0 AS balance_equal, s_suppkey % 3 <> 0 AS all_equal FROM supplier WHERE s_suppkey % 2 = 0""")
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    one = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("balance"))
    other = R.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return Q.fields_equal(one, other, ["id"], ["name", "balance"])


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey <> 2")
def saved_without_one(spark: SparkSession, d: str) -> DataFrame:
    return M.delete_item(R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", 2)


# ---- events ------------------------------------------------------------------------------------------------


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def event_days(spark: SparkSession, d: str) -> DataFrame:
    out = E.tumbling_counts(R.table(spark, d, "events"), "ts", "1 day", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = E.session_counts(R.table(spark, d, "events"), "ts", "1 hour", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# ---- samples -----------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'taipei' ELSE 'new-taipei' END AS city FROM supplier)
SELECT id, city FROM s QUALIFY city = 'taipei' OR row_number() OVER (PARTITION BY city ORDER BY id) <= 5""")
def rail_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "taipei").otherwise("new-taipei").alias("city"))
    return W.first_by_kind(rows, "city", "id", {"taipei": None, "new-taipei": 5})


_CASE = "CASE p_partkey % 7 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'unknown' ELSE 'low' END"


@query(f"""WITH c AS (SELECT p_partkey AS id, p_brand AS category, {_CASE} AS kind FROM part), one AS (SELECT id, category FROM c WHERE kind = 'red' ORDER BY id LIMIT 1)
SELECT id, category, kind FROM c WHERE id IN (SELECT id FROM one UNION ALL (SELECT c.id FROM c, one WHERE kind = 'red' AND c.category <> one.category ORDER BY c.id LIMIT 1) UNION ALL (SELECT id FROM c WHERE kind = 'yellow' ORDER BY id LIMIT 2) UNION ALL (SELECT id FROM c WHERE kind = 'unknown' ORDER BY id LIMIT 1))""")
def flood_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = R.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.expr(_CASE).alias("kind"))
    reds = W.different_second(rows.where("kind = 'red'"), ["kind"], "category", "id").select(*rows.columns)
    return reds.unionByName(W.first_by_kind(rows, "kind", "id", {"yellow": 2, "unknown": 1}))


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'uncovered' END AS kind FROM part)
SELECT id, kind FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) <= CASE kind WHEN 'uncovered' THEN 2 ELSE 1 END""")
def liquefaction_sample(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = R.table(spark, d, "part").select(k.alias("id"), F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").when(k % 5 == 2, "low").otherwise("uncovered").alias("kind"))
    return W.first_by_kind(rows, "kind", "id", {"high": 1, "medium": 1, "low": 1, "uncovered": 2})
