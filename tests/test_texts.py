"""Text rules on cases worked out by hand. The queries of the same names vary the texts by row."""

import pytest
from pyspark.sql import functions as F

from hearthgauge.functions import names, scalars as S

CASES = {}


def worked(name, cases, rule):
    CASES[name] = (cases, rule)


worked("western_date_texts", [("20240229", "2024-02-29"), ("20230229", None), ("2024/12/31", "2024-12-31"), ("20231231", None), ("2024123", None), ("", None), (None, None)], lambda t: S.western_date(t, F.lit(2024)).cast("string"))
worked("local_dates", [("2024-05-31T16:30:00Z", "2024/06/01"), ("2024-05-31T15:59:59Z", "2024/05/31"), ("", "日期不明"), (None, "日期不明"), ("soon", "soon")], S.local_date_text)
worked("building_types", [("公寓(5樓含以下無電梯)", "apartment"), ("華廈(10層含以下有電梯) ", "mansion"), ("住宅大樓 (11層含以上有電梯)", "highrise"), ("店面(店鋪)", None), (None, None)], S.building_type)
worked("chinese_numbers", [("五", "5"), ("十", "10"), ("十二", "12"), ("二十", "20"), ("九十九", "99"), ("兩", "2"), ("〇", "0"), ("17", "17"), ("二三", None), ("百", None), ("", None), (" 七 ", "7")], lambda t: S.chinese_number(t).cast("string"))
worked("floor_numbers", [("五層", 5), ("十二層", 12), ("地下一層", 0), ("三層，陽台", 3), ("二層，三層", 0), ("屋頂夾層", 0), ("見其他登記事項", 0), ("", 0), (None, 0), ("21層", 21), ("百層", 0)], S.floor_number)
worked("place_names", [("台北(市)立 [大同] 國小", "臺北市立大同國小"), ("【台大】　醫院", "臺大醫院"), ("", ""), (None, "")], names.place_name)
worked("market_names", [("台北市公有士林市場", "士林市場"), ("東門市場(1)", "東門市場一"), ("東門市場(2)", "東門市場二"), ("南門中繼市場", "南門市場"), ("成功市場（BOT）", "成功市場"), ("環南市場(2樓)", "環南市場"), ("湖光市場臨時攤棚", "湖光市場"), ("中山 市場(104)", "中山市場"), (None, "")], names.market_name)
worked("rail_names", [(" 臺北-環島 ", "臺北"), ("板橋", "板橋"), ("-環島線", "-環島線"), (None, None)], names.rail_name)
worked("metro_names", [("{台北車站,Taipei}", "台北車站"), ("{ 中山 }", "中山"), ("{a}b,{c}", "a"), ("中山", ""), (None, None)], names.metro_name)
worked("park_types", [("大安森林公園", "park"), ("中山廣場公園", "plaza"), ("河濱綠地公園", "green-space"), ("行道樹", None), (None, None)], names.park_type)
worked("lat_lon_texts", [("25.03 121.5", "25.03;121.5"), ("  -1.5\t2 ", "-1.5;2.0"), ("25.03,121.5", ""), ("25.03 121.5 1", ""), ("N25 121", ""), ("1. 2", ""), (None, "")], lambda t: F.concat_ws(";", *(c.cast("string") for c in names.lat_lon(t))))
worked("address_lists", [("和平路1號（後棟）\n信義路2號;大安區", "和平路1號|信義路2號"), ("甲路1號、甲路1號；乙路2號", "甲路1號|乙路2號"), ("", ""), (None, "")], lambda t: F.array_join(names.address_list(t, F.lit("大安區")), "|"))
worked("address_variant_lists", [
    ("大安區龍泉里和平路二段十五號之3、5", "大安區龍泉里和平路二段十五號之3、5|大安區和平路二段十五號之3、5|大安區和平路二段15號之3、5|大安區和平路二段15號之3號"),
    ("信義路3段12之1、14號", "信義路3段12之1、14號|信義路三段12之1、14號|信義路三段12之1號"),
    ("復興路二十巷五號", "復興路二十巷五號|復興路20巷5號"),
    (None, ""),
], lambda t: F.array_join(names.address_variants(t, F.lit("大安區")), "|"))
worked("first_filled_texts", [(" ", "-"), ("", "-"), (None, "-"), (" a b ", "a b"), ("　x", "x")], lambda t: names.first_filled(t, F.lit(" - ")))
worked("nfkc_texts", [("１２３ＡＢ", "123AB"), ("㈱", "(株)"), ("ﬁ", "fi"), ("a　b", "a b"), ("臺北", "臺北"), ("", ""), (None, None)], names.nfkc)
worked("address_keys", [
    ("臺北市大安區和平東路一段10號五樓", "和平東路一段10號"),
    ("大安區和平東路(雙)12-3號", "和平東路12之3號"),
    ("台北市大安區信義路, 5號之2 三樓", "信義路5號之2"),
    ("大安區大安區公園", "大安區公園"),
    ("", ""),
    (None, ""),
], lambda t: names.normal_address(t, F.lit("臺北市"), F.lit("大安區")))


@pytest.mark.parametrize("name", list(CASES))
def test_text_rule(spark, name):
    cases, rule = CASES[name]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, text string")
    got = {r.k: r.value for r in rows.select("k", rule(F.col("text")).alias("value")).collect()}
    assert [got[k] for k in range(len(cases))] == [v for _, v in cases]
