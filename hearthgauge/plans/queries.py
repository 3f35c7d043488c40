"""Registered queries: the library's operators on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, names, scalars as S
from ..operators import analysis as A, dedupe as D, documents as M, lookup as J, quality as Q, sampling as W, spatial as G
from ..operators.quantiles import exact_quantiles
from . import roles as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
METRES = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cut(c, places: int = METRES):
    return S.half_up(c, places)


def cuts(x: str, places: int = METRES) -> str:
    return f"floor({x} * 1e{places} + 0.5) / 1e{places}"


# ---- price -------------------------------------------------------------------------------------------------

PAIRS = f"""pairs AS (SELECT p.property_id, s.date, {R.unit_price_sql('s.total_price', 's.area_ping', 's.parking_price', 's.parking_area_ping')} AS u, {R.hav('p', 's')} AS distance
  FROM properties p JOIN sales s ON p.district = s.district AND NOT s.special AND abs(s.age - p.p_age) <= 10 AND s.building_type = p.p_type WHERE abs(s.lat - p.lat) < 0.02 AND abs(s.lon - p.lon) < 0.02),
near AS (SELECT property_id, CASE WHEN count(*) FILTER (distance <= 500) >= 5 THEN 500 ELSE 1000 END AS radius_used FROM pairs WHERE distance <= 1000 GROUP BY 1),
used AS (SELECT pairs.*, radius_used FROM pairs JOIN near USING (property_id) WHERE distance <= radius_used)"""


@query(f"""WITH {R.SALES}, {R.PROPERTIES}, {PAIRS},
q AS (SELECT property_id, quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.5) AS median, quantile_cont(u, 0.75) AS q3, count(*) AS n, max(radius_used) AS r FROM used GROUP BY 1),
o AS (SELECT property_id, {R.unit_price_sql()} AS unit_price FROM properties)
SELECT o.property_id, unit_price, {cuts('median', 4)} AS median, {cuts('q1', 4)} AS q1, {cuts('q3', 4)} AS q3, coalesce(n, 0)::BIGINT AS sample_count,
 CASE WHEN n >= 5 AND median <> 0 THEN {cuts('(unit_price - median) / median * 100', 6)} END AS difference_percent, coalesce(r, 1000)::INT AS radius_used, coalesce(n, 0) < 5 AS insufficient FROM o LEFT JOIN q USING (property_id)""")
def price_analysis(spark: SparkSession, d: str) -> DataFrame:
    with R.lean_sales(spark, d) as sales:
        out = A.price_analysis(R.properties(spark, d), sales)
    return out.withColumns({c: cut(F.col(c), 4) for c in ("median", "q1", "q3")}).withColumn("difference_percent", cut(F.col("difference_percent"), 6))


@query(f"""WITH {R.SALES}, {R.PROPERTIES}, {PAIRS} SELECT property_id, year(date)::INT AS year, {cuts('quantile_cont(u, 0.5)', 4)} AS median, count(*)::BIGINT AS sample_count FROM used GROUP BY ALL""")
def price_trend(spark: SparkSession, d: str) -> DataFrame:
    with R.lean_sales(spark, d) as sales:
        out = A.price_trend(R.properties(spark, d), sales)
    return out.withColumn("median", cut(F.col("median"), 4))


@query(f"""WITH {R.SALES}, {R.PROPERTIES}, {PAIRS}, y AS (SELECT property_id, year(date) AS year, quantile_cont(u, 0.5) AS m, count(*) AS n FROM used GROUP BY ALL)
SELECT property_id, count(*)::INT AS n_years, string_agg(year::VARCHAR, ',' ORDER BY year) FILTER (n < 5) AS low_sample_years, {cuts('max(m)', 4)} AS scale FROM y GROUP BY 1""")
def price_trend_chart(spark: SparkSession, d: str) -> DataFrame:
    with R.lean_sales(spark, d) as sales:
        out = A.price_trend_arrays(R.properties(spark, d), sales)
    return out.select("property_id", F.size("trend").alias("n_years"), F.nullif(F.array_join("low_sample_years", ","), F.lit("")).alias("low_sample_years"), cut(F.col("scale"), 4).alias("scale"))


@query(f"""WITH {R.SALES}, {R.PROPERTIES}, {PAIRS} SELECT property_id, radius_used::INT AS radius_used, count(*)::BIGINT AS n, {cuts('max(distance)')} AS farthest FROM used GROUP BY ALL""")
def comparables_adaptive_radius(spark: SparkSession, d: str) -> DataFrame:
    own = A.comparable_radius(R.properties(spark, d), R.sales(spark, d))
    return own.select("property_id", F.col("radius_used").cast("int").alias("radius_used"), "n", cut(F.col("farthest")).alias("farthest"))


@query(f"""WITH {R.SALES} SELECT building_type, status, count(*)::BIGINT AS n, {cuts('sum(' + R.unit_price_sql() + ')', 1)} AS zero_sum, count({R.unit_price_sql(empty='NULL')})::BIGINT AS n_priced, {cuts('max(' + R.unit_price_sql(empty='NULL') + ')', 2)} AS highest FROM sales GROUP BY ALL""")
def unit_price(spark: SparkSession, d: str) -> DataFrame:
    args = [F.col(c) for c in ("total_price", "area_ping", "parking_price", "parking_area_ping")]
    own = R.sales(spark, d).select("building_type", "status", S.unit_price(*args).alias("u"), S.unit_price_or_null(*args).alias("v"))
    return own.groupBy("building_type", "status").agg(F.count("*").alias("n"), cut(F.sum("u"), 1).alias("zero_sum"), F.count("v").alias("n_priced"), cut(F.max("v"), 2).alias("highest"))


@query("SELECT p_type AS building_type, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1")
def quartiles_by_type(spark: SparkSession, d: str) -> DataFrame:
    parts = R.table(spark, d, "part").select(F.col("p_type").alias("building_type"), "p_retailprice")
    return exact_quantiles(parts, ["building_type"], "p_retailprice", [0.25, 0.5, 0.75]).select("building_type", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


#: Remarks by row: each word that marks a special sale, in a text of other words, words that come near to one, or none.
_REMARKS = [*S.SPECIAL_NOTES.split("|"), "親 友", "增加建物", "政府", "一般買賣"]
_REMARK = "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE concat('備註', l_suppkey, '：', CASE (l_orderkey * 7 + l_linenumber) % {n} {w} END, '交易') END".format(n=len(_REMARKS), w=" ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_REMARKS)))
_ANY = " OR ".join(f"contains(note, '{w}')" for w in S.SPECIAL_NOTES.split("|"))


@query(f"WITH {R.SALES}, n AS (SELECT district, {_REMARK} AS note FROM sales) SELECT district, coalesce({_ANY}, false) AS special, count(*)::BIGINT AS n FROM n GROUP BY ALL")
def special_filter(spark: SparkSession, d: str) -> DataFrame:
    noted = R.sales(spark, d).withColumn("note", F.expr(_REMARK))
    return noted.groupBy("district", S.special_transaction(F.col("note")).alias("special")).agg(F.count("*").alias("n"))


# ---- cascades and quality ----------------------------------------------------------------------------------

REASON = """CASE WHEN status = 'F' AND l_linenumber = 7 THEN 'nonResidentialTarget' WHEN building_type = 'PROMO' THEN 'unsupportedBuilding' WHEN date < DATE '1996-01-01' THEN 'outsideWindow'
 WHEN area_ping <= 1 OR age > 49 THEN 'invalidCoreFields' WHEN l_suppkey % 17 = 0 THEN 'ambiguousAddress' WHEN l_suppkey % 13 = 0 THEN 'unmatchedAddress' WHEN lat > 25.04 THEN 'outOfBounds' END"""
EARLY = ["nonResidentialTarget", "unsupportedBuilding", "outsideWindow", "invalidCoreFields"]
LATE = ["ambiguousAddress", "unmatchedAddress", "outOfBounds"]
REASONED = f"{R.SALES}, r AS (SELECT *, {REASON} AS reason FROM sales)"


def reasoned(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return R.sales(spark, d).withColumn(
        "reason",
        Q.cascade([
            ("nonResidentialTarget", (c("status") == "F") & (c("l_linenumber") == 7)),
            ("unsupportedBuilding", c("building_type") == "PROMO"),
            ("outsideWindow", c("date") < F.lit("1996-01-01").cast("date")),
            ("invalidCoreFields", (c("area_ping") <= 1) | (c("age") > 49)),
            ("ambiguousAddress", c("l_suppkey") % 17 == 0),
            ("unmatchedAddress", c("l_suppkey") % 13 == 0),
            ("outOfBounds", c("lat") > 25.04),
        ]),
    )


@query(f"WITH {REASONED} SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY 1")
def reject_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts_by(reasoned(spark, d), "reason")


_FUNNEL = "count(*)::BIGINT AS seen, count(*) FILTER (reason IS NULL OR reason NOT IN (" + ", ".join(f"'{x}'" for x in EARLY) + "))::BIGINT AS eligible, count(*) FILTER (reason IS NULL)::BIGINT AS matched"
_EXCLUDED = ", ".join(f"count(*) FILTER (reason = '{x}')::BIGINT AS excluded_{x}" for x in EARLY + LATE)


@query(f"WITH {REASONED} SELECT district, {_FUNNEL}, {_EXCLUDED} FROM r GROUP BY 1")
def district_funnel(spark: SparkSession, d: str) -> DataFrame:
    return Q.funnel(reasoned(spark, d), ["district"], "reason", EARLY, LATE)


@query(f"WITH {REASONED} SELECT coalesce(district, -1)::INT AS district, eligible, matched, {cuts('matched / eligible', 6)} AS rate FROM (SELECT district, {_FUNNEL} FROM r GROUP BY ROLLUP (district))")
def matching_rates_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    out = Q.rates(reasoned(spark, d), "district", F.col("reason").isNull(), ~F.coalesce(F.col("reason").isin(*EARLY), F.lit(False)))
    return out.select(F.coalesce("district", F.lit(-1)).alias("district"), "eligible", "matched", cut(F.col("rate"), 6).alias("rate"))


@query(f"WITH {REASONED} SELECT district, eligible, matched FROM (SELECT district, {_FUNNEL} FROM r GROUP BY 1) WHERE matched / eligible < 0.81")
def failing_districts(spark: SparkSession, d: str) -> DataFrame:
    return Q.failing(Q.funnel(reasoned(spark, d), ["district"], "reason", EARLY, LATE), 0.81).select("district", "eligible", "matched")


@query(f"WITH {REASONED} SELECT count(*)::BIGINT AS raw_rows, count(*) FILTER (reason IS NULL)::BIGINT AS accepted, count(reason)::BIGINT AS excluded, count(*) = count(*) FILTER (reason IS NULL) + count(reason) AS reconciled FROM r")
def reconcile_rows(spark: SparkSession, d: str) -> DataFrame:
    return Q.reconciled(reasoned(spark, d), "reason")


@query("""WITH t AS (SELECT user_id % 3 AS grp, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM events GROUP BY 1) SELECT grp::BIGINT AS grp, n::BIGINT AS n, floor(bad / n * 1e6 + 0.5) / 1e6 AS invalid_rate, bad / n <= 0.2 AS passed FROM t""")
def invalid_rate_gate(spark: SparkSession, d: str) -> DataFrame:
    own = R.table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    rate = F.col("bad") / F.col("n")
    return own.select("grp", "n", cut(rate, 6).alias("invalid_rate"), (rate <= 0.2).alias("passed"))


@query("""WITH now AS (SELECT user_id AS id, count(*) AS record_count FROM events GROUP BY 1), old AS (SELECT user_id AS id, count(*) + user_id % 20 AS previous_count FROM events GROUP BY 1)
SELECT id, record_count::BIGINT AS record_count, previous_count::BIGINT AS previous_count FROM now JOIN old USING (id) WHERE record_count < previous_count * 0.9::DOUBLE""")
def record_drop_gate(spark: SparkSession, d: str) -> DataFrame:
    now = R.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("record_count"))
    return Q.drop_check(now, now.withColumn("record_count", F.col("record_count") + F.col("id") % 20), "id").select("id", "record_count", "previous_count")


@query(f"WITH {R.ACCIDENTS} SELECT user_id, {cuts('lat', 4)} AS lat FROM accidents GROUP BY user_id, accidents.lat HAVING count(DISTINCT severity) FILTER (severity IN ('A1', 'A2')) < 2")
def presence_gate(spark: SparkSession, d: str) -> DataFrame:
    return Q.presence(R.accidents(spark, d), ["user_id", "lat"], "severity", ["A1", "A2"]).select("user_id", cut(F.col("lat"), 4).alias("lat"))


# ---- lookups -----------------------------------------------------------------------------------------------

INDEX = """raw AS (SELECT ps_key, ord, lat, lon FROM (SELECT p_brand || '|' || p_size AS ps_key, p_partkey AS ord, {pt} FROM part)),
firsts AS (SELECT ps_key, arg_min(lat, ord) AS lat0, arg_min(lon, ord) AS lon0 FROM raw GROUP BY 1),
idx AS (SELECT ps_key, lat0 AS lat, lon0 AS lon, bool_or(sqrt(pow((raw.lat - lat0) * 111000, 2) + pow((raw.lon - lon0) * 101000, 2)) > 4000) AS is_ambiguous, count(*) AS n FROM raw JOIN firsts USING (ps_key) GROUP BY ALL)""".format(pt=R._sql_point("p_partkey"))


def index(spark: SparkSession, d: str) -> DataFrame:
    rows = R.table(spark, d, "part").select(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("ps_key"), F.col("p_partkey").alias("ord"), R.lat("p_partkey").alias("lat"), R.lon("p_partkey").alias("lon"))
    return J.ambiguity_index(rows, ["ps_key"], "ord", 4000.0)


@query(f"WITH {INDEX} SELECT ps_key, is_ambiguous, n::BIGINT AS n, {cuts('lat', 4)} AS lat, {cuts('lon', 4)} AS lon FROM idx")
def address_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select("ps_key", "is_ambiguous", "n", cut(F.col("lat"), 4).alias("lat"), cut(F.col("lon"), 4).alias("lon"))


@query(f"""WITH {INDEX}, q AS (SELECT l_orderkey, l_linenumber, 'Brand#' || (l_partkey % 30) || '|' || (l_suppkey % 60) AS ps_key FROM lineitem)
SELECT CASE WHEN is_ambiguous IS NULL THEN 'unmatched' WHEN is_ambiguous THEN 'ambiguous' ELSE 'matched' END AS match_status, count(*)::BIGINT AS n FROM q LEFT JOIN idx USING (ps_key) GROUP BY 1""")
def address_lookup_tristate(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("Brand#"), (F.col("l_partkey") % 30).cast("string"), F.lit("|"), (F.col("l_suppkey") % 60).cast("string"))
    rows = R.table(spark, d, "lineitem").select(key.alias("ps_key"))
    return J.lookup(rows, index(spark, d), ["ps_key"]).groupBy("match_status").agg(F.count("*").alias("n"))


_VARIANTS = "SELECT c_custkey, unnest(['Brand#' || (c_custkey % 28) || '|' || (c_custkey % 55), 'Brand#' || (c_custkey % 25) || '|' || (c_custkey % 50)]) AS ps_key FROM customer"


@query(f"""WITH {INDEX}, v AS (SELECT DISTINCT * FROM ({_VARIANTS})), h AS (SELECT c_custkey, bool_or(is_ambiguous) AS a, count(DISTINCT CASE WHEN NOT is_ambiguous THEN round(lat, 7)::VARCHAR || ',' || round(lon, 7) END) AS k FROM v JOIN idx USING (ps_key) GROUP BY 1)
SELECT c_custkey, CASE WHEN a IS NULL THEN 'unmatched' WHEN a OR k > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status FROM customer LEFT JOIN h USING (c_custkey)""")
def multi_variant_match(spark: SparkSession, d: str) -> DataFrame:
    form = lambda m, n: F.concat(F.lit("Brand#"), (F.col("c_custkey") % m).cast("string"), F.lit("|"), (F.col("c_custkey") % n).cast("string"))
    rows = R.table(spark, d, "customer").select("c_custkey", F.array(form(28, 55), form(25, 50)).alias("variants"))
    return J.lookup_variants(rows, index(spark, d), ["c_custkey"], [], "variants", "ps_key").select("c_custkey", "match_status")


@query(f"""WITH {INDEX}, a AS (SELECT c_custkey, 'Brand#' || (c_custkey % 28) || '|' || (c_custkey % 55) AS k1, 'Brand#' || (c_custkey % 25) || '|' || (c_custkey % 50) AS k2 FROM customer),
s AS (SELECT c_custkey, CASE WHEN x.ps_key IS NULL THEN 'unmatched' WHEN x.is_ambiguous THEN 'ambiguous' ELSE 'matched' END AS s1, y.ps_key IS NOT NULL AND NOT y.is_ambiguous AS s2 FROM a LEFT JOIN idx x ON x.ps_key = k1 LEFT JOIN idx y ON y.ps_key = k2)
SELECT c_custkey, CASE WHEN s1 = 'unmatched' AND s2 THEN 'matched' ELSE s1 END AS match_status, CASE WHEN s1 = 'matched' THEN 'address' WHEN s1 = 'unmatched' AND s2 THEN 'landmark' END AS location_method FROM s""")
def priority_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    form = lambda m, n: F.concat(F.lit("Brand#"), (F.col("c_custkey") % m).cast("string"), F.lit("|"), (F.col("c_custkey") % n).cast("string")).alias("ps_key")
    c, idx = R.table(spark, d, "customer"), index(spark, d)
    first, second = (J.lookup(c.select("c_custkey", form(m, n)), idx, ["ps_key"]).drop("ps_key") for m, n in ((28, 55), (25, 50)))
    return J.with_fallback(first, second, ["c_custkey"], only_unmatched=True).select("c_custkey", "match_status", "location_method")


@query("WITH dim AS (SELECT lpad((n_nationkey % 20)::VARCHAR, 3, '0') AS code, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1) SELECT n_name, count(*)::BIGINT AS n FROM (SELECT 'X65' || lpad((o_custkey % 30)::VARCHAR, 3, '0') AS area FROM orders) LEFT JOIN dim ON ends_with(area, code) GROUP BY 1")
def suffix_code_join(spark: SparkSession, d: str) -> DataFrame:
    dim = R.table(spark, d, "nation").select("n_nationkey", "n_name", F.lpad((F.col("n_nationkey") % 20).cast("string"), 3, "0").alias("code"))
    rows = R.table(spark, d, "orders").select(F.concat(F.lit("X65"), F.lpad((F.col("o_custkey") % 30).cast("string"), 3, "0")).alias("area"))
    return J.suffix_join(rows, "area", dim, "code", 3, "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


LABELS = ["widget", "ring", "small", "red", "blue"]


@query("SELECT CASE " + " ".join(f"WHEN contains(p_name, '{x}') THEN '{x}'" for x in LABELS) + " END AS label, count(*)::BIGINT AS n FROM part GROUP BY 1")
def label_contains_join(spark: SparkSession, d: str) -> DataFrame:
    return R.table(spark, d, "part").groupBy(J.label_in_text(F.col("p_name"), LABELS).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH {INDEX}, grp AS (SELECT c_custkey, unnest(range(0, 4)) AS g FROM customer), h AS (SELECT c_custkey, g, i.lat, i.lon FROM grp JOIN idx i ON i.ps_key = 'Brand#' || ((c_custkey + g) % 25) || '|' || ((c_custkey * 7 + g) % 50) AND NOT i.is_ambiguous)
SELECT c_custkey, count(*)::BIGINT AS n_groups, coalesce(CASE WHEN count(*) = 1 THEN min(g) END, -1)::INT AS g FROM h GROUP BY 1""")
def unique_over_districts(spark: SparkSession, d: str) -> DataFrame:
    c = R.table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g"))
    rows = c.withColumn("ps_key", F.concat(F.lit("Brand#"), ((F.col("c_custkey") + F.col("g")) % 25).cast("string"), F.lit("|"), ((F.col("c_custkey") * 7 + F.col("g")) % 50).cast("string"))).withColumn("ord", F.lit(0))
    hits = rows.join(index(spark, d).where("NOT is_ambiguous"), "ps_key")
    return J.one_match_over_groups(hits, ["c_custkey"], "g", "ord").select("c_custkey", "n_groups", F.coalesce("g", F.lit(-1)).alias("g"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.02)")
def referential_check(spark: SparkSession, d: str) -> DataFrame:
    used = R.table(spark, d, "lineitem").where("l_quantity > 49 AND l_discount < 0.02").select(F.col("l_suppkey").alias("s_suppkey"))
    return J.missing_references(R.table(spark, d, "supplier").select("s_suppkey", "s_name"), used, ["s_suppkey"])


@query("SELECT p_type, min(p_partkey) AS p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber <= 2) GROUP BY 1")
def reserve_anti_join(spark: SparkSession, d: str) -> DataFrame:
    used = R.table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_partkey").alias("p_partkey"))
    return J.next_reserve(R.table(spark, d, "part").select("p_partkey", "p_type"), used, "p_partkey", ["p_type"], "p_partkey")


@query("""SELECT r_regionkey AS district, y::INT AS year, count(o_orderkey)::BIGINT AS n FROM region CROSS JOIN (SELECT unnest(range(1995, 2004)) AS y) LEFT JOIN (SELECT o_orderkey, n_regionkey AS k, year(o_orderdate) AS oy FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) ON k = r_regionkey AND oy = y GROUP BY ALL""")
def empty_group_preserve(spark: SparkSession, d: str) -> DataFrame:
    place = R.table(spark, d, "customer").join(R.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("district"))
    rows = R.table(spark, d, "orders").join(place, F.col("o_custkey") == F.col("c_custkey")).select("district", F.year("o_orderdate").alias("year"))
    dim = R.districts(spark, d).select("district").withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2003))))
    return J.preserve_groups(dim, rows, ["district", "year"], {"n": F.count("*")})


@query("""WITH new AS (SELECT s_suppkey AS id, s_suppkey % 4 = 0 AS checked FROM supplier WHERE s_suppkey % 3 <> 0) SELECT id, coalesce(old.checked, false) AS checked, false AS custom FROM (SELECT s_suppkey AS id FROM supplier) f LEFT JOIN new old USING (id) UNION ALL SELECT -1, true, true""")
def checklist_carry_over(spark: SparkSession, d: str) -> DataFrame:
    s = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    old = s.where("id % 3 <> 0").select("id", (F.col("id") % 4 == 0).alias("checked"), F.lit(False).alias("custom")).unionByName(spark.createDataFrame([(-1, True, True)], "id long, checked boolean, custom boolean"))
    return J.carry_over(s.withColumn("custom", F.lit(False)), old, ["id"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 7 = 0")
def upsert_samples(spark: SparkSession, d: str) -> DataFrame:
    c = R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    changes = c.where("id % 5 = 0").unionByName(c.where("id % 7 = 0").select((-F.col("id") - 1).alias("id"))).withColumn("version", F.lit("new"))
    return J.upsert(c.withColumn("version", F.lit("old")), changes, ["id"], True)


# ---- space -------------------------------------------------------------------------------------------------

PTS = "pts AS (SELECT property_id AS pid, district, lat AS p_lat, lon AS p_lon FROM properties)"


def shapes(spark: SparkSession, d: str, layer: str = "hazards") -> DataFrame:
    keys = ["ord", "district", "level"]
    return G.with_bounds(G.edge_table(R.polygons(spark, d, layer), keys), keys)


@query(f"WITH {R.PROPERTIES}, {PTS}, {R.EDGES}, {R.HELD} SELECT pid AS property_id, coalesce(arg_min(held.level, held.pord), 'unknown') AS level FROM pts LEFT JOIN held USING (pid) GROUP BY 1")
def pip_first_match(spark: SparkSession, d: str) -> DataFrame:
    p = R.properties(spark, d).select("property_id", "lat", "lon")
    out = G.first_match(p, G.points_in_polygons(G.places(p), shapes(spark, d)), ["lat", "lon"], "ord", ["level"])
    return out.select("property_id", F.coalesce("level", F.lit("unknown")).alias("level"))


@query(f"WITH {R.PROPERTIES}, {PTS}, {R.EDGES}, {R.HELD} SELECT pid AS property_id, count(held.pord)::BIGINT AS n_districts, CASE count(held.pord) WHEN 0 THEN 'outsideDistrict' WHEN 1 THEN 'accepted' ELSE 'ambiguousDistrict' END AS outcome FROM pts LEFT JOIN held USING (pid) GROUP BY 1")
def pip_district_cardinality(spark: SparkSession, d: str) -> DataFrame:
    p = R.properties(spark, d).select("property_id", "lat", "lon")
    n = G.points_in_polygons(G.places(p), shapes(spark, d)).groupBy("lat", "lon").agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.lit(0))
    return p.join(n, ["lat", "lon"], "left").select("property_id", count.alias("n_districts"), F.when(count == 0, "outsideDistrict").when(count == 1, "accepted").otherwise("ambiguousDistrict").alias("outcome"))


_SEG_T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2))))"


_ZONED = f"pts AS (SELECT c_custkey AS pid, c_nationkey AS district, lat AS p_lat, lon AS p_lon FROM (SELECT *, {R._sql_point('c_custkey')} FROM customer))"


@query(f"""WITH {_ZONED}, {R.ZONE_EDGES}, {R.HELD},
sc AS (SELECT pid, (x1 - p_lon) * cos(radians(p_lat)) * 111000 AS ax, (y1 - p_lat) * 111000 AS ay, (x2 - p_lon) * cos(radians(p_lat)) * 111000 AS bx, (y2 - p_lat) * 111000 AS by_ FROM pts JOIN edges ON pts.district = pdistrict),
dist AS (SELECT pid, min(sqrt(pow(ax + {_SEG_T} * (bx - ax), 2) + pow(ay + {_SEG_T} * (by_ - ay), 2))) AS m FROM sc GROUP BY 1)
SELECT pts.pid AS property_id, {cuts('m', 2)} AS boundary_distance, coalesce(m <= 20 OR bool_or(held.pord IS NOT NULL), false) AS matches FROM pts LEFT JOIN dist USING (pid) LEFT JOIN held ON held.pid = pts.pid AND held.pdistrict = pts.district GROUP BY pts.pid, m""")
def boundary_tolerance(spark: SparkSession, d: str) -> DataFrame:
    points = R.table(spark, d, "customer").select(F.col("c_custkey").alias("property_id"), F.col("c_nationkey").cast("int").alias("district"), R.lat("c_custkey").alias("lat"), R.lon("c_custkey").alias("lon"))
    out = G.in_own_polygon(points, shapes(spark, d, "zones"), ["district"], 20.0)
    return out.select("property_id", cut(F.col("boundary_distance"), 2).alias("boundary_distance"), "matches")


_NEAR = f"near AS (SELECT p.property_id, f.* FROM properties p JOIN facilities f ON p.district = f.district WHERE {R.hav('p', 'f')} <= 1000)"


@query(f"WITH {R.PROPERTIES}, {R.FACILITIES}, {_NEAR} SELECT p.property_id, " + ", ".join(f"count(near.ord) FILTER (category = '{c}')::BIGINT AS n_{c}" for c in (*A.TRANSPORT, *A.LIFE)) + ", count(near.ord) FILTER (category NOT IN ('metro', 'rail', 'bus'))::BIGINT AS facility_count FROM properties p LEFT JOIN near USING (property_id) GROUP BY 1")
def radius_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.radius_counts(R.properties(spark, d), R.facilities(spark, d), 1000)


@query(f"WITH {R.PROPERTIES}, {R.FACILITIES}, m AS (SELECT property_id, category, f.name, f.ord, {R.hav('p', 'f')} AS distance FROM properties p JOIN facilities f ON p.district = f.district) SELECT property_id, category, {cuts('min(distance)')} AS distance, arg_min(name, (distance, ord)) AS name FROM m GROUP BY ALL")
def nearest_facility(spark: SparkSession, d: str) -> DataFrame:
    return A.nearest_facilities(R.properties(spark, d), R.facilities(spark, d)).withColumn("distance", cut(F.col("distance")))


@query(f"WITH {R.PROPERTIES}, {R.FACILITIES}, {_NEAR} SELECT p.property_id, " + ", ".join(f"count(near.ord) FILTER (category = 'school' AND p_size % {k + 2} = 0)::BIGINT AS {v}" for k, v in enumerate(A.SCHOOL_LEVELS)) + " FROM properties p LEFT JOIN near USING (property_id) GROUP BY 1")
def school_level_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.school_levels(R.properties(spark, d), R.facilities(spark, d).where("category = 'school'"), 1000)


@query(f"""WITH {R.PROPERTIES}, {R.ACCIDENTS}, near AS (SELECT p.property_id, a.severity FROM properties p JOIN accidents a ON p.district = a.district WHERE {R.hav('p', 'a')} <= 500), y AS (SELECT district, count(DISTINCT year) AS k, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years FROM accidents GROUP BY 1)
SELECT p.property_id, count(severity)::BIGINT AS total, count(*) FILTER (severity = 'A1')::BIGINT AS a1, count(*) FILTER (severity = 'A2')::BIGINT AS a2, max(years) AS years, floor(count(severity) / max(k) + 0.5)::BIGINT AS annual_average FROM properties p LEFT JOIN near USING (property_id) LEFT JOIN y USING (district) GROUP BY 1""")
def accident_summary(spark: SparkSession, d: str) -> DataFrame:
    out = A.accident_summary(R.properties(spark, d), R.accidents(spark, d), 500)
    return out.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


@query(f"WITH {R.FACILITIES}, s AS (SELECT round(lat, 7) AS a, round(lon, 7) AS b, count(*) AS n FROM facilities GROUP BY ALL) SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, {cuts('sum(n - 1) / sum(n)', 6)} AS rate FROM s")
def dup_coordinate_rate(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_coordinate_rate(R.facilities(spark, d)).withColumn("rate", cut(F.col("rate"), 6))


#: The grid of each polygon's box, with each point's crossings of the edges and its distance from the nearest one.
_INTERIOR = """WITH {edges}, box AS (SELECT pord, min(least(x1, x2)) AS west, max(greatest(x1, x2)) AS east, min(least(y1, y2)) AS south, max(greatest(y1, y2)) AS north FROM edges GROUP BY 1),
spot AS (SELECT pord, xi, yi, west + (east - west) * xi / 40 AS lon, south + (north - south) * yi / 40 AS lat FROM box, range(1, 40) a(xi), range(1, 40) b(yi)),
near AS (SELECT *, cos(radians(lat)) * 111000.0 AS kx FROM spot),
side AS (SELECT near.*, (x1 - lon) * kx AS ax, (y1 - lat) * 111000.0 AS ay, (x2 - lon) * kx - (x1 - lon) * kx AS dx, (y2 - lat) * 111000.0 - (y1 - lat) * 111000.0 AS dy,
  (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 AS crosses,
  (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) AS touches FROM near JOIN edges USING (pord)),
foot AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM side),
far AS (SELECT pord, xi, yi, lon, lat, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS d FROM foot GROUP BY ALL HAVING count(*) FILTER (crosses) % 2 = 1 OR bool_or(touches))"""


@query(f"""{_INTERIOR.format(edges=R.EDGES)} SELECT pord AS ord, {cuts('lon', 6)} AS lon, {cuts('lat', 6)} AS lat, {cuts('d')} AS edge_distance FROM far WHERE d >= 20 QUALIFY row_number() OVER (PARTITION BY pord ORDER BY round(d, 6) DESC, xi, yi) = 1""")
def interior_points(spark: SparkSession, d: str) -> DataFrame:
    out = G.interior_point(shapes(spark, d), ["ord", "district", "level"])
    return out.select("ord", cut(F.col("lon"), 6).alias("lon"), cut(F.col("lat"), 6).alias("lat"), cut(F.col("edge_distance")).alias("edge_distance"))


@query(f"""{_INTERIOR.format(edges=R.ZONE_EDGES + ', ' + R.EDGES.replace('edges AS', 'hazard AS', 1))},
met AS (SELECT far.*, hazard.*, lat AS p_lat, (x1 - lon) * cos(radians(lat)) * 111000 AS ax, (y1 - lat) * 111000 AS ay, (x2 - lon) * cos(radians(lat)) * 111000 AS bx, (y2 - lat) * 111000 AS by_ FROM (SELECT pord AS zone, * EXCLUDE pord FROM far) far JOIN hazard ON zone % 5 = pdistrict),
inside AS (SELECT DISTINCT zone, xi, yi FROM (SELECT zone, xi, yi, pord FROM met GROUP BY ALL HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1
 OR bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)))),
beside AS (SELECT zone, xi, yi, min(sqrt(pow(ax + {_SEG_T} * (bx - ax), 2) + pow(ay + {_SEG_T} * (by_ - ay), 2))) AS m FROM met GROUP BY ALL),
free AS (SELECT far.pord, far.xi, far.yi, lon, lat, round(least(d, coalesce(m, d)), 6) AS d FROM far LEFT JOIN beside ON zone = far.pord AND beside.xi = far.xi AND beside.yi = far.yi WHERE (far.pord, far.xi, far.yi) NOT IN (SELECT zone, xi, yi FROM inside))
SELECT pord AS ord, {cuts('lon', 6)} AS lon, {cuts('lat', 6)} AS lat, {cuts('d')} AS edge_distance FROM free WHERE d >= 20 QUALIFY row_number() OVER (PARTITION BY pord ORDER BY d DESC, xi, yi) = 1""")
def uncovered_points(spark: SparkSession, d: str) -> DataFrame:
    """The point of each zone that is farthest from its border and from the hazards of its part."""
    zones = shapes(spark, d, "zones").withColumn("part", F.col("district") % 5)
    hazards = shapes(spark, d).withColumn("part", F.col("district"))
    out = G.interior_point(zones, ["ord"], excluded=hazards, on=["part"])
    return out.select("ord", cut(F.col("lon"), 6).alias("lon"), cut(F.col("lat"), 6).alias("lat"), cut(F.round("edge_distance", 6)).alias("edge_distance"))


def _series(terms: dict[int, str], outer: str, f: str, inner: str = "1", g: str = "") -> str:
    """The sum of `c * f(2j * outer) * g(2j * inner)` over the terms j: c."""
    return " + ".join(f"({c}) * {f}({2 * j} * {outer})" + (f" * {g}({2 * j} * {inner})" if g else "") for j, c in terms.items())


#: The inverse transverse Mercator projection as SQL over x and y of `p`; n is the third flattening of the ellipsoid.
_BETA = {1: "n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360", 2: "n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440", 3: "17 * n**3 / 480 - 37 * n**4 / 840", 4: "4397 * n**4 / 161280"}
_DELTA = {1: "2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45", 2: "7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45", 3: "56 * n**3 / 15 - 136 * n**4 / 35", 4: "4279 * n**4 / 630"}
_PROJECTED = f"""WITH p AS (SELECT s_suppkey, 300000::DOUBLE + s_suppkey * 37 % 9000 AS x, 2770000::DOUBLE + s_suppkey * 53 % 9000 AS y, 1::DOUBLE / (2 * 298.257222101::DOUBLE - 1) AS n FROM supplier),
r AS (SELECT *, 0.9999::DOUBLE * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) AS radius FROM p),
a AS (SELECT *, y / radius AS xi, (x - 250000) / radius AS eta FROM r),
b AS (SELECT *, xi - ({_series(_BETA, 'xi', 'sin', 'eta', 'cosh')}) AS xi1, eta - ({_series(_BETA, 'xi', 'cos', 'eta', 'sinh')}) AS eta1 FROM a),
c AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM b),
w AS (SELECT s_suppkey, {cuts('(degrees(atan2(sinh(eta1), cos(xi1))) + 121)', 7)} AS lon, {cuts(f"degrees(chi + {_series(_DELTA, 'chi', 'sin')})", 7)} AS lat FROM c)"""


@query(f"""{_PROJECTED} SELECT s_suppkey, lon, lat, coalesce(lat BETWEEN 24.65::DOUBLE AND 25.32::DOUBLE AND lon BETWEEN 121.28::DOUBLE AND 122.02::DOUBLE, false) AS inside FROM w""")
def projected_points(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.lit(300000.0) + F.col("s_suppkey") * 37 % 9000, F.lit(2770000.0) + F.col("s_suppkey") * 53 % 9000
    lon, lat = geo.twd97_to_wgs84(x, y)
    return R.table(spark, d, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat"), S.in_study_area(lat, lon).alias("inside"))


# ---- deduplication and samples -----------------------------------------------------------------------------


@query(f"WITH {R.SALES} SELECT l_orderkey, l_linenumber, total_price, l_partkey FROM sales QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY date DESC, total_price DESC, l_partkey DESC) = 1")
def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return D.last_wins(R.sales(spark, d), ["l_orderkey", "l_linenumber"], ["total_price", "l_partkey"], ["date", "total_price", "l_partkey"])


@query(f"WITH {R.ACCIDENTS} SELECT severity, rn > 1 AS is_duplicate, count(*)::BIGINT AS n FROM (SELECT severity, row_number() OVER (PARTITION BY user_id, year ORDER BY severity, id) AS rn FROM accidents) GROUP BY ALL")
def dedupe_first_wins_count(spark: SparkSession, d: str) -> DataFrame:
    return D.first_wins(R.accidents(spark, d), ["user_id", "year"], ["severity", "id"]).groupBy("severity", "is_duplicate").agg(F.count("*").alias("n"))


@query(f"""WITH {R.FACILITIES}, f AS (SELECT *, first_value(lat) OVER w AS la, first_value(lon) OVER w AS lo, first_value(ord) OVER w AS o FROM facilities WINDOW w AS (PARTITION BY brand ORDER BY ord))
SELECT CASE WHEN ord = o THEN 'accepted' WHEN sqrt(pow((lat - la) * 111000, 2) + pow((lon - lo) * 101000, 2)) <= 2500 THEN 'mergedDuplicate' ELSE 'conflictingDuplicate' END AS outcome, count(*)::BIGINT AS n FROM f GROUP BY 1""")
def library_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return D.merged_or_conflicting(R.facilities(spark, d), ["brand"], "ord", 2500.0).groupBy("outcome").agg(F.count("*").alias("n"))


#: Rows of a group in turn, with the ids and coordinates claimed by the rows accepted so far.
_CLAIMED = f"""WITH RECURSIVE {R.FACILITIES}, r AS (SELECT district, ord % 900 AS ident, round(lat, 7)::VARCHAR || ' ' || round(lon, 7)::VARCHAR AS spot, row_number() OVER (PARTITION BY district ORDER BY ord) AS k FROM facilities),
g(district, k, ids, spots, outcome) AS (SELECT DISTINCT district, 0::BIGINT, []::BIGINT[], []::VARCHAR[], NULL::VARCHAR FROM r UNION ALL
  SELECT district, k, CASE WHEN outcome = 'accepted' THEN list_append(ids, ident) ELSE ids END, CASE WHEN outcome = 'accepted' THEN list_append(spots, spot) ELSE spots END, outcome FROM (
    SELECT r.*, g.ids, g.spots, CASE WHEN list_contains(g.ids, r.ident) THEN 'duplicateId' WHEN list_contains(g.spots, r.spot) THEN 'duplicateCoordinate' ELSE 'accepted' END AS outcome FROM g JOIN r ON r.district = g.district AND r.k = g.k + 1))"""


@query(f"{_CLAIMED} SELECT district, outcome, count(*)::BIGINT AS n FROM g WHERE k > 0 GROUP BY ALL")
def facility_greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = R.facilities(spark, d).select("district", (F.col("ord") % 900).alias("ident"), "ord", "lat", "lon")
    return D.greedy_unique(rows, ["district"], "ident", "ord").groupBy("district", "outcome").agg(F.count("*").alias("n"))


def _merged_sql(keys: str, where: str, metres: float) -> str:
    """`c`: clusters (keys, lat, lon, n, codes as a list). Rows in turn begin a cluster unless one begun before is near;
    each row is of the first cluster near it."""
    same = " AND ".join(f"r.{k} = g.{k}" for k in keys.split(", "))
    near = f"sqrt(pow((r.lat - h.lat) * 111000.0, 2) + pow((r.lon - h.lon) * 101000.0, 2)) <= {metres}"
    return f"""WITH RECURSIVE {R.FACILITIES}, r AS (SELECT {keys}, ord, lat, lon, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS k FROM facilities WHERE {where}),
g({keys}, k, heads) AS (SELECT {keys}, k, [{{'lat': lat, 'lon': lon}}] FROM r WHERE k = 1 UNION ALL
  SELECT {', '.join(f'r.{k}' for k in keys.split(', '))}, r.k, CASE WHEN len(list_filter(g.heads, lambda h: {near})) > 0 THEN g.heads ELSE list_append(g.heads, {{'lat': r.lat, 'lon': r.lon}}) END FROM g JOIN r ON {same} AND r.k = g.k + 1),
e AS (SELECT {keys}, arg_max(heads, k) AS heads FROM g GROUP BY ALL),
o AS (SELECT {', '.join(f'r.{k}' for k in keys.split(', '))}, r.ord, list_filter(g.heads, lambda h: {near})[1] AS h FROM r JOIN e g ON {same}),
c AS (SELECT {keys}, h.lat AS lat, h.lon AS lon, count(*)::BIGINT AS n, list_sort(list(ord::VARCHAR)) AS codes FROM o GROUP BY {keys}, h)"""


@query(f"{_merged_sql('brand', 'true', 1500.0)} SELECT brand, n, {cuts('lat', 4)} AS lat, {cuts('lon', 4)} AS lon, array_to_string(codes, ',') AS codes FROM c")
def rail_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = R.facilities(spark, d).select("brand", F.col("ord").cast("string").alias("code"), "ord", "lat", "lon")
    out = D.greedy_merge(rows, ["brand"], "ord", "code", 1500.0)
    return out.select("brand", "n", cut(F.col("lat"), 4).alias("lat"), cut(F.col("lon"), 4).alias("lon"), F.array_join("codes", ",").alias("codes"))


@query(f"{_merged_sql('district, brand', "category = 'school'", 3000.0)} SELECT district, brand, n, array_to_string(codes, '+') AS codes, substring(sha256(district || '|' || trim(brand) || '|' || array_to_string(codes, '+')), 1, 24) AS id FROM c")
def campus_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = R.facilities(spark, d).where("category = 'school'").select("district", "brand", F.col("ord").cast("string").alias("code"), "ord", "lat", "lon")
    out = D.greedy_merge(rows, ["district", "brand"], "ord", "code", 3000.0)
    return out.select("district", "brand", "n", F.array_join("codes", "+").alias("codes"), S.stable_id(F.col("district").cast("string"), F.col("brand"), F.array_join("codes", "+")).alias("id"))


@query("""WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS s FROM part), q AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN s <= 3 AND p_type IN ('SMALL', 'LARGE', 'PROMO') THEN 0 ELSE 1 END, p_partkey) AS p FROM r),
x AS (SELECT *, p <= 10 AS pr, row_number() OVER (PARTITION BY p <= 10 ORDER BY p_partkey) AS rr FROM q) SELECT p_partkey, p_type, CASE WHEN pr THEN 'primary' ELSE 'reserve' END AS role FROM x WHERE pr OR rr <= 20""")
def audit_sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return W.stratified(R.table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 3, 10, 20, values=["SMALL", "LARGE", "PROMO"])


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5")
def topk_per_city(spark: SparkSession, d: str) -> DataFrame:
    return W.top_per_group(R.table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 5)


QUOTAS = [("year = 2021", 1), ("year = 2022", 1), ("year = 2023", 2), ("severity = 'A1'", 1), ("severity = 'A2'", 1)]


def _sample_sql(total: int) -> str:
    """The turns one after another: each takes from what those before it left."""
    steps, left = [f"WITH {R.ACCIDENTS}, l0 AS (SELECT district, id, year, severity FROM accidents)"], "l0"
    for k, (condition, n) in enumerate(QUOTAS):
        steps.append(f"t{k} AS (SELECT *, {k} AS slot FROM {left} WHERE {condition} QUALIFY row_number() OVER (PARTITION BY district ORDER BY id) <= {n})")
        steps.append(f"l{k + 1} AS (SELECT * FROM {left} ANTI JOIN t{k} USING (district, id))")
        left = f"l{k + 1}"
    every = " UNION ALL ".join([f"SELECT * FROM t{k}" for k in range(len(QUOTAS))] + [f"SELECT *, {len(QUOTAS)} FROM {left}"])
    return ", ".join(steps) + f", e AS ({every}) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY district ORDER BY slot, id) <= {total}"


@query(_sample_sql(8))
def accident_sample(spark: SparkSession, d: str) -> DataFrame:
    return W.prioritised(R.accidents(spark, d).select("district", "id", "year", "severity"), ["district"], QUOTAS, "id", 8)


@query("""WITH f AS (SELECT p_brand, arg_min(p_type, p_partkey) AS t FROM part GROUP BY 1) SELECT p_brand, p_partkey, p_type FROM part JOIN f USING (p_brand) QUALIFY row_number() OVER (PARTITION BY p_brand, p_type = t ORDER BY p_partkey) = 1""")
def risk_sample_categories(spark: SparkSession, d: str) -> DataFrame:
    return W.different_second(R.table(spark, d, "part").select("p_brand", "p_partkey", "p_type"), ["p_brand"], "p_type", "p_partkey").select("p_brand", "p_partkey", "p_type")


# ---- scalars -----------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS day, (year(o_orderdate) - 1911)::VARCHAR || strftime(o_orderdate, '%m%d') AS txt FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS parsed FROM t""")
def roc_date_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    text = F.concat((F.year(day) - 1911).cast("string"), F.lit("/"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("1345")).otherwise(F.date_format(day, "MMdd")))
    return R.table(spark, d, "orders").select("o_orderkey", S.roc_date(text).cast("string").alias("parsed"))


@query("SELECT p_partkey, substring(sha256(trim(p_name) || '|' || coalesce(nullif(p_brand, 'Brand#2'), '') || '|' || p_size), 1, 24) AS id, sha256(sha256(p_name) || ':' || sha256(p_brand)) AS composite FROM part")
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("\t　"), F.col("p_name"), F.lit(" "))
    return R.table(spark, d, "part").select("p_partkey", S.stable_id(name, F.nullif("p_brand", F.lit("Brand#2")), S.number_text(F.col("p_size").cast("double"))).alias("id"), S.composite_hash(F.sha2("p_name", 256), F.sha2("p_brand", 256)).alias("composite"))


@query(r"SELECT doc_id, length(regexp_replace(replace(coalesce(text, ''), '台', '臺'), '[\s]+', '', 'g'))::INT AS n, sha256(regexp_replace(coalesce(text, ''), '[\s]+', '', 'g')) AS digest FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = names.plain_text(F.col("text"))
    return R.table(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("digest"))


@query("SELECT p_partkey, '信義路' || p_size || '號之3' AS address FROM part")
def normalize_text_nfkc(spark: SparkSession, d: str) -> DataFrame:
    own = R.table(spark, d, "part").select("p_partkey", names.nfkc(F.concat(F.lit("臺北市大安區（信義路"), F.col("p_size").cast("string"), F.lit("號－３）內"))).alias("a"))
    return own.select("p_partkey", names.normal_address(F.col("a"), F.lit("臺北市"), F.lit("大安區")).alias("address"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import json_path

    return R.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(json_path(F.col("props"), "$.k", "bigint")).alias("total"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'attention' WHEN 4 THEN NULL ELSE 'priority' END AS depth, CASE p_size % 3 WHEN 0 THEN 'priority' WHEN 1 THEN 'attention' ELSE 'low' END AS liquefaction, [6, 12, 24][p_size % 3 + 1]::INT AS hours, [150, 200, 650][p_size % 3 + 1]::INT AS millimetres FROM part")
def hazard_levels(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_size") % n + 1).cast("int"))
    scenario = pick(["6h-150", "12h-200", "24h-650"], 3)
    return R.table(spark, d, "part").select("p_partkey", S.depth_level(pick(["0.3-0.5", "0.5-1.0", "1.0-2.0", ">3.0", "none"], 5)).alias("depth"), S.liquefaction_level((F.col("p_size") % 3 + 1).cast("string")).alias("liquefaction"), S.scenario_hours(scenario).alias("hours"), S.scenario_millimetres(scenario).alias("millimetres"))


@query("""WITH r AS (SELECT o_custkey AS id, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
s AS (SELECT id, unnest(generate_series(date_trunc('quarter', a)::DATE, b, INTERVAL 3 MONTH)) AS q FROM r)
SELECT id, (year(q) - 1911)::VARCHAR || 'S' || quarter(q) AS season, row_number() OVER (PARTITION BY id ORDER BY q) AS n FROM s""")
def season_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Seasons from each customer's first order to the last."""
    day = F.to_date("o_orderdate")
    span = R.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return span.select("id", F.posexplode(M.seasons(F.col("a"), F.col("b"))).alias("k", "season")).select("id", "season", (F.col("k") + 1).cast("long").alias("n"))


@query("SELECT p_partkey, p_size + 0.0::DOUBLE AS sqm, floor(p_size / 3.305785::DOUBLE * 100 + 0.5) / 100 AS ping, greatest(0, floor(date_diff('day', DATE '1990-01-01' + p_size::INT * 100, DATE '2000-01-01') / 365.25::DOUBLE))::INT AS age FROM part")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    built = F.date_add(F.lit("1990-01-01").cast("date"), F.col("p_size") * 100)
    return R.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("sqm"), S.sqm_to_ping(F.col("p_size").cast("double")).alias("ping"), S.age_years(F.lit("2000-01-01").cast("date"), built).alias("age"))


# ---- results and documents ---------------------------------------------------------------------------------

_STATES = "states AS (SELECT r_regionkey AS district, id, CASE (r_regionkey * 3 + k * k) % 4 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'stale' ELSE 'official' END AS status, '2026-0' || (1 + (r_regionkey + k) % 7) || '-01' AS updated_at FROM region, (SELECT unnest(['metro', 'rail', 'bus', 'accidents', 'medical', 'parking', 'school', 'park', 'market', 'library']) AS id, unnest(range(0, 10)) AS k))"


def states(spark: SparkSession, d: str) -> DataFrame:
    ids = [*A.TRANSPORT, "accidents", *A.LIFE]
    rows = R.districts(spark, d).select("district", F.posexplode(F.array(*map(F.lit, ids))).alias("k", "id"))
    m = (F.col("district") * 3 + F.col("k") * F.col("k")) % 4
    return rows.select("district", "id", F.when(m == 0, "unavailable").when(m == 1, "stale").otherwise("official").alias("status"), F.concat(F.lit("2026-0"), (1 + (F.col("district") + F.col("k")) % 7).cast("string"), F.lit("-01")).alias("updated_at"))


@query(f"WITH {_STATES}, c AS (SELECT district, count(*) FILTER (status <> 'unavailable' AND id IN ('metro', 'rail', 'bus', 'accidents')) AS t, count(*) FILTER (status <> 'unavailable' AND id NOT IN ('metro', 'rail', 'bus', 'accidents')) AS l FROM states GROUP BY 1) SELECT district, t::BIGINT AS transport, l::BIGINT AS life, CASE WHEN t = 4 THEN 'official' WHEN t > 0 THEN 'partial' ELSE 'unavailable' END AS transport_availability, CASE WHEN l = 6 THEN 'official' WHEN l > 0 THEN 'partial' ELSE 'unavailable' END AS life_availability FROM c")
def decision_availability(spark: SparkSession, d: str) -> DataFrame:
    return A.dimension_availability(states(spark, d), ["district"])


@query(f"WITH {_STATES} SELECT district, count(*) FILTER (status = 'official')::BIGINT AS official_count, CASE WHEN count(*) FILTER (status = 'official') = 0 THEN 'unavailable' WHEN bool_and(status = 'official') THEN 'official' ELSE 'mixed' END AS data_quality FROM states GROUP BY 1")
def data_quality_class(spark: SparkSession, d: str) -> DataFrame:
    return A.data_quality(states(spark, d), ["district"])


@query(f"WITH {_STATES} SELECT district, coalesce(max(updated_at) FILTER (status = 'official'), '2026-01-01') AS updated_at FROM states GROUP BY 1")
def source_latest_update(spark: SparkSession, d: str) -> DataFrame:
    return M.latest_update(states(spark, d), ["district"], F.lit("2026-01-01"))


@query("SELECT c_custkey, floor(((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0)::INT + (c_acctbal > 0)::INT + 1) * 100 / 6 + 0.5)::INT AS completeness FROM customer")
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    signals = [F.col("c_custkey") % k == 0 for k in (2, 3, 5, 7)] + [F.col("c_acctbal") > 0, F.lit(True)]
    return R.table(spark, d, "customer").select("c_custkey", A.completeness(*signals).alias("completeness"))


_LV = "['priority', 'attention', 'unknown', 'low']"


@query(f"""WITH c AS (SELECT c_custkey, {_LV}[c_custkey % 4 + 1] AS f, {_LV}[c_custkey % 3 + 2] AS l FROM customer) SELECT c_custkey, CASE WHEN 'priority' IN (f, l) THEN 'priority' WHEN 'unknown' IN (f, l) THEN 'unknown' WHEN 'attention' IN (f, l) THEN 'attention' ELSE 'low' END AS disaster,
 CASE WHEN c_custkey % 6 = 0 OR c_custkey % 11 < 5 THEN 'unknown' WHEN c_custkey % 61 - 30 > 20 THEN 'priority' WHEN c_custkey % 61 - 30 > 8 OR c_custkey % 61 - 30 < -20 THEN 'attention' ELSE 'low' END AS price, CASE WHEN c_custkey % 11 < 5 THEN 'low' WHEN c_custkey % 11 < 10 THEN 'medium-low' ELSE 'medium' END AS confidence FROM c""")
def risk_levels_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    level = lambda n: F.element_at(F.array(*map(F.lit, ("priority", "attention", "unknown", "low"))), n.cast("int"))
    return R.table(spark, d, "customer").select("c_custkey", S.disaster_level(level(k % 4 + 1), level(k % 3 + 2)).alias("disaster"), S.price_level(k % 6 != 0, k % 11 < 5, (k % 61 - 30).cast("double")).alias("price"), S.confidence_band(k % 11).alias("confidence"))


@query(f"""WITH c AS (SELECT c_custkey AS k, {_LV}[c_custkey % 4 + 1] AS f, {_LV}[c_custkey % 3 + 2] AS l, c_custkey % 11 < 5 AS ins, c_custkey % 61 - 30 AS pct, c_custkey % 2 AS acc FROM customer),
i AS (SELECT k, 0 AS seq, 'flood' AS id, f AS level FROM c WHERE f <> 'low' UNION ALL SELECT k, 1, 'liquefaction', l FROM c WHERE l <> 'low' UNION ALL SELECT k, 2, 'price', CASE WHEN ins THEN 'unknown' ELSE 'attention' END FROM c WHERE ins OR pct > 10
 UNION ALL SELECT k, 3, 'traffic', 'attention' FROM c WHERE acc > 0 UNION ALL SELECT k, 4, 'repair', 'attention' FROM c UNION ALL SELECT k, 5, 'fund', 'attention' FROM c UNION ALL SELECT k, 6, 'license', 'attention' FROM c)
SELECT k AS c_custkey, string_agg(id || ':' || level, ',' ORDER BY CASE level WHEN 'priority' THEN 0 WHEN 'attention' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, seq) AS items FROM i GROUP BY 1""")
def checklist_ranked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    level = lambda n: F.element_at(F.array(*map(F.lit, ("priority", "attention", "unknown", "low"))), n.cast("int"))
    items = A.checklist(level(k % 4 + 1), level(k % 3 + 2), k % 11 < 5, (k % 61 - 30).cast("double"), k % 2)
    return R.table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(items, lambda x: F.concat(x["id"], F.lit(":"), x["level"])), ",").alias("items"))


@query("SELECT metric, max(v) FILTER (k = 1) AS p1, max(v) FILTER (k = 2) AS p2, max(v) FILTER (k = 3) AS p3 FROM (SELECT s_suppkey AS k, unnest(['balance', 'nation']) AS metric, unnest([s_acctbal, s_nationkey::DOUBLE]) AS v FROM supplier WHERE s_suppkey IN (1, 2, 3)) GROUP BY 1")
def comparison_pivot(spark: SparkSession, d: str) -> DataFrame:
    own = R.table(spark, d, "supplier").where("s_suppkey IN (1, 2, 3)").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return A.comparison(own, "s_suppkey", ["balance", "nation"], [1, 2, 3]).withColumnsRenamed({"1": "p1", "2": "p2", "3": "p3"})


_SAMPLES = "samples AS (SELECT user_id % 4 AS city, user_id AS id, event_id AS ord, CASE WHEN event_id % 97 = 0 THEN 'mismatch' WHEN event_id % 5 = 0 THEN 'inconclusive' ELSE 'matched' END AS result, event_type AS kind FROM events)"


@query(f"WITH {_SAMPLES}, last AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY city, id ORDER BY ord DESC) = 1), c AS (SELECT city, count(*) FILTER (result = 'matched') AS m, count(*) FILTER (result = 'mismatch') AS x, count(DISTINCT kind) FILTER (result = 'matched') AS k FROM last GROUP BY 1) SELECT city, m::BIGINT AS matched, x::BIGINT AS mismatched, k::BIGINT AS kinds, m >= 10 AND x = 0 AND k >= 3 AS passed FROM c")
def audit_evaluate(spark: SparkSession, d: str) -> DataFrame:
    e = R.table(spark, d, "events")
    rows = e.select((F.col("user_id") % 4).alias("city"), F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 97 == 0, "mismatch").when(F.col("event_id") % 5 == 0, "inconclusive").otherwise("matched").alias("result"), F.col("event_type").alias("kind"))
    return Q.evaluate_audit(rows, "city", "id", "ord", 10, "kind", 3)


@query(f"WITH {R.PROPERTIES}, {PTS}, {R.EDGES}, {R.HELD}, n AS (SELECT pts.pid, count(held.pord) AS k, min(held.level) AS lv FROM pts LEFT JOIN held USING (pid) GROUP BY 1) SELECT pid AS property_id, k::BIGINT AS n_matches, CASE WHEN k = 0 THEN 'unconfirmed' WHEN k > 1 THEN 'blocked' WHEN lv IN ('priority', 'attention') THEN 'resolved' ELSE 'blocked' END AS evidence, CASE WHEN k = 1 AND lv IN ('priority', 'attention') THEN lv END AS category FROM n")
def evidence_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = R.properties(spark, d).select("property_id", "lat", "lon")
    return Q.resolve_evidence(p, G.points_in_polygons(G.places(p), shapes(spark, d)), ["property_id"], "level", ["priority", "attention"], by=["lat", "lon"])


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS reason FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def readiness_merge(spark: SparkSession, d: str) -> DataFrame:
    n = R.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return M.merge_readiness(n.where("id % 2 = 0").withColumn("reason", F.lit("old")), n.where("id % 3 = 0").withColumn("reason", F.lit("new")))


@query("SELECT conv_id, turn, coalesce(v, 0)::INT AS version, " + ", ".join((f"coalesce(CASE WHEN conv_id % 3 = 0 THEN conv_id % 2 = 0 END, coalesce(v, 2) < {n})" if k == "life" else f"coalesce(v, 2) < {n}") + f" AS legacy_{k}" for k, n in M.LEGACY_BEFORE.items()) + " FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL ELSE (turn + 1)::INT END AS v FROM conversations) WHERE v IS NULL OR v BETWEEN 2 AND 8")
def migration_flags(spark: SparkSession, d: str) -> DataFrame:
    saved = R.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, (F.col("turn") + 1).cast("int")).alias("version"), F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") % 2 == 0).alias("legacy_life"))
    return M.migrate(saved).drop("version_now").withColumn("version", F.coalesce("version", F.lit(0)))


@query("SELECT user_id AS id, user_id % 4 <> 0 AS skip FROM events GROUP BY 1")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    now = R.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.sha2(F.count("*").cast("string"), 256).alias("digest"))
    before = now.withColumn("digest", F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("digest")))
    return M.unchanged(now, before, "id", "digest").select("id", "skip")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderdate::DATE >= DATE '2001-08-01' - 1826)::BIGINT AS kept, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def retention_window(spark: SparkSession, d: str) -> DataFrame:
    kept = M.retention(F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date"))
    return R.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(kept).alias("kept"), F.count("*").alias("n"))


@query()
def full_analysis(spark: SparkSession, d: str) -> DataFrame:
    p = R.properties(spark, d)
    spots = p.select("property_id", "lat", "lon")
    hazard = lambda layer: G.first_match(spots, G.points_in_polygons(G.places(spots), shapes(spark, d, layer)), ["lat", "lon"], "ord", ["level"]).select("property_id", F.col("level"))
    hazards = hazard("hazards").withColumnRenamed("level", "flood").join(hazard("zones").withColumnRenamed("level", "liquefaction"), "property_id")
    sources = states(spark, d).select("district", "id", "status")
    out = A.analyse(p, R.sales(spark, d), R.facilities(spark, d), R.accidents(spark, d), hazards, sources)
    return out.select("property_id", F.col("price.sample_count").alias("sample_count"), F.size("price.trend").alias("n_years"), "flood", "liquefaction", "completeness", "data_quality", F.size("checklist").alias("n_checks"), F.to_json("accidents").alias("accidents"))


from . import overlays, records, texts, upkeep  # noqa: E402, F401  (register the queries over polygons, raw records, texts, gates and audits)
