"""Registered queries of gates and audits by source, and of the index that a stream keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audits as U, lookup as J
from ..sources.scratch import Scratch
from ..streaming import address_index as X
from . import roles as R
from .queries import INDEX, cut, cuts, query
from .records import _pick, raw, raw_sql

# ---- audits ------------------------------------------------------------------------------------------------

SAMPLE = {
    "audit": "user_id % 20",
    "id": "event_id % 400",
    "ord": "event_id",
    "city": _pick("event_id", "'taipei'", "'new-taipei'", "'taipei'", "'new-taipei'", "'elsewhere'"),
    "result": "CASE WHEN event_id % 211 = 7 AND user_id % 3 = 0 THEN 'mismatch' WHEN event_id % 6 = 5 THEN 'inconclusive' ELSE 'matched' END",
    "verification_method": "CASE WHEN event_id % 13 = 3 THEN 'official-map' WHEN event_id % 29 = 1 THEN 'guess' WHEN event_id % 31 = 1 THEN NULL ELSE 'official-raw-offline' END",
    "f1": "CASE WHEN event_id % 37 = 2 THEN NULL ELSE event_id % 19 <> 4 END",
    "f2": "(event_id + user_id) % 23 <> 5",
    "source": _pick("event_id", "'school'", "'library'", "'market'"),
    "building_type": _pick("(event_id * 7919 % 101)", "'apartment'", "'mansion'", "'highrise'"),
    "year": "CAST(2022 + event_id * 31 % 37 % 4 AS INT)",
    "severity": _pick("(event_id * 41 % 43)", "'A1'", "'A2'", "'A2'"),
    "district": "concat('d', event_id * 17 % 23 % 4)",
    "level": _pick("(event_id * 29 % 31)", "'elementary'", "'junior'", "'senior'", "'special'"),
    "market_ownership": _pick("(event_id * 53 % 59)", "'public'", "'private'", "'public'"),
    "case_type": _pick("(event_id * 61 % 67)", "'red'", "'yellow'", "'unknown'", "'red'", "'high'", "'medium'", "'low'", "'uncovered'"),
    "expected_category": _pick("(event_id * 71 % 73)", "'x'", "'y'", "'z'"),
    "observed_category": "CASE WHEN event_id % 47 = 9 THEN 'w' ELSE " + _pick("(event_id * 71 % 73)", "'x'", "'y'", "'z'") + " END",
    "latitude": "CASE WHEN event_id % 41 = 8 THEN CAST(25.123456 AS DOUBLE) ELSE CAST(25.1234 AS DOUBLE) END",
    "longitude": "CAST(121.5 AS DOUBLE)",
    "evidence": "CASE WHEN user_id % 7 = 4 AND event_id % 100 = 3 THEN 'other' ELSE 'ours' END",
}
AUDIT = {"audit": "n_nationkey", "status": "CASE WHEN n_nationkey % 7 = 6 THEN 'pending' ELSE 'passed' END", "adapter_version": "CASE WHEN n_nationkey % 5 = 4 THEN 'v1' ELSE 'v2' END"}


def _samples(spark: SparkSession, d: str) -> DataFrame:
    own = raw(spark, d, "events", SAMPLE)
    names = sorted({f for rule in U.RULES.values() for f in rule.fields})
    # every kind has one field that f1 confirms and one that f2 does; the others always are
    held = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col("f1") if n in ("date", "name", "id") else F.col("f2") if n in ("district", "floor") else F.lit(True) for n in names)))
    return own.withColumns({"fields": held, "school_levels": F.array("level")}).drop("f1", "f2", "level")


def _judged(spark: SparkSession, d: str, kind: str, bound=None) -> DataFrame:
    samples = _samples(spark, d)
    if kind in ("flood", "liquefaction"):
        samples = samples.withColumn("source", F.lit(kind))
    out = U.evaluate(samples, raw(spark, d, "nation", AUDIT), kind, "v2", bound=bound)
    return out.withColumn("methods", F.concat_ws(",", "methods"))


def _audit_sql(least: tuple[int, int], unique: str, matched: str = "true", offline: bool = True, source: str | None = None, bound: str = "true", methods: str = "result = 'matched'", confirmed: str = "f1 AND f2", required: int = 10) -> str:
    """The verdicts of one kind of audit; `unique` and `matched` say what a city's samples cover."""
    where = f"WHERE source = '{source}'" if source else ""
    usual = "AND verification_method = 'official-raw-offline'" if offline else ""
    cities = "city IN ('taipei', 'new-taipei')"
    return f"""WITH s AS (SELECT * FROM ({raw_sql('events', SAMPLE)}) {where}), a AS ({raw_sql('nation', AUDIT)}),
u AS (SELECT * FROM s WHERE result = 'matched' AND {confirmed} {usual} QUALIFY row_number() OVER (PARTITION BY audit, city, id ORDER BY ord DESC) = 1),
w AS (SELECT audit, count(*) FILTER (result = 'mismatch') AS mismatches, count(*) FILTER (NOT ({bound})) AS unbound, string_agg(DISTINCT verification_method, ',' ORDER BY verification_method) FILTER ({methods}) AS methods FROM s GROUP BY 1),
n AS (SELECT audit, count(*) FILTER (city = 'taipei') AS t, count(*) FILTER (city = 'new-taipei') AS nt FROM u GROUP BY 1),
cu AS (SELECT audit, count(*) = 2 AND bool_and(ok) AS ok FROM (SELECT audit, city, {unique} AS ok FROM u WHERE {cities} GROUP BY audit, city) GROUP BY 1),
cm AS (SELECT audit, count(*) = 2 AND bool_and(ok) AS ok FROM (SELECT audit, city, {matched} AS ok FROM s WHERE result = 'matched' AND {cities} GROUP BY audit, city) GROUP BY 1),
j AS (SELECT a.*, coalesce(t, 0) AS t, coalesce(nt, 0) AS nt, mismatches, unbound, methods, coalesce(cu.ok, false) AND coalesce(cm.ok, false) AS covered FROM a LEFT JOIN w USING (audit) LEFT JOIN n USING (audit) LEFT JOIN cu USING (audit) LEFT JOIN cm USING (audit))
SELECT audit, t::BIGINT AS n_taipei, nt::BIGINT AS n_new_taipei, (t + nt)::BIGINT AS sample_count, {required}::INT AS required_count, coalesce(mismatches, 0)::BIGINT AS mismatches, coalesce(unbound, 0)::BIGINT AS unbound, coalesce(methods, '') AS methods, covered,
 coalesce(status = 'passed' AND adapter_version = 'v2' AND mismatches = 0 AND unbound = 0 AND covered AND t >= {least[0]} AND nt >= {least[1]}, false) AS passed FROM j"""


@query(_audit_sql((10, 10), "count(DISTINCT building_type) = 3", offline=False, required=20).replace(" AND coalesce(cm.ok, false)", ""))
def audit_price(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "price")


@query(_audit_sql((4, 5), "true", offline=False, required=9).replace("coalesce(cu.ok, false) AND coalesce(cm.ok, false)", "true"))
def audit_rail(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "rail")


_YEARS = "count(DISTINCT year) FILTER (year IN (2023, 2024, 2025)) = 3 AND count(DISTINCT severity) = 2 AND count(DISTINCT district) >= 3"


@query(_audit_sql((5, 5), _YEARS, bound="evidence = 'ours'", methods="true").replace(" AND coalesce(cm.ok, false)", ""))
def audit_accidents(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "accidents", F.col("evidence") == "ours")


_COVERS = {
    "school": "count(DISTINCT level) = 4",
    "library": "count(DISTINCT district) >= 3",
    "market": "CASE city WHEN 'taipei' THEN count(*) FILTER (market_ownership = 'public') >= 3 AND count(*) FILTER (market_ownership = 'private') >= 2 ELSE count(*) FILTER (market_ownership = 'public') >= 5 END",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS source, * FROM ({_audit_sql((5, 5), 'true', matched, source=k, bound=chr(39) + 'ours' + chr(39) + ' = evidence').replace('coalesce(cu.ok, false) AND', '')})" for k, matched in _COVERS.items()))
def audit_facilities(spark: SparkSession, d: str) -> DataFrame:
    one = lambda kind: _judged(spark, d, kind, F.col("evidence") == "ours").withColumn("source", F.lit(kind))
    return one("school").unionByName(one("library")).unionByName(one("market"))


_FITS = "result = 'matched' AND observed_category = expected_category AND verification_method <> 'guess' AND latitude <> 25.123456::DOUBLE"
_CASES = {
    "flood": "count(*) >= 5 AND count(DISTINCT expected_category) FILTER (case_type = 'red') >= 2 AND count(*) FILTER (case_type = 'yellow') >= 2 AND bool_or(case_type = 'unknown')",
    "liquefaction": "count(*) >= 5 AND count(DISTINCT case_type) FILTER (case_type IN ('high', 'medium', 'low', 'uncovered')) = 4",
}


def _risk_sql(kind: str) -> str:
    whole = _audit_sql((0, 0), "true", offline=False, confirmed="true")
    fits = f"v AS (SELECT * FROM s WHERE {_FITS} QUALIFY row_number() OVER (PARTITION BY audit, city, id ORDER BY ord DESC) = 1),\ncu AS (SELECT audit, count(*) = 2 AND bool_and(ok) AS ok FROM (SELECT audit, city, {_CASES[kind]} AS ok FROM v WHERE"
    start = whole.index("cu AS (")
    return (whole[:start] + fits + whole[whole.index("WHERE", start) + 5 :]).replace("coalesce(cu.ok, false) AND coalesce(cm.ok, false)", "coalesce(cu.ok, false)")


@query(" UNION ALL ".join(f"SELECT '{k}' AS source, * FROM ({_risk_sql(k)})" for k in _CASES))
def audit_risks(spark: SparkSession, d: str) -> DataFrame:
    one = lambda kind: _judged(spark, d, kind).withColumn("source", F.lit(kind))
    return one("flood").unionByName(one("liquefaction"))


@query("""WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS id FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY nation, segment ORDER BY id) = 1 AS first FROM c),
g AS (SELECT *, first AND row_number() OVER (PARTITION BY nation, first ORDER BY id) <= 3 AS chosen FROM f) SELECT nation, segment, id, row_number() OVER (PARTITION BY nation ORDER BY chosen DESC, id)::INT AS slot FROM g QUALIFY slot <= 5""")
def district_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = R.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    return U.district_sample(rows, "nation", "segment", "id")


# ---- gates -------------------------------------------------------------------------------------------------

_PLACED = {
    "source": _pick("o_custkey", "'market'", "'school'", "'park'", "'hospital'"),
    "city": "CASE WHEN o_orderkey % 3 = 0 THEN 'taipei' ELSE 'new-taipei' END",
    "reason": "CASE WHEN o_orderkey % 41 = 0 OR o_custkey % 4 = 1 AND o_orderkey % 39 = 0 THEN 'unmatched' WHEN o_orderkey % 13 = 1 THEN 'invalidCoreFields' WHEN o_orderkey % 17 = 2 AND o_custkey % 4 = 3 THEN 'multipleAddress' WHEN o_custkey % 4 = 2 AND o_orderkey % 3 = 0 THEN 'unmatched' END",
}
_EARLY = {**dict.fromkeys(("market", "school", "park"), ["invalidCoreFields"]), "hospital": ["invalidCoreFields", "multipleAddress"]}


@query(f"""WITH p AS ({raw_sql('orders', _PLACED)}), e AS (SELECT *, reason IS NULL AS ok FROM p WHERE reason IS NULL OR NOT (reason = 'invalidCoreFields' OR reason = 'multipleAddress' AND source = 'hospital')),
r AS (SELECT source, CASE WHEN source = 'park' THEN 1.0::DOUBLE ELSE avg(ok::INT) FILTER (city = 'taipei') END AS t, avg(ok::INT) FILTER (city = 'new-taipei') AS n, avg(ok::INT) AS o FROM e GROUP BY 1),
f AS (SELECT *, CASE WHEN t < 0.95 AND source IN ('market', 'school') THEN 'taipei' WHEN n < 0.95 THEN 'new-taipei' WHEN o < 0.95 AND source <> 'hospital' THEN 'overall' END AS failed_scope FROM r)
SELECT source, {cuts('t', 6)} AS taipei_rate, {cuts('n', 6)} AS new_taipei_rate, {cuts('o', 6)} AS overall_rate, failed_scope, failed_scope IS NULL AS passed FROM f""")
def match_rate_gates(spark: SparkSession, d: str) -> DataFrame:
    rates = ("taipei_rate", "new_taipei_rate", "overall_rate")
    return U.match_gates(raw(spark, d, "orders", _PLACED), _EARLY).select("source", *(cut(F.col(r), 6).alias(r) for r in rates), "failed_scope", "passed")


@query(f"""WITH s AS (SELECT c_custkey AS scenario, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') AS n_invalid FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT *, CASE WHEN n > 0 THEN n_invalid / n ELSE 1.0 END AS rate FROM s)
SELECT scenario, n::BIGINT AS n, n_invalid::BIGINT AS n_invalid, {cuts('rate', 6)} AS invalid_rate, CASE WHEN rate > 0.02 THEN 'invalid_rate' WHEN n = n_invalid THEN 'no_features' END AS fault, NOT (rate > 0.02 OR n = n_invalid) AS passed FROM r""")
def scenario_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = R.table(spark, d, "orders").select(F.col("o_custkey").alias("scenario"), "o_orderstatus")
    out = U.invalid_gate(R.table(spark, d, "customer").select(F.col("c_custkey").alias("scenario")), rows, ["scenario"], F.col("o_orderstatus") == "P")
    return out.withColumn("invalid_rate", cut(F.col("invalid_rate"), 6))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase')::BIGINT AS official_count, count(*) FILTER (event_type = 'error')::BIGINT AS failed_count, count(*)::BIGINT AS n FROM events GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "official").when(F.col("event_type") == "error", "failed").otherwise("stale")
    return U.source_counts(R.table(spark, d, "events").select("user_id", status.alias("status")), ["user_id"])


_STALLS = ["p_size", "-p_size", "p_size * 1000 + p_partkey % 7", "NULL", "p_partkey % 10", "p_size % 3"]
#: Each count as its text in the register: plain, negative, with commas, missing, blank and beside words.
_TEXTS = ["CAST(p_size AS STRING)", "CAST(-p_size AS STRING)", "format_number(p_size * 1000 + p_partkey % 7, 0)", "CAST(NULL AS STRING)", "concat(' ', p_partkey % 10, ' ')", "CASE WHEN p_size % 3 = 0 THEN 'x' ELSE CAST(p_size % 3 AS STRING) END"]


@query(f"""WITH s AS (SELECT replace(CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '台' WHEN 2 THEN p_brand || '臺' ELSE '' END, '台', '臺') AS name, {' + '.join(f'greatest(coalesce({x}, 0), 0)' for x in _STALLS)} AS stalls FROM part)
SELECT name, sum(stalls)::DOUBLE AS stalls, count(*)::BIGINT AS n FROM s WHERE name <> '' GROUP BY 1""")
def stall_classification(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('台北市公有', p_brand) WHEN 1 THEN concat(' ', p_brand, '台') WHEN 2 THEN concat('臺北市公有', p_brand, '臺', '　') ELSE '臺北市公有' END")
    rows = R.table(spark, d, "part").select(name.alias("market"), *(F.expr(x).alias(f"c{k}") for k, x in enumerate(_TEXTS)))
    return U.classify_stalls(rows, "market", [f"c{k}" for k in range(6)]).select("name", F.col("fresh_stalls").alias("stalls"), "n")


# ---- schools by two addresses ------------------------------------------------------------------------------

_REGISTER = {"district": _pick("p_partkey", "'大安區'", "'信義區'", "'中山區'"), "address": "concat('和平路', p_partkey % 40, '號')", "ord": "p_partkey"}
_SCHOOL = {
    "id": "c_custkey",
    "district": _pick("c_custkey", "'大安區'", "'信義區'", "'中山區'"),
    "raw": f"concat('臺北市', {_pick('c_custkey', chr(39) + '大安區' + chr(39), chr(39) + '信義區' + chr(39), chr(39) + '中山區' + chr(39))}, '和平路', c_custkey % 50, {_pick('c_custkey', *(chr(39) + t + chr(39) for t in ('號三樓', '號', '號之1', '號', '號五樓')))})",
    "simple": f"CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat({_pick('c_custkey', chr(39) + '大安區' + chr(39), chr(39) + '信義區' + chr(39), chr(39) + '中山區' + chr(39))}, '福安里和平路', CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 50 ELSE c_custkey * 7 % 50 END, '號') END",
}


@query(f"""WITH raw AS (SELECT *, {R._sql_point('ord')} FROM ({raw_sql('part', _REGISTER)})), firsts AS (SELECT district, address, arg_min(lat, ord) AS lat0, arg_min(lon, ord) AS lon0 FROM raw GROUP BY ALL),
idx AS (SELECT district, address, lat0, lon0, bool_or(sqrt(pow((lat - lat0) * 111000, 2) + pow((lon - lon0) * 101000, 2)) > 9000) AS amb FROM raw JOIN firsts USING (district, address) GROUP BY ALL),
t AS (SELECT id, district, regexp_extract(unnest([raw, simple]), '(和平路[0-9]+號(之1)?)', 1) AS address FROM ({raw_sql('customer', _SCHOOL)})),
h AS (SELECT id, bool_or(amb) AS amb, count(DISTINCT (round(lat0, 7), round(lon0, 7))) AS k, min(lat0) AS lat FROM t JOIN idx USING (district, address) GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN k IS NULL THEN 'unmatched' WHEN amb OR k > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status, CASE WHEN NOT amb AND k = 1 THEN {cuts('lat', 4)} END AS lat FROM customer LEFT JOIN h ON id = c_custkey""")
def school_address_match(spark: SparkSession, d: str) -> DataFrame:
    register = raw(spark, d, "part", _REGISTER).withColumns({"lat": R.lat("ord"), "lon": R.lon("ord")})
    index = J.ambiguity_index(register, ["district", "address"], "ord", 9000.0)
    out = J.lookup_addresses(raw(spark, d, "customer", _SCHOOL), index, ["id"], ["raw", "simple"], F.lit("臺北市"), "district")
    return out.select("id", "match_status", cut(F.col("matched_lat"), 4).alias("lat"))


# ---- the index of a stream ---------------------------------------------------------------------------------


@query(f"WITH {INDEX} SELECT ps_key, is_ambiguous, n::BIGINT AS n, {cuts('lat', 4)} AS lat, {cuts('lon', 4)} AS lon FROM idx")
def address_index_stream(spark: SparkSession, d: str) -> DataFrame:
    """The index of all rows, taken in from files by a stream."""
    rows = R.table(spark, d, "part").select(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("ps_key"), F.col("p_partkey").alias("ord"), R.lat("p_partkey").alias("lat"), R.lon("p_partkey").alias("lon"))
    scratch = Scratch(spark, "address-index")
    files = scratch.save(rows.repartition(4, "ord"), "in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(f"{scratch.root}/in")
    X.follow(X.index_changes(stream, ["ps_key"], "ord", 4000.0), f"{scratch.root}/out", f"{scratch.root}/checkpoint").awaitTermination()
    index = X.current_index(spark.read.parquet(f"{scratch.root}/out"), ["ps_key"])
    return index.select("ps_key", "is_ambiguous", "n", cut(F.col("lat"), 4).alias("lat"), cut(F.col("lon"), 4).alias("lon"))
