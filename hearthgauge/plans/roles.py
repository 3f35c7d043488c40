"""The test tables in the roles of the library's inputs, and the same in SQL.

Coordinates are made by integer arithmetic on keys, which every engine evaluates alike.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import unit_cents
from ..sources.scratch import Scratch

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
CATEGORIES = ("medical", "parking", "school", "park", "market", "library", "metro", "rail", "bus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: str) -> Column:
    return F.lit(24.95) + (F.col(key).cast("bigint") * 7919 % 1000) * F.lit(1e-4)


def lon(key: str) -> Column:
    return F.lit(121.45) + (F.col(key).cast("bigint") * 104729 % 1000) * F.lit(1e-4)


def _sql_point(key: str) -> str:
    return f"24.95::DOUBLE + (({key}::BIGINT * 7919) % 1000) * 0.0001::DOUBLE AS lat, 121.45::DOUBLE + (({key}::BIGINT * 104729) % 1000) * 0.0001::DOUBLE AS lon"


def districts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("district"), (F.col("r_regionkey") % 2).alias("city"))


def _order_districts(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("district"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(place, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "district")


def _ages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_size").alias("age"), F.col("p_type").alias("building_type"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its order's customer's region as district. Dimension tables are joined as their sizes allow."""
    li = table(spark, d, "lineitem").join(_order_districts(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).join(_ages(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "district",
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("total_price"),
        F.col("l_quantity").alias("area_ping"),
        "age",
        "building_type",
        (F.col("l_returnflag") == "R").alias("special"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("parking_price"),
        (F.col("l_tax") * 20).alias("parking_area_ping"),
        F.col("l_linestatus").alias("status"),
        lat("l_partkey").alias("lat"),
        lon("l_partkey").alias("lon"),
    )


@contextmanager
def lean_sales(spark: SparkSession, d: str):
    """What comparables want of `sales` but special ones, for as long as it takes to write them.

    Year and price are made before the joins, so few bytes of a sale are dealt. It is dealt twice, by order and by part;
    each time the rows are written, so that the shuffle files of one join are gone when the next one makes its own.
    """
    scratch = Scratch(spark, "lean-sales")
    price, area, discount, tax = (F.col(f"l_{c}") for c in ("extendedprice", "quantity", "discount", "tax"))
    items = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", F.year(F.to_date("l_shipdate")).alias("year"), unit_cents(price, area, price * discount, tax * 20).alias("unit_cents"))
    orders = scratch.save(_order_districts(spark, d), "orders", lean=True)
    sold = scratch.save(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "district", "year", "unit_cents"), "sold", lean=True)
    scratch.drop("orders")
    placed = sold.join(_ages(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    try:
        yield placed.select("district", "year", "unit_cents", "age", "building_type", F.lit(False).alias("special"), lat("l_partkey").alias("lat"), lon("l_partkey").alias("lon"))
    finally:
        scratch.drop("sold")


SALES = f"""sales AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_regionkey AS district, l_shipdate::DATE AS date, l_extendedprice AS total_price, l_quantity AS area_ping, p_size AS age,
  p_type AS building_type, l_returnflag = 'R' AS special, l_extendedprice * l_discount AS parking_price, l_tax * 20 AS parking_area_ping, l_linestatus AS status, {_sql_point('l_partkey')}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def properties(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select(
        F.col("c_custkey").alias("property_id"), F.col("n_regionkey").alias("district"), lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"), (F.col("c_custkey") % 50).cast("int").alias("p_age"), kind.alias("p_type"),
        (F.lit(20000.0) + F.col("c_acctbal")).alias("total_price"), F.lit(10.0).alias("area_ping"), F.lit(1000.0).alias("parking_price"), F.lit(1.5).alias("parking_area_ping"),
    )


_KINDS = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
PROPERTIES = f"""properties AS (SELECT c_custkey AS property_id, n_regionkey AS district, {_sql_point('c_custkey')}, (c_custkey % 50)::INT AS p_age, {_KINDS}[c_custkey % 5 + 1] AS p_type,
  20000.0::DOUBLE + c_acctbal AS total_price, 10.0::DOUBLE AS area_ping, 1000.0::DOUBLE AS parking_price, 1.5::DOUBLE AS parking_area_ping FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def facilities(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("p_partkey") % 9 + 1).cast("int"))
    names = ["elementary", "junior", "senior", "special"]
    held = F.filter(F.array(*(F.when(F.col("p_size") % (k + 2) == 0, F.lit(n)) for k, n in enumerate(names))), lambda x: x.isNotNull())
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 5).cast("int").alias("district"), kind.alias("category"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("name"), held.alias("levels"), F.col("p_brand").alias("brand"), lat("p_partkey").alias("lat"), lon("p_partkey").alias("lon"))


_CATS = "[" + ", ".join(f"'{t}'" for t in CATEGORIES) + "]"
FACILITIES = f"""facilities AS (SELECT p_partkey AS ord, (p_partkey % 5)::INT AS district, {_CATS}[p_partkey % 9 + 1] AS category, p_brand || '-' || p_partkey AS name, p_size, p_brand AS brand, {_sql_point('p_partkey')} FROM part)"""


def accidents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('error', 'purchase')")
    return e.select(F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 5).cast("int").alias("district"), F.when(F.col("event_type") == "error", "A1").otherwise("A2").alias("severity"), (F.lit(2021) + F.dayofmonth("ts") % 3).cast("int").alias("year"), lat("event_id").alias("lat"), lon("event_id").alias("lon"))


ACCIDENTS = f"""accidents AS (SELECT event_id AS id, user_id, (user_id % 5)::INT AS district, CASE WHEN event_type = 'error' THEN 'A1' ELSE 'A2' END AS severity, (2021 + day(ts) % 3)::INT AS year, {_sql_point('event_id')}
  FROM events WHERE event_type IN ('error', 'purchase'))"""


#: Shapes in turn by a row's key, each as rings of corners (x, y) from x, y and half of its width u and height v: a box,
#: one with a hole, one with a notch, a triangle. Corners lie on the lattice of 10^-4 degrees on which the points lie.
_SHAPES = (
    [[("x", "y"), ("x + 2 * u", "y"), ("x + 2 * u", "y + 2 * v"), ("x", "y + 2 * v")]],
    [[("x", "y"), ("x + 2 * u", "y"), ("x + 2 * u", "y + 2 * v"), ("x", "y + 2 * v")], [("x + 5", "y + 5"), ("x + 2 * u - 5", "y + 5"), ("x + 2 * u - 5", "y + 2 * v - 5"), ("x + 5", "y + 2 * v - 5")]],
    [[("x", "y"), ("x + 2 * u", "y"), ("x + u", "y + v"), ("x + 2 * u", "y + 2 * v"), ("x", "y + 2 * v")]],
    [[("x", "y"), ("x + 2 * u", "y + v"), ("x", "y + 2 * v")]],
)
#: By layer: table, key, district, and the least half width. Hazards may overlap, so the first one matters; a zone is its district's only one.
_LAYERS = {"hazards": ("supplier", "s_suppkey", "s_suppkey % 5", 10), "zones": ("nation", "n_nationkey", "n_nationkey", 200)}
_LEVEL = "CASE ord % 7 WHEN 0 THEN 'low' WHEN 1 THEN 'priority' WHEN 2 THEN 'attention' WHEN 3 THEN 'priority' WHEN 4 THEN 'attention' WHEN 5 THEN 'unlisted' ELSE 'low' END"


def _bases(layer: str) -> dict[str, str]:
    _, key, district, least = _LAYERS[layer]
    k = f"CAST({key} AS BIGINT)"
    return {"ord": k, "district": f"CAST({district} AS INT)", "x": f"{k} * 7919 % 900 - {least - 10}", "y": f"{k} * 104729 % 900 - {least - 10}", "u": f"{least} + {k} * 37 % 65", "v": f"{least} + {k} * 53 % 65"}


def _degrees(x: str, y: str) -> tuple[str, str]:
    return f"CAST(121.45 AS DOUBLE) + ({x}) * CAST(0.0001 AS DOUBLE)", f"CAST(24.95 AS DOUBLE) + ({y}) * CAST(0.0001 AS DOUBLE)"


def polygons(spark: SparkSession, d: str, layer: str = "hazards") -> DataFrame:
    """Polygons (ord, district, level, rings), one for each row of the layer's table."""
    corner = lambda x, y: "named_struct('lon', {}, 'lat', {})".format(*_degrees(x, y))
    shapes = ["array(" + ", ".join("array(" + ", ".join(corner(*p) for p in ring) + ")" for ring in rings) + ")" for rings in _SHAPES]
    rings = "CASE ord % 4 " + " ".join(f"WHEN {k} THEN {shape}" for k, shape in enumerate(shapes)) + " END"
    base = table(spark, d, _LAYERS[layer][0]).select(*(F.expr(e).alias(n) for n, e in _bases(layer).items()))
    return base.select("ord", "district", F.expr(_LEVEL).alias("level"), F.expr(rings).alias("rings"))


def _edges_sql(layer: str) -> str:
    base = ", ".join(f"{e} AS {n}" for n, e in _bases(layer).items())
    out = []
    for k, rings in enumerate(_SHAPES):
        for ring in rings:
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                (x1, y1), (x2, y2) = _degrees(*a), _degrees(*b)
                out.append(f"SELECT ord AS pord, district AS pdistrict, {_LEVEL} AS level, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM base WHERE ord % 4 = {k}")
    return f"edges AS (WITH base AS (SELECT {base} FROM {_LAYERS[layer][0]}) " + " UNION ALL ".join(out) + ")"


EDGES, ZONE_EDGES = _edges_sql("hazards"), _edges_sql("zones")
#: Polygons that hold a point of `pts`, by an odd number of crossings or a place on an edge.
HELD = """held AS (SELECT p.pid, p.district, e.pord, e.pdistrict, e.level FROM pts p JOIN edges e ON true GROUP BY ALL
  HAVING count(*) FILTER ((y1 > p_lat) <> (y2 > p_lat) AND p_lon < (x2 - x1) * (p_lat - y1) / (y2 - y1) + x1) % 2 = 1
   OR bool_or((x2 - x1) * (p_lat - y1) - (y2 - y1) * (p_lon - x1) = 0 AND p_lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND p_lat BETWEEN least(y1, y2) AND greatest(y1, y2)))"""
HELD = HELD.replace("SELECT p.pid, p.district, e.pord", "SELECT p.pid, p.district, p.p_lat, p.p_lon, e.pord")


def hav(a: str, b: str) -> str:
    """Great-circle metres between columns lat, lon of two aliases."""
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + pow(sin(radians({b}.lon - {a}.lon) / 2), 2) * cos(radians({a}.lat)) * cos(radians({b}.lat)))"
    return f"(2 * 6371008.8::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def unit_price_sql(total: str = "total_price", area: str = "area_ping", pp: str = "parking_price", pa: str = "parking_area_ping", empty: str = "0.0") -> str:
    net = f"({area} - greatest(0.0::DOUBLE, {pa}))"
    return f"(CASE WHEN {net} > 0 THEN floor(({total} - greatest(0.0::DOUBLE, {pp})) / {net} * 100 + 0.5) / 100 ELSE {empty} END)"
