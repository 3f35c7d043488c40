"""Lookup joins that keep apart what is found, ambiguous and missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import planar
from ..functions.names import address_variants, nfkc, normal_address


def ambiguity_index(rows: DataFrame, keys: list[str], order: Column | str, tolerance: float) -> DataFrame:
    """Per key: the first coordinate (lat, lon) by `order`, and whether another lies more than `tolerance` metres off.

    The first coordinate is a minimum, joined back to the rows; both steps combine before they shuffle.
    """
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), order).alias("first"))
    far = planar(F.col("lat"), F.col("lon"), F.col("first.lat"), F.col("first.lon")) > tolerance
    return rows.join(first, keys).groupBy(*keys).agg(F.min("first").alias("first"), F.max(far).alias("is_ambiguous"), F.count("*").alias("n")).select(*keys, F.col("first.lat").alias("lat"), F.col("first.lon").alias("lon"), "is_ambiguous", "n")


def status(present: Column, ambiguous: Column) -> Column:
    return F.when(present.isNull(), "unmatched").when(ambiguous, "ambiguous").otherwise("matched")


def lookup(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with match_status and, where matched, the index's lat and lon. The index's size decides the kind of join."""
    found = index.select(*keys, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "is_ambiguous", F.lit(True).alias("__found"))
    out = rows.join(found, keys, "left").withColumn("match_status", status(F.col("__found"), F.col("is_ambiguous")))
    hit = F.col("match_status") == "matched"
    return out.withColumns({"matched_lat": F.when(hit, F.col("__lat")), "matched_lon": F.when(hit, F.col("__lon"))}).drop("__lat", "__lon", "__found", "is_ambiguous")


def lookup_variants(rows: DataFrame, index: DataFrame, key: list[str], on: list[str], variants: str, name: str, places: int = 7) -> DataFrame:
    """Per row (`key`) with an array of `variants`: status over all variants' hits in `index` (on, name).

    Any ambiguous hit makes it ambiguous, and so do hits at different coordinates (rounded to `places`).
    """
    each = rows.select(*key, *on, F.explode(F.array_distinct(variants)).alias(name))
    hits = each.join(index.select(*on, name, "lat", "lon", "is_ambiguous"), [*on, name])
    rounded = F.struct(F.round("lat", places).alias("lat"), F.round("lon", places).alias("lon"))
    found = hits.groupBy(*key).agg(F.max("is_ambiguous").alias("__any"), F.min(F.when(~F.col("is_ambiguous"), rounded)).alias("__low"), F.max(F.when(~F.col("is_ambiguous"), rounded)).alias("__high"))
    out = rows.join(found, key, "left")
    several = F.col("__any") | (F.col("__low") != F.col("__high"))
    state = status(F.col("__any"), several)
    return out.withColumn("match_status", state).withColumns({"matched_lat": F.when(state == "matched", F.col("__low.lat")), "matched_lon": F.when(state == "matched", F.col("__low.lon"))}).drop("__any", "__low", "__high")


def lookup_addresses(rows: DataFrame, index: DataFrame, key: list[str], addresses: list[str], city: Column, district: str, name: str = "address") -> DataFrame:
    """`rows` located by one or more of their address texts (as written, as simplified) in `index` (district, name).

    Each text is looked up in all the ways in which it may stand in the register. What all texts hit is judged together:
    any ambiguous hit makes the row ambiguous, and so do hits at different coordinates. Null and blank texts hit nothing.
    """
    ways = lambda a: F.transform(address_variants(nfkc(F.col(a)), F.col(district)), lambda v: normal_address(v, city, F.col(district)))
    forms = F.filter(F.flatten(F.array(*map(ways, addresses))), lambda v: v != "")
    return lookup_variants(rows.withColumn("__forms", forms), index, key, [district], "__forms", name).drop("__forms")


def with_fallback(first: DataFrame, second: DataFrame, key: list[str], only_unmatched: bool = False) -> DataFrame:
    """`first` (a lookup's result) with `second`'s coordinate where the first gave none, and location_method.

    only_unmatched: an ambiguous first lookup is final.
    """
    other = second.where("match_status = 'matched'").select(*key, F.col("matched_lat").alias("__lat"), F.col("matched_lon").alias("__lon"))
    out = first.join(other, key, "left")
    own = F.col("match_status") == "matched"
    may = (F.col("match_status") == "unmatched") if only_unmatched else ~own
    take = may & F.col("__lat").isNotNull()
    method = F.when(own, "address").when(take, "landmark")
    state = F.when(take, "matched").otherwise(F.col("match_status"))
    return out.select(*key, state.alias("match_status"), method.alias("location_method"), F.when(take, F.col("__lat")).otherwise(F.col("matched_lat")).alias("matched_lat"), F.when(take, F.col("__lon")).otherwise(F.col("matched_lon")).alias("matched_lon"))


def one_match_over_groups(hits: DataFrame, key: list[str], group: str, order: str) -> DataFrame:
    """Per key: the first hit (lat, lon) of each group by `order`, kept only if all groups with a hit agree on one row."""
    firsts = hits.groupBy(*key, group).agg(F.min(F.struct(order, "lat", "lon")).alias("m"))
    one = firsts.groupBy(*key).agg(F.count("*").alias("n_groups"), F.min(group).alias(group), F.min("m").alias("m"))
    return one.select(*key, "n_groups", F.when(F.col("n_groups") == 1, F.col(group)).alias(group), F.when(F.col("n_groups") == 1, F.col("m.lat")).alias("lat"), F.when(F.col("n_groups") == 1, F.col("m.lon")).alias("lon"))


def suffix_join(rows: DataFrame, code: str, dimension: DataFrame, suffix: str, length: int, order: str) -> DataFrame:
    """`rows` with the first dimension row, by `order`, whose `suffix` (of fixed `length`) ends their `code`; an equi-join
    on the code's end, and no row twice."""
    values = [c for c in dimension.columns if c != suffix]
    first = dimension.groupBy(F.col(suffix).alias("__s")).agg(F.min_by(F.struct(*values), order).alias("__v"))
    return rows.withColumn("__s", F.right(F.col(code), F.lit(length))).join(first, "__s", "left").select(*rows.columns, "__v.*")


def label_in_text(text: Column, labels: list[str]) -> Column:
    """The first of `labels`, in their order, that the text contains; null if none."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(label)), F.lit(label)) for label in labels))


def preserve_groups(dimension: DataFrame, rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """One row for each group of `dimension`, groups without rows included, with aggregated `counts` (0 if none)."""
    own = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in counts.items()))
    return dimension.join(own, keys, "left").select(*dimension.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in counts))


def missing_references(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key doesn't exist; must be empty for an intact catalogue."""
    return rows.join(existing.select(*key).distinct(), key, "left_anti")


def next_reserve(reserve: DataFrame, used: DataFrame, key: str, group: list[str], order: str) -> DataFrame:
    """Per group, the first reserve row that isn't used."""
    left = reserve.join(used.select(key).distinct(), key, "left_anti")
    return left.groupBy(*group).agg(F.min_by(key, order).alias(key))


def carry_over(fresh: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """A new checklist with the old one's marks by id, and its custom rows after it."""
    marks = previous.where("NOT custom").groupBy(*key).agg(F.max("checked").alias("__c"))
    own = fresh.join(marks, key, "left").withColumn("checked", F.coalesce("__c", F.lit(False))).drop("__c").select(*previous.columns)
    return own.unionByName(previous.where("custom"))


def upsert(rows: DataFrame, changes: DataFrame, key: list[str], replace: bool) -> DataFrame:
    """`rows` with `changes` added; those of known keys replace the old row, or are ignored unless `replace`."""
    if replace:
        return rows.join(changes.select(*key), key, "left_anti").select(*rows.columns).unionByName(changes)
    return rows.unionByName(changes.join(rows.select(*key), key, "left_anti").select(*rows.columns))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first `n` rows of each key. Spark keeps n rows a key and task before the shuffle."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
