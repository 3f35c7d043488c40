"""Manual audits, each judged by the rules of its source, and the match rates that a source must reach.

Samples of all audits are judged together: what an audit needs of its samples is counted by aggregations that combine
before their shuffle, and an audit without samples is in the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names, scalars as S
from .lookup import preserve_groups
from .quality import cascade
from .release import CITIES, VERIFICATIONS
from .sampling import top_per_group


@dataclass(frozen=True)
class Rule:
    """Matched samples that each of CITIES needs, the fields that must be confirmed, and whether from raw files."""

    least: tuple[int, int]
    fields: tuple[str, ...] = ()
    offline: bool = False
    by_source: bool = False


# Fixed values
OFFLINE = "official-raw-offline"
_PLACE = ("name", "id", "district", "coordinate")
RULES = {
    "price": Rule((10, 10), ("date", "totalPrice", "areaSquareMeters", "buildingType", "floor", "parkingPrice", "parkingAreaSquareMeters")),
    "rail": Rule((4, 5), ("name", "address", "district", "gps")),
    "accidents": Rule((5, 5), ("id", "date", "severity", "district", "coordinate"), offline=True),
    "flood": Rule((0, 0), by_source=True),
    "liquefaction": Rule((0, 0), by_source=True),
    "parking": Rule((5, 5), (*_PLACE, "carCapacity"), True, True),
    "medical": Rule((5, 5), _PLACE, True, True),
    "school": Rule((5, 5), (*_PLACE, "schoolLevels"), True, True),
    "park": Rule((5, 5), (*_PLACE, "parkType"), True, True),
    "library": Rule((5, 5), _PLACE, True, True),
    "market": Rule((5, 5), (*_PLACE, "marketOwnership", "classificationMethod"), True, True),
}
BUILDING_KINDS, YEARS, SEVERITIES = 3, (2023, 2024, 2025), ("A1", "A2")
SCHOOL_LEVELS = ("elementary", "junior", "senior", "special")
LIQUEFACTION_CASES = ("high", "medium", "low", "uncovered")
#: Match rates that a source is held to, in the order in which they are looked at, and rates that are no count.
MATCH_SCOPES = {"market": (*CITIES, "overall"), "school": (*CITIES, "overall"), "park": ("new-taipei", "overall"), "hospital": ("new-taipei",)}
FIXED_RATES = {("park", "taipei"): 1.0}
STALL_OWNER = "^臺北市公有"


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _last(samples: DataFrame, audit: str, order: str, columns: list[str]) -> DataFrame:
    """The last sample of each id of an audit's city."""
    return samples.groupBy(audit, "city", "id").agg(F.max_by(F.struct(*columns), order).alias("__v")).select(audit, "city", *(F.col(f"__v.{c}").alias(c) for c in columns))


def _in_city(city: str) -> Column:
    return F.col("city") == city


def _distinct(city: str, value: Column) -> Column:
    return F.count_distinct(F.when(_in_city(city), value))


def _places(column: str) -> Column:
    """At most 5 digits after the point; a coordinate that is no finite number has none to count and doesn't pass."""
    c = F.col(column)
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite & (F.length(F.regexp_extract(c.cast("string"), "\\.([0-9]+)$", 1)) <= 5)


def _risk_coverage(samples: DataFrame, audit: str, source: str, order: str) -> DataFrame:
    """Per audit: whether each city has five samples that fit, of all the cases that the source asks for."""
    c = F.col
    fine = samples.where((c("result") == "matched") & (c("observed_category") == c("expected_category")) & c("verification_method").isin(*VERIFICATIONS) & _places("latitude") & _places("longitude"))
    own = _last(fine, audit, order, ["case_type", "expected_category"])

    def covers(city: str) -> Column:
        of = lambda kind: _sure(_in_city(city) & (c("case_type") == kind))
        enough = F.count_if(_sure(_in_city(city))) >= 5
        if source == "flood":
            reds = F.count_distinct(F.when(of("red"), F.coalesce("expected_category", F.lit(""))))
            return enough & (reds >= 2) & (F.count_if(of("yellow")) >= 2) & (F.count_if(of("unknown")) >= 1)
        return enough & _all(F.count_if(of(kind)) >= 1 for kind in LIQUEFACTION_CASES)

    return own.groupBy(audit).agg(_all(map(covers, CITIES)).alias("__covers"))


def _unique_coverage(kind: str) -> Column:
    """What the last matched samples must cover."""
    c = F.col
    if kind == "price":
        return _all(_distinct(city, F.coalesce("building_type", F.lit(""))) == BUILDING_KINDS for city in CITIES)
    if kind == "accidents":
        each = lambda city, column, values: _all(F.count_if(_sure(_in_city(city) & (c(column) == v))) >= 1 for v in values)
        return _all(each(city, "year", YEARS) & each(city, "severity", SEVERITIES) & (_distinct(city, F.coalesce("district", F.lit(""))) >= 3) for city in CITIES)
    return F.lit(True)


def _matched_coverage(kind: str) -> Column:
    """What all matched samples of a source must cover, confirmed in each field or not."""
    c, ok = F.col, F.col("result") == "matched"
    if kind == "school":
        return _all(F.count_if(_sure(ok & _in_city(city) & F.array_contains("school_levels", level))) >= 1 for city in CITIES for level in SCHOOL_LEVELS)
    if kind == "library":
        return _all(F.count_distinct(F.when(ok & _in_city(city), F.coalesce("district", F.lit("")))) >= 3 for city in CITIES)
    if kind == "market":
        owned = lambda city, ownership: F.count_if(_sure(ok & _in_city(city) & (c("market_ownership") == ownership)))
        return (owned("taipei", "public") >= 3) & (owned("taipei", "private") >= 2) & (owned("new-taipei", "public") >= 5)
    return F.lit(True)


def evaluate(samples: DataFrame, audits: DataFrame, kind: str, version: str, audit: str = "audit", order: str = "ord", bound: Column | None = None) -> DataFrame:
    """Per audit of `audits` (audit, status, adapter_version): matched samples by city and in all, mismatches, methods,
    whether the samples cover what `kind` of RULES asks for, and whether the audit passes.

    An audit passes if its status is passed, it is of this `version` of the reader, no sample is a mismatch, both cities
    have enough samples with all fields confirmed, one an id, and they cover all cases. `bound`: that a sample's evidence
    is of the files of this run, to be true of all samples. `samples`: audit, source, city, id, `order` (the last
    matched one of an id counts), result, verification_method, fields (map of name to boolean) and what the rule reads:
    building_type; year, severity, district; school_levels; market_ownership; case_type, expected_category,
    observed_category, latitude, longitude. Null fields are unconfirmed; samples of other cities count as mismatches only.
    """
    rule, c = RULES[kind], F.col
    own = samples.where(c("source") == kind) if rule.by_source else samples
    matched = _sure(c("result") == "matched")
    with_method = c("verification_method").isNotNull() & (c("verification_method") != "")
    methods = F.array_sort(F.collect_set(F.when(with_method & (matched if kind != "accidents" else F.lit(True)), c("verification_method"))))
    whole = own.groupBy(audit).agg(
        F.count_if(_sure(c("result") == "mismatch")).alias("mismatches"),
        F.count_if(~_sure(bound if bound is not None else F.lit(True))).alias("unbound"),
        methods.alias("methods"),
        _matched_coverage(kind).alias("__matched"),
    )
    confirmed = matched & _all(_sure(F.element_at("fields", F.lit(f))) for f in rule.fields)
    if rule.offline:
        confirmed = confirmed & _sure(c("verification_method") == OFFLINE)
    columns = {"price": ["building_type"], "accidents": ["year", "severity", "district"]}.get(kind, ["result"])
    counted = _last(own.where(confirmed), audit, order, columns).groupBy(audit).agg(*(F.count_if(_sure(_in_city(city))).alias(f"n_{city.replace('-', '_')}") for city in CITIES), _unique_coverage(kind).alias("__unique"))
    out = audits.select(audit, "status", "adapter_version").join(whole, audit, "left").join(counted, audit, "left")
    if kind in ("flood", "liquefaction"):
        out = out.join(_risk_coverage(own, audit, kind, order), audit, "left")
    else:
        out = out.withColumn("__covers", F.lit(True))
    n = [F.coalesce(f"n_{city.replace('-', '_')}", F.lit(0)) for city in CITIES]
    # an audit without samples covers what isn't asked for
    covers = F.coalesce("__matched", F.lit(kind not in ("school", "library", "market"))) & F.coalesce("__unique", F.lit(kind not in ("price", "accidents"))) & _sure(c("__covers"))
    passed = _sure(c("status") == "passed") & _sure(c("adapter_version") == version) & (c("mismatches") == 0) & (c("unbound") == 0) & covers & _all(x >= least for x, least in zip(n, rule.least, strict=True))
    return out.select(
        audit, n[0].alias("n_taipei"), n[1].alias("n_new_taipei"), (n[0] + n[1]).alias("sample_count"), F.lit(max(10, sum(rule.least)) if kind != "rail" else sum(rule.least)).alias("required_count"),
        F.coalesce("mismatches", F.lit(0)).alias("mismatches"), F.coalesce("unbound", F.lit(0)).alias("unbound"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"), covers.alias("covered"), _sure(passed).alias("passed"),
    )


def match_gates(rows: DataFrame, early: dict[str, list[str]], least: float = 0.95) -> DataFrame:
    """Per source of MATCH_SCOPES: the match rates of the cities and overall, the first scope it is held to whose rate
    is below `least`, what to say of it, and whether the source passes; a source without rows has rates of 0.

    `rows`: source, city, reason (null: matched). `early`: by source, the reasons that make a row not eligible.
    """
    c = F.col
    ineligible = F.coalesce(*(F.when(c("source") == s, _sure(c("reason").isin(*reasons))) for s, reasons in early.items()), F.lit(False))
    scopes = {"taipei": _sure(_in_city("taipei")), "new_taipei": _sure(_in_city("new-taipei")), "overall": F.lit(True)}
    counts = {}
    for name, inside in scopes.items():
        counts[f"{name}_eligible"] = F.count_if(inside & ~ineligible)
        counts[f"{name}_matched"] = F.count_if(inside & c("reason").isNull())
    sources = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, MATCH_SCOPES))).alias("source"))
    out = preserve_groups(sources, rows, ["source"], counts)
    for name in scopes:
        fixed = [F.when(c("source") == s, F.lit(rate)) for (s, scope), rate in FIXED_RATES.items() if scope.replace("-", "_") == name]
        rate = F.when(c(f"{name}_eligible") > 0, c(f"{name}_matched") / c(f"{name}_eligible")).otherwise(0.0)
        out = out.withColumn(f"{name}_rate", F.coalesce(*fixed, rate))
    held = [(scope, c("source").isin([s for s, of in MATCH_SCOPES.items() if scope in of]) & (c(f"{scope.replace('-', '_')}_rate") < least)) for scope in (*CITIES, "overall")]
    out = out.withColumn("failed_scope", cascade(held))
    failed = F.coalesce(*(F.when(c("failed_scope") == scope, c(f"{scope.replace('-', '_')}_rate")) for scope in (*CITIES, "overall")))
    text = F.format_string(f"%s %s match rate %.2f%% below {least * 100:g}%%", "source", "failed_scope", failed * 100)
    return out.withColumn("error", F.when(c("failed_scope").isNotNull(), text)).withColumn("passed", c("failed_scope").isNull())


def invalid_gate(groups: DataFrame, rows: DataFrame, keys: list[str], invalid: Column, most: float = 0.02) -> DataFrame:
    """Per group of `groups`: rows, invalid ones, their rate (1 if there are no rows) and the first fault: more than
    `most` invalid, or none valid. With `most` 0, one invalid row is a fault."""
    own = preserve_groups(groups, rows, keys, {"n": F.count("*"), "n_invalid": F.count_if(_sure(invalid))})
    rate = F.when(F.col("n") > 0, F.col("n_invalid") / F.col("n")).otherwise(1.0)
    out = own.withColumn("invalid_rate", rate)
    fault = cascade([("invalid_rate", F.col("invalid_rate") > most), ("no_features", F.col("n") == F.col("n_invalid"))])
    return out.withColumn("fault", fault).withColumn("passed", F.col("fault").isNull())


def classify_stalls(rows: DataFrame, name: str, counts: list[str]) -> DataFrame:
    """Per market by its normal name: rows, and fresh stalls as the sum of the columns `counts`.

    The name is taken without compatibility forms and without its owner; rows without a name go. A count is a number
    text, thousands set off by commas; what is no finite number above 0 counts as 0.
    """
    normal = S.strip(F.regexp_replace(F.translate(F.coalesce("__nfkc", F.lit("")), "台", "臺"), STALL_OWNER, ""))

    def stalls(column: str) -> Column:
        number = S.js_number(F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(","), F.lit("")))
        return F.when((number > 0) & (number < float("inf")), number).otherwise(0.0)

    own = rows.select(names.nfkc(F.col(name)).alias("__nfkc"), *(stalls(x).alias(f"__{k}") for k, x in enumerate(counts)))
    total = reduce(lambda a, b: a + b, (F.col(f"__{k}") for k in range(len(counts))))
    return own.select(normal.alias("name"), total.alias("fresh_stalls")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.sum("fresh_stalls").alias("fresh_stalls"))


def source_counts(sources: DataFrame, group: list[str]) -> DataFrame:
    """Per group of source rows (status): how many are official, how many failed, and all."""
    status = lambda s: F.count_if(_sure(F.col("status") == s))
    return sources.groupBy(*group).agg(status("official").alias("official_count"), status("failed").alias("failed_count"), F.count("*").alias("n"))


def district_sample(rows: DataFrame, group: str, district: str, order: str, districts: int = 3, total: int = 5) -> DataFrame:
    """`rows` with `slot`: in each group the first row, by `order` (unique in a group), of each of the first `districts`
    districts to come up in that order, then other rows up to `total`.

    What can be chosen is cut out by limits that hold before the shuffle, so what is then ranked is small.
    """
    firsts = top_per_group(top_per_group(rows, [group, district], order, 1), [group], order, districts)
    other = top_per_group(rows, [group], order, districts + total)
    marked = firsts.withColumn("__k", F.lit(0)).unionByName(other.withColumn("__k", F.lit(1)))
    # a row that is both is chosen once, for its district
    once = marked.groupBy(group, order).agg(F.min_by(F.struct(*[x for x in marked.columns if x not in (group, order)]), "__k").alias("__v")).select(group, order, "__v.*")
    ranked = once.withColumn("__o", F.struct("__k", order))
    slotted = top_per_group(ranked, [group], "__o", total)
    place = F.array_position(F.sort_array(F.col("__all")), F.col("__o")).cast("int")
    slots = slotted.groupBy(group).agg(F.collect_list("__o").alias("__all"))
    return slotted.join(slots, group).select(*rows.columns, place.alias("slot"))
