"""Gates before a release: what a source, an audit, a readiness report or the published tree must hold.

Each gate returns the rows that break it, or one verdict a group; `quality.require` turns rows into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S

# Fixed values
HASH = "^[a-f0-9]{64}$"
CITIES = ("taipei", "new-taipei")
PRICE_FIELDS = ("date", "address", "totalPrice", "area", "buildingType", "parking", "floor")
VERIFICATIONS = ("official-map", "official-raw-offline")
READINESS_SOURCES, READINESS_STATUS = ("market", "park"), ("blocked", "ready")
FILE_COUNTS = {"district-boundary": 41, "flood": 410, "liquefaction": 41, "rail": 41, "parking": 41, "medical": 41, "school": 41, "park": 41, "library": 41, "market": 41, "accidents": 123}
MOST_FILE_BYTES = 5 * 1024 * 1024
ACCIDENT_KEYS, ACCIDENT_YEARS = ("id", "date", "year", "severity"), ("2023", "2024", "2025")
NAMED_FACILITIES = ("parking", "medical", "school", "park", "library", "market")


def rail_gate(stations: DataFrame, invalid: int, least: int = 25) -> DataFrame:
    """One row: stations, distinct points at 5 places, and whether there are enough, all apart and none invalid."""
    point = lambda c: F.format_string("%.5f", F.round(F.col(c), 5))
    own = stations.agg(F.count("*").alias("stations"), F.count_distinct(F.concat_ws(":", point("lon"), point("lat"))).alias("points"))
    return own.withColumn("passed", (F.col("stations") >= least) & (F.col("points") == F.col("stations")) & F.lit(invalid == 0))


def major_exclusions(rows: DataFrame, group: str, reasons: list[str], most: float = 0.02) -> DataFrame:
    """Per group: raw rows, those excluded for one of `reasons`, their share, and whether it is `most` at the utmost."""
    own = rows.groupBy(group).agg(F.count("*").alias("raw_rows"), F.count_if(F.coalesce(F.col("reason").isin(*reasons), F.lit(False))).alias("major"))
    return own.withColumn("rate", F.col("major") / F.col("raw_rows")).withColumn("passed", F.col("rate") <= most)


def repeated_ids(rows: DataFrame, ident: str) -> DataFrame:
    """Ids that occur more than once, over all years and files together."""
    return rows.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count("*").alias("n")).where("n > 1")


def matched_conflicts(markets: DataFrame, most_metres: float = 150.0) -> DataFrame:
    """Markets whose address and official coordinate contradict one another: another district, or too far apart.

    `markets`: address_district, address_lat, address_lon of the address match; place_district, official_lat,
    official_lon of the coordinate. One such row stops the whole batch.
    """
    c = F.col
    metres = F.hypot((c("address_lat") - c("official_lat")) * 111000, (c("address_lon") - c("official_lon")) * 101000)
    both = c("address_district").isNotNull() & c("place_district").isNotNull()
    return markets.withColumn("metres", metres).where(both & ((c("address_district") != c("place_district")) | (c("metres") > most_metres)))


def located_markets(markets: DataFrame, stalls: DataFrame, key: str) -> DataFrame:
    """Public markets with lat, lon, location_method and reason: a market without fresh stalls under its normal name is
    out, the address locates it, else the official coordinate in a known district. `stalls`: key, fresh_stalls (a key once)."""
    joined = markets.join(stalls.select(key, "fresh_stalls"), key, "left")
    c = F.col
    by_address, by_point = c("address_district").isNotNull(), c("place_district").isNotNull() & c("official_lat").isNotNull()
    fresh = F.coalesce(c("fresh_stalls") > 0, F.lit(False))
    reason = F.when(~fresh, "noFreshFoodStalls").when(~(by_address | by_point), "unmatchedAddress")
    pick = lambda a, b: F.when(c("reason").isNull(), F.when(by_address, c(a)).otherwise(c(b)))
    return joined.withColumn("reason", reason).withColumns({
        "lat": pick("address_lat", "official_lat"), "lon": pick("address_lon", "official_lon"), "district": pick("address_district", "place_district"),
        "location_method": F.when(c("reason").isNull(), F.when(by_address, "address").otherwise("official-coordinate-fallback")),
    })


def market_sample(markets: DataFrame) -> DataFrame:
    """Samples to audit: of Taipei 3 public ones, one located by coordinate first, and 2 private; of New Taipei 5; by id."""
    c = F.col
    fallback = (c("ownership") == "public") & (c("location_method") == "official-coordinate-fallback")
    stratum = F.when(c("city") == "new-taipei", "new-taipei").when(c("ownership") == "public", "public").when(c("ownership") == "private", "private")
    own = markets.withColumn("stratum", stratum).where("stratum IS NOT NULL")
    # only the first coordinate fallback of Taipei's public markets is moved to the front
    first = own.where((c("stratum") == "public") & fallback).agg(F.min("id").alias("__first"))
    ranked = own.join(F.broadcast(first)).withColumn("__front", F.when((c("stratum") == "public") & c("id").eqNullSafe(c("__first")), 0).otherwise(1))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("__front", "id")))
    quota = F.when(c("stratum") == "public", 3).when(c("stratum") == "private", 2).otherwise(5)
    return placed.where(c("place") <= quota).drop("__front", "__first")


def risk_coverage(samples: DataFrame, source: str) -> DataFrame:
    """Per city of CITIES: whether matched risk samples (one an id) cover what they must.

    Five samples at least, with coordinates of 5 places at most; of a flood audit two categories of red cases, two
    yellow cases and an unknown one, else each of the classes high, medium, low and uncovered.
    """
    c = F.col
    short = lambda name: F.length(F.regexp_extract(c(name).cast("string"), "\\.([0-9]+)$", 1)) <= 5
    fine = (c("source") == source) & (c("result") == "matched") & (c("observed_category") == c("expected_category")) & c("verification_method").isin(*VERIFICATIONS)
    own = samples.where(fine & short("latitude") & short("longitude")).dropDuplicates(["city", "id"])
    n = lambda kind: F.count_if(c("case_type") == kind)
    flood = (F.count_distinct(F.when(c("case_type") == "red", c("expected_category"))) >= 2) & (n("yellow") >= 2) & (n("unknown") >= 1)
    classes = (n("high") >= 1) & (n("medium") >= 1) & (n("low") >= 1) & (n("uncovered") >= 1)
    held = own.groupBy("city").agg(F.count("*").alias("n"), (flood if source == "flood" else classes).alias("covers"))
    cities = samples.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CITIES))).alias("city"))
    out = cities.join(held, "city", "left")
    return out.select("city", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce((F.col("n") >= 5) & F.col("covers"), F.lit(False)).alias("passed"))


def unbound_evidence(samples: DataFrame, source: str, source_hash: str, index_hashes: dict[str, str], landmark_hash: str) -> DataFrame:
    """Samples whose evidence is not that of the files of this run.

    The source's hash must be equal and the query's output a hash; where an address was matched, the address index of
    the city must be the same, or for a place located by a landmark that table.
    """
    c = F.col
    same = F.coalesce((c("source_sha256") == source_hash) & c("query_output_sha256").rlike(HASH), F.lit(False))
    by_landmark = F.coalesce(c("location_method") == "ntpc-landmark-exact", F.lit(False))
    landmark = F.coalesce(c("landmark_sha256") == landmark_hash, F.lit(False))
    index = F.coalesce(*(F.when(c("city") == k, c("address_index_sha256") == v) for k, v in index_hashes.items()), F.lit(False))
    if source in ("medical", "park"):
        index = (c("city") == "taipei") | index
    if source == "park":
        index = index | (by_landmark & landmark)
    bound = same & (index if source in ("medical", "school", "park", "market") else F.lit(True))
    if source == "school":
        bound = bound & (~by_landmark | landmark)
    return samples.where((c("source") == source) & ~F.coalesce(bound, F.lit(False)))


def price_record_error() -> Column:
    """What is wrong with a price audit entry (result, attempts, mismatch_fields); null if nothing."""
    c = F.col
    fields = F.coalesce("mismatch_fields", F.array().cast("array<string>"))
    unknown = F.size(F.array_except(fields, F.array(*map(F.lit, PRICE_FIELDS)))) > 0
    return (
        F.when(~F.coalesce(c("result").isin("matched", "mismatch", "inconclusive"), F.lit(False)), "unknownResult")
        .when((c("result") == "inconclusive") & (c("attempts") < 2), "tooFewAttempts")
        .when(c("result") == "inconclusive", F.lit(None))
        .when((c("result") == "mismatch") & (F.size(fields) == 0), "mismatchWithoutFields")
        .when(unknown, "unknownField")
        .when((c("result") == "matched") & (F.size(fields) > 0), "matchedWithFields")
    )


def risk_record_error(least_metres: float = 20.0) -> Column:
    """What is wrong with a risk audit entry (result, observed, expected_category, boundary_distance, verification_method)."""
    c = F.col
    return (
        F.when(~F.coalesce(c("result").isin("matched", "mismatch"), F.lit(False)), "unknownResult")
        .when(F.coalesce(c("observed"), F.lit("")) == "", "nothingObserved")
        .when(c("boundary_distance") < least_metres, "nearBoundary")
        .when((c("result") == "matched") & (c("observed") != c("expected_category")), "observedDiffers")
        .when((c("result") == "mismatch") & (c("observed") == c("expected_category")), "observedEqual")
        .when(~F.coalesce("verification_method", F.lit(VERIFICATIONS[0])).isin(*VERIFICATIONS), "unknownVerification")
    )


def candidates_of(samples: DataFrame, candidates: DataFrame) -> DataFrame:
    """Samples with their candidate, by source and id; a sample without one, or with several, is no row."""
    single = candidates.groupBy("source", "id").agg(F.count("*").alias("__n"), F.first(F.struct(*[x for x in candidates.columns if x not in ("source", "id")])).alias("candidate")).where("__n = 1").drop("__n")
    return samples.join(single, ["source", "id"])


def readiness_error() -> Column:
    """What is wrong with a readiness row: id, source_id, status, checked_at, adapter_version, rate_taipei, rate_new_taipei,
    rate_overall, excluded and location_methods (map of counts), blocked_reason, and keys (the fields it came with)."""
    c = F.col
    allowed = ("id", "status", "checkedAt", "adapterVersion", "matchingRates", "excluded", "locationMethods", "blockedReason")
    blank = lambda name: F.coalesce(c(name), F.lit("")) == ""
    rate = lambda name: F.coalesce(c(name).between(0, 1) & ~F.isnan(c(name)), F.lit(False))

    def counts(name: str) -> Column:
        whole = F.forall(F.map_values(c(name)), lambda v: F.coalesce((v >= 0) & (v == F.floor(v)), F.lit(False)))
        return F.coalesce(whole & ~F.array_contains(F.map_keys(c(name)), F.lit("")), F.lit(False))

    return (
        F.when(~F.coalesce(c("source_id").isin(*READINESS_SOURCES), F.lit(False)), "unknownSource")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, allowed)))) > 0, "unknownField")
        .when(~c("id").eqNullSafe(c("source_id")) | ~F.coalesce(c("status").isin(*READINESS_STATUS), F.lit(False)) | c("checked_at").isNull() | c("adapter_version").isNull(), "invalidField")
        .when((c("status") == "blocked") & blank("blocked_reason"), "blockedWithoutReason")
        .when((c("status") == "ready") & c("blocked_reason").isNotNull(), "readyWithReason")
        .when(~(rate("rate_taipei") & rate("rate_new_taipei") & rate("rate_overall")), "invalidRate")
        .when(~(counts("excluded") & counts("location_methods")), "invalidCount")
    )


def stale_candidates(candidates: DataFrame, run: Column, fingerprints: DataFrame) -> DataFrame:
    """Candidates (source, generated_at, dataset_sha256) that another run made, or whose output is not the one published."""
    held = fingerprints.select("source", F.col("dataset_sha256").alias("__published"))
    joined = candidates.join(held, "source", "left")
    own = F.coalesce(F.col("generated_at") == run, F.lit(False)) & F.col("dataset_sha256").eqNullSafe(F.col("__published"))
    return joined.where(~own).drop("__published")


def feature_error() -> Column:
    """What is wrong with a published feature: file, has_geometry, lon, lat and properties (map of texts). Null if nothing."""
    c = F.col
    p = lambda key: F.coalesce(F.try_element_at(c("properties"), F.lit(key)), F.lit(""))
    within = lambda folder: F.contains("file", F.lit(f"/{folder}/"))
    place = F.coalesce(c("has_geometry") & S.in_study_area(c("lat"), c("lon")), F.lit(False))
    keys = F.map_keys(c("properties"))
    accident = F.size(F.array_except(keys, F.array(*map(F.lit, ACCIDENT_KEYS)))) > 0
    accident = accident | (p("id") == "") | ~p("date").rlike("^20(23|24|25)-[0-9]{2}-[0-9]{2}$") | ~p("year").isin(*ACCIDENT_YEARS) | ~p("severity").isin("A1", "A2")
    risk = ~p("riskType").isin("flood", "liquefaction") | ~p("level").isin("low", "attention", "priority") | (p("officialCategory") == "")
    has = lambda *names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) > 0
    category = p("category")
    return (
        F.when(~place, "invalidGeometry")
        .when(within("accidents") & accident, "invalidAccident")
        .when(within("accidents"), F.lit(None))
        .when(within("risks") & risk, "invalidRisk")
        .when(within("risks") | ~within("facilities"), F.lit(None))
        .when(has("address", "tel", "phone"), "forbiddenField")
        .when(category.isin(*NAMED_FACILITIES) & ((p("id") == "") | (p("name") == "") | (p("facilityType") == "")), "invalidFacility")
        .when((category == "school") & ~(has("schoolLevels") & has("officialCodes")), "invalidSchool")
        .when((category == "park") & ~p("parkType").isin("park", "green-space", "plaza"), "invalidPark")
        .when((category == "library") & (p("facilityType") != "public-library"), "invalidLibrary")
        .when((category == "market") & ((p("facilityType") != "traditional-market") | ~p("marketOwnership").isin("public", "private")), "invalidMarket")
    )


def file_errors(listed: DataFrame, present: DataFrame, expected: dict[str, int] = FILE_COUNTS) -> DataFrame:
    """(source, file, error) of files that a source lists: missing, over the size, or not as many as they must be.

    `listed`: source, file; `present`: file, bytes. A source that lists no file is not counted.
    """
    joined = listed.join(present, "file", "left")
    each = joined.select("source", "file", F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") > MOST_FILE_BYTES, "tooLarge").alias("error")).where("error IS NOT NULL")
    counts = listed.groupBy("source").agg(F.count("file").alias("n"))
    want = F.coalesce(*(F.when(F.col("source") == k, F.lit(v)) for k, v in expected.items()))
    wrong = counts.withColumn("want", want).where("n > 0 AND want IS NOT NULL AND n <> want")
    return each.unionByName(wrong.select("source", F.lit(None).cast("string").alias("file"), F.lit("fileCount").alias("error")))


def uncovered_districts(listed: DataFrame, districts: DataFrame, key: str) -> DataFrame:
    """Districts that the catalogue lacks, and those it has beyond the known ones."""
    return districts.join(listed, key, "left_anti").select(key, F.lit("missing").alias("error")).unionByName(listed.join(districts, key, "left_anti").select(key, F.lit("unknown").alias("error")))
