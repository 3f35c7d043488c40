"""Audits and gates on cases worked out by hand: each rule broken in turn, and odd rows."""

import pytest
from pyspark.sql import Row, functions as F

from hearthgauge.operators import audits as U

SAMPLES = (
    "audit string, source string, city string, id string, ord int, result string, verification_method string, fields map<string,boolean>, building_type string, year int, severity string, district string,"
    " school_levels array<string>, market_ownership string, case_type string, expected_category string, observed_category string, latitude double, longitude double"
)
AUDITS = "audit string, status string, adapter_version string"


def sample(kind, city, k, **changes):
    """A sample such that ten of a city (k from 0) satisfy every rule."""
    row = dict(
        audit="a", source=kind, city=city, id=f"{city}-{k}", ord=k, result="matched", verification_method="official-raw-offline", fields=dict.fromkeys(U.RULES[kind].fields, True),
        building_type=("apartment", "mansion", "highrise")[k % 3], year=2023 + k % 3, severity=("A1", "A2")[k % 2], district=f"d{k % 3}", school_levels=list(U.SCHOOL_LEVELS[k % 4 : k % 4 + 1]),
        market_ownership="private" if city == "taipei" and k % 2 else "public", case_type=("high", "medium", "low", "uncovered")[k % 4] if kind == "liquefaction" else ("red", "yellow", "unknown")[k % 3],
        expected_category=f"c{k % 2}", observed_category=f"c{k % 2}", latitude=25.12345, longitude=121.5,
    )
    return row | changes


def good(kind):
    return [sample(kind, city, k) for city in U.CITIES for k in range(10)]


def judged(spark, kind, rows, status="passed", version="v", bound=None):
    names = [f.split()[0] for f in SAMPLES.replace(", ", ",").split(",") if " " in f]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SAMPLES)
    return {r.audit: r for r in U.evaluate(df, spark.createDataFrame([("a", status, version), ("none", "passed", "v")], AUDITS), kind, "v", bound=bound).collect()}


@pytest.mark.parametrize("kind", sorted(U.RULES))
def test_whole_audit_passes_and_each_fault_stops_it(spark, kind):
    rows = good(kind)
    got = judged(spark, kind, rows)
    assert got["a"].passed and got["a"].covered and (got["a"].n_taipei, got["a"].n_new_taipei, got["a"].mismatches) == (10, 10, 0)
    assert not got["none"].passed and got["none"].sample_count == 0 and got["none"].methods == []
    assert not judged(spark, kind, rows, status="pending")["a"].passed
    assert not judged(spark, kind, rows, version=None)["a"].passed
    mismatch = judged(spark, kind, [*rows, sample(kind, "elsewhere", 0, result="mismatch")])["a"]
    assert (mismatch.passed, mismatch.mismatches) == (False, 1)
    # a city alone, and ids repeated until too few are left
    assert not judged(spark, kind, [r for r in rows if r["city"] == "taipei"])["a"].passed
    repeated = judged(spark, kind, [r | {"id": f"{r['city']}-{r['ord'] % 3}"} for r in rows])["a"]
    assert repeated.n_taipei == 3 and not repeated.passed
    odd = [dict.fromkeys(rows[0]) | {"audit": "a", "source": kind}, dict.fromkeys(rows[0])]
    assert judged(spark, kind, [*rows, *rows, *odd])["a"].passed


@pytest.mark.parametrize("kind", [k for k, r in U.RULES.items() if r.fields])
def test_unconfirmed_fields_do_not_count(spark, kind):
    field = U.RULES[kind].fields[-1]
    rows = [r | {"fields": r["fields"] | {field: [None, False][r["ord"] % 2]}} if r["city"] == "taipei" else r for r in good(kind)]
    got = judged(spark, kind, rows)["a"]
    assert (got.n_taipei, got.n_new_taipei, got.passed) == (0, 10, False)


@pytest.mark.parametrize(
    "kind, change",
    [
        ("price", lambda r: {"building_type": "mansion"}), ("accidents", lambda r: {"year": 2023}), ("accidents", lambda r: {"severity": "A2"}), ("accidents", lambda r: {"district": None}),
        ("school", lambda r: {"school_levels": ["junior"]}), ("library", lambda r: {"district": "d"}), ("market", lambda r: {"market_ownership": "public"}), ("market", lambda r: {"market_ownership": "private"}),
        ("flood", lambda r: {"expected_category": "c", "observed_category": "c"}), ("flood", lambda r: {"case_type": "yellow"}), ("liquefaction", lambda r: {"case_type": "high"}),
        ("flood", lambda r: {"latitude": 25.123456}), ("flood", lambda r: {"longitude": float("nan")}), ("liquefaction", lambda r: {"observed_category": "else"}), ("liquefaction", lambda r: {"verification_method": "guess"}),
        ("library", lambda r: {"verification_method": "official-map"}), ("accidents", lambda r: {"verification_method": None}),
    ],
)
def test_what_is_not_covered_stops_it(spark, kind, change):
    assert not judged(spark, kind, [r | change(r) for r in good(kind)])["a"].passed


def test_evidence_of_other_files_stops_it(spark):
    rows = good("park")
    assert judged(spark, "park", rows, bound=F.col("ord") >= 0)["a"].passed
    got = judged(spark, "park", rows, bound=F.col("ord") > 0)["a"]
    assert (got.unbound, got.passed) == (2, False)


def test_match_gates(spark):
    def rows(source, city, matched, unmatched, early=0):
        return [(source, city, None)] * matched + [(source, city, "unmatched")] * unmatched + [(source, city, "invalidCoreFields")] * early

    data = rows("market", "taipei", 100, 0) + rows("market", "new-taipei", 80, 20) + rows("school", "taipei", 95, 5, 50) + rows("school", "new-taipei", 95, 5)
    data += rows("park", "taipei", 0, 1) + rows("park", "new-taipei", 99, 0) + [("hospital", "taipei", "unmatched")] * 9 + [("hospital", "new-taipei", None)]
    early = dict.fromkeys(U.MATCH_SCOPES, ["invalidCoreFields"])
    got = {r.source: r for r in U.match_gates(spark.createDataFrame(data, "source string, city string, reason string"), early).collect()}
    assert (got["market"].failed_scope, got["market"].error) == ("new-taipei", "market new-taipei match rate 80.00% below 95%")
    assert got["school"].passed and got["school"].overall_rate == 0.95 and got["school"].error is None
    # the parks of the one city are not looked at, nor are the hospitals
    assert got["park"].passed and got["park"].taipei_rate == 1.0 and got["hospital"].passed
    empty = U.match_gates(spark.createDataFrame([], "source string, city string, reason string"), early).collect()
    assert {r.source: r.failed_scope for r in empty} == {"market": "taipei", "school": "taipei", "park": "new-taipei", "hospital": "new-taipei"}


def test_invalid_gate(spark):
    groups = spark.createDataFrame([(k,) for k in range(4)], "g int")
    rows = spark.createDataFrame([(0, False)] * 98 + [(0, True)] * 2 + [(1, False)] * 97 + [(1, True)] * 3 + [(2, None)], "g int, bad boolean")
    got = {r.g: (r.n, r.n_invalid, r.fault) for r in U.invalid_gate(groups, rows, ["g"], F.col("bad")).collect()}
    assert got == {0: (100, 2, None), 1: (100, 3, "invalid_rate"), 2: (1, 0, None), 3: (0, 0, "invalid_rate")}
    assert [r.fault for r in U.invalid_gate(groups, rows, ["g"], F.col("bad"), 0.0).orderBy("g").collect()] == ["invalid_rate", "invalid_rate", None, "invalid_rate"]
    assert U.invalid_gate(groups, spark.createDataFrame([(0, True)], "g int, bad boolean"), ["g"], F.col("bad"), 1.0).where("g = 0").first().fault == "no_features"


def test_stalls(spark):
    rows = [("台北市公有東門", "1,200", " 3 "), ("臺北市公有東門", "-5", "x"), (" 東門", None, "1e999"), ("", "7", "7"), (None, "7", "7"), ("臺北市公有", "7", "7"), ("Ａ市場", "0x10", "")]
    got = U.classify_stalls(spark.createDataFrame(rows, "name string, a string, b string"), "name", ["a", "b"]).collect()
    assert sorted((r.name, r.n, r.fresh_stalls) for r in got) == [("A市場", 1, 16.0), ("東門", 3, 1203.0)]


def test_district_sample(spark):
    rows = [("x", "d1", 1), ("x", "d1", 2), ("x", "d1", 3), ("x", None, 4), ("x", "d2", 5), ("x", "d3", 6), ("y", "d", 9), ("y", "d", 8)]
    got = U.district_sample(spark.createDataFrame([Row(city=a, district=b, id=c) for a, b, c in rows]), "city", "district", "id").collect()
    assert sorted((r.city, r.slot, r.id) for r in got) == [("x", 1, 1), ("x", 2, 4), ("x", 3, 5), ("x", 4, 2), ("x", 5, 3), ("y", 1, 8), ("y", 2, 9)]


def test_source_counts(spark):
    rows = spark.createDataFrame([("d", "official"), ("d", "failed"), ("d", None), ("e", "stale")], "d string, status string")
    assert {r.d: (r.official_count, r.failed_count, r.n) for r in U.source_counts(rows, ["d"]).collect()} == {"d": (1, 1, 3), "e": (0, 0, 1)}
