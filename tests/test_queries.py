import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from hearthgauge.plans import queries as P
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(P.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(P.QUERIES[name], P.ORACLE_SQL[name], spark, SF)


@pytest.mark.parametrize("name", sorted(set(P.QUERIES) - set(P.ORACLE_SQL)))
def test_other_query_runs(spark, name):
    assert P.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_analysis_has_every_property_and_its_own_sources(spark):
    got = {r.property_id: r for r in P.full_analysis(spark, SF).collect()}
    districts = {r.property_id: r.district for r in P.R.properties(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/customer.parquet").count() and set(got) == set(districts)
    rows = P.states(spark, SF).collect()
    quality = {}
    for x in {r.district for r in rows}:
        n = [r.status == "official" for r in rows if r.district == x]
        quality[x] = "unavailable" if not any(n) else "official" if all(n) else "mixed"
    assert all(got[p].data_quality == quality[x] for p, x in districts.items())
    known = {r.district for r in rows if r.id == "accidents" and r.status != "unavailable"}
    assert {x in known for x in districts.values()} == {True, False}
    # accidents are one of six signals
    assert all(got[p].completeness <= 83 for p, x in districts.items() if x not in known)
