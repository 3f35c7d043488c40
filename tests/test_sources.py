import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hearthgauge.operators import documents, presentation
from hearthgauge.sources import archives, catalog, readers, sinks
from hearthgauge.streaming import events


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿a,b\nThe villages and towns urban district,x\n1,"say ""hi"", now"\n\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(p), ["a", "b"]).collect()] == [("1", 'say "hi", now'), ("2", "")]
    m = tmp_path / "m.csv"
    m.write_text('a,b\r\n1,"x\r\ny"\r\n', encoding="utf-8")
    assert len(readers.read_csv(spark, str(m), ["a", "b"], multiline=True).collect()) == 1


def test_zip_with_repeated_headers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("A1.csv", "發生年度,經度\n2024,121.5\nnote發生年度,緯度\n2024,25.0\n\n")
    out = readers.read_zip_csv(spark, str(tmp_path / "x.zip"), "A*.csv", ["發生年度", "經度", "緯度"], header=readers.ACCIDENT_HEADER).collect()
    assert [(r["發生年度"], r["經度"], r["緯度"], r.header_count) for r in out] == [("2024", "121.5", "", 2), ("2024", "", "25.0", 2)]
    with pytest.raises(ValueError):
        archives.zip_members(io.BytesIO(b"<html>"), "*")
    assert archives.shapefile_entry(["a/x.shp", "a/x.dbf", "a/x.prj", "a/x.shx"]) == "a/x.shp"
    with pytest.raises(ValueError):
        archives.shapefile_entry(["x.shp"])


def test_geojson_and_json(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    data = {"type": "FeatureCollection", "features": [{"properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"n": "b"}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [square, square]}]}}]}
    (tmp_path / "g.json").write_text(json.dumps(data), encoding="utf-8")
    rows = readers.read_geojson(spark, str(tmp_path / "g.json"), "n string").orderBy("ord").collect()
    assert [(r.n, r.lon, r.rings and len(r.rings)) for r in rows] == [("a", 1.0, None), ("b", None, 2)]
    (tmp_path / "j.json").write_text('{"data": {"park": [{"id": "1"}, {"id": "2"}]}}', encoding="utf-8")
    assert readers.read_json_rows(spark, str(tmp_path / "j.json"), "data struct<park:array<struct<id:string>>>", "data.park").count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(50)], "city string, id int, v double")
    sinks.write_partitioned(rows, str(tmp_path / "t"), ["city"], ["id"], 20)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50
    assert sinks.oversized(spark, str(tmp_path / "t")).count() == 0
    assert sinks.fingerprint(spark, str(tmp_path / "t")) == sinks.fingerprint(spark, str(tmp_path / "t"))
    dim = spark.createDataFrame([("a",), ("b",)], "city string")
    assert {r.city: r.record_count for r in sinks.group_catalog(rows, dim, ["city"]).collect()} == {"a": 50, "b": 0}
    sinks.write_json_atomic({"x": 1}, str(tmp_path / "c.json"))
    assert catalog.load_optional(str(tmp_path / "c.json")) == {"x": 1} and catalog.load_optional(str(tmp_path / "no.json")) is None
    (tmp_path / "new").mkdir()
    sinks.replace_folder(str(tmp_path / "new"), str(tmp_path / "t"))
    assert list((tmp_path / "t").iterdir()) == []
    with pytest.raises(OSError):
        sinks.replace_folder(str(tmp_path / "missing"), str(tmp_path / "t"))
    assert (tmp_path / "t").exists()
    assert sinks.forbidden_fields(rows.select(F.struct(F.col("city").alias("Address")).alias("s"))) == ["s.Address"]


def test_catalog(tmp_path):
    good = {"schemaVersion": "2.0.0", "mode": "production", "sources": {"metro": {"status": "official", "files": ["a/x.json", "b/y.json"]}, "park": {"status": "unavailable", "files": ["a/p.json"]}}}
    (tmp_path / "m.json").write_text(json.dumps(good), encoding="utf-8")
    m = catalog.load_manifest(str(tmp_path / "m.json"))
    assert catalog.source_files(m, "metro", "a/") == ["a/x.json"] and catalog.source_files(m, "park") == []
    (tmp_path / "m.json").write_text("{}", encoding="utf-8")
    with pytest.raises(ValueError):
        catalog.load_manifest(str(tmp_path / "m.json"))
    assert catalog.retry("x", lambda: 5) == 5
    good_, failed = readers.read_tolerant({"a": lambda: 1 / 0})
    assert good_ == {} and "a" in failed


def test_odd_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,x\n', encoding="utf-8")
    with pytest.raises(ValueError, match="unclosed"):
        readers.read_csv(spark, str(tmp_path / "open.csv"), ["a", "b"], multiline=True).collect()
    (tmp_path / "big5.csv").write_bytes("名,值\n臺北,1\n".encode("big5"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        assert [r["名"] for r in readers.read_csv(spark, str(tmp_path / "big5.csv"), ["名", "值"], encoding="Big5").collect()] == ["臺北"]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    (tmp_path / "bom.json").write_text('\ufeff[{"id": "1"}, {"id": "2"}]', encoding="utf-8")
    assert {r.id for r in readers.read_json_rows(spark, str(tmp_path / "bom.json"), "id string").collect()} == {"1", "2"}


def test_pages(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    for k, n in enumerate([3, 3, 1]):
        (pages / f"p{k}.csv").write_text("a\n" + "".join(f"{k}{i}\n" for i in range(n)), encoding="utf-8")
    assert readers.paged(spark, str(pages), ["a"], 3).count() == 7
    with pytest.raises(ValueError):
        readers.paged(spark, str(pages), ["a"], 3, 2)
    (pages / "p1.csv").write_text("a\n1\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.paged(spark, str(pages), ["a"], 3)


def test_fingerprint_is_of_names_and_bytes(spark, tmp_path):
    want = hashlib.sha256()
    for name in ["a/x.bin", "a/y.bin", "b.bin"]:
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(name.encode() * 3)
        want.update(name.encode() + name.encode() * 3)
    assert sinks.fingerprint(spark, str(tmp_path / "f")) == want.hexdigest()


def test_exports_and_readiness(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "x")], "id int, t string")
    assert sinks.export_json(rows, str(tmp_path / "e.json"), ["id"]) == 2
    assert json.loads((tmp_path / "e.json").read_text(encoding="utf-8")) == [{"id": 1, "t": "x"}, {"id": 2, "t": None}]
    with pytest.raises(ValueError):
        sinks.export_json(rows, str(tmp_path / "e.json"), ["id"], 1)
    assert documents.delete_item(rows, "id", 2).count() == 1
    for value, known in [({"schemaVersion": "1.0.0", "sources": {"market": {}}}, True), ({"schemaVersion": "1.0.0", "sources": {"metro": {}}}, False), ({"schemaVersion": "2.0.0", "sources": {}}, False), ({"schemaVersion": "1.0.0"}, False), ([], False)]:
        (tmp_path / "r.json").write_text(json.dumps(value), encoding="utf-8")
        assert (catalog.load_readiness(str(tmp_path / "r.json")) is not None) == known
    assert catalog.load_readiness(str(tmp_path / "none.json")) is None


def test_states_as_shown(spark):
    got = spark.range(1).select(presentation.status_text(F.lit(None).cast("string")).alias("a"), presentation.record_count_text(F.lit("stale"), F.lit(12345)).alias("b"), presentation.record_count_text(F.lit(None).cast("string"), F.lit(1)).alias("c")).first()
    assert tuple(got) == ("尚未接入", "12,345", "資料不足")


def test_streaming_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    counts = events.tumbling_counts(stream, "ts", "1 day", ["event_type"])
    got = events.run_available(counts, "counts", str(tmp_path / "ck"), "complete")
    want = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == sorted(map(tuple, want.collect()))
    firsts = events.run_available(events.first_seen(stream, ["user_id"], "ts", "400 days"), "firsts", str(tmp_path / "ck2"))
    assert firsts.count() == e.select("user_id").distinct().count()
