import io
import json
import random
import struct
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearthgauge.sources import archives, readers


def rows_of(out, columns):
    return [(r.member, r.header_count, r.ord, *(r[c] for c in columns)) for r in out.orderBy("archive", "member", "ord").collect()]


def test_members_are_partitions(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"a {k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a_lvr.csv", f'﻿編號,"價\n格"\n{readers.SUBTITLE},x\n{k},"1,0\r\n0"\n\nx{k},"say ""hi"""\n')
            z.writestr("b_lvr.csv", "編號\n7\n8,9\n")
            z.writestr("c.txt", "編號\n0\n")
    out = readers.read_zip_csv(spark, str(tmp_path), "?_lvr.csv", ["編號", "價\n格"])
    assert out.rdd.getNumPartitions() == 6
    assert rows_of(out, ["編號", "價\n格"]) == [x for k in range(3) for x in [("a_lvr.csv", 1, 0, str(k), "1,0\r\n0"), ("a_lvr.csv", 1, 1, f"x{k}", 'say "hi"'), ("b_lvr.csv", 1, 0, "7", ""), ("b_lvr.csv", 1, 1, "8", "")]]
    assert readers.read_zip_csv(spark, str(tmp_path), "none*", ["編號"]).count() == 0


def test_glued_headers_and_big5(spark, tmp_path):
    text = "description,描述發生年度,事故類別名稱,經度\n2024,A2,121.5\n發生年度,經度,事故類別名稱\n2024,121.6,A2\n"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("A2.csv", text.encode("big5"))
    out = readers.read_zip_csv(spark, str(tmp_path / "x.zip"), "*A2*", ["發生年度", "經度"], header=readers.ACCIDENT_HEADER, encoding="big5")
    assert rows_of(out, ["發生年度", "經度"]) == [("A2.csv", 2, 0, "2024", "121.5"), ("A2.csv", 2, 1, "2024", "121.6")]


@pytest.mark.parametrize("content", [b"<html>", b"PK\x03\x04 but nothing more"])
def test_what_is_no_archive_raises(spark, tmp_path, content):
    (tmp_path / "x.zip").write_bytes(content)
    with pytest.raises(Exception, match="ZIP|zip"):
        readers.read_zip_csv(spark, str(tmp_path), "*", ["a"]).collect()


def test_a_broken_member_and_an_open_quote_raise(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.csv", "a\n" + "1\n" * 500)
    raw = bytearray((tmp_path / "x.zip").read_bytes())
    raw[200] ^= 1
    (tmp_path / "x.zip").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="CRC"):
        readers.read_zip_csv(spark, str(tmp_path), "*", ["a"]).collect()
    monkeypatch.setattr(archives, "LONGEST_FIELD", 1000)
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("a.csv", 'a\n"1' + "\n2" * 5000)
    reader = archives.ZipCsv({"columns": '["a"]', "paths": json.dumps([str(tmp_path / "y.zip")]), "members": "*"})
    reader = reader.reader(spark.createDataFrame([], reader.schema()).schema)
    with pytest.raises(Exception, match="field larger"):
        [*reader.read(reader.partitions()[0])]


@pytest.mark.parametrize("what", ["ab", "a", "發生"])
def test_occurrences_across_chunks(what, monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "發", "生", "ab"]) for _ in range(rng.randrange(60))).encode()
        monkeypatch.setattr(archives, "CHUNK", rng.randrange(1, 7))
        assert archives.occurrences(io.BytesIO(text), what.encode()) == text.count(what.encode())


LARGE = """
import json, resource, sys
sys.path.insert(0, {root!r})
from hearthgauge.sources import archives
from pyspark.sql.types import LongType, StringType, StructField, StructType
kinds = dict(archive=StringType(), member=StringType(), header_count=LongType(), ord=LongType(), a=StringType(), b=StringType())
schema = StructType([StructField(*x) for x in kinds.items()])
reader = archives.ZipCsvReader(schema, {{"columns": '["a", "b"]', "paths": json.dumps([{path!r}]), "members": "*", "header": "a,"}})
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(sum(x.num_rows for x in reader.read(reader.partitions()[0])), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)
"""


def test_a_large_member_is_never_held(tmp_path):
    path, line = tmp_path / "x.zip", "1234567890," + "x" * 189 + "\n"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("a.csv", "w") as f:
        f.write(b"a,b\n")
        for _ in range(300):
            f.write((line * 5_000).encode())
    done = subprocess.run([sys.executable, "-c", LARGE.format(root=str(Path(__file__).parents[1]), path=str(path))], capture_output=True, text=True)
    assert not done.returncode, done.stderr
    n, kilobytes = map(int, done.stdout.split())
    assert n == 1_500_000 and kilobytes < 100_000  # of 300 MB


# ---- shapefiles


def shape(kind, rings=(), point=(0, 0)):
    if kind == 0:
        return struct.pack("<i", 0)
    if kind in (1, 11, 21):
        return struct.pack("<i2d", kind, *point) + b"\0" * 8 * {1: 0, 11: 2, 21: 1}[kind]
    xs = [p for r in rings for p in r]
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    box = (min(x for x, _ in xs), min(y for _, y in xs), max(x for x, _ in xs), max(y for _, y in xs))
    flat = struct.pack("<i4d2i", kind, *box, len(rings), len(xs)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in xs)
    return flat + b"\0" * (16 + 8 * len(xs)) * {5: 0, 15: 2, 25: 1}[kind]


def written(shapes, rows, names, encoding="utf-8", width=20):
    """.shp, .shx and .dbf of contents and texts; a row that begins with * is deleted."""
    body, index, at = b"", b"", 100
    for k, s in enumerate(shapes):
        head = struct.pack(">2i", k + 1, len(s) // 2)
        index += struct.pack(">2i", at // 2, len(s) // 2)
        body += head + s
        at += len(head) + len(s)
    head = lambda n, kind: struct.pack(">i20xi", 9994, n // 2) + struct.pack("<2i8d", 1000, kind, *[0] * 8)
    kind = struct.unpack("<i", shapes[0][:4])[0] if shapes else 5
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", width, 0) for n in names)
    first, size = 33 + 32 * len(names), 1 + width * len(names)
    table = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(rows), first, size) + fields + b"\r"
    for row in rows:
        gone = row[0].startswith("*")
        table += (b"*" if gone else b" ") + b"".join(v.encode(encoding).ljust(width) for v in row)
    return {".shp": head(at, kind) + body, ".shx": head(100 + len(index), kind) + index, ".dbf": table + b"\x1a", ".prj": b"x"}


SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # with the clock
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def put(folder, name, parts, archive=None):
    if archive is None:
        for e, content in parts.items():
            (folder / f"{name}{e}").write_bytes(content)
        return str(folder / f"{name}.shp")
    with zipfile.ZipFile(folder / f"{name}.zip", "w", archive) as z:
        for e, content in parts.items():
            z.writestr(f"deep/{name}{e.upper()}", content)
    return str(folder / f"{name}.zip")


@pytest.mark.parametrize("archive", [None, zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("kind", [5, 15, 25])
def test_features_equal_those_of_geojson(spark, tmp_path, archive, kind):
    moved = lambda ring, k: [(x + k, y) for x, y in ring]
    shapes = [shape(kind, [moved(SQUARE, 10 * k), moved(HOLE, 10 * k)][: 1 + k % 2]) for k in range(25)]
    names = [f"名{k}" for k in range(25)]
    path = put(tmp_path, "x", written(shapes, [(n, "v") for n in names], ["NAME", "V"], "big5"), archive)
    out = readers.read_shapefile(spark, path, ["NAME"], encoding="big5", records=4)
    assert out.rdd.getNumPartitions() == (1 if archive == zipfile.ZIP_DEFLATED else 7)
    features = [{"type": "Feature", "properties": {"NAME": n}, "geometry": {"type": "Polygon", "coordinates": [[*map(list, reversed(r))] for r in [moved(SQUARE, 10 * k), moved(HOLE, 10 * k)][: 1 + k % 2]]}} for k, n in enumerate(names)]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8")
    opened = F.transform("rings", lambda r: F.slice(r, F.lit(1), F.size(r) - 1))
    want = readers.read_geojson(spark, str(tmp_path / "g.json"), "NAME string").withColumn("rings", opened)
    assert out.select("ord", "NAME", "rings").orderBy("ord").collect() == want.select("ord", "NAME", "rings").orderBy("ord").collect()


def test_points_nulls_and_deleted_rows(spark, tmp_path):
    path = put(tmp_path, "p", written([shape(1, point=(1.5, 2.5)), shape(0), shape(11, point=(3, 4)), shape(21, point=(5, 6))], [("a",), ("b",), ("*c",), ("d",)], ["n"]))
    assert [(r.ord, r.n, r.lon, r.lat, r.rings) for r in readers.read_shapefile(spark, path, ["n"]).orderBy("ord").collect()] == [(0, "a", 1.5, 2.5, None), (1, "b", None, None, None), (3, "d", 5.0, 6.0, None)]
    assert readers.read_shapefile(spark, put(tmp_path, "e", written([], [], ["n"])), ["n"]).count() == 0


def broken(change):
    parts = written([shape(5, [SQUARE]), shape(5, [SQUARE])], [("a",), ("b",)], ["n"])
    change(parts)
    return parts


@pytest.mark.parametrize(
    "change",
    [
        lambda p: p.update({".shp": b"x" + p[".shp"][1:]}),
        lambda p: p.update({".shp": p[".shp"][:-20]}),
        lambda p: p.update({".shx": p[".shx"][:-4] + struct.pack(">i", 9999)}),
        lambda p: p.update({".shx": p[".shx"][:100] + p[".shx"][108:] + p[".shx"][100:108]}),
        lambda p: p.update({".dbf": p[".dbf"][:-10]}),
        lambda p: p.update({".dbf": p[".dbf"][:4] + struct.pack("<I", 3) + p[".dbf"][8:]}),
        lambda p: p.update({".shp": p[".shp"][:108] + struct.pack("<i", 31) + p[".shp"][112:]}),
        lambda p: p.update({".shp": p[".shp"][:148] + struct.pack("<i", 900) + p[".shp"][152:]}),
    ],
)
def test_broken_shapefiles_raise(tmp_path, change):
    path = put(tmp_path, "x", broken(change))
    source = archives.Shapefile({"columns": '["n"]', "paths": json.dumps([path])})
    reader = archives.ShapefileReader(None, source.options)
    with pytest.raises(ValueError):
        [r for p in reader.partitions() for r in reader.rows(p)]


def test_incomplete_archives_and_missing_columns_raise(spark, tmp_path):
    parts = written([shape(5, [SQUARE])], [("a",)], ["n"])
    path = put(tmp_path, "x", parts, zipfile.ZIP_STORED)
    with pytest.raises(Exception, match="no columns"):
        readers.read_shapefile(spark, path, ["m"]).collect()
    del parts[".prj"]
    with pytest.raises(Exception, match="complete shapefile"):
        readers.read_shapefile(spark, put(tmp_path, "y", parts, zipfile.ZIP_STORED), ["n"]).collect()


def test_hazards_are_valid_and_in_degrees(spark, tmp_path):
    at = lambda ring: [(300_000 + 100 * x, 2_770_000 + 100 * y) for x, y in ring]
    bow = [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]
    path = put(tmp_path, "x", written([shape(5, [at(SQUARE), at(HOLE)]), shape(5, [at(bow)]), shape(0), shape(5, [at(SQUARE)])], [("臺北市", "1"), ("新北市", "2"), ("臺北市", "3"), ("基隆市", "1")], ["city", "class"]), zipfile.ZIP_DEFLATED)
    out = {r["class"]: r for r in readers.read_hazards(spark, path, ["city", "class"], F.col("city").isin("臺北市", "新北市")).collect()}
    assert out.keys() == {"1", "2"} and [len(out[k].rings) for k in "12"] == [2, 2]
    assert all(121 < p.lon < 122 and 25 < p.lat < 25.1 for r in out.values() for ring in r.rings for p in ring)
    metres = {k: r.area * 111_000 * 111_000 * 0.9063 for k, r in out.items()}  # cos of 25.03 degrees
    assert metres == pytest.approx({"1": 150_000, "2": 80_000}, rel=0.02)
