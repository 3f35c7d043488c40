"""Python data sources for archives and shapefiles: a partition for each member or range of records, read as a stream."""

from __future__ import annotations

import csv
import io
import json
import struct
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and letters of their fields, in a batch.
BATCH_ROWS, BATCH_LETTERS = 5_000, 4 << 20
#: Letters of the longest field; a quote that isn't closed runs past it and raises.
LONGEST_FIELD = 16 << 20
CHUNK = 1 << 20


def opened(path: str):
    """A seekable binary file of a path or URI, on any store that pyarrow knows; nothing is read ahead."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb")  # noqa: SIM115  closed by the caller
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def zip_members(file, pattern: str) -> list[str]:
    """Names in an archive's directory that fit the pattern; what is no ZIP archive raises."""
    if file.read(2) != b"PK":
        raise ValueError("no ZIP archive")
    file.seek(0)
    with zipfile.ZipFile(file) as z:
        return [n for n in z.namelist() if fnmatch(n, pattern)]


def sections(lines: Iterable[str], header: str | None) -> Iterator[dict[str, str]]:
    """Rows of the lines of a CSV text; with `header`, a header may begin anywhere in a line, after its last occurrence,
    again and again."""
    names: list[str] | None = None
    for fields in csv.reader(lines):
        line = ",".join(fields)
        if header is not None and header in line:
            names = [x.lstrip("﻿").strip() for x in next(csv.reader([line[line.rindex(header) :]]))]
            continue
        if not "".join(fields).strip():
            continue
        if names is None:
            if header is None:
                names = [x.lstrip("﻿").strip() for x in fields]
            continue
        yield dict(zip(names, [*fields, *[""] * len(names)], strict=False))


def occurrences(file, what: bytes) -> int:
    """How often `what` occurs in a stream, read in chunks."""
    n, rest = 0, b""
    while chunk := file.read(CHUNK):
        rest += chunk
        n += rest.count(what)
        rest = rest[rest.rfind(what) + len(what) if what in rest else 0 :][-(len(what) - 1) :] if len(what) > 1 else b""
    return n


def batched(rows: Iterator[tuple], schema: pa.Schema, letters) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += letters(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_LETTERS:
            yield give()
            held, size = [], 0
    if held:
        yield give()


@dataclass
class Member(InputPartition):
    archive: str
    name: str


class ZipCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.columns = schema, json.loads(options["columns"])
        self.paths, self.pattern = json.loads(options["paths"]), options["members"]
        self.header, self.skip = options.get("header") or None, options.get("skip", "").lower()
        self.encoding = options.get("encoding", "utf-8-sig")

    def partitions(self) -> list[Member]:
        found = []
        for path in self.paths:
            with opened(path) as f:
                found += [Member(path, n) for n in zip_members(f, self.pattern)]
        return found

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where there are no partitions
            return
        csv.field_size_limit(LONGEST_FIELD)
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            n = 1
            if self.header:
                with z.open(partition.name) as m:
                    n = occurrences(m, self.header.encode(self.encoding.removesuffix("-sig")))
            with z.open(partition.name) as m, io.TextIOWrapper(m, self.encoding, newline="") as lines:
                found = (r for r in sections(lines, self.header) if not self.skip or next(iter(r.values()), "").lower() != self.skip)
                rows = ((partition.archive, partition.name, n, k, *(r.get(c, "") for c in self.columns)) for k, r in enumerate(found))
                yield from batched(rows, to_arrow_schema(self.schema), lambda row: sum(map(len, row[4:])))


class ZipCsv(DataSource):
    """Rows of CSV members of ZIP archives. A partition is a member; it is inflated as a stream and never held whole."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv_members"

    def schema(self) -> str:
        return "archive string, member string, header_count long, ord long, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> ZipCsvReader:
        return ZipCsvReader(schema, dict(self.options))


# ---- shapefiles

#: Kinds of shapes: what they are without heights and measures.
KINDS = {0: None, 1: "point", 11: "point", 21: "point", 5: "polygon", 15: "polygon", 25: "polygon"}


def shapefile_entry(names: list[str]) -> str:
    """The one .shp of an archive; it must have its .dbf, .prj and .shx beside it."""
    found = [n for n in names if n.lower().endswith(".shp")]
    lower = {n.lower() for n in names}
    if len(found) != 1 or any(found[0].lower()[:-4] + e not in lower for e in (".dbf", ".prj", ".shx")):
        raise ValueError("an archive must hold one complete shapefile")
    return found[0]


def geometry(content: bytes) -> tuple[list | None, float | None, float | None]:
    """(rings, lon, lat) of a record's content. Outer rings of a shapefile run with the clock and holes against it; they
    are turned round, as in GeoJSON, and left open."""
    (code,) = struct.unpack_from("<i", content)
    if code not in KINDS:
        raise ValueError(f"shapes of type {code} are not read")
    if KINDS[code] is None:
        return None, None, None
    if KINDS[code] == "point":
        x, y = struct.unpack_from("<2d", content, 4)
        return None, x, y
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_parts)
    if starts[:1] != [0] and n_points or any(a > b for a, b in zip(starts, starts[1:], strict=False)):
        raise ValueError("a shape's parts are out of order")
    rings = []
    for a, b in zip(starts, starts[1:], strict=False):
        ring = [{"lon": flat[2 * k], "lat": flat[2 * k + 1]} for k in range(b - 1, a - 1, -1)]
        rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    return rings, None, None


@dataclass
class Records(InputPartition):
    path: str
    entry: str  # in an archive; else empty
    start: int
    end: int


class ShapefileParts:
    """The .shp, .shx and .dbf of a path, or of an archive."""

    def __init__(self, path: str, entry: str = ""):
        self.path, self.held = path, []
        self.zip = None
        if path.lower().endswith(".zip"):
            self.held.append(f := opened(path))
            self.zip = zipfile.ZipFile(f)
            self.held.append(self.zip)
            self.entry = entry or shapefile_entry(self.zip.namelist())

    def __enter__(self) -> ShapefileParts:
        return self

    def __exit__(self, *_) -> None:
        for f in reversed(self.held):
            f.close()

    def part(self, extension: str):
        if self.zip is None:
            f = opened(self.path[:-4] + (extension if self.path.endswith(".shp") else extension.upper()))
        else:
            want = (self.entry[:-4] + extension).lower()
            # a handle each: members of one share its place when they seek
            self.held.append(own := opened(self.path))
            self.held.append(z := zipfile.ZipFile(own))
            f = z.open(next(n for n in z.namelist() if n.lower() == want))
        self.held.append(f)
        return f

    def seekable(self) -> bool:
        """Whether a place can be gone to without reading what is before it: a member that is stored, or a plain file."""
        return self.zip is None or self.zip.getinfo(self.entry).compress_type == zipfile.ZIP_STORED


def _exactly(file, n: int) -> bytes:
    data = file.read(n)
    if len(data) != n:
        raise ValueError("a shapefile ends before its records do")
    return data


def shape_header(file) -> int:
    """Length in bytes that the header of a .shp or .shx gives."""
    head = _exactly(file, 100)
    if struct.unpack_from(">i", head)[0] != 9994 or struct.unpack_from("<i", head, 28)[0] != 1000:
        raise ValueError("no shapefile")
    return 2 * struct.unpack_from(">i", head, 24)[0]


def table_header(file) -> tuple[int, int, int, list[tuple[str, int, int]]]:
    """Records, first byte, bytes a record, and fields (name, place, width) of a .dbf."""
    n, first, width = struct.unpack_from("<IHH", _exactly(file, 32), 4)
    fields, at = [], 1
    for one in struct.iter_unpack("<11sc4xBB14x", _exactly(file, (first - 33) // 32 * 32)):
        fields.append((one[0].split(b"\0")[0].decode("ascii", "replace"), at, one[2]))
        at += one[2]
    if at > width:
        raise ValueError("the fields of a table are wider than its records")
    return n, first, width, fields


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.columns = schema, json.loads(options["columns"])
        self.paths, self.records = json.loads(options["paths"]), int(options.get("records", 20_000))
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self) -> list[Records]:
        found = []
        for path in self.paths:
            with ShapefileParts(path) as p:
                n = (shape_header(p.part(".shx")) - 100) // 8
                if table_header(p.part(".dbf"))[0] != n:
                    raise ValueError(f"{path} has not as many shapes as rows")
                step = self.records if p.seekable() else max(n, 1)
                found += [Records(path, getattr(p, "entry", ""), k, min(k + step, n)) for k in range(0, n, step)]
        return found

    def rows(self, part: Records) -> Iterator[tuple]:
        with ShapefileParts(part.path, part.entry) as p:
            index, shapes, table = p.part(".shx"), p.part(".shp"), p.part(".dbf")
            end = shape_header(shapes)
            _, first, width, fields = table_header(table)
            missing = set(self.columns) - {f[0] for f in fields}
            if missing:
                raise ValueError(f"{part.path} has no columns {sorted(missing)}")
            places = {name: slice(at, at + n) for name, at, n in fields}
            index.seek(100 + 8 * part.start)
            table.seek(first + width * part.start)
            for k in range(part.start, part.end):
                at, size = (2 * x for x in struct.unpack(">2i", _exactly(index, 8)))
                if not 100 <= at <= at + 8 + size <= end:
                    raise ValueError(f"record {k} lies beyond {part.path}")
                shapes.seek(at)
                if struct.unpack(">2i", _exactly(shapes, 8)) != (k + 1, size // 2):
                    raise ValueError(f"record {k} is not where the index of {part.path} says")
                try:
                    shape = geometry(_exactly(shapes, size))
                except struct.error as e:
                    raise ValueError(f"record {k} of {part.path} is broken") from e
                row = _exactly(table, width)
                if row[:1] != b"*":  # deleted
                    yield part.path, k, *(row[places[c]].decode(self.encoding).strip(" \0") for c in self.columns), *shape

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        yield from batched(self.rows(partition) if partition else iter(()), to_arrow_schema(self.schema), lambda row: 40 * sum(map(len, row[-3] or ())))


class Shapefile(DataSource):
    """Features of shapefiles. A partition is a range of records, found by the index; an archive whose .shp is deflated is one."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "file string, ord long, " + "".join(f"`{c}` string, " for c in json.loads(self.options["columns"])) + "rings array<array<struct<lon:double,lat:double>>>, lon double, lat double"

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(schema, dict(self.options))
