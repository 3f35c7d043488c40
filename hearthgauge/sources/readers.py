"""Readers of the published files: text tables, JSON, GeoJSON, archives. All values are read as text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.geo import wgs84_rings
from ..operators.overlay import make_valid
from . import archives

# The subtitle row of sale files; the column a repeated accident header begins with
SUBTITLE = "The villages and towns urban district"
ACCIDENT_HEADER = "發生年度"


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def _unclosed(spark: SparkSession, path: str) -> str | None:
    """A file with an odd number of quotes. Counted in bytes, so any encoding that keeps ASCII will do."""
    line = F.col("value")
    quotes = F.sum(F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit(""))))
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(quotes.alias("n")).where("n % 2 = 1").agg(F.min("file")).first()[0]


def read_csv(spark: SparkSession, path: str, columns: list[str], multiline: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Rows of CSV files with a header, all columns text, the English subtitle row left out.

    multiline reads quoted line ends, and raises if a file has an unclosed quote, which the parser would let pass: its
    quotes are counted in a scan of its own. Big5 needs spark.sql.legacy.javaCharsets.
    """
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("enforceSchema", True)
    if multiline:
        opened = _unclosed(spark, path)
        if opened:
            raise ValueError(f"unclosed quote in {opened}")
        reader = reader.option("multiLine", True).option("mode", "FAILFAST")
    rows = reader.csv(path)
    return rows.where(~F.coalesce(F.lower(F.col(f"`{columns[0]}`")), F.lit("")).eqNullSafe(SUBTITLE.lower())).na.fill("")


def read_json_rows(spark: SparkSession, path: str, schema: str, into: str | None = None) -> DataFrame:
    """Rows of JSON files: a list, or the list at the dotted path `into` of an object."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw if into is None else raw.select(F.explode(into).alias("r")).select("r.*")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of FeatureCollections: ord (per file), file, properties, and rings of Polygon and MultiPolygon or lon and lat of Point.

    Files that aren't collections (HTML error pages among them) raise.
    """
    names = [p.split()[0].split(":")[0] for p in properties.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                text = bytes(content).decode("utf-8-sig")
                data = json.loads(text) if text.lstrip()[:1] == "{" else None
                if not isinstance(data, dict) or data.get("type") != "FeatureCollection":
                    raise ValueError(f"{path} is no FeatureCollection")
                for k, f in enumerate(data["features"]):
                    for g in polygons(f.get("geometry") or {}):
                        own = f.get("properties") or {}
                        rows.append((path, k, *(None if own.get(n) is None else str(own[n]) for n in names), *g))
            yield pd.DataFrame(rows, columns=["file", "ord", *names, "rings", "lon", "lat"])

    fields = "file string, ord long, " + ", ".join(f"`{n}` string" for n in names) + ", rings array<array<struct<lon:double,lat:double>>>, lon double, lat double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, fields)


def polygons(geometry: dict) -> Iterator[tuple[list | None, float | None, float | None]]:
    """(rings, lon, lat) of a geometry: one for points, one for all rings of its polygons; collections are flattened."""
    kind, c = geometry.get("type"), geometry.get("coordinates")
    ring = lambda r: [{"lon": float(p[0]), "lat": float(p[1])} for p in r]
    if kind == "Point":
        yield None, float(c[0]), float(c[1])
    elif kind == "Polygon":
        yield [ring(r) for r in c], None, None
    elif kind == "MultiPolygon":
        yield [ring(r) for part in c for r in part], None, None
    elif kind == "GeometryCollection":
        for g in geometry["geometries"]:
            if g["type"] in ("Polygon", "MultiPolygon", "GeometryCollection"):
                yield from polygons(g)


def _paths(spark: SparkSession, path: str) -> str:
    """Names of the files of a path or pattern, as JSON; only names come to the driver."""
    return json.dumps([r.path for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()])


def read_zip_csv(spark: SparkSession, path: str, members: str, columns: list[str], header: str | None = None, encoding: str = "utf-8-sig") -> DataFrame:
    """Rows of the CSV members of ZIP archives: archive, member, header_count, ord, columns (text; missing ones empty).

    Each member is a task, which inflates it as a stream and holds some thousand rows, as headers repeat inside a member.
    What isn't a ZIP raises, and so does a quote that isn't closed and a member that is cut short. Archives are opened by
    the executors at the paths that Spark lists, on any store that pyarrow knows.
    """
    spark.dataSource.register(archives.ZipCsv)
    source = spark.read.format("zip_csv_members").option("paths", _paths(spark, path)).option("columns", json.dumps(columns))
    return source.option("members", members).option("header", header or "").option("skip", SUBTITLE).option("encoding", encoding).load()


def read_shapefile(spark: SparkSession, path: str, columns: list[str], encoding: str = "utf-8", records: int = 20_000) -> DataFrame:
    """Features of shapefiles, plain (.shp beside .shx and .dbf) or in ZIP archives of one each: file, ord (per file),
    columns (text), and rings of polygons or lon and lat of points, in the file's own coordinates.

    A task reads `records` records by the index. Broken or cut files, wrong indexes and missing columns raise; deleted
    rows are left out; null shapes have null rings, lon and lat.
    """
    spark.dataSource.register(archives.Shapefile)
    return spark.read.format("shapefile").option("paths", _paths(spark, path)).option("columns", json.dumps(columns)).option("encoding", encoding).option("records", records).load()


def read_hazards(spark: SparkSession, path: str, columns: list[str], where: Column, encoding: str = "utf-8") -> DataFrame:
    """Polygons of shapefiles in TWD97 TM2 as valid ones in WGS84: file, ord, columns, area, rings. `where` is on the columns."""
    found = read_shapefile(spark, path, columns, encoding).where(where & F.col("rings").isNotNull())
    keys = ["file", "ord", *columns]
    return make_valid(found.select(*keys, wgs84_rings(F.col("rings")).alias("rings")), keys)


def paged(spark: SparkSession, folder: str, columns: list[str], page_rows: int = 100_000, most_pages: int = 31) -> DataFrame:
    """Rows of an API's pages, one file a page named in order; all but the last must be full, at most `most_pages` of them."""
    rows = read_csv(spark, folder, columns).withColumn("page", F.col("_metadata.file_path"))
    sizes = [r["count"] for r in rows.groupBy("page").count().orderBy("page").limit(most_pages + 1).collect()]
    if len(sizes) > most_pages or any(n < page_rows for n in sizes[:-1]):
        raise ValueError(f"more than {most_pages} pages, or a short one before the last: {sizes}")
    return rows.drop("page")


def json_path(text: Column, path: str, kind: str) -> Column:
    """A value of a JSON text."""
    return F.get_json_object(text, path).try_cast(kind)


def read_tolerant(readers: dict[str, object]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results of readers (functions without arguments) by source, and the errors of those that failed."""
    good, failed = {}, {}
    for name, reader in readers.items():
        try:
            good[name] = reader()
            good[name].schema  # noqa: B018  a missing file shows here
        except Exception as e:  # noqa: BLE001  a source's failure must not stop the others
            failed[name] = str(e).split("\n")[0]
    return good, failed
