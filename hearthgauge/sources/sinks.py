"""Writers: partitioned tables with every group present, catalogues, fingerprints, staged release."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import archives

# Fixed value: bytes of a published file
MOST_BYTES = 5_000_000


def write_partitioned(rows: DataFrame, path: str, keys: list[str], order: list[str], records_per_file: int = 20_000) -> None:
    """`rows` by `keys`, in `order` inside a file. A group is dealt to as many tasks as it needs files, by its counted
    size, so a large one isn't one task's and a small one is one file."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / records_per_file).alias("__files")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(sizes[f"__{k}"]) for k in keys))
    dealt = rows.join(sizes, same).withColumn("__salt", F.pmod(F.xxhash64(*order), "__files")).select(*rows.columns, "__salt")
    dealt.repartition(*keys, "__salt").drop("__salt").sortWithinPartitions(*keys, *order).write.mode("overwrite").option("maxRecordsPerFile", records_per_file).partitionBy(*keys).parquet(path)


def group_catalog(rows: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Every group of `dimension` with its number of rows, those without any included."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("record_count"))
    return dimension.join(n, keys, "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def oversized(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    return file_sizes(spark, path).where(F.col("length") > most)


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names, relative to the folder, and the bytes of all files below it, in the order of names.

    A digest has one order, so the files pass the driver one partition after another; published files are at most
    MOST_BYTES long.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digest = hashlib.sha256()
    for f in files.select(F.substring("path", len(root) + 2, 1 << 30).alias("name"), "content").orderBy("name").toLocalIterator():
        digest.update(f.name.encode())
        digest.update(f.content)
    return digest.hexdigest()


#: Bytes of a file that are hashed as one.
BLOCK = 8 << 20


def tree_fingerprint(spark: SparkSession, path: str, block: int = BLOCK) -> str:
    """SHA-256 of a tree over all files below a folder, whatever their sizes: blocks of `block` bytes are hashed by the
    executors, a file's digest is that of its blocks' digests in order, and files are gathered by the first two digits
    of their names' digests. The driver gets 256 digests at most and no content. A changed name or byte, a block moved
    and a file added or left out change it; the order in which files are found does not. Empty files are not listed.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    blocks = file_sizes(spark, path).select(F.substring("path", len(root) + 2, 1 << 30).alias("name"), "path", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / block) - 1, F.lit(0)))).alias("k"))

    def run(batches):
        for batch in batches:
            names, paths, ks = (c.to_pylist() for c in batch.columns)
            found = []
            for file, k in zip(paths, ks, strict=True):
                with archives.opened(file) as f:
                    f.seek(k * block)
                    found.append(hashlib.sha256(f.read(block)).hexdigest())
            yield pa.RecordBatch.from_pydict({"name": names, "k": pa.array(ks, pa.int64()), "digest": found})

    # dealt by block, so one large file is many tasks' work
    hashed = blocks.repartition("path", "k").select("name", "path", F.col("k").cast("long").alias("k")).mapInArrow(run, "name string, k long, digest string")
    joined = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda r: F.concat_ws(":", r["name"], r["digest"])), "\n")
    files = hashed.groupBy("name").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "digest"))), lambda r: r["digest"]), "\n"), 256).alias("digest"))
    parts = files.groupBy(F.left(F.sha2("name", 256), F.lit(2)).alias("part")).agg(F.sha2(joined(F.struct("name", "digest")), 256).alias("digest"))
    return hashlib.sha256("\n".join(f"{r.part}:{r.digest}" for r in parts.orderBy("part").collect()).encode()).hexdigest()


class Versions:
    """Versions of a published folder on any store that Hadoop knows, and a pointer to the one that counts.

    A version is a folder below `root` that is written once; the pointer is a file that is replaced by one rename. So a
    reader sees the old version or the new one, never parts of both, and a release that fails leaves the pointer alone.
    """

    POINTER = "_current"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.Path(f"{self.root}/{name}" if name else self.root)

    def current(self) -> str | None:
        """Folder of the version that counts; null before the first release."""
        if not self.fs.exists(self._path(self.POINTER)):
            return None
        f = self.fs.open(self._path(self.POINTER))
        try:
            return f"{self.root}/{f.readUTF()}"
        finally:
            f.close()

    def point_to(self, version: str) -> None:
        """Makes a version the one that counts, an earlier one as well; one that is not there raises."""
        name = version.rstrip("/").rpartition("/")[2]
        if not self.fs.exists(self._path(name)):
            raise FileNotFoundError(version)
        part = self._path(f"{self.POINTER}.{uuid.uuid4().hex}.part")
        out = self.fs.create(part, True)
        out.writeUTF(name)
        out.close()
        rename = getattr(self.jvm, "Options$Rename")
        over = self.spark._sc._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context = self.jvm.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(part), self.fs.makeQualified(self._path(self.POINTER)), over)
        except Exception:
            self.fs.delete(part, False)
            raise

    def release(self, write: Callable[[str], None], check: Callable[[str], None] = lambda folder: None) -> str:
        """Folder of a new version that `write` filled and `check` did not refuse; if either raises, nothing is left of it."""
        folder = f"{self.root}/v-{uuid.uuid4().hex}"
        try:
            write(folder)
            check(folder)
            self.point_to(folder)
        except Exception:
            self.fs.delete(self.jvm.Path(folder), True)
            raise
        return folder

    def prune(self, keep: list[str]) -> None:
        """Deletes versions other than the one that counts and those named."""
        names = {v.rstrip("/").rpartition("/")[2] for v in [*keep, self.current() or ""]}
        for s in self.fs.listStatus(self._path("")):
            if s.isDirectory() and s.getPath().getName().startswith("v-") and s.getPath().getName() not in names:
                self.fs.delete(s.getPath(), True)


def write_json_atomic(value: object, path: str) -> None:
    """A small JSON file on the driver's disk, complete or not there."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    Path(part).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(part, path)


def export_json(rows: DataFrame, path: str, order: list[str], most: int = 1_000) -> int:
    """A small result, such as a comparison or the candidates of an audit, as one JSON list; more than `most` rows raise."""
    held = [json.loads(r[0]) for r in rows.orderBy(*order).limit(most + 1).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).collect()]
    if len(held) > most:
        raise ValueError(f"more than {most} rows")
    write_json_atomic(held, path)
    return len(held)


def replace_folder(staged: str, target: str) -> None:
    """`staged` in place of `target`; if that fails, the old folder is back."""
    old = f"{target}.{uuid.uuid4().hex}.old"
    had = os.path.exists(target)
    if had:
        os.rename(target, old)
    try:
        os.rename(staged, target)
    except OSError:
        if had:
            os.rename(old, target)
        raise
    if had:
        shutil.rmtree(old)


def to_geojson(properties: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """A point feature as JSON text; only the named properties, so nothing private slips in."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def forbidden_fields(df: DataFrame, names: tuple[str, ...] = ("address", "tel", "phone")) -> list[str]:
    """Paths of fields, nested ones included, with a forbidden name."""
    found: list[str] = []

    def walk(kind, path: str) -> None:
        if hasattr(kind, "elementType"):
            walk(kind.elementType, path)
        elif hasattr(kind, "valueType"):
            walk(kind.valueType, path)
        elif hasattr(kind, "fields"):
            for f in kind.fields:
                own = f"{path}.{f.name}" if path else f.name
                if f.name.lower() in names:
                    found.append(own)
                walk(f.dataType, own)

    walk(df.schema, "")
    return found
