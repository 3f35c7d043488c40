"""The ambiguity index kept up to date while files of coordinates come, in any order.

The state of a key is its first coordinate so far, its number of rows, and the convex hull of its coordinates: a row that
comes later may have a smaller ordinal and so become the first, and the coordinate farthest from any first one is a corner
of that hull. Once two coordinates are more than twice the tolerance apart, one of them is too far from any first
coordinate; the key then stays ambiguous and keeps those two alone. So a key's state is a few coordinates, whatever its
number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.geo import METRES_LAT, METRES_LON

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = StructType().add("ord", LongType()).add("lat", DoubleType()).add("lon", DoubleType()).add("n", LongType()).add("lats", ArrayType(DoubleType())).add("lons", ArrayType(DoubleType()))
#: Square metres by which a corner must turn inwards to be left out; all that is on the border, or nearly, stays.
TURN = 1e-6
#: Coordinates of a key in a batch above which those inside its hull are left out before the shuffle.
FEW = 8


def metres(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> np.ndarray:
    """As `geo.planar`."""
    return np.hypot((lat - lat0) * METRES_LAT, (lon - lon0) * METRES_LON)


def hull(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places of distinct coordinates on the border of the convex hull, or so near to it that rounding could decide."""
    if len(lat) < 3:
        return np.arange(len(lat))
    x, y = (lat - lat[0]) * METRES_LAT, (lon - lon[0]) * METRES_LON
    order = np.lexsort((y, x))
    kept: set[int] = set()
    for way in (order, order[::-1]):
        chain: list[int] = []
        for c in way.tolist():
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a]) >= -TURN:
                    break
                chain.pop()
            chain.append(c)
        kept.update(chain)
    return np.array(sorted(kept))


def corners(lat: np.ndarray, lon: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """What a key has to keep of its coordinates: two that are more than twice the tolerance apart, else the hull."""
    spots = np.unique(np.stack([lat, lon], 1), axis=0)
    lat, lon = spots[:, 0], spots[:, 1]
    a = int(np.argmax(metres(lat, lon, lat[0], lon[0])))
    away = metres(lat, lon, lat[a], lon[a])
    b = int(np.argmax(away))
    keep = np.array([a, b]) if away[b] > 2 * tolerance * (1 + 1e-9) else hull(lat, lon)
    return lat[keep], lon[keep]


def combined(keys: list[str]):
    """Rows of one Arrow batch as one row a key and coordinate, without those inside the hull of a key with many, so that
    a key with a third of all rows crosses the shuffle as a few rows a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spots = pdf.groupby([*keys, "lat", "lon"], sort=False, as_index=False).agg(ord=("ord", "min"), n=("ord", "size"))
            spots = spots.sort_values([*keys, "ord", "lat", "lon"], ignore_index=True)
            number = spots.groupby(keys, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            ends = np.append(starts[1:], len(spots))
            lat, lon, n = (spots[c].to_numpy(copy=True) for c in ("lat", "lon", "n"))
            stays = np.ones(len(spots), bool)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > FEW:
                    own = np.zeros(e - s, bool)
                    own[hull(lat[s:e], lon[s:e])] = True
                    own[0] = True
                    stays[s:e] = own
                    n[s] += n[s:e][~own].sum()
            yield spots.assign(n=n)[stays][[*keys, "ord", "lat", "lon", "n"]]

    return run


class Index(StatefulProcessor):
    """First coordinate, hull and number of rows of each key; a changed key is a row of the result."""

    def __init__(self, keys: list[str], tolerance: float):
        self.keys, self.tolerance = keys, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, n, lat, lon = None, 0, np.empty(0), np.empty(0)
        if self.state.exists():
            o, la, lo, n, lats, lons = self.state.get()
            first, lat, lon = (o, la, lo), np.array(lats, float), np.array(lons, float)
        for pdf in rows:
            if not len(pdf):
                continue
            best = pdf[["ord", "lat", "lon"]].sort_values(["ord", "lat", "lon"]).iloc[0]
            best = (int(best["ord"]), float(best["lat"]), float(best["lon"]))
            first = best if first is None else min(first, best)
            n += int(pdf["n"].sum())
            lat, lon = corners(np.append(lat, pdf["lat"].to_numpy(float)), np.append(lon, pdf["lon"].to_numpy(float)), self.tolerance)
        if first is None:
            return
        self.state.update((first[0], first[1], first[2], n, lat.tolist(), lon.tolist()))
        far = bool(metres(lat, lon, first[1], first[2]).max() > self.tolerance)
        yield pd.DataFrame([(*key, first[1], first[2], far, n)], columns=[*self.keys, "lat", "lon", "is_ambiguous", "n"])

    def close(self) -> None:
        pass


def index_changes(rows: DataFrame, keys: list[str], order: str, tolerance: float) -> DataFrame:
    """Of a stream of rows (keys, whole-number `order`, lat, lon): a row for each key whenever it changes, with the first
    coordinate by `order`, whether another lies more than `tolerance` metres off, and n, the rows so far.

    Rows without a key, order or coordinate, or with one that is no number, are left out. Of rows with equal order, the
    one with the smallest coordinate is first. Further columns are left out.
    """
    known = rows.select(*keys, F.col(order).cast("bigint").alias("ord"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna()
    fields = {f.name: f for f in known.schema.fields}
    key = [StructField(k, fields[k].dataType) for k in keys]
    spots = known.mapInPandas(combined(keys), StructType([*key, *(fields[c] for c in ("ord", "lat", "lon"))]).add("n", "long"))
    out = StructType(key).add("lat", "double").add("lon", "double").add("is_ambiguous", "boolean").add("n", "long")
    return spots.groupBy(*keys).transformWithStateInPandas(Index(keys, tolerance), out, "Append", "None")


def follow(changes: DataFrame, folder: str, checkpoint: str):
    """Starts a query that takes in all files that are there now and appends the changes to `folder`.

    A later start with the same `checkpoint` goes on from there. The state store of the query alone is RocksDB, which
    this kind of state needs and which keeps it on disk.
    """
    conf = changes.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def current_index(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The index as it stands: the change of each key with the most rows behind it. Usable in `lookup`."""
    values = ("lat", "lon", "is_ambiguous", "n")
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "n").alias("__v")).select(*keys, *(F.col(f"__v.{c}").alias(c) for c in values))
