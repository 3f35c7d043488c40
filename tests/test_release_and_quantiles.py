import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from hearthgauge.operators.quantiles import exact_quantiles
from hearthgauge.sources import sinks

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def quantiles(df, keys=("g",)):
    return {tuple(r[k] for k in keys): (r.n, r.q and [round(x, 6) for x in r.q]) for r in exact_quantiles(df, [*keys], "v", PROBABILITIES).collect()}


@pytest.mark.parametrize("draw", ["even", "steep", "few", "near"])
def test_quantiles_equal_sql(spark, draw):
    rng = random.Random(draw)
    one = {"even": lambda: rng.uniform(-1e6, 1e6), "steep": lambda: 10 ** rng.uniform(-6, 6), "few": lambda: float(rng.randrange(4)), "near": lambda: 1 + rng.randrange(5000) * 2.0**-50}[draw]
    rows = [(g, one()) for g, n in (("a", 3000), ("b", 1), ("c", 2), (None, 7)) for _ in range(n)] + [("a", None), ("d", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    held = [(g, v) for g, v in rows if v is not None and v == v]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (g VARCHAR, v DOUBLE)")
    c.executemany("INSERT INTO t VALUES (?, ?)", held)
    want = {(g,): (n, [round(x, 6) for x in q]) for g, n, q in c.execute(f"SELECT g, count(*), quantile_cont(v, {PROBABILITIES}) FROM t GROUP BY g").fetchall()}
    assert quantiles(df) == want | {("d",): (0, None)}


def test_quantiles_of_a_hot_group_and_of_nothing(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.lit("x").alias("h"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    n, q = quantiles(df, ("g", "h"))[1, "x"]
    values = sorted(k * 7919 % 200_003 for k in range(200_000))
    assert n == 200_000 and q[2] == statistics.median(values) and (q[0], q[5]) == (values[0], values[-1])
    assert quantiles(df.limit(0)) == {}
    with pytest.raises(Exception, match="infinite"):
        quantiles(spark.createDataFrame([("a", 1.0), ("a", float("inf"))], "g string, v double"))


def test_fingerprint_of_a_tree(spark, tmp_path):
    folder = tmp_path / "f"
    (folder / "deep er").mkdir(parents=True)
    rng = random.Random(2)
    blocks = [rng.randbytes(100) for _ in range(5)]

    def put(name="a.bin", content=b"".join(blocks) + b"tail"):
        (folder / name).write_bytes(content)
        return sinks.tree_fingerprint(spark, str(folder), block=100)

    first = put()
    seen = {first, put("deep er/b.json", b"x")}
    whole = put("empty", b"")
    assert whole in seen and len(seen) == 2  # Spark lists no empty files
    assert whole == put() and whole == sinks.tree_fingerprint(spark, str(folder), block=100)
    seen |= {whole, put(content=b"".join(blocks[::-1]) + b"tail"), put(content=b"".join(blocks) + b"tail!")}
    put()
    (folder / "deep er/b.json").rename(folder / "deep er/c.json")
    seen.add(sinks.tree_fingerprint(spark, str(folder), block=100))
    assert len(seen) == 5


def test_versions_swap_whole_or_not_at_all(spark, tmp_path):
    held = sinks.Versions(spark, f"file://{tmp_path}/t")
    write = lambda n: lambda folder: spark.range(n).write.parquet(folder)
    count = lambda: spark.read.parquet(held.current()).count()
    assert held.current() is None
    one = held.release(write(1))
    reader = spark.read.parquet(held.current())  # opened before the swap
    two = held.release(write(2))
    assert count() == 2 and reader.count() == 1 and held.current() == two

    def refuse(folder):
        raise ValueError(f"{spark.read.parquet(folder).count()} rows")

    with pytest.raises(ValueError, match="3 rows"):
        held.release(write(3), refuse)
    with pytest.raises(ZeroDivisionError):
        held.release(lambda folder: 1 / 0)
    with pytest.raises(FileNotFoundError):
        held.point_to(f"{held.root}/v-none")
    assert held.current() == two and count() == 2
    held.point_to(one)
    assert count() == 1
    held.prune([])
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["_current", one.rpartition("/")[2]]


def test_a_failed_swap_leaves_the_old_pointer(spark, tmp_path, monkeypatch):
    held = sinks.Versions(spark, str(tmp_path / "t"))
    held.release(lambda folder: spark.range(1).write.parquet(folder))
    before = held.current()
    monkeypatch.setattr(sinks.Versions, "point_to", lambda self, v: (_ for _ in ()).throw(OSError("no rename")))
    with pytest.raises(OSError):
        held.release(lambda folder: spark.range(5).write.parquet(folder))
    assert held.current() == before and spark.read.parquet(before).count() == 1
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1
