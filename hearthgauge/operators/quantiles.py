"""Exact quantiles of groups of any size, by histograms that are refined where the wanted ranks lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import Scratch

#: Bins of a histogram, which is all that a task holds of a group.
BINS = 1024


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Per group of `rows`: keys, n (values), q (array, one for each probability, interpolated between the two values
    next to its rank as quantile_cont does).

    Values are counted first, so repeated ones cost nothing further. Each round counts the values of the interval that
    holds a rank in BINS bins and goes on with the least and the largest value of the bin it falls in, until they are
    equal. So no task holds a group's values, and rounds are few: an interval shrinks by BINS at least. Counts and
    intervals are aggregations that combine before their shuffle. Nulls and NaN are left out, infinite values raise; a
    group without values has n = 0 and q null. Null keys are a group.
    """
    scratch = Scratch(rows.sparkSession, "quantiles")
    c = F.col
    own = rows.select(F.struct(*keys).alias("g"), c(value).cast("double").alias("v"))
    counted = scratch.save(own.withColumn("v", F.when(~F.isnan("v"), c("v"))).groupBy("g", "v").agg(F.count("*").alias("n")), "counted")
    groups = counted.groupBy("g").agg(F.coalesce(F.sum(F.when(c("v").isNotNull(), c("n"))), F.lit(0)).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = [F.lit(p) * (c("total") - 1) for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in at))))
    finite = F.when((F.abs("low") < float("inf")) & (F.abs("high") < float("inf")), c("low")).otherwise(F.raise_error(F.lit("a value is infinite")).cast("double"))
    wanted = groups.where("total > 0").select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), finite.alias("low"), "high")
    wanted = scratch.save(wanted, "wanted-0")
    done, k = [wanted.where("low = high")], 0
    while not (left := wanted.where("low < high")).isEmpty():
        spans = left.select("g", "low", "high").distinct()
        held = counted.join(spans, "g").where(c("v").between(c("low"), c("high")))
        half = c("high") / 2 - c("low") / 2  # the difference of two large values may have no double
        place = F.least(F.floor((c("v") / 2 - c("low") / 2) / half * BINS), F.lit(BINS - 1)).cast("int")
        bins = held.groupBy("g", "low", "high", place.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("n").over(Window.partitionBy("g", "low", "high").orderBy("bin")) - c("n")
        met = left.join(bins.withColumn("before", before), ["g", "low", "high"])
        met = met.where((c("rank") - c("below") >= c("before")) & (c("rank") - c("below") < c("before") + c("n")))
        k += 1
        wanted = scratch.save(met.select("g", "rank", (c("below") + c("before")).alias("below"), c("least").alias("low"), c("most").alias("high")), f"wanted-{k}")
        done.append(wanted.where("low = high"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", c("low").alias("v")))).alias("at"))

    def quantile(x):
        low, high = F.try_element_at("at", F.floor(x)), F.try_element_at("at", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    joined = groups.select("g", "total").join(values, "g", "left")
    return joined.select(*(c(f"g.{x}").alias(x) for x in keys), c("total").alias("n"), F.when(c("at").isNotNull(), F.array(*map(quantile, at))).alias("q"))

