"""Benchmark decontamination over word templates. DataFrame functions only.

Words become typed placeholders where a question can be given new values: numbers, units of measure and names (words
with a capital). Windows of template words of the documents and of the benchmark meet in a hash join. A document that
asks an item again with other values has its windows at one distance, or at near ones if it was edited, and each value of the item stands for one value
of the document throughout; windows that only look alike break that rule. Beside the templates, windows of the words
themselves meet without regard to case, so passages in capitals or small letters are found too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .columns import hash_windows, let
from ..sources.scratch import Scratch

WINDOW = 8
#: Words of a window that are not placeholders; below it a template says too little.
LITERALS_LEAST = 4
#: Distances that differ by no more belong to one copy of an item.
NEAR = 16
#: So many words of an item in a row are a hit, whatever part of it they are.
RUN = 13
#: Rows of a table that may be broadcast (some 40 bytes each), counted before; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
UNITS = "mm cm m km g kg mg ml l kwh mb gb tb km/h mph seconds minutes hours days weeks months years dollars euros cents percent miles feet inches pounds ounces liters litres meters metres kilometers kilometres grams kilograms degrees".split()
#: Numbers written out are numbers as well.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
NUMBER, NAME, UNIT = "\u0001n", "\u0001c", "\u0001u"


def raw_words(text: Column) -> Column:
    """Words without signs around them; empty ones left out. A sharp s, which has two capitals, is two letters."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("SS"))
    return F.filter(F.split(plain, "[^\\p{L}\\p{N}%$€/.]+|[./]+(?=[^\\p{L}\\p{N}]|$)"), lambda w: w != "")


def template_words(words: Column) -> Column:
    """Placeholders for numbers (with what is written to them, or written out), units and names; other words as they are."""
    first = lambda w: F.substr(w, F.lit(1), F.lit(1))
    # a capital differs from its lower-case form, a digit lies between 0 and 9; both without a pattern for each word
    return F.transform(
        words,
        lambda w: F.when(((w >= "0") & (w < ":")) | F.startswith(w, F.lit("$")) | F.startswith(w, F.lit("€")), F.lit(NUMBER)).when(first(w) != F.lower(first(w)), F.lit(NAME)).when(w.isin(*UNITS), F.lit(UNIT)).when(w.isin(*NUMBER_WORDS), F.lit(NUMBER)).otherwise(w),
    )


def folded_windows(words: Column, widths: list[int]) -> Column:
    """Windows of words without regard to case, of each of the widths in turn."""
    return let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), lambda x: F.concat(*(hash_windows(x, k) for k in widths)))


def template_windows(template: Column, width: int) -> Column:
    return hash_windows(F.transform(template, lambda w: F.xxhash64(w)), width)


def _opens(words: Column, i: Column) -> Column:
    """Whether element i of template words does not go on with the placeholder before it."""
    return ~F.startswith(words[i], F.lit("\u0001")) | (i == 0) | (words[F.greatest(i - 1, F.lit(0))] != words[i])


def collapsed(template: Column) -> Column:
    """Template words with one placeholder for neighbours alike, so a name or number may have any number of words."""
    return let(template, lambda t: F.filter(t, lambda _, i: _opens(t, i)))


def run_starts(template: Column) -> Column:
    """Place of each collapsed word among the words, and their number at the end."""
    return let(template, lambda t: F.concat(F.filter(F.transform(t, lambda _, i: i), lambda i: _opens(t, i)), F.array(F.size(t))))


def _small(table: DataFrame, n: int) -> DataFrame:
    """A table of `n` rows of some 40 bytes for a join: broadcast up to MOST_BROADCAST rows, else shuffled."""
    return F.broadcast(table) if n <= MOST_BROADCAST else table.hint("merge")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = 0.5) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, items (sorted item_ids found), n_windows, contaminated.

    An item of `benchmark` (item_id, text) is found where windows at distances near one another cover at least `share`
    of its words or RUN words in a row, by words regardless of case or by templates of which every placeholder's value
    maps to a single value. Templates whose values do not are held against the item unless all its words are there.
    Template windows with under LITERALS_LEAST plain words are left out; an item with fewer than `width` words is found
    where it stands whole, so one of a single word is found in each text with that word. An item_id with several texts
    is found where one of them is. Null and empty texts contain nothing; null item_ids are left out; equal rows have equal
    results; rows of one doc_id and different texts are judged apart. Other columns of both tables are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    plain = lambda words: F.size(F.filter(words, lambda w: ~F.startswith(w, F.lit("\u0001"))))
    # an item_id with several texts is as many items, found if one of them is
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", raw_words(F.col("text")).alias("item_words")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "item_words")).withColumn("full", template_words(F.col("item_words")))
    items = items.withColumns({"item_template": collapsed(F.col("full")), "item_places": run_starts(F.col("full"))}).drop("full")
    by_template = (
        items.select("item", "item_template", F.size("item_template").alias("of"), F.posexplode(template_windows(F.col("item_template"), width)).alias("item_at", "window"))
        .where(plain(F.slice("item_template", F.col("item_at") + 1, width)) >= LITERALS_LEAST)
        .select("item", "item_at", "window", "of", F.lit(False).alias("exact"))
    )
    folded = items.select("item", F.col("item_words").alias("w"), F.size("item_words").alias("of")).where("of > 0")
    whole = reduce(lambda a, k: F.when(F.col("of") == k, folded_windows(F.col("w"), [k])).otherwise(a), range(1, width), folded_windows(F.col("w"), [width]))
    by_words = folded.select("item", F.posexplode(whole).alias("item_at", "window"), "of", F.lit(True).alias("exact"))
    item_windows = scratch.save(by_template.unionByName(by_words), "items")
    n = item_windows.count()
    table = _small(item_windows, n)
    items = scratch.save(items, "texts")
    # items shorter than a window are matched whole; at most width - 1 lengths
    short = sorted(r["of"] for r in item_windows.where(F.col("exact") & (F.col("of") < width)).select("of").distinct().collect())

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    words = keyed.where("text IS NOT NULL").select("doc_id", "text_key", raw_words(F.col("text")).alias("words"))
    kind = lambda exact, hashes: F.struct(F.lit(exact).alias("exact"), hashes.alias("windows"))
    by_kind = let(F.col("words"), lambda w: F.array(kind(False, template_windows(collapsed(template_words(w)), width)), kind(True, folded_windows(w, [width, *short]))))
    windows = words.select("doc_id", "text_key", F.inline(by_kind)).select("doc_id", "text_key", "exact", F.posexplode("windows").alias("at", "window"))
    distance = F.when(F.col("exact") & (F.col("of") < width), 0).otherwise(F.col("at") - F.col("item_at")).alias("distance")
    hits = windows.join(table, ["window", "exact"]).select("doc_id", "text_key", "item", "exact", distance, "item_at", "of").distinct()
    pair = ["doc_id", "text_key", "item", "exact", "of"]
    at_one = hits.groupBy(*pair, "distance").agg(F.collect_set("item_at").alias("starts"))
    # words put in or left out shift what follows; distances near one another belong together
    order = Window.partitionBy(*pair).orderBy("distance")
    apart = F.coalesce((F.col("distance") - F.lag("distance").over(order) > NEAR).cast("int"), F.lit(0))
    grouped = at_one.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(order)).groupBy(*pair, "cluster").agg(F.collect_list(F.struct("distance", "starts")).alias("parts"))
    several = F.size("parts") > 1
    alone = F.when(several, F.transform("parts", lambda x: F.array(x))).otherwise(F.array().cast(f"array<{grouped.schema['parts'].dataType.simpleString()}>"))
    runs = grouped.select(*pair, F.explode(F.concat(F.array("parts"), alone)).alias("parts"))
    length = F.least(F.lit(width), F.col("of"))
    spread = lambda starts: F.flatten(F.transform(starts, lambda x: F.sequence(x, x + length - 1)))
    runs = runs.withColumns({"starts": F.array_distinct(F.flatten(F.col("parts.starts"))), "covered": F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda x: spread(x["starts"])))))})
    state = lambda last, n, most: F.struct(last.cast("int").alias("last"), n.cast("int").alias("n"), most.cast("int").alias("most"))

    def step(acc, x):
        n = F.when(x == acc["last"] + 1, acc["n"] + 1).otherwise(1)
        return state(x, n, F.greatest(acc["most"], n))

    longest = F.aggregate("covered", state(F.lit(-9), F.lit(0), F.lit(0)), step, lambda acc: acc["most"])
    runs = scratch.save(runs.where((F.size("covered") >= share * F.col("of")) | (longest >= RUN)).drop("covered"), "runs")
    templates = runs.where("NOT exact")

    # the values behind the placeholders, only of documents and items that met
    some = scratch.save(templates.select("doc_id", "text_key").distinct().withColumnsRenamed({"doc_id": "d", "text_key": "t"}), "some")
    texts = keyed.join(_small(some, some.count()), keyed["doc_id"].eqNullSafe(some["d"]) & (keyed["text_key"] == some["t"]), "left_semi").dropDuplicates(["doc_id", "text_key"])
    texts = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), raw_words(F.col("text")).alias("words")).withColumn("places", run_starts(template_words(F.col("words"))))
    met = templates.hint("merge").join(items.hint("merge"), "item").join(texts.hint("merge"), templates["doc_id"].eqNullSafe(F.col("d")) & (templates["text_key"] == F.col("t")))
    value = lambda words, places, p: F.lower(F.array_join(F.slice(words, places[p] + 1, places[p + 1] - places[p]), " "))
    slots = lambda part: F.filter(F.array_distinct(spread(part["starts"])), lambda p: F.startswith(F.col("item_template")[p], F.lit("\u0001")))
    of_part = lambda part: F.transform(slots(part), lambda p: F.struct(value(F.col("item_words"), F.col("item_places"), p).alias("of_item"), value(F.col("words"), F.col("places"), p + part["distance"]).alias("of_document")))
    values = F.array_distinct(F.flatten(F.transform("parts", of_part)))
    consistent = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda v: v["of_item"])))
    by_values = met.withColumn("values", values).select("d", "t", "item", "starts", F.lit(False).alias("whole"), F.lit(False).alias("exact"), consistent.alias("fits"))
    whole = F.exists("parts", lambda x: F.size(x["starts"]) == F.col("of") - length + 1)
    by_text = runs.where("exact").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "item", "starts", whole.alias("whole"), "exact", F.lit(True).alias("fits"))
    # a template whose values break the rule speaks against words alike, unless those are the whole item
    seen = by_values.unionByName(by_text).groupBy("d", "t", "item").agg(
        F.max(F.when(F.col("fits"), F.size("starts"))).alias("n_windows"),
        F.bool_or(F.col("whole") | (~F.col("exact") & F.col("fits"))).alias("sure"),
        F.bool_or(~F.col("fits")).alias("against"),
    )
    found = seen.where("sure OR NOT against")
    named = found.join(items.select("item", "item_id").hint("merge"), "item").groupBy("d", "t", "item_id").agg(F.max("n_windows").alias("n_windows"))
    verdict = named.groupBy("d", "t").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.sum("n_windows").alias("n_windows"))
    rows = keyed.select("doc_id", "text_key")
    out = rows.join(verdict.hint("merge"), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["text_key"] == F.col("t")), "left")
    return out.select(
        "doc_id",
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.col("items").isNotNull().alias("contaminated"),
        "text_key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` in which no item of `benchmark` is found; all columns stay."""
    bad = contaminated(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    key = F.xxhash64(docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__d"]) & (key == bad["__t"]), "left_anti")
