"""Personal data: fixed patterns, and identifiers found by the contexts of those. DataFrame functions only.

Spans of the fixed patterns are seeds, and so, for the kind SECRET, is what has the shape of a key or digest. The words
around seeds are lexical patterns; a pattern's score for a kind is the mean score of what it surrounds, an unknown
identifier's score the mean over its patterns. Both are computed in turn for ROUNDS rounds over the graph of patterns and
instances, and identifiers of high score are added as spans. A shape alone makes no span: what looks like a key is added
only where its contexts are those of other keys, as any other identifier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .columns import cut_out, in_blocks, let, running_max, running_sums
from ..sources.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: The shape of a seed of that kind: long, of letters and digits and what encodings add to them.
SECRET_SHAPE = "^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=-]{32,512}$"
#: The fixed patterns, written so that matching takes linear time: quantifiers never give back, and a match starts only
#: where its first run starts, or where the match before it ended.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+(?<=[0-9])",
}
#: What a text must contain for its pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
#: A run of other characters than white space with a digit or an at sign.
TOKEN = "(?<!\\S)[^\\s0-9@]*+[0-9@]\\S*+"
TOKEN_CHARS, CONTEXT_CHARS = 6, 64
ROUNDS, SUPPORT, LEAST = 3, 3, 0.6
SPAN = "array<struct<kind:string,start:int,end:int>>"
VALUED = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Letters of the blocks that contexts are cut from, as a place in a long text is counted from its beginning.
BLOCK = 512


def _found(text: Column, pattern: str) -> Column:
    """Matches as array of (start, end, value), in code points: the lengths of gaps and matches, summed."""

    def of(x: Column) -> Column:
        # the last gap, after all matches, is part of no sum
        before = running_sums(F.transform(x["hits"], lambda h, i: F.length(h) + F.length(x["gaps"][i])))

        def place(begins: Column) -> Column:
            start = lambda i: (begins[i] + F.length(x["gaps"][i])).cast("int")
            return F.transform(x["hits"], lambda h, i: F.struct(start(i).alias("start"), (start(i) + F.length(h)).alias("end"), h.alias("value")))

        return let(before, place)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), of)


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(999)) <= 255)))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end, value) of the fixed patterns, by kind in the order of KINDS, then start."""
    each = []
    for kind in KINDS:
        spans = F.transform(F.filter(_found(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"])), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        each.append(F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(VALUED)))
    return F.concat(*each)


def _context(blocks: Column, start: Column, end: Column) -> tuple[Column, Column]:
    def piece(at: Column, n: Column) -> Column:
        k = F.floor(at / BLOCK).cast("int")
        return F.substr(F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit(""))), at - k * BLOCK + 1, n)

    left, right = piece(F.greatest(start - CONTEXT_CHARS, F.lit(0)), F.least(start, F.lit(CONTEXT_CHARS))), piece(end, F.lit(CONTEXT_CHARS))
    part = lambda c: F.filter(F.split(F.lower(c), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return part(left), part(right)


def _units(text: Column, base: Column) -> Column:
    """Seeds (kind) and other tokens that may be identifiers (kind null, or SECRET for their shape): kind, start, end, value, patterns."""
    edge = "[\"'(<\\[{|]*"
    trimmed = F.transform(
        _found(text, TOKEN),
        lambda m: let(
            F.struct(m["start"].alias("start"), F.regexp_extract(m["value"], "^" + edge, 0).alias("lead"), F.regexp_replace(F.regexp_replace(m["value"], "^" + edge, ""), "[\"')>\\]}|.,;:!?#$%&*]++$", "").alias("value")),
            lambda t: F.struct((t["start"] + F.length(t["lead"])).alias("start"), (t["start"] + F.length(t["lead"]) + F.length(t["value"])).alias("end"), t["value"].alias("value")),
        ),
    )
    def meets(spans: Column, t: Column) -> Column:
        """Whether one of the spans of a kind, which are in order and apart, overlaps t: the last that starts before its end."""
        step = lambda p, s: F.when((p + s <= F.size(spans)) & (F.get(spans, p + s - 1)["start"] < t["end"]), p + s).otherwise(p)
        halves = F.array(*(F.lit(1 << k) for k in reversed(range(26))))
        return let(F.aggregate(halves, F.lit(0), step), lambda p: (p > 0) & (F.get(spans, F.greatest(p - 1, F.lit(0)))["end"] > t["start"]))

    def apart_of(by_kind: Column) -> Column:
        clear = lambda t: ~reduce(lambda a, b: a | b, [F.when(F.size(by_kind[k]) > 0, meets(by_kind[k], t)).otherwise(False) for k in KINDS])
        return F.filter(trimmed, lambda t: (F.length(t["value"]) >= TOKEN_CHARS) & clear(t))

    of_kind = lambda kind: F.filter(base, lambda b: b["kind"] == kind).alias(kind)
    apart = let(F.struct(*map(of_kind, KINDS)), apart_of)
    others = F.transform(apart, lambda t: F.struct(F.when(t["value"].rlike(SECRET_SHAPE), SECRET).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value")))

    def unit(u: Column, blocks: Column) -> Column:
        left, right = _context(blocks, u["start"], u["end"])
        last = lambda n: F.array_join(F.slice(left, -n, n), " ")
        two = F.when(F.size(left) >= 2, F.concat(F.lit("2 "), last(2)))
        one = F.when(F.size(left) >= 1, F.concat(F.lit("1 "), last(1)))
        after = F.when(F.size(right) >= 1, F.concat(F.lit("> "), right[0]))
        return F.struct(u["kind"].alias("kind"), u["start"].alias("start"), u["end"].alias("end"), u["value"].alias("value"), F.filter(F.array(two, one, after), lambda p: p.isNotNull()).alias("patterns"))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    found = let(F.concat(base, others), lambda x: F.struct(x.alias("units"), F.when(F.size(x) > 0, blocks).alias("blocks")))
    return let(found, lambda x: F.transform(x["units"], lambda u: unit(u, x["blocks"])))


def _discovered(units: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, kind) of identifiers that no fixed pattern has and whose contexts are those of seeds."""
    edges = units.select("kind", "value", F.explode("patterns").alias("pattern")).groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))
    edges = scratch.save(edges, "edges")
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.countDistinct("value").alias("support")).where(F.col("support") >= SUPPORT).select("pattern", F.col("kind").alias("as"))
    # for each kind that a pattern supports, all that it surrounds
    graph = scratch.save(edges.join(seeds, "pattern"), "graph")
    seed = F.when(F.col("kind") == F.col("as"), 1.0).when(F.col("kind").isNotNull(), 0.0)
    open_ones = graph.where(F.col("kind").isNull() | ((F.col("kind") == SECRET) & (F.col("as") == SECRET)))
    unknown = None
    for k in range(ROUNDS):
        held = graph if unknown is None else graph.join(unknown, ["value", "as"], "left")
        score = F.coalesce(seed, F.col("score") if unknown is not None else F.lit(0.0))
        patterns = held.groupBy("pattern", "as").agg((F.sum(F.col("n") * score) / F.sum("n")).alias("trust"))
        unknown = open_ones.join(patterns, ["pattern", "as"]).groupBy("value", "as").agg((F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("score"))
        unknown = scratch.save(unknown, f"scores-{k}")
    best = unknown.where(F.col("score") >= LEAST).groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("less"), "as")).alias("b"))
    return best.select("value", F.col("b.as").alias("kind"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, text_key, base and spans (arrays of kind, start, end).

    base holds the spans of the fixed patterns, spans those and the discovered ones, by kind in the order of KINDS and
    SECRET, then start; offsets count code points, ends are exclusive, spans of different kinds may overlap. Of kinds with
    equal scores an identifier has the first by name. Null and empty texts, and an empty table, have none. Rows repeated
    with one doc_id and text have one result each, rows without doc_id theirs by their text. Seeds and contexts are
    gathered over all rows. Other columns are ignored. text_key is a hash of the text, to join by.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "personal-data")
    text = F.col("text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    based = keyed.withColumn("valued", F.when(text.rlike("[0-9@]"), base_spans(text)).otherwise(F.array().cast(VALUED)))
    units = F.when(text.rlike("[0-9@]"), let(F.struct(text.alias("text"), F.col("valued").alias("base")), lambda x: _units(x["text"], x["base"])))
    base = F.transform("valued", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = scratch.save(based.select("doc_id", "text_key", base.alias("base"), units.alias("units")), "rows")
    flat = rows.select("doc_id", "text_key", F.explode("units").alias("u")).select("doc_id", "text_key", "u.*")
    added = flat.where(F.col("kind").isNull() | (F.col("kind") == SECRET)).drop("kind", "patterns").join(_discovered(flat, scratch), "value")
    by_doc = added.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more")).withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    out = rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["d"]) & (rows["text_key"] == by_doc["t"]), "left")
    together = F.concat("base", F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN)))
    of_kind = lambda kind: F.array_sort(F.filter(together, lambda s: s["kind"] == kind))
    ordered = F.concat(*map(of_kind, (*KINDS, SECRET)))
    return out.select("doc_id", "text_key", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(ordered).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind.

    A column n_chars is set to the new length; other columns stay, whatever their names.
    """
    found = find_personal_data(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), F.col("spans").alias("__spans")).dropDuplicates(["__d", "__t"])

    def cut(x: Column) -> Column:
        """What is between the spans and the kinds in their place, each read once and joined at the end."""
        between = cut_out(x["blocks"])
        ends = running_max(F.transform(x["spans"], lambda s: s["end"]))

        def parts(before: Column) -> Column:
            known = F.transform(x["spans"], lambda s, i: F.struct(F.get(before, i).alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))
            apart = F.filter(known, lambda s: s["start"] >= s["from"])
            pieces = F.transform(apart, lambda s: F.concat(between(s["from"], s["start"]), F.lit("<"), s["kind"], F.lit(">")))
            end = F.array_max(F.transform(x["spans"], lambda s: s["end"])).cast("long")
            return F.concat(F.array_join(pieces, ""), between(end, x["size"]))

        return let(ends, parts)

    def redacted(text: Column, spans: Column) -> Column:
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return let(F.struct(in_blocks(text).alias("blocks"), placed.alias("spans"), F.length(text).cast("long").alias("size")), cut)

    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["__d"]) & (F.xxhash64(docs["text"]) == found["__t"]), "left")
    text = F.when(found["__spans"].isNull(), docs["text"]).otherwise(redacted(docs["text"], found["__spans"]))
    changed = {"text": text} | ({"n_chars": F.when(found["__spans"].isNull(), docs["n_chars"]).otherwise(F.length(text))} if "n_chars" in docs.columns else {})
    return joined.select(*(changed[c].cast(t).alias(c) if c in changed else docs[c] for c, t in docs.dtypes))
