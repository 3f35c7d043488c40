"""Quality rules as a cascade ordered by measured rejection per cost. DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .columns import hash_windows, let

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOL_CLASS = "[#*$%&|<>]"
REPEAT_WINDOW = 8
#: Rows that the order of the rules is estimated on, and the partitions they are dealt to. They change the cost of a run, never a verdict.
SAMPLE_ROWS, SAMPLE_PARTS = 2000, 8


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOL_CLASS)), F.lit(0)).cast("long")


def repeat_words(windows: Column, width: int) -> Column:
    """Words inside windows that occur twice or more, given the windows' hashes by start."""

    def starts(placed: Column) -> Column:
        same = lambda k, h: F.try_element_at(placed, k)["h"] == h
        held = F.transform(placed, lambda x, k: F.when(F.coalesce((k > 0) & same(F.greatest(k, F.lit(1)), x["h"]), F.lit(False)) | F.coalesce(same(k + 2, x["h"]), F.lit(False)), x["i"]))
        return F.array_sort(F.filter(held, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        return F.aggregate(at, zero, lambda a, i: F.struct((i + width).alias("end"), (a["sum"] + i + width - F.greatest(a["end"], i)).alias("sum")))["sum"]

    def of(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # most texts repeat nothing, which the number of distinct hashes shows without a sort
        return F.when(F.size(F.array_distinct(w)) < F.size(w), covered(let(placed, starts))).otherwise(0).cast("long")

    return let(windows, of)


@dataclass(frozen=True)
class Rule:
    """`rejects` gives a condition over the metrics named in `needs`."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]

    def on_columns(self) -> Column:
        """The condition where the metrics are columns."""
        return self.rejects({m: F.col(m) for m in self.needs})


RULES = (
    Rule("too_few_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("few_letters", ("word_chars", "n_letters"), lambda m: 100 * m["n_letters"] < 40 * m["word_chars"]),
    Rule("ellipsis_lines", ("n_lines", "n_ellipsis_lines"), lambda m: 100 * m["n_ellipsis_lines"] > 30 * m["n_lines"]),
    Rule("bullet_lines", ("n_lines", "n_bullet_lines"), lambda m: 100 * m["n_bullet_lines"] > 90 * m["n_lines"]),
)
BASE = ("too_few_words", "repeated_words")
#: Metrics that quality_rules returns for every row. The others are computed where the cascade comes to their rules.
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
HELPERS = ("__words", "__lines", "__windows")
VERDICTS = ("base_failed", "rejected_by", "kept")

#: Each metric by the columns text, __words, __lines and __windows.
METRIC = {
    "n_words": lambda: F.size("__words").cast("long"),
    "word_chars": lambda: F.length(F.array_join("__words", "")).cast("long"),
    "n_symbols": lambda: symbols(F.col("text")),
    "n_lines": lambda: F.size("__lines").cast("long"),
    "n_dup_lines": lambda: (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    "n_repeat_words": lambda: repeat_words(F.col("__windows"), REPEAT_WINDOW),
    "n_letters": lambda: F.coalesce(F.length(F.regexp_replace("text", "[^\\p{L}]+", "")), F.lit(0)).cast("long"),
    "n_ellipsis_lines": lambda: F.size(F.filter("__lines", lambda x: x.rlike("(?:\\.\\.\\.|\u2026)[\\x20\\x09-\\x0D]*$"))).cast("long"),
    "n_bullet_lines": lambda: F.size(F.filter("__lines", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*\u2022]"))).cast("long"),
}
OF_WORDS, OF_LINES = {"n_words", "word_chars", "n_repeat_words"}, {"n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines"}


def with_metrics(docs: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """`docs` with the metrics named, and helper columns __words, __lines, __windows where those need them."""
    out = docs
    if OF_WORDS & {*names}:
        out = out.withColumn("__words", words(F.col("text")))
    if "n_repeat_words" in names:
        out = out.withColumn("__windows", hash_windows(F.transform("__words", lambda w: F.xxhash64(w)), REPEAT_WINDOW))
    if OF_LINES & {*names}:
        out = out.withColumn("__lines", lines(F.col("text")))
    return out.withColumns({k: METRIC[k]() for k in names})


def _set_aside(docs: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns that are named like one of `names` under other names, and those by their own."""
    taken = {n.lower() for n in names}
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(aside), aside


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, highest first, estimated on a seeded sample of some `sample_rows` rows of all splits.

    Rejections of all rules are counted in one pass. A rule's cost is the time it takes alone, the better of two runs
    (the first compiles it), less that of a run without a rule. The sample costs one reading of the text column.
    """
    n = docs.count()
    if not n:
        return list(rules)
    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / n), seed=10).repartition(SAMPLE_PARTS).cache()
    try:
        size = sample.count()
        every = with_metrics(sample, tuple(dict.fromkeys(m for r in rules for m in r.needs)))
        hits = every.agg(*(F.count(F.when(r.on_columns(), 1)).alias(r.name) for r in rules)).first()

        def seconds(rule: Rule | None) -> float:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                (sample.where("length(text) < 0") if rule is None else with_metrics(sample, rule.needs).where(rule.on_columns())).count()
                took.append(time.perf_counter() - began)
            return min(took)

        nothing = seconds(None)
        rate = {r.name: (hits[r.name] + 0.5) / (size + 1) / max(seconds(r) - nothing, 1e-3) for r in rules}
        return sorted(rules, key=lambda r: -rate[r.name])
    finally:
        sample.unpersist()


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` (with a column text) with the metrics of METRICS, base_failed, rejected_by and kept.

    rejected_by is the first rule that rejects, in the estimated order; rules after it are not evaluated, nor are their
    metrics unless METRICS has them. kept, true where no rule rejects, does not depend on the order. Null texts count
    as empty, which has too few words. Rows are judged alone, so repeated rows have equal results; other columns stay,
    those named like a result under `own_` and their name. An empty table gives an empty one.
    """
    ordered = order_rules(docs, rules)
    docs, aside = _set_aside(docs, (*METRIC, *HELPERS, *VERDICTS))
    out = with_metrics(docs)
    # a metric that is not a column yet is written out where its rule stands, so that only rows that come there pay for it
    by = F.lit(None).cast("string")
    for r in reversed(ordered):
        by = F.when(r.rejects({m: F.col(m) if m in METRICS else METRIC[m]() for m in r.needs}), r.name).otherwise(by)
    base = reduce(lambda a, b: a | b, [r.on_columns() for r in rules if r.name in BASE], F.lit(False))
    out = out.withColumn("base_failed", base).withColumn("rejected_by", by).withColumn("kept", F.col("rejected_by").isNull())
    return out.drop(*HELPERS).withColumnsRenamed({new: f"own_{old}" for old, new in aside.items()})


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of `docs` that no rule rejects. A rule's metrics are computed only for rows that the rules before it kept.

    All columns stay as they are, whatever their names. Null and empty texts are rejected, equal rows alike.
    """
    columns = docs.columns
    out, aside = _set_aside(docs, (*METRIC, *HELPERS))
    own = out.columns
    for r in order_rules(docs, rules):
        out = with_metrics(out, r.needs).where(~r.on_columns()).select(*own)
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in columns))
