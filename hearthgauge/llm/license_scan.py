"""Licence notices by Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import Scratch
from .columns import let

DICE_LEAST = 0.75

#: Notices of public licences, as their owners publish them. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Words of any English text, taken as anchors only where nothing else is left.
COMMON = frozenset("a all and any are at be by can for general in international is it may no not of on one or other provided public shall source subject terms that the this to under use was with without work you".split())


def normal_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def template_bigrams(templates=TEMPLATES) -> list[tuple[int, str, int, str, int]]:
    """(template, licence, size, bigram, times) for each distinct bigram; size counts all bigrams."""
    out = []
    for k, (name, text) in enumerate(templates):
        w = normal_words(text)
        grams = Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
        out += [(k, name, len(w) - 1, g, n) for g, n in sorted(grams.items())]
    return out


def template_table(spark: SparkSession, grams: list[tuple[int, str, int, str, int]]) -> DataFrame:
    """The rows of template_bigrams as a table, from one literal."""
    fields = ("template", "license", "t_size", "gram", "t_times")
    rows = json.dumps([dict(zip(fields, g, strict=True)) for g in grams])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<template int, license string, t_size int, gram string, t_times int>>")))


def anchors(grams: list[tuple[int, str, int, str, int]], least: float) -> list[str]:
    """Words of which every text that can reach `least` with a template has one.

    A unit that reaches it shares least * (a + b) / 2 of its a bigrams with the template's b, and a is b / wide at least;
    so it lacks a part of the template's bigrams that is smaller than `spare`. Words are taken until those of each
    template are in more of its bigrams than that; first the words in most bigrams of templates still open, long ones
    before short ones, as those are rarer in texts.
    """
    spare = 1 - least * (1 + least / (2 - least)) / 2
    open_ones: dict[int, dict[str, int]] = {}
    need: dict[int, float] = {}
    for k, _, size, gram, n in grams:
        open_ones.setdefault(k, {})[gram] = n
        need[k] = spare * size
    out = []
    while open_ones:
        weight = Counter()
        for held in open_ones.values():
            for gram, n in held.items():
                for w in {*gram.split(" ")}:
                    weight[w] += n
        best = max(weight, key=lambda w: (weight[w] * len(w) ** 3 / (1000 if w in COMMON else 1), w))
        out.append(best)
        for k, held in [*open_ones.items()]:
            for gram in [g for g in held if best in g.split(" ")]:
                need[k] -= held.pop(gram)
            if need[k] < 0 or not held:
                del open_ones[k]
    return out


def notices_within(keyed: DataFrame, table: DataFrame, grams: list[tuple[int, str, int, str, int]], least: float) -> DataFrame:
    """(doc_id, text_key, license, dice) of notices inside longer paragraphs, the best of each licence.

    Windows of a template's size start at its bigrams. Of windows that overlap, the one with the largest coefficient
    stays, the first by name among equals. A window holds enough bigrams of its template only if that many of them,
    counted with all repeats, lie close enough, so few windows are counted out. A piece is cut into stretches as long as
    the longest template; a window is counted in the stretch it starts in, beside the next one's bigrams, and compared
    with the windows of the stretches it may overlap. So the work grows with the words of a piece, and its stretches are
    rows of their own.
    """
    span = max(g[2] for g in grams)
    pieces = keyed.where("text IS NOT NULL").select("doc_id", "text_key", F.posexplode(F.split("text", "\n[\\x20\\x09-\\x0D]*\n")).alias("piece_at", "piece"))
    words = pieces.select("doc_id", "text_key", "piece_at", F.filter(F.split(F.lower("piece"), "[^0-9a-z]+"), lambda w: w != "").alias("words")).where(F.size("words") >= 2)
    pairs = let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1])))
    key = ["doc_id", "text_key", "piece_at"]
    stretch = lambda at: F.floor(at / span).cast("int")
    hits = words.select(*key, F.posexplode(pairs).alias("at", "gram")).join(F.broadcast(table), "gram")
    dealt = hits.withColumn("stretch", F.explode(F.array(stretch(F.col("at")) - 1, stretch(F.col("at")))))
    own = [*key, "stretch", "template", "license", "t_size"]
    # a set, as rows of one doc_id and text may be repeated
    rows = dealt.groupBy(*own).agg(F.array_sort(F.collect_set(F.struct("at", "gram", "t_times"))).alias("hits"))
    need = F.ceil(F.col("t_size") * least).cast("int")
    close = lambda i: (F.col("hits")[i + need - 1]["at"] < F.col("hits")[i]["at"] + F.col("t_size")) & (stretch(F.col("hits")[i]["at"]) == F.col("stretch"))
    starts = rows.where(F.size("hits") >= need).select("*", F.explode(F.filter(F.sequence(F.lit(0), F.size("hits") - need), close)).alias("i")).withColumn("start", F.col("hits")[F.col("i")]["at"])
    inside = F.filter(F.slice("hits", F.col("i") + 1, F.col("t_size")), lambda h: h["at"] < F.col("start") + F.col("t_size"))
    counted = starts.select(*own, "start", F.explode(inside).alias("h")).groupBy(*own, "start", "h.gram", "h.t_times").agg(F.count("*").alias("times"))
    scored = counted.groupBy(*own, "start").agg((F.sum(F.least("times", "t_times")) / F.col("t_size")).alias("dice")).where(F.col("dice") >= least)
    window = F.struct((-F.col("dice")).alias("less"), "license", "start", (F.col("start") + F.col("t_size")).alias("end"))
    reach = F.sequence(stretch(F.col("start") - span + 1), stretch(F.col("start") + F.col("t_size") - 1))
    windows = scored.select(*key, F.explode(reach).alias("stretch"), window.alias("w")).groupBy(*key, "stretch").agg(F.collect_list("w").alias("windows"))
    better = lambda x, w: (x["start"] < w["end"]) & (w["start"] < x["end"]) & ((x["less"] < w["less"]) | ((x["less"] == w["less"]) & (x["license"] < w["license"])))
    best = F.filter("windows", lambda w: (stretch(w["start"]) == F.col("stretch")) & ~F.exists("windows", lambda x: better(x, w)))
    return windows.select("doc_id", "text_key", F.explode(best).alias("w")).groupBy("doc_id", "text_key", F.col("w.license").alias("license")).agg(F.max(-F.col("w.less")).alias("dice"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = DICE_LEAST) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, licenses (sorted distinct names), n_notices, best_dice.

    Units are the lines of a text, its paragraphs (parted at blank lines) that have several lines, and a whole text of
    several paragraphs. Dice's coefficient of a unit A and a template B is 2 * |A and B| / (|A| + |B|) over bigrams with
    their repeats. They are compared only if their sizes allow the coefficient `least`: |A| and |B| differ by a factor
    of (2 - least) / least at most, so a unit's word count alone drops most units. n_notices counts the units that
    reach it, and each licence that only a part of a longer paragraph names (see notices_within). Texts without any of
    the anchors' words are not looked at. Null and empty texts have none. Rows repeated with one doc_id and text are
    counted once and have one result each. Letters other than ASCII part words. `templates` is a constant of the code,
    so broadcasting it is bounded. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    grams = template_bigrams(templates)
    wide = (2 - least) / least
    table = template_table(spark, grams)
    every = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    words = anchors(grams, least)
    # long words are looked for as letters anywhere, which is quick; the few short ones between other signs
    long, short = [w for w in words if len(w) > 3], [w for w in words if len(w) <= 3]
    between = f"(?<![0-9a-z])(?:{'|'.join(short)})(?![0-9a-z])"
    tests = lambda small: [F.contains(small, F.lit(w)) for w in long] + ([small.rlike(between)] if short else [])
    keyed = every.where(let(F.lower("text"), lambda small: reduce(lambda a, b: a | b, tests(small), F.lit(False))))
    keyed = Scratch(spark, "license-scan").save(keyed, "texts")
    by_paragraph = F.split("text", "\n[\\x20\\x09-\\x0D]*\n")
    longer = F.concat(F.filter(by_paragraph, lambda p: F.contains(p, F.lit("\n"))), F.when(F.size(by_paragraph) > 1, F.array("text")).otherwise(F.array().cast("array<string>")))
    # a row of its own for each input row, so that the bigrams of repeated rows are not added up
    rowed = keyed.where("text IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    units = rowed.select("doc_id", "text_key", "row", F.posexplode(F.concat(F.split("text", "\n"), longer)).alias("unit", "piece"))
    words = units.select("doc_id", "text_key", "row", "unit", F.filter(F.split(F.lower("piece"), "[^0-9a-z]+"), lambda w: w != "").alias("words"))
    possible = words.withColumn("size", F.size("words") - 1).where(F.col("size").between(min(g[2] for g in grams) / wide, max(g[2] for g in grams) * wide))
    pairs = let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1])))
    key = ["doc_id", "text_key", "row", "unit", "template", "license", "size", "t_size"]
    shared = (
        possible.select("doc_id", "text_key", "row", "unit", "size", F.explode(pairs).alias("gram"))
        .join(F.broadcast(table), "gram")
        .where((F.col("size") <= F.col("t_size") * wide) & (F.col("t_size") <= F.col("size") * wide))
        .groupBy(*key, "gram", "t_times")
        .agg(F.count("*").alias("times"))
        .groupBy(*key)
        .agg(F.sum(F.least("times", "t_times")).alias("both"))
    )
    scored = shared.withColumn("dice", 2.0 * F.col("both") / (F.col("size") + F.col("t_size"))).where(F.col("dice") >= least)
    # a unit has the licence of its best template, the first by name among equals
    found = scored.groupBy("doc_id", "text_key", "unit").agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best")).select("doc_id", "text_key", "unit", "best.license", (-F.col("best.less")).alias("dice"))
    within = notices_within(keyed, table, grams, least)
    met = found.select("doc_id", "text_key", "license").distinct().withColumnsRenamed({"doc_id": "d", "text_key": "t", "license": "l"})
    more = within.join(met, within["doc_id"].eqNullSafe(met["d"]) & (within["text_key"] == met["t"]) & (within["license"] == met["l"]), "left_anti")
    found = found.unionByName(more.withColumn("unit", F.lit(None).cast("int")))
    verdict = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.count("license").alias("n_notices"), F.max("dice").alias("best_dice"))
    rows, v = every.select("doc_id", "text_key"), verdict.withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    out = rows.join(v, rows["doc_id"].eqNullSafe(v["d"]) & (rows["text_key"] == v["t"]), "left")
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))
