"""Spelling variants of frequent words by a symmetric-delete join.

Every word emits the key of itself and of each string that lacks one of its letters. Two words differ by one edit only
if they share a key: the longer word without a letter is the shorter word, or both lack a letter at the same place. So
one equi-join on the key finds all pairs, and what a pair needs beside the key (places, which of the two is whole) is
part of the join. Keys are 62-bit hashes, made for all places of a word in linear time; every pair is confirmed on the
words themselves, so hashes never decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import Scratch

#: A word has at least this many code points and occurs at least so often; its form at least so many times as often as it.
LEAST_LETTERS, LEAST_TIMES, FORM_TIMES = 7, 2, 10
#: Of occurrences whose hash this divides, a letter is left out.
DAMAGED = 31
#: Words that a task counts before it passes them on.
HELD = 150_000
#: Rows of keys in a batch.
KEYS_AT_A_TIME = 20_000
#: Two moduli and bases of the polynomial hashes.
LANES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013))

_SMALL = {c: c + 32 for c in range(65, 91)}


def _small(run: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return run.lower() if run.isascii() else run.translate(_SMALL)


def document_words(doc_id: int | None, text: str | None, runs, least: int = LEAST_LETTERS) -> Counter:
    """Words of a text and how often: its runs in lower case, damaged where the hash of document and run says so.

    runs: findall of the maximal runs of `least` letters or more; shorter ones give no word.
    """
    out: Counter = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs(text or "")).items():
        word = _small(run)
        h = zlib.crc32(word.encode(), prefix)
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        out[word] += n
    return out


def count_words(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the words that occur at least `times` times in all texts. Tasks add up what they read before the shuffle."""
    pattern = f"[A-Za-zÀ-ÿ]{{{least},}}"

    def run(batches):
        runs, held = re.compile(pattern).findall, Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.update(document_words(doc_id, text, runs, least))
                if len(held) >= HELD:
                    yield give()
                    held.clear()
        yield give()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """Keys of the words; and of each word's distinct deletions in turn: the word's index, the key of the word without
    the letter, and the first and last place whose deletion gives this (a run of one letter)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    at = np.arange(len(letters)) - np.repeat(starts, lengths)
    own, without = np.zeros(len(words), np.uint64), np.zeros(len(letters), np.uint64)
    for p, base in LANES:
        powers = np.ones(int(lengths.max(initial=0)) + 1, np.uint64)
        for i in range(1, len(powers)):
            powers[i] = int(powers[i - 1]) * base % p
        m = np.uint64(p)
        terms = letters * powers[at] % m
        sums = np.concatenate(([np.uint64(0)], np.cumsum(terms)))  # under 2^31 each: no overflow below 2^33 letters
        total = sums[ends] - sums[starts]
        before = sums[:-1] - np.repeat(sums[starts], lengths)
        after = np.repeat(total, lengths) - before - terms
        back = np.uint64(pow(base, -1, p))
        own = own << np.uint64(31) | total % m
        without = without << np.uint64(31) | (before % m + after % m * back % m) % m
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (at[1:] == 0)
    firsts = np.flatnonzero(new)
    runs = np.diff(np.append(firsts, len(letters)))
    return own.astype(np.int64), np.repeat(np.arange(len(words)), lengths)[firsts], without[firsts].astype(np.int64), at[firsts], at[firsts] + runs - 1


def _emit(words: DataFrame) -> DataFrame:
    """(key, first, last, id) of each word: itself with -1 as places, and each of its distinct deletions."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            k = 0
            while k < len(texts):
                size, end = len(texts[k]), k + 1
                while end < len(texts) and size + len(texts[end]) < KEYS_AT_A_TIME:
                    size += len(texts[end])
                    end += 1
                own, of, without, first, last = deletion_keys(texts[k:end])
                itself = np.full(end - k, -1, np.int64)
                arrays = [np.concatenate([own, without]), *(np.concatenate([itself, x]).astype(np.int32) for x in (first, last)), np.concatenate([ids[k:end], ids[k:end][of]])]
                out = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["key", "first", "last", "id"])
                yield from (out.slice(s, KEYS_AT_A_TIME) for s in range(0, out.num_rows, KEYS_AT_A_TIME))
                k = end

    return words.select("id", "word").mapInArrow(run, "key long, first int, last int, id long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two of `words` (id long, word, n) that differ by exactly one edit, both ways round.

    Words under one key are compared inside the join, which gives the pairs that are near and nothing else. A key has a
    word once, and a word for each letter at each of its places at most, whatever the corpus.
    """
    keys = _emit(words)
    a, b = keys.alias("a"), keys.alias("b")
    c = F.col
    same_place = (c("a.first") >= 0) & (c("a.first") <= c("b.last")) & (c("b.first") <= c("a.last"))
    longer = (c("a.first") < 0) != (c("b.first") < 0)
    pairs = a.join(b, (c("a.key") == c("b.key")) & (c("a.id") != c("b.id")) & (same_place | longer)).select(c("a.id").alias("id"), c("b.id").alias("near_id"))
    near = words.select(c("id").alias("near_id"), c("word").alias("near"), c("n").alias("near_n"))
    both = pairs.join(near, "near_id").join(words, "id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form. Each round doubles the steps taken; a form occurs ten times as often
    as its word, so a chain has as many steps as the largest count has digits and there is no circle."""
    now, k = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("on")), 0
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.save(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), f"roots-{k}")
        if k:
            scratch.drop(f"roots-{k - 1}")
        if not now.where("on").limit(1).count():
            return now.select("word", "root")
        k += 1


def spelling_variants(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_TIMES, form_times: int = FORM_TIMES) -> DataFrame:
    """Per word of `docs` (doc_id, text): word, n, n_near, form, form_n, root.

    A word's form is the most frequent of its near words (ties: the smallest), if it occurs at least `form_times` as
    often; its root is the last form on the way from form to form, or the word itself. Null and empty texts have no
    words, a null doc_id is hashed as an empty string, repeated rows count again, other columns are ignored. Words of
    any length are taken whole: a word of L letters makes L + 1 rows of 24 bytes at most.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    counted = count_words(docs, least, times)
    words = scratch.save(counted.select(F.xxhash64("word").alias("id"), "word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    formed = near.select("word", "n_near", F.when(form_n >= form_times * F.col("n"), F.struct(F.col("best.near").alias("form"), form_n.alias("form_n"))).alias("f"))
    formed = scratch.save(formed.select("word", "n_near", "f.form", "f.form_n"), "formed")
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"), scratch)
    whole = words.select("word", "n").join(formed, "word", "left").join(roots, "word", "left")
    return whole.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
