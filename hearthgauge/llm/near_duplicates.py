"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A signature has `symbols` MinHash values of 32 bits. Its first `chunks * chunk` symbols are cut into chunks. Two
signatures with at most `chunks * (errors + 1) - 1` different symbols there have, by the pigeonhole principle, a chunk
with at most `errors` differences. Each chunk is therefore indexed once for each choice of `errors` symbols that may
differ (left out of the key), so all such pairs meet under a key. With 4 chunks of 5 symbols and 2 errors that holds up
to 11 of 20 differences, and a pair of similarity 0.75 is missed with a probability of about 1 in 10,000.

Links are confirmed on full shingle sets. Under a key of n documents not all n*n/2 pairs are made: every document is
first compared with the key's smallest one, the links found are closed to components, and only documents of one key
that are still in different components are compared further, by their whole signatures in blocks of bounded size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from ..sources.scratch import Scratch
from .texts import map_texts
from .wordhash import WordCache, mix, run_hashes, split_words, word_hashes

SYMBOLS, CHUNKS, CHUNK, ERRORS = 512, 4, 5, 2
LEAST = 0.75
#: Pairs whose signatures agree on a smaller part are not compared: 3.7 standard deviations below LEAST.
SIGNATURE_LEAST = LEAST - 3.7 * (LEAST * (1 - LEAST) / SYMBOLS) ** 0.5
BLOCK = 2048


def shingle_set(text: str | None, width: int, cache: WordCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words than `width`, one of the whole sequence."""
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words, cache)
    if len(hashes) < width:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes))], np.uint64)
    return np.unique(run_hashes(hashes, width))


def permutations(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    return rng.integers(0, 2**32, (symbols, 1), dtype=np.uint32), rng.integers(0, 2**31, (symbols, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(shingles: np.ndarray, perms: tuple[np.ndarray, np.ndarray], step: int = 2048) -> np.ndarray:
    low = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    return np.min([((low[None, k : k + step] ^ perms[0]) * perms[1]).min(axis=1) for k in range(0, len(low), step)], axis=0)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key, head, tail): set_key is 128 bits of the set, head the symbols used for keys, tail 8 bits of every symbol."""

    def start():
        cache, perms = WordCache(), permutations(SYMBOLS)

        def of(text):
            s = shingle_set(text, width, cache)
            if not len(s):
                return 0, None, None, None
            m = minhash(s, perms)
            return len(s), xxhash.xxh3_128_digest(s.tobytes()), m[: CHUNKS * CHUNK].astype(np.int64), m.astype(np.uint8).tobytes()

        return lambda texts: map(of, texts)

    return map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id")], F.col("text"), start, "n_shingles long, set_key binary, head array<long>, tail binary")


def chunk_keys(head) -> list:
    """Key columns in a fixed order: for each chunk, its symbols without each choice of `ERRORS` of them."""
    return [F.xxhash64(F.lit(c), F.lit(m), *(head[c * CHUNK + j] for j in kept)) for c in range(CHUNKS) for m, kept in enumerate(combinations(range(CHUNK), CHUNK - ERRORS))]


def _tail_matches(a: pd.Series, b: pd.Series) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return (x == y).mean(axis=1)


def _alike(pairs: DataFrame, tails: DataFrame) -> DataFrame:
    """Of pairs (u, v), those that may be similar by size and whole signature."""

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_tail_matches(a, b) if len(a) else np.empty(0))

    side = lambda k: tails.select(F.col("doc_id").alias(k), F.col("tail").alias(f"tail_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    near = pairs.join(side("v"), "v").join(side("u"), "u").where("4 * least(n_u, n_v) >= 3 * greatest(n_u, n_v)")
    return near.where(agreement("tail_u", "tail_v") >= SIGNATURE_LEAST).select("u", "v")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (u, v), those with 100 * intersection >= percent * union of the full shingle sets."""

    def run(batches):
        cache, last, kept = WordCache(), None, None
        for pdf in batches:
            yes = np.zeros(len(pdf), bool)
            for k, (u, a, b) in enumerate(zip(pdf["u"], pdf["text_u"], pdf["text_v"], strict=True)):
                if u != last:
                    last, kept = u, shingle_set(a, width, cache)
                other = shingle_set(b, width, cache)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                yes[k] = 100 * both >= percent * (len(kept) + len(other) - both)
            yield pdf.loc[yes, ["u", "v"]]

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "text_u", "text_v").mapInPandas(run, "u long, v long")


def _pairs_in_blocks(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components under one key whose signatures agree enough, each pair under its first common key only.

    `members`: key, ordinal (of the key), doc_id, component, n (documents under the key), head, tail. Keys of over
    BLOCK documents are dealt over pairs of blocks, so no task holds more than two blocks.
    """
    kept = np.array([[c * CHUNK + j for j in k] for c in range(CHUNKS) for k in combinations(range(CHUNK), CHUNK - ERRORS)])

    def compare(g: pd.DataFrame):
        comp = g["component"].to_numpy()
        if len(g) < 2 or (comp == comp[0]).all():
            return None
        ids, ordinal, blk = g["doc_id"].to_numpy(), g["ordinal"].iloc[0], g["blk"].to_numpy()
        tail = np.frombuffer(b"".join(g["tail"]), np.uint8).reshape(len(g), -1)
        size = g["n_shingles"].to_numpy()
        found = []
        two = g["lo"].iloc[0] != g["hi"].iloc[0]
        for i in range(len(g) - 1):
            js = np.arange(i + 1, len(g))
            ok = (comp[js] != comp[i]) & (4 * np.minimum(size[js], size[i]) >= 3 * np.maximum(size[js], size[i]))
            if two:
                ok &= blk[js] != blk[i]
            js = js[ok]
            if len(js):
                js = js[(tail[js] == tail[i]).mean(axis=1) >= SIGNATURE_LEAST]
            found += [(i, j) for j in js.tolist()]
        if not found:
            return None
        heads = np.stack(g["head"].to_list())
        i, j = np.array(found).T
        first = (heads[i][:, kept] == heads[j][:, kept]).all(axis=2).argmax(axis=1) == ordinal
        i, j = i[first], j[first]
        return pd.DataFrame({"u": np.minimum(ids[i], ids[j]), "v": np.maximum(ids[i], ids[j])})

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            marks = pdf[["key", "ordinal", "lo", "hi"]].to_numpy()
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            starts = [0, *cuts.tolist()]
            for a, b in zip(starts, starts[1:], strict=False):
                if (out := compare(pdf.iloc[a:b])) is not None:
                    yield out
            rest = pdf.iloc[starts[-1] :]
        if rest is not None and (out := compare(rest)) is not None:
            yield out

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        members.withColumn("blk", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", "ordinal", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "doc_id", "component", "n_shingles", "head", "tail")
    )
    return dealt.repartition("key", "ordinal", "lo", "hi").sortWithinPartitions("key", "ordinal", "lo", "hi", "doc_id").mapInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, class_id, component_id, kept.

    Texts are linked where 100 * intersection >= percent * union of their shingle sets; texts with one set form a
    class (class_id: its smallest doc_id), of which only that document is compared. component_id is the smallest
    doc_id reachable over links. Null and blank texts have no shingles and are linked with nothing. Rows repeated with
    one doc_id are returned each; kept is true for all of them. A row without doc_id takes the component of its class,
    never names one, and is kept only if nothing with a doc_id is in it. Other columns of `docs` are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    docs = docs.select("doc_id", "text")
    sigs = scratch.save(signatures(docs, width), "signatures")
    classes = scratch.save(sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = sigs.join(classes.select(F.col("class_id").alias("doc_id"), "set_key"), ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"])
    # a doc_id on rows with different texts can head several classes; the smallest set then stands for it
    reps = scratch.save(reps.groupBy("doc_id").agg(F.min(F.struct("set_key", "n_shingles", "head", "tail")).alias("s")).select("doc_id", "s.*"), "representatives")
    head = [F.col("head")[k] for k in range(CHUNKS * CHUNK)]
    keys = reps.select("doc_id", F.posexplode(F.array(*chunk_keys(head))).alias("ordinal", "key"))
    hubs = keys.groupBy("key", "ordinal").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = scratch.save(keys.join(hubs, ["key", "ordinal"]), "members")

    pairs = members.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct()
    reps_text = docs  # texts are read again rather than kept beside the signatures
    star = scratch.save(_confirmed(_alike(pairs, reps), reps_text, width, percent), "star")
    first = components(star, scratch, "first")
    labelled = members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_keys = labelled.groupBy("key", "ordinal").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key", "ordinal")
    left = labelled.join(open_keys, ["key", "ordinal"]).join(reps, "doc_id").select("key", "ordinal", "doc_id", "component", "n", "n_shingles", "head", "tail")
    rest = scratch.save(_confirmed(_pairs_in_blocks(left), reps_text, width, percent), "rest")
    final = components(star.unionByName(rest), scratch, "all")

    named = classes.join(final.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_key", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
