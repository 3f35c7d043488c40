"""Removal of passages that an earlier document has, with a count-min prefilter.

Documents are dealt into batches of a few MB; a batch is read the same way in each of three passes. Within a batch the
smallest document of each window is known, so between batches a window is one row a batch, however often it occurs.

Pass 1: each batch adds its distinct windows to a sketch of two rows of cells. The partial sketches, as sorted cell
numbers in ranges, are merged range by range; nothing gathers the whole sketch. A merged cell never counts less than the
batches of its windows, so a window with a cell of count one in either row is in one batch only. Each batch gets back
one bit for each cell it sent: whether it counts two or more.
Pass 2: windows with two such bits, which are those of several batches and a few others, are grouped exactly, by 96 bits
of hash; a batch is told which of its windows start in a smaller document of another batch.
Pass 3 removes words, by what the batch was told and by its own smallest documents.

The sketch has CELLS_PER_WINDOW cells a window, so it grows with the text and filters alike at every size; one range is
all that a task holds of it. Ranges grow with the sketch up to RANGE_BITS[1], so up to about 1.6 TB of text a row of the
sketch has 2**RANGES_BITS ranges at most, and a batch sends some 40 windows in one shuffled row. Beyond that the number of
ranges grows: results stay the same, but at 100 TB a shuffled row holds one or two windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from .wordhash import WordCache, run_hashes, split_words, word_hashes

WINDOW = 13
ROWS, CELLS_PER_WINDOW = 2, 4
#: Bits of a range's size, least and most, and of the number of ranges aimed at.
RANGE_BITS, RANGES_BITS = (20, 26), 14
#: Bytes of text in a batch, and the least number of batches.
BATCH, BATCHES_LEAST = 4 << 20, 256
#: Texts whose copies take more than an eighth of a batch are dealt over all batches; so many texts at most, by their part of all bytes.
HOT_TEXTS = 1_000_000
NO_ID = 2**63 - 1
PARTS = "part long, g long, row int, cells binary"


def cells(h: np.ndarray, bits: int, row: int) -> np.ndarray:
    """Cell numbers of window hashes in one row of the sketch; rows follow one another, 2**bits cells in all."""
    c = (h if row == 0 else h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits)
    return c | np.uint64(row << (bits - 1))


def pack(offsets: np.ndarray, planes: int) -> bytes:
    """Sorted offsets, repeats included, as the byte planes of their differences."""
    return np.diff(offsets, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes()


def unpack(raw: bytes, planes: int) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).reshape(planes, -1).astype(np.int64)
    return np.cumsum(sum(parts[k] << 8 * k for k in range(planes)))


class Batch:
    """Distinct texts of some documents, their distinct windows (hashes in order) and each window's smallest document."""

    def __init__(self, ids: np.ndarray, texts, window: int):
        cache, at = WordCache(), {}
        self.window = window
        self.of_row = np.empty(len(texts), np.int64)
        words, smallest = [], []
        for k, (doc, text) in enumerate(zip(ids.tolist(), texts, strict=True)):
            t = at.get(text)
            if t is None:
                t = at[text] = len(words)
                words.append(split_words(text))
                smallest.append(doc)
            elif doc < smallest[t]:
                smallest[t] = doc
            self.of_row[k] = t
        self.words = words
        hashed = [word_hashes(w, cache) for w in words]
        runs = [run_hashes(h, window) for h in hashed]
        n = np.array([len(r) for r in runs], np.int64)
        self.ends = np.cumsum(n)
        every = np.concatenate([*runs, np.empty(0, np.uint64)])
        self.hashes, first, self.which = np.unique(every, return_index=True, return_inverse=True)
        self.least = np.full(len(self.hashes), NO_ID, np.int64)
        np.minimum.at(self.least, self.which, np.repeat(np.array(smallest, np.int64), n))
        self._hashed, self._first = hashed, first

    def second(self) -> np.ndarray:
        """32 further bits of hash for each distinct window."""
        every = np.concatenate([*(run_hashes(h, self.window, lane=1) for h in self._hashed), np.empty(0, np.uint64)])
        return every[self._first].astype(np.uint32).view(np.int32)

    def in_order(self, bits: int, row: int) -> tuple[np.ndarray, np.ndarray | slice]:
        """Cells of the distinct windows in rising order, and that order."""
        c = cells(self.hashes, bits, row)
        if row == 0:
            return c, slice(None)
        order = np.argsort(c, kind="stable")
        return c[order], order


def _parts(dealt: DataFrame, window: int, bits: int, range_bits: int) -> DataFrame:
    """(part, g, row, cells): the cells of each batch by range; part is the range's number over both rows."""
    planes = 3 if range_bits <= 24 else 4

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        batch, out = Batch(pdf["doc_id"].to_numpy(), pdf["text"].tolist(), window), []
        g = pdf["g"].iloc[0]
        for row in range(ROWS):
            c, _ = batch.in_order(bits, row)
            if not len(c):
                continue
            which = c >> np.uint64(range_bits)
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(c)]
            low = (c & np.uint64((1 << range_bits) - 1)).astype(np.int64)
            out += [(int(which[a]), g, row, pack(low[a:b], planes)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame(out, columns=["part", "g", "row", "cells"])

    return dealt.groupBy("g").applyInPandas(run, PARTS)


def _answers(parts: DataFrame, range_bits: int) -> DataFrame:
    """(part, g, row, cells): for each row of `parts`, one bit a cell (cells): whether it counts two or more in all batches."""
    planes = 3 if range_bits <= 24 else 4

    def answer(held):
        counts = np.zeros(1 << range_bits, np.uint8)
        for _, _, raw in held:
            offsets = unpack(raw, planes)
            first = np.concatenate([[True], offsets[1:] != offsets[:-1]])
            counts[offsets[~first]] = 2
            counts[offsets[first]] = np.minimum(counts[offsets[first]] + 1, 2)
        for g, row, raw in held:
            yield g, row, np.packbits(counts[unpack(raw, planes)] > 1).tobytes()

    def run(batches):
        at, held, out, size = None, [], [], 0

        def ready():
            return pd.DataFrame(out, columns=["part", "g", "row", "cells"])

        for pdf in batches:
            for part, g, row, raw in zip(pdf["part"].tolist(), pdf["g"].tolist(), pdf["row"].tolist(), pdf["cells"], strict=True):
                if part != at:
                    out += [(at, *a) for a in answer(held)]
                    size += len(held)
                    at, held = part, []
                    if size > 20_000:
                        yield ready()
                        out, size = [], 0
                held.append((g, row, raw))
        out += [(at, *a) for a in answer(held)]
        if out:
            yield ready()

    return parts.repartition("part").sortWithinPartitions("part").mapInPandas(run, PARTS)


def _candidates(dealt: DataFrame, answers: DataFrame, window: int, bits: int, range_bits: int) -> DataFrame:
    """(h1, h2, doc_id, g, at): windows with two bits, one row a batch; doc_id is the batch's smallest, at the window's place."""

    def run(docs: pd.DataFrame, bit_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(bit_rows):
            return pd.DataFrame({"h1": np.empty(0, np.int64), "h2": np.empty(0, np.int32), "doc_id": np.empty(0, np.int64), "g": np.empty(0, np.int64), "at": np.empty(0, np.int32)})
        batch = Batch(docs["doc_id"].to_numpy(), docs["text"].tolist(), window)
        twice = np.ones(len(batch.hashes), bool)
        for row in range(ROWS):
            c, order = batch.in_order(bits, row)
            bit_of = dict(zip(bit_rows["part"].tolist(), bit_rows["cells"], strict=True))
            which = c >> np.uint64(range_bits)
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(c)]
            bits_here = [np.unpackbits(np.frombuffer(bit_of[int(which[a])], np.uint8), count=b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
            own = np.empty(len(c), bool)
            own[order] = np.concatenate(bits_here) > 0
            twice &= own
        at = np.flatnonzero(twice)
        return pd.DataFrame({"h1": batch.hashes[at].view(np.int64), "h2": batch.second()[at], "doc_id": batch.least[at], "g": docs["g"].iloc[0], "at": at.astype(np.int32)})

    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(run, "h1 long, h2 int, doc_id long, g long, at int")


def _removed(dealt: DataFrame, told: DataFrame, window: int) -> DataFrame:
    """Per row of `dealt`: doc_id, no_id, text_kept, n_words, n_removed. `told`: (g, places) of windows that start elsewhere earlier."""

    def run(docs: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(docs["doc_id"].to_numpy(), docs["text"].tolist(), window)
        elsewhere = np.zeros(len(batch.hashes), bool)
        for p in places["places"]:
            elsewhere[np.asarray(p, np.int64)] = True
        rows, made = [], {}
        for doc, t in zip(docs["doc_id"].tolist(), batch.of_row.tolist(), strict=True):
            if (doc, t) not in made:
                words = batch.words[t]
                n = len(words)
                which = batch.which[batch.ends[t] - max(0, n - window + 1) : batch.ends[t]]
                at = np.flatnonzero(elsewhere[which] | (batch.least[which] < doc))
                if len(at):
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                made[doc, t] = (b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words))
            rows.append(made[doc, t])
        out = pd.DataFrame(rows, columns=["text_kept", "n_words", "n_removed"])
        out.insert(0, "no_id", docs["no_id"].to_numpy())
        out.insert(0, "doc_id", docs["doc_id"].to_numpy())
        return out

    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(run, "doc_id long, no_id boolean, text_kept string, n_words long, n_removed long")


def _dealt(docs: DataFrame, total: int) -> DataFrame:
    """(doc_id, no_id, text, g): copies of a text in one batch, unless they are many. No column is null."""
    batches = max(BATCHES_LEAST, total // BATCH)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    # HOT_TEXTS at most can each have that part of all bytes, 8 bytes a text
    hot = docs.groupBy(key.alias("k")).agg(F.sum(size + 1).alias("bytes")).where(F.col("bytes") > max(total // batches // 8, total // HOT_TEXTS)).select("k", F.lit(True).alias("hot"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("k"), F.monotonically_increasing_id().alias("row"))
    placed = keyed.join(F.broadcast(hot), "k", "left").withColumn("g", F.pmod(F.when(F.col("hot"), F.xxhash64("doc_id", "row")).otherwise(F.col("k")), F.lit(batches)))
    return placed.select("doc_id", "no_id", "text", "g").repartition("g")


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, text_kept, n_words, n_removed.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Words are parted at the six ASCII white-space characters; text_kept joins those left by
    one space. Null and blank texts have no words. Rows without doc_id count as after all others, and not as
    before each other. Rows repeated with one doc_id are judged each by its own text, and never against each other.
    Other columns are ignored. `docs` is read several times and must give the same rows in the same order each time, as
    a table does. Equality of windows is that of 64 bits of hash within a batch, of 96 between batches.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, total / 6 * CELLS_PER_WINDOW))), RANGE_BITS[0] + 1, 62))
    range_bits = int(np.clip(bits - RANGES_BITS, *RANGE_BITS))
    dealt = _dealt(docs, total)
    answers = _answers(_parts(dealt, window, bits, range_bits), range_bits)
    candidates = _candidates(dealt, answers, window, bits, range_bits)
    # a window has one row a batch; its smallest document runs along them, so none is held for the others
    along = Window.partitionBy("h1", "h2").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = candidates.withColumn("first", F.min("doc_id").over(along)).where("first < doc_id").groupBy("g").agg(F.collect_list("at").alias("places"))
    out = _removed(dealt, told, window)
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text_kept", "n_words", "n_removed")
