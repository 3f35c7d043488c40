"""Packing token sequences into windows of equal capacity, by Karmarkar-Karp differencing.

A document's tokens are cut into full windows first. What remains of the documents, less than a window each, is packed
in batches: partial partitions, of one remainder each at the start, are merged two at a time, those of the largest
difference between their windows first, so that the fullest window of one meets the emptiest of the other. The last
partition has near-equal windows. A batch's total is made a whole number of windows (what is over waits for the next
batch), the window count rises while a window exceeds the capacity and the padding stays under a 256th, and what still
exceeds it is cut off and put where there is room. The last remainders of a task become sequences of powers of two.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import deque
from itertools import compress
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import BITS, MOST_FILE, PLACE_BITS, Bpe, kept_in_worker, merge_pairs

CAPACITY = 2048
#: The id after each document's own.
END = 1
#: Remainders packed together.
BATCH = 1024
#: Least share of tokens to padding for which the window count rises.
SPARE = 256
#: Bytes of the longest piece that is merged beside others, and letters of the longest word that is kept.
LONGEST_PIECE, LONGEST_WORD = 64, 48
#: Bytes of the texts that are encoded together.
PORTION = 16 << 20
#: Calls whose words stay known when others are forgotten; signs that are a piece of their own at a word's end.
RECENT, SIGNS = 1, ".,;:!?*&%$#"

Piece = tuple  # (document number in the task, start, length)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of `sizes` in k windows of near-equal sums, by multiway differencing. Empty windows are left out."""
    # a partial partition: its windows that aren't empty as (sum, node), largest first; a node is an item or two nodes
    nodes: list = []
    heap = []
    for i, size in enumerate(sizes):
        nodes.append(i)
        heap.append((-size, i, [(size, i)]))
    heapq.heapify(heap)
    spread = lambda p: p[0][0] - (p[-1][0] if len(p) == k else 0)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the smallest of a meet the smallest of b, in opposite order
            met = []
            for (x, u), (y, v) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True):
                met.append((x + y, len(nodes)))
                nodes.append((u, v))
            a, b = a[: len(a) - over], b[: len(b) - over] + met
        merged = sorted(a + b, reverse=True)
        heapq.heappush(heap, (-spread(merged), made, merged))
        made += 1
    windows = []
    for _, node in heap[0][2] if heap else []:
        items, todo = [], [node]
        while todo:
            x = nodes[todo.pop()]
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        windows.append(items)
    return windows


def fill(windows: list[list[Piece]], capacity: int) -> None:
    """Cuts what exceeds the capacity off the longest piece of a window and puts it where there is room."""
    total = lambda w: sum(p[2] for p in w)
    room = [[capacity - t, w] for w in windows if (t := total(w)) < capacity]
    for w in windows:
        excess = total(w) - capacity
        while excess > 0:
            w.sort(key=lambda p: p[2])
            doc, start, length = w.pop()
            most = min(excess, length, room[-1][0])
            if length > most:
                w.append((doc, start, length - most))
            room[-1][1].append((doc, start + length - most, most))
            room[-1][0] -= most
            excess -= most
            if not room[-1][0]:
                room.pop()


def pack(pieces: list[Piece], capacity: int = CAPACITY, spare: int = SPARE) -> list[list[Piece]]:
    """Windows of pieces whose total is a whole number of windows."""
    total = sum(p[2] for p in pieces)
    least = total // capacity
    first, k = None, least
    while k == least or (k - least) * capacity * spare <= total:
        windows = [[pieces[i] for i in w] for w in difference([p[2] for p in pieces], k)]
        if max((sum(p[2] for p in w) for w in windows), default=0) <= capacity:
            return windows
        first, k = first or windows, k + 1
    fill(first, capacity)  # no padding, but cuts
    return first


def whole_windows(pieces: list[Piece], capacity: int) -> tuple[list[Piece], list[Piece]]:
    """Pieces whose total is a whole number of windows, and the rest, less than one; the last piece may be cut in two."""
    rest, over = [], sum(p[2] for p in pieces) % capacity
    pieces = sorted(pieces, key=lambda p: (p[2], p))
    while over:
        # the smallest that is enough, or else the largest
        doc, start, length = pieces.pop(min(bisect_left(pieces, over, key=lambda p: p[2]), len(pieces) - 1))
        most = min(over, length)
        if length > most:
            pieces.append((doc, start, length - most))
        rest.append((doc, start + length - most, most))
        over -= most
    return pieces, rest


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of lengths that are different powers of two, largest first."""
    out, total = [], sum(p[2] for p in pieces)
    todo = sorted(pieces, key=lambda p: p[2])
    while total:
        size = 1 << total.bit_length() - 1
        total -= size
        out.append([])
        while size:
            doc, start, length = todo.pop()
            most = min(size, length)
            out[-1].append((doc, start, most))
            size -= most
            if length > most:
                todo.append((doc, start + most, length - most))
    return out


def pack_stream(lengths: Iterator[tuple[int, int]], capacity: int = CAPACITY, batch: int = BATCH) -> Iterator[list[Piece]]:
    """Sequences (lists of pieces) of documents (number, tokens), as soon as they are known."""
    held: list[Piece] = []
    full = batch
    for doc, n in lengths:
        cut = n - n % capacity
        yield from ([(doc, start, capacity)] for start in range(0, cut, capacity))
        if n > cut:
            held.append((doc, cut, n - cut))
        if len(held) >= full:
            fits, held = whole_windows(held, capacity)
            full = len(held) + batch
            yield from pack(fits, capacity)
    fits, rest = whole_windows(held, capacity)
    yield from pack(fits, capacity)
    yield from powers(rest)


class BatchBpe(Bpe):
    """Ids of whole texts as little-endian unsigned 32-bit numbers. New words of many texts are merged side by side."""

    def __init__(self, content: bytes, most_words: int = 1_000_000):
        super().__init__(content)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        values = list(self.ranks.values())
        self.pair_rank = np.fromiter((v[0] >> PLACE_BITS for v in values), np.int64, len(values))[order]
        self.pair_id = np.fromiter((v[1] for v in values), np.int64, len(values))[order]
        self.first = np.array([-1 if x is None else x for x in self.inner], np.int64)
        self.final = np.array([-1 if x is None else x for x in self.last], np.int64)
        self.most_words, self.known, self.recent = most_words, {}, deque(maxlen=RECENT)
        self.rare_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among those that merge, or -1."""
        keys = left << BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, at, -1)

    def merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: in each round every piece merges its leftmost pair of the lowest rank."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        out = [b""] * len(raw)
        side = [k for k, r in enumerate(raw) if 0 < len(r) <= LONGEST_PIECE]
        for k, r in enumerate(raw):
            if len(r) > LONGEST_PIECE:
                symbols = [self.inner[b] for b in r[:-1]] + [self.last[r[-1]]]
                out[k] = array("I", merge_pairs([x for x in symbols if x is not None], self.ranks)).tobytes()
        if not side:
            return out
        lengths = np.fromiter((len(raw[k]) for k in side), np.int64, len(side))
        letters = np.frombuffer(b"".join([raw[k] for k in side]), np.uint8)
        ids, owner = self.first[letters], np.repeat(np.arange(len(side)), lengths)
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.final[letters[ends]]
        there = ids >= 0  # without an unknown token, symbols that the vocabulary lacks are left out
        ids, owner = ids[there], owner[there]
        done_ids, done_owner = [], []
        none = np.int64(1) << 40
        pair = np.full(len(ids), -1, np.int64)
        same = owner[:-1] == owner[1:]
        pair[:-1][same] = self._pairs(ids[:-1][same], ids[1:][same])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            key = np.where(pair >= 0, self.pair_rank[pair], none) << 22 | np.arange(len(ids))
            best = np.minimum.reduceat(key, starts)
            goes_on = best >> 22 < none
            sizes = np.diff(np.append(starts, len(ids)))
            stays = np.repeat(goes_on, sizes)
            done_ids.append(ids[~stays])
            done_owner.append(owner[~stays])
            if not goes_on.any():
                break
            at = best[goes_on] & (1 << 22) - 1
            ids[at] = self.pair_id[pair[at]]
            stays[at + 1] = False
            at = np.cumsum(stays)[at] - 1
            ids, owner, pair = ids[stays], owner[stays], pair[stays]
            last = np.append(owner[1:] != owner[:-1], True)
            pair[at] = -1
            inner = at[~last[at]]
            pair[inner] = self._pairs(ids[inner], ids[inner + 1])
            before = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            pair[before] = self._pairs(ids[before], ids[before + 1])
        if not done_ids:
            return out
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        stop = 4 * np.cumsum(np.bincount(owner, minlength=len(side)))
        start = 0
        for k, end in zip(side, stop.tolist(), strict=True):
            out[k], start = data[start:end], end
        return out

    def _remember(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), 50_000):
            part = pieces[k : k + 50_000]
            self.known.update(zip(part, self.merged(part), strict=True))

    def learn(self, words: list[str]) -> None:
        """Ids of new words into `known`. A piece that stands alone is a word of one piece; letters with signs after them
        are two, other words are cut by the pattern."""
        known = self.known
        signed = [w for w in words if not w.isalpha()]
        cores = [w.rstrip(SIGNS) for w in signed]
        fine = [c.isalpha() for c in cores]
        new = {w for w in words if w.isalpha()}
        new.update(compress(cores, fine))
        cuts = {w: self.pieces(w) for w, f in zip(signed, fine, strict=True) if not f}
        tails = {t: self.pieces(t) for t in {w[len(c) :] for w, c, f in zip(signed, cores, fine, strict=True) if f}}
        new.update(*cuts.values(), *tails.values())
        self._remember([p for p in new if p not in known])
        ends = {t: b"".join([known[p] for p in ps]) for t, ps in tails.items()}
        known.update({w: known[c] + ends[w[len(c) :]] for w, c, f in zip(signed, cores, fine, strict=True) if f})
        known.update({w: b"".join([known[p] for p in ps]) for w, ps in cuts.items()})

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose words are parted by ASCII white space, each different word looked up once."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        seen = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        if len(known) > self.most_words:
            kept = set().union(*self.recent, seen)
            self.known = known = {w: v for w, v in known.items() if w in kept}
        self.recent.append(seen)
        self.learn([w for w in seen if w not in known])
        spelt = [known[w] for w in seen]
        for w in [w for w in known if len(w) > LONGEST_WORD] if any(len(w) > LONGEST_WORD for w in seen) else ():
            del known[w]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4
        data, begins = np.frombuffer(b"".join(spelt), np.uint32), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ends = np.cumsum(n)
        place = np.repeat(begins[at] - ends + n, n)
        place += np.arange(len(place))
        ids = data[place].tobytes()
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        cuts = (4 * np.concatenate(([0], ends))[offsets]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Words are remembered from call to call, most_words at most beside those of the last calls."""
        out = [b""] * len(texts)
        plain, at = [], []
        for k, t in enumerate(texts):
            if t and (self.rare_space(t) or any(a in t for a in self.added)):
                out[k] = array("I", self.encode(t)).tobytes()
            elif t:
                plain.append(unicodedata.normalize("NFC", t).replace("Σ", "σ").lower())
                at.append(k)
        for k, ids in zip(at, self._by_words(plain) if plain else (), strict=True):
            out[k] = ids
        return out

    def forget(self) -> None:
        super().forget()
        self.known = {}
        self.recent.clear()


def portions(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (id, text) of PORTION bytes of text at most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < rows.num_rows:
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PORTION, side="right")))
        yield rows.slice(k, end - k)
        k = end


MADE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, batch: int = BATCH, hold: bool = False) -> DataFrame:
    """Pieces of the token sequences of `docs` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset,
    ids (little-endian unsigned 32-bit numbers of the piece).

    A document's tokens are its text's ids and `end`; each token is in exactly one piece, each sequence holds at most
    `capacity`, its pieces without gaps from offset 0. Sequences are full, or of a length that is a power of two, but for
    those of a batch whose window count rose, which is under one token in 256. Null texts count as empty: `end` alone.
    Repeated rows are packed each on their own, so rows of one doc_id may repeat a start; other columns are ignored.

    Rows of a partition are packed together and nothing is shuffled: a task holds `batch` remainders at most. Numbers of
    sequences come from the partition's number, so a task that is run again gives the same ones, as long as `docs` is
    read from files.
    """
    with open(path, "rb") as f:
        content = f.read(MOST_FILE + 1)
    if len(content) > MOST_FILE:
        raise ValueError(f"{path} is over {MOST_FILE} bytes")
    sent, key = docs.sparkSession.sparkContext.broadcast(content), f"batch-bpe-{hashlib.sha256(content).hexdigest()}"
    source = docs.select("doc_id", "text")
    schema = StructType([source.schema["doc_id"], *StructType.fromDDL(MADE).fields])
    arrow = to_arrow_schema(schema)
    tail = array("I", [end]).tobytes()
    held = lambda: kept_in_worker(key, lambda: BatchBpe(sent.value))

    def run(batches):
        bpe, part = held(), TaskContext.get().partitionId()
        live: dict[int, list] = {}  # documents with tokens that have no sequence yet: id, tokens, bytes, tokens left

        def lengths():
            number = 0
            for rows in batches:
                for some in portions(rows):
                    for doc_id, ids in zip(some.column(0).to_pylist(), bpe.encode_many(some.column(1).to_pylist()), strict=True):
                        ids += tail
                        n = len(ids) // 4
                        live[number] = [doc_id, n, ids, n]
                        yield number, n
                        number += 1

        out: list[tuple] = []
        size = 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for sequence, pieces in enumerate(pack_stream(lengths(), capacity, batch)):
            offset = 0
            for number, start, length in pieces:
                doc = live[number]
                out.append((doc[0], start, length, doc[1], part << 40 | sequence, offset, doc[2][4 * start : 4 * (start + length)]))
                offset += length
                doc[3] -= length
                if not doc[3]:
                    del live[number]
            size += offset
            if size >= 1 << 20:
                yield give()
                out, size = [], 0
        if out:
            yield give()
        if not hold:
            bpe.forget()

    return source.mapInArrow(run, schema)
