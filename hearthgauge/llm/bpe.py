"""BPE encoding and decoding with the vocabulary of a tokenizer file; merges by a segment tree over adjacent pairs.

The tree's leaves hold the rank of each adjacent pair and its place, inner nodes the smaller of two. The root is the
leftmost pair of the lowest rank; merging it changes two neighbouring leaves and clears one, each in logarithmic time,
until no pair can be merged. Pieces recur, so each task keeps the ids of those it met, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import unicodedata
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .texts import map_texts

BITS, PLACE_BITS = 20, 40
PLACE, NEVER = (1 << PLACE_BITS) - 1, 1 << 62
#: Letters of the longest words and pieces that are kept.
LONGEST = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next letter from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in set(printable) else next(spare)) for b in range(256)]


def put(tree: list[int], i: int, value: int) -> None:
    """Sets a leaf and the least values above it, as far as they change."""
    if tree[i] == value:
        return
    tree[i] = value
    while i > 1:
        other = tree[i ^ 1]
        i >>= 1
        if other < value:
            value = other
        if tree[i] == value:
            return
        tree[i] = value


def merge_pairs(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """`symbols` after all merges; ranks: left id << BITS | right id -> (rank << PLACE_BITS, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    if n == 2:
        found = get(symbols[0] << BITS | symbols[1])
        return symbols if found is None else [found[1]]
    width = 1 << (n - 2).bit_length()
    ids, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    tree = [NEVER] * (2 * width)  # rank and place: the least is the leftmost of the lowest rank
    left = ids[0]
    for k in range(n - 1):
        right = ids[k + 1]
        if (found := get(left << BITS | right)) is not None:
            tree[width + k] = found[0] | k
        left = right
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (best := tree[1]) != NEVER:
        k = best & PLACE
        gone = after[k]
        own = ids[k] = get(ids[k] << BITS | ids[gone])[1]
        nxt, prev = after[gone], before[k]
        after[k] = nxt
        if nxt >= 0:
            before[nxt] = k
            found = get(own << BITS | ids[nxt])
            put(tree, width + k, NEVER if found is None else found[0] | k)
            put(tree, width + gone, NEVER)
        else:
            put(tree, width + k, NEVER)  # the last symbol has no leaf of its own
        if prev >= 0:
            found = get(ids[prev] << BITS | own)
            put(tree, width + prev, NEVER if found is None else found[0] | prev)
    out, k = [], 0
    while k >= 0:
        out.append(ids[k])
        k = after[k]
    return out


def kept_in_worker(key: str, make):
    """What `make` returned for `key` when this process first asked; a Python worker serves many tasks."""
    state = sys.modules.setdefault("hearthgauge_worker_state", types.ModuleType("hearthgauge_worker_state"))
    if key not in state.__dict__:
        state.__dict__[key] = make()
    return state.__dict__[key]


class Bpe:
    """Encoder and decoder of a tokenizer file: NFC, white space to one space, lower case; letters, single digits,
    other signs and English contractions as pieces; bytes as letters; an end mark on a piece's last symbol."""

    def __init__(self, content: bytes, most_words: int = 400_000, most_pieces: int = 700_000):
        file = json.loads(content)
        model = file["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        v, cut = self.vocab, len(model["continuing_subword_prefix"] or "")
        self.ranks: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            self.ranks[v[a] << BITS | v[b]] = (k << PLACE_BITS, v[a + b[cut:]])
        self.token = {i: t for t, i in v.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.number = {i: str(i) for i in self.token}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"), regex.V0).findall
        # without an unknown token, symbols that the vocabulary lacks are left out
        letters = byte_letters()
        self.inner = [v.get(c) for c in letters]
        self.last = [v.get(c + self.end) for c in letters]
        self.piece_cache: dict[str, tuple[int, ...]] = {}
        self.word_cache: dict[str, tuple[int, ...]] = {}
        self.text_cache: dict[str, tuple[int, str, str]] = {}
        self.most = {id(self.piece_cache): most_pieces}
        self.most_words = most_words
        self.joined = " " if file["decoder"] is None else ""
        self.space = regex.compile(r"\s+")
        #: What str.split() parts at although it is no white space to the pattern.
        self.separators = re.compile("[\x1c-\x1f]").search

    def _put(self, cache: dict, key: str, value):
        """Keeps the value of a key of LONGEST letters at most, so the memory of a cache is bounded by its entries."""
        if len(key) <= LONGEST:
            if len(cache) >= self.most.get(id(cache), self.most_words):
                cache.clear()
            cache[key] = value
        return value

    def forget(self) -> None:
        for cache in (self.piece_cache, self.word_cache, self.text_cache):
            cache.clear()

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "replace")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self._put(self.piece_cache, text, tuple(merge_pairs([x for x in symbols if x is not None], self.ranks)))

    def normal(self, text: str) -> str:
        # letter by letter: a capital sigma is never a final one, and other letters don't depend on their place
        return self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def _run(self, text: str) -> list[int]:
        out: list[int] = []
        get = self.piece_cache.get
        for p in self.pieces(self.normal(text)):
            out.extend(get(p) or self.piece(p))
        return out

    def _word(self, text: str) -> tuple[int, ...]:
        """Ids of a text without white space. Letters alone are one piece, and so is a sign after them."""
        t = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        get = self.piece_cache.get
        if t.isalpha():
            return get(t) or self.piece(t)
        if t[-1] in ".,;:!?" and (letters := t[:-1]).isalpha():
            return (get(letters) or self.piece(letters)) + (get(t[-1]) or self.piece(t[-1]))
        return tuple(chain.from_iterable([get(p) or self.piece(p) for p in self.pieces(t)]))

    def word(self, text: str) -> tuple[int, ...]:
        return self._put(self.word_cache, text, self._word(text))

    def parts(self, text: str) -> list[str] | None:
        """Words of a text, if it can be encoded word by word: pieces, normal forms and small letters don't depend on
        what is beyond white space; but added tokens and rare separators may."""
        if self.separators(text) or self.split_added and any(t in text for t in self.added):
            return None
        return text.split()

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; the strings of added tokens become their ids."""
        if not text:
            return []
        words = self.parts(text)
        if words is not None:
            get, word = self.word_cache.get, self.word
            return list(chain.from_iterable([get(w) or word(w) for w in words]))
        out: list[int] = []
        for k, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if k % 2:
                out.append(self.added[part])
            else:
                out.extend(self._run(part))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined as the library joins them when the file names no decoder: by one space, special tokens included."""
        token = self.token
        return self.joined.join([token[i] for i in ids if i in token])

    def _spelt(self, word: str) -> tuple[int, str, str]:
        ids = self._word(word)
        number, token = self.number, self.token
        return self._put(self.text_cache, word, (len(ids), " ".join([number[i] for i in ids]), self.joined.join([token[i] for i in ids])))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded text."""
        words = self.parts(text) if text else []
        if words is None:
            ids = self.encode(text)
            n, numbers, decoded = len(ids), " ".join(map(str, ids)), self.decode(ids)
        else:
            get, spelt = self.text_cache.get, self._spelt
            found = [f for f in [get(w) or spelt(w) for w in words] if f[0]]
            n, numbers, decoded = sum([f[0] for f in found]), " ".join([f[1] for f in found]), self.joined.join([f[2] for f in found])
        return n, hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None, digests: bool = False, hold: bool = False) -> DataFrame:
    """`docs` with n_tokens, ids (array<int>) and decoded (string); or, with `digests`, their sha256 in place of both.

    path: a tokenizer file, read on the driver and sent to the executors (a few MB at most, MOST_FILE). keep: columns of `docs` to return
    before them (default: doc_id). hold: a worker keeps the words it has seen from task to task, which is faster, but
    their memory (that many entries, each of a word of LONGEST letters at most) stays taken while the worker serves other
    stages. Null texts count as empty: no tokens. Every row is treated alone, so repeated rows and null ids stay as they
    are; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    with open(path, "rb") as f:
        content = f.read(MOST_FILE + 1)
    if len(content) > MOST_FILE:
        raise ValueError(f"{path} is over {MOST_FILE} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(content)
    key = f"bpe-{hashlib.sha256(content).hexdigest()}"

    held = lambda: kept_in_worker(key, lambda: Bpe(sent.value))

    def start():
        bpe = held()
        if digests:
            return lambda texts: map(bpe.digests, texts)
        return lambda texts: ((len(ids), ids, bpe.decode(ids)) for ids in map(bpe.encode, texts))

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    return map_texts(docs, keep, docs["text"], start, made, finish=None if hold else lambda: held().forget())


MOST_FILE = 16 << 20
