"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, permuted by
their places; a text's vector bundles (adds) those of its trigrams, and a language's prototype those of all its texts.
A document has the language whose prototype makes the smallest angle with its vector. Vectors are centred on the mean
prototype first, as the trigrams that all languages share say nothing about any.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .texts import map_texts

DIMENSIONS, GRAM, LETTERS = 1024, 3, 256
BATCH = 256
UNKNOWN = "und"


def held_out() -> Column:
    """Whether a document is kept out of learning; true without a doc_id, which has no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def _code(point: int) -> int:
    return 1 + point % (LETTERS - 1) if chr(point).isalpha() else 0


_TABLE = np.array([_code(p) for p in range(0x600)], np.uint32)


def gram_codes(text: str | None) -> np.ndarray:
    """Trigrams of a text bounded by blanks, as numbers: lower-case letters, and each run of other characters as one
    blank; letters share codes by remainder. Empty without a letter."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    if len(far := np.flatnonzero(points >= len(_TABLE))):
        kinds, inverse = np.unique(points[far], return_inverse=True)
        codes[far] = np.array([_code(p) for p in kinds.tolist()], np.uint32)[inverse]
    if not codes.any():
        return np.empty(0, np.uint32)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their numbers."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.sort(codes)
    cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[cuts].astype(np.int64), np.diff(np.append(cuts, len(s)))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return counted(gram_codes(text))


class Vectors:
    """Trigram vectors, made when first met and kept up to a bound."""

    def __init__(self, most: int = 30_000):
        base = np.random.default_rng(1024).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
        self.places = [np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.most = most
        self.row: dict[int, int] = {}
        self.table = np.empty((most, DIMENSIONS), np.int8)

    def __call__(self, which: np.ndarray) -> np.ndarray:
        new = [g for g in which.tolist() if g not in self.row]
        if len(self.row) + len(new) > self.most:
            self.row.clear()
            if len(which) > self.most:
                return self.make(which)
            new = which.tolist()
        if new:
            at = len(self.row)
            self.table[at : at + len(new)] = self.make(np.array(new))
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[[self.row[g] for g in which.tolist()]]

    def make(self, which: np.ndarray) -> np.ndarray:
        a, b, c = which // LETTERS**2, which // LETTERS % LETTERS, which % LETTERS
        return self.places[0][a] * self.places[1][b] * self.places[2][c]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their prototypes, from all documents with a language that aren't held out.

    Each task bundles its documents of a language by adding their trigram counts, as bundling is linear, and sends one
    vector a language; they are added up by dimension. What reaches the driver is languages times DIMENSIONS numbers.
    """

    def run(batches):
        total: dict[str, dict[int, int]] = {}
        for pdf in batches:
            held: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                held.setdefault(lang, []).append(gram_codes(text))
            for lang, codes in held.items():
                own = total.setdefault(lang, {})
                which, n = counted(np.concatenate(codes))
                for g, k in zip(which.tolist(), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + k
        vectors = Vectors()
        for lang, counts in total.items():
            which, n = np.array([*counts], np.int64), np.array([*counts.values()], np.float64)
            v = np.zeros(DIMENSIONS)
            for k in range(0, len(which), 4096):
                v += n[k : k + 4096] @ vectors.make(which[k : k + 4096]).astype(np.float64)
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMENSIONS, dtype=np.int32), "value": v})

    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("text", "lang")
    rows = labelled.mapInPandas(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    langs = sorted(rows["lang"].unique())
    prototypes = rows.pivot(index="lang", columns="dim", values="value").loc[langs].to_numpy() if langs else np.empty((0, DIMENSIONS))
    return langs, prototypes


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Without a `model` (see learn) one is learnt from the rows that aren't held out: those whose crc32(doc_id as text)
    mod 4 is 2 are. Prediction reads the whole text only. lang_pred is `und`, with score 0, if the text is null or has
    no letter, or nothing was learnt. score is the cosine with the prototype, 0 at least; of languages
    with equal cosines the first by name is taken. Rows are predicted alone, so repeated rows have equal results; a null
    doc_id counts as held out. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    langs, prototypes = learn(docs) if model is None else model
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    profiles = unit(prototypes)
    centre = profiles.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    sent = spark.sparkContext.broadcast((langs, centre.astype(np.float32), unit(profiles - centre).astype(np.float32)))

    def start():
        names, middle, known = sent.value
        vectors = Vectors()

        def of(texts):
            out = [(UNKNOWN, 0.0)] * len(texts)
            for first in range(0, len(texts), BATCH):
                found = [grams(t) for t in texts[first : first + BATCH]]
                rows = [k for k, (g, _) in enumerate(found) if len(g)]
                if not rows or not names:
                    continue
                which, inverse = np.unique(np.concatenate([found[k][0] for k in rows]), return_inverse=True)
                counts = np.zeros((len(rows), len(which)), np.float32)
                counts[np.repeat(np.arange(len(rows)), [len(found[k][0]) for k in rows]), inverse] = np.concatenate([found[k][1] for k in rows])
                bundled = np.zeros((len(rows), DIMENSIONS), np.float32)
                for k in range(0, len(which), 4096):
                    bundled += counts[:, k : k + 4096] @ vectors(which[k : k + 4096]).astype(np.float32)
                cosine = unit(unit(bundled) - middle) @ known.T
                best = cosine.argmax(axis=1)
                for r, k in enumerate(rows):
                    out[first + k] = names[best[r]], float(np.clip(cosine[r, best[r]], 0, 1))
            return out

        return of

    return map_texts(docs, ["doc_id", held_out().alias("held_out")], F.col("text"), start, "lang_pred string, score double")
