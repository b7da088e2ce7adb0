"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rolled) by its place. A document bundles (adds) its n-gram vectors; a language's prototype bundles its
documents. The predicted language has the prototype of the largest cosine with the document.

The dot product of a bundle with a prototype is the sum of the dot products of its n-grams, so these are kept by
n-gram and a document costs one lookup for each letter; its own length divides out of the comparison and of the score.

Edge cases: a null text or one without a letter (of Unicode: digits, fractions and Roman numeral signs are none) is
``und`` with score 0. Very long texts are taken whole, a block at a time. Equal cosines: the first language by name.
Documents without language don't teach. No teaching document at all, or an empty table: everything is ``und``. Rows that
occur twice are predicted twice. A null doc_id teaches nothing. Further columns are ignored by ``predict`` and ``learn``,
whatever their names, and handed on by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, need

DIMENSIONS = 2048
SEED = 20240501
#: Letter codes: 0 parts words, 1-26 are a-z, 27-59 the letters of Latin-1 beyond, the rest shares what remains.
CODES, SHARED = 128, 60
BLOCK = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def code_table() -> np.ndarray:
    """Code by code point."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            low = ord(c.lower()[0])
            if 97 <= low <= 122:
                table[point] = low - 96
            elif 0xDF <= low <= 0xFF:
                table[point] = low - 0xDF + 27
            else:
                table[point] = SHARED + low * 2654435761 % 2**32 // 2**8 % (CODES - SHARED)
    return table


@lru_cache(2)
def letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (CODES, dimensions), dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """A row for each trigram id: the letters' vectors, rolled by two, one and no place, multiplied."""
    v = letter_vectors(dimensions)
    a, b, c = grams // CODES**2, grams // CODES % CODES, grams % CODES
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Ids of all letter trigrams, a block of the text at a time; runs of other characters, and the text's ends, count as one gap. None without a letter."""
    table = code_table()
    kept = np.zeros(1, np.uint8)  # the text begins with a gap
    for start in range(0, len(text) + 1, BLOCK):
        codes = table[np.frombuffer((text[start : start + BLOCK] + " " * (start + BLOCK > len(text))).encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([kept, codes])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep].astype(np.int32)
        if len(codes) >= 3:
            yield (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
        kept = codes[-2:].astype(np.uint8)


class Slots:
    """Dense numbers for the trigrams met so far."""

    def __init__(self) -> None:
        self.of = np.full(CODES**3, -1, np.int32)
        self.n = 0

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' numbers, and the new ids in the order of their numbers."""
        slots = self.of[ids]
        new = np.unique(ids[slots < 0])
        if len(new):
            self.of[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            slots = self.of[ids]
        return slots, new


class Bundler:
    """Adds up documents by language: counts by trigram first, vectors at the end of the task. All sums are integers, so they don't depend on partitions."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions, self.slots, self.grams, self.sums = dimensions, Slots(), [], {}

    def __call__(self, text: str, lang: str) -> Iterator[tuple]:
        parts = list(trigrams(text))
        n = sum(map(len, parts))
        if n:
            weight = max(1, (1 << 20) // n)  # documents weigh alike, whatever their length
            for ids in parts:
                slots, new = self.slots(ids)
                self.grams.append(new)
                count = np.bincount(slots, minlength=self.slots.n) * weight
                old = self.sums.get(lang)
                if old is not None:
                    count[: len(old)] += old
                self.sums[lang] = count
        return iter(())

    def last(self) -> Iterator[tuple]:
        if not self.sums:
            return
        grams = np.concatenate(self.grams)
        for lang, count in self.sums.items():
            total = np.zeros(self.dimensions, np.float64)  # exact: far below 2**53
            for start in range(0, len(count), 1024):
                total += count[start : start + 1024].astype(np.float64) @ gram_vectors(grams[start : min(start + 1024, len(count))], self.dimensions)
            yield from ((lang, i, int(x)) for i, x in enumerate(total))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Unit prototypes by language from columns text and lang: at most languages x dimensions numbers reach the driver."""
    need(docs, "text", "lang")
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = map_rows(rows, lambda: Bundler(dimensions), "lang string, i int, x bigint").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, i, x in sums.collect():
        found.setdefault(lang, np.zeros(dimensions))[i] = x
    return {k: (v / norm).tolist() for k, v in sorted(found.items()) if (norm := np.linalg.norm(v)) > 0}


class Comparer:
    def __init__(self, prototypes: dict[str, list[float]]) -> None:
        self.langs = list(prototypes)
        self.prototypes = np.array([prototypes[k] for k in self.langs]).reshape(len(self.langs), -1)
        self.slots = Slots()
        self.dots = np.zeros((1024, len(self.langs)))

    def dot(self, text: str) -> tuple[np.ndarray, float, int]:
        """The bundle's dot products with the prototypes, its length (taking n-gram vectors as orthogonal, as they nearly are by chance), and its number of n-grams."""
        total, counts = np.zeros(len(self.langs)), np.zeros(0, np.int64)
        for ids in trigrams(text):
            slots, new = self.slots(ids)
            if len(new):
                while self.slots.n > len(self.dots):
                    self.dots = np.concatenate([self.dots, np.zeros_like(self.dots)])
                for start in range(0, len(new), 1024):
                    part = new[start : start + 1024]
                    self.dots[self.slots.of[part]] = gram_vectors(part, self.prototypes.shape[1]) @ self.prototypes.T
            count = np.bincount(slots, minlength=self.slots.n)
            total += count @ self.dots[: self.slots.n]
            count[: len(counts)] += counts
            counts = count
        return total, float(np.sqrt((counts.astype(np.float64) ** 2).sum() * self.prototypes.shape[1])), int(counts.sum())

    def __call__(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, the best cosine, and the number of n-grams."""
        if not text or not self.langs:
            return UNKNOWN, 0.0, 0.0, 0
        dots, length, n = self.dot(text)
        if not n:  # no letter
            return UNKNOWN, 0.0, 0.0, 0
        best = int(np.argmax(np.round(dots, 6)))  # ties: the first by name
        positive = np.maximum(dots, 0)
        return self.langs[best], round(float(positive[best] / total), 6) if (total := positive.sum()) > 0 else 0.0, float(dots[best]) / length, n


def predict(docs: DataFrame, prototypes: dict[str, list[float]], *carry: str) -> DataFrame:
    """doc_id, the columns to carry, lang_pred and score (the best cosine's share in all positive ones) for each row."""
    need(docs, "doc_id", "text", *carry)
    kinds = dict(docs.dtypes)

    def make():
        compare = Comparer(prototypes)
        return lambda text, *rest: [(*rest, *compare(text)[:2])]

    names = ["doc_id", *carry]
    return map_rows(docs.select(F.col("text").cast("string"), *names), make, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all of them."""
    need(docs, "doc_id", "text", "lang")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", held_out(F.col("doc_id")))
    prototypes = learn(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(rows, prototypes, "held_out")


#: A document is rejected if it is und, or if it has so many n-grams and its best cosine is not so many standard deviations
#: (1 / sqrt(dimensions)) above what unrelated bundles have: its language or script is none of those learned. A few letters say too little.
LEAST_DEVIATIONS, LEAST_GRAMS = 3.0, 30


def keep_identified(docs: DataFrame, least: float = LEAST_DEVIATIONS) -> DataFrame:
    """The documents in a learned language, with the columns they came with: not und, and unless it is very short, like a prototype beyond chance."""
    prototypes = learn(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))

    def make():
        compare = Comparer(prototypes)

        def keep(text: str | None, *rest):
            lang, _, cosine, n = compare(text)
            if lang != UNKNOWN and (n < LEAST_GRAMS or cosine > least / compare.prototypes.shape[1] ** 0.5):
                yield (text, *rest)

        return keep

    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(["text string", *(f"`{n}` {t}" for n, t in docs.select(*rest).dtypes)])
    return map_rows(docs.select("text", *rest), make, schema).select(*docs.columns)
