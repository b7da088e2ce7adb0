"""Benchmark decontamination by greedy string tiling.

Words (lower case) of test items and documents are compared. Every run of SEED words that a document shares with an item
is a seed. Seeds are joined by hash: documents first drop the runs whose bit isn't in a table of the benchmark's seeds (of
fixed size, whatever the benchmark's), the rest meet the seeds in a join. A text and an item with seeds enough to reach the
coverage come together with their texts, and greedy string tiling marks longest common runs first: Karp-Rabin hashes of all
unmarked windows of one length find the longest match, which is marked in both texts so that no word counts twice; then
again, down to SEED words. The share of the item's words under tiles is its coverage; passages in another order count as
much as passages in place. From ``least`` coverage on, the document is contaminated by the item.

What is shuffled grows with the matches: seeds that are shared, and texts that may be contaminated, each once however many
copies it has (texts are known by 64 bits of hash).

Edge cases: items of fewer than SEED words, and null texts, match nothing; an empty benchmark or table gives no matches;
very long texts are taken whole; of equally long runs the first in the item, then in the text, is marked; repeated rows are
judged one by one, alike; items that occur twice are reported twice; further columns, whatever their names, are ignored by
``contaminated`` and handed on by ``clean``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import U, Words, bit_table, filtered, map_rows, maybe_in, mix, need, roll

SEED, LEAST = 5, 0.8
#: Bits of the table of seeds, as a power of two.
BITS = 24
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64, of mixed ids) of all windows of n ids, by doubling."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return roll(x, n)


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item place, document place, length), longest first. Ids under 0 match nothing."""
    free_i, free_d = item >= 0, doc >= 0
    tiles: list[tuple[int, int, int]] = []

    def windows(ids: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        blocked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(blocked[n:] == blocked[:-n])
        return window_hashes(ids, n)[at], at

    def common(n: int) -> bool:
        return len(np.intersect1d(windows(item, free_i, n)[0], windows(doc, free_d, n)[0])) > 0

    high = min(len(item), len(doc))
    while high >= least:
        low = least  # the longest common run: windows of every length below it are common too
        if not common(low):
            break
        top = high
        while low < top:
            middle = (low + top + 1) // 2
            low, top = (middle, top) if common(middle) else (low, middle - 1)
        hi, ai = windows(item, free_i, low)
        hd, ad = windows(doc, free_d, low)
        keep = np.isin(hd, hi)
        by_hash: dict[int, list[int]] = {}
        for h, p in zip(hd[keep].tolist(), ad[keep].tolist()):
            by_hash.setdefault(h, []).append(p)
        for queue in by_hash.values():
            queue.reverse()
        for h, p in zip(hi.tolist(), ai.tolist()):
            queue = by_hash.get(h)
            while queue and free_i[p : p + low].all():
                q = queue.pop()
                if free_d[q : q + low].all() and np.array_equal(item[p : p + low], doc[q : q + low]):
                    tiles.append((p, q, low))
                    free_i[p : p + low] = False
                    free_d[q : q + low] = False
        high = low - 1 if not common(low) else low
    return tiles


def seeds(text: list[str], known: Words) -> np.ndarray:
    """Hash of every run of SEED words, in order."""
    return mix(roll(mix(np.array(list(map(known.__getitem__, text)), U)), SEED)) if len(text) >= SEED else np.zeros(0, U)


def coverage(item: list[str], doc: list[str], known: Words, least: float) -> tuple[float, int] | None:
    """The share of the item's words under tiles, and the number of tiles; None if it is under least."""
    hi, hd = seeds(item, known), seeds(doc, known)
    at = np.flatnonzero(np.isin(hd, hi))
    if not len(at) or _covered(np.flatnonzero(np.isin(hi, hd)), len(item)).sum() < least * len(item):  # no tiling can cover more than the seeds do
        return None
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in item])
    inside = _covered(at, len(doc))
    edge = inside | np.concatenate([[False], inside[:-1]])  # one stop between runs
    there = np.array([number.get(w, -1) for w in doc])
    tiles = tile(ids, np.where(inside, there, -1)[edge])
    share = sum(n for *_, n in tiles) / len(item)
    return (share, len(tiles)) if share >= least else None


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in the runs of SEED words that begin at these places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + SEED, -1)
    return np.cumsum(change)[:-1] > 0


def seed_rows(benchmark: DataFrame) -> DataFrame:
    """item (hash of its text), n (its words) and seed, a row for each run of SEED words."""

    def make():
        known = Words()

        def rows(item, text):
            w = words(text)
            for h in seeds(w, known).view(np.int64).tolist():
                yield (item, len(w), h)

        return rows

    return map_rows(benchmark.select("item", "text").distinct(), make, "item bigint, n int, seed bigint")


def hits(docs: DataFrame, of: DataFrame) -> DataFrame:
    """th and seed of the texts' runs that may be seeds (of: seed_rows), each once a text."""
    place = F.col("seed").bitwiseAND((1 << BITS) - 1)
    table = of.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("m")).collect()
    bits = np.zeros(1 << (BITS - 6), np.int64)  # 2 ** BITS bits at most, whatever the benchmark
    if table:
        bits[[r[0] for r in table]] = [r[1] for r in table]
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        known, have = Words(), sent.value.view(U)

        def rows(th, text):
            h = seeds(words(text), known)
            p = h & U((1 << BITS) - 1)
            for x in np.unique(h[(have[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1]).view(np.int64).tolist():
                yield (th, x)

        return rows

    return map_rows(docs.select("th", "text"), make, "th bigint, seed bigint")


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """th (xxhash64 of the text) and items (an array of item_id, coverage, tiles) of the contaminated texts."""
    need(docs, "doc_id", "text")
    need(benchmark, "item_id", "text")
    text = F.col("text").cast("string")
    items = stored(benchmark.select("item_id", text.alias("text")).where("text is not null").withColumn("item", F.xxhash64("text")), "bench-items")
    texts = docs.select(F.xxhash64("text").alias("th"), text.alias("text")).where("text is not null")
    of = stored(seed_rows(items), "bench-seeds")
    shared = hits(texts, of).join(of, "seed").groupBy("th", "item").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    # a run of SEED words covers SEED words at most
    pairs = stored(shared.where(F.col("k") * SEED >= least * F.col("n")).select("th", "item"), "bench-pairs")
    whole = filtered(texts, "th", pairs.select("th")).groupBy("th").agg(F.first("text").alias("text"))
    both = pairs.join(items.groupBy("item").agg(F.first("text").alias("of")), "item").join(whole, "th")

    def make():
        known = Words()

        def rows(th, item, of, text):
            found = coverage(words(of), words(text), known, least)
            if found:
                yield (th, item, round(found[0], 6), found[1])

        return rows

    tiled = map_rows(both.select("th", "item", "of", "text"), make, "th bigint, item bigint, coverage double, tiles int")
    named = tiled.join(items.select("item", "item_id"), "item").groupBy("th").agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage", "tiles"))).alias("items"))
    return stored(named, "bench-matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, contaminated, n_items, items (their ids) and the largest coverage of each document."""
    found = matches(docs, benchmark, least)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th")).join(found, "th", "left")
    return rows.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.transform("items", lambda x: x["item_id"]), F.array().cast(f"array<{dict(benchmark.dtypes)['item_id']}>")).alias("items"),
        F.coalesce(F.array_max(F.transform("items", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that no item contaminates, with the columns they came with. Those that surely aren't among the matches aren't shuffled."""
    found = matches(docs, benchmark, least).select(F.col("th").alias("__th"))
    known = maybe_in(docs.withColumn("__th", F.xxhash64("text")), "__th", bit_table(found))
    kept = known.where("__maybe").join(found, "__th", "left_anti").select(*docs.columns)
    return known.where("not __maybe").select(*docs.columns).unionByName(kept)
