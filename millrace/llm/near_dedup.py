"""MinHash near-dedup with DartMinHash signatures.

A text is the bag of its runs of WORDS words (lower case; a shorter text is one run): hashed elements, each weighted by
its count (weigh="one": by 1). Every element throws darts, a Poisson process over (weight, rank) that depends on its hash
alone, cut into dyadic regions; a dart counts if its weight lies below the element's. Each dart has a coordinate, and a
coordinate keeps its earliest dart. A text of weight n needs about t log t darts in all, not n * t hashes. Equal
coordinates have the probability of the weighted Jaccard similarity (sum of minima by sum of maxima). Runs of ROWS
coordinates are bands; texts that share a band meet in its bucket.

Pairs are verified with the whole bags, the k-th occurrence of an element standing for itself. Not every pair is made:

1. In each bucket one text leads, by chance, and the others are compared with it.
2. Only buckets with texts of several classes go on. An element that at most RARE of these texts have is rare, and texts of
   different classes that share a rare element are compared (RARE * (RARE - 1) / 2 pairs an element at most).
3. Two texts that share no rare element have at most min(common) elements in common, so most pairs can't reach the
   similarity. In each bucket the text with the fewest rare elements leads, and others that can reach it are compared.
4. Texts of a bucket that are still in different classes and could reach the similarity by their common elements and sizes
   are compared. Nothing else is left, so the classes are the connected components of all similar pairs that share a band.

Texts are known by 64 bits of their bag's hash, elements by 32 bits. Edge cases: texts without a word (null, empty) are
classes of their own; very long texts are taken whole (a signature's cost grows with the elements, its size doesn't);
rows that repeat get the same class; a null doc_id is the smallest; empty tables give empty results; further columns are
ignored, whatever their names, and representatives() hands them on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dropped, stored
from .common import Words, arrow_schema, filtered, mix, need, roll, tidy

U = np.uint64
LATE = np.iinfo(U).max
WORDS, LEAST = 5, 0.8
#: At similarity 0.8 a pair shares none of 32 bands of 6 once in 16,000; the leaders' links make that rarer.
BANDS, ROWS = 32, 6
WORD = re.compile(r"\w+")
#: Texts with so many elements, or so many texts, get their darts at once.
GATHERED, GATHERED_TEXTS = 100_000, 400
#: The first rank region ends here, and each further one is twice as far; regions by weight end at 1, 2, 4 and so on.
FIRST_RANK = 2.0**-7
#: Elements that so many of the remaining texts have, at most, are rare.
RARE = 4
#: Links that one task joins to classes; more are joined by rounds of joins.
ONE_TASK = 1 << 20
#: Texts' keys that a signing task keeps, to give equal ones their bands once.
KEYS = 1 << 18


def shingles(text: str | None, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all runs of WORDS words, and how often each occurs."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    ids = np.array(list(map(known.__getitem__, words)), U)
    return np.unique(mix(roll(mix(ids), min(WORDS, len(ids)))), return_counts=True)


@lru_cache(256)
def poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    k = np.arange(int(mean + 12 * mean**0.5) + 30)
    return np.cumsum(np.exp(k * np.log(mean) - mean - np.cumsum(np.log(np.maximum(k, 1)))))


def darts(elements: np.ndarray, weights: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element's number, rank and coordinate's random bits of all darts of the elements in one rank region."""
    start, width = (0.0, FIRST_RANK) if rank == 0 else (FIRST_RANK * 2.0 ** (rank - 1), FIRST_RANK * 2.0 ** (rank - 1))
    owners, ranks, bits = [], [], []
    low, high, region = 0.0, 1.0, 0
    top = float(weights.max(initial=0))
    while low < top:
        own = np.flatnonzero(weights > low) if low else np.arange(len(elements))
        with np.errstate(over="ignore"):
            seed = mix(elements[own] + U((rank * 64 + region + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        n = np.searchsorted(poisson_table(width * (high - low)), (seed >> U(11)).astype(np.float64) * 2.0**-53, "right")
        at = np.repeat(np.arange(len(own)), n)
        if len(at):
            nth = np.arange(len(at), dtype=U) - np.repeat(np.cumsum(n) - n, n).astype(U)
            with np.errstate(over="ignore"):
                h = mix(seed[at] + (nth + U(1)) * U(0xD1342543DE82EF95))
            owner = own[at]
            if high > 1.0 or float(weights.min()) < 1:
                place = low + (high - low) * (mix(h ^ U(0xA0761D6478BD642F)) >> U(11)).astype(np.float64) * 2.0**-53
                kept = place < weights[owner]
                h, owner = h[kept], owner[kept]
            owners.append(owner)
            ranks.append(start + width * ((h >> U(11)).astype(np.float64) + 1) * 2.0**-53)
            bits.append(h & U(0x7FF))
        low, high, region = high, high * 2, region + 1
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U)
    return np.concatenate(owners), np.concatenate(ranks), np.concatenate(bits)


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """A row for each text (sizes: its number of elements, 1 at least): the rank of the earliest dart of each coordinate, as a number that is as good as the dart's name."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    best, rank = np.full(len(sizes) * size, LATE, U), 0
    while len(owner):
        which, r, bits = darts(elements, weights, rank)
        rank += 1
        np.minimum.at(best, owner[which] * size + (bits % U(size)).astype(np.int64), r.view(U))  # positive floats sort as their bits
        left = (best.reshape(-1, size) == LATE).any(1)[owner]  # later regions can't give earlier darts
        elements, weights, owner = elements[left], weights[left], owner[left]
    return best.reshape(-1, size)


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    rows = mix(sig.reshape(-1, BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return mix(np.bitwise_xor.reduce(rows, axis=2) + np.arange(BANDS, dtype=U) * U(0xD1B54A32D192ED03)).view(np.int64)


def bag(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """32 bits of every occurrence of every element, sorted: equal for the k-th occurrences of one element."""
    again = np.repeat(elements, counts)
    nth = np.arange(len(again), dtype=U) - np.repeat(np.cumsum(counts) - counts, counts).astype(U)
    with np.errstate(over="ignore"):
        return np.unique(np.where(nth == 0, again, mix(again + nth * U(0x9E3779B97F4A7C15))) >> U(32)).astype(np.uint32)


def signed(docs: DataFrame, weigh: str = "count") -> DataFrame:
    """doc_id, th (hash of the text), key (of the bag), n, bands and bag of all documents; without a word key is null, and bands and bag are null where the task has met the key before."""
    kind = dict(docs.dtypes)["doc_id"]
    out = T._parse_datatype_string(f"doc_id {kind}, th bigint, key bigint, n int, bands array<bigint>, bag binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        known = Words()
        seen: set[int] = set()
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            new = [x for x in held if x[3] is not None]
            found: list = []
            if new:
                weights = np.concatenate([x[4] for x in new]).astype(np.float64)
                found = bands(signatures(np.concatenate([x[3] for x in new]), weights, np.array([len(x[3]) for x in new]))).tolist()
            of = iter(found)
            bags = [None if x[3] is None else bag(x[3], x[4]) for x in held]
            columns = [
                [x[0] for x in held],
                [x[1] for x in held],
                [x[2] for x in held],
                [None if b is None else len(b) for b in bags],
                [None if b is None else next(of) for b in bags],
                [None if b is None else b.tobytes() for b in bags],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema)], schema=schema)

        for b in batches:
            for start in range(0, b.num_rows, 256):
                for doc_id, th, text in zip(*(c.to_pylist() for c in b.slice(start, 256).columns)):
                    s, counts = shingles(text, known)
                    key = None
                    if weigh != "count":
                        counts = np.ones_like(counts)
                    if len(s):
                        key = int.from_bytes(hashlib.blake2b(s.tobytes() + counts.tobytes(), digest_size=8).digest(), "little", signed=True)
                    if key is None or key in seen:
                        held.append((doc_id, th, key, None, None))
                    else:
                        if len(seen) >= KEYS:
                            seen.clear()
                        seen.add(key)
                        held.append((doc_id, th, key, s, counts))
                        total += int(counts.sum())
                    if total >= GATHERED or len(held) >= GATHERED_TEXTS:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()
        held = known = None
        tidy()

    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string")).mapInArrow(run, out)


def buckets(table: DataFrame) -> DataFrame:
    """band, key, n and leader (a key) of the bands that several texts share."""
    rows = table.where("bands is not null").select("key", "n", F.explode("bands").alias("band"))
    # a text's chance to lead: its key under a mask by band, smallest first; the mask gives the leader's key back
    turned = lambda c: F.col(c).bitwiseXOR(F.xxhash64("band"))
    chances = rows.groupBy("band").agg(F.min(turned("key")).alias("low"), F.max(turned("key")).alias("high")).where("low != high")
    leaders = stored(chances.select("band", turned("low").alias("leader")), "near-leaders")
    found = stored(filtered(rows, "band", leaders.select("band")).join(leaders, "band"), "near-buckets")
    dropped(leaders)
    return found


def pairs_of(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def verified(pairs: DataFrame, bags: DataFrame, least: float, name: str) -> DataFrame:
    """a, b of the pairs (a, b: keys) whose bags have the similarity; a hot a's pairs are split by AQE, as both sides are shuffled for the join."""
    with_b = pairs.join(bags.select(F.col("key").alias("b"), F.col("bag").alias("sb"), F.col("n").alias("nb")), "b")
    both = with_b.join(bags.select(F.col("key").alias("a"), F.col("bag").alias("sa"), F.col("n").alias("na")), "a")
    both = both.where(F.least("na", "nb") >= least * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint32) for s in (sa, sb))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[i] = shared >= least * (len(x) + len(y) - shared) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return stored(both.mapInArrow(run, "a bigint, b bigint"), name)


def joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and class of the links that one task holds, ONE_TASK of them at most."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if parts:
        nodes, ends = np.unique(np.concatenate(parts, axis=1).ravel(), return_inverse=True)
        u, v = ends.reshape(2, -1)
        label, old = np.arange(len(nodes)), None
        while old is None or (label != old).any():
            old = label.copy()
            low = np.minimum(label[u], label[v])
            for at in (u, v, label[u], label[v]):
                np.minimum.at(label, at, low)
            label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["key", "class"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """key and class (its component's smallest key) of all keys of links (a, b).

    Few links are joined in a task of bounded size. More take rounds: smallest neighbour's label, then the label's own label, until nothing changes.
    """
    if links.count() <= one_task:
        return stored(links.repartition(1).mapInArrow(joined_in_task, "key bigint, class bigint"), "near-labels")
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "near-edges")
    labels = stored(both.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("m")).select("key", F.least("key", "m").alias("class")), "near-labels")
    while True:
        offered = both.join(labels.select(F.col("key").alias("v"), "class"), "v").groupBy(F.col("u").alias("key")).agg(F.min("class").alias("offer"))
        nearer = stored(labels.join(offered, "key").select("key", F.least("class", "offer").alias("near"), F.col("class").alias("old")), "near-nearer")
        jumped = nearer.join(nearer.select(F.col("key").alias("near"), F.col("near").alias("far")), "near", "left").select("key", F.least("near", F.coalesce("far", "near")).alias("class"), "old")
        done, labels = labels, stored(jumped, "near-labels")
        dropped(done, nearer)
        if labels.where("class != old").isEmpty():
            dropped(both)
            return labels.select("key", "class")


def unlike(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (band, key, ..) of the bands whose texts are in several classes, with their class."""
    known = rows.drop("class").join(labels, "key", "left").withColumn("class", F.coalesce("class", "key"))
    mixed = known.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("band")
    return stored(known.join(mixed, "band"), "near-left")


def rarities(texts: DataFrame, least: float) -> DataFrame:
    """Of texts (key, class, n, bag): rows a, b of pairs in different classes that share a rare element, and rows a, null, k of texts with k rare elements."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                b = whole.slice(start, 1_000)
                bags = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column("bag")]
                e = np.concatenate(bags).view(np.int32)
                owner = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
                order = np.argsort(e, kind="stable")
                e, owner = e[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
                nth = np.arange(len(e)) - np.repeat(first, np.diff(np.append(first, len(e))))
                keep = nth <= RARE  # one more than a rare element has says enough
                e, owner = e[keep], owner[keep]
                yield pa.RecordBatch.from_arrays([pa.array(e), *(pa.array(b.column(c).to_numpy()[owner]) for c in ("key", "class", "n"))], ["e", "key", "class", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = [c.to_numpy() for c in b.columns]
            if rest is not None:
                t = [np.concatenate(x) for x in zip(rest, t)]
            cut = int(np.searchsorted(t[0], t[0][-1]))  # the last element may go on
            if len(t[0]) - cut > RARE + 1:  # and is common already
                rest = [x[cut : cut + RARE + 1] for x in t]
            else:
                rest = [x[cut:] for x in t]
            if cut:
                yield groups([x[:cut] for x in t])
        if rest is not None:
            yield groups(rest)

    def groups(t: list[np.ndarray]) -> pa.RecordBatch:
        e, key, of, n = t
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        size = np.repeat(np.diff(np.append(first, len(e))), np.diff(np.append(first, len(e))))
        rare = size <= RARE
        keys, k = np.unique(key[rare], return_counts=True)
        e, key, of, n = (x[rare] for x in t)
        found = []
        for step in range(1, RARE):
            same = np.flatnonzero(e[step:] == e[:-step])
            x, y = same, same + step
            possible = (of[x] != of[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]))
            found.append(np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], axis=1)[possible])
        pairs = np.unique(np.concatenate(found), axis=0)
        none = np.zeros(len(pairs), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys, pairs[:, 0]])), pa.array(np.concatenate([keys, pairs[:, 1]]), mask=np.concatenate([np.ones(len(keys), bool), none.astype(bool)])), pa.array(np.concatenate([k, none]))], ["a", "b", "k"]
        )

    elements = texts.select("key", "class", "n", "bag").mapInArrow(spread, "e int, key bigint, class bigint, n int")
    return stored(elements.repartition("e").sortWithinPartitions("e", "key").mapInArrow(meet, "a bigint, b bigint, k bigint"), "near-rare")


def classes_of(found: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """key and class of all texts of the buckets that are linked to others."""
    asked = found.select("key").distinct()
    bags = stored(filtered(table.where("bag is not null").select("key", "n", "bag"), "key", asked).groupBy("key").agg(F.first("n").alias("n"), F.first("bag").alias("bag")), "near-bags")
    followers = found.where("key != leader")
    links = verified(pairs_of(followers, "leader", "key"), bags, least, "near-links")
    labels = components(links)
    left = unlike(followers.select("band", "key", "n"), labels)
    if left.isEmpty():
        return labels
    fewer = stored(filtered(bags, "key", left.select("key")).join(left.select("key", "class").distinct(), "key"), "near-bags")
    dropped(bags)
    facts = rarities(fewer, least)
    rare = facts.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("k").alias("k"))
    left = left.join(rare, "key", "left").select("band", "key", "class", "n", (F.col("n") - F.coalesce("k", F.lit(0))).alias("common"))
    # without a shared rare element: shared <= min(common), and shared >= least / (1 + least) * (sum of the sizes) is due
    possible = (F.col("class") != F.col("class2")) & (F.least("common", "common2") >= least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-9)
    second = lambda df: df.select("band", *(F.col(c).alias(c + "2") for c in ("key", "class", "n", "common")))
    central = left.groupBy("band").agg(F.max(F.struct((F.col("common") / F.col("n")).alias("share"), "key", "class", "n", "common")).alias("x")).select("band", "x.key", "x.class", "x.n", "x.common")
    central = stored(central, "near-central")
    met = left.join(second(central), "band").where(possible)
    asked = pairs_of(met, "key", "key2").unionByName(facts.where("b is not null").select("a", "b")).distinct()
    more = verified(stored(asked, "near-asked"), fewer, least, "near-links")
    stars = labels.where("key != class").select(F.col("class").alias("a"), F.col("key").alias("b"))
    labels = components(stored(stars.unionByName(more), "near-links"))
    left = unlike(left.join(central.select("band", "key"), ["band", "key"], "left_anti"), labels)
    if left.isEmpty():
        return labels
    met = left.join(second(left), "band").where(possible & (F.col("key") < F.col("key2")))
    more = verified(pairs_of(met, "key", "key2"), fewer, least, "near-links")
    stars = labels.where("key != class").select(F.col("class").alias("a"), F.col("key").alias("b"))
    return components(stored(stars.unionByName(more), "near-links"))


def classes(docs: DataFrame, least: float = LEAST, weigh: str = "count") -> DataFrame:
    """doc_id, th (hash of the text), class_id (the smallest doc_id of the class), class_th and n_copies (documents of equal bags) for each row."""
    need(docs, "doc_id", "text")
    table = stored(signed(docs.select("doc_id", "text"), weigh), "near-signed")
    found = buckets(table)
    labels = classes_of(found, table, least)
    dropped(found)
    own = F.struct("doc_id", "th")
    groups = stored(table.where("key is not null").groupBy("key").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n_copies")), "near-groups")
    linked = stored(labels.join(groups, "key").select("key", "class", "first"), "near-linked")
    named = linked.join(linked.groupBy("class").agg(F.min("first").alias("of")), "class").select("key", "of")
    named = stored(groups.join(named, "key", "left").select("key", F.coalesce("of", "first").alias("of"), "n_copies"), "near-named")
    of = F.when(F.col("of").isNull(), own).otherwise(F.col("of"))
    rows = table.select("doc_id", "th", "key").join(named, "key", "left").withColumn("of", of)
    return rows.select("doc_id", "th", F.col("of.doc_id").alias("class_id"), F.col("of.th").alias("class_th"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def representatives(docs: DataFrame, least: float = LEAST, weigh: str = "count") -> DataFrame:
    """The smallest document of each class, with the columns it came with; of rows with its doc_id and text the one whose other columns are smallest as JSON."""
    found = classes(docs, least, weigh).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    kept = stored(found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("__rows")).select(F.struct("doc_id", "th").alias("__node"), "__rows"), "near-kept")
    marked = docs.withColumn("__node", F.struct("doc_id", F.xxhash64("text").alias("th"))).join(kept, "__node")
    if kept.where("__rows > 1").isEmpty():
        return marked.select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("__node").orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0))
    repeated = marked.where("__rows > 1").withColumn("__i", F.row_number().over(order)).where("__i = 1")
    return marked.where("__rows = 1").select(*docs.columns).unionByName(repeated.select(*docs.columns))
