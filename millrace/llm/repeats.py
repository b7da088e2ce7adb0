"""Suffix-array dedup with a run-length index: bytes under a WINDOW-byte string that starts earlier anywhere go.

1. Every window of WINDOW bytes has a minimizer: the leftmost smallest hash of its runs of k bytes. Consecutive windows
   with the same one form a piece. Equal windows have equal minimizers, so only pieces of one minimizer can share any.
   Pieces that are equal as a whole (two 64-bit hashes) are settled by hash: all but the earliest are repeated. Tasks
   do so for each chunk they read first, so a hot piece leaves a chunk once.
2. What remains are pieces that share a minimizer but differ, the ends of repeats. Their texts are fetched and come
   together by minimizer. Groups of more than GROUP pieces are cut again with longer runs (LEVELS; at the last a run is a
   whole window), so no group is larger than that in a task.
3. Blocks of such groups get a run-compressed Burrows-Wheeler transform with suffix-array samples at the run ends. Every
   piece streams backwards through it, all in step: at each place the row interval of the longest match, cut at WINDOW
   bytes (matching statistics). An interval of several rows is a repeated window, and its earliest place stays.

Texts are UTF-8 bytes. Order is by doc_id, then by place. Edge cases: null texts are empty; texts under WINDOW bytes lose
nothing; a null doc_id comes first; rows with one doc_id are documents in the order of their texts' hashes, so of
repeated rows the first keeps its bytes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, stored
from .common import bit_table, filtered, maybe_in, mix, need

WINDOW = 100
#: Lengths of the hashed runs: minimizers of each refinement.
LEVELS = (32, 64, 84, WINDOW)
GROUP = 2_500
#: Bytes that a task hashes at once, and those from which on it indexes the groups it holds. A piece has up to
#: 2 * WINDOW - LEVELS[0] bytes and an end sign, so a block stays under 2 ** SORT_BITS.
CHUNK, BLOCK, SORT_BITS = 1 << 21, 600_000, 20
PLACE = 22  # bits of a place within a chunk
#: The row number among rows of one doc_id stands above the place in a document.
ROW = 44
FIRST_ID = -(1 << 63)

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE ** i, its inverse, and a random number by byte."""
    n = 2 * CHUNK + 1
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        x = np.full(n, base, U)
        x[0] = 1
        out.append(np.cumprod(x, dtype=U))
    return out[0], out[1], mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


class Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        self.up, self.down, table = powers()
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum(table[raw] * self.up[: len(raw)], dtype=U, out=self.sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """Of all runs of k bytes."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    if w == 1 or len(x) < w:
        return x if w == 1 else x[:0]
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(U).max, U)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def pieces(raw: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(start, windows, minimizer's hash, whole hash) of all pieces of the texts that lie one after another in raw."""
    none = np.zeros(0, np.int64)
    if len(raw) < WINDOW:
        return none, none, none, none
    h = Hashes(raw)
    runs = h.runs(k)
    at = np.arange(len(runs), dtype=U)
    low = sliding_min((runs >> U(PLACE)) << U(PLACE) | at, WINDOW - k + 1)
    place = (low & U((1 << PLACE) - 1)).astype(np.int64)
    # windows within one text
    cover = np.zeros(len(place) + 1, np.int32)
    a, b = np.maximum(ends - WINDOW + 1, 0), np.minimum(ends, len(place))
    inside = a < b
    np.add.at(cover, a[inside], 1)
    np.add.at(cover, b[inside], -1)
    valid = np.cumsum(cover)[:-1] == 0
    change = np.ones(len(place) + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    cut = np.flatnonzero(change)
    start, n = cut[:-1], np.diff(cut)
    keep = valid[start]
    start, n = start[keep], n[keep]
    return start, n, runs[place[start]].view(np.int64), h.of(start, start + n + WINDOW - 1).view(np.int64)


ROWS = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("d", pa.int64()), ("p", pa.int64()), ("n", pa.int16()), ("mark", pa.bool_())])
ROWS_SQL = "h bigint, g bigint, d bigint, p bigint, n smallint, mark boolean"
MARKS_SQL = "d bigint, p bigint, n int"


def batch(h, g, d, p, n, mark) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(d), pa.array(p), pa.array(n.astype(np.int16)), pa.array(mark)], schema=ROWS)


def settle(h: np.ndarray, g: np.ndarray, d: np.ndarray, p: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Marks what repeats among these, so that every (h, g) goes on once. Marks get their document's hash as key."""
    order = np.lexsort((p, d, g, h))
    h, g, d, p, n = h[order], g[order], d[order], p[order], n[order]
    mark = np.zeros(len(h), bool)
    mark[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    h = np.where(mark, mix(d.view(U)).view(np.int64), h)
    return batch(h, np.where(mark, 0, g), d, p, n, mark)


def cut(docs: DataFrame) -> DataFrame:
    """Pieces of docs (d, row, text) at the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
            ends = np.cumsum([len(x[2]) for x in held])
            start, n, h, g = pieces(raw, ends, LEVELS[0])
            owner = np.searchsorted(ends, start, "right")
            begin = np.concatenate([[0], ends[:-1]])
            d, first = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            return settle(h, g, d[owner], start - begin[owner] + first[owner], n)

        for b in batches:
            ids, rows, texts = b.column(0), b.column(1), b.column(2)
            for i in range(b.num_rows):
                d, row, text = ids[i].as_py(), rows[i].as_py(), texts[i]
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < WINDOW:
                    continue
                for at in range(0, max(1, len(raw) - WINDOW + 1), CHUNK):  # of a long text parts that share WINDOW - 1 bytes
                    part = raw[at : at + CHUNK + WINDOW - 1]
                    if held and size + len(part) > CHUNK:
                        yield flush()
                        held, size = [], 0
                    held.append((d, (row << ROW) + at, part))
                    size += len(part)
        if held:
            yield flush()

    return docs.select("d", "row", "text").mapInArrow(run, ROWS_SQL)


def meet(rows: DataFrame) -> DataFrame:
    """Pieces by minimizer, in order: marks of whole repeats, and as other rows the first pieces of minimizers that have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the last first piece, and whether it has been sent
        sent = True
        previous = None  # (h, g) of the last row
        for b in batches:
            h, g, d, p, n, mark = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            done = batch(h[mark], g[mark], d[mark], p[mark], n[mark], mark[mark])
            if done.num_rows:
                yield done
            h, g, d, p, n = h[~mark], g[~mark], d[~mark], p[~mark], n[~mark]
            if not len(h):
                continue
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            again[0] = previous == (h[0], g[0])
            previous = (h[-1], g[-1])
            if again.any():
                yield batch(h[again], np.zeros(int(again.sum()), np.int64), d[again], p[again], n[again], again[again])
            h, g, d, p, n = h[~again], g[~again], d[~again], p[~again], n[~again]
            if not len(h):
                continue
            if last is not None and last[0] == h[0] and not sent:
                yield batch(*(np.array([x]) for x in last), np.array([False]))
            several = np.zeros(len(h), bool)
            several[1:] = h[1:] == h[:-1]
            with_next = np.zeros(len(h), bool)
            with_next[:-1] = several[1:]
            several[0] = last is not None and last[0] == h[0]
            several |= with_next
            last, sent = (h[-1], g[-1], d[-1], p[-1], n[-1]), bool(several[-1])
            if several.any():
                yield batch(h[several], g[several], d[several], p[several], n[several], np.zeros(int(several.sum()), bool))

    return rows.repartition("h").sortWithinPartitions("h", "mark", "g", "d", "p").mapInArrow(run, ROWS_SQL)


def fetched(pieces_: DataFrame, docs: DataFrame) -> DataFrame:
    """h, d, p, hot and the bytes (s) of pieces (h, d, p, n, hot)."""
    by_doc = pieces_.withColumn("row", F.shiftright("p", ROW)).groupBy("d", "row").agg(F.collect_list(F.struct("h", "p", "n", "hot")).alias("of"))
    joined = filtered(docs, "d", pieces_.select("d")).join(by_doc, ["d", "row"]).select("d", "text", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, ids = b.column("of"), b.column("d")
            offsets, values = of.offsets.to_numpy(), of.values
            h, p, n, hot = (values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            place = p & ((1 << ROW) - 1)
            until = place + n.astype(np.int64) + WINDOW - 1
            for i in range(b.num_rows):
                text, lo, hi = b.column("text")[i].as_buffer().to_pybytes(), offsets[i], offsets[i + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[lo:hi]), pa.array(np.full(hi - lo, ids[i].as_py())), pa.array(p[lo:hi]), pa.array(hot[lo:hi]), pa.array([text[x:y] for x, y in zip(place[lo:hi].tolist(), until[lo:hi].tolist())], pa.binary())],
                    ["h", "d", "p", "hot", "s"],
                )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined.mapInArrow(gathered, "h bigint, d bigint, p bigint, hot boolean, s binary")


def cut_again(texts: DataFrame, level: int) -> DataFrame:
    """Pieces of pieces (d, p, s) by the minimizers of a further level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 5_000):
                part = b.slice(start, 5_000)
                texts_ = part.column("s").to_pylist()
                d, p = part.column("d").to_numpy(), part.column("p").to_numpy()
                ends = np.cumsum([len(x) for x in texts_])
                at, n, h, g = pieces(np.frombuffer(b"".join(texts_), np.uint8), ends, LEVELS[level])
                owner = np.searchsorted(ends, at, "right")
                begin = np.concatenate([[0], ends[:-1]])
                yield settle(h, g, d[owner], at - begin[owner] + p[owner], n)

    return texts.select("d", "p", "s").mapInArrow(run, ROWS_SQL)


def dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of keys (under 2 ** (64 - SORT_BITS)), equal ones alike, and the places in order of key and place."""
    packed = key.astype(U) << U(SORT_BITS) | np.arange(len(key), dtype=U)
    packed.sort()
    at = (packed & U((1 << SORT_BITS) - 1)).astype(np.int64)
    packed >>= U(SORT_BITS)
    rank = np.zeros(len(key), np.int64)
    np.cumsum(packed[1:] != packed[:-1], out=rank[1:])
    out = np.empty_like(rank)
    out[at] = rank
    return out, at


class Index:
    """Run-compressed Burrows-Wheeler transform of texts (each with an end sign), with samples at run ends."""

    def __init__(self, texts: list[bytes]) -> None:
        lengths = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(lengths + 1) - 1  # of the end signs
        t = np.zeros(int(self.ends[-1]) + 1, np.int64)
        body = np.ones(len(t), bool)
        body[self.ends] = False
        t[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.t, n = t, len(t)
        where = np.arange(n)
        self.left = self.ends[np.searchsorted(self.ends, where)] - where  # characters up to the end sign
        if n >= 1 << SORT_BITS:
            raise ValueError(f"{n} bytes are too many for one block")
        (ranks, self.sa), length = dense(self._packed()), 4
        self.at = {}
        longest = int(lengths.max()) + 1
        while True:
            self.at[length] = ranks
            if length >= longest and length >= 64:
                break
            further = np.zeros(n, np.int64)
            further[: n - length] = ranks[length:] + 1
            further[self.left < length] = 0  # nothing behind the end sign counts
            ranks, self.sa = dense(ranks * (n + 1) + further)
            length *= 2
        bwt = t[self.sa - 1]
        bwt[self.sa == 0] = 0
        edge = np.flatnonzero(np.diff(bwt)) + 1
        starts = np.concatenate([[0], edge])
        lengths_ = np.diff(np.concatenate([starts, [n]]))
        self.samples = self.sa[starts + lengths_ - 1]  # where the text of each run's last row begins
        order = np.lexsort((starts, bwt[starts]))
        self.run_of = order
        self.run_char, self.run_start, self.run_length = bwt[starts][order], starts[order], lengths_[order]
        before = np.cumsum(self.run_length) - self.run_length  # rows of smaller characters and of earlier runs: C[c] and the rank in one
        self.before = before
        self.keys = self.run_char * (n + 1) + self.run_start
        self.n = n

    def _packed(self) -> np.ndarray:
        t, out = self.t, np.zeros(len(self.t), np.int64)
        for i in range(4):
            c = np.zeros(len(t), np.int64)
            c[: len(t) - i] = t[i:]
            c[self.left < i] = 0
            out = out * 257 + c
        return out

    def step(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before c + (the suffixes before row): LF for interval ends, by runs."""
        i = np.searchsorted(self.keys, c * (self.n + 1) + row, "right") - 1
        i = np.maximum(i, 0)
        same = self.run_char[i] == c
        inside = np.minimum(row - self.run_start[i], self.run_length[i])
        following = self.before[np.minimum(i + 1, len(self.before) - 1)]
        first = self.before[np.searchsorted(self.run_char, c)]
        return np.where(same, self.before[i] + inside, np.where(self.run_char[np.minimum(i + 1, len(self.before) - 1)] == c, following, first))

    def same(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the first and the end of the rows that agree with it in so many characters."""
        a = self.at[64][self.sa]
        shifted = np.minimum(self.sa + length - 64, self.n - 1)
        b = self.at[64][shifted]
        short = self.left[self.sa] < length
        edge = np.ones(self.n + 1, bool)
        edge[1:-1] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | short[1:] | short[:-1]
        cuts = np.flatnonzero(edge)
        group = np.cumsum(edge[:-1]) - 1
        return cuts[:-1][group], cuts[1:][group]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place the row interval of the match of WINDOW characters that begins there (start and end; -1 if the text ends sooner)."""
        low, high = np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        first, end = self.same(WINDOW - 1)
        begins = np.concatenate([[0], self.ends[:-1] + 1])
        live = np.arange(len(self.ends))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        length = 0  # of the match, the same for all
        place = self.ends.copy()
        while True:
            place = place - 1
            still = place >= begins[live]
            if not still.all():
                live, lo, hi, place = live[still], lo[still], hi[still], place[still]
            if not len(live):
                return low, high
            if length == WINDOW:  # the last character goes: the rows that agree in one less
                lo, hi = first[lo], end[lo]
                length -= 1
            c = self.t[place]
            lo, hi = self.step(c, lo), self.step(c, hi)
            length += 1
            if length == WINDOW:
                low[place], high[place] = lo, hi


def repeated(texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(text, place, windows) of the runs of windows that also begin earlier in these texts."""
    index = Index(texts)
    low, high = index.statistics()
    at = np.flatnonzero(high - low > 1)
    if not len(at):
        return
    earliest = np.full(index.n, index.n, np.int64)
    np.minimum.at(earliest, low[at], at)
    gone = np.zeros(index.n + 1, bool)
    gone[at] = earliest[low[at]] != at
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
    begins = np.concatenate([[0], index.ends[:-1] + 1])
    for a, b in edges.reshape(-1, 2).tolist():
        i = int(np.searchsorted(index.ends, a))
        yield i, a - int(begins[i]), b - a


def indexed(texts: DataFrame) -> DataFrame:
    """Marks (d, p, n) within groups of pieces by minimizer: whole groups, BLOCK bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = [(held[i][0], held[i][1] + at, n) for i, at, n in repeated([x[2] for x in held])]
            columns = list(zip(*found)) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["d", "p", "n"])

        for b in batches:
            for h, d, p, s in zip(*(b.column(c).to_pylist() for c in ("h", "d", "p", "s"))):
                if h != last and size >= BLOCK:
                    yield flush()
                    held, size = [], 0
                held.append((d, p, s))
                size += len(s)
                last = h
        if held:
            yield flush()

    return texts.select("h", "d", "p", "s").repartition("h").sortWithinPartitions("h", "d", "p").mapInArrow(run, MARKS_SQL)


def numbered(docs: DataFrame) -> DataFrame:
    """d (doc_id, or FIRST_ID), row (0, 1, .. among rows of one doc_id) and text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if rows.groupBy("d").count().where("count > 1").isEmpty():
        return rows.select("d", F.lit(0).cast("bigint").alias("row"), "text")
    order = Window.partitionBy("d").orderBy(F.xxhash64("text"))
    return stored(rows.select("d", (F.row_number().over(order) - 1).cast("bigint").alias("row"), "text"), "repeats-docs")


def marks(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """d, row and of (a list of p: place, n) of the rows with windows that begin earlier elsewhere. docs: as numbered() gives them."""
    found, mets, texts, rows = [], [], None, cut(docs)
    for level in range(len(LEVELS)):
        met = stored(meet(rows), "repeats-met")
        mets.append(met)
        if texts is not None:
            dropped(texts)
        found.append(met.where("mark").select("d", "p", F.col("n").cast("int").alias("n")))
        several = met.where(~F.col("mark")).select("h", "d", "p", "n")
        counts = several.groupBy("h").count()
        hot = stored(counts.where(F.col("count") > group).select("h", F.lit(True).alias("hot")), "repeats-hot")
        marked = several.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        texts = fetched(marked, docs)
        if hot.isEmpty():
            found.append(indexed(texts))
            break
        texts = stored(texts, "repeats-texts")
        found.append(stored(indexed(texts.where(~F.col("hot"))), "repeats-marks"))
        rows = cut_again(texts.where("hot"), level + 1)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    place = F.col("p").bitwiseAND((1 << ROW) - 1)
    by_doc = out.groupBy("d", F.shiftright("p", ROW).alias("row")).agg(F.collect_list(F.struct(place.alias("p"), "n")).alias("of"))
    by_doc = stored(by_doc, "repeats-by-doc")
    dropped(*mets)
    return by_doc


def removed(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """For each row d, text, and of (its marks). Only texts that may have marks are shuffled."""
    base = numbered(docs)
    by_doc = marks(base, group)
    known = maybe_in(base, "d", bit_table(by_doc.select("d")))
    with_marks = known.where("__maybe").join(by_doc, ["d", "row"], "left").select("d", "text", "of")
    return with_marks.unionByName(known.where("not __maybe").select("d", "text", F.lit(None).cast(dict(by_doc.dtypes)["of"]).alias("of")))


def merged(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the byte ranges under runs of n windows."""
    order = np.argsort(place, kind="stable")
    a, b = place[order], (place + n)[order] + WINDOW - 1
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    cut_ = np.flatnonzero(new)
    return a[cut_], reach[np.concatenate([cut_[1:], [len(a)]]) - 1]


def dedup(docs: DataFrame, group: int = GROUP, content: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if content is asked for spans (array of start and end, in bytes) and kept (the bytes that stay)."""
    need(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                out: list[tuple] = []
                for d, text, of in zip(part.column("d").to_pylist(), part.column("text"), part.column("of")):
                    raw = text.as_buffer().to_pybytes()
                    spans: list[tuple[int, int]] = []
                    kept = raw
                    if of.is_valid:
                        a, z = merged(of.values.field(0).to_numpy(), of.values.field(1).to_numpy(zero_copy_only=False).astype(np.int64))
                        spans = list(zip(a.tolist(), z.tolist()))
                        at, left = 0, []
                        for x, y in spans:
                            left.append(raw[at:x])
                            at = y
                        kept = b"".join([*left, raw[at:]])
                    out.append((None if d == FIRST_ID else d, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans], kept))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    names, types = (list(x) for x in zip(*(REPORT + CONTENT * content)))
    return removed(docs, group).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<start:bigint,end:bigint>>, kept binary" * content)


REPORT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
CONTENT = [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
