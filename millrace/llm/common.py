"""Shared by the operators: column checks, Arrow row loops, hashing of words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows gathered before an output batch is sent on; a batch also goes at BATCH_BYTES.
BATCH_ROWS, BATCH_BYTES = 5_000, 16 << 20


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """mapInArrow by rows. make() runs once a task and returns f(*columns) -> output rows; f.last, if there, yields rows at the end."""
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(out)
        f = make()
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in kind]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=k.type) for c, k in zip(columns, kind)], schema=kind)

        for b in batches:
            for start in range(0, b.num_rows, 256):  # few rows as Python objects at a time
                for row in zip(*(c.to_pylist() for c in b.slice(start, 256).columns)):
                    for made in f(*row):
                        rows.append(made)
                        size += sum(len(x) for x in made if isinstance(x, (str, bytes)))
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch()
                            rows, size = [], 0
        for made in getattr(f, "last", lambda: ())():
            rows.append(made)
            if len(rows) >= BATCH_ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()
        rows = []
        tidy()

    return df.mapInArrow(run, out)


def tidy() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


#: Pre-filter of joins: 2 ** FILTER_BITS words of 64 bits, whatever the input.
FILTER_BITS = 18


def bit_table(wanted: DataFrame) -> DataFrame:
    """The bits (__word, __m) of all values of wanted's only column."""
    bits = wanted.select(_bit(wanted.columns[0]).alias("__bit"))
    return bits.groupBy(_word().alias("__word")).agg(F.bit_or(_mask()).alias("__m"))


def maybe_in(rows: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """rows with a flag __maybe: false if the column's value is surely not in the bit table, which has a fixed size."""
    marked = rows.withColumn("__bit", _bit(name)).withColumn("__word", _word()).join(F.broadcast(table), "__word", "left")
    return marked.select(*rows.columns, (F.coalesce("__m", F.lit(0)).bitwiseAND(_mask()) != 0).alias("__maybe"))


def filtered(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Those of rows whose column may be among wanted's only one, so that what surely isn't needed isn't shuffled."""
    return maybe_in(rows, name, bit_table(wanted)).where("__maybe").select(*rows.columns)


def _bit(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(64 << FILTER_BITS))


def _word() -> Column:
    return F.shiftright("__bit", 6).cast("int")


def _mask() -> Column:
    return F.expr("shiftleft(1L, cast(__bit % 64 as int))")


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Words whose hashes a task keeps.
REMEMBERED = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words(dict):
    """64-bit hash by word; forgets everything when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def roll(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of x[i + k] * BASE ** (n - 1 - k) for each i."""
    if len(x) < n:
        return x[:0]
    out, have, power, double, span, weight = None, 0, n, x, 1, BASE
    with np.errstate(over="ignore"):
        while power:
            if power & 1:
                m = len(x) - (have + span) + 1
                out = double[:m] if out is None else out[:m] * weight + double[have : have + m]
                have += span
            power >>= 1
            if power:
                m = len(double) - span
                double = double[:m] * weight + double[span : span + m]
                weight = weight * weight
                span *= 2
    return out
