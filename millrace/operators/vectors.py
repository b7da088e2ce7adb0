"""Nearest neighbours by dot product of unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .best import SLACK, Best, column

#: Queries that go to every task at once; larger sets are taken in blocks of this many.
BLOCK = 1_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, doc_id, similarity, distance (2 - 2 * similarity: squared, of unit vectors), rank.

    vectors: doc_id, embedding; queries: query_id, embedding. Every block of BLOCK queries goes to all tasks and is compared with
    all vectors; a task keeps the first k rows of each query as it reads, so pairs are neither sorted nor shuffled.
    """
    numbered = queries.select("query_id", F.col("embedding").alias("q"))
    n = numbered.count()
    parts = max(1, -(-n // BLOCK))
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "doc_id")
    out = None
    for i in range(parts):
        block = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else numbered
        top = _scored(vectors, block, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))
        out = top if out is None else out.unionByName(top)
    return out.withColumn("distance", 2 - 2 * F.col("similarity"))


def _matrix(lists: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which ones there are: not null, of length d, without a null in them."""
    there = pc.fill_null(pc.equal(pc.list_value_length(lists), d), False).to_numpy(zero_copy_only=False)
    flat = lists.filter(pa.array(there)).flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
        rows, there[there] = rows[whole], whole
    return rows, there


def _scored(vectors: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, similarity of all pairs that may be among the first k of their query."""
    held = block.toArrow()
    ids, lists = column(held, "query_id"), column(held, "q")
    d = max(pc.list_value_length(lists).drop_null().to_pylist(), default=0)
    asked, there = _matrix(lists, d) if d else (None, np.zeros(1, bool))
    kinds = dict(vectors.dtypes)
    if k > 0 and held.num_rows and not there.all():  # vectors of several lengths: pair by pair
        return vectors.select("doc_id", "embedding").crossJoin(F.broadcast(block)).select("query_id", "doc_id", dot(F.col("embedding"), F.col("q")).alias("similarity"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, others = Best(len(ids), k), []
        reach = np.sqrt((asked**2).sum(axis=1))
        for b in batches:
            rows, whole = _matrix(b.column("embedding"), d)
            docs = b.column("doc_id")
            if not whole.all():  # without similarity, behind all others
                others = pa.concat_arrays([*others, docs.filter(pa.array(~whole))])
                others = [others.take(pc.sort_indices(others)[:k])]
                docs = docs.filter(pa.array(whole))
            if not len(rows):
                continue
            # a quick product first; what it can't rule out is summed in the order of dot()
            near = rows @ asked.T
            slack = SLACK + 1e-13 * np.sqrt((rows**2).sum(axis=1)).max() * reach
            least = best.floor
            if len(rows) > k:
                least = np.maximum(least, np.partition(near, len(rows) - k, axis=0)[len(rows) - k] - slack) if np.isneginf(least).any() else least
            row, query = np.nonzero(~(near < least - slack))
            if not len(row):
                continue
            exact = np.zeros(len(row))
            for i in range(d):
                exact += rows[row, i] * asked[query, i]
            best.add(query, exact, docs.take(pa.array(row)))
        found = best.table(ids, "similarity")
        if found is not None:
            yield from found.to_batches()
        for docs in others:
            for i in range(len(ids)):
                yield pa.record_batch({"query_id": pa.repeat(ids[i], len(docs)), "doc_id": docs, "similarity": pa.nulls(len(docs), pa.float64())})

    if k <= 0 or not held.num_rows:
        return vectors.select("doc_id").limit(0).crossJoin(block.select("query_id").limit(0)).select("query_id", "doc_id", F.lit(None).cast("double").alias("similarity"))
    return vectors.select("doc_id", "embedding").mapInArrow(run, f"query_id {dict(block.dtypes)['query_id']}, doc_id {kinds['doc_id']}, similarity double")


def nearest_where(vectors: DataFrame, queries: DataFrame, equal: dict, k: int = 20) -> DataFrame:
    """nearest() among the vectors whose columns have these values."""
    for name, value in equal.items():
        vectors = vectors.where(F.col(name) == F.lit(value))
    return nearest(vectors, queries, k)


def matching(vectors: DataFrame, equal: dict, k: int = 20) -> DataFrame:
    """Rows with these values without any query: the first k by id."""
    for name, value in equal.items():
        vectors = vectors.where(F.col(name) == F.lit(value))
    return vectors.orderBy("doc_id").limit(max(k, 0))
