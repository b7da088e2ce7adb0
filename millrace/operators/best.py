"""The first k rows of each query, kept while batches go by in a Python worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores are ordered as rounded to 9 places, so two that are farther apart than this have the order of their values.
SLACK = 2e-9


class Best:
    """Rows (query, score, document) that may be among the first k of their query by rounded score, then document; loses none of them.

    Of equal scores k documents stay, and of different ones all that rounding can make equal to the k-th.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor, self.rows = k, np.full(queries, -np.inf), None

    def add(self, query: np.ndarray, score: np.ndarray, doc: pa.Array) -> None:
        # as in Spark's order, NaN comes before all numbers
        key = np.nan_to_num(score, nan=1e301, posinf=1e300, neginf=-1e300)
        new = pa.table({"query": query.astype(np.int32), "key": key, "score": pa.array(score, from_pandas=False), "doc": doc})
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        rows = rows.sort_by([("query", "ascending"), ("key", "descending"), ("doc", "ascending")])
        q, x, n = rows["query"].to_numpy(), rows["key"].to_numpy(), rows.num_rows
        if not n:
            return
        at = np.arange(n)
        first = np.r_[True, q[1:] != q[:-1]]
        start = np.maximum.accumulate(np.where(first, at, 0))
        tie = np.maximum.accumulate(np.where(first | np.r_[True, x[1:] != x[:-1]], at, 0))
        kth = at - start == self.k - 1
        self.floor[q[kth]] = x[kth]
        self.rows = rows.filter(pa.array((at - tie < self.k) & (x >= self.floor[q] - SLACK)))

    def table(self, ids: pa.Array, name: str) -> pa.Table | None:
        """query_id, doc_id and the score under its name."""
        if self.rows is None:
            return None
        return pa.table({"query_id": ids.take(self.rows["query"].combine_chunks()), "doc_id": self.rows["doc"], name: self.rows["score"]})


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)
