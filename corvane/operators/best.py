"""The best rows of each query within a task.

A task scores its rows against all queries in matrices and keeps k rows a query,
so that what is sorted and shuffled are k rows a query and task and never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that all queries of a block may hold in a task.
HELD_ROWS = 2_000_000
OUT_ROWS = 65_536


class Best:
    """The k best rows of each query so far, by score to some decimals and then by id."""

    def __init__(self, queries: int, k: int, decimals: int):
        self.k, self.decimals = k, decimals
        self.least = np.full(queries, -np.inf)  # what the k-th best has, where there are k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, exact=None) -> None:
        """scores (queries x rows) of rows with ids; NaN is no score. exact(queries, rows), places of pairs, gives the scores that count if these are only near them."""
        slack = 1.5 * 10.0**-self.decimals
        hit = scores >= (self.least - slack)[:, None]
        if np.count_nonzero(hit) > 2 * self.k * len(self.least) and scores.shape[1] > self.k:
            kth = np.partition(np.where(np.isnan(scores), -np.inf, scores), -self.k, axis=1)[:, -self.k]
            hit &= scores >= (kth - slack)[:, None]
        who, at = np.nonzero(hit)
        if not len(who):
            return
        self.parts.append((who, scores[who, at] if exact is None else exact(who, at), ids[at]))
        self.waiting += len(who)
        if self.waiting >= self.k * len(self.least):
            self._shrink()

    def _shrink(self) -> None:
        who, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        shown = np.round(score, self.decimals)
        place = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place, -shown, who))
        who, score, ids, shown = who[order], score[order], ids[order], shown[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        nth = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        last = nth == self.k - 1
        self.least[who[last]] = shown[last]
        keep = nth < self.k
        self.parts, self.waiting = [(who[keep], score[keep], ids[keep])], 0

    def rows(self, query_ids: pa.Array, id_type: pa.DataType, names: list[str], before: tuple[pa.Scalar, ...] = ()) -> Iterator[pa.RecordBatch]:
        """(..., query id, row id, score) of all that is kept, behind columns of one value each."""
        if self.parts:
            self._shrink()
        for who, score, ids in self.parts:
            for i in range(0, len(who), OUT_ROWS):
                part = slice(i, i + OUT_ROWS)
                fixed = [pa.array([x.as_py()] * len(who[part]), x.type) for x in before]
                yield pa.RecordBatch.from_arrays([*fixed, query_ids.take(pa.array(who[part])), pa.array(ids[part], id_type), pa.array(score[part])], names)


def ids_of(column: pa.Array) -> np.ndarray:
    """Row ids as numpy has them: numbers, or objects that compare as Spark's values do."""
    return column.to_numpy(zero_copy_only=False)


def query_blocks(queries: int, k: int) -> int:
    """Blocks that a query set is cut into, so that what a task holds of one is bounded."""
    return max(1, -(-queries * k // HELD_ROWS))
