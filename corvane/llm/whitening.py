"""Whitening of embeddings: exact integer means, then a covariance of centred vectors, one eigenproblem and a broadcast projection.

The first pass sums the fixed-point vectors in whole numbers; the second sums
outer products of the centred vectors by matrix products; both are merged by
treeAggregate, so that the driver gets one vector and one matrix of the number of
dimensions, whatever the number of rows. A third pass measures what covariance
the whitened vectors really have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import tidy

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: A component has no variance if its eigenvalue is below this share of the largest one.
FLAT = 1e-12
#: Partial sums meet in so many rounds.
DEPTH = 2
#: Entries beyond this are as this: n times an entry is then exact in Python's whole numbers and each entry is a long.
LIMIT = 1 << 62
_LIMB = 24


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as doubles) of the rows of a list column that hold finite numbers only, for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    given = values.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~given | ~np.isfinite(flat))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    lengths = np.diff(offsets)
    for size in np.unique(lengths[ok]).tolist():
        rows = np.flatnonzero(ok & (lengths == size))
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]


def fixed(vectors: np.ndarray) -> np.ndarray:
    """x = floor(SCALE * c) + SHIFT of each entry, as long."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE) + SHIFT, -LIMIT, LIMIT).astype(np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python's whole numbers: halves of 32 bits can't overflow."""
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return [(h << 32) + w for h, w in zip(high.tolist(), low.tolist())]


@dataclass
class Moments:
    """What one pass has summed for each length of vectors: how many, and sums (whole numbers, or a matrix and a vector)."""

    parts: dict[int, list]

    def merge(self, other: Moments) -> Moments:
        for size, (n, *sums) in other.parts.items():
            if size not in self.parts:
                self.parts[size] = [n, *sums]
            else:
                mine = self.parts[size]
                mine[0] += n
                for k, s in enumerate(sums, 1):
                    mine[k] = [a + b for a, b in zip(mine[k], s)] if isinstance(s, list) else mine[k] + s
        return self


@dataclass
class Fit:
    """The fit of all vectors of a length: their number, exact sums, the projection (dimensions x components) and its shares."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    alive: np.ndarray
    error: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where that holds it, else Python's whole numbers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < LIMIT:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row the sum of (n * x - S)^2, exact."""
        v = self.scaled(x)
        if v.dtype == object or (v.size and int(np.abs(v).max()) >= 1 << 2 * _LIMB):
            v = v.astype(object)
            return [int(s) for s in (v * v).sum(1)] if v.shape[1] else [0] * len(v)
        if not v.size or int(np.abs(v).max()) ** 2 * v.shape[1] < LIMIT:
            return (v * v).sum(1).tolist()
        v = np.abs(v)
        high, low = v >> _LIMB, v & ((1 << _LIMB) - 1)
        parts = ((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
        return [(a << 2 * _LIMB) + (b << _LIMB + 1) + c for a, b, c in zip(*parts)]


def _merged(vectors: DataFrame, of_batch) -> Moments:
    """The sums that of_batch makes of each batch's vectors, over all rows: one row a task, merged by treeAggregate."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total = Moments({})
        for b in batches:
            for _, m in matrices(b.column(0)):
                total.merge(Moments({m.shape[1]: of_batch(m)}))
        if total.parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total.parts)], pa.binary())], ["part"])

    def add(total: Moments, row) -> Moments:
        import pickle

        return total.merge(Moments(pickle.loads(row["part"])))

    parts = vectors.mapInArrow(lambda it: tidy(partial(it)), "part binary")
    return parts.rdd.treeAggregate(Moments({}), add, Moments.merge, DEPTH)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """For each length of the vectors (column `vec`), what whitens those of that length."""
    spark = vectors.sparkSession
    sums = _merged(vectors, lambda m: [len(m), exact_sums(fixed(m))])
    fits = {size: Fit(n, s, np.zeros((size, 0)), np.zeros(0), np.zeros(0, bool)) for size, (n, s) in sums.parts.items() if size}
    if not fits:
        return fits
    means = spark.sparkContext.broadcast(fits)

    def outer(m: np.ndarray) -> list:
        c = means.value[m.shape[1]].centred(fixed(m)) if m.shape[1] else m
        return [len(m), c.T @ c]

    covariances = _merged(vectors, outer)
    for size, f in fits.items():
        v = covariances.parts[size][1] / f.n
        v = (v + v.T) / 2
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        trace = float(np.trace(v))
        f.alive = values > max(FLAT * max(float(values[0]), 0.0), 0.0)
        f.projection = axes / np.sqrt(np.where(f.alive, values, 1.0))
        f.explained = np.where(f.alive, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    whole = spark.sparkContext.broadcast(fits)

    def whitened_outer(m: np.ndarray) -> list:
        f = whole.value.get(m.shape[1])
        w = f.centred(fixed(m)) @ f.projection if f else m
        return [len(m), w.T @ w, w.sum(0)]

    measured = _merged(vectors, whitened_outer)
    for size, f in fits.items():
        n, products, totals = measured.parts[size]
        covariance = products / n - np.outer(totals / n, totals / n)
        gap = np.abs(covariance - np.eye(len(covariance)))[np.ix_(f.alive, f.alive)]
        f.error = float(gap.max(initial=0.0))
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    Rows whose vector is null or holds a null or non-finite entry are dropped.
    An entry c becomes x = floor(1024 c) + 100000, to the nearest end of
    +-2^62 where that is beyond. All remaining rows are the fit list, each as
    often as it occurs; vectors of different lengths are a fit list of their own
    for each length, and empty vectors have no component and so no row. A vector
    of fewer dimensions than `components` has as many components as dimensions.
    A component without variance (one row only, constant dimensions) has whitened
    null and explained 0 and doesn't count for identity_error. deviation is null
    where it is beyond a long, deviation_exact (decimal) beyond 38 digits. A null
    id stays null; other columns are ignored; an empty table gives no rows.

    The vectors are read four times, so `vectors` has to be a table or a plan that
    gives the same rows again; nothing but sums of tasks is shuffled.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(vec_col).alias("vec"), F.col(id_col).alias("vec_id"))
    whole = spark.sparkContext.broadcast(fit(src.select("vec"), components))
    kind = src.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, m in matrices(b.column(0)):
                f = whole.value.get(m.shape[1])
                if f is None:
                    continue
                x = fixed(m)
                k = f.projection.shape[1]
                whitened = f.centred(x) @ f.projection
                whitened[:, ~f.alive] = np.nan
                wide = f.deviations(x)
                longs = [d if d < 1 << 63 else None for d in wide]
                exact = pa.array([Decimal(d) if d < 10**38 else None for d in wide], pa.decimal128(38, 0))
                of_row = pa.array(np.repeat(np.arange(len(rows)), k))
                size = len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(1).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(size, f.n, np.int64)),
                        pa.array(longs, pa.int64()).take(of_row),
                        pa.array(whitened.ravel(), from_pandas=True),
                        pa.array(np.tile(f.explained, len(rows))),
                        pa.array(np.full(size, f.error)),
                        exact.take(of_row),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return src.mapInArrow(lambda it: tidy(project(it)), schema)
