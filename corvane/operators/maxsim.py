"""Late interaction: each token vector of a query takes its best token of a chunk, and the best are summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.lexical import ranked

#: Numbers of a product at once: query tokens times chunk tokens.
BLOCK_CELLS = 1 << 20


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit token vectors of all rows, one after the other; number of tokens of each row)."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    vectors = column.flatten()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norms == 0, 1.0, norms), sizes


def best_sums(q: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each chunk, of tokens x in turn, the sum over q of the largest product; 0 for a chunk or query without tokens."""
    out = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if not len(some) or not len(q):
        return out
    starts = np.cumsum(sizes) - sizes
    best = np.full((len(q), len(some)), -np.inf)
    step = max(1, BLOCK_CELLS // len(q))
    owner = np.repeat(np.arange(len(some)), sizes[some])
    rows = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in some])
    for lo in range(0, len(rows), step):  # a chunk may go on in the next block
        here = owner[lo : lo + step]
        first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        products = np.maximum.reduceat(q @ x[rows[lo : lo + step]].T, first, axis=1)
        best[:, here[first]] = np.maximum(best[:, here[first]], products)
    out[some] = best.sum(0)
    return out


def scored(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs (query_id, chunk_ord, ...) with maxsim: token vectors are queries (query_id, tokens) and chunks (chunk_ord, tokens), arrays of vectors.

    Products are made for a query and all its chunks of a batch at once, in
    blocks of a bounded size. A null or empty array scores 0, a zero vector is
    nobody's best unless all are worse; pairs without a query or chunk go.
    """
    none = F.array().cast("array<array<double>>")
    q = queries.select("query_id", F.coalesce(F.col("tokens").cast("array<array<double>>"), none).alias("__q"))
    c = chunks.select("chunk_ord", F.coalesce(F.col("tokens").cast("array<array<double>>"), none).alias("__c"))
    joined = pairs.join(c, "chunk_ord").join(q, "query_id").sortWithinPartitions("query_id")
    kept = [f for f in joined.columns if f not in ("__q", "__c")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            ids = b.column(names.index("query_id"))
            q_column, c_column = b.column(names.index("__q")), b.column(names.index("__c"))
            codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            out = np.zeros(len(codes))
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    mine, _ = _tokens(q_column.slice(lo, 1))
                    out[lo:hi] = best_sums(mine, *_tokens(c_column.slice(lo, hi - lo)))
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(k)) for k in kept), pa.array(out)], [*kept, "maxsim"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in kept)
    return joined.mapInArrow(run, f"{schema}, maxsim double")


def rerank(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 8) -> DataFrame:
    """(query_id, chunk_ord, score, rank): candidates (query_id, chunk_ord) in the order of late interaction."""
    done = scored(pairs.select("query_id", "chunk_ord"), queries, chunks)
    return ranked(done.select("query_id", "chunk_ord", (F.round("maxsim", 6) + 0.0).alias("score")), top_k)
