"""Fusion of rankings, and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import dense, ivf, lexical

RRF_K = 60
CANDIDATES = 100


def reciprocal_rank_fusion(rankings: list[DataFrame], top_k: int, k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(query_id, chunk_ord, score, rank) of rankings (query_id, chunk_ord, rank).

    A chunk scores weight / (k + rank) in each ranking that has it. Ties go to
    the chunk that appears first, by ranking and then by rank. One union and one
    grouped sum, no outer join.
    """
    weights = weights or [1.0] * len(rankings)
    rows = None
    for at, (r, w) in enumerate(zip(rankings, weights, strict=True)):
        part = r.select("query_id", "chunk_ord", (F.lit(float(w)) / (k + F.col("rank"))).alias("s"), F.struct(F.lit(at).alias("list"), "rank").alias("place"))
        rows = part if rows is None else rows.union(part)
    fused = rows.groupBy("query_id", "chunk_ord").agg(F.round(F.sum("s"), 12).alias("score"), F.min("place").alias("place"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("place"))
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).drop("place")


def hybrid(
    queries: DataFrame, chunks: DataFrame, query_vectors: DataFrame, vectors: DataFrame, top_k: int = 8, candidates: int = CANDIDATES,
    weights: list[float] | None = None, namespace: str | None = None, filters: dict[str, str] | None = None,
) -> DataFrame:
    """Lexical and dense candidates of each query, fused."""
    lex = lexical.search(queries, chunks, candidates, namespace, filters)
    den = dense.search(query_vectors, vectors, candidates, namespace=namespace, filters=filters)
    return reciprocal_rank_fusion([lex, den], top_k, weights=weights)


def shared_dense(lexical_rankings: DataFrame, dense_ranking: DataFrame, top_k: int) -> DataFrame:
    """Each lexical ranking fused with one dense ranking (chunk_ord, rank) that all queries share."""
    shared = lexical_rankings.select("query_id").distinct().crossJoin(dense_ranking.select("chunk_ord", "rank"))
    return reciprocal_rank_fusion([lexical_rankings, shared], top_k)


def rerank(ranking: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, top_k: int, least: int = 50) -> DataFrame:
    """The first max(top_k, least) rows of a ranking in the order of a scorer's column `rerank_score`; without a scorer, in their own."""
    pool = ranking.filter(F.col("rank") <= max(top_k, least))
    if scorer is None:
        return pool.filter(F.col("rank") <= top_k)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("rank"))
    scored = scorer(pool).withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= top_k)
    return scored.select("query_id", "chunk_ord", F.col("rerank_score").alias("score"), F.col("new_rank").alias("rank"))


def dense_by(backend: str, query_vectors: DataFrame, vectors: DataFrame, top_k: int, index: ivf.Index | None = None, probes: int = 8, **more) -> DataFrame:
    """Dense retrieval by a backend: `memory` compares with all vectors, `index` looks into a stored inverted file, `auto` takes that if there is one."""
    if backend not in ("memory", "index", "auto"):
        raise ValueError(f"unknown backend {backend}")
    if backend == "index" and index is None:
        raise ValueError("the backend `index` needs an index")
    if backend == "memory" or index is None:
        return dense.search(query_vectors, vectors, top_k, **more)
    return ivf.nearest_rows(query_vectors, index, top_k, probes=probes, **more)


def retrieve(
    mode: str, queries: DataFrame, chunks: DataFrame, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, top_k: int = 8, namespace: str | None = "knowledge", scorer=None,
    backend: str = "memory", index: ivf.Index | None = None, **more,
) -> DataFrame:
    """One retrieval by mode: lexical, dense, hybrid, or any of them with `_colbert`, which reranks; without vectors, lexical. Dense parts go to a backend (dense_by)."""
    base, _, second = mode.partition("_")
    if base == "colbert":
        base, second = "hybrid", "colbert"
    if base not in ("lexical", "dense", "hybrid") or second not in ("", "colbert"):
        raise ValueError(f"unknown mode {mode}")
    k = max(top_k, 50) if second else top_k
    if base == "lexical" or vectors is None or query_vectors is None:
        found = lexical.search(queries, chunks, k, namespace, **more)
    elif base == "dense":
        found = dense_by(backend, query_vectors, vectors, k, index, namespace=namespace, **more)
    else:
        lex = lexical.search(queries, chunks, max(k, CANDIDATES), namespace, **more)
        found = reciprocal_rank_fusion([lex, dense_by(backend, query_vectors, vectors, max(k, CANDIDATES), index, namespace=namespace, **more)], k)
    return rerank(found, scorer, top_k) if second else found
