"""Exact dense retrieval over vector tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions import vectors as V
from corvane.functions.plan import settled, stored
from corvane.operators.best import OUT_ROWS, Best, ids_of, query_blocks
from corvane.operators.lexical import matching, ranked

METRICS = ("dot", "cosine", "l2")
#: Largest block of queries, in bytes of vectors, that is sent to all executors.
BROADCAST_BYTES = 32 << 20
#: Pairs that a task scores at once.
PAIRS = 2_000_000


def prepare(vectors: DataFrame, dimension: int | None = None, vec_col: str = "vector") -> DataFrame:
    """Unit vectors in double precision, truncated to a dimension if one is given."""
    v = V.doubles(F.col(vec_col))
    return vectors.withColumn(vec_col, V.truncate(v, dimension) if dimension else V.normalize(v))


def search(
    queries: DataFrame, vectors: DataFrame, top_k: int = 8, metric: str = "dot", dimension: int | None = None,
    namespace: str | None = None, filters: dict[str, str] | None = None,
) -> DataFrame:
    """(query_id, chunk_ord, score, rank): each of queries (query_id, vector) against all vectors (chunk_ord, vector).

    dot and cosine score unit vectors, l2 is the negative squared distance.
    Scores below zero stay. A stated query set is compared with all rows, in
    blocks of queries that are broadcast one after the other.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    native = vectors.select(F.max(F.size("vector"))).first()[0] or 0
    if dimension is not None and not 1 <= dimension <= native:
        raise ValueError(f"dimension must be from 1 to {native}")
    width = dimension or native
    q = settled(prepare(queries.select("query_id", "vector"), dimension).withColumnRenamed("vector", "query_vector"))
    v = settled(prepare(matching(vectors, namespace, filters), dimension).select("chunk_ord", "vector"))
    score = -V.squared_distance(F.col("query_vector"), F.col("vector")) if metric == "l2" else V.dot(F.col("query_vector"), F.col("vector"))

    def near(a: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        if metric != "l2":
            return [a @ x.T]
        return [2 * (a @ x.T) - (a * a).sum(1)[:, None] - (x * x).sum(1)[None, :]]

    def exact(a: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Of pairs of rows, summed in order as Spark sums them."""
        return [-((a - x) ** 2).cumsum(1)[:, -1] if metric == "l2" else (a * x).cumsum(1)[:, -1]]

    def odd_scores(a: DataFrame, b: DataFrame) -> DataFrame:
        return paired(a, b, native).select("query_id", "chunk_ord", score.alias("score"))

    found = _best(q, v, width, near, exact, odd_scores, top_k).select("query_id", "chunk_ord", (F.round("score", 9) + 0.0).alias("score"))
    return ranked(found, top_k)


def _sound(v: Column, width: int) -> Column:
    """Whether a vector has all its components, none of them null or no number or so large that squares overflow."""
    return F.coalesce((F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e150)), F.lit(False))


def _best(q: DataFrame, v: DataFrame, width: int, near, exact, odd_scores, top_k: int, keys: tuple = ()) -> DataFrame:
    """([key,] query_id, chunk_ord, score): at least the top_k best chunks (chunk_ord, vector) of each of q (query_id, query_vector), by scores that are rounded to nine decimals.

    Tasks take chunks against a block of queries in matrices: near(queries,
    chunks) gives one matrix for each key, or one, whose best are scored again by
    exact() on rows of pairs. Vectors that have no such score (null, shorter, not
    finite) are paired by odd_scores(); of those, as all of a kind score alike,
    top_k of each kind are enough for sound queries.
    """
    spark, names = v.sparkSession, ["query_id", "chunk_ord", "score"]
    kinds = [q.schema["query_id"].dataType.simpleString(), v.schema["chunk_ord"].dataType.simpleString()]
    query_type = to_arrow_type(q.schema["query_id"].dataType)
    good, odd = q.filter(_sound(F.col("query_vector"), width)), q.filter(~_sound(F.col("query_vector"), width))
    n_queries, n_good = q.agg(F.count("*"), F.count(F.when(_sound(F.col("query_vector"), width), 1))).first()
    blocks = max(query_blocks(n_good, top_k * max(1, len(keys))), -(-n_good * max(width, 1) * 8 // BROADCAST_BYTES))
    # one task a core, whatever the files: each gives top_k rows a query
    dealt = v.filter(_sound(F.col("vector"), width)).repartition(spark.sparkContext.defaultParallelism, "chunk_ord")
    dealt = stored(dealt, "dealt") if blocks > 1 else dealt
    schema = ("key int, " if keys else "") + f"query_id {kinds[0]}, chunk_ord {kinds[1]}, score double"
    out = None
    for block in range(blocks):
        mine = good if blocks == 1 else good.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = mine.collect()  # BROADCAST_BYTES, about
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["query_vector"] for r in rows], np.float64).reshape(len(rows), width)))

        def look(batches, sent=sent):
            ids, a = sent.value
            best, id_type = [Best(len(ids), top_k, 9) for _ in keys or (0,)], None
            step = max(64, min(4096, PAIRS // max(1, len(ids))))
            for whole in batches:
                id_type = whole.column(0).type
                for i in range(0, whole.num_rows if ids else 0, step):
                    b = whole.slice(i, step)
                    x = b.column(1).flatten().to_numpy().reshape(b.num_rows, width)

                    def again(who, at, k, x=x):
                        return np.concatenate([exact(a[who[j : j + OUT_ROWS]], x[at[j : j + OUT_ROWS]])[k] for j in range(0, len(who), OUT_ROWS)])

                    for k, s in enumerate(near(a, x)):
                        best[k].add(s, ids_of(b.column(0)), lambda who, at, k=k, again=again: again(who, at, k))
            for k, kept in enumerate(best):
                before = (pa.scalar(keys[k], pa.int32()),) if keys else ()
                yield from kept.rows(pa.array(ids, query_type), id_type, ["key", *names] if keys else names, before)

        part = dealt.mapInArrow(look, schema)
        out = part if out is None else out.unionByName(part)
    lacking = F.col("vector").isNull() | (F.size("vector") != width) | F.exists("vector", lambda x: x.isNull())
    strange = v.filter(~_sound(F.col("vector"), width))
    for kind in (lacking, ~lacking):
        out = out.unionByName(odd_scores(good, strange.filter(kind).orderBy("chunk_ord").limit(top_k)))
    return out.unionByName(odd_scores(odd, v)) if n_good < n_queries else out


def paired(queries: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Each query with each vector: queries in blocks of BROADCAST_BYTES at most, about, each of which is one pass over the vectors."""
    blocks = max(1, -(-queries.count() * max(dimension, 1) * 8 // BROADCAST_BYTES))
    out = None
    for k in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        pairs = vectors.crossJoin(F.broadcast(block))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def search_dimensions(queries: DataFrame, vectors: DataFrame, dimensions: list[int], top_k: int = 8) -> DataFrame:
    """(dimension, query_id, chunk_ord, score, rank): the rankings of search() at several dimensions from one pass.

    The products of a query and a vector are summed once, from one dimension to
    the next, and so are the squares of each vector.
    """
    if not dimensions:
        raise ValueError("no dimensions")
    edges = sorted(set(dimensions))
    native = vectors.select(F.max(F.size("vector"))).first()[0] or 0
    if edges[0] < 1 or edges[-1] > max(native, 1):
        raise ValueError(f"dimensions must be from 1 to {native}")

    def upto(values: Column) -> Column:
        """Sums of the first components, one for each dimension."""
        pieces = F.array(*(F.aggregate(F.slice(values, a + 1, b - a), F.lit(0.0), lambda s, x: s + x) for a, b in zip([0, *edges], edges)))
        return F.aggregate(pieces, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)))))

    scores = F.zip_with(upto(F.zip_with("q", "v", lambda a, b: a * b)), F.zip_with("q_norms", "v_norms", lambda a, b: a * b), lambda s, n: F.when(n == 0, 0.0).otherwise(s / n))
    pieces = list(zip([0, *edges], edges))

    def plain_scores(a: DataFrame, b: DataFrame) -> DataFrame:
        return paired(a.withColumnRenamed("query_vector", "q"), b.withColumnRenamed("vector", "v"), native).select("query_id", "chunk_ord", F.posexplode(scores).alias("at", "score"))

    def near(a: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        total, out = 0.0, []
        for i, j in pieces:
            total = total + a[:, i:j] @ x[:, i:j].T
            n = np.sqrt((a[:, :j] ** 2).sum(1))[:, None] * np.sqrt((x[:, :j] ** 2).sum(1))[None, :]
            out.append(np.divide(total, n, out=np.zeros_like(total), where=n != 0))
        return out

    def exact(a: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Of pairs of rows, summed piece by piece in order as Spark sums them."""
        sums, out = [0.0, 0.0, 0.0], []
        for i, j in pieces:
            sums = [t + (f[:, i:j] * g[:, i:j]).cumsum(1)[:, -1] for t, (f, g) in zip(sums, ((a, x), (a, a), (x, x)))]
            n = np.sqrt(sums[1]) * np.sqrt(sums[2])
            out.append(np.divide(sums[0], n, out=np.zeros_like(n), where=n != 0))
        return out

    def odd_scores(a: DataFrame, b: DataFrame) -> DataFrame:
        normed = lambda rows, name, at: rows.withColumn(f"{name}_norms", F.transform(upto(F.transform(at, lambda x: x * x)), lambda x: F.sqrt(x)))
        flat = plain_scores(normed(a, "q", F.col("query_vector")), normed(b, "v", F.col("vector")))
        return flat.select(F.col("at").alias("key"), "query_id", "chunk_ord", "score")

    bare = lambda rows, *names: settled(rows.filter("vector IS NOT NULL").select(F.col(names[0]), V.doubles(F.col("vector")).alias(names[1])))
    found = _best(bare(queries, "query_id", "query_vector"), bare(vectors, "chunk_ord", "vector"), native, near, exact, odd_scores, top_k, tuple(range(len(edges))))
    named = found.select(F.get(F.array(*map(F.lit, edges)), F.col("key")).alias("dimension"), "query_id", "chunk_ord", (F.round("score", 9) + 0.0).alias("score"))
    w = Window.partitionBy("dimension", "query_id").orderBy(F.desc("score"), F.asc("chunk_ord"))
    return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def candidate_limit(top_k: int, filters: dict[str, str], indexed: set[str]) -> int:
    """How many candidates are fetched when some filters are checked afterwards."""
    return top_k if set(filters) <= indexed else max(top_k, min(1000, 25 * top_k))


def where_clause(filters: dict[str, str]) -> str:
    """Equality of each key, in order, as SQL."""
    return " AND ".join(f"{k} = '{str(v).replace(chr(39), 2 * chr(39))}'" for k, v in sorted(filters.items()))


def search_residual(queries: DataFrame, vectors: DataFrame, top_k: int, filters: dict[str, str], indexed: set[str], namespace: str | None = None, **more) -> DataFrame:
    """search() as a store with an index on some columns answers it: those filters first, then candidate_limit rows, then the others.

    It may give fewer rows than search(), whose filters all come first.
    """
    first = {k: v for k, v in filters.items() if k in indexed}
    rest = {k: v for k, v in filters.items() if k not in indexed}
    found = search(queries, vectors, candidate_limit(top_k, filters, indexed), namespace=namespace, filters=first, **more)
    kept = matching(vectors, None, rest).select("chunk_ord")
    return ranked(found.join(kept, "chunk_ord", "left_semi").drop("rank"), top_k)
