"""Retrieval-quality and accuracy metrics over whole result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(results: DataFrame, gold: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, recall, mrr, ndcg) per query of gold (query_id, chunk_ord, gain 2 required or 1 helpful).

    Each gold row is one evidence and each result claims at most one, so gains
    are a join. Queries without required evidence have recall 1 and MRR 0;
    without any, nDCG 1 needs no rows here.
    """
    hits = results.filter(F.col("rank") <= top_k).join(gold, ["query_id", "chunk_ord"]).groupBy("query_id").agg(
        F.count(F.when(F.col("gain") == 2, 1)).alias("hit"),
        F.min(F.when(F.col("gain") == 2, F.col("rank"))).alias("first"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "chunk_ord"))
    ideal = gold.withColumn("place", place).groupBy("query_id").agg(
        F.count(F.when(F.col("gain") == 2, 1)).alias("required"),
        F.sum(F.when(F.col("place") <= top_k, F.col("gain") / F.log2(F.col("place") + 1.0))).alias("ideal"),
    )
    hit = F.coalesce("hit", F.lit(0))
    return ideal.join(hits, "query_id", "left").select(
        "query_id",
        F.when(F.col("required") > 0, hit / F.col("required")).otherwise(1.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame, names: tuple[str, ...] = ("recall", "mrr", "ndcg")) -> DataFrame:
    """(metric, value) means; 0.0 over no rows."""
    means = per_query.agg(*(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names))
    return means.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))))


def micro_accuracy(correct: Column, total: Column) -> Column:
    """Sum of correct over sum of total, 1.0 over nothing."""
    return F.when(F.coalesce(F.sum(total), F.lit(0)) == 0, 1.0).otherwise(F.sum(correct) / F.sum(total))


def percentile_nearest(values: str, p: float) -> Column:
    """Nearest rank: the value at ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {values})")


def percentile_rounded(values: str, p: float) -> Column:
    """The value at position (n - 1) p, rounded half to even, of the sorted values, to 2 places.

    For groups of a bounded size, such as the last requests; larger ones take
    percentile_rounded_table.
    """
    ordered = F.array_sort(F.collect_list(values))
    at = F.bround((F.size(ordered) - 1) * F.lit(p)).cast("int")
    return F.round(F.get(ordered, at), 2)


def percentile_rounded_table(rows: DataFrame, by: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """percentile_rounded for groups of any size: counts per value, running totals, no group in memory."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    picks = []
    for p in ps:
        at = F.bround((F.col("n") - 1) * F.lit(p)) + 1
        picks.append(F.round(F.max(F.when((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at), F.col(value))), 2).alias(f"p{round(100 * p)}"))
    return run.groupBy(*by).agg(*picks)


def percentile_linear(values: str, p: float) -> Column:
    return F.percentile(values, p)


def latency_summary(rows: DataFrame, value: str) -> DataFrame:
    """Mean, nearest-rank percentiles and maximum, to 2 places; 0.0 over no rows."""
    parts = [F.avg(value).alias("mean"), *(percentile_nearest(value, p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)), F.max(value).alias("max")]
    names = ("mean", "p50", "p90", "p95", "p99", "max")
    return rows.agg(*parts).select(*(F.round(F.coalesce(n, F.lit(0.0)), 2).alias(n) for n in names))


def latency_metrics(rows: DataFrame, axis: str, value: str) -> DataFrame:
    """(metric, value): `<axis>_latency_ms_<mean, p50, p90, p95, p99, max>` of each axis (a column), percentiles by nearest rank."""
    v = F.col(value).cast("double")
    parts = {"mean": F.avg(v), **{f"p{p}": percentile_nearest(f"CAST(`{value}` AS DOUBLE)", p / 100) for p in (50, 90, 95, 99)}, "max": F.max(v)}
    per = rows.groupBy(F.col(axis).alias("axis")).agg(*(c.alias(n) for n, c in parts.items()))
    named = F.array(*(F.struct(F.concat("axis", F.lit(f"_latency_ms_{n}")).alias("metric"), F.coalesce(n, F.lit(0.0)).alias("value")) for n in parts))
    return per.select(F.inline(named))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, threshold, value, passed) for each threshold; a missing metric fails."""
    joined = thresholds.join(metrics, "metric", "left")
    return joined.select("metric", "threshold", "value", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed"))


def strategy_grid(lexical: DataFrame, dense: DataFrame, gold: DataFrame, dimensions: list[int], top_k: int = 10, candidates: int = 100) -> DataFrame:
    """(strategy, dimension, metric, value): recall, mrr and ndcg of lexical (dimension 0), dense and hybrid retrieval at each dimension.

    lexical has (query_id, chunk_ord, rank), dense (dimension, query_id,
    chunk_ord, rank), both with `candidates` rows a query; they are made once and
    shared by all cells of the grid. A cell's query is a key of (strategy,
    dimension, query_id), so fusion and metrics take the whole grid at once.
    """
    from corvane.operators.fusion import reciprocal_rank_fusion

    def keyed(rows: DataFrame, strategy: str, dimension: Column) -> DataFrame:
        key = F.struct(F.lit(strategy).alias("strategy"), dimension.cast("int").alias("dimension"), "query_id").alias("query_id")
        return rows.filter(F.col("rank") <= candidates).select(key, "chunk_ord", "rank")

    each = F.explode(F.array(*map(F.lit, dimensions))).alias("dimension")
    spread = lexical.select("query_id", "chunk_ord", "rank", each)
    hybrid = reciprocal_rank_fusion([keyed(spread, "hybrid", F.col("dimension")), keyed(dense, "hybrid", F.col("dimension"))], top_k)
    cells = keyed(lexical, "lexical", F.lit(0)).unionByName(keyed(dense, "dense", F.col("dimension"))).unionByName(hybrid.select("query_id", "chunk_ord", "rank"))
    grid = [("lexical", 0), *((s, d) for s in ("dense", "hybrid") for d in dimensions)]
    configs = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(d).cast("int").alias("dimension")) for s, d in grid))).alias("config")
    wanted = gold.select("*", configs).withColumn("query_id", F.struct("config.strategy", "config.dimension", "query_id")).drop("config")
    per = retrieval_metrics(cells, wanted, top_k)
    names = ("recall", "mrr", "ndcg")
    means = per.groupBy("query_id.strategy", "query_id.dimension").agg(*(F.avg(n).alias(n) for n in names))
    return means.select("strategy", "dimension", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))))


def ablation(configs: list[dict], run) -> DataFrame:
    """Metrics of each config (a dict of scalars) of a grid, by run(config) -> (metric, value); one union, run as one job."""
    out = None
    for c in configs:
        part = run(c).select(*(F.lit(v).alias(k) for k, v in c.items()), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out
