"""Registered queries: request events, percentiles, evaluation, stores and manifests, relational basics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.plan import stored
from corvane.operators import dense, evaluation, events
from corvane.plans.common import chunks, t, vectors
from corvane.plans.retrieval import BM25, _bm25, _dense_sql, _top
from corvane.sources import manifest, store

WINDOW_S, SPIKE = 3600, 5
SLOW = 40.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events")


def win9_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sliding_counts(_events(spark, sf_dir), 86400, by=["user_id"]).select("event_id", "window_count")


def ops4_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.spikes(_events(spark, sf_dir), WINDOW_S, SPIKE).select("event_id", "window_count", "is_spike")


def ops5_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events.spikes(_events(spark, sf_dir), WINDOW_S, SPIKE)
    reasons = events.alert_reasons(F.col("event_type") == "error", F.col("is_spike"), F.col("value") >= SLOW)
    return s.select("event_id", F.array_join(reasons, ",").alias("reasons"))


def win10_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.last_n(_events(spark, sf_dir), 10, "value", ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", F.round("last_mean", 6).alias("last_mean"), "last_max")


def ops1_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.rate_limit(_events(spark, sf_dir), 2, 86400, "user_id").select("event_id", "accepted", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


def ops2_two_level_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.two_level_limit(_events(spark, sf_dir), 2, 86400, 10, "user_id")


def ops3_calendar_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.calendar_budget(_events(spark, sf_dir), 200, 3000).select("event_id", "accepted")


def ops3_deep_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = _events(spark, sf_dir).withColumn("deep", F.col("event_type") == "purchase")
    return events.deep_budget(deep, {"daily": 200, "monthly": 3000, "daily_deep": 30, "monthly_deep": 500}).select("event_id", "accepted")


def ops6_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.snapshot(_events(spark, sf_dir))


def ops6_merged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, gauges and percentiles of half a month from the summaries of its hours; percentiles as whether their ranks are within the sketch's bound."""
    e = _events(spark, sf_dir)
    since, until = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    shot = events.merged_snapshot(events.window_summaries(e, 3600), since, until)
    error = events.rank_error(e.filter((F.col("ts") >= since) & (F.col("ts") < until)), shot).agg(F.max("error")).first()[0]
    statuses = F.array_join(F.transform(F.map_entries("by_status"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return shot.select("requests_total", "errors_total", statuses.alias("by_status"), "latency_count", "max_latency", "last_request_at", F.lit(error <= 0.0266).alias("percentiles_within_bound"))


def evl8_strategy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, dense and hybrid retrieval at three dimensions against the gold labels; texts and vectors are read once for all."""
    q = t(spark, sf_dir, "embeddings").join(t(spark, sf_dir, "benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    lex = stored(_bm25(spark, sf_dir, 100), "lexical")
    den = stored(dense.search_dimensions(q, vectors(spark, sf_dir), [16, 32, 64], 100), "dense")
    grid = evaluation.strategy_grid(lex, den, _gold(spark, sf_dir), [16, 32, 64])
    return grid.withColumn("value", F.round("value", 6))


def ops7_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    user = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string"))
    header = F.when(F.col("user_id") % 3 == 1, F.concat_ws(", ", F.col("user_id").cast("string"), F.lit("proxy")))
    session = F.when(F.col("event_id") % 2 == 0, F.col("props"))
    return e.select("event_id", events.identity(user, [header], F.lit(None).cast("string"), session, "salt").alias("identity"))


def agg9_percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(*(evaluation.percentile_nearest("value", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)))


def agg10_percentile_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.percentile_rounded_table(_events(spark, sf_dir), ["event_type"], "value", (0.5, 0.95, 0.99))


def agg11_percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(*(F.round(evaluation.percentile_linear("value", p), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.95)))


def agg12_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency_summary(_events(spark, sf_dir), "value")


def agg13_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of query q: labelled documents with doc_id = q modulo 40; required if of good quality, else helpful."""
    items = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m"))
    labels = t(spark, sf_dir, "labels").filter("quality IS NOT NULL").select(F.col("doc_id").alias("chunk_ord"), (F.col("doc_id") % 40).alias("m"), (F.col("quality") + 1).alias("gain"))
    return items.join(labels, "m").drop("m")


def evl1_recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.retrieval_metrics(_bm25(spark, sf_dir), _gold(spark, sf_dir))
    return m.select(F.col("query_id").alias("item_id"), *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


def evl7_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluation.mean_metrics(evaluation.retrieval_metrics(_bm25(spark, sf_dir), _gold(spark, sf_dir)))
    limits = spark.createDataFrame([("recall", 0.95), ("mrr", 0.001), ("ndcg", 0.6), ("latency", 1.0)], "metric string, threshold double")
    return evaluation.gate(means.withColumn("value", F.round("value", 6)), limits)


def evl2_latency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies of every kind of event as an evaluation reports those of its axes."""
    return evaluation.latency_metrics(_events(spark, sf_dir), "event_type", "value").withColumn("value", F.round("value", 6))


def evl3_micro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents"), "doc_id")
    right = (F.col("quality") == 1).cast("int")
    return both.groupBy("lang").agg(F.round(evaluation.micro_accuracy(right, F.lit(1)), 6).alias("accuracy"))


def src19_counts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts_by(chunks(spark, sf_dir).withColumn("key", F.when(F.col("chunk_ord") % 5 > 0, F.col("title"))), "key")


def src8_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.matches(t(spark, sf_dir, "labels"), t(spark, sf_dir, "documents"), "doc_id")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") + 1).alias("position"), F.concat(F.lit("p"), (F.col("doc_id") % 700).cast("string")).alias("path"), F.when(F.col("doc_id") % 11 > 0, "open").alias("license"),
        F.when(F.col("doc_id") % 13 > 0, "primary").otherwise("").alias("trust_tier"), F.col("lang").alias("namespace"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 2 == 0).alias("ingest"),
    )


def src2_manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.validate(_manifest(spark, sf_dir))


def src4_manifest_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "documents").select(
        F.concat(F.when(F.col("doc_id") % 10 == 0, "corpus/routing/").otherwise("corpus/"), "lang", F.lit("/"), F.when(F.col("doc_id") % 25 == 0, "README").otherwise(F.concat(F.lit("my_file-"), F.col("doc_id").cast("string"))), F.lit(".md")).alias("path")
    )
    return manifest.generate(p, {"de": "german", "fr": "french"}).withColumn("section_tags", F.array_join("section_tags", ","))


#: Names of files and folders that the manifest's rules look at.
FOLDERS, FILES = ("routing", "report", "curated", "vendor_docs"), ("README", "cost_model", "sources", "FULL_REPORT", "chunk-retrieval_notes", "readme_reference", "router")


def src4_manifest_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents as files under folders and names of all kinds; each fourth has a heading."""
    i = F.col("doc_id")
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (F.floor(i / by) % len(names)).cast("int"))
    path = F.when(i % 50 == 7, "corpus/README.md").otherwise(F.concat_ws("/", F.lit("corpus"), pick(FOLDERS, 1), "source", F.concat(pick(FILES, 3), F.when(i % 4 > 1, i.cast("string")).otherwise(""), F.lit(".md"))))
    text = F.concat(F.when(i % 4 == 0, F.concat(F.lit("\n# Title of "), "lang", F.lit(" \n"))).otherwise(""), F.substring("source", 1, 3))
    files = t(spark, sf_dir, "documents").select(path.alias("path"), text.alias("text"))
    made = manifest.describe(files, "corpus", {"src3": "three"}, "open", "2026-01-01").withColumn("section_tags", F.array_join("section_tags", ",")).drop("source_url")
    return made.groupBy(*made.columns).agg(F.count("*").alias("n"))


def src3_manifest_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.by_path(_manifest(spark, sf_dir)).select("path", "position")


def flt6_ingestible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.ingestible(_manifest(spark, sf_dir)).select("position", "path")


def src7_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.md5(F.col("vec_id").cast("string")).alias("content_hash"))
    want = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5((F.col("doc_id") - F.col("doc_id") % 2).cast("string")).alias("content_hash"))
    return store.missing_vectors(want, have).select(F.col("chunk_id").alias("doc_id"))


def rel1_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def rel2_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, o, li = (t(spark, sf_dir, x) for x in ("nation", "customer", "orders", "lineitem"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def rel3_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def rel4_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        win9_sliding_counts, ops4_spikes, ops5_alerts, win10_last_n, ops1_rate_limit, ops2_two_level_limit, ops3_calendar_budget, ops3_deep_budget, ops6_snapshot, ops6_merged_snapshot, evl8_strategy_grid, ops7_identity,
        agg9_percentile_nearest, agg10_percentile_rounded, agg11_percentile_linear, agg12_latency_summary, agg13_status_counts, evl1_recall_mrr_ndcg, evl7_gate,
        evl2_latency_metrics, evl3_micro_accuracy, src19_counts_by, src8_table_match, src2_manifest_validate, src4_manifest_generate, src4_manifest_described, src3_manifest_by_path, flt6_ingestible, src7_missing_vectors,
        rel1_pricing_summary, rel2_revenue_by_nation, rel3_rollup, rel4_session_windows,
    )
}

_RANGE = "RANGE BETWEEN INTERVAL {0} SECONDS PRECEDING AND CURRENT ROW"
SPIKES = f"spikes AS (SELECT *, count(*) OVER (ORDER BY ts {_RANGE.format(WINDOW_S)}) AS window_count FROM events)"
GOLD = "gold AS (SELECT item_id AS query_id, doc_id, quality + 1 AS gain FROM benchmark JOIN labels ON doc_id % 40 = item_id % 40 WHERE quality IS NOT NULL)"
METRICS = f"""{BM25}, top AS ({_top('bm', 10, 'doc_id')}), {GOLD},
hits AS (SELECT query_id, count(*) FILTER (gain = 2) AS hit, min(rank) FILTER (gain = 2) AS first, sum(gain / log2(rank + 1.0)) AS dcg FROM top JOIN gold USING (query_id, doc_id) GROUP BY query_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM gold),
ideal AS (SELECT query_id, count(*) FILTER (gain = 2) AS required, sum(gain / log2(place + 1.0)) FILTER (place <= 10) AS ideal FROM placed GROUP BY query_id),
per AS (SELECT query_id, CASE WHEN required > 0 THEN coalesce(hit, 0) / required ELSE 1.0 END AS recall, coalesce(1.0 / first, 0.0) AS mrr, coalesce(dcg / ideal, 0.0) AS ndcg FROM ideal LEFT JOIN hits USING (query_id))"""
MANIFEST = """m AS (SELECT doc_id + 1 AS position, 'p' || (doc_id % 700) AS path, CASE WHEN doc_id % 11 > 0 THEN 'open' END AS license, CASE WHEN doc_id % 13 > 0 THEN 'primary' ELSE '' END AS trust_tier,
lang AS namespace, CASE WHEN doc_id % 4 > 0 THEN doc_id % 2 = 0 END AS ingest FROM documents)"""

_LIVE = "list_filter(s.kept, lambda k: k >= e.t - 86400000000)"
RATE_LIMIT = f"""
WITH g AS (SELECT user_id, list({{'t': epoch_us(ts), 'id': event_id}} ORDER BY ts, event_id) AS es FROM events GROUP BY user_id),
f AS (SELECT list_reduce(list_prepend({{'t': 0::BIGINT, 'id': 0::BIGINT, 'kept': []::BIGINT[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN, wait INTEGER)[]}},
    list_transform(es, lambda x: {{'t': x.t, 'id': x.id, 'kept': []::BIGINT[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN, wait INTEGER)[]}})),
  lambda s, e: {{'t': e.t, 'id': e.id, 'kept': CASE WHEN len({_LIVE}) < 2 THEN list_append({_LIVE}, e.t) ELSE {_LIVE} END,
    'out': list_append(s.out, {{'id': e.id, 'ok': len({_LIVE}) < 2, 'wait': CASE WHEN len({_LIVE}) < 2 THEN NULL ELSE greatest(1, trunc(86400 - (e.t - list_min({_LIVE})) / 1000000.0)::INT) END}})}}).out AS o FROM g),
r AS (SELECT unnest(o) AS x FROM f) SELECT x.id AS event_id, x.ok AS accepted, coalesce(x.wait, 0) AS retry_after FROM r"""

ORACLE_SQL = {
    "ops1_rate_limit": RATE_LIMIT,
    "win9_sliding_counts": f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts {_RANGE.format(86400)}) AS window_count FROM events",
    "ops4_spikes": f"WITH {SPIKES} SELECT event_id, window_count, window_count >= {SPIKE} AS is_spike FROM spikes",
    "ops5_alerts": f"WITH {SPIKES} SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'failed_call' END, CASE WHEN value >= {SLOW} THEN 'slow_call' END, CASE WHEN window_count >= {SPIKE} THEN 'traffic_spike' END) AS reasons FROM spikes",
    "win10_last_n": "SELECT event_id, round(avg(value) OVER w, 6) AS last_mean, max(value) OVER w AS last_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "ops2_two_level_limit": """
WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
own AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS event_id, NULL::BIGINT AS t, false AS ok FROM e
  UNION ALL SELECT user_id, n, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, event_id, t, len(live) < 2
  FROM (SELECT e.*, list_filter(own.kept, lambda x: x >= e.t - 86400000000) AS live FROM own JOIN e ON e.user_id = own.user_id AND e.n = own.n + 1)),
passed AS MATERIALIZED (SELECT event_id, t, row_number() OVER (ORDER BY t, event_id) AS n FROM own WHERE ok),
total AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS event_id, false AS ok
  UNION ALL SELECT n, CASE WHEN len(live) < 10 THEN list_append(live, t) ELSE live END, event_id, len(live) < 10
  FROM (SELECT p.*, list_filter(total.kept, lambda x: x >= p.t - 86400000000) AS live FROM total JOIN passed p ON p.n = total.n + 1))
SELECT own.event_id, own.ok AS own_ok, coalesce(total.ok, false) AS accepted FROM own LEFT JOIN total ON own.event_id = total.event_id WHERE own.event_id IS NOT NULL""",
    "ops3_deep_budget": """
WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m') AS m, (event_type = 'purchase')::INT AS deep, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT 0::BIGINT AS n, '' AS d, '' AS m, 0 AS a, 0 AS b, 0 AS c, 0 AS e, NULL::BIGINT AS event_id, false AS ok
  UNION ALL SELECT n, d, m, a + ok::INT, b + ok::INT, c + ok::INT * deep, e + ok::INT * deep, event_id, ok
  FROM (SELECT *, a < 200 AND b < 3000 AND (deep = 0 OR (c < 30 AND e < 500)) AS ok
    FROM (SELECT e.n, e.d, e.m, e.deep, e.event_id, CASE WHEN e.d = r.d THEN r.a ELSE 0 END AS a, CASE WHEN e.m = r.m THEN r.b ELSE 0 END AS b, CASE WHEN e.d = r.d THEN r.c ELSE 0 END AS c, CASE WHEN e.m = r.m THEN r.e ELSE 0 END AS e
      FROM r JOIN e ON e.n = r.n + 1)))
SELECT event_id, ok AS accepted FROM r WHERE event_id IS NOT NULL""",
    "ops3_calendar_budget": """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dn FROM events),
m AS (SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS mn FROM d WHERE dn <= 200)
SELECT d.event_id, dn <= 200 AND coalesce(mn <= 3000, false) AS accepted FROM d LEFT JOIN m USING (event_id)""",
    "ops6_snapshot": "SELECT count(*) AS requests_total, count(*) FILTER (event_type = 'error') AS errors_total, max(ts) AS last_request_at, round(max(value), 2) AS max_latency FROM events",
    "ops6_merged_snapshot": """
WITH e AS (SELECT * FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20'), s AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1)
SELECT count(*) AS requests_total, count(*) FILTER (event_type = 'error') AS errors_total, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM s) AS by_status, count(value) AS latency_count, round(max(value), 2) AS max_latency, max(ts) AS last_request_at, true AS percentiles_within_bound FROM e""",
    "evl8_strategy_grid": f"""
WITH {BM25}, lex AS ({_top('bm', 100, 'doc_id')}), {', '.join(_dense_sql(f'd{d}', 100, d, queries='vec_id IN (SELECT item_id FROM benchmark)') for d in (16, 32, 64))}, {GOLD},
rankings AS (SELECT 'lexical' AS strategy, 0::INT AS dimension, query_id, doc_id AS id, rank FROM lex {' '.join(f"UNION ALL SELECT 'dense', {d}, query_id, vec_id, rank FROM d{d}" for d in (16, 32, 64))}),
parts AS (SELECT unnest([16, 32, 64]) AS dimension, query_id, id, 1.0 / (60 + rank) AS s, 0 AS l, rank FROM rankings WHERE strategy = 'lexical' UNION ALL SELECT dimension, query_id, id, 1.0 / (60 + rank), 1, rank FROM rankings WHERE strategy = 'dense'),
fused AS (SELECT dimension, query_id, id, round(sum(s), 12) AS score, min((l, rank)) AS place FROM parts GROUP BY ALL),
cells AS (SELECT * FROM rankings UNION ALL SELECT 'hybrid', dimension, query_id, id, row_number() OVER (PARTITION BY dimension, query_id ORDER BY score DESC, place) FROM fused),
hits AS (SELECT strategy, dimension, cells.query_id, count(*) FILTER (gain = 2) AS hit, min(rank) FILTER (gain = 2) AS first, sum(gain / log2(rank + 1.0)) AS dcg FROM cells JOIN gold ON gold.query_id = cells.query_id AND gold.doc_id = cells.id WHERE rank <= 10 GROUP BY strategy, dimension, cells.query_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM gold),
ideal AS (SELECT query_id, count(*) FILTER (gain = 2) AS required, sum(gain / log2(place + 1.0)) FILTER (place <= 10) AS ideal FROM placed GROUP BY query_id),
configs AS (SELECT DISTINCT strategy, dimension FROM cells),
per AS (SELECT strategy, dimension, CASE WHEN required > 0 THEN coalesce(hit, 0) / required ELSE 1.0 END AS recall, coalesce(1.0 / first, 0.0) AS mrr, coalesce(dcg / ideal, 0.0) AS ndcg FROM configs CROSS JOIN ideal LEFT JOIN hits USING (strategy, dimension, query_id)),
means AS (SELECT strategy, dimension, avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM per GROUP BY ALL)
SELECT strategy, dimension, metric, round(value, 6) AS value FROM (UNPIVOT means ON recall, mrr, ndcg INTO NAME metric VALUE value)""",
    "ops7_identity": """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'user:' || sha256('salt:' || user_id)[:20] WHEN user_id % 3 = 1 THEN 'ip:' || sha256('salt:' || user_id)[:20]
  WHEN event_id % 2 = 0 THEN 'session:' || sha256('salt:' || props)[:20] ELSE 'anonymous:unknown' END AS identity FROM events""",
    "agg9_percentile_nearest": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
    "agg10_percentile_rounded": """
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(max(value) FILTER (i = round_even((n - 1) * 0.5::DOUBLE, 0)), 2) AS p50, round(max(value) FILTER (i = round_even((n - 1) * 0.95::DOUBLE, 0)), 2) AS p95,
  round(max(value) FILTER (i = round_even((n - 1) * 0.99::DOUBLE, 0)), 2) AS p99 FROM o GROUP BY 1""",
    "agg11_percentile_linear": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "agg12_latency_summary": "SELECT round(avg(value), 2) AS mean, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.9), 2) AS p90, round(quantile_disc(value, 0.95), 2) AS p95, round(quantile_disc(value, 0.99), 2) AS p99, round(max(value), 2) AS max FROM events",
    "agg13_status_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "evl1_recall_mrr_ndcg": f"WITH {METRICS} SELECT query_id AS item_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM per",
    "evl7_gate": f"""
WITH {METRICS}, means AS (SELECT unnest(['recall', 'mrr', 'ndcg']) AS metric, unnest([avg(recall), avg(mrr), avg(ndcg)]) AS value FROM per),
limits(metric, threshold) AS (VALUES ('recall', 0.95), ('mrr', 0.001), ('ndcg', 0.6), ('latency', 1.0))
SELECT metric, threshold::DOUBLE AS threshold, round(value, 6) AS value, coalesce(round(value, 6) >= threshold, false) AS passed FROM limits LEFT JOIN means USING (metric)""",
    "evl3_micro_accuracy": "SELECT lang, round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "src19_counts_by": "SELECT coalesce(CASE WHEN doc_id % 5 > 0 THEN source END, 'unknown') AS key, count(*) AS count FROM documents GROUP BY 1",
    "src8_table_match": """
WITH n AS (SELECT (SELECT count(*) FROM labels) AS n_stored, (SELECT count(*) FROM documents) AS n_chunks,
  (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra)
SELECT *, n_stored = n_chunks AND missing = 0 AND extra = 0 AS matches FROM n""",
    "src2_manifest_validate": f"""
WITH {MANIFEST} SELECT position, 'missing license' AS error FROM m WHERE license IS NULL UNION ALL SELECT position, 'missing trust_tier' FROM m WHERE trust_tier = ''
UNION ALL SELECT position, 'duplicate path ' || path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY position) AS n FROM m) WHERE n > 1""",
    "src4_manifest_generate": """
WITH p AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'corpus/routing/' ELSE 'corpus/' END || lang || '/' || CASE WHEN doc_id % 25 = 0 THEN 'README' ELSE 'my_file-' || doc_id END || '.md' AS path,
  CASE lang WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'general' END AS domain FROM documents)
SELECT path, CASE WHEN doc_id % 25 = 0 THEN 'Readme' ELSE 'My File ' || doc_id END AS title, CASE WHEN doc_id % 10 = 0 THEN 'routing' ELSE 'knowledge' END AS namespace,
  CASE WHEN doc_id % 10 = 0 THEN 'routing-card' ELSE 'research-bundle' END AS content_kind, domain, array_to_string(list_sort([lang, domain]), ',') AS section_tags, doc_id % 25 <> 0 AS ingest FROM p""",
    "src4_manifest_described": f"""
WITH p AS (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 7 THEN 'corpus/README.md' ELSE 'corpus/' || ({list(FOLDERS)})[1 + doc_id % {len(FOLDERS)}] || '/' || source || '/' || ({list(FILES)})[1 + (doc_id // 3) % {len(FILES)}] || CASE WHEN doc_id % 4 > 1 THEN doc_id::VARCHAR ELSE '' END || '.md' END AS path FROM documents),
q AS (SELECT *, string_split(path[8:], '/') AS parts FROM p), r AS (SELECT *, parts[1] AS a, parts[2] AS b, parts[-1] AS name, regexp_replace(parts[-1], '\\.md$', '') AS stem, lower(path) AS low FROM q),
s AS (SELECT *, CASE a WHEN 'routing' THEN 'routing' WHEN 'report' THEN 'implementation' ELSE CASE coalesce(b, 'general') WHEN 'src3' THEN 'three' ELSE coalesce(b, 'general') END END AS domain, CASE a WHEN 'routing' THEN 'routing-card' WHEN 'report' THEN 'implementation-spec' ELSE 'research-bundle' END AS content_kind,
  NOT (upper(name) IN {manifest.REPEATING} OR path = 'corpus/README.md') AS ingest FROM r)
SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'Title of ' || lang ELSE array_to_string(list_transform(string_split(translate(stem, '_-', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title,
  CASE a WHEN 'routing' THEN 'routing' ELSE 'knowledge' END AS namespace, content_kind, domain, 'open' AS license, CASE WHEN NOT starts_with(lower(name), 'readme') AND len(list_filter({list(manifest.PRIMARY)}, lambda w: contains(stem, w))) > 0 THEN 'primary' ELSE 'reputable' END AS trust_tier,
  CASE WHEN len(list_filter({list(manifest.VOLATILE)}, lambda w: contains(low, w))) > 0 THEN 'volatile' ELSE 'stable' END AS volatility, 'consensus' AS contested, array_to_string(list_sort(list_distinct(list_concat([domain, content_kind], list_filter({list(manifest.TAG_WORDS)}, lambda w: contains(low, w))))), ',') AS section_tags,
  '2026-01-01' AS date, ingest, CASE WHEN ingest THEN '' ELSE 'Excluded duplicate combined report.' END AS notes, count(*) AS n FROM s GROUP BY ALL""",
    "evl2_latency_metrics": """
WITH m AS (SELECT event_type, avg(value) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY 1)
SELECT event_type || '_latency_ms_' || name AS metric, round(value, 6) AS value FROM (UNPIVOT m ON mean, p50, p90, p95, p99, max INTO NAME name VALUE value)""",
    "src3_manifest_by_path": f"WITH {MANIFEST} SELECT path, max(position) AS position FROM m GROUP BY path",
    "flt6_ingestible": f"WITH {MANIFEST} SELECT position, path FROM m WHERE coalesce(ingest, true)",
    "src7_missing_vectors": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = d.doc_id AND md5(vec_id::VARCHAR) = md5((d.doc_id - d.doc_id % 2)::VARCHAR))",
    "rel1_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "rel2_revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "rel3_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "rel4_session_windows": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
}
