"""Registered queries over stored indexes: inverted files of vectors, and postings in segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.plan import shared_dir, stored
from corvane.operators import dense, inverted, ivf, maxsim
from corvane.plans import retrieval
from corvane.plans.common import chunks, query_vectors, questions, t, vectors
from corvane.sources.collection import Alias, Collection, EmbeddingCache
from corvane.plans.retrieval import _hits, _named

EVERY_CELL = 1 << 30


def ret19_ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted file that is probed in all its cells, each vector scored: the exact ranking."""
    index = ivf.build(vectors(spark, sf_dir))
    return _hits(ivf.nearest_rows(query_vectors(spark, sf_dir), index, 10, probes=EVERY_CELL, oversample=None).withColumn("score", F.round("score", 6)))


def ret19_ivf_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ivf.build(vectors(spark, sf_dir), cells=16)
    return _hits(ivf.nearest_rows(query_vectors(spark, sf_dir), index, 10, "l2", EVERY_CELL, None).withColumn("score", F.round("score", 6)))


def ret20_ivf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ivf.build(vectors(spark, sf_dir), cells=16)
    return _hits(ivf.nearest_rows(query_vectors(spark, sf_dir), index, 10, "cosine", EVERY_CELL, None, filters={"namespace": "3"}).withColumn("score", F.round("score", 6)))


def ret20_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether as many probes and candidates as calibration asks for find 0.95 of what exact search finds, over all queries."""
    queries, all_vectors = query_vectors(spark, sf_dir), vectors(spark, sf_dir)
    index = ivf.build(all_vectors)
    exact = stored(dense.search(queries, all_vectors, 10), "exact")
    _, _, got = ivf.calibrate_all(index, queries, exact, 10, 0.97)
    return queries.agg(F.count("*").alias("queries")).withColumns({"top_k": F.lit(10), "enough": F.lit(got >= 0.95)})


def stale(found: DataFrame) -> DataFrame:
    """Chunks as an index had them before: some with other texts, some missing, and some that are gone by now."""
    i = F.col("chunk_ord")
    before = found.filter(i % 7 != 5).select("chunk_ord", F.when(i % 3 == 0, F.concat_ws(" ", "title", F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    return before.unionByName(found.filter(i % 11 == 4).select((-1 - i).alias("chunk_ord"), "text"))


def ret12_stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ret4_bm25_topk from an index that was built of older texts and updated with what has changed since."""
    found = chunks(spark, sf_dir)
    old = stale(found)
    gone = old.filter("chunk_ord < 0").select("chunk_ord")
    index = inverted.build(old).update(found.select("chunk_ord", "text"), gone)
    return _named(index.search(questions(spark, sf_dir), 10))


def ret12_compacted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the segments merged into one."""
    found = chunks(spark, sf_dir)
    old = stale(found)
    index = inverted.build(old).update(found.select("chunk_ord", "text"), old.filter("chunk_ord < 0").select("chunk_ord")).compact()
    return _named(index.search(questions(spark, sf_dir), 10))


#: Embeddings whose ids have the same tens are the token vectors of an item.
TOKENS = 10


def ret24_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items (ten embeddings each) by late interaction: candidates of a query's first vector among all items' first vectors."""
    all_vectors = vectors(spark, sf_dir)
    item = F.floor(F.col("chunk_ord") / TOKENS).cast("long")
    items = all_vectors.groupBy(item.alias("chunk_ord")).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_ord").alias("n"), "vector"))).alias("all")).select("chunk_ord", F.col("all.vector").alias("tokens"))
    firsts = all_vectors.filter(F.col("chunk_ord") % TOKENS == 0).withColumn("chunk_ord", item)
    queries = items.filter("chunk_ord % 10 = 0").select(F.col("chunk_ord").alias("query_id"), "tokens")
    heads = firsts.filter("chunk_ord % 10 = 0").select(F.col("chunk_ord").alias("query_id"), "vector")
    found = maxsim.rerank(dense.search(heads, firsts, 20), queries, items, 8)
    return found.select("query_id", F.col("chunk_ord").alias("item"), "score", F.col("rank").cast("long").alias("rank"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{name}-{spark._jvm.java.util.UUID.randomUUID()}"


def src7_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose vectors a cache lacks after two thirds of the documents changed nothing and one third did."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    cache = EmbeddingCache(spark, _folder(spark, "cache"), "a/model", 2)

    def encode(lacking: DataFrame) -> DataFrame:
        return lacking.select("digest", F.array(F.length("text").cast("float"), F.ascii("text").cast("float")).alias("vector"))

    before = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    cache.vectors(before, encode).agg(F.count("*")).collect()
    now = cache.vectors(docs, encode)
    return now.select("doc_id", "digest", "computed", F.col("vector")[0].cast("double").alias("first"), F.col("vector")[1].cast("double").alias("second"))


def src9_collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of embeddings after two upserts (the second replayed), shown through an alias that a damaged plan did not move."""
    rows = t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("first"))
    guard = {"model": "m", "dimension": 64}
    collection = Collection(spark, _folder(spark, "collection"), "vec_id").upsert(rows.filter("vec_id % 2 = 0"), guard, 0)
    alias = Alias(spark, _folder(spark, "alias"))
    alias.promote(collection, rows.filter("vec_id % 2 = 0"))
    changed = rows.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    later = collection.upsert(changed, guard, 1, deleted=rows.filter("vec_id % 10 = 4").select("vec_id"))
    again = Collection(spark, later.root, "vec_id").upsert(changed, guard, 1)
    assert again.number == later.number
    try:
        alias.promote(again, rows)
    except ValueError:
        pass
    assert alias.target().number == collection.number
    alias.promote(again)
    return alias.read()


QUERIES = {
    f.__name__: f
    for f in (ret19_ivf_full_probe, ret19_ivf_l2, ret20_ivf_filtered, ret20_ivf_recall, ret12_stored_index_topk, ret12_compacted_topk, ret24_maxsim, src7_embedding_cache, src9_collection_upsert)
}

ORACLE_SQL = {
    "ret19_ivf_full_probe": retrieval.ORACLE_SQL["ret18_dense_topk"],
    "ret19_ivf_l2": retrieval.ORACLE_SQL["ret19_l2_topk"],
    "ret20_ivf_filtered": retrieval.ORACLE_SQL["flt2_filtered_dense_topk"],
    "ret20_ivf_recall": "SELECT count(*) AS queries, 10::INT AS top_k, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    "ret12_stored_index_topk": retrieval.ORACLE_SQL["ret4_bm25_topk"],
    "ret12_compacted_topk": retrieval.ORACLE_SQL["ret4_bm25_topk"],
    "ret24_maxsim": """
WITH u AS (SELECT vec_id // 10 AS item, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
f AS (SELECT item, v FROM u WHERE vec_id % 10 = 0),
pool AS (SELECT a.item AS q, b.item, row_number() OVER (PARTITION BY a.item ORDER BY round(list_dot_product(a.v, b.v), 9) + 0.0 DESC, b.item) AS n FROM f a, f b WHERE a.item % 10 = 0 QUALIFY n <= 20),
best AS (SELECT q, pool.item, a.vec_id, max(list_dot_product(a.v, b.v)) AS m FROM pool JOIN u a ON a.item = q JOIN u b ON b.item = pool.item GROUP BY ALL),
s AS (SELECT q AS query_id, item, round(sum(m), 6) + 0.0 AS score FROM best GROUP BY ALL)
SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 8""",
    "src7_embedding_cache": """
WITH known AS (SELECT DISTINCT sha256(coalesce(CASE WHEN doc_id % 3 = 1 THEN text || ' old' ELSE text END, '')) AS digest FROM documents)
SELECT doc_id, sha256(coalesce(text, '')) AS digest, sha256(coalesce(text, '')) NOT IN (SELECT digest FROM known) AS computed, length(coalesce(text, ''))::DOUBLE AS first, ascii(coalesce(text, ''))::DOUBLE AS second FROM documents""",
    "src9_collection_upsert": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, embedding[1] AS first FROM embeddings WHERE (vec_id % 2 = 0 OR vec_id % 3 = 0) AND (vec_id % 10 <> 4 OR false)",
}
