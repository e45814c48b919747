"""Rankings that tasks cut to the best rows, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import dense, ivf, lexical
from corvane.plans import judging, retrieval

WORDS = "policy policies class pass the of rank index 9.5s a.b tree trees query hybrid".split()


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "No_Token-Here/İ"]) if i % 13 == 5 else " ".join(rng.choices(WORDS, k=rng.randrange(1, 30))) if i % 4 else "the same policies for all trees") for i in range(n)]


@pytest.mark.parametrize("held", [None, 40])
def test_bm25_topk_is_the_ranking_of_all_pairs(spark, monkeypatch, held):
    if held:  # several blocks of queries
        monkeypatch.setattr(lexical, "QUERY_CELLS", held)
    chunks = spark.createDataFrame(texts(1, 300), "chunk_ord long, text string").repartition(5)
    queries = lexical.query_features(spark.createDataFrame([(f"q{i}", t) for i, t in texts(2, 25)], "query_id string, query string"))
    want = lexical.ranked(lexical.bm25(queries, chunks).select("query_id", "chunk_ord", F.round("bm25", 6).alias("score")), 7)
    got = lexical.bm25_topk(queries, chunks, 7)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    some = chunks.filter("chunk_ord % 3 = 1").select("chunk_ord")
    want = lexical.ranked(lexical.bm25(queries, chunks).join(some, "chunk_ord", "left_semi").select("query_id", "chunk_ord", F.round("bm25", 6).alias("score")), 7)
    assert sorted(map(tuple, lexical.bm25_topk(queries, chunks, 7, only=some).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert lexical.bm25_topk(queries.limit(0), chunks, 7).count() == lexical.bm25_topk(queries, chunks.limit(0), 7).count() == 0


@pytest.mark.parametrize("query", [judging.evd7_research, judging.evd1_fan_out, retrieval.ret4_bm25_topk, retrieval.ret6_field_boosts, retrieval.flt1_namespace_search, retrieval.ret11_lexical_search])
def test_rankings_make_no_pairs(spark, monkeypatch, query):
    def pairs(*_):
        raise AssertionError("all pairs of queries and chunks")

    monkeypatch.setattr(lexical, "bm25", pairs)
    got = query(spark, "/root/testdata/sf0.001")
    assert got.count() and ("status" not in got.columns or got.filter("status = 'ok'").count())


def test_results_take_texts_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table were short
    try:
        found = judging._results(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        want = retrieval._bm25(spark, "/root/testdata/sf0.001", judging.FEW).select("query_id", "chunk_ord", "rank")
        assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_qualities_meet_the_ranking_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table were short
    try:
        found = judging._qualities(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select(F.col("doc_id").alias("chunk_ord"), "quality")
        want = retrieval._bm25(spark, "/root/testdata/sf0.001", judging.FEW).join(labels, "chunk_ord", "left").select(found.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_dense_search_pairs_only_odd_vectors(spark, monkeypatch, metric):
    rng = random.Random(3)
    odd = {3: None, 4: [0.0] * 6, 5: [math.nan] + [1.0] * 5, 6: [1.0, 2.0], 7: [math.inf] + [1.0] * 5, 8: [None] + [1.0] * 5, 11: None, 12: [math.nan] * 6}
    rows = [(i, odd[i] if i in odd else [float(rng.randrange(-2, 3)) for _ in range(6)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "chunk_ord long, vector array<double>")
    queries = vectors.filter("chunk_ord % 20 = 0 OR chunk_ord IN (3, 4, 5, 6, 7)").withColumnRenamed("chunk_ord", "query_id")
    plain, seen = dense.paired, []

    def paired(q, v, n):
        seen.append((q.count(), v.count()))
        return plain(q, v, n)

    q, v = dense.prepare(queries).withColumnRenamed("vector", "query_vector"), dense.prepare(vectors)
    score = -dense.V.squared_distance(F.col("query_vector"), F.col("vector")) if metric == "l2" else dense.V.dot(F.col("query_vector"), F.col("vector"))
    for k in (3, 1000):
        want = lexical.ranked(plain(q, v, 6).select("query_id", "chunk_ord", (F.round(score, 9) + 0.0).alias("score")), k)
        monkeypatch.setattr(dense, "paired", paired)
        got = dense.search(queries, vectors, k, metric)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert all(b <= k or a <= 5 for a, b in seen)


@pytest.mark.parametrize("query", [judging.evl1_evidence_metrics, judging.win7_claimed_gains])
def test_metrics_of_rankings_make_no_pairs(spark, monkeypatch, query):
    def pairs(*_):
        raise AssertionError("all pairs of queries and chunks")

    monkeypatch.setattr(lexical, "bm25", pairs)
    assert query(spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("query", [retrieval.ret15_matryoshka_topk_32, retrieval.ret18_dense_topk])
def test_registered_dense_rankings_pair_no_sound_vectors(spark, monkeypatch, query):
    plain = dense.paired

    def paired(q, v, n):
        assert v.count() == 0 or q.count() == 0, "all pairs of queries and vectors"
        return plain(q, v, n)

    monkeypatch.setattr(dense, "paired", paired)
    assert query(spark, "/root/testdata/sf0.001").count()
