"""Stored indexes against exact search, on changed texts and on odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dense, inverted, ivf, lexical
from corvane.plans import stores
from corvane.sources.versions import Conflict, Versions

WORDS = "the cat sat on a mat and dog ran over hill with sun moon star river tree house stone bird fish".split()


def vector_table(spark, x, names=None):
    return spark.createDataFrame([(i, v.tolist(), str(i % 4)) for i, v in enumerate(x)], "chunk_ord bigint, vector array<float>, namespace string")


def same(a, b):
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_ord, round(r.score, 6)) for r in df.collect())
    assert rows(a) == rows(b)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    return (centres[rng.integers(40, size=3000)] + rng.normal(size=(3000, 24)) * 0.4).astype(np.float32)


def test_ivf_with_all_cells_is_exact(spark, clustered):
    vectors = vector_table(spark, clustered)
    queries = vectors.filter("chunk_ord % 300 = 0").select(F.col("chunk_ord").alias("query_id"), "vector")
    index = ivf.build(vectors, cells=12)
    assert index.manifest["cells"] == 12 and index.blocks.select(F.sum(F.size("ids"))).first()[0] == 3000
    for metric in ("dot", "l2"):
        same(ivf.nearest_rows(queries, index, 10, metric, 99, None), dense.search(queries, vectors, 10, metric))
    same(ivf.nearest_rows(queries, index, 10, "cosine", 99, None, filters={"namespace": "2"}), dense.search(queries, vectors, 10, "cosine", filters={"namespace": "2"}))


def test_ivf_probes_find_nearly_all(spark, clustered, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ivf, "GROUP_QUERIES", 7)
    vectors = vector_table(spark, clustered)
    queries = vectors.filter("chunk_ord % 100 = 0").select(F.col("chunk_ord").alias("query_id"), "vector")
    index = ivf.build(vectors, cells=32)
    assert index.blocks.count() > 40
    probes, reached = ivf.calibrate(index, queries, vectors, 10, 0.95)
    found = ivf.nearest_rows(queries, index, 10, probes=probes)
    assert reached >= 0.95 and probes < 32 and ivf.recall(found, dense.search(queries, vectors, 10)) >= 0.95
    best = found.filter("rank = 1").collect()
    assert len(best) == 30 and all(r.query_id == r.chunk_ord and r.score == 1.0 for r in best)
    plan = index.blocks.filter("cell = 3").select("codes")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "components" not in plan.split("ReadSchema")[1]


def test_ivf_recall_where_codes_are_too_coarse(spark, tmp_path):
    """Vectors without clusters, which codes tell apart badly."""
    x = np.random.default_rng(5).normal(size=(6000, 64)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in stores.ret20_ivf_recall(spark, str(tmp_path)).collect()] == [(60, 10, True)]
    queries, vectors = stores.query_vectors(spark, str(tmp_path)), stores.vectors(spark, str(tmp_path))
    index, exact = ivf.build(vectors), dense.search(queries, vectors, 10)
    assert ivf.calibrate_all(index, queries, exact, 10, 1.0, most=5)[2] == 1.0


def test_ivf_filters_take_more_candidates(spark, clustered):
    vectors = vector_table(spark, clustered)
    queries = vectors.filter("chunk_ord % 500 = 0").select(F.col("chunk_ord").alias("query_id"), "vector")
    found = ivf.nearest_rows(queries, ivf.build(vectors, cells=8), 5, probes=8, namespace="1")
    exact = dense.search(queries, vectors, 5, namespace="1")
    assert ivf.recall(found, exact) >= 0.9 and found.join(vectors, "chunk_ord").filter("namespace <> '1'").count() == 0


def test_ivf_of_few_and_odd_rows(spark):
    kind = "chunk_ord bigint, vector array<float>"
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, kind)
    queries = vectors.filter("chunk_ord = 1").select(F.col("chunk_ord").alias("query_id"), "vector")
    got = [(r.chunk_ord, r.score) for r in ivf.nearest_rows(queries, ivf.build(vectors), 9, probes=9, oversample=None).orderBy("rank").collect()]
    assert got == [(1, 1.0), (4, 1.0), (2, 0.0), (4, 0.0)]
    assert ivf.nearest_rows(queries, ivf.build(spark.createDataFrame([], kind)), 3).count() == 0
    assert ivf.nearest_rows(queries.limit(0), ivf.build(vectors), 3).count() == 0


def texts(seed, n, words=6):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, words)))) for i in range(n)]


def plain_bm25(docs, queries, k):
    tokens = {i: (t or "").split() for i, t in docs.items()}
    df = Counter(w for ts in tokens.values() for w in set(ts))
    mean = max(sum(map(len, tokens.values())) / max(len(tokens), 1), 1.0)
    out = []
    for q, text in queries:
        scores = {}
        for i, ts in tokens.items():
            tf = Counter(ts)
            s = sum((math.log((1 + len(docs)) / (1 + df[w])) + 1) * tf[w] * 2.4 / (tf[w] + 1.4 * (0.25 + 0.75 * len(ts) / mean)) for w in text.split() if tf[w])
            if any(tf[w] for w in text.split()):
                scores[i] = round(s, 6)
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def found_rows(df):
    return [(r.query_id, r.rank, r.chunk_ord, r.score) for r in df.orderBy("query_id", "rank").collect()]


def close(a, b):
    return [x[:3] for x in a] == [x[:3] for x in b] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(a, b))


def test_stored_index_follows_changes_and_equals_plain_bm25(spark, monkeypatch):
    monkeypatch.setattr(inverted, "RANGE", 8)
    kind = "chunk_ord bigint, text string"
    queries = [(1, "moon river cat"), (2, "stone stone bird"), (3, "nothing known"), (4, "")]
    asked = spark.createDataFrame(queries, "query_id int, query string")
    docs = dict(texts(1, 400))
    docs[7] = None
    index = inverted.build(spark.createDataFrame(list(docs.items()), kind))
    report = {}
    assert close(found_rows(index.search(asked, 5, report)), plain_bm25(docs, queries, 5))
    assert 0 < report["scored"] < report["ranges"]
    changed = {i: t for i, t in texts(2, 460) if i % 3 == 0}
    gone = [2, 5, 399, 10_000]
    updated = index.update(spark.createDataFrame(list(changed.items()), kind), spark.createDataFrame([(g,) for g in gone], "chunk_ord bigint"))
    docs = {i: t for i, t in (docs | changed).items() if i not in gone}
    assert close(found_rows(updated.search(asked, 5)), plain_bm25(docs, queries, 5))
    assert updated.statistics()[0] == len(docs) == updated.documents().count()
    again = updated.update(spark.createDataFrame([(i, docs[i]) for i in (0, 1, 4)], kind))
    assert len(again.segments) == 2 and again.tombs == updated.tombs
    small = again.compact()
    assert len(small.segments) == 1 and small.dead().count() == 0
    assert close(found_rows(small.search(asked, 5)), plain_bm25(docs, queries, 5))
    with pytest.raises(Conflict):
        updated.update(spark.createDataFrame([(0, "cat")], kind))
    with pytest.raises(ValueError):
        inverted.build(spark.createDataFrame([(0, "cat")], kind), small.root)


def test_stored_index_of_nothing(spark):
    kind = "chunk_ord bigint, text string"
    asked = spark.createDataFrame([(1, "cat")], "query_id int, query string")
    index = inverted.build(spark.createDataFrame([], kind))
    assert index.search(asked).count() == 0
    assert [r.chunk_ord for r in index.update(spark.createDataFrame([(3, "a cat"), (4, None)], kind)).search(asked).collect()] == [3]


def test_files_become_chunks_in_order_and_an_index(spark):
    files = [(f"docs/{name}.md", f"# {name}\n\n## First\n\n{' '.join(WORDS)} {name}\n\n## Second\n\n" + "\n\n".join(" ".join(WORDS * 3) for _ in range(12))) for name in ("beta", "alpha", "gamma")]
    index, chunks = inverted.build_from_files(spark.createDataFrame(files, "path string, text string"))
    rows = chunks.orderBy("chunk_ord").collect()
    assert [r.chunk_ord for r in rows] == list(range(len(rows))) and [(r.source_path, r.chunk_index) for r in rows] == sorted((r.source_path, r.chunk_index) for r in rows)
    asked = spark.createDataFrame([(1, "gamma river")], "query_id int, query string")
    got = found_rows(index.search(asked, 4))
    want = lexical.ranked(lexical.bm25(lexical.query_features(asked), chunks.withColumn("text", F.col("text_for_embedding"))).withColumn("score", F.round("bm25", 6)), 4)
    assert close(got, found_rows(want)) and rows[got[0][2]].source_path == "docs/gamma.md"


def test_versions_are_made_once(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.current() == (0, {})
    assert versions.commit(0, {"a": 1}) == 1 and versions.commit(1, {"a": 2}) == 2
    with pytest.raises(Conflict):
        versions.commit(1, {"a": 3})
    assert versions.current() == (2, {"a": 2}) and versions.manifest(1) == {"a": 1} and versions.numbers() == [1, 2]


def test_searches_of_a_stored_index_make_no_pairs(spark, monkeypatch):
    """Ranges are scored in tasks, in several blocks of queries, with more dead chunks than are broadcast, and merged."""
    monkeypatch.setattr(inverted, "RANGE", 8)
    monkeypatch.setattr(inverted, "FIRST_RANGES", 2)
    monkeypatch.setattr(inverted, "BROADCAST_RANGES", 0)
    monkeypatch.setattr(inverted, "QUERY_CELLS", 40, raising=False)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 12)))) for i in range(-40, 160)]
    now = [(i, t if i % 3 else f"{t} suns Moon_moon") for i, t in rows if i % 7]
    table = lambda x: spark.createDataFrame(x, "chunk_ord long, text string").repartition(3)
    index = inverted.build(table(rows)).update(table(now), table(rows).filter("chunk_ord % 7 = 0").select("chunk_ord"))
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(WORDS, k=4))) for i in range(12)], "query_id string, query string")
    want = lexical.bm25_topk(lexical.query_features(queries), table(now), 5)
    for found in (index.search(queries, 5), index.compact().search(queries, 5)):
        same(found, want)
        assert "HashAggregate(keys=[query_id" not in found._jdf.queryExecution().toString()
    merged = inverted.Stored(spark, index.root)
    assert len(merged.segments) == 1 and merged.postings().groupBy("term", "place").count().filter("count > 1").count() == 0
