"""Collections: replays, guards, damaged buckets, promotion; late interaction by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import maxsim
from corvane.sources.collection import Alias, Collection, EmbeddingCache, Mismatch, migrate, sink
from corvane.sources.versions import Conflict

KIND = "chunk_id string, vector array<double>"


def rows_of(df):
    return sorted(map(tuple, df.select("chunk_id", "vector").collect()))


def table(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], KIND)


def test_upserts_replace_and_replays_change_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    a = Collection(spark, root).upsert(table(spark, [("a", [1]), ("b", [2])]), {"model": "m"}, 0)
    b = a.upsert(table(spark, [("b", [3]), ("c", [4])]), {"model": "m"}, 1, deleted=spark.createDataFrame([("zz",)], "chunk_id string"))
    assert rows_of(b.read()) == [("a", [1.0]), ("b", [3.0]), ("c", [4.0])] and rows_of(a.read()) == [("a", [1.0]), ("b", [2.0])]
    assert b.upsert(table(spark, [("b", [9])]), batch=1).number == b.number == 2
    with pytest.raises(Mismatch):
        b.upsert(table(spark, [("b", [9])]), {"model": "other"}, 2)
    with pytest.raises(Mismatch):
        b.upsert(spark.createDataFrame([("b", 1)], "chunk_id string, n int"))
    with pytest.raises(Conflict):
        a.upsert(table(spark, [("d", [9])]))
    now = Collection(spark, root)
    assert now.number == 2
    now.verify()
    assert now.matches(table(spark, [("c", [4]), ("a", [1]), ("b", [3])]).repartition(3)) and not now.matches(table(spark, [("c", [4]), ("a", [1])]))
    fresh = now.upsert(table(spark, [("x", [1])]), {"model": "other"}, rebuild=True)
    assert rows_of(fresh.read()) == [("x", [1.0])]
    gone = fresh.upsert(table(spark, []), deleted=spark.createDataFrame([("x",)], "chunk_id string"))
    assert gone.read().count() == 0
    last = fresh.spark.createDataFrame([("k", [1.0], 1), ("k", [2.0], 5), ("k", [3.0], 2)], KIND + ", seq int")
    assert rows_of(gone.upsert(last).read()) == [("k", [2.0])]


def test_stream_into_a_collection(spark, tmp_path):
    for k in range(3):
        table(spark, [(f"r{k}", [k]), ("all", [k])]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = f"file://{tmp_path}/c"
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put = sink(spark, root, "chunk_id", {"model": "m"})
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    now = Collection(spark, root)
    assert now.manifest["batch"] == 2 and sorted(r.chunk_id for r in now.read().collect()) == ["all", "r0", "r1", "r2"]
    put(table(spark, [("all", [77])]), 2)  # the last batch once more
    assert Collection(spark, root).number == now.number


def test_alias_moves_only_to_whole_versions(spark, tmp_path):
    alias = Alias(spark, f"file://{tmp_path}/alias")
    with pytest.raises(Mismatch):
        alias.read()
    a = Collection(spark, f"file://{tmp_path}/a").upsert(table(spark, [("a", [1])]))
    assert alias.promote(a)["changed"] and not alias.promote(a)["changed"]
    shown = alias.read()
    b = migrate(a, f"file://{tmp_path}/b")
    b = b.upsert(table(spark, [("b", [2])]))
    with pytest.raises(Mismatch):
        alias.promote(b, a.read())
    with pytest.raises(Conflict):
        migrate(a, b.root)
    alias.promote(b, table(spark, [("a", [1]), ("b", [2])]))
    assert rows_of(alias.read()) == [("a", [1.0]), ("b", [2.0])] and rows_of(shown) == [("a", [1.0])]
    damaged = next(p for p in (tmp_path / "b" / "data").glob("v00000002-*/*/*.parquet"))
    damaged.unlink()
    with pytest.raises(Exception):  # noqa: B017  the check reads all rows
        Alias(spark, f"file://{tmp_path}/other").promote(Collection(spark, b.root))
    assert alias.roll_back()["root"] == a.root and rows_of(alias.read()) == [("a", [1.0])]


def test_embedding_cache_computes_what_it_lacks(spark, tmp_path):
    seen = []

    def encode(lacking):
        got = lacking.select("digest", "text").collect()
        seen.append(sorted(r.text for r in got))
        return spark.createDataFrame([(r.digest, [float(len(r.text))]) for r in got], "digest string, vector array<float>")

    texts = lambda *ts: spark.createDataFrame(list(enumerate(ts)), "i int, text string")
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", "org/model-1", 1)
    first = cache.vectors(texts("a", "bb", "a", None, ""), encode).collect()
    assert seen[-1] == ["", "a", "bb"] and [r.vector[0] for r in sorted(first, key=lambda r: r.i)] == [1, 2, 1, 0, 0]
    second = {r.i: r.computed for r in cache.vectors(texts("bb", "ccc", "a"), encode).collect()}
    assert seen[-1] == ["ccc"] and second == {0: False, 1: True, 2: False}
    EmbeddingCache(spark, f"file://{tmp_path}/cache", "org/model-1", 2).vectors(texts("a"), encode).collect()
    assert seen[-1] == ["a"]
    at = Collection(spark, cache.root, "digest")
    lost = next(iter(at.manifest["buckets"].values()))
    for p in (tmp_path / "cache").rglob("*.parquet"):
        if lost in str(p) and "dim_1" in str(p):
            p.write_bytes(b"damaged")
    again = cache.vectors(texts("a", "bb", "ccc", ""), encode).collect()
    assert 1 <= len(seen[-1]) < 4 and sorted(r.vector[0] for r in again) == [0, 1, 2, 3]
    cache.vectors(texts("a", "bb", "ccc", ""), encode).collect()
    assert seen[-1] == []


def test_maxsim_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    make = lambda n: [rng.normal(size=(k, 5)).round(3).tolist() for k in n]
    queries, chunks = make([3, 1, 0, 40]), make([4, 0, 7, 1, 60, 2])
    chunks[3] = [[0.0] * 5]
    kind = "array<array<double>>"
    q = spark.createDataFrame([*enumerate(queries), (9, None)], f"query_id int, tokens {kind}")
    c = spark.createDataFrame([*enumerate(chunks), (9, None)], f"chunk_ord int, tokens {kind}")
    pairs = q.select("query_id").crossJoin(c.select("chunk_ord")).withColumn("tokens", F.lit("kept"))
    unit = lambda m: [np.array(v) / (np.linalg.norm(v) or 1) for v in m or []]
    want = {(i, j): sum(max((a @ b for b in unit(y)), default=0.0) for a in unit(x)) for i, x in [*enumerate(queries), (9, None)] for j, y in [*enumerate(chunks), (9, None)]}
    for cells in (1 << 20, 50):
        monkeypatch.setattr(maxsim, "BLOCK_CELLS", cells)
        got = maxsim.scored(pairs, q, c).collect()
        assert {(r.query_id, r.chunk_ord): pytest.approx(r.maxsim) for r in got} == want and {r.tokens for r in got} == {"kept"}
    best = maxsim.rerank(pairs, q, c, 2).filter("query_id = 3").orderBy("rank").collect()
    assert [r.chunk_ord for r in best] == sorted(range(6), key=lambda j: (-round(want[(3, j)], 6), j))[:2]
