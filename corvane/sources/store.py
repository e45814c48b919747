"""Chunk and vector tables: counts, matching, writing, migration and promotion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, count); null and empty are `unknown`."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown")).alias(key)).agg(F.count("*").alias("count"))


def matches(stored: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: n_stored, n_chunks, missing, extra, matches: whether a stored table has exactly these chunks."""
    both = stored.select(key, F.lit(1).alias("s"), F.lit(0).alias("c")).union(chunks.select(key, F.lit(0), F.lit(1)))
    per = both.groupBy(key).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    out = per.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("n_stored"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"),
        F.count(F.when(F.col("s") == 0, 1)).alias("missing"), F.count(F.when(F.col("c") == 0, 1)).alias("extra"),
    )
    return out.withColumn("matches", (F.col("n_stored") == F.col("n_chunks")) & (F.col("missing") == 0) & (F.col("extra") == 0))


def table_name(base: str, dimension: int) -> str:
    if "{dimension}" in base:
        return base.replace("{dimension}", str(dimension))
    suffix = f"_dim_{dimension}"
    return base if base.endswith(suffix) else base + suffix


def build_order(native: int, dimensions: list[int]) -> list[int]:
    """Native dimension first, each once."""
    return list(dict.fromkeys([native, *dimensions]))


def vector_rows(chunks: DataFrame, vectors: DataFrame, model: str, dimension: int, native: int) -> DataFrame:
    """Rows of the vector table: chunks joined with their unit vectors and the model's marks."""
    from corvane.operators.dense import prepare

    v = prepare(vectors, dimension).select("chunk_id", "vector")
    return chunks.join(v, "chunk_id").withColumns(
        {"embedding_model": F.lit(model), "embedding_dimension": F.lit(dimension), "embedding_native_dimension": F.lit(native)}
    )


def write_vectors(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, base: str, model: str, native: int, dimensions: list[int], rebuild: bool = False) -> DataFrame:
    """One Parquet table per dimension under `base`; one that differs from the chunks is only replaced if rebuild is set. (table, dimension, rows)."""
    out = []
    for d in build_order(native, dimensions):
        path = table_name(base, d)
        try:
            stored = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        same = stored is not None and matches(stored, chunks).first()["matches"]
        if stored is not None and not same and not rebuild:
            raise ValueError(f"{path} differs from the chunks; set rebuild to replace it")
        if not same:
            vector_rows(chunks, vectors, model, d, native).write.mode("overwrite").parquet(path)
        out.append((path, d, spark.read.parquet(path).count()))
    return spark.createDataFrame(out, "table string, dimension int, rows long")


def missing_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks that a cache of vectors (chunk_id, content_hash) lacks: new or changed ones."""
    return chunks.join(cache.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def migrate(spark: SparkSession, source: str, target: str) -> int:
    """Copy a vector table and check that counts and ids agree; the number of rows."""
    rows = spark.read.parquet(source)
    rows.write.mode("errorifexists").parquet(target)
    check = matches(spark.read.parquet(target), rows).first()
    if not check["matches"]:
        raise ValueError(f"{target} has {check['n_stored']} rows of {check['n_chunks']}")
    return check["n_chunks"]


def promote(spark: SparkSession, alias: str, target: str) -> None:
    """Let the view `alias` show a target table, at once; the target must exist and have rows, and alias must be no table."""
    if not spark.catalog.tableExists(target):
        raise ValueError(f"no table {target}")
    if not spark.table(target).head(1):
        raise ValueError(f"{target} is empty")
    if spark.catalog.tableExists(alias) and spark.catalog.getTable(alias).tableType not in ("VIEW", "TEMPORARY"):
        raise ValueError(f"{alias} is a table")
    spark.sql(f"CREATE OR REPLACE VIEW `{alias}` AS SELECT * FROM `{target}`")


def append_json(rows: DataFrame, path: str, fail: bool = True) -> bool:
    """Append rows to a JSON-lines log; with fail=False an error is reported and not raised."""
    try:
        rows.write.mode("append").json(path)
        return True
    except Exception:
        if fail:
            raise
        return False


def sections(bundle: DataFrame, text: str = "text") -> DataFrame:
    """(path, content) of a bundle in which each file follows a line `# file: <path>`."""
    return bundle.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?ms)^# file: ([^\n]+\n.*?)(?=^# file: |\z)"), F.lit(1))).alias("part")).select(
        F.split("part", "\n", 2)[0].alias("path"), F.split("part", "\n", 2)[1].alias("content")
    )


def bundle(files: DataFrame) -> DataFrame:
    """One row: files (path, content) as one text, in the order of their paths."""
    parts = F.array_sort(F.collect_list(F.struct("path", "content")))
    return files.agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("# file: "), p["path"], F.lit("\n"), p["content"])), "").alias("text"))


def for_each_batch(write: Callable[[DataFrame], None]):
    """A foreachBatch function that hands each micro-batch to a writer."""
    return lambda df, _: write(df)


def upsert(collection: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A collection with rows put in: a row with a key that is there takes its place, of several with one key the last in `rows` by column seq if there is one.

    Both have the same columns, but for seq.
    """
    if "seq" in rows.columns:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
        rows = rows.withColumn("__n", last).filter("__n = 1").drop("__n", "seq")
    return collection.join(rows.select(key), key, "left_anti").unionByName(rows)
