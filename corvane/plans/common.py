"""Shared pieces of the registered queries: stand-in tables and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the driver's tables stand for: documents are chunks, benchmark texts are queries, embeddings are chunk vectors.
PHRASES = (
    "hipaa patient data in a hospital with ehr", "bank transaction fraud with pci and kyc, batch", "developer api and sdk docs with low latency",
    "therapist notes on cbt, human review", "multi-hop questions over changelog and code snippets", "gdpr and many languages, external api",
    "patient records through a hosted llm under hipaa with real-time answers", "no compliance, public docs, direct answer", "plain words",
)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: section is (source, lang), tags the language, path source/doc_id."""
    return t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_ord"), "text", F.col("source").alias("title"), F.array("source", "lang").alias("section_path"), F.array("lang").alias("tags"),
        F.col("source").alias("domain"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"),
        F.when(F.col("doc_id") % 7 == 0, "reference").otherwise("prose").alias("element_type"), F.col("lang").alias("namespace"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("vector"), F.col("label").alias("namespace"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 100."""
    return t(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a brief, with a phrase that the rules know."""
    at = (F.col("conv_id") * 3 + F.col("turn")) % len(PHRASES)
    phrase = F.get(F.array(*map(F.lit, PHRASES)), at.cast("int"))
    return t(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("brief_id"), F.concat_ws(" ", "text", phrase).alias("brief")
    )


PHRASE_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
BRIEFS_SQL = f"briefs AS (SELECT concat_ws(':', conv_id::VARCHAR, turn::VARCHAR) AS brief_id, concat_ws(' ', text, ({PHRASE_LIST})[1 + (conv_id * 3 + turn) % {len(PHRASES)}]) AS brief FROM conversations)"


def stem_sql(x: str) -> str:
    return (
        f"CASE WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN {x}[:-4] || 'y' "
        f"WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN {x}[:-2] ELSE {x} END"
    )


def tokens_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(translate(lower({text}), '_-/', '   '), '[a-z0-9][a-z0-9.]*'), lambda w: {stem_sql('w')})"
