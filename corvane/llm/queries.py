"""Queries opN_<name> of this package, with their parameters and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, flatgraph, langid, packing, passages, pii, simhash, spelling, spotsigs, toxicity, urlrep, warc, whitening
from corvane.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine; the executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("archive")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label with its id; quality 0 is bad."""
    outcomes = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "CASE quality WHEN 0 THEN 1 WHEN 1 THEN 0 END AS bad")
    return urlrep.judge(table(spark, sf_dir, "pages"), outcomes).drop("bad_chance")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_spans")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("deviation_exact")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_bpe, op3_warc, op4_simhash, op5_toxicity,
        op6_url_filter, op7_substring_dedup, op8_spotsigs, op9_langid, op10_packing,
        op11_whitening, op12_pii, op13_spelling,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_warc": warc.ORACLE_SQL, "op6_url_filter": urlrep.oracle_sql(), "op13_spelling": spelling.ORACLE_SQL}
