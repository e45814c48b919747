"""A corpus pipeline of five stages: language, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import langid, packing, passages, simhash, toxicity
from corvane.llm.common import materialize, table, tune
from corvane.llm.queries import tokenizer_path

#: Texts whose best language scores below this are in none of the learned languages. Measured: of 51,282 documents in a
#: learned language none scores less (lowest 0.29), on sf0.1 3 of 10,000, with 5 letters at most; Polish 0.18, Finnish 0.19,
#: Russian 0.01, but neighbours of a learned language more (Spanish left out of training 0.27, the median).
MIN_LANGUAGE_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter or too unlike every language go.

    Null and empty texts have no letter and go. If no document has a language to
    learn from, all go. Null ids, repeated rows and other columns stay as they
    are; whole texts of any length are read; an empty table gives no rows.
    """
    tune(spark)
    predict = langid.predictor(langid.train(docs), spark)
    judged = docs.withColumn("__language", predict(F.col("text")))
    return judged.filter((F.col("__language.lang") != langid.UNKNOWN) & (F.col("__language.score") >= MIN_LANGUAGE_SCORE)).drop("__language")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below the threshold stay.

    Null and empty texts have the probability of a text without words, as the
    model has learned it; without toxic labels all stay. Null ids, repeated rows
    and other columns stay as they are; an empty table gives no rows.
    """
    tune(spark)
    score = toxicity.scorer(toxicity.train(docs, table(spark, sf_dir, "labels")), spark)
    return docs.withColumn("__toxicity", score(F.col("text"))).filter(F.col("__toxicity.toxic") < toxicity.THRESHOLD).drop("__toxicity")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that with the smallest doc_id.

    Of different texts under that id the one with the smallest hash stays, of
    rows that repeat both one. Unrelated texts under one id all stay, as do rows
    without an id. Null and empty texts are one group; an empty table gives no rows.
    """
    tune(spark)
    return simhash.first_of_each(docs).select(docs.columns)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all documents but their first; n_chars follows the text.

    All rows stay. Rows without an id or a text stay as they are; repeated rows
    are one document, different texts under one id are different documents; an
    empty table gives no rows.
    """
    tune(spark)
    cut = passages.dedupe(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents, packed.

    Every row gives pieces: a null or empty text one with the end id only, a very
    long one several. Null ids and repeated rows each keep theirs; an empty table
    gives no rows.
    """
    tune(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("passages", passages_stage),
    ("packing", packing_stage),
]

#: The stages learn models, compare fingerprints and search for packings; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
