"""Manifests: reading, checking, generating, and the corpus scan that they describe."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "path string, title string, namespace string, content_kind string, domain string, license string, trust_tier string, volatility string, "
    "contested string, section_tags array<string>, source_url string, date string, ingest boolean, notes string"
)
REQUIRED = ("path", "license", "trust_tier", "namespace")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a manifest, with their 1-based position: an object with a list `documents`, or a list, as JSON or YAML; none if the file is missing."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    text = spark.read.text(path, wholetext=True).first()[0] if there else "[]"
    if text.lstrip()[:1] not in ("{", "["):
        import yaml

        text = json.dumps(yaml.safe_load(text) or {}, default=str)
    kind = f"array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in SCHEMA.split(', '))}>>"
    whole = spark.createDataFrame([(text,)], "t string")
    parsed = F.from_json("t", kind) if text.lstrip().startswith("[") else F.from_json("t", f"documents {kind}")["documents"]
    return whole.select(F.posexplode(parsed).alias("at", "d")).select((F.col("at") + 1).alias("position"), "d.*")


def validate(documents: DataFrame) -> DataFrame:
    """(position, error): required fields that are missing or empty, and later documents with a path that came before."""
    missing = F.filter(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED)), lambda x: x.isNotNull())
    nth = F.row_number().over(Window.partitionBy("path").orderBy("position"))
    again = documents.filter(F.coalesce("path", F.lit("")) != "").withColumn("n", nth).filter("n > 1")
    return documents.select("position", F.explode(missing).alias("error")).union(again.select("position", F.concat(F.lit("duplicate path "), "path")))


def by_path(documents: DataFrame) -> DataFrame:
    """One document per path, the last."""
    w = Window.partitionBy("path").orderBy(F.desc("position"))
    return documents.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def generate(files: DataFrame, domains: dict[str, str]) -> DataFrame:
    """Manifest rows of files (path): namespace, kind, domain by folder, tags from the path, ingest.

    domains maps a folder's name to a domain; others are `general`.
    """
    parts = F.split("path", "/")
    folder = F.coalesce(F.try_element_at(parts, F.size(parts) - 1), F.lit(""))
    name = F.element_at(parts, -1)
    domain: Column = F.lit("general")
    for k, v in domains.items():
        domain = F.when(F.array_contains(parts, k), v).otherwise(domain)
    routing = F.array_contains(parts, "routing")
    return files.select(
        "path",
        F.initcap(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  ")).alias("title"),
        F.when(routing, "routing").otherwise("knowledge").alias("namespace"),
        F.when(routing, "routing-card").otherwise("research-bundle").alias("content_kind"),
        domain.alias("domain"),
        F.array_distinct(F.array_sort(F.filter(F.array(folder, domain), lambda x: x != ""))).alias("section_tags"),
        (~F.lower(name).startswith("readme")).alias("ingest"),
    )


# Words of a path that mark what changes quickly, words of a name that mark primary sources, words that become tags, and files that repeat others.
VOLATILE = ("pricing", "cost", "gpu", "model_selection", "vendor", "cloud_platform", "latency_cost")
PRIMARY = ("source", "reference", "bibliography")
TAG_WORDS = ("evaluation", "chunk", "rerank", "retrieval", "security", "terraform", "iac", "cost", "freshness", "grounding", "citation", "abstention", "router")
REPEATING = ("FULL_REPORT.MD", "FULL_COMBINED_REPORT.MD")


def describe(files: DataFrame, root: str = "corpus", domains: dict[str, str] | None = None, license: str = "", date: str = "") -> DataFrame:
    """Whole manifest rows of scanned files (path, text), in the order of a manifest's fields.

    The first folder under the root gives namespace and kind, the second the
    domain (domains maps names of folders, others stand for themselves); the title
    is the text's first level-1 heading, else the file's name. Combined reports
    and the root's own README are not taken in.
    """
    parts = F.split(F.regexp_replace("path", "^" + re.escape(root.rstrip("/") + "/"), ""), "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    low = F.lower("path")
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    domain: Column = F.coalesce(second, F.lit("general"))
    for k, v in (domains or {}).items():
        domain = F.when(second == k, v).otherwise(domain)
    domain = F.when(first == "routing", "routing").when(first == "report", "implementation").otherwise(domain)
    kind = F.when(first == "routing", "routing-card").when(first == "report", "implementation-spec").otherwise("research-bundle")
    heading = F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?m)^# (.*)$", 1))
    primary = ~F.lower(name).startswith("readme") & has(stem, PRIMARY)
    ingest = ~F.upper(name).isin(*REPEATING) & ~((name == "README.md") & (F.size(parts) == 1))
    words = F.filter(F.array(*map(F.lit, TAG_WORDS)), lambda w: F.contains(low, w))
    return files.select(
        "path", F.when(F.coalesce("text", F.lit("")).rlike(r"(?m)^# "), heading).otherwise(F.initcap(F.translate(stem, "_-", "  "))).alias("title"), F.when(first == "routing", "routing").otherwise("knowledge").alias("namespace"),
        kind.alias("content_kind"), domain.alias("domain"), F.lit(license).alias("license"), F.when(primary, "primary").otherwise("reputable").alias("trust_tier"), F.when(has(low, VOLATILE), "volatile").otherwise("stable").alias("volatility"),
        F.lit("consensus").alias("contested"), F.array_sort(F.array_distinct(F.concat(F.array(domain, kind), words))).alias("section_tags"), F.lit(None).cast("string").alias("source_url"), F.lit(date).alias("date"), ingest.alias("ingest"),
        F.when(ingest, "").otherwise("Excluded duplicate combined report.").alias("notes"),
    )


def ingestible(documents: DataFrame) -> DataFrame:
    """Documents to take in; a missing flag means yes."""
    return documents.filter(F.coalesce("ingest", F.lit(True)))


def scan(spark: SparkSession, documents: DataFrame, root: str) -> DataFrame:
    """Text of each document to take in; raises if a file is missing."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    base = re.sub("^file:/+", "/", root.rstrip("/") + "/")
    texts = texts.withColumn("path", F.replace(F.regexp_replace("file", "^file:/+", "/"), F.lit(base), F.lit("")))
    joined = ingestible(documents).join(texts.select("path", "text"), "path", "left")
    return joined.withColumn("text", F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("missing file "), "path"))).otherwise(F.col("text")))
