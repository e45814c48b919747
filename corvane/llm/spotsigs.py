"""SpotSigs document fingerprints, with DataFrame functions only.

A spot is an occurrence of a very common word (the anchor), or a content word
that begins with one of a few characters; its signature is the chain of content
words that follow, with further anchors skipped. A text's
fingerprint is the set of its signatures. Texts whose sets differ too much in
size can't be alike, so the similarity join works within partitions of set
size, on each set's rarest signatures, and verifies by Jaccard.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize

# Anchors, very common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been by for from had has have he in is it its not of on or that the their they this to was were which with "
    "auf aus das dem den der des die ein eine er für ist mit nicht sich und von zu "
    "au aux avec ce dans du en est et il la le les ne par pas pour que qui sur un une "
    "con de del el es las lo los no para por se su una y"
).split()
#: Content words in a chain.
CHAIN = 3
#: First characters of content words that are spots by themselves, so that texts in other languages and lists of words have spots too.
OWN_SPOT = "[^a-z# ]|[emr]"
SIMILARITY = 0.8
#: Documents in one bucket of the order by id, and the most buckets whose bounds the driver holds.
BUCKET_ROWS = 2000
MIN_BUCKETS, MAX_BUCKETS = 32, 8192


def trie(words: list[str]) -> str:
    """A regular expression of words that shares their beginnings, longest match first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = [h + (trie(rest) if any(rest) else "") for h, rest in heads.items()]
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in words else "")


_RUN = f"(?:{trie(ANCHORS)} )"


def plain(text: Column) -> Column:
    """A text's words in lower case, each with a space before and one after the last."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Distinct 32-bit hashes of a text's spot signatures, ascending.

    A spot is the start of the text, a run of anchors, or a content word that
    begins with a character of OWN_SPOT; it is signed by the `chain` content
    words that follow it (of its own, that begin with it), fewer at the end.
    Null and wordless texts have none.
    """
    marked = F.regexp_replace(plain(text), rf"^ {_RUN}*+| {_RUN}++", " #")
    spot = rf"(?:#|(?<= )(?={OWN_SPOT}))(?=([^ ]+(?: [^ ]+){{0,{chain - 1}}}))"
    spots = F.regexp_extract_all(marked, F.lit(spot), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(spots, lambda s: F.hash(F.translate(s, "#", "")))))


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: its signatures in 8 hex digits each, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.right(F.lpad(F.hex(s), 16, "0"), F.lit(8))), "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints, 1 for two empty ones; sizes of which one is zero need no comparison."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def length_partition(size: Column, tau: float = SIMILARITY) -> Column:
    """Partition of a set size: sizes in one partition, or in neighbouring ones, are all that can reach tau."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / -math.log(tau) + 1e-9).cast("int")).otherwise(F.lit(-2))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(doc_id, sigs array<int>, fingerprint string, length_partition int) of each whole text."""
    sigs = docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col), chain).alias("sigs"))
    return sigs.select("doc_id", "sigs", as_text(F.col("sigs")).alias("fingerprint"), length_partition(F.size("sigs")).alias("length_partition"))


def similar(docs: DataFrame, tau: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates by SpotSigs: (members, links).

    members has doc_id and class_id, the smallest doc_id with an equal
    fingerprint; links has (a, b, likeness) of classes a < b with a Jaccard of
    tau or more. Two sets can only be that alike if their sizes are in one or in
    neighbouring partitions, and if they share one of each set's rarest
    |s| - ceil(tau |s|) + 1 signatures. Rows with a null id and texts without a
    signature belong to no link; repeated rows are repeated members.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, chain).filter("doc_id is not null"), "spots")
    classes = materialize(fps.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "classes")
    members = fps.join(classes, "sigs").select("doc_id", "class_id")
    flat = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    common = materialize(flat.groupBy("sig").agg(F.count("*").alias("df")), "df")
    rare = Window.partitionBy("class_id").orderBy("df", "sig")
    prefix = flat.join(common, "sig").withColumn("at", F.row_number().over(rare)).filter(F.col("at") <= F.col("n") - F.ceil(F.lit(tau) * F.col("n") - 1e-9) + 1)
    prefix = materialize(prefix.select("class_id", "n", "sig", length_partition(F.col("n"), tau).alias("part")), "prefix")
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    pairs = left.join(right, ["part", "sig"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= tau * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sets = classes.select("class_id", "sigs")
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return members, full.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= tau)


def bucket_of(value: str, bounds: list) -> Column:
    """How many of the ascending bounds are below a column's value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.array(*map(F.lit, bounds))
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(held, at + step - 1) < F.col(value)), at + step).otherwise(at),
    )


def with_next(docs: DataFrame, derive: Callable[[Column], Column]) -> DataFrame:
    """docs (doc_id, text) with sigs = derive(text), and next_text and next_sigs of the next row in descending order of doc_id; the last row's next is the first.

    Rows are dealt into buckets of id ranges, each sorted in one task. The first
    row of each bucket, one row per bucket, is the next of the bucket before.
    Equal ids are ordered by a hash of the text, null ids come last.
    """
    n = docs.count()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-n // BUCKET_ROWS)))
    cut = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 50 * buckets)).first()[0] or []
    dealt = docs.withColumn("bucket", bucket_of("doc_id", sorted(set(cut)))).withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    first = dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", -F.col("tie").cast("decimal(20,0)"))).alias("top"))
    tops = materialize(first.select("bucket", F.col("top.doc_id").alias("top_id")), "tops")
    ring = Window.orderBy(F.desc("bucket"))  # one row per bucket
    after = tops.select(
        F.col("bucket").alias("of"),
        F.coalesce(F.lead("bucket").over(ring), F.first("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"),
    )
    heads = dealt.join(F.broadcast(tops), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("top_id")))
    heads = materialize(heads.groupBy("bucket").agg(F.min_by("text", "tie").alias("head_text")), "tops")
    heads = after.join(heads, "bucket").select(F.col("of").alias("head_of"), "head_text", derive(F.col("head_text")).alias("head_sigs"))
    heads = materialize(heads, "heads")
    w = Window.partitionBy("bucket").orderBy(*order)
    led = dealt.withColumn("sigs", derive(F.col("text")))
    led = led.select("*", *(F.lead(c).over(w).alias(f"lead_{c}") for c in ("text", "sigs")))
    joined = led.join(heads.hint("merge"), led.bucket == heads.head_of)
    return joined.select(*docs.columns, "sigs", *(F.coalesce(f"lead_{c}", f"head_{c}").alias(f"next_{c}") for c in ("text", "sigs")))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document in descending doc_id; after the
    last comes the first. Likeness is the Jaccard of the signature sets. Null
    texts are empty; two empty fingerprints are alike. Rows with a null id come
    last, equal ids in the order of a hash of their texts; an empty table gives
    no rows; extra columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next(src, lambda text: signatures(text, chain))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    out = out.select("*", signatures(F.col("edited"), chain).alias("edited_sigs"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
