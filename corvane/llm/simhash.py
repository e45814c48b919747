"""SimHash near-duplicates over a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import components, discard, forest, materialize, tidy

WORDS = 3
MAX_BITS = 2
#: Fingerprints in one shard of the index; the number of shards follows from it, up to MAX_SHARDS, beyond which shards grow.
SHARD_ROWS = 20_000
MIN_SHARDS, MAX_SHARDS = 32, 1 << 16
FANOUT = 16
QUERY_BLOCK = 2048


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed integer.

    A-Z are lower-cased; words are runs of other than ASCII white space; the
    shingles of `words` words count as often as they occur. A text with fewer
    words is one shingle; null and wordless texts have fingerprint 0.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[i:j], 42) for i, j in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) for each row of docs."""
    return _tagged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("tag")), words).drop("tag")


def _tagged(src: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, tag) of rows (doc_id, text, tag)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = [fingerprint(t, words) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "tag"])

    return src.mapInArrow(lambda it: tidy(batches(it)), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint, tag bigint")


def gray_rank(fp: F.Column | str) -> F.Column:
    """Place of a fingerprint in Gray order, with the top bit flipped so that signed order is the unsigned one."""
    r = F.col(fp) if isinstance(fp, str) else fp
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold what their fingerprints share.

    A node keeps the mask of bits on which all fingerprints below agree and
    that its parent does not already hold, and their pattern. The differences
    add up on the way down; a node over the limit drops its whole group.
    """

    def __init__(self, ones: np.ndarray, zeros: np.ndarray | None = None, fanout: int = FANOUT):
        """Over fingerprints; or over groups, by the bits that are 1 (ones) and those that are 0 (zeros) in a whole group."""
        self.fanout = fanout
        zeros = ~ones if zeros is None else zeros
        levels = [(ones, zeros)]
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            levels.append((ones, zeros))
        self.levels = []
        above = np.zeros(1, np.uint64)
        for ones, zeros in reversed(levels):
            shared = ones | zeros
            own = shared & ~above[np.arange(len(ones)) // fanout]
            self.levels.append((own, ones))
            above = shared

    def search(self, queries: np.ndarray, most: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, leaf index) at `most` or fewer differing bits, in blocks; of groups, those that can hold such a fingerprint."""
        for at in range(0, len(queries), QUERY_BLOCK):
            q = queries[at : at + QUERY_BLOCK]
            qi, node, acc = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)
            for depth, (own, pattern) in enumerate(self.levels):
                if depth:
                    qi, acc = np.repeat(qi, self.fanout), np.repeat(acc, self.fanout)
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    real = node < len(own)
                    qi, node, acc = qi[real], node[real], acc[real]
                acc = acc + np.bitwise_count((q[qi] ^ pattern[node]) & own[node])
                near = acc <= most
                qi, node, acc = qi[near], node[near], acc[near]
            yield qi + at, node


def near_edges(classes: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that span the links of distinct fingerprints (column fp).

    Fingerprints are cut into shards of near-equal size by Gray rank. The
    shards' roots, two numbers each, are the leaves of an index of their own:
    a fingerprint goes down from its top and visits the later shards that are
    left, so whole runs of shards are pruned at once. A shard's task returns a
    spanning forest of what it found, not its pairs.
    """
    spark = classes.sparkSession
    ranked = classes.select("fp", gray_rank("fp").alias("rank"))
    n = ranked.count()
    shards = min(MAX_SHARDS, max(MIN_SHARDS, -(-n // SHARD_ROWS)))
    cuts = sorted(set(ranked.select(F.percentile_approx("rank", [i / shards for i in range(1, shards)], 100 * shards)).first()[0] or []))
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    def homes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            home = np.searchsorted(bounds.value, b.column(1).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(home, pa.int32())], ["fp", "home"])

    homed = ranked.mapInArrow(homes, "fp bigint, home int")
    # one row per shard, MAX_SHARDS at most: its root
    roots = sorted(homed.groupBy("home").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")).collect())
    upper = spark.sparkContext.broadcast(np.array(roots, np.int64).reshape(-1, 3))

    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ones, zeros = np.ascontiguousarray(upper.value.T)
        top = GrayIndex(ones.view(np.uint64), zeros.view(np.uint64))
        for b in it:
            fp, home = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(home, pa.int32()), pa.array(np.ones(len(fp), bool))], ["fp", "shard", "own"])
            for qi, node in top.search(fp.view(np.uint64), most):
                later = home[qi] < at[node]
                qi, to = qi[later], at[node[later]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fp[qi]), pa.array(to, pa.int32()), pa.array(np.zeros(len(qi), bool))], ["fp", "shard", "own"])

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        own = pdf["own"].to_numpy(bool)
        members, guests = np.sort(fp[own]), fp[~own]
        rank = members.copy()
        for k in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(k)
        members = members[np.argsort(rank, kind="stable")]
        nodes = np.concatenate([members, guests])
        root = np.arange(len(nodes))
        if len(members):
            for qi, hit in GrayIndex(members).search(nodes, most):
                left, right = root[qi], root[hit]
                new = np.unique(np.stack([left, right], 1)[left != right], axis=0)
                step = forest(new[:, 0], new[:, 1], len(nodes))
                root = step[root]
        far = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[far].view(np.int64), "b": nodes[root[far]].view(np.int64)})

    return homed.mapInArrow(visits, "fp bigint, shard int, own boolean").groupBy("shard").applyInPandas(shard, "a bigint, b bigint")


def _named(fps: DataFrame, most: int) -> DataFrame:
    """(fp, comp: a number of its component, component_id: the smallest doc_id in it) of each distinct fingerprint of fps (doc_id, fp)."""
    n = fps.count()
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes", n)
    comps = materialize(components(near_edges(classes, most)), "comps", n)
    named = classes.join(comps, classes.fp == comps.id, "left").select("fp", "first_id", F.coalesce("comp", "fp").alias("comp"))
    named = materialize(named, "named", n)
    first = materialize(named.groupBy("comp").agg(F.min("first_id").alias("component_id")), "first", n)
    labels = materialize(named.join(first, "comp").select("fp", "comp", "component_id"), "labels", n)
    discard(classes, comps, named, first)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), kept.

    Documents link when their fingerprints differ in `most` or fewer bits.
    Equal fingerprints are one node, so copies cost one row each. Null texts are
    empty texts (fingerprint zero, linked like any other). A row with a null
    doc_id takes its fingerprint's component and is never kept. Repeated rows
    each get a row. Extra columns are ignored; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "fps")
    labels = _named(fps, most)
    return fps.join(labels, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MAX_BITS) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, with all its columns.

    Of different texts under that doc_id the one with the smallest hash stays,
    and of rows that repeat both one row. Rows that share a doc_id but not a
    component stay apart. Rows with a null doc_id always stay. Null texts are
    empty texts. Columns that hold a working name are not touched.
    """
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    src = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tag.alias("tag"))
    fps = materialize(_tagged(src, words), "fps")
    found = fps.join(_named(fps, most), "fp").filter("doc_id = component_id")
    copies = found.groupBy("comp", "doc_id", "tag").agg(F.count("*").alias("n"))
    chosen = copies.groupBy("comp", "doc_id").agg(F.min("tag").alias("tag")).join(copies, ["comp", "doc_id", "tag"])
    # two components may choose equal keys only where hashes of two texts of one doc_id collide
    kept = materialize(chosen.groupBy(F.col("doc_id").alias("__kept_id"), F.col("tag").alias("__kept_tag")).agg(F.max("n").alias("__n")), "kept", fps.count())
    on = (F.col(id_col) == F.col("__kept_id")) & (tag == F.col("__kept_tag"))
    single = docs.join(kept.filter("__n = 1"), on, "left_semi")
    several = docs.join(kept.filter("__n > 1"), on, "left_semi").dropDuplicates([id_col, text_col])
    return single.unionByName(several).unionByName(docs.filter(F.col(id_col).isNull()))
