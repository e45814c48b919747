"""Removal of repeated passages by hashing lines, sentences, runs of short sentences and anchored stretches of words."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from corvane.llm.common import discard, materialize, tidy

#: Units with fewer words stay by themselves: short lines and sentences are common in clean text.
MIN_LINE_WORDS = 5
MIN_SENTENCE_WORDS = 8
#: Repeated sentences, runs and stretches that lie together, with lines or without, are cut if they have so many words; repeated lines always are.
MIN_PASSAGE_WORDS = 25
#: Words of a stretch between two anchors at least; an anchor's hash is the least of so many words on both sides.
MIN_STRETCH_WORDS = 25
ANCHOR_WORDS = 6
#: Characters whose words are hashed at once.
BLOCK_CHARS = 1 << 18
#: Letters of scripts without spaces, each of which is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED_LETTER = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")
_LINE = re.compile(r"[^\n]*\n?")
_SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?。！？]+[\"'”’)\]]*(?:\s+|$)|[.!?。！？]+|$)")


def normal(unit: str) -> str:
    """A unit as it is compared: NFC, lower case, white space runs as one space."""
    unit = unit if unit.isascii() else unicodedata.normalize("NFC", unit)
    return " ".join(unit.lower().split())


def digest(kind: str, text: str) -> bytes:
    """96 bits: the digests are most of what is written and shuffled."""
    return xxhash.xxh3_128_digest((kind + text).encode("utf-8", "surrogatepass"))[:12]


def sentences(line: str, at: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of a line that starts at `at`; what stands between two ends belongs to the later."""
    start = 0
    while start < len(line):
        end = start
        while end < len(line):
            end = _SENTENCE.match(line, end).end()
            if end >= len(line) or line[end - 1].isspace() or line[end - 1] in "。！？":
                break
        yield at + start, at + end
        start = end


def n_words(norm: str) -> int:
    """Words of a normal unit."""
    if norm.isascii() or not _UNSPACED_LETTER.search(norm):
        return norm.count(" ") + 1 if norm else 0
    return len(_WORD.findall(norm))


@cache
def _kinds() -> np.ndarray:
    """For each code point: 0 for white space, 2 for a word of its own, else 1."""
    kinds = np.ones(sys.maxunicode + 1, np.int8)
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = 0
    for first, last in re.findall("(.)-(.)", _UNSPACED):
        kinds[ord(first) : ord(last) + 1] = 2
    return kinds


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_starts(text: str) -> list[int]:
    """Offsets of what _WORD finds."""
    kinds = _kinds()[_codes(text)]
    before = np.concatenate([np.zeros(1, np.int8), kinds[:-1]])
    return np.flatnonzero((kinds == 2) | ((kinds == 1) & (before != 1))).tolist()


@cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))


def _sums(codes: np.ndarray, starts: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    """A polynomial hash of the characters from each start to the next one, without those outside."""
    x = (codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    at = np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))
    x *= _powers()[at & 0xFFFF]
    if inside is not None:
        x[~inside] = 0
    return np.add.reduceat(x, starts)


def word_hashes(text: str, starts: list[int]) -> np.ndarray:
    """A hash of each word in NFC and lower case, all words of a block at once."""
    low = text.lower()
    if len(low) != len(text) or not unicodedata.is_normalized("NFC", text):
        words = [unicodedata.normalize("NFC", w).lower() for w in _WORD.findall(text)]
        return np.array([_sums(_codes(w), np.zeros(1, np.int64), None)[0] for w in words], np.uint64)
    out, at = [], np.array(starts, np.int64)
    edges = np.searchsorted(at, np.arange(0, len(text), BLOCK_CHARS))
    for i, j in zip(edges, [*edges[1:], len(at)]):
        if i < j:
            first, last = at[i], at[j] if j < len(at) else len(text)
            out.append(_sums(_codes(low[first:last]), at[i:j] - first, _kinds()[_codes(text[first:last])] > 0))
    return np.concatenate(out)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Words at which the hash of three words is less than those around it: a passage has the same ones wherever it stands."""
    h = np.pad(hashes, (0, 2))
    h = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.lib.stride_tricks.sliding_window_view(np.pad(h, ANCHOR_WORDS, constant_values=np.uint64((1 << 64) - 1)), ANCHOR_WORDS).min(1)
    return np.flatnonzero((h < low[: len(h)]) & (h <= low[ANCHOR_WORDS + 1 :]))


def stretches(text: str) -> Iterator[tuple[bytes, int, int]]:
    """Units of whole words from each anchor to the first one MIN_STRETCH_WORDS or more behind it, wherever lines and sentences end."""
    starts = word_starts(text)
    if len(starts) < MIN_STRETCH_WORDS:
        return
    hashes = word_hashes(text, starts)
    at = np.concatenate([[0], (mid := anchors(hashes))[mid > 0], [len(starts)]])
    to = np.searchsorted(at, at + MIN_STRETCH_WORDS)
    raw, edges = hashes.tobytes(), [*starts, len(text)]
    for i, j in zip(at[to < len(at)].tolist(), at[to[to < len(at)]].tolist()):
        yield xxhash.xxh3_128_digest(raw[8 * i : 8 * j], 1)[:12], edges[i], edges[j]


def runs(parts: list[tuple[str, int, int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Units around short sentences (normal, words, start, end): each with those after it, and with those before it, up to MIN_SENTENCE_WORDS."""
    found = set()
    for i in [i for i, p in enumerate(parts) if p[1] < MIN_SENTENCE_WORDS]:
        for step in (1, -1):
            k, n = i, parts[i][1]
            while n < MIN_SENTENCE_WORDS and 0 <= k + step < len(parts):
                k += step
                n += parts[k][1]
            if n >= MIN_SENTENCE_WORDS:
                found.add((min(i, k), max(i, k)))
    for i, k in sorted(found):
        yield digest("r", " ".join(p[0] for p in parts[i : k + 1])), parts[i][2], parts[k][3]


def units(text: str) -> Iterator[tuple[bytes, int, int, bool]]:
    """(digest, start, end, whether a line) of a text's lines, sentences, runs of sentences with a short one, and stretches; offsets in characters."""
    parts: list[tuple[str, int, int, int]] = []
    for m in _LINE.finditer(text):
        if m.start() == m.end():
            break
        line = m[0]
        norm = normal(line)
        n = n_words(norm)
        if n >= MIN_LINE_WORDS:
            yield digest("l", norm), m.start(), m.end(), True
        for start, end in sentences(line, m.start()) if n else ():
            part = normal(text[start:end])
            if k := n_words(part):
                parts.append((part, k, start, end))
                if k >= MIN_SENTENCE_WORDS:
                    yield digest("s", part), start, end, False
    for extra in (runs(parts), stretches(text)):
        yield from ((*unit, False) for unit in extra)


def occurrences(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, tag, start, stop, line) of each unit of docs (doc_id, tag, text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, digests, starts, stops, lines = [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for d, start, stop, line in units(t or ""):
                    ids.append(i)
                    digests.append(d)
                    starts.append(start)
                    stops.append(stop)
                    lines.append(line)
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), b.column(0).take(at), b.column(1).take(at), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(lines, pa.bool_())],
                ["digest", "doc_id", "tag", "start", "stop", "line"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda it: tidy(batches(it)), f"digest binary, doc_id {kind}, tag bigint, start int, stop int, line boolean")


def place(found: DataFrame) -> Column:
    """The rank of an occurrence: by doc_id, then the text's hash, then the offset.

    As one decimal for ids of up to 64 bits, since a minimum of that is hashed
    and not sorted; the text's hash has eight digits there, which only orders
    different texts under one id.
    """
    if isinstance(found.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        tag = F.pmod("tag", F.lit(10**8)).cast("decimal(8,0)")
        return (F.col("doc_id").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") + tag * F.lit(10**10).cast("decimal(11,0)") + F.col("start")
    return F.struct("doc_id", "tag", "start")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def chosen(text: str, spans: list[dict], min_words: int) -> list[tuple[int, int]]:
    """What is cut of the repeated units: lines, and others where those that lie together have min_words words or more."""
    lines = merged((s["start"], s["stop"]) for s in spans if s["line"])
    if len(lines) == len(spans):
        return lines
    long = [(a, b) for a, b in merged((s["start"], s["stop"]) for s in spans) if len(word_starts(text[a:b])) >= min_words]
    return merged([*lines, *long])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at:start])
        at = stop
    return "".join([*kept, text[at:]])


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_PASSAGE_WORDS) -> DataFrame:
    """All columns of docs with repeated units cut from the text, and removed_spans array<struct<start,stop>>.

    Units are lines of MIN_LINE_WORDS words or more, sentences of
    MIN_SENTENCE_WORDS or more, runs of sentences that bring a short one to that
    number, and stretches of MIN_STRETCH_WORDS or more between words that are
    chosen by what stands around them, so that a long passage is found within
    sentences and across lines. Of each unit that occurs more than once the
    occurrence with the smallest (doc_id, offset) stays, in that document only,
    and the others go: every line, and of the other units those that make up
    `min_words` words or more where they stand, together with what they touch;
    offsets are of the original text, in characters. Rows
    with a null id or text are kept as they are and are no occurrence. Rows with
    an equal doc_id and text are one document: each keeps what that document
    keeps. Different texts under one doc_id are different documents, in the order
    of a hash of the text. An existing column removed_spans is replaced.

    Digests are grouped with a minimum that is combined before its shuffle. Only
    the repeated ones meet the occurrences again, and both sides of that join are
    read from written tables, so adaptive execution can split a line that a third
    of the documents have.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).dropna()
    # only where an id repeats do units need to tell its texts apart
    again = materialize(src.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")), "again")
    tag = F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    tagged = src.join(again, F.col("doc_id") == F.col("again"), "left").select("doc_id", tag.alias("tag"), "text")
    found = materialize(occurrences(tagged), "units")
    at = place(found)
    firsts = found.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    repeated = materialize(firsts.filter("n > 1").select("digest", "first"), "repeated")
    later = found.join(repeated, "digest").filter(at != F.col("first")).select("doc_id", "tag", "start", "stop", "line")
    spans = materialize(later.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "stop", "line")).alias("spans")), "spans")
    discard(again, found, repeated)

    @F.pandas_udf("text string, spans array<struct<start:int,stop:int>>")
    def apply(texts, spans):
        import pandas as pd

        rows = []
        for t, s in zip(texts, spans):
            got = chosen(t, s, min_words) if s is not None and len(s) else []
            rows.append((cut(t, got) if got else t, [{"start": a, "stop": b} for a, b in got]))
        return pd.DataFrame(rows, columns=["text", "spans"])

    named = spans.select(F.col("doc_id").alias("__span_doc"), F.col("tag").alias("__span_tag"), F.col("spans").alias("__spans"))
    on = (F.col(id_col) == F.col("__span_doc")) & ((F.col("__span_tag") == 0) | (F.col("__span_tag") == F.xxhash64(text_col)))
    joined = docs.drop("removed_spans").join(named, on, "left").withColumn("__cut", apply(F.col(text_col), F.col("__spans")))
    return joined.withColumn(text_col, F.col("__cut.text")).withColumn("removed_spans", F.col("__cut.spans")).drop("__span_doc", "__span_tag", "__spans", "__cut")
