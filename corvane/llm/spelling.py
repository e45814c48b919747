"""Spelling variants by full neighbourhood generation: all words one edit away over the observed alphabet, joined to the vocabulary.

A word of L letters has about 2 L A neighbours over an alphabet of A. They are
hashed from prefix and suffix sums of a rolling hash, so that each costs the
same for words of any length, and those that a Bloom filter of the vocabulary
rules out are never written out. The others become words and are joined to the
vocabulary by equality, which is the whole test: no distance is computed. A
filter has a bounded size; a larger vocabulary is gone through in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, materialize, tidy

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS = 6
MIN_COUNT = 5
#: A word's form occurs so many times as often at least.
RATIO = 5
#: Of the runs of a document those are altered whose crc32 this divides.
ALTERED = 199
#: The filter: segments of 2^23 bits (1 MB), about so many bits and so many hashes a word, and segments at most at a time.
SEGMENT_BITS = 23
WORD_BITS = 16
HASHES = 3
MAX_SEGMENTS = 64
#: Neighbours that are hashed at once.
CELLS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def altered_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): each run of letters of each text, lower-cased and, for one run of ALTERED, with a letter deleted."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= MIN_LETTERS)
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select(run.alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % ALTERED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counts are combined before their shuffle."""
    words = altered_words(docs, id_col, text_col).filter(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_keys(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), _BASE, np.uint64))])[:n]


class Words:
    """Words of a batch, letter by letter, with the rolling hash of what stands before and behind each letter."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.at = np.arange(len(self.codes)) - self.start[self.word]
        self.power = powers(int(self.length.max(initial=0)) + 1)
        self.term = letter_keys(self.codes) * self.power[self.at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.term)])
        self.total = sums[self.start + self.length] - sums[self.start]
        self.before = sums[:-1] - sums[self.start][self.word]
        self.behind = self.total[self.word] - self.before - self.term


def neighbours(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words, str]]:
    """Blocks (hashes, word numbers, places, letters, words, kind) of all distinct deletions, replacements and insertions.

    A deletion within a run of one letter is made at its first place only, and no
    letter is inserted behind its like, so that nothing is made twice.
    """
    w = Words(words)
    if not len(w.codes):
        return
    keys = letter_keys(alphabet)
    same = np.concatenate([[False], w.codes[1:] == w.codes[:-1]]) & (w.at > 0)
    first = np.flatnonzero(~same)
    yield w.before[first] + w.behind[first] * _BACK, w.word[first], w.at[first], np.zeros(len(first), np.uint32), w, "deletion"
    # places of insertions: before each letter, and behind the last one
    ends = w.start + w.length
    place = np.concatenate([np.arange(len(w.codes)), ends - 1])
    behind_last = np.arange(len(place)) >= len(w.codes)
    step = max(1, CELLS // max(len(alphabet), 1))
    for lo in range(0, len(w.codes), step):
        s = slice(lo, min(lo + step, len(w.codes)))
        rest = w.before[s] + w.behind[s]
        h = rest[:, None] + keys[None, :] * w.power[w.at[s]][:, None]
        i, k = np.nonzero(alphabet[None, :] != w.codes[s][:, None])
        yield h[i, k], w.word[s][i], w.at[s][i], alphabet[k], w, "replacement"
    for lo in range(0, len(place), step):
        p, last = place[lo : lo + step], behind_last[lo : lo + step]
        at = w.at[p] + last
        head = w.before[p] + np.where(last, w.term[p], np.uint64(0))
        tail = (w.behind[p] + np.where(last, np.uint64(0), w.term[p])) * _BASE
        tail[last] = 0
        h = (head + tail)[:, None] + keys[None, :] * w.power[at][:, None]
        left = np.where(at > 0, w.codes[np.where(last, p, np.maximum(p - 1, 0))], 0)
        i, k = np.nonzero(alphabet[None, :] != left[:, None])
        yield h[i, k], w.word[p][i], at[i], alphabet[k], w, "insertion"


def edited(word: str, at: int, letter: str, kind: str) -> str:
    return word[:at] + ("" if kind == "deletion" else letter) + word[at + (kind != "insertion") :]


def bits(hashes: np.ndarray, segments: int, width: int = SEGMENT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(segment, bits within it as one row a hash) of rolling hashes; all bits of a word are in one segment."""
    x = mixed(hashes)
    mask = np.uint64((1 << width) - 1)
    y = mixed(x + _BASE)
    rows = np.stack([x & mask, (x >> np.uint64(width)) & mask, y & mask][:HASHES])
    return ((y >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), rows.astype(np.int64)


def segments_of(vocab: DataFrame, segments: int) -> DataFrame:
    """(segment, bits binary): one row of 1 MB for each segment that has a word, of rolling hashes grouped by segment."""
    width = SEGMENT_BITS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = Words(b.column(0).to_pylist()).total
            yield pa.RecordBatch.from_arrays([pa.array(bits(total, segments, width)[0].astype(np.int32)), pa.array(total.view(np.int64))], ["segment", "h"])

    def filled(pdf):
        import pandas as pd

        on = np.zeros(1 << width, bool)
        on[bits(pdf["h"].to_numpy(np.int64).view(np.uint64), segments, width)[1].ravel()] = True
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    return vocab.select("word").mapInArrow(hashed, "segment int, h bigint").groupBy("segment").applyInPandas(filled, "segment int, bits binary")


def likely_neighbours(vocab: DataFrame, alphabet: np.ndarray, segments: int, size: int) -> DataFrame:
    """(word, n, near): neighbours of each word that the vocabulary's filter doesn't rule out, for all segments, MAX_SEGMENTS at a time."""
    spark, width = vocab.sparkSession, SEGMENT_BITS
    made = materialize(segments_of(vocab, segments), "filter")
    out = []
    for low in range(0, segments, MAX_SEGMENTS):
        high = min(low + MAX_SEGMENTS, segments)
        table = np.zeros((high - low, 1 << width - 3), np.uint8)
        for r in made.filter(F.col("segment").between(low, high - 1)).toLocalIterator():  # MAX_SEGMENTS MB at most
            table[r["segment"] - low] = np.frombuffer(r["bits"], np.uint8)
        sent = spark.sparkContext.broadcast(table)

        def passing(batches: Iterator[pa.RecordBatch], sent=sent, low=low, high=high) -> Iterator[pa.RecordBatch]:
            letters = {int(c): chr(c) for c in alphabet}
            for b in batches:
                words, counts = b.column(0).to_pylist(), b.column(1)
                for h, word, at, letter, _, kind in neighbours(words, alphabet):
                    segment, rows = bits(h, segments, width)
                    pick = np.flatnonzero((segment >= low) & (segment < high))
                    for row in rows:
                        r = row[pick]
                        pick = pick[(sent.value[segment[pick] - low, r >> 3] >> (r & 7).astype(np.uint8)) & 1 == 1]
                    if len(pick):
                        of = word[pick].tolist()
                        near = [edited(words[k], a, letters.get(c, ""), kind) for k, a, c in zip(of, at[pick].tolist(), letter[pick].tolist())]
                        took = pa.array(of)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(took), counts.take(took), pa.array(near, pa.string())], ["word", "n", "near"])

        parts = max(8, min(4096, -(-size // 20_000)))
        out.append(materialize(vocab.repartition(parts).mapInArrow(lambda it, f=passing: tidy(f(it)), "word string, n bigint, near string"), "neighbours"))
    discard(made)
    whole = out[0]
    for df in out[1:]:
        whole = whole.union(df)
    return whole


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words of vocab (word, n) that differ by one letter inserted, deleted or replaced, both ways."""
    size, longest = vocab.agg(F.count("*"), F.max(F.length("word"))).first()
    if not size:
        return vocab.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    found = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # an alphabet
    alphabet = np.array(sorted(ord(r["c"]) for r in found if r["c"]), np.uint32)
    segments = -(-size * WORD_BITS // (1 << SEGMENT_BITS))
    likely = likely_neighbours(vocab, alphabet, segments, size)
    names = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return likely.join(names, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each step follows all forms that have been found so far, so that a chain's length is halved."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        more = moved.filter("moved").limit(1).count()
        discard(state)
        state = moved
        if not more:
            return state.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters of whole texts, A-Z lower-cased, one run of
    199 by crc32 of "id:run" with a letter deleted (a null id counts as empty);
    those of 6 letters or more with 5 occurrences or more are the vocabulary. Null
    and empty texts have no words. A word's near words differ from it by one
    letter; its form is the most frequent of them (ties: the smallest) where that
    occurs `ratio` times as often at least, and its root is where its forms end.
    Repeated rows count as often as they occur; words of any length are handled
    alike; other columns are ignored; an empty table gives no rows.
    """
    vocab = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    near = near_words(vocab)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = vocab.join(best, "word", "left")
    form_n: Column = -F.col("best.less")
    has = form_n >= ratio * F.col("n")
    named = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, form_n).alias("form_n")
    )
    named = materialize(named, "forms")
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows by another way: crc32 bit by bit over bytes, and pairs from words with one letter left out.
ORACLE_SQL = """
WITH RECURSIVE bytes AS (SELECT range AS b, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bytes WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bytes WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n, id || ':' || run AS key FROM runs WHERE length(run) >= 6 GROUP BY id, run),
hexed AS (SELECT *, hex(encode(key)) AS x FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS INT), 2)) AS BIGINT)),
    lambda a, v: xor(a >> 8, t[CAST(xor(a & 255, v) + 1 AS INT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM hexed, crc),
altered AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
short AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM short a JOIN short b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM short a JOIN words b ON a.s = b.word
    UNION SELECT b.word, a.word, a.n FROM short a JOIN words b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n,
    CASE WHEN b.top >= 5 * w.n THEN (SELECT min(x.near) FROM near x WHERE x.word = w.word AND x.near_n = b.top) END AS form FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON c.root = e.word WHERE e.form IS NULL
"""
