"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of 1 to 3 characters; the kernel
of two texts is the number of n-grams that both have, over the geometric mean
of their numbers. Nystroem landmarks make it a short feature vector, on which
one-versus-rest kernel ridge regression learns; a batch of texts is scored by
two matrix products.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: n-grams are told apart by a hash of so many bits.
BITS = 20
#: Bounds of the sample that is learned from, and of the landmarks.
TRAIN_ROWS = 3000
LANDMARKS = 120
RIDGE = 1e-3
BLOCK = 64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case (first character), and whether it is a letter."""
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            letter[cp] = True
            lower[cp] = ord(c.lower()[0])
    return lower, letter


def grams(text: str | None) -> np.ndarray | None:
    """Hashes of the n-grams that a whole text has, ascending; None if it is null or has no letter."""
    if not text:
        return None
    lower, letter = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[codes]
    if not is_letter.any():
        return None
    c = np.pad(np.where(is_letter, lower[codes], np.uint32(32)), 1, constant_values=32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    shift = np.uint32(32 - BITS)
    h = c * np.uint32(2654435761)
    found = [(h >> np.uint32(11)) * np.uint32(3266489917) >> shift]
    h = (h ^ (h >> 15))[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
    found.append((h ^ (h >> 13)) * np.uint32(668265263) >> shift)
    if len(c) > 2:
        h = (h ^ (h >> 15))[:-1] * np.uint32(374761393) + c[2:] * np.uint32(2654435761)
        found.append((h ^ (h >> 13)) * np.uint32(2246822519) >> shift)
    every = np.concatenate(found)
    if len(every) < 1 << 16:
        return np.unique(every)
    seen = np.zeros(1 << BITS, bool)
    seen[every] = True
    return np.flatnonzero(seen).astype(np.uint32)


@dataclass
class Model:
    """langs: the learned values; columns: hashes that landmarks have; landmarks: their presence over sqrt of their size; weights: landmark kernels to scores."""

    langs: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    _places: np.ndarray | None = None

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        place = self.places()
        x = np.zeros((len(sets), len(self.columns)), np.float32)
        for row, s in zip(x, sets, strict=True):
            at = place[s]
            row[at[at >= 0]] = 1 / np.sqrt(len(s))
        return x @ self.landmarks

    def places(self) -> np.ndarray:
        """For each hash its column, or -1."""
        if self._places is None:
            self._places = np.full(1 << BITS, -1, np.int32)
            self._places[self.columns] = np.arange(len(self.columns), dtype=np.int32)
        return self._places

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        for at in range(0, len(texts), BLOCK):
            found = [(i, g) for i, t in enumerate(texts[at : at + BLOCK], at) if (g := grams(t)) is not None]
            if found:
                out = self.kernels([g for _, g in found]) @ self.weights
                for (i, _), row in zip(found, out, strict=True):
                    k = int(row.argmax())
                    langs[i], scores[i] = self.langs[k], float(min(1.0, max(0.0, row[k])))
        return langs, scores


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Model of n-gram sets and their labels; an equal number of landmarks from each label, in the given order."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    each = max(1, landmarks // len(langs))
    chosen = [i for lang in langs for i in [j for j, x in enumerate(labels) if x == lang][:each]]
    columns = np.unique(np.concatenate([sets[i] for i in chosen]))
    marks = np.zeros((len(columns), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[np.searchsorted(columns, sets[i]), k] = 1 / np.sqrt(len(sets[i]))
    model = Model(langs, columns, marks, np.zeros((len(chosen), len(langs)), np.float32))
    between = model.kernels([sets[i] for i in chosen]).astype(np.float64)
    value, vector = np.linalg.eigh((between + between.T) / 2)
    value, vector = value[value > 1e-6 * value.max()], vector[:, value > 1e-6 * value.max()]
    root = vector / np.sqrt(value)
    phi = np.concatenate([model.kernels(sets[at : at + BLOCK]) for at in range(0, len(sets), BLOCK)]).astype(np.float64) @ root
    target = np.array([[x == lang for lang in langs] for x in labels], np.float64)
    weights = np.linalg.solve(phi.T @ phi + ridge * len(sets) * np.eye(phi.shape[1]), phi.T @ target)
    model.weights = (root @ weights).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, mod 3, is 1; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on `rows` documents at most, of those with an id, a text and a language that are not held out, in the order of a hash of the id.

    Executors turn texts into hashes of their n-grams; the driver gets those only.
    """

    def bins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [(g, lang) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (g := grams(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g.astype("<u4").tobytes() for g, _ in got], pa.binary()), pa.array([x for _, x in got], pa.string())], ["grams", "lang"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().filter(~held_out("doc_id"))
    ids = src.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows)
    last = ids.agg(F.max("h")).first()[0]
    sample = src.filter(F.xxhash64("doc_id") <= (last if last is not None else 0)).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
    got = sample.select("text", "lang").mapInArrow(bins, "grams binary, lang string").collect()
    return fit([np.frombuffer(r["grams"], "<u4") for r in got], [r["lang"] for r in got])


def predictor(model: Model, spark):
    """Column function: text -> struct<lang, score>."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Only documents that are not held out are learned from; the prediction uses
    the text alone. Null texts and texts without a letter are `und` with score 0,
    as is every text if nothing can be learned. Null ids are not learned from and
    not held out; repeated rows each get a row; extra columns are ignored.
    """
    predict = predictor(train(docs, id_col, text_col, lang_col), docs.sparkSession)
    return (
        docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p"))
        .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
    )
