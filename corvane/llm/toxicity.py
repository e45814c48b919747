"""Toxicity by a classifier chain.

The categories, themes of toxic texts and then toxic itself, are predicted in
order by linear models. A model sees words and stems of the text and the
probabilities of the categories before it; in training those probabilities are
out of fold, so that they are as uncertain as later.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize

#: The labels only say toxic or not. The categories before that are themes: groups of toxic texts by the features they share, learned from the sample.
CHAIN = ("theme_a", "theme_b", "toxic")

#: Bounds of the sample that is learned from, and of the words that are features of the model; the features are chosen from all words of the sample.
TRAIN_ROWS = 4000
FEATURES = 160
MIN_DOCS = 8
FOLDS = 4
L2 = 0.3
STEPS = 12
THRESHOLD = 0.5
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, wanted: Container[str] | None = None) -> set[str]:
    """Binary features of a whole text: its words, and its stems by how they are used.

    A stem stands for the longer words that begin with it: `stem*` if those are
    at least one in 1,000 words, `stem**` if one in 250, `stem+` if besides they
    have two forms or more. Rates, not counts, keep long texts apart from toxic
    ones. With `wanted`, only stems in it are looked at.
    """
    counts = Counter(_WORD.findall((text or "").lower()))
    found, total = set(counts), sum(counts.values())
    stems: dict[str, list[int]] = {}
    for w, c in counts.items():
        for n in STEMS:
            if len(w) <= n:
                break
            if wanted is None or w[:n] in wanted:
                got = stems.setdefault(w[:n], [0, 0])
                got[0] += 1
                got[1] += c
    for stem, (forms, c) in stems.items():
        if 1000 * c >= total:
            found.add(stem + "*")
            if 250 * c >= total:
                found.add(stem + "**")
            if forms > 1:
                found.add(stem + "+")
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = STEPS) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method; the last column of x is the intercept and is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    """words: feature -> column; weights: one vector per category, over those, the earlier probabilities and an intercept."""

    categories: tuple[str, ...]
    words: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.stems = frozenset(w.rstrip("*+") for w in self.words if w[-1] in "*+")

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        n = len(texts)
        if not self.weights:
            return np.zeros((n, len(self.categories)))
        out = np.zeros((n, 0))
        scores = np.zeros((n, len(self.categories)))
        known, stems = self.words.keys(), self.stems
        table = np.stack([w[: len(self.words)] for w in self.weights], 1)
        for i, t in enumerate(texts):
            scores[i] = table[[self.words[w] for w in known & features(t, stems)]].sum(0)
        for k, w in enumerate(self.weights):
            p = _sigmoid(scores[:, k] + out @ w[len(self.words) : -1] + w[-1])
            out = np.concatenate([out, p[:, None]], 1)
        return out


def fit(sets: list[set[str]], labels: np.ndarray, chosen: list[str], categories: tuple[str, ...] = CHAIN) -> Chain:
    """A chain over feature sets and a 0/1 matrix with a column per category, on the chosen features.

    Rows are dealt into folds in turn.
    """
    if not chosen or not labels.any():
        return Chain(categories)
    n, columns = len(sets), {w: k for k, w in enumerate(chosen)}
    x = np.zeros((n, len(chosen)))
    for i, s in enumerate(sets):
        x[i, [columns[w] for w in columns.keys() & s]] = 1
    folds = np.arange(n) % FOLDS
    earlier, weights = np.zeros((n, 0)), []
    for k in range(len(categories)):
        full = np.concatenate([x, earlier, np.ones((n, 1))], 1)
        y = labels[:, k].astype(float)
        p = np.zeros(n)
        for f in range(FOLDS):
            if (folds == f).any() and (folds != f).any():
                p[folds == f] = _sigmoid(full[folds == f] @ logistic(full[folds != f], y[folds != f]))
        weights.append(logistic(full, y))
        earlier = np.concatenate([earlier, p[:, None]], 1)
    return Chain(categories, columns, weights)


def themes(x: np.ndarray, k: int = len(CHAIN) - 1, rounds: int = 10) -> np.ndarray:
    """A theme from 0 for each row of a 0/1 matrix, by cosine to k middles that begin far apart; the largest theme comes first."""
    x = x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    seeds = [int((x @ x.mean(0)).argmax())]
    while len(seeds) < k:
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    middles = x[seeds]
    for _ in range(rounds):
        own = (x @ middles.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) for j in range(k)])
        middles = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    own = (x @ middles.T).argmax(1)
    place = np.argsort(np.argsort(-np.bincount(own, minlength=k), kind="stable"), kind="stable")
    return place[own]


def categorised(sets: list[set[str]], toxic: np.ndarray, chosen: list[str]) -> np.ndarray:
    """The 0/1 matrix of CHAIN: a toxic text has one theme, by the chosen features, and is toxic."""
    out = np.zeros((len(sets), len(CHAIN)), bool)
    out[:, -1] = toxic
    rows = np.flatnonzero(toxic)
    if len(rows) and chosen:
        x = np.array([[w in sets[i] for w in chosen] for i in rows], float)
        out[rows, themes(x)] = True
    return out


def choose(bags: DataFrame, most: int = FEATURES) -> list[str]:
    """The features of bags (bag, toxic 0/1) whose presence tells most about toxic, by chi-square.

    Of those in MIN_DOCS texts or more, and in one toxic text at least.
    """
    total = bags.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n = total["n"]
    if not n or not total["toxic"]:
        return []
    seen = bags.select(F.explode("bag").alias("feature"), "toxic").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    seen = seen.filter((F.col("n") >= MIN_DOCS) & (F.col("toxic") > 0))
    expected = F.col("n") * (total["toxic"] / n)
    chi = F.pow(F.col("toxic") - expected, 2) / F.greatest(expected * (1 - F.col("n") / n), F.lit(1e-9))
    return sorted(r["feature"] for r in seen.orderBy(F.desc(F.round(chi, 6)), "feature").limit(most).collect())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """Fit on `rows` labelled documents at most, in the order of a hash of the id.

    labels has (doc_id, toxic); rows with a null in either are not used, and a
    document labelled more than once is toxic if any label says so. Texts become
    feature bags on the executors, where the features are chosen too; the driver
    gets the chosen features of each sampled text only.
    """

    def bagged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(features(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["h", "toxic", "bag"])

    known = labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("labelled")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    # of the labelled ids that are documents with a text, the first `rows` by their hash
    there = known.join(src.select("doc_id"), F.col("labelled") == F.col("doc_id"), "left_semi")
    known = materialize(there.orderBy(order, "labelled").limit(rows), "known")
    sample = src.join(known, src.doc_id == known.labelled).select(order.alias("h"), "toxic", "text")
    bags = materialize(sample.mapInArrow(bagged, "h bigint, toxic int, bag array<string>"), "bags")
    chosen = choose(bags)
    got = bags.select("h", "toxic", F.array_intersect("bag", F.array(*map(F.lit, chosen or [""]))).alias("bag")).orderBy("h", "bag").limit(rows).collect()
    sets = [set(r["bag"]) for r in got]
    return fit(sets, categorised(sets, np.array([r["toxic"] for r in got], bool), chosen), chosen)


def scorer(chain: Chain, spark):
    """Column function: text -> struct of a probability per category."""
    shared = spark.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{c} double" for c in chain.categories))
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.probabilities([t if isinstance(t, str) else None for t in texts]), columns=list(chain.categories))

    return score


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, p_theme_a, p_theme_b, p_toxic, toxic boolean (p_toxic >= threshold).

    Whole texts are scored. A null or wordless text has the intercepts'
    probabilities; without toxic labels all probabilities are 0. Null ids,
    repeated rows and empty tables keep their rows; extra columns are ignored.
    """
    score = scorer(train(docs, labels, id_col, text_col), docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("p")).select(
        "doc_id", *(F.col(f"p.{c}").alias(f"p_{c}") for c in CHAIN), (F.col("p.toxic") >= threshold).alias("toxic")
    )
