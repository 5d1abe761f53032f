"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees word features and the probabilities that the models
before it gave. In training those probabilities are out-of-fold predictions. The threshold of the last category is
the one of best F-score on out-of-fold predictions, with BETA for recall: clean documents weigh more.

Training takes at most MAX_TRAIN labelled documents, the first in an order by hash of doc_id, and FEATURES words,
those whose presence tells the categories apart best in that sample; both bounds are parameters. Scoring reads all
texts whole. Null texts are empty; rows with a null label are not trained on; without labels of both kinds a
category's probability is its smoothed share. A doc_id repeated in documents or labels is trained on once, with the
text of least hash and the least labels, whatever the order of rows. Of extra columns, score() carries none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM

MAX_TRAIN, FEATURES, FOLDS, PENALTY, BETA = 12_000, 512, 5, 0.5, 0.7
CATEGORIES = ("low_quality", "toxic")


def word_set(raw: bytes | None) -> list[int]:
    return [xxhash.xxh64_intdigest(w) for w in set((raw or b"").translate(ALNUM).split())]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 12) -> np.ndarray:
    """Newton steps for an L2-penalised logistic model; the last weight is the intercept, which has no penalty."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    x1 = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x1 * s[:, None]).T @ x1 + np.diag(ridge), x1.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-5:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """words: the features' hashes, sorted; weights: a vector per category (words, earlier categories, intercept)."""

    categories: tuple[str, ...]
    words: np.ndarray
    weights: list[np.ndarray]
    threshold: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """x: presence of the words, one row per document; a column of probabilities per category."""
        out = np.empty((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, probability(np.column_stack([x, out]), w)])
        return out


def select_words(sets: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The words that go with a category the most, by chi-square; each category has an equal share of them."""
    words, at = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    total = np.bincount(at, minlength=len(words)).astype(float)
    chosen: list[np.ndarray] = []
    n = len(sets)
    for j in range(y.shape[1]):
        got = np.bincount(at, weights=y[doc, j], minlength=len(words))
        share = max(y[:, j].mean(), 1e-9) if n else 0
        expect = total * share
        score = np.where((total >= 3) & (got > expect), (got - expect) ** 2 / np.maximum(expect, 1e-9) / np.maximum(1 - total / max(n, 1), 1e-9), 0)
        best = np.argsort(-score, kind="stable")[: most // y.shape[1]]
        chosen.append(best[score[best] > 0])
    return words[np.unique(np.concatenate(chosen))] if chosen else words[:0]


def presence(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(words)))
    for i, s in enumerate(sets):
        x[i, np.flatnonzero(np.isin(words, s))] = 1
    return x


def fit_chain(sets: list[np.ndarray], y: np.ndarray, fold: np.ndarray, categories=CATEGORIES, features: int = FEATURES) -> Chain:
    words = select_words(sets, y, features)
    x = presence(sets, words)
    known, weights = np.empty((len(x), 0)), []
    for j in range(y.shape[1]):
        seen, p = np.column_stack([x, known]), np.empty(len(x))
        for f in range(FOLDS):
            out = fold == f
            p[out] = probability(seen[out], fit_logistic(seen[~out], y[~out, j]))
        weights.append(fit_logistic(seen, y[:, j]))
        known = np.column_stack([known, p])
    return Chain(tuple(categories), words, weights, best_threshold(known[:, -1], y[:, -1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F-score, midway to the next lower probability; 1, never reached, without positives."""
    if not y.sum():
        return 1.0
    order = np.argsort(-p, kind="stable")
    q, hit = p[order], np.cumsum(y[order])
    f = (1 + BETA**2) * hit / (np.arange(1, len(q) + 1) + BETA**2 * y.sum())
    f[:-1][q[:-1] == q[1:]] = 0  # equal probabilities are taken together
    i = int(np.argmax(f))
    return float((q[i] + (q[i + 1] if i + 1 < len(q) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain:
    """labels: doc_id, then a 0/1 column per category, in the order of the chain."""
    categories = tuple(c for c in labels.columns if c != "doc_id")
    least = labels.dropna().groupBy("doc_id").agg(F.min(F.struct(*categories)).alias("y")).select("doc_id", "y.*")
    sample = least.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches):
        for b in batches:
            sets = [np.array(word_set(x), np.uint64).tobytes() for x in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *(b.column(i) for i in range(1, b.num_columns))], names=["words", "fold", *categories])

    part = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(sample), "doc_id")  # at most max_train rows broadcast
    once = F.min_by("raw", F.struct(F.xxhash64("raw").alias("h"), F.length("raw").alias("n"))).alias("raw")
    part = part.groupBy("doc_id", *categories).agg(once)  # at most max_train rows
    part = part.select("raw", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), *(F.col(c).cast("double") for c in categories))
    got = part.mapInArrow(run, "words binary, fold int, " + ", ".join(f"{c} double" for c in categories)).toArrow()
    sets = [np.frombuffer(x, np.uint64) for x in got["words"].to_pylist()]
    y = np.column_stack([got[c].to_numpy() for c in categories])
    return fit_chain(sets, y, got["fold"].to_numpy(), categories)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability per category (p_<name>) and toxic, whether the last one reaches the threshold."""
    last = chain.categories[-1]

    def run(batches):
        # Words are told by themselves, not by place: a word's column number, or None for the many others.
        column: dict[bytes, int | None] = {}
        for b in batches:
            raw = b.column("raw").to_pylist()
            x = np.zeros((len(raw), len(chain.words)))
            for i, t in enumerate(raw):
                for w in set((t or b"").translate(ALNUM).split()):
                    if w not in column:
                        if len(column) > 300_000:
                            column.clear()
                        h = np.uint64(xxhash.xxh64_intdigest(w))
                        k = int(np.searchsorted(chain.words, h))
                        column[w] = k if k < len(chain.words) and chain.words[k] == h else None
                    if (k := column[w]) is not None:
                        x[i, k] = 1
            p = chain.predict(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= chain.threshold)], names=["doc_id", *(f"p_{c}" for c in chain.categories), last])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = "".join(f", p_{c} double" for c in chain.categories)
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}{fields}, {last} boolean")


def label_columns(labels: DataFrame) -> DataFrame:
    """The chain's categories from the labels table: low quality first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the chain calls toxic; columns as they are."""
    chain = train(docs, label_columns(labels))
    columns = docs.columns

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(columns.index("text")).to_pylist()]
            p = chain.predict(presence([np.array(word_set(t), np.uint64) for t in raw], chain.words))
            yield b.filter(pa.array(p[:, -1] < chain.threshold))

    return docs.mapInArrow(run, docs.schema)
