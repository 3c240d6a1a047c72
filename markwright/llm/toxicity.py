"""Toxicity by a classifier chain.

Categories are label columns, in the order of the chain; each has a logistic regression over the distinct words that are or
begin like a feature (a word, or the first 4 to 7 letters of words), a few figures of the text, and the log odds that the models before it gave. While fitting, those odds come from models that
haven't seen the row (FOLDS folds); while predicting, from the models fitted on all rows. Here the labels hold one toxic
category, "toxic"; "low_quality" (quality = 0) stands before it in the chain. A document is rejected by the last category.

Fitted on the driver from a bounded sample: the SAMPLE labelled rows with the smallest hash of the id, as counts of
features of the vocabulary (FEATURES_KNOWN at most, in LEAST sample documents or more). The model is a few thousand numbers. Documents are
scored whole and one by one, without a shuffle. While fitting, each fold's features are chosen without that fold too, so the
odds handed on come from models that have seen nothing of the row.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, settle

SAMPLE = 10_000
FEATURES_KNOWN = 40_000
LEAST = 5
FEATURES = 300
BEGINNINGS = (4, 5, 6, 7)
MOST = 5
FOLDS = 5
RIDGE = 0.3
CUT = 0.5
CHAIN = ("low_quality", "toxic")
_TOKEN = re.compile(r"[^\W\d_]+")


def figures(text: str) -> list[float]:
    """Logs of length, and shares of symbols, digits and repeated words."""
    n, words = max(1, len(text)), text.split()
    symbols = sum(map(text.count, "#*$%&|<>"))
    digits = sum(map(text.count, "0123456789"))
    return [float(np.log1p(len(words))) / 5, min(1.0, 10 * symbols / n), min(1.0, 10 * digits / n), 1 - len(set(words)) / max(1, len(words))]


N_FIGURES = 4


def tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def features(text: str, known=None) -> tuple[dict[str, int], int]:
    """How many distinct words are, or (with "^") begin like, each feature, MOST at most; the number of distinct words.

    known: the only features to count."""
    words, out = tokens(text), {}
    for t in words:
        if known is None or t in known:
            out[t] = 1
        for n in BEGINNINGS:
            if len(t) <= n:
                break
            f = f"^{t[:n]}"
            if known is None or f in known:
                out[f] = min(MOST, out.get(f, 0) + 1)
    return out, len(words)


def weight(words: int) -> float:
    """Counts weigh less in long texts, where more comes up by chance."""
    return 10 / (words + 1) ** 0.5


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights (the last one is the constant) of a ridge-penalised logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def screened(sets: list[np.ndarray], y: np.ndarray, size: int, most: int) -> list[int]:
    """The features whose rates in the two classes differ most, in standard errors."""
    n1, n = max(1, y.sum()), len(y)
    all_, in1 = np.zeros(size), np.zeros(size)
    for s, t in zip(sets, y, strict=True):
        all_[s] += 1
        if t:
            in1[s] += 1
    rate = (all_ + 0.5) / (n + 1)
    z = np.abs(in1 / n1 - (all_ - in1) / max(1, n - n1)) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / max(1, n - n1)))
    return sorted(np.argsort(-z, kind="stable")[:most].tolist())


class Chain:
    """predict(text) -> a probability for each category."""

    def __init__(self, chain: tuple[str, ...]):
        self.chain = chain
        self.models: list[tuple[dict[str, int], np.ndarray]] = []  # feature -> place, weights
        self.known: set[str] = set()
        self.unseen: list[np.ndarray] = []  # of each category, the log odds of the rows it was fitted on, by models of other folds

    def fit(self, rows: list[tuple], vocabulary: list[str], folds: int = FOLDS) -> Chain:
        """rows: (fold number, places in the vocabulary, counts (both packed arrays), distinct words, figures, *labels); none:
        nothing is rejected."""
        if not rows:
            return self
        fold = np.array([r[0] % folds for r in rows])
        sets, more = [np.frombuffer(r[1], np.int32) for r in rows], np.array([r[4] for r in rows], float).reshape(len(rows), N_FIGURES)
        before = np.zeros((len(rows), 0))
        for c in range(len(self.chain)):
            y = np.array([r[5 + c] for r in rows], float)

            def table(chosen):
                place = np.full(len(vocabulary), -1)
                place[chosen] = np.arange(len(chosen))
                x = np.zeros((len(rows), len(chosen)))
                for i, (_, _, counts, words, *_) in enumerate(rows):
                    at = place[sets[i]]
                    x[i, at[at >= 0]] = np.frombuffer(counts, np.uint8)[at >= 0] * weight(words)
                return np.hstack([x, more, before])  # noqa: B023

            unseen = np.zeros(len(rows))
            for k in range(folds):
                if (here := fold == k).any() and (~here).any():
                    x = table(screened([s for s, h in zip(sets, here, strict=True) if not h], y[~here], len(vocabulary), FEATURES))
                    w = fit_logistic(x[~here], y[~here])
                    unseen[here] = np.clip(x[here] @ w[:-1] + w[-1], -8, 8)
            chosen = screened(sets, y, len(vocabulary), FEATURES)
            self.unseen.append(unseen)
            self.known |= {vocabulary[f] for f in chosen}
            self.models.append(({vocabulary[f]: k for k, f in enumerate(chosen)}, fit_logistic(table(chosen), y)))
            before = np.hstack([before, unseen[:, None]])
        return self

    def predict(self, text: str | None) -> list[float]:
        text = text or ""
        (counts, words), more, odds = features(text, self.known), figures(text), []
        for place, w in self.models:
            z = w[-1] + weight(words) * sum(n * w[place[f]] for f, n in sorted(counts.items()) if f in place)
            for v, k in zip([*more, *odds], range(len(place), len(w) - 1), strict=True):
                z += v * w[k]
            odds.append(float(np.clip(z, -8, 8)))
        return [float(sigmoid(z)) for z in odds] or [0.0] * len(self.chain)


def fit(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, sample: int = SAMPLE) -> Chain:
    """labels: doc_id and a 0/1 column for each category; rows with a null there or no document are left out, and of rows
    that repeat an id the one with the largest labels counts."""
    known = labels.groupBy("doc_id").agg(*(F.max(c).cast("int").alias(c) for c in chain)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in chain))
    known = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    picked = settle(docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(F.broadcast(known), "doc_id"))  # `sample` rows of numbers

    def counted(rows):
        for doc_id, text, order, *y in rows:
            counts, words = features(text or "")
            yield doc_id, order, sorted(counts), [counts[f] for f in sorted(counts)], words, figures(text or ""), y

    kinds = "doc_id long, order long, {} array<int>, words int, figures array<double>, y array<int>"
    parsed = settle(map_rows(picked.select("doc_id", "text", "order", *chain), counted, kinds.format("features array<string>, counts")))
    kept = F.min(F.struct("order", "doc_id", "words", "figures")).alias("kept")  # the same one in every run
    one = parsed.groupBy("features", "counts", "y").agg(kept)  # copies would count as evidence for whatever words they hold
    one = one.select("kept.doc_id", "kept.order", "features", "counts", "kept.words", "kept.figures", "y")
    common = one.select(F.explode("features").alias("f")).groupBy("f").count().where(F.col("count") >= LEAST).orderBy(F.desc("count"), "f").limit(FEATURES_KNOWN)
    vocabulary = [r["f"] for r in common.collect()]
    shared = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(vocabulary)})

    def numbers(rows):
        for doc_id, order, names, counts, *more in rows:
            found = [(shared.value[f], n) for f, n in zip(names, counts, strict=True) if f in shared.value]
            yield doc_id, order, np.array([f for f, _ in found], np.int32).tobytes(), np.array([n for _, n in found], np.uint8).tobytes(), *more

    packed = map_rows(one, numbers, "doc_id long, order long, features binary, counts binary, words int, figures array<double>, y array<int>")
    rows = [(r["order"], r["doc_id"], bytes(r["features"]), bytes(r["counts"]), r["words"], r["figures"], *r["y"]) for r in packed.toLocalIterator()]
    rows.sort(key=lambda r: r[:2])
    return Chain(chain).fit([(k, *r[2:]) for k, r in enumerate(rows)], vocabulary)


def score(docs: DataFrame, model: Chain, cut: float = CUT) -> DataFrame:
    """doc_id, p_<category> for each category, rejected (the last one reaches `cut`) for each row of `docs`.

    Null and empty texts are scored as texts without words; rows that repeat an id each get a row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows):
        for doc_id, text in rows:
            p = [round(x, 6) for x in shared.value.predict(text)]
            yield doc_id, *p, p[-1] >= cut

    columns = ", ".join(f"p_{c} double" for c in model.chain)
    return map_rows(docs.select("doc_id", "text"), work, f"doc_id long, {columns}, rejected boolean")


def clean(docs: DataFrame, model: Chain, cut: float = CUT) -> DataFrame:
    """`docs`, all columns, without the documents that the model rejects."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(rows):
        for row in rows:
            if shared.value.predict(row[at])[-1] < cut:
                yield row

    return map_rows(docs, work, docs.schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's odds and verdict; nulls, copies and empty tables as in `fit` and the functions it calls."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, chain_labels(read(spark, sf_dir, "labels"))))
