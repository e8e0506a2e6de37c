"""Toxicity by a chain of classifiers.

The categories are predicted one after the other.  Each is a logistic regression
over the presence of words and word beginnings (stems take many endings), plus the
probabilities of all categories before it in the chain.  In training those
probabilities are out-of-fold: the rows are dealt into folds, and a row's come from
a model that hasn't seen its fold, so later models meet them as they are on new
texts.

The labels give toxic and quality; the chain is ``abusive_spam`` (toxic and of low
quality), ``abusive_prose`` (toxic and of good quality) and then ``toxic``.

Training reads at most ``MAX_TRAIN`` labelled rows, and of these as many as have
``TRAIN_BYTES`` of features, as a documented bound, with features computed on the
executors; every text is scored.  Features are 32-bit hashes; those kept occur in
enough distinct positive texts and seldom in others.  An id that ``documents`` repeats
counts once for each of its labels, with the smallest features of its texts.

Results: null and empty texts have no feature and get the prior; null labels are
not learned from; a category without positive rows has its prior, near 0.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.llm.common import bounded_features, map_texts, table, training_sample

CATEGORIES = ("abusive_spam", "abusive_prose", "toxic")
MAX_TRAIN, FOLDS, STEPS, RATE, DECAY = 12_000, 5, 300, 0.3, 1e-3
TRAIN_BYTES = 192 << 20
STEMS = (4, 5, 6)
#: A feature is kept that occurs in so many positive rows (and this share of them), mostly there, up to MAX_FEATURES.
LEAST_ROWS, LEAST_SHARE, LEAST_PRECISION, MAX_FEATURES = 4, 0.004, 0.5, 4000
THRESHOLD = 0.3
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))
WORDS_ONLY = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def features(text: bytes) -> set[int]:
    """Hashes of the distinct words, and of the beginnings of longer ones (A-Z lowered)."""
    words = set(text.translate(WORDS_ONLY).split())
    out = {crc32(w) for w in words}
    for n in STEMS:
        out.update(map(crc32, {b"%d:" % n + w[:n] for w in words if len(w) >= n}))
    return out


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class Linear:
    """Logistic regression on sparse presence features and dense columns, by full-batch AdaGrad."""

    def __init__(self, size: int, dense: int):
        self.bias, self.w, self.u = 0.0, np.zeros(size), np.zeros(dense)

    def fit(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        n = len(y)
        prior = (y.sum() + 0.5) / (n + 1.0)
        self.bias = float(np.log(prior / (1 - prior)))
        if not 0 < y.sum() < n:
            return self
        gb, gw, gu = 1e-6, np.full(len(self.w), 1e-6), np.full(len(self.u), 1e-6)
        for _ in range(STEPS):
            wrong = (self.predict(row, col, dense, n) - y) / n
            dw = np.bincount(col, wrong[row], minlength=len(self.w)) + DECAY / 10 * self.w
            du, db = dense.T @ wrong + DECAY / 10 * self.u, wrong.sum()
            gw, gu, gb = gw + dw * dw, gu + du * du, gb + db * db
            self.w -= RATE * dw / np.sqrt(gw)
            self.u -= RATE * du / np.sqrt(gu)
            self.bias -= RATE * db / np.sqrt(gb)
        return self

    def predict(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        return logistic(self.bias + np.bincount(row, self.w[col], minlength=n) + dense @ self.u)


class Chain:
    """Models in the order of the categories, over the features in ``known`` (hash to column)."""

    def __init__(self, known: dict[int, int], models: list[Linear]):
        self.known, self.models = known, models

    def score(self, text: bytes) -> list[float]:
        known = self.known
        col = [known[h] for h in features(text) if h in known]
        out: list[float] = []
        for m in self.models:
            margin = m.bias + m.w[col].sum() + np.dot(m.u, out) if out else m.bias + m.w[col].sum()
            out.append(float(logistic(margin)))
        return out

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Chain:
        """``rows``: feature hashes of each text; ``y``: a column per category; ``fold``: of each text."""
        if not rows:
            return cls({}, [Linear(0, k) for k in range(len(CATEGORIES))]).without_rows()
        hashes, back = np.unique(np.concatenate(rows), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        total, use = np.bincount(back, minlength=len(hashes)), np.zeros(len(hashes), dtype=bool)
        for k in range(y.shape[1]):
            hit = np.bincount(back, y[row, k], minlength=len(hashes))
            good = (hit >= max(LEAST_ROWS, LEAST_SHARE * y[:, k].sum())) & (hit >= LEAST_PRECISION * (total + 1))
            best = np.argsort(-hit * good, kind="stable")[:MAX_FEATURES]
            use[best] |= good[best]
        number = np.cumsum(use) - 1
        inside = use[back]
        row, col = row[inside], number[back[inside]]
        size, n = int(use.sum()), len(rows)
        models, outs = [], np.zeros((n, 0))
        for k in range(y.shape[1]):
            models.append(Linear(size, k).fit(row, col, outs, y[:, k]))
            out = np.zeros(n)
            for f in range(FOLDS):
                test = fold == f
                if not test.any() or test.all():
                    continue
                of = ~test[row]
                m = Linear(size, k).fit(np.cumsum(~test)[row[of]] - 1, col[of], outs[~test], y[~test, k])
                out[test] = m.predict(np.cumsum(test)[row[~of]] - 1, col[~of], outs[test], int(test.sum()))
            outs = np.column_stack([outs, out])
        return cls({int(h): i for i, h in enumerate(hashes[use])}, models)

    def without_rows(self) -> Chain:
        for m in self.models:
            m.bias = float(np.log(0.5 / 99.5))
        return self


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, size: int = TRAIN_BYTES) -> Chain:
    def run(texts: list[bytes]) -> list:
        return [[np.fromiter(sorted(features(t)), dtype=np.uint32).tobytes() for t in texts]]

    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("__y"), F.coalesce(F.col("quality").cast("int"), F.lit(1)).alias("__q"))
    chosen = training_sample(docs, marked.where(F.col("__y").isin(0, 1)), limit)
    got = bounded_features(map_texts(chosen, run, "__f binary", carry=("doc_id", "__y", "__q")), ["__f"], size, "toxicity-train")
    once = {(r["__f"], r["__y"], r["__q"]): r for r in reversed(got)}  # copies count once
    got = sorted(once.values(), key=lambda r: (r.doc_id, r["__y"], r["__q"], r["__f"]))
    y = np.array([(r["__y"] and not r["__q"], r["__y"] and r["__q"] == 1, r["__y"]) for r in got], dtype=float).reshape(-1, len(CATEGORIES))
    return Chain.fit([np.frombuffer(r["__f"], np.uint32) for r in got], y, np.array([crc32(str(r.doc_id).encode()) % FOLDS for r in got]))


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and is_toxic."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # at most 3 × MAX_FEATURES features

    def run(texts: list[bytes]) -> list:
        got = [model.value.score(t) for t in texts]
        return [[x[k] for x in got] for k in range(len(CATEGORIES))]

    made = map_texts(docs, run, ", ".join(f"p_{c} double" for c in CATEGORIES))
    return made.withColumn("is_toxic", (F.col("p_toxic") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
