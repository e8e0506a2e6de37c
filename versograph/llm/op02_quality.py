"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a vector of ``RANK`` numbers; the score of a text is
the logistic of w0 + Σ w_i x_i + Σ_{i<j} <v_i, v_j> x_i x_j, where the sum over all
pairs comes in linear time as ½ Σ_f [(Σ_i v_if x_i)² − Σ_i v_if² x_i²].

Training reads at most ``MAX_TRAIN`` labelled rows (those with the smallest hashes
of their ids), and of these as many as have ``TRAIN_BYTES`` of features, as a documented
bound; features are computed on the executors.  An id that ``documents`` repeats counts
once for each of its labels, with the smallest features of its texts.
Scoring reads every whole text.  Labels, language, source and doc_id never enter a
feature; the metadata features are how far n_chars is from the text's own length in
code points (the logarithm of their ratio, without sign), and whether it is missing.

Results: null and empty texts have structure features only and still get a score;
null labels are not learned from; if there are no labels, every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from versograph.llm.common import bounded_features, held_out, map_texts, table, training_sample

HASHED, STRUCTURE, RANK = 1 << 15, 16, 8
SIZE = HASHED + STRUCTURE
MAX_TRAIN, EPOCHS, BATCH, RATE, DECAY, SEED = 12_000, 6, 64, 0.05, 1e-4, 7
TRAIN_BYTES = 192 << 20
THRESHOLD = 0.3
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _MARKS = b"#*$%&|<>", b".,!?;:"


def features(text: bytes, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed lower-case words by damped frequency (norm 1), then structure statistics and metadata."""
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    seen = Counter(words)
    index = np.fromiter((crc32(w) & HASHED - 1 for w in seen), dtype=np.int64, count=len(seen))
    value = np.log1p(np.fromiter(seen.values(), dtype=np.float64, count=len(seen)))
    if len(seen):
        value /= np.sqrt(np.square(value).sum())
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    rate = lambda chars: (size - len(text.translate(None, chars))) / size if text else 0.0
    adjacent = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    five = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    code_points = len(text.decode("utf-8", "replace"))
    off = abs(np.log1p(max(0, n_chars)) - np.log1p(code_points)) if n_chars is not None else 0.0
    structure = [
        np.log1p(n) / 5, size / max(1, n) / 8, np.sqrt(rate(_UPPER)) * 2, np.sqrt(rate(_SYMBOLS)) * 2, np.sqrt(rate(_MARKS)) * 2,
        np.sqrt(rate(_DIGITS)) * 2, np.sqrt(rate(b"!")) * 2, len(seen) / max(1, n), adjacent, seen.most_common(1)[0][1] / n if n else 0.0,
        1 - len(set(full)) / len(full) if full else 0.0, np.log1p(n / len(full)) / 4 if full else 0.0, 1 - len(set(five)) / len(five) if five else 0.0, 1.0,
        off, float(n_chars is None),
    ]
    return np.concatenate([index, np.arange(HASHED, SIZE)]), np.concatenate([value, np.minimum(structure, 3.0)])


class Machine:
    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.w0 = w0
        self.w = np.zeros(SIZE) if w is None else w
        self.v = np.random.default_rng(SEED).normal(0, 0.05, (SIZE, RANK)) if v is None else v

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        return float(self.w0 + self.w[index] @ value + 0.5 * (np.square(vx.sum(0)) - np.square(vx).sum(0)).sum())

    def score(self, text: bytes, n_chars: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text, n_chars)), -30, 30))))

    def gradient(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean logistic loss: by w0, the features concerned, and by their w and v."""
        index = np.concatenate([i for i, _ in rows])
        value = np.concatenate([v for _, v in rows])
        size = np.array([len(i) for i, _ in rows])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        margin = self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (np.square(sums).sum(1) - np.add.reduceat(np.square(vx).sum(1), starts))
        wrong = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(rows)
        each = np.repeat(wrong, size)
        dv = each[:, None] * value[:, None] * (np.repeat(sums, size, axis=0) - vx)
        unique, back = np.unique(index, return_inverse=True)
        sv = np.zeros((len(unique), RANK))
        np.add.at(sv, back, dv)
        return float(wrong.sum()), unique, np.bincount(back, each * value), sv

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
        """Mini-batches with per-coordinate rates (AdaGrad); the order is fixed by ``SEED``."""
        rng = np.random.default_rng(SEED)
        gw, gv, g0 = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                part = order[at : at + BATCH]
                s0, unique, sw, sv = self.gradient([rows[i] for i in part], labels[part])
                sw += DECAY * self.w[unique]
                sv += DECAY * self.v[unique]
                gw[unique] += sw * sw
                gv[unique] += sv * sv
                self.w[unique] -= RATE * sw / np.sqrt(gw[unique])
                self.v[unique] -= RATE * sv / np.sqrt(gv[unique])
                g0 += s0**2
                self.w0 -= RATE * s0 / np.sqrt(g0)
        return self


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", holdout: int = 0, limit: int = MAX_TRAIN, size: int = TRAIN_BYTES) -> Machine:
    def run(texts: list[bytes], n_chars: list[int | None]) -> list:
        made = [features(t, n) for t, n in zip(texts, n_chars, strict=True)]
        return [[i.astype(np.int32).tobytes() for i, _ in made], [v.astype(np.float32).tobytes() for _, v in made]]

    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("__y"))
    chosen = training_sample(docs, marked.where(F.col("__y").isin(0, 1) & ~held_out(holdout)), limit)
    rows = bounded_features(map_texts(chosen, run, "__i binary, __v binary", carry=("doc_id", "__y"), also=("n_chars",)), ["__i", "__v"], size, "quality-train")
    if not rows:
        return Machine(v=np.zeros((SIZE, RANK)))
    x = [(np.frombuffer(r["__i"], np.int32).astype(np.int64), np.frombuffer(r["__v"], np.float32).astype(np.float64)) for r in rows]
    return Machine().fit(x, np.array([r["__y"] for r in rows], dtype=float))


def score_documents(docs: DataFrame, machine: Machine, holdout: int = 0) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))  # SIZE × (RANK + 1) numbers

    def run(texts: list[bytes], n_chars: list[int | None]) -> list:
        m = Machine(*model.value)
        return [[m.score(t, n) for t, n in zip(texts, n_chars, strict=True)]]

    scored = map_texts(docs.withColumn("doc_id", F.col("doc_id").cast(LongType())), run, "score double", also=("n_chars",))
    return scored.select("doc_id", held_out(holdout).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
