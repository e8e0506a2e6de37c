"""Quality rules: base counts, and robust multivariate outliers by minimum covariance determinant.

Each text that passes the base rules becomes a vector of transformed statistics.
Per language and source, centre and scatter are those of the part with ``SHARE`` of
the rows that has the smallest determinant of

    K = F + (h c S + v T + h v / (h + v) D) / (h + v),

the regularised form of the estimate: S is the scatter of the part (h rows), c makes
it consistent for normal data, T (squared interquartile scales of all rows) counts as v
= ``PRIOR`` more rows at the medians of all rows, D is the square of the way from there
to the part's mean, and F = ``FLOORS``² keeps the determinant from vanishing, as most
texts have the same value (none) in several statistics.  So a group of few texts
takes most from all rows and a large one next to nothing, without a threshold.

The part is found by concentration: take the rows that are nearest by the last estimate,
estimate anew, repeat; no step can raise the determinant.  There are three starts for
each group: its quartiles, those of all rows, and its spatial signs.  After
``FIRST_STEPS`` steps the one with the lowest determinant goes on until it stops
falling (by more than ``TOLERANCE`` in its logarithm), each group by itself.  Every step
is two aggregations over all rows (partial sums per task, so a group may hold any share
of the rows): a histogram of log distances says where the nearest part ends, and the
rows of the last bin count by the fraction that is still needed, so ties share; then the
sums.  No group is ever sorted or gathered.  Texts beyond the chi-square quantile of
``LEVEL`` are rejected.

Results: null texts count as empty and fail the base rules; null languages or
sources form groups of their own; repeated rows are judged each; a text at the cut-off
is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versograph.llm.common import DOCUMENT_COLUMNS, joined, map_texts, table, written

COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_distinct long"
)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
#: Smallest scale of each statistic, in the order of ``vectors``.
FLOORS = (0.35, 0.08, 0.04, 0.10, 0.10, 0.08, 0.15)
DIM = len(FLOORS)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
SHARE, PRIOR, FIRST_STEPS, TOLERANCE = 0.75, 10.0, 2, 1e-3
#: Bins of the histogram of log distances for each factor e.
BINS = 32
#: Probability that a text of a normal group lies beyond the cut-off; small, as clean texts have heavy tails in length.
LEVEL = 1e-6


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    a, x = degrees / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * exp(a * log(x) - x - lgamma(a))


def chi_square_quantile(q: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < q else (low, mid)
    return high


#: Makes the scatter of the nearest part consistent for normal data.
CONSISTENCY = SHARE / chi_square(chi_square_quantile(SHARE, DIM), DIM + 2)
CUTOFF = chi_square_quantile(1 - LEVEL, DIM)


def counts(texts: list[bytes]) -> list:
    rows = []
    for t in texts:
        words = t.split()  # on the six ASCII space characters only
        n = len(words)
        code_points = len(t.decode("utf-8", "replace")) - sum(map(t.count, (SPACES[i : i + 1] for i in range(6))))
        symbols = sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(8))))
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        repeated = 0
        if n >= 6:
            windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
            if len(set(windows)) < len(windows):
                seen, end = Counter(windows), 0
                for i, w in enumerate(windows):
                    if seen[w] > 1:
                        repeated += i + 5 - max(i, end)
                        end = i + 5
        rows.append((n, code_points, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(t) - len(t.translate(None, UPPER)), len(set(words))))
    return list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in range(8)]


def vectors(rows: list) -> list[list[float]]:
    """The transformed statistics of ``counts`` rows, one list per statistic."""
    words, chars, symbols, dup, repeated, lines, upper, distinct = (np.asarray(x, dtype=float) for x in rows)
    w, c, n = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    z = [np.log1p(words), np.log(np.maximum(chars, 1) / w), np.sqrt(symbols / c), np.sqrt(dup / n), np.sqrt(repeated / w), np.sqrt(upper / c), np.log(np.maximum(distinct, 1) / w)]
    return [x.tolist() for x in z]


def statistics(texts: list[bytes]) -> list:
    rows = counts(texts)
    return [*rows, *vectors(rows)]


STATISTICS = COUNTS + "".join(f", z{i} double" for i in range(DIM))
_Z = [f"z{i}" for i in range(DIM)]


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def group() -> F.Column:
    return F.to_json(F.struct("lang", "source")).alias("__g")


def _histogram(stats: DataFrame) -> DataFrame:
    """(__g, d, b, n): rows of each group by statistic and bin of a quarter floor."""
    bins = F.array(*[F.struct(F.lit(i).alias("d"), F.floor(F.col(f"z{i}") * (4 / FLOORS[i])).alias("b")) for i in range(DIM)])
    hist = stats.select("__g", F.explode(bins).alias("x")).groupBy("__g", "x.d", "x.b").agg(F.count(F.lit(1)).alias("n"))
    return written(hist, "rules-histogram")


def _quartiles(hist: DataFrame) -> DataFrame:
    """(__g, m, s): medians and interquartile scales (the floor at least) of each group's statistics."""
    w = Window.partitionBy("__g", "d")
    h = hist.withColumn("c", F.sum("n").over(w.orderBy("b"))).withColumn("total", F.sum("n").over(w))
    at = [F.min(F.when(4 * F.col("c") >= q * F.col("total"), F.col("b"))).cast("double").alias(f"q{q}") for q in (1, 2, 3)]
    cells = h.groupBy("__g", "d").agg(*at).withColumn("__f", F.get(F.array(*map(F.lit, FLOORS)), F.col("d")))
    cell = F.struct("d", ((F.col("q2") + 0.5) * F.col("__f") / 4).alias("m"), F.greatest((F.col("q3") - F.col("q1")) * F.col("__f") / 4 / 1.349, F.col("__f")).alias("s"))
    return cells.groupBy("__g").agg(F.sort_array(F.collect_list(cell)).alias("x")).select("__g", F.col("x.m").alias("m"), F.col("x.s").alias("s"))


#: A group's estimate: which start it comes from, mean, inverse of K (upper part), and the logarithm of the determinant.
ESTIMATE = "struct<k:int,m:array<double>,p:array<double>,logdet:double>"


class Prior:
    """Medians and scales of all rows."""

    def __init__(self, m: np.ndarray, s: np.ndarray):
        self.m, self.target, self.floors = m, np.diag(np.square(s)), np.diag(np.square(FLOORS))

    def estimate(self, h: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and K of a part of h rows with these sums of statistics and of their products (upper part)."""
        mean = sums / h if h else self.m
        scatter = symmetric(products) / h - np.outer(mean, mean) if h else np.zeros((DIM, DIM))
        off = mean - self.m
        within = h * CONSISTENCY * scatter + PRIOR * self.target + h * PRIOR / (h + PRIOR) * np.outer(off, off)
        return (h * mean + PRIOR * self.m) / (h + PRIOR), self.floors + within / (h + PRIOR)


def _prior(hist: DataFrame) -> Prior:
    every = _quartiles(hist.groupBy(F.lit("").alias("__g"), "d", "b").agg(F.sum("n").alias("n"))).head()
    return Prior(np.array(every["m"]), np.array(every["s"])) if every else Prior(np.zeros(DIM), np.array(FLOORS))


def symmetric(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((DIM, DIM))
    for x, (i, j) in zip(upper, PAIRS, strict=True):
        out[i, j] = out[j, i] = x
    return out


def described(k: int, mean: np.ndarray, scatter: np.ndarray) -> dict:
    inverse = np.linalg.inv(scatter)
    return {"k": k, "m": mean.tolist(), "p": [float(inverse[i, j]) for i, j in PAIRS], "logdet": float(np.linalg.slogdet(scatter)[1])}


def _distance(e: str) -> F.Column:
    """The squared distance of a row by the estimate in column ``e``."""
    off = [F.col(f"z{i}") - F.col(e)["m"][i] for i in range(DIM)]
    return sum((off[i] * off[j] * F.col(e)["p"][k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def _starts(rows: DataFrame, quartiles: DataFrame, prior: Prior, total: int, groups: int) -> DataFrame:
    """(__g, __n, e): the estimates from which each group starts; ``quartiles`` has __g, __n, m and s."""
    off = [(F.col(f"z{i}") - F.col("m")[i]) / F.col("s")[i] for i in range(DIM)]
    both = joined(rows, quartiles, ["__g"], total, size=groups).select("__g", *[x.alias(f"v{i}") for i, x in enumerate(off)])
    norm = sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(DIM)), F.lit(1e-12))
    signs = both.withColumn("r", norm).groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}") / F.col("r")) for i, j in PAIRS]).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for m, s, n, x in zip(f["m"], f["s"], f["n"], f["x"], strict=True):
                m, s = np.array(m), np.array(s)
                sign = np.outer(s, s) * symmetric(x) * DIM / n
                made.append([described(0, m, np.diag(s * s)), described(1, prior.m, prior.target), described(2, m, sign + prior.floors)])
            yield pd.DataFrame({"__g": f["__g"], "__n": f["__n"], "e": made})

    return quartiles.join(signs, "__g").mapInPandas(run, f"__g string, __n long, e array<{ESTIMATE}>")


def _nearest(rows: DataFrame, estimates: DataFrame, total: int, groups: int) -> DataFrame:
    """(__g, __n, e, c): with each estimate, the bin in which the nearest part ends and the fraction of that bin."""
    each = joined(rows, estimates, ["__g"], total, size=groups).select("__g", *_Z, F.explode("e").alias("x"))
    hist = each.groupBy("__g", F.col("x.k").alias("k"), _bin("x").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("__g", "k")
    hist = hist.withColumn("c", F.sum("n").over(w.orderBy("b"))).withColumn("need", F.sum("n").over(w) * SHARE)
    hist = hist.where(F.col("c") >= F.col("need")).select("__g", "k", "b", ((F.col("need") - F.col("c") + F.col("n")) / F.col("n")).alias("part"))
    cuts = hist.groupBy("__g", "k").agg(F.min(F.struct("b", "part")).alias("c")).groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("k", "c.b", "c.part"))).alias("c"))
    return estimates.join(cuts, "__g")


def _bin(e: str) -> F.Column:
    return F.floor(F.log(F.greatest(_distance(e), F.lit(1e-6))) * BINS).cast("int")


def _concentrated(rows: DataFrame, nearest: DataFrame, prior: Prior, total: int, groups: int) -> DataFrame:
    """(__g, k, n: estimate of the nearest part, old: the one before)."""
    each = joined(rows, nearest.select("__g", "__n", F.arrays_zip("e", "c").alias("x")), ["__g"], total, size=groups).select("__g", *_Z, F.explode("x").alias("x"))
    each = each.select("__g", *_Z, F.col("x.e").alias("e"), F.col("x.c").alias("c")).withColumn("b", _bin("e")).where("b <= c.b")
    each = each.withColumn("w", F.when(F.col("b") < F.col("c.b"), 1.0).otherwise(F.col("c.part")))
    made = [F.sum("w"), *[F.sum(F.col("w") * F.col(z)) for z in _Z], *[F.sum(F.col("w") * F.col(_Z[i]) * F.col(_Z[j])) for i, j in PAIRS]]
    sums = each.groupBy("__g", F.col("e.k").alias("k")).agg(F.array(*made).alias("x"))
    old = nearest.select("__g", "__n", F.explode("e").alias("old")).select("__g", "__n", "old", F.col("old.k").alias("k"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = [described(k, *prior.estimate(x[0], np.array(x[1 : DIM + 1]), np.array(x[DIM + 1 :]))) for k, x in zip(f["k"], f["x"], strict=True)]
            yield pd.DataFrame({"__g": f["__g"], "__n": f["__n"], "old": f["old"], "new": new})

    return old.join(sums, ["__g", "k"]).mapInPandas(run, f"__g string, __n long, old {ESTIMATE}, new {ESTIMATE}")


def estimate(stats: DataFrame) -> DataFrame:
    """(__g, __n, e) for every group of a written table of statistics with __g, from the rows that pass the base rules; __n: all its rows."""
    rows = stats.where(~base_failed()).select("__g", *_Z)
    hist = _histogram(rows)
    sizes = stats.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    prior, total = _prior(hist), stats.count()
    quartiles = written(_quartiles(hist).join(sizes, "__g"), "rules-quartiles")
    groups = quartiles.count()
    now = written(_starts(rows, quartiles, prior, total, groups).withColumn("done", F.lit(False)), "rules-step")
    step = 0
    while now.where("NOT done").limit(1).count():
        step += 1
        nearest = written(_nearest(rows, now.where("NOT done").drop("done"), total, groups), "rules-nearest")
        moved = _concentrated(rows, nearest, prior, total, groups)
        if step <= FIRST_STEPS:
            e = F.col("new")
            done = F.lit(False)
        else:
            fell = F.col("new.logdet") < F.col("old.logdet") - TOLERANCE
            e = F.when(F.col("new.logdet") < F.col("old.logdet"), F.col("new")).otherwise(F.col("old"))
            done = ~fell
        moved = moved.select("__g", "__n", e.alias("e"), done.alias("done"))
        if step == FIRST_STEPS:
            moved = moved.groupBy("__g", "__n").agg(F.min(F.struct("e.logdet", "e.k", "e")).alias("x")).select("__g", "__n", "x.e", F.lit(False).alias("done"))
        moved = moved.groupBy("__g", "__n").agg(F.sort_array(F.collect_list("e")).alias("e"), F.min("done").alias("done"))
        now = written(now.where("done").unionByName(moved), "rules-step")
    return written(now.select("__g", "__n", F.get("e", F.lit(0)).alias("e")), "rules-estimates")


def judge(stats: DataFrame, estimates: DataFrame, total: int) -> DataFrame:
    """``stats`` with base_failed, distance (squared; 0 in a group of which no row passes the base rules) and kept."""
    columns = [c for c in stats.columns if c != "__g" and c not in _Z]
    rows = joined(stats, estimates, ["__g"], total, "left").withColumn("__d", F.coalesce(_distance("e"), F.lit(0.0)))
    return rows.select(*columns, base_failed().alias("base_failed"), F.col("__d").alias("distance"), (~base_failed() & (F.col("__d") <= CUTOFF)).alias("kept"))


def judged_documents(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, distance and kept, one row per document."""
    stats = map_texts(docs, statistics, STATISTICS, carry=("doc_id", "lang", "source")).withColumn("__g", group())
    stats = written(stats, "rules-counts")
    return judge(stats, estimate(stats), stats.count())


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents kept, with the columns of documents; texts are read twice and never shuffled."""
    stats = map_texts(docs, statistics, STATISTICS, carry=("lang", "source")).withColumn("__g", group())
    stats = written(stats, "rules-counts")
    full = map_texts(docs, statistics, STATISTICS, carry=DOCUMENT_COLUMNS).withColumn("__g", group())
    return judge(full, estimate(stats), stats.count()).where("kept").select(*DOCUMENT_COLUMNS)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judged_documents(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
