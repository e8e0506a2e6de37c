import os

import numpy as np
import pytest

from tests.llm import helpers
from versograph.llm import common
from versograph.llm import op02_quality as quality
from versograph.llm import op04_toxicity as toxicity

DATA = "/root/testdata/sf0.01"


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    index, value = quality.features("Some words and Some more!! # here\nand a line".encode())
    pairs = sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i + 1, len(index)))
    assert m.margin(index, value) == pytest.approx(0.3 + m.w[index] @ value + pairs)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    m = quality.Machine(0.2, rng.normal(size=quality.SIZE) / 9, rng.normal(size=(quality.SIZE, quality.RANK)) / 9)
    texts = [b"a few words", b"some other words, and some again!", b"", b"a line\na line\n\nNUMBERS 123"]
    rows, y = [quality.features(t, n) for t, n in zip(texts, (11, None, 3, 4), strict=True)], np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        return np.mean([np.log1p(np.exp(-(2 * b - 1) * m.margin(*r))) for r, b in zip(rows, y, strict=True)])

    s0, unique, sw, sv = m.gradient(rows, y)
    step, cells = 1e-5, [(m.w, i, sw[k]) for k, i in enumerate(unique)] + [(m.v, (i, f), sv[k, f]) for k, i in enumerate(unique) for f in (0, 3)]
    for array, at, want in cells:
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        assert (up - loss()) / (2 * step) == pytest.approx(want, abs=1e-6)
        array[at] += step
    m.w0 += step
    up = loss()
    m.w0 -= 2 * step
    assert (up - loss()) / (2 * step) == pytest.approx(s0, abs=1e-6)


def test_a_machine_learns_an_interaction():
    """x and y are good together or missing together: no linear model can tell."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(1500):
        x, y = rng.integers(0, 2, 2)
        rows.append((np.array([1, 2]), np.array([2.0 * x - 1, 2.0 * y - 1])))
        labels.append(float(x == y))
    m = quality.Machine().fit(rows, np.array(labels))
    right = [(m.margin(*r) > 0) == bool(y) for r, y in zip(rows, labels, strict=True)]
    assert np.mean(right) > 0.95


def test_metadata_reaches_training_and_scores(spark):
    """Equal texts, good where n_chars is that of the text: nothing else tells them apart."""
    rows = [(i, "some words of a text", "en", "a", (20, 2000, None)[i % 3]) for i in range(300)]
    docs = helpers.table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, quality.train(docs, labels, holdout=9), holdout=9).collect()
    assert len(got) == 300 and all((r.score > 0.5) == (r.doc_id % 3 == 0) for r in got)


def test_chain_feeds_out_of_fold_probabilities_on():
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(600):
        bad, spam = rng.random() < 0.3, rng.random() < 0.5
        words = [f"w{i}" for i in rng.integers(0, 200, 20)] + (["idiotic" if rng.random() < 0.9 else "scumbag"] if bad else []) + (["buy"] if spam else [])
        rows.append(np.fromiter(sorted(toxicity.features(" ".join(words).encode())), dtype=np.uint32))
        y.append((bad and spam, bad and not spam, bad))
    c = toxicity.Chain.fit(rows, np.array(y, dtype=float), np.arange(600) % 5)
    assert [len(m.u) for m in c.models] == [0, 1, 2] and np.abs(c.models[2].u).max() > 0
    assert c.score(b"an IDIOTIC remark")[2] > 0.5 > c.score(b"a kind remark")[2]
    assert all(0 <= p <= 1 for p in c.score(b""))


def dense_chain(rows, y, fold):
    """The chain with dense matrices and one loop per model; (features kept, weights and out-of-fold outputs by category)."""

    def fit(x, target):
        n, prior = len(target), (target.sum() + 0.5) / (len(target) + 1.0)
        w, b = np.zeros(x.shape[1]), np.log(prior / (1 - prior))
        if 0 < target.sum() < n:
            gw, gb = np.full(len(w), 1e-6), 1e-6
            for _ in range(toxicity.STEPS):
                wrong = (toxicity.logistic(x @ w + b) - target) / n
                dw, db = x.T @ wrong + toxicity.DECAY / 10 * w, wrong.sum()
                gw, gb = gw + dw * dw, gb + db * db
                w, b = w - toxicity.RATE * dw / np.sqrt(gw), b - toxicity.RATE * db / np.sqrt(gb)
        return w, b

    kept = []
    for h in sorted(set(np.concatenate(rows).tolist())):
        has = np.array([h in r for r in rows])
        for k in range(y.shape[1]):
            hit = y[has, k].sum()
            if hit >= max(toxicity.LEAST_ROWS, toxicity.LEAST_SHARE * y[:, k].sum()) and hit >= toxicity.LEAST_PRECISION * (has.sum() + 1):
                kept.append(h)
                break
    x = np.array([[h in r for h in kept] for r in rows], dtype=float)
    models = []
    for k in range(y.shape[1]):
        models.append(fit(x, y[:, k]))
        out = np.zeros(len(rows))
        for f in range(toxicity.FOLDS):
            w, b = fit(x[fold != f], y[fold != f, k])
            out[fold == f] = toxicity.logistic(x[fold == f] @ w + b)
        x = np.column_stack([x, out])
    return kept, models


def test_chain_is_that_of_dense_matrices():
    rng = np.random.default_rng(6)
    rows, y = [], []
    for _ in range(150):
        bad, spam = rng.random() < 0.4, rng.random() < 0.5
        words = [f"w{i}" for i in rng.integers(0, 30, 6)] + ["nasty"] * bad + ["buy"] * spam
        rows.append(np.fromiter(sorted(toxicity.features(" ".join(words).encode())), dtype=np.uint32))
        y.append((bad and spam, bad and not spam, bad))
    y, fold = np.array(y, dtype=float), np.arange(150) % 5
    got, (kept, models) = toxicity.Chain.fit(rows, y, fold), dense_chain(rows, y, fold)
    assert sorted(got.known) == kept
    for m, (w, b) in zip(got.models, models, strict=True):
        assert m.bias == pytest.approx(b) and np.concatenate([m.w, m.u]) == pytest.approx(w)


def test_training_data_is_bounded(spark):
    """A thousand copies of an id count once; very long texts are left out beyond the bytes allowed."""
    rows = [(1, f"copy {i % 7} of a text", "en", "a", 20) for i in range(1000)]
    rows += [(i, " ".join(f"w{i}x{k}" for k in range(20_000)), "en", "a", 1) for i in range(2, 14)] + [(i, "short text", "en", "a", 1) for i in range(20, 60)]
    docs = helpers.table(spark, rows)
    marked = spark.createDataFrame([(r, r % 2) for r in {x[0] for x in rows}] + [(1, 1), (1, 0)], "doc_id long, __y int")
    size = lambda texts: [[len(t).to_bytes(4, "big") * (len(t) // 100 + 1) for t in texts]]
    made = common.map_texts(common.training_sample(docs, marked, 100), size, "__f binary", carry=("doc_id", "__y"))
    got = common.bounded_features(made, ["__f"], 1 << 30, "test")
    assert [(r.doc_id, r["__y"]) for r in got] == sorted([(1, 0)] + [(r, r % 2) for r in {x[0] for x in rows}])
    few = common.bounded_features(made, ["__f"], 20_000, "test")
    assert 0 < sum(len(r["__f"]) for r in few) <= 20_000 and set(few) < set(got)
    assert len(common.training_sample(docs, marked, 5).select("doc_id", "__y").distinct().collect()) == 5
    labels = marked.selectExpr("doc_id", "__y AS quality", "__y AS toxic")
    assert quality.score_documents(docs, quality.train(docs, labels)).count() == len(rows)
    assert toxicity.score_documents(docs, toxicity.train(docs, labels, size=10_000)).count() == len(rows)


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1), (5, 1, 0), (5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS text", "'clash' AS score")
    df, none = helpers.table(spark), helpers.table(spark, [])
    for table in (labels, labels.where("false")):
        got = quality.score_documents(df, quality.train(df, table)).collect()
        assert len(got) == len(helpers.ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        got = toxicity.score_documents(df, toxicity.train(df, table)).collect()
        assert len(got) == len(helpers.ODD) and all(0 <= r.p_toxic <= 1 for r in got)
    assert quality.score_documents(none, quality.train(none, labels)).count() == 0
    assert toxicity.score_documents(none, toxicity.train(none, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_quality(spark):
    got = quality.op2_quality(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert right >= 0.9 * len(got)


@pytest.mark.skipif(not os.path.isdir(DATA.replace("0.01", "0.1")), reason="no test data")
def test_held_out_toxicity(spark):
    d = DATA.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    c = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    got = toxicity.score_documents(docs.where("doc_id % 4 = 0"), c).join(labels, "doc_id").collect()
    caught = [r.is_toxic for r in got if r.toxic]
    wrong = [r.is_toxic for r in got if not r.toxic]
    assert np.mean(caught) >= 0.8 and np.mean(wrong) <= 0.02
