import re
from itertools import combinations

import numpy as np
import pytest

from tests.llm import helpers
from versograph.llm import op09_rules as op


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 2000 else set(range(len(words)))
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_counts_match_brute_force(spark):
    got = op.judged_documents(helpers.table(spark)).collect()
    assert len(got) == len(helpers.ODD)
    by = {(r.doc_id, r.n_words, r.word_chars): r for r in got}
    for doc_id, text, *_ in helpers.ODD:
        n, chars, symbols, dup, rep = brute(text)
        r = by[doc_id, n, chars]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def test_empty_table(spark):
    assert op.judged_documents(helpers.table(spark, [])).count() == 0
    assert op.kept_documents(helpers.table(spark, [])).count() == 0


def test_chi_square():
    assert op.chi_square_quantile(0.999, 7) == pytest.approx(24.3219, abs=1e-3)
    assert op.chi_square_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)
    assert op.CUTOFF == pytest.approx(40.52, abs=0.01)


def moments(z, weight):
    upper = [[z[:, i] * z[:, j] @ weight] for i, j in op.PAIRS]
    return weight.sum(), weight @ z, np.array(upper).reshape(-1)


def distances(z, mean, scatter):
    return np.einsum("ni,ij,nj->n", z - mean, np.linalg.inv(scatter), z - mean)


def concentrate(z, prior, mean, scatter):
    """Steps with sorted distances, without bins, until the determinant stops falling."""
    last = np.inf
    while True:
        weight, left = np.zeros(len(z)), op.SHARE * len(z)
        for i in np.argsort(distances(z, mean, scatter), kind="stable"):
            weight[i] = min(1, left)
            left -= weight[i]
        new = prior.estimate(*moments(z, weight))
        now = np.linalg.slogdet(new[1])[1]
        if now >= last - 1e-9:
            return last, mean, scatter
        last, (mean, scatter) = now, new


def written_statistics(spark, tmp_path, groups):
    rows = [(i, g, 100, 0, *map(float, z)) for g, zs in groups.items() for i, z in enumerate(zs)]
    df = spark.createDataFrame(rows, "i long, __g string, n_words long, n_repeat_words long" + "".join(f", z{k} double" for k in range(op.DIM)))
    df.repartition(5).write.parquet(f"{tmp_path}/stats")
    return spark.read.parquet(f"{tmp_path}/stats")


def test_estimates_match_brute_force(spark, tmp_path):
    """Correlated groups of 3 to 400 rows, a fifth of them far off, some statistics constant, many ties."""
    rng, groups = np.random.default_rng(1), {}
    for g, n in (("a", 400), ("b", 150), ("c", 40), ("d", 8), ("e", 3)):
        z = rng.normal(size=(n, op.DIM)) @ rng.normal(size=(op.DIM, op.DIM)) * 0.5 + rng.normal(size=op.DIM)
        z[: n // 5] += 9 * rng.normal(size=op.DIM)
        z[:, 5:] = 0
        z[:, 4] = np.round(z[:, 4])
        groups[g] = z
    stats = written_statistics(spark, tmp_path, groups)
    estimates, prior = op.estimate(stats), op._prior(op._histogram(stats))
    found = {r["__g"]: r["e"] for r in estimates.collect()}
    judged = {(r.i, r.g): r for r in op.judge(stats.selectExpr("*", "`__g` AS g"), estimates, stats.count()).collect()}
    every = np.quantile(np.concatenate(list(groups.values())), 0.5, axis=0)
    assert np.abs(prior.m - every).max() < 0.1
    for g, z in groups.items():
        q1, q2, q3 = np.quantile(z, [0.25, 0.5, 0.75], axis=0)
        s = np.maximum((q3 - q1) / 1.349, op.FLOORS)
        v = (z - q2) / s
        sign = v / np.sqrt((v * v).sum(1, keepdims=True) + 1e-12)
        starts = [(q2, np.diag(s * s)), (prior.m, prior.target), (q2, np.outer(s, s) * (sign.T @ sign) * op.DIM / len(z) + prior.floors)]
        logdet, mean, scatter = min((concentrate(z, prior, *x) for x in starts), key=lambda x: x[0])
        assert found[g]["logdet"] == pytest.approx(logdet, abs=0.1)
        want = distances(z, mean, scatter)
        for i, d in enumerate(want):
            if not 0.85 < d / op.CUTOFF < 1.15:
                assert judged[i, g].kept == (d <= op.CUTOFF)


def test_estimate_is_near_the_best_of_all_parts(spark, tmp_path):
    rng = np.random.default_rng(7)
    groups = {f"g{k}": rng.normal(size=(12, op.DIM)) + (rng.random((12, 1)) < 0.2) * 6 for k in range(5)}
    stats = written_statistics(spark, tmp_path, groups)
    found, prior = {r["__g"]: r["e"] for r in op.estimate(stats).collect()}, op._prior(op._histogram(stats))
    for g, z in groups.items():
        parts = [np.isin(np.arange(12), c).astype(float) for c in combinations(range(12), 9)]
        best = min(np.linalg.slogdet(prior.estimate(*moments(z, w))[1])[1] for w in parts)
        assert best - 0.1 <= found[g]["logdet"] <= best + 0.25


def test_equal_rows_share_the_last_place(spark, tmp_path):
    groups = {"same": np.ones((50, op.DIM)), "one": np.zeros((1, op.DIM))}
    stats = written_statistics(spark, tmp_path, groups)
    got = op.judge(stats, op.estimate(stats), stats.count()).collect()
    assert len(got) == 51 and all(r.kept for r in got)


def test_outliers_are_rejected_and_clean_rows_kept(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(500)]
    rows = []
    for i in range(600):
        words = list(rng.choice(vocabulary, int(rng.lognormal(5, 0.6)) + 12))
        bad = i % 6 == 0
        text = "### ".join(w.upper() for w in words) if bad else " ".join(words)
        rows.append((i, text, "en", "hot" if i % 5 < 2 else f"s{i % 5}", len(text)))
    kept = {r.doc_id for r in op.kept_documents(helpers.table(spark, rows)).collect()}
    assert not [i for i in kept if i % 6 == 0]
    clean = [i for i in range(600) if i % 6]
    assert len([i for i in clean if i in kept]) >= 0.99 * len(clean)
    full = op.judged_documents(helpers.table(spark, rows)).where("kept").count()
    assert full == len(kept)


def test_kept_documents_have_the_columns_of_documents(spark):
    out = op.kept_documents(helpers.table(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_labelled_documents(spark, sf):
    import os

    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    made = op.op9_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good = made.where("quality = 1")
    assert good.where("kept").count() >= 0.97 * good.count()
    bad = made.where("quality = 0")
    assert bad.where("NOT kept").count() >= 0.8 * bad.count()
