import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tests.llm import helpers
from versograph.llm import common
from versograph.llm import op03_lm as op


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 13])
@pytest.mark.parametrize("universe", [1, 100, 1 << 20, 1 << 45, 1 << 64])
def test_monotone_round_trip_and_search(universe, step, monkeypatch):
    monkeypatch.setattr(op, "STEP", step)
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, min(universe, 1 << 62), 500, dtype=np.uint64))
    m, rest = op.Monotone.unpack(memoryview(op.Monotone.of(values, universe).pack() + b"rest"))
    assert m.values().tolist() == values.tolist() and bytes(rest) == b"rest"
    m = op.Monotone.of(values, universe)
    if universe <= 1 << 45:
        ask = np.sort(np.concatenate([values.astype(np.int64), rng.integers(-1, universe + 5, 300)]))
        at = {int(v): i for i, v in enumerate(values)}
        assert m.find(ask).tolist() == [at.get(int(x), -1) for x in ask]
        assert m[np.arange(len(values))].tolist() == values.tolist()


def test_monotone_of_equal_numbers(monkeypatch):
    monkeypatch.setattr(op, "STEP", 3)
    values = np.array([0, 0, 0, 5, 5, 9, 300, 300, 70_000], dtype=np.int64)
    m = op.Monotone.of(values, 100_000)
    assert m[np.arange(9)].tolist() == values.tolist() == m.values().tolist()


@pytest.mark.parametrize("top", [0, 255, 256, 1 << 33, (1 << 62)])
def test_counts_of_any_size(top):
    x = np.array([top, 0, 1], dtype=np.int64)
    got, rest = op.unpacked_numbers(memoryview(op.packed_numbers(x) + b"rest"))
    assert got.tolist() == x.tolist() and bytes(rest) == b"rest"


@pytest.mark.parametrize("lengths", [(0, 0, 0), (1, 0, 3), (0, 700, 2), (5, 5, 0)])
def test_parts_of_any_length_and_width(lengths):
    parts = [np.arange(n, dtype=np.int64) * wide for n, wide in zip(lengths, (1 << 40, 1, 300), strict=True)]
    *got, rest = op.unpacked_numbers(memoryview(op.packed_numbers(*parts) + b"rest"), 3)
    assert [x.tolist() for x in got] == [x.tolist() for x in parts] and bytes(rest) == b"rest"


def test_rows_of_few_ngrams_are_small():
    """What a block sends to a shard of which it has one n-gram of each order, at the hash widths of 30 GB."""
    keys = b"".join(op.Monotone.of(np.array([(1 << bits) - 1], dtype=np.uint64), 1 << bits).pack() for bits in (52, 39, 39))
    assert len(keys + op.packed_numbers(*[np.ones(1, dtype=np.int64)] * 3)) < 100


@pytest.mark.parametrize("bits", [8, 64])
def test_numbered_is_as_unique(bits):
    key = np.random.default_rng(1).integers(0, 1 << min(bits, 63), 500, dtype=np.uint64)
    keys, own, at = op.numbered(key, bits)
    assert keys.tolist() == np.unique(key).tolist() and keys[own].tolist() == key.tolist() == key[at][own].tolist()


def test_monotone_empty():
    m = op.Monotone.of(np.zeros(0, dtype=np.int64), 10)
    assert m.values().tolist() == [] == m[np.zeros(0, dtype=np.int64)].tolist() and m.find(np.array([0, 3])).tolist() == [-1, -1]


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), "</s>"]


def brute(rows):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    counts = [Counter(), Counter(), Counter()]
    for i, text, *_ in rows:
        if not held(i):
            t = tokens(text)
            for n in range(3):
                counts[n].update(tuple(t[k : k + n + 1]) for k in range(len(t) - n))
    N, V = sum(counts[0].values()), len(counts[0])

    def p(gram):
        w = gram[-1:]
        if len(gram) == 1:
            return (counts[0][w] + 0.5) / (N + 0.5 * (V + 1))
        k = op.WEIGHT[len(gram)]
        return (counts[len(gram) - 1][gram] + k * p(gram[1:])) / (counts[len(gram) - 2][gram[:-1]] + k)

    out = []
    for i, text, *_ in rows:
        t = tokens(text)
        base = sum(math.log10((counts[0][(w,)] + 0.5) / (N + 0.5 * (V + 1))) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, k - 2) : k + 1]))) for k in range(len(t)))
        out.append((i, held(i), len(t), sum(counts[0][(w,)] > 0 for w in t), N, base, score))
    return out


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_scores_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    rows = [r for r in helpers.ODD if len(r[1] or "") < 3000] + [(20 + i, f"the cat sat on the {w} and the cat ate {w} {i % 3}", "en", "a", 1) for i, w in enumerate("mat rat hat mat bat cat".split() * 4)]
    got = sorted(op.score_documents(helpers.table(spark, rows)).collect(), key=str)
    want = sorted(brute(rows), key=lambda r: str(op_row(r)))
    got.sort(key=lambda r: (str(r[0]), r[2], r[5]))
    want.sort(key=lambda r: (str(r[0]), r[2], r[5]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], abs=1e-9)
        assert g.score == pytest.approx(w[6], abs=2e-3 * w[2])


#: Prints the bytes of shuffle files after the answers are written and the rows of the result, where nothing goes with the driver's garbage.
ALONE = """
import random, sys, time
from pathlib import Path
from pyspark.sql import SparkSession
from tests.llm import helpers
from versograph.llm import op03_lm as op

conf = {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.cleaner.referenceTracking": "false"}
spark = SparkSession.builder.config(map=conf | {"spark.local.dir": sys.argv[1] + "/local", "spark.checkpoint.dir": sys.argv[1] + "/shared"}).getOrCreate()
rng = random.Random(1)
rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(1000)), "en", "a", 1) for i in range(40)]
made = op.score_documents(helpers.table(spark, rows))
size = lambda: sum(f.stat().st_size for f in Path(sys.argv[1], "local").rglob("shuffle_*"))
end = time.time() + 20
while size() > 50_000 and time.time() < end:
    time.sleep(0.1)
print("bytes", size(), made.count())
"""


def test_requests_leave_the_disk(tmp_path):
    done = subprocess.run([sys.executable, "-c", ALONE, str(tmp_path)], capture_output=True, text=True, timeout=300)
    _, size, rows = next(x for x in done.stdout.splitlines() if x.startswith("bytes")).split()
    assert int(size) < 50_000 and int(rows) == 40


@pytest.mark.parametrize("before", [None, "false", "true"])
def test_setting_is_put_back(spark, before, request):
    if before:
        spark.conf.set(common.CLEANUP, before)
        request.addfinalizer(lambda: spark.conf.unset(common.CLEANUP))
    dealt = spark.range(9).repartition(2, "id")
    common.written(dealt, "put-back", free=True)
    with pytest.raises(PySparkException):
        common.written(dealt.selectExpr("raise_error('no') AS x"), "put-back", free=True)
    assert spark.conf.get(common.CLEANUP, None) == before


def op_row(r):
    return r


def test_empty_table(spark):
    assert op.score_documents(helpers.table(spark, [])).count() == 0
