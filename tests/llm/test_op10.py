import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm import helpers
from versograph.llm import common
from versograph.llm import op10_simhash as op


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in keys}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def many(seed, n=300, group=60):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(group):
        x = rng.choice(out[: n // 10] + out[-3:])
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out + [0, 1, 15, 31, (1 << 64) - 1]


@pytest.mark.parametrize("text", ["", None, "A b", "a b c d", "The Quick brown fox jumps over ÄÖ the lazy dog again", "x\x1cy z\x85 w v u"])
def test_fingerprint(text):
    assert op.fingerprint((text or "").encode()) % (1 << 64) == brute_print(text)


@pytest.mark.parametrize("count", [1, 2, 3, 4])
@pytest.mark.parametrize("chunk", [8, 1 << 19])
def test_every_scheme_finds_the_classes_of_brute_force(count, chunk, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", chunk)
    prints = sorted(set(many(count)))
    want = brute_classes(prints)
    choices = list(op.combinations(op.blocks(op.BUDGET + count), count))
    fp = np.array([signed(p) for p in prints], dtype=np.int64)
    allfp, choice = np.tile(fp, len(choices)), np.repeat(np.arange(len(choices)), len(fp))
    u, v = op.joined_task(allfp, choice, np.zeros(len(allfp), dtype=np.int64), choices)
    got = op.Classes(len(fp))
    at = {p: i for i, p in enumerate(fp.tolist())}
    got.join(np.array([at[x] for x in u.tolist()], dtype=int), np.array([at[x] for x in v.tolist()], dtype=int))
    groups = lambda f: sorted(sorted(g) for g in f.values())
    a, b = {}, {}
    for i, p in enumerate(prints):
        a.setdefault(want[p], []).append(p)
        b.setdefault(int(got.root[i]), []).append(p)
    assert groups(a) == groups(b)


def test_a_dense_group_is_merged_without_all_pairs():
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 4000:
        prints.add(centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
        if len(prints) > 1900:
            prints.add(centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fp = np.array(sorted(map(signed, prints)), dtype=np.int64)
    choices = op.scheme(len(fp))
    u, v = op.joined_task(np.tile(fp, len(choices)), np.repeat(np.arange(len(choices)), len(fp)), np.zeros(len(fp) * len(choices), dtype=np.int64), choices)
    assert len(u) == len(fp) - 1 and set(v.tolist()) == {fp[0]}


@pytest.mark.parametrize(("sent", "few", "task"), [(50_000, 200, 200_000), (3, 4, 7)])
def test_documents(spark, monkeypatch, sent, few, task):
    monkeypatch.setattr(common, "SENT_KEYS", sent)
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(op, "TASK_ROWS", task)
    base = "the same words go on and on in every copy of this text until the very end of the line is reached at last"
    rows = [*helpers.ODD, *[(100 + i, base if i % 3 else base.upper(), "en", "a", 1) for i in range(30)]]
    rows += [(200 + i, base + f" tail{i}", "en", "a", 1) for i in range(40)]
    got = op.deduplicate(helpers.table(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {brute_print(r[1]) for r in rows}
    root = brute_classes(sorted(prints))
    smallest = {}
    for r in rows:
        k = root[brute_print(r[1])]
        if r[0] is not None:
            smallest[k] = min(smallest.get(k, r[0]), r[0])
    want = sorted((str(r[0]), f"{brute_print(r[1]):016x}", str(smallest.get(root[brute_print(r[1])]))) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    one = op.one_per_class(helpers.table(spark, rows))
    assert one.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = one.collect()
    assert sorted(root[brute_print(r.text)] for r in kept) == sorted(set(root.values()))
    assert {str(smallest.get(root[brute_print(r.text)])) for r in kept} == {str(r.doc_id) for r in kept}


@pytest.mark.parametrize(("sent", "task"), [(50_000, 200_000), (2, 9)])
def test_large_buckets_are_dealt_into_parts(spark, monkeypatch, sent, task):
    monkeypatch.setattr(common, "SENT_KEYS", sent)
    monkeypatch.setattr(op, "TASK_ROWS", task)
    prints = sorted(set(many(11)))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = op.components(op.links(df, len(prints), bucket=5)).collect()
    want = brute_classes(prints)
    group = {}
    for p in prints:
        group.setdefault(want[p], []).append(signed(p))
    assert sorted((r.u, r.v) for r in found) == sorted((x, min(g)) for g in group.values() for x in g if x != min(g))


def test_empty_table(spark):
    assert op.deduplicate(helpers.table(spark, [])).count() == 0
    assert op.one_per_class(helpers.table(spark, [])).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("sent", [1000, 10, 2])
def test_join_of_hot_keys_loses_nothing(spark, monkeypatch, how, sent):
    monkeypatch.setattr(common, "SENT_KEYS", sent)
    monkeypatch.setattr(common, "FEW_ROWS", 5)
    keys = [1] * 40 + [2] * 20 + [3] * 3 + list(range(4, 20))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    facts = spark.createDataFrame([(k, f"f{k}", keys.count(k)) for k in {*keys} - {3, 5}], "k long, f string, __n long")
    want = [(k, i, None if k in (3, 5) else f"f{k}") for i, k in enumerate(keys) if how == "left" or k not in (3, 5)]
    assert sorted(map(tuple, common.joined(rows, facts, ["k"], len(keys), how).collect()), key=str) == sorted(want, key=str)
