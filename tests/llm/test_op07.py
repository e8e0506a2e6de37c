import random

import numpy as np
import pytest

from tests.llm import helpers
from versograph.llm import op07_decontaminate as op

WORDS = [f"w{i}" for i in range(400)]


def smith_waterman(a, b):
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b, 1):
            new.append(max(0.0, row[j - 1] + (op.MATCH if x == y else op.MISMATCH), row[j] + op.GAP, new[-1] + op.GAP))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_matches_brute_force():
    rng = random.Random(1)
    a = [[rng.randrange(6) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    b = [[rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(60)]
    score, _ = op.align(op.padded(list(map(np.array, a)), -1), op.padded(list(map(np.array, b)), -2))
    assert score.tolist() == pytest.approx([smith_waterman(x, y) for x, y in zip(a, b, strict=True)])


def case(seed=3):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(12, 40)))) for i in range(12)] + [(None, "w1 w2 zz"), (90, ""), (91, None)]
    docs, want = [], set()
    for d in range(120):
        text = rng.choices(WORDS, k=rng.randint(5, 200))
        if d % 3 == 0:
            i, t = items[rng.randrange(12)]
            copy = t.split()
            for _ in range(len(copy) // 6 if d % 2 else 0):
                copy[rng.randrange(len(copy))] = "edit"
            at = rng.randrange(len(text))
            text[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(text).upper() if d % 5 == 0 else ", ".join(text), "en", "a", 1))
    return items, docs, want


@pytest.mark.parametrize("block", [4_000_000, 600])
def test_exact_and_edited_copies_are_found(spark, block, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_CHARS", block)
    items, docs, want = case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = helpers.table(spark, [*docs, *helpers.ODD])
    got = op.contaminated(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    number = {w: i for i, w in enumerate(WORDS)}
    texts, by = dict((d[0], d[1]) for d in docs), dict(items)
    for r in got:
        words = [number.get(w, -3) for w in texts[r.doc_id].lower().replace(",", "").split()]
        item = [number[w] for w in by[r.item_id].split()]
        assert r.score == pytest.approx(smith_waterman(item, words) / len(item))
        assert smith_waterman(item, words[r.first_word : r.end_word]) / len(item) == pytest.approx(r.score)
    kept = op.clean_documents(df, benchmark)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == len(docs) + len(helpers.ODD) - len({d for d, _ in want})


def test_heavily_edited_copies_are_those_of_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS[:60] if i % 2 else WORDS, k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 12, 15, 20, 30, 40])]
    docs = []
    for d in range(150):
        text = rng.choices(WORDS[:60] if d % 4 == 0 else WORDS, k=rng.randint(0, 60))
        copy, how = items[d % 15][1].split(), d // 15 % 5
        if how == 0:  # every third word replaced: no run of three words is left
            copy = ["edit" if j % 3 == 2 else w for j, w in enumerate(copy)]
        elif how == 1:  # a word put in after each
            copy = [x for w in copy for x in (w, "edit")]
        else:
            for _ in range(rng.randint(0, len(copy) * 35 // 100)):
                j = rng.randrange(len(copy))
                copy[j : j + 1] = rng.choice([["edit"], [], [copy[j], "edit"]]) if len(copy) > 1 else copy
        at = rng.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + copy + text[at:]), "en", "a", 1))
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            score = smith_waterman(item.split(), text.split()) / len(item.split())
            if score >= (op.MIN_SCORE if len(item.split()) > op.GRAM else 1):
                want[d, i] = score
    got = op.contaminated(spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == pytest.approx(want) and len(got) == len(want)


def test_the_seeds_that_occur_are_not_left_out(spark):
    """A copy with words 3, 6 and 9 of 12 replaced; its only whole run of three words had been discarded."""
    item = WORDS[:12]
    copy = ["edit" if j in (2, 5, 8) else w for j, w in enumerate(item)]
    got = op.contaminated(spark.createDataFrame([(1, " ".join(copy), "en", "a", 1)], helpers.SCHEMA), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(1, 7, smith_waterman(item, copy) / 12)]


def test_an_item_in_every_document_is_found(spark):
    item = " ".join(WORDS[:30])
    docs = spark.createDataFrame([(i, f"w{i + 50} {item} w{i + 90}", "en", "a", 1) for i in range(50)], helpers.SCHEMA)
    assert op.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 50


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.contaminated(helpers.table(spark), none).count() == 0
    assert op.clean_documents(helpers.table(spark), none).count() == len(helpers.ODD)
    assert op.contaminated(helpers.table(spark, []), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0
