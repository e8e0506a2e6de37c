import random
import re
import time

import pytest

from tests.llm import helpers
from versograph.llm import op01_license as op

SCAN = op.Scanner()


def distance(a, b):
    """Edits to turn ``a`` into some substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("text", [
    "Foo bar.\nReleased under the MIT License.", "Relased undr the MIT Lisence", "released under an mit license", "licensed under the Apache Licence, Version 2.0",
    "This work is licenced under the GNU General Public Licens, version 3", "Licensed under CC BY-NC 4.0.", "Licensed CC BYNC 4.0", "nothing of this kind here", "all right reserved", "",
])
def test_fuzzy_labels_match_brute_force(text):
    flat = b" ".join(text.encode().translate(op.WORDS_ONLY).split()).decode()
    want = {label for notice, label, k in op.NOTICES if distance(notice, flat) <= k}
    assert {x[2] for x in SCAN.fuzzy(flat)} == want


def test_a_worse_match_before_the_best_is_found():
    for text, want in (
        ("relased undr the mit license released under the mit license", [(0, 28, 2), (29, 59, 0)]),
        ("released under the mit license relased undr the mit license", [(0, 30, 0), (31, 59, 2)]),
    ):
        assert [(a, b, e) for a, b, label, e, _ in SCAN.fuzzy(text) if label == "mit"] == want


def whole_text_search(text, pattern, start, end):
    """The best match, then what lies before and after it."""
    m = pattern.search(text, start, end) if end > start else None
    if not m:
        return []
    here = (sum(m.fuzzy_counts), m.start(), m.end())
    return [*whole_text_search(text, pattern, start, m.start()), here, *whole_text_search(text, pattern, m.end(), end)]


@pytest.mark.parametrize("seed", range(12))
def test_spans_are_those_of_searching_the_whole_text(seed):
    r = random.Random(seed)
    for i in (0, 4, 5, 8, 12, 20, 23):
        notice, _, k, pattern = SCAN.notices[i]
        parts = []
        for _ in range(r.randint(1, 5)):
            x = list(notice)
            for _ in range(r.randint(0, k + 1)):
                at = r.randrange(len(x))
                x[at : at + r.randint(0, 1)] = r.choice(["", "z", "q", "e"])
            parts.append("".join(x))
        text = r.choice([" ", "", " and "]).join(parts)
        got = SCAN.spans(text, i, SCAN.windows(text).get(i, []))
        want = whole_text_search(text, pattern, 0, len(text))
        assert sorted(got, key=lambda x: x[1]) == want


def test_a_megabyte_of_near_notices_takes_seconds():
    text = "all right reserved " * 55_000
    began = time.process_time()
    assert len(SCAN.scan(text.encode())["hits"]) == 55_000
    assert time.process_time() - began < 60


def test_notices_leave_room_for_one_match_in_a_window():
    assert all(len(text) > 6 * k for text, _, k in op.NOTICES)


def test_spans_are_places_in_the_text():
    text = "Ünï — x.\n\nReleased,  under the (MIT) License!! and so on"
    (hit,) = SCAN.scan(text.encode())["hits"]
    assert text[hit["start"] : hit["end"]] == "Released,  under the (MIT) License" and hit["edits"] == 0


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts = [(i, label) for phrase, label in op.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in starts]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts}))


def test_documents(spark):
    rows = [*helpers.ODD, (50, "MIT License mit LICENSE; the apache-license\nGNU general public license xmit license", "en", "a", 1), (51, "mit licenses emit license", "en", "a", 1)]
    got = op.scan_documents(helpers.table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (doc_id, text, *_) in zip(got, rows, strict=True):
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (doc_id, *brute(text))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert op.scan_documents(helpers.table(spark, [])).count() == 0


def test_the_query_returns_the_spans(spark, tmp_path):
    helpers.table(spark, [(1, "Released undr the MIT License", "en", "a", 1), (2, None, "en", "a", 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hits for r in op.op1_license(spark, str(tmp_path)).collect()}
    assert got == {1: "mit:0:29:1", 2: ""}
