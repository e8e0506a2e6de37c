"""Small histories with known answers, on intervals, on chains and in stored archives."""

import random

import pytest

from versograph.functions import stats
from versograph.operators import chain, patch
from versograph.operators import query as q
from versograph.operators.log import intervals, net, normalise
from versograph.operators.model import TriplePattern

F1 = "0:+aaa+aab+aac 1:-aab"
F2 = "0:+gpo+szo+hzo+hpo 1:-gpo+apo-szo+sao 2:-gpo-apo-hzo+lao 4:-hpo-szo 5:+hpo 6:+apo"
F3 = "0:" + "".join(f"+{i}{i}{i}" for i in range(10)) + " 1:-000-111-222-444-555"
F4 = "0:+aaa+baa+ccc+daa+yaa+zaa 1:-baa-ccc-yaa-zaa"
F5 = "0:+aaa+aab+aac 1:-aab 2:+aad 3:+aae-aaa"
F6 = "0:+aaa 1:-aaa 2:+aaa 3:-aaa 4:+aaa"
F7 = "0:+aaa+aab+aac 1:-aab 2:+aad 3:+abc+abd-aaa"
F8 = "0:+aaa+aba 1:-aba 2:+aca 3:-aaa+ada+aea 4:-aca 5:-ada 6:+aba 7:+aca"
F11 = "0:+aaa+aab 1:+aac 2:+aad 3:-aab+aae 4:+aab-aae 5:-aab+aae"


def rows(text):
    out = []
    for part in text.split():
        v, ops = part.split(":")
        for k in range(0, len(ops), 4):
            sign, s, p, o = ops[k : k + 4]
            out.append((int(v), s, p, o, 1 if sign == "+" else -1))
    return out


def log(spark, text):
    return normalise(spark.createDataFrame(rows(text), "version int, s string, p string, o string, op int"))


@pytest.fixture
def presence(spark):
    return lambda text: intervals(log(spark, text))


def triples(df):
    return ["".join(r[:3]) for r in df.collect()]


def delta(df):
    return [("+" if r.addition else "-") + r.s + r.p + r.o for r in df.collect()]


def lists(df):
    return {r.s + r.p + r.o: r.versions for r in df.collect()}


def test_first_and_last_versions(presence):
    p = presence(F1)
    assert sorted(triples(q.vm(p, 0))) == ["aaa", "aab", "aac"]
    assert sorted(triples(q.vm(p, 1))) == sorted(triples(q.vm(p, 2))) == ["aaa", "aac"]
    assert triples(q.vm(p, -1)) == [] and triples(q.vm(p, 1, (None, None, "c"))) == ["aac"]


def test_redundant_changes_and_order(presence, spark):
    p = presence(F2)
    assert triples(q.vm_in_chain_order(p, 1, 0)) == ["hpo", "hzo", "apo", "sao"]
    assert sorted(triples(q.vm(p, 2))) == ["hpo", "lao", "sao"]
    versions = spark.createDataFrame([(v,) for v in range(3)], "version int")
    assert {r.version: r.n for r in q.vm_counts(p, versions).collect()} == {0: 4, 1: 4, 2: 3}


@pytest.mark.parametrize("offset, want", [(0, ["333", "666", "777", "888", "999"]), (3, ["888", "999"]), (9, [])])
def test_offsets(presence, offset, want):
    assert triples(q.vm(presence(F3), 1, offset=offset, limit=100)) == want


def test_offsets_with_a_pattern(presence):
    p, m = presence(F4), (None, "a", "a")
    assert q.vm(p, 0, m).count() == 5 and triples(q.vm(p, 1, m, offset=0, limit=9)) == ["aaa", "daa"]
    assert triples(q.vm(p, 1, m, offset=1)) == ["daa"] and triples(q.vm(p, 1, m, offset=2)) == []


def test_deltas_and_estimate(presence, spark):
    p = presence(F5)
    assert delta(q.dm(p, 1, 2)) == ["+aad"] and sorted(delta(q.dm(p, 2, 3))) == ["+aae", "-aaa"]
    assert q.dm(p, 1, 3).count() == 3 and q.dm(p, 3, 1).count() == 0 and q.dm(p, 2, 2).count() == 0
    assert tuple(q.dm_estimate(p, 1, 2, [0]).head()) == (3, "UP_TO")
    g = log(spark, F5)
    assert sorted(delta(chain.dm_hybrid(g, 1, 3))) == sorted(delta(q.dm(p, 1, 3))) == sorted(delta(q.dm_plain(p, 1, 3)))


def test_add_and_remove_cycles(presence, spark):
    p = presence(F6)
    assert [delta(q.dm(p, i, i + 1)) for i in range(4)] == [["-aaa"], ["+aaa"], ["-aaa"], ["+aaa"]]
    assert delta(q.dm(p, 0, 4)) == [] and lists(q.vq(p, 4)) == {"aaa": [0, 2, 4]}
    assert net(log(spark, F6), 0, 4).count() == 0


@pytest.mark.parametrize("text, last", [(F2, 6), (F6, 4), (F8, 7), (F11, 5)])
def test_sizes_of_all_deltas(presence, text, last):
    p = presence(text)
    want = {(i, j): q.dm_plain(p, i, j).count() for i in range(last + 1) for j in range(i + 1, last + 1)}
    assert {(r.i, r.j): r.n for r in q.dm_counts(p, last).collect()} == want
    assert {(r.i, r.j): r.n for r in q.dm_counts(p, 1).collect()} == {(0, 1): want[0, 1]}
    assert [r.n for r in q.dm_counts(p.where("false"), 2).collect()] == [0, 0, 0]


def test_writes_one_after_the_other(spark):
    rng = random.Random(3)
    writes = [(rng.choice("ab"), "p", rng.choice("xyz"), rng.choice([1, -1]), k, rng.random() < 0.5) for k in range(60)]
    want = {}
    for s, p, o, op, _, local in writes:
        old = want.get((s, p, o))
        want[s, p, o] = (op, not old[1]) if old and old[0] != op else (op, local)
    rows = spark.createDataFrame(writes, "s string, p string, o string, op int, seq int, local boolean")
    assert {(r.s, r.p, r.o): (r.op, r.local) for r in patch.written_in_order(rows).collect()} == want


@pytest.mark.parametrize("text, last, step, want", [
    (F7, 3, 2, {"aaa": [0, 1, 2], "aab": [0], "aac": [0, 1, 2, 3], "aad": [2, 3], "abc": [3], "abd": [3]}),
    (F8, 7, 3, {"aaa": [0, 1, 2], "aba": [0, 6, 7], "aca": [2, 3, 7], "ada": [3, 4], "aea": [3, 4, 5, 6, 7]}),
])
def test_version_lists_over_several_snapshots(presence, spark, text, last, step, want):
    p, g = presence(text), log(spark, text)
    snaps = {v: q.vm(p, v) for v in range(0, last + 1, step)}
    assert lists(q.vq(p, last)) == lists(chain.vq_hybrid(snaps, g, last)) == want
    assert lists(q.vq(p, last, ("a", "b", "a"))) == {k: v for k, v in want.items() if k == "aba"}
    assert q.vq(p, last, offset=len(want)).count() == 0 and q.vq_count(p).head()["n"] == len(want)


def test_hybrid_versions_equal_those_of_the_intervals(presence, spark):
    for text, last in ((F2, 6), (F11, 5)):
        p, g = presence(text), log(spark, text)
        for v in range(last + 1):
            start = v - v % 3
            assert sorted(triples(chain.vm_hybrid(q.vm(p, start), g, start, v))) == sorted(triples(q.vm(p, v)))


def test_deltas_over_snapshots(presence):
    p = presence(F11)
    assert sorted(delta(q.dm(p, 0, 5))) == ["+aac", "+aad", "+aae", "-aab"]
    assert sorted(delta(q.dm(p, 1, 5))) == ["+aad", "+aae", "-aab"]


def test_literals_come_before_resources(spark):
    data = [(0, "<a>", "<b>", '"z"^^<http://example.org/literal>', 1), (0, "<a>", "<b>", "<c>", 1), (1, "<a>", "<b>", '"a"', 1)]
    p = intervals(spark.createDataFrame(data, "version int, s string, p string, o string, op int"))
    got = [r.o for r in q.vm(p, 1, offset=0, limit=9).collect()]
    assert got == ['"a"', '"z"^^<http://example.org/literal>', "<c>"]


def test_patches_with_a_virtual_snapshot(spark):
    text = "-1:+222+333+444 0:+111-222-333 1:+abc 2:-444"
    out = []
    for part in text.split():
        v, ops = part.split(":")
        out += [(int(v), ops[k + 1], ops[k + 2], ops[k + 3], 1 if ops[k] == "+" else -1) for k in range(0, len(ops), 4)]
    g = normalise(spark.createDataFrame(out, "version int, s string, p string, o string, op int"))
    at = lambda v: sorted(("+" if r.op == 1 else "-") + r.s + r.p + r.o for r in patch.reconstruct(g, -1, v).collect())
    assert at(0) == ["+111", "-222", "-333"] and at(2) == ["+111", "+abc", "-222", "-333", "-444"]
    assert [patch.deletion_count(g, -1, v).head()["n"] for v in (0, 1, 2)] == [2, 2, 3]
    places = {r.s: (r["pos____"], r["pos_s__"]) for r in patch.deletion_positions(g, -1, 2).collect()}
    assert places == {"2": (0, 0), "3": (1, 0), "4": (2, 0)}
    d02 = patch.reconstruct(g, 0, 2)
    assert sorted(map(tuple, patch.compose(patch.reconstruct(g, -1, 0), d02).collect())) == sorted(map(tuple, patch.reconstruct(g, -1, 2).collect()))
    assert sorted(map(tuple, patch.rebase(patch.reconstruct(g, -1, 0), patch.reconstruct(g, -1, 2)).collect())) == sorted(map(tuple, d02.collect()))


def test_patterns():
    assert [TriplePattern(*x).shape() for x in (("a", "b", "c"), ("a", "?x", ""), (None, "b", "?"))] == ["SPO", "S??", "?P?"]
    assert TriplePattern(None, "p", None).order() == ["p", "o", "s"]


def test_statistics(presence):
    p = presence(F7)
    value = lambda f, i, j: f(p, i, j).head()["value"]
    assert value(stats.change_ratio, 0, 3) == pytest.approx(5 / 8) and value(stats.growth_ratio, 0, 3) == pytest.approx(4 / 3)
    assert value(stats.dynamicity, 0, 3) == pytest.approx(1 / 4)
    assert value(stats.entity_changes, 0, 3) == 0 and value(stats.triple_to_entity_change, 0, 3) == 0
    assert value(stats.object_updates, 0, 3) == 2 and value(stats.orphan_additions, 0, 3) == 0
