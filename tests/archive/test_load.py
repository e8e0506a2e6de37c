"""A whole history loaded at once, against appends of its versions."""

import pytest
from pyspark.sql import functions as F

from tests.archive.test_golden import F7, F8, log, rows, triples
from versograph.operators.model import TRIPLE
from versograph.plans import fixtures, strategy
from versograph.sources.store import Archive

SAME = ["version", "snapshot_id", "is_snapshot", "delta_size", "agg_delta_size", "version_size", "change_ratio", "local_change_ratio", "snapshot_size"]
UNTIDY = "0:+aaa-bbb+aab+aac 1:+aaa-aab-ccc 2:+aab-aaa+aad 3:-aaa+aaa+aad 4:-aab-aad 6:+aab+aaa+eee"


def appended(archive, changes, versions):
    for v in versions:
        assert archive.append(changes.where(F.col("version") == v).select(*TRIPLE, "op"), v, check_uniqueness=False)
    return archive


def content(archive):
    sets = {"log": archive.log(), "presence": archive.presence()} | {v: archive.snapshot(v) for v in archive.snapshots()}
    return {k: sorted(map(tuple, df.collect())) for k, df in sets.items()}, [[r[c] for c in SAME] for r in archive.rows]


@pytest.mark.parametrize("text, last, make", [(F7, 3, lambda: strategy.interval(2)), (UNTIDY, 7, lambda: strategy.aggchange(0.5))])
def test_a_load_equals_appends(spark, tmp_path, text, last, make):
    changes, versions = spark.createDataFrame(rows(text), "version int, s string, p string, o string, op int").persist(), range(last + 1)
    one = appended(Archive.open(spark, str(tmp_path / "one"), make(), buckets=2), changes, versions)
    Archive.open(spark, str(tmp_path / "all"), make(), buckets=2).load(changes, list(versions))
    again = Archive.open(spark, str(tmp_path / "all"), make())
    assert content(again) == content(one)
    for a in (one, again):
        a.new_patch().addition("n", "n", "n").deletion("a", "a", "a").commit()
    assert content(again) == content(one)
    with pytest.raises(ValueError):
        again.load(changes, list(versions))


def test_a_load_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    changes, path = log(spark, F8).persist(), str(tmp_path / "a")
    with monkeypatch.context() as m:
        m.setattr(Archive, "_manifest", lambda self: 1 / 0)
        broken = Archive.open(spark, path, strategy.interval(3))
        with pytest.raises(ZeroDivisionError):
            broken.load(changes, list(range(8)))
        assert broken.rows == [] and broken.max_version() == -1
    a = Archive.open(spark, path, strategy.interval(3))
    assert a.max_version() == -1 and triples(a.vm(3)) == []
    a.load(changes, list(range(8)))
    assert sorted(map(tuple, a.log().collect())) == sorted(map(tuple, changes.collect())) and a._numbers("log/version=0") == [a.generation]


def test_the_stored_orders_are_not_appended_one_by_one(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "timestamp '1996-02-03' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(Archive, "append", lambda *a, **b: 1 / 0)
    archive = fixtures.stored_orders(spark, str(tmp_path))
    want = fixtures.orders_log(spark, str(tmp_path)).select("version", *TRIPLE, "op")
    assert sorted(map(tuple, archive.log().collect())) == sorted(map(tuple, want.collect())) and archive.snapshots() == [0, 3, 6]
