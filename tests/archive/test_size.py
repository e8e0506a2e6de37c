"""What a task holds doesn't grow with the table, and no step is done twice."""

import pytest
from pyspark.sql import functions as F

from versograph.functions import terms
from versograph.plans import fixtures, queries

COLUMNS = ["id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "timestamp '1996-02-03' + make_interval(id % 5) AS o_orderdate", "'1-URGENT' AS o_orderpriority"]


@pytest.fixture
def orders(spark, tmp_path):
    spark.range(200).selectExpr(*COLUMNS).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_tasks_grow_in_number_with_the_table(spark, tmp_path):
    text = " || ".join(["uuid()"] * 5)
    spark.range(100_000).selectExpr(*COLUMNS[:2], f"{text} AS o_orderstatus", *COLUMNS[3:]).write.parquet(f"{tmp_path}/orders.parquet")
    rows = fixtures.orders_presence(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 12 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in rows) < 2 * sum(r["count"] for r in rows) / len(rows)


@pytest.mark.parametrize("name", ["dm_range", "version_index", "dict_subjects", "stat_entity_changes", "stat_triple_to_entity_change"])
def test_triples_and_subjects_take_one_shuffle_of_orders(spark, orders, name):
    df = queries.QUERIES[name](spark, orders)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_shared_terms_come_from_one_pass(spark, orders):
    plan = queries.QUERIES["dict_shared_terms"](spark, orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan
    rows = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("b", "q", "b"), (None, "p", None)], "s string, p string, o string")
    assert {r.term for r in terms.terms(rows, "shared").collect()} == {"b", None}


def test_an_untidy_log_is_shuffled_and_sorted_once(spark, orders):
    plan = queries.QUERIES["log_normalised"](spark, orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_frequent_terms_are_not_dealt_out_by_their_value(spark):
    t = spark.range(3000).selectExpr("concat('s', id) AS s", "'p' AS p", "if(id % 3 = 0, concat('o', id), 'often') AS o").union(spark.createDataFrame([("x", "q", "often"), (None, "p", None)], "s string, p string, o string"))
    ids = terms.dictionary(t.where("s IS NOT NULL"), 3)
    match = {"p": ids.where("term = 'p'")}
    coded = terms.encode(t, ids, match)
    assert sorted(map(tuple, terms.decode(coded, ids, match).select("s", "p", "o").collect()), key=str) == sorted(map(tuple, t.where("p = 'p'").collect()), key=str)
    known = {r.term: r.term_id for r in ids.collect()}
    assert sorted(known.values()) == list(range(1, len(known) + 1)) and [*known] == sorted(known, key=known.get) == sorted(known)
    assert {r.o for r in coded.where("s IS NOT NULL").collect()} == {known[r.o] for r in t.where("s IS NOT NULL").collect()}
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p#" not in plan and sum("hashpartitioning(o#" in line for line in plan.splitlines()) <= 1  # the count of each object
