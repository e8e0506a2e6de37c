"""Two archives made of the test tables, as change logs; and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versograph.operators.log import intervals
from versograph.operators.model import TRIPLE
from versograph.plans import strategy
from versograph.sources.store import Archive

LAST_ORDERS, LAST_EVENTS = 6, 9


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last action per three days: replaced when it differs from the one before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    version = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3).cast("int")
    last = e.groupBy("user_id", version.alias("version")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("o"))
    rows = last.withColumn("before", F.lag("o").over(Window.partitionBy("user_id").orderBy("version"))).where("before IS NULL OR before <> o")
    s, p = F.concat(F.lit("ex:user/"), F.col("user_id").cast("string")), F.lit("ex:lastAction")
    both = F.array(F.struct(F.col("o"), F.lit(1).alias("op")), F.struct(F.col("before").alias("o"), F.lit(-1).alias("op")))
    return rows.select("version", s.alias("s"), p.alias("p"), F.explode(both).alias("c")).where("c.o IS NOT NULL").select("version", "s", "p", "c.o", "c.op")


def parts(table: DataFrame) -> int:
    """As many as the table has MiB on disk, so that a task's share doesn't grow with it; the default parallelism at least."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(size >> 20, table.sparkSession.sparkContext.defaultParallelism)


def orders_log(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Orders that are placed, archived, sometimes withdrawn and sometimes restored.

    ``together``: each order, so each subject, in one task.  Orders are shuffled, then, and not
    the several changes of each; all that goes by triple or by subject needs no other shuffle.
    """
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = table.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.year("o_orderdate") - 1995).alias("v0"))
    k = F.col("o_orderkey")
    o = o.withColumn("v1", (F.col("v0") + 1 + k % 4).cast("int")).withColumn("s", F.concat(F.lit("ex:order/"), k.cast("string")))
    o = o.repartition(parts(table), "s") if together else o
    cust = F.concat(F.lit("ex:cust/"), F.col("o_custkey").cast("string"))

    def row(version: Column, p: str, value: Column, op: int, when: Column) -> Column:
        return F.when(when, F.struct(version.cast("int").alias("version"), F.lit(p).alias("p"), value.alias("o"), F.lit(op).alias("op")))

    v0, v1, always = F.col("v0"), F.col("v1"), F.lit(True)
    rows = []
    for p, value in (("ex:placedBy", cust), ("ex:priority", F.col("o_orderpriority"))):
        rows += [row(v0, p, value, 1, always), row(v1, p, value, -1, (v1 <= 6) & (k % 5 == 0)), row(v1 + 1, p, value, 1, (v1 + 1 <= 6) & (k % 10 == 0))]
    status = F.col("o_orderstatus")
    rows += [row(v0, "ex:status", status, 1, always), row(v1, "ex:status", status, -1, v1 <= 6), row(v1, "ex:status", F.lit("archived"), 1, v1 <= 6)]
    return o.select("s", F.explode(F.array(*rows)).alias("c")).where("c IS NOT NULL").select("c.version", "s", "c.p", "c.o", "c.op")


def orders_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(orders_log(spark, sf_dir, together=True))


_STORED: dict[tuple[str, str], Archive] = {}


def ingest_orders(spark: SparkSession, sf_dir: str, path: str, done: Callable[[int], None] | None = None) -> Archive:
    """The orders archive on disk, appended version by version, with a snapshot at every third; ``done`` is called after each."""
    archive = Archive.open(spark, path, strategy.interval(3), buckets=8)
    log = orders_log(spark, sf_dir).persist()
    for v in range(LAST_ORDERS + 1):
        archive.append(log.where(F.col("version") == v).select(*TRIPLE, "op"), v, check_uniqueness=False)
        if done:
            done(v)
    log.unpersist()
    return archive


def stored_orders(spark: SparkSession, sf_dir: str) -> Archive:
    """The orders archive in the shared folder, loaded once by an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        archive = Archive.open(spark, f"{where or tempfile.mkdtemp()}/versograph-orders-{uuid.uuid4().hex}", strategy.interval(3), buckets=8)
        archive.load(orders_log(spark, sf_dir, together=True), list(range(LAST_ORDERS + 1)))
        archive._fs.deleteOnExit(archive._at(""))
        _STORED[key] = archive
    return _STORED[key]


def events_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(events_log(spark, sf_dir))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


_ORDERS_SQL = """base AS (
  SELECT 'ex:order/' || o_orderkey AS s, o_orderkey AS k, 'ex:cust/' || o_custkey AS cust, o_orderpriority AS pri, o_orderstatus AS st,
    CAST(year(o_orderdate) - 1995 AS INTEGER) AS v0, CAST(year(o_orderdate) - 1995 + 1 + o_orderkey % 4 AS INTEGER) AS v1 FROM orders),
two AS (SELECT s, k, v0, v1, 'ex:placedBy' AS p, cust AS o FROM base UNION ALL SELECT s, k, v0, v1, 'ex:priority', pri FROM base),
log AS (
  SELECT v0 AS version, s, p, o, 1 AS op FROM two
  UNION ALL SELECT v1, s, p, o, -1 FROM two WHERE v1 <= 6 AND k % 5 = 0
  UNION ALL SELECT v1 + 1, s, p, o, 1 FROM two WHERE v1 + 1 <= 6 AND k % 10 = 0
  UNION ALL SELECT v0, s, 'ex:status', st, 1 FROM base
  UNION ALL SELECT v1, s, 'ex:status', st, -1 FROM base WHERE v1 <= 6
  UNION ALL SELECT v1, s, 'ex:status', 'archived', 1 FROM base WHERE v1 <= 6)"""
_EVENTS_SQL = """acts AS (
  SELECT user_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) AS INTEGER) AS version, event_type,
    row_number() OVER (PARTITION BY user_id, floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) ORDER BY ts DESC, event_id DESC) AS rn FROM events),
lasts AS (SELECT user_id, version, event_type AS o, lag(event_type) OVER (PARTITION BY user_id ORDER BY version) AS b FROM acts WHERE rn = 1),
log AS (
  SELECT version, 'ex:user/' || user_id AS s, 'ex:lastAction' AS p, o, 1 AS op FROM lasts WHERE b IS NULL OR b <> o
  UNION ALL SELECT version, 'ex:user/' || user_id, 'ex:lastAction', b, -1 FROM lasts WHERE b <> o)"""
_PRESENCE_SQL = """pres AS (SELECT s, p, o, version AS v_from, v_to FROM (
  SELECT *, coalesce(lead(version) OVER (PARTITION BY s, p, o ORDER BY version), 2147483647) AS v_to FROM log) WHERE op = 1)"""
ORDERS_SQL = f"WITH {_ORDERS_SQL},\n{_PRESENCE_SQL}"
EVENTS_SQL = f"WITH {_EVENTS_SQL},\n{_PRESENCE_SQL}"
