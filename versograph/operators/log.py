"""From a change log to intervals of presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versograph.operators.model import OPEN, TRIPLE


def last_write_wins(changes: DataFrame, *keys: str) -> DataFrame:
    """One change per triple (and ``keys``): the one with the largest ``seq``; without ``seq``, an addition beats a deletion."""
    rank = F.struct("seq", "op") if "seq" in changes.columns else F.struct("op")
    return changes.groupBy(*TRIPLE, *keys).agg(F.max(rank).alias("__r")).select(*keys, *TRIPLE, F.col("__r.op").alias("op"))


def normalise(changes: DataFrame) -> DataFrame:
    """A log in which each triple's operations alternate, beginning with an addition, at most one per version."""
    one = last_write_wins(changes, "version")
    before = F.lag("op").over(Window.partitionBy(*TRIPLE).orderBy("version"))
    return one.withColumn("__b", F.coalesce(before, F.lit(-1))).where("op <> __b").select("version", *TRIPLE, "op")


def intervals(log: DataFrame) -> DataFrame:
    """(s, p, o, v_from, v_to) of a normalised log; v_to is exclusive, OPEN while the triple lasts."""
    after = F.lead("version").over(Window.partitionBy(*TRIPLE).orderBy("version"))
    rows = log.withColumn("v_to", F.coalesce(after, F.lit(OPEN)).cast("int")).where("op = 1")
    return rows.select(*TRIPLE, F.col("version").cast("int").alias("v_from"), "v_to")


def net(log: DataFrame, start: int, end: int) -> DataFrame:
    """The delta between two versions (s, p, o, op), from the changes after ``start`` up to ``end`` of a normalised log.

    A triple whose first and last operations differ is as it was.
    """
    part = log.where((F.col("version") > start) & (F.col("version") <= end))
    both = part.groupBy(*TRIPLE).agg(F.min_by("op", "version").alias("a"), F.max_by("op", "version").alias("op"))
    return both.where("a = op").select(*TRIPLE, "op")
