"""Queries on snapshots and the change sets after them, without the table of intervals.

Each chain starts at a snapshot.  Only the log between the snapshot and the version
is read, so with the log in one folder per version a query costs the snapshot and
its chain, however long the history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versograph.operators.log import intervals, net
from versograph.operators.model import TRIPLE, TriplePattern, pattern
from versograph.operators.query import routed


def vm_hybrid(snapshot: DataFrame, log: DataFrame, start: int, version: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """The snapshot without what its chain deletes, and what the chain adds."""
    m = pattern(match)
    delta = net(m.filter(log), start, version)
    kept = m.filter(snapshot).join(delta.where("op = -1"), TRIPLE, "left_anti")
    return kept.select(*TRIPLE).unionByName(delta.where("op = 1").select(*TRIPLE))


def dm_hybrid(log: DataFrame, start: int, end: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """The delta from the changes between the two versions alone."""
    return net(pattern(match).filter(log), start, end).select(*TRIPLE, (F.col("op") == 1).alias("addition"))


def snapshot_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, p, o, addition) between two snapshots, which hold each triple once."""
    gone = a.join(b, TRIPLE, "left_anti").select(*TRIPLE, F.lit(False).alias("addition"))
    return gone.unionByName(b.join(a, TRIPLE, "left_anti").select(*TRIPLE, F.lit(True).alias("addition")))


def vq_hybrid(snapshots: dict[int, DataFrame], log: DataFrame, last: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """Version lists chain by chain, then united."""
    m, starts, parts = pattern(match), sorted(snapshots), []
    for k, start in enumerate(starts):
        end = starts[k + 1] - 1 if k + 1 < len(starts) else last
        own = m.filter(log).where((F.col("version") > start) & (F.col("version") <= end)).select("version", *TRIPLE, "op")
        first = m.filter(snapshots[start]).select(F.lit(start).cast("int").alias("version"), *TRIPLE, F.lit(1).alias("op"))
        spans = F.sequence("v_from", F.least(F.col("v_to") - 1, F.lit(end)))
        parts.append(intervals(first.unionByName(own)).select(*TRIPLE, spans.alias("versions")))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*TRIPLE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions")))).alias("versions"))


def routing(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, snapshot): the greatest snapshot up to each version, -1 if there is none."""
    pairs = versions.join(F.broadcast(snapshots), F.col("snapshot") <= F.col("version"), "left")  # one row per snapshot
    return pairs.groupBy("version").agg(F.coalesce(F.max("snapshot"), F.lit(-1)).cast("int").alias("snapshot"))


__all__ = ["dm_hybrid", "routed", "routing", "snapshot_difference", "vm_hybrid", "vq_hybrid"]
