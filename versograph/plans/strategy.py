"""When to materialise a version as a snapshot.

A strategy is a predicate on the history of the open chain: one entry per version
since its snapshot.  It runs on the driver, over as many numbers as versions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versograph.operators.log import net
from versograph.operators.query import holds


@dataclass
class Version:
    version: int
    delta_size: int = 0
    agg_delta_size: int = 0
    version_size: int = 0
    change_ratio: float = 0.0
    local_change_ratio: float = 0.0
    ingest_ms: int = 0


@dataclass
class Chain:
    """A snapshot's size and the versions after it."""

    snapshot: int
    snapshot_size: int
    versions: list[Version] = field(default_factory=list)

    def add(self, version: int, delta: int, additions: int, deletions: int, ingest_ms: int = 0) -> Version:
        changed, size = additions + deletions, self.snapshot_size - deletions + additions
        before = self.versions[-1].version_size if self.versions else None
        local = delta / (before + delta) if before is not None and before + delta else 0.0
        v = Version(version, delta, changed, size, changed / max(1, self.snapshot_size + additions), local, ingest_ms)
        self.versions.append(v)
        return v


Strategy = Callable[[Chain], bool]


def never() -> Strategy:
    return lambda c: False


def always() -> Strategy:
    return lambda c: True


def interval(step: float = 5) -> Strategy:
    return lambda c: bool(c.versions) and c.versions[-1].version % int(step) == 0


def size(threshold: float = 10.0) -> Strategy:
    """The chain's delta against the mean delta, rounded down (none while that is 0)."""

    def create(c: Chain) -> bool:
        mean = sum(v.delta_size for v in c.versions) // len(c.versions) if c.versions else 0
        return mean > 0 and c.versions[-1].agg_delta_size / mean > threshold

    return create


def time(ratio: float = 3.0) -> Strategy:
    return lambda c: len(c.versions) >= 3 and c.versions[1].ingest_ms > 0 and c.versions[-1].ingest_ms / c.versions[1].ingest_ms > ratio


def size2(threshold: float = 0.12) -> Strategy:
    return lambda c: bool(c.versions) and c.snapshot_size > 0 and c.versions[-1].agg_delta_size / c.snapshot_size > threshold


def change(threshold: float = 0.05) -> Strategy:
    return lambda c: bool(c.versions) and c.versions[-1].change_ratio > threshold


def aggchange(threshold: float = 1.5) -> Strategy:
    return lambda c: sum(v.change_ratio for v in c.versions) >= threshold


def locaggchange(threshold: float = 0.5) -> Strategy:
    return lambda c: sum(v.local_change_ratio for v in c.versions) >= threshold


def any_of(*parts: Strategy) -> Strategy:
    return lambda c: any(p(c) for p in parts)


def all_of(*parts: Strategy) -> Strategy:
    return lambda c: all(p(c) for p in parts)


NAMED = {"never": never, "interval": interval, "size": size, "time": time, "size2": size2, "change": change, "aggchange": aggchange, "locaggchange": locaggchange}


def parse(name: str, parameters: str = "") -> Strategy | None:
    """``interval``; or ``and_a-b`` (all of) and ``or_a-b`` (any of) with parameters ``x-y``; None if the numbers differ (none are needed for a single name) or a name is unknown."""
    how, _, rest = name.rpartition("_")
    names = rest.split("-")
    if how and not parameters:
        return None
    values = parameters.split("-") if parameters else [""] * len(names)
    if len(values) != len(names) or any(n not in NAMED for n in names):
        return None
    parts = [NAMED[n](float(v)) if v and n != "never" else NAMED[n]() for n, v in zip(names, values, strict=True)]
    if not how:
        return parts[0] if len(parts) == 1 else None
    return all_of(*parts) if how == "and" else any_of(*parts)


def version_meta(presence: DataFrame, log: DataFrame, snapshot: int, last: int) -> DataFrame:
    """(version, delta_size, agg_delta_size, version_size, change_ratio, local_change_ratio) of one chain's versions.

    All versions come from running sums over the changes of each: one to a triple that
    the snapshot holds takes from it or gives back, another adds or takes back.
    """
    spark = presence.sparkSession
    versions = spark.range(snapshot + 1, last + 1).select(F.col("id").cast("int").alias("version"))
    deltas = log.where((F.col("version") > snapshot) & (F.col("version") <= last)).groupBy("version").agg(F.count(F.lit(1)).alias("delta_size"))
    base = presence.where(holds(snapshot)).select("s", "p", "o").withColumn("base", F.lit(1))
    moves = log.where((F.col("version") > snapshot) & (F.col("version") <= last)).join(base, ["s", "p", "o"], "left")
    kept = F.col("base").isNotNull()
    steps = moves.groupBy("version").agg(F.sum(F.when(~kept, F.col("op")).otherwise(0)).alias("a"), F.sum(F.when(kept, -F.col("op")).otherwise(0)).alias("d"))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    upto = versions.join(F.broadcast(steps.withColumnRenamed("version", "at")), F.col("at") <= F.col("version"), "left")  # a row per version
    rows = upto.groupBy("version").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("d"), F.lit(0)).alias("d")).crossJoin(F.broadcast(n))  # one row
    out = versions.join(F.broadcast(rows), "version", "left").join(F.broadcast(deltas), "version", "left").na.fill(0)
    size = F.col("n") - F.col("d") + F.col("a")
    out = out.select("version", "delta_size", (F.col("a") + F.col("d")).alias("agg_delta_size"), size.alias("version_size"), ((F.col("a") + F.col("d")) / F.greatest(F.col("n") + F.col("a"), F.lit(1))).alias("change_ratio"))
    b = out.select((F.col("version") + 1).alias("version"), F.col("version_size").alias("before"))
    both = out.join(F.broadcast(b), "version", "left")
    local = F.when(F.col("before").isNull(), 0.0).otherwise(F.col("delta_size") / (F.col("before") + F.col("delta_size")))
    return both.select("version", "delta_size", "agg_delta_size", "version_size", "change_ratio", F.coalesce(local, F.lit(0.0)).alias("local_change_ratio"))


__all__ = ["Chain", "NAMED", "Strategy", "Version", "aggchange", "all_of", "always", "any_of", "change", "interval", "locaggchange", "net", "never", "parse", "size", "size2", "time", "version_meta"]
