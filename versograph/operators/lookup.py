"""Point lookups, seeks and positions in change sets, routes of snapshot differences, and estimates.

A change set is (s, p, o, op).  Its elements are ordered by triple, a deletion before an
addition.  Positions are counts of one scan; no change set is numbered for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versograph.operators import chain
from versograph.operators.log import net
from versograph.operators.model import TRIPLE, TriplePattern, pattern
from versograph.operators.patch import compose, reconstruct
from versograph.operators.query import EXACT, UP_TO, holds, page, routed

ELEMENT = [*TRIPLE, "op"]


def _key(columns: list[str], values: tuple) -> tuple[Column, Column]:
    return F.struct(*columns), F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, values, strict=True)])


# --- lookups


def latest_versions(log: DataFrame, version: int, match: TriplePattern | tuple | None = None, exact: bool = False) -> DataFrame:
    """(s, p, o, added, deleted): the last version up to ``version`` (``exact``: that one only) at which a triple was added and deleted, -1 if none."""
    rows = pattern(match).filter(log).where(F.col("version") == version if exact else F.col("version") <= version)
    last = lambda op: F.coalesce(F.max(F.when(F.col("op") == op, F.col("version"))), F.lit(-1))
    return rows.groupBy(*TRIPLE).agg(last(1).alias("added"), last(-1).alias("deleted"))


def changes(log: DataFrame, key: tuple | None = None, version: int | None = None, exact: bool = True, match: TriplePattern | tuple | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """The changes of a version (else of those up to it, or of all), from the triple ``key`` on in order; ``reverse``: back from it."""
    rows = pattern(match).filter(log)
    if version is not None:
        rows = rows.where(F.col("version") == version if exact else F.col("version") <= version)
    if key is not None:
        here, there = _key(TRIPLE, key)
        near = F.col("s") <= key[0] if reverse else F.col("s") >= key[0]  # this part reaches the scan
        rows = rows.where(near & (here <= there if reverse else here >= there))
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in (*TRIPLE, "version")]
    return page(rows.select("version", *ELEMENT), order, 0, limit)


def first_deletion(log: DataFrame, snapshot: int, version: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """The first deletion that matches, in the order of the index which serves the pattern."""
    m = pattern(match)
    return page(m.filter(reconstruct(log, snapshot, version).where("op = -1")).select(*TRIPLE), m.order(), 0, 1)


def additions(log: DataFrame, snapshot: int, version: int, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The additions of a version's patch from an offset on; version 0: those of any version."""
    m = pattern(match)
    rows = m.filter(log).where("op = 1").select(*TRIPLE).distinct() if version == 0 else m.filter(reconstruct(log, snapshot, version).where("op = 1")).select(*TRIPLE)
    return page(rows, m.order(), offset, limit)


def version_index(presence: DataFrame, version: int) -> DataFrame:
    """(s, p, o, index): the place of a version in the list of versions of each triple that holds then."""
    before = F.greatest(F.least("v_to", F.lit(version)) - F.col("v_from"), F.lit(0))
    rows = presence.where(F.col("v_from") <= version).groupBy(*TRIPLE).agg(F.sum(before).alias("index"), F.max(holds(version)).alias("now"))
    return rows.where("now").select(*TRIPLE, "index")


# --- positions in a change set


def position_of(patch: DataFrame, element: tuple, strict: bool = False) -> DataFrame:
    """(position): how many elements come before (s, p, o, op); ``strict``: -1 if it isn't there."""
    here, there = _key(ELEMENT, element)
    rows = patch.agg(F.coalesce(F.sum((here < there).cast("bigint")), F.lit(0)).alias("n"), F.coalesce(F.max(here == there), F.lit(False)).alias("found"))
    return rows.select(F.when(F.col("found") | F.lit(not strict), F.col("n")).otherwise(-1).alias("position"))


def position_of_pattern(patch: DataFrame, element: tuple, same: str) -> DataFrame:
    """(position): of the element among those that agree with it in the parts named by ``same`` (letters of ``spo``, ``t`` for the type)."""
    here, there = _key(ELEMENT, element)
    names = dict(zip("spot", ELEMENT, strict=True))
    rows = patch.where(reduce(Column.__and__, [F.col(names[c]) == element[ELEMENT.index(names[c])] for c in same], F.lit(True)) & (here <= there))
    return rows.agg((F.count(F.lit(1)) - 1).alias("position"))


def index_of_triple(patch: DataFrame, triple: tuple) -> DataFrame:
    """(position): of the triple's deletion, else of its addition, else -1."""
    here, there = _key(TRIPLE, triple)
    sums = patch.agg(F.sum((here < there).cast("bigint")).alias("n"), F.max(here == there).alias("found"))
    return sums.select(F.when(F.col("found"), F.col("n")).otherwise(-1).alias("position"))


def element_at(patch: DataFrame, index: int) -> DataFrame:
    """The element at a place from 0; one beyond the end is an error."""
    got = page(patch.select(*ELEMENT), ELEMENT, index, 1) if index >= 0 else None
    if got is None or got.isEmpty():
        raise IndexError(index)
    return got


def overwritten(patch: DataFrame, index: int, element: tuple) -> DataFrame:
    """The change set with the element at a place replaced."""
    old = element_at(patch, index).head()
    here, there = _key(ELEMENT, tuple(old))
    return patch.select(*ELEMENT).where(here != there).unionByName(patch.sparkSession.createDataFrame([element], "s string, p string, o string, op int"))


# --- differences of snapshots


def folded_delta(log: DataFrame, snapshots: list[int], start: int, end: int) -> DataFrame:
    """(s, p, o, op) between two snapshots: the deltas of the chains between them, composed."""
    stops = [s for s in sorted(snapshots) if start <= s <= end]
    if not stops or stops[0] != start or stops[-1] != end:
        raise ValueError(f"{start} and {end} are not both snapshots")
    parts = [net(log, a, b) for a, b in zip(stops, stops[1:], strict=False)]
    return reduce(compose, parts) if parts else net(log, start, start)


def snapshot_delta(log: DataFrame, snapshots: dict[int, DataFrame], start: int, end: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """(s, p, o, addition): neighbouring snapshots by the changes of their chain, others by comparing the two."""
    if start not in snapshots or end not in snapshots:
        raise ValueError(f"{start} and {end} are not both snapshots")
    if sum(start < s <= end for s in snapshots) <= 1:
        return chain.dm_hybrid(log, start, end, match)
    m = pattern(match)
    return chain.snapshot_difference(m.filter(snapshots[start]), m.filter(snapshots[end]))


# --- estimates


def vm_estimate(log: DataFrame, snapshot: DataFrame, start: int, version: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """(n, kind): the snapshot's matches less the deletions and with the additions of the version's patch."""
    m = pattern(match)
    base = m.filter(snapshot).agg(F.count(F.lit(1)).alias("a"))
    moved = m.filter(net(log, start, version)).agg(F.coalesce(F.sum("op"), F.lit(0)).alias("b"))
    return base.crossJoin(F.broadcast(moved)).select((F.col("a") + F.col("b")).cast("bigint").alias("n"), F.lit(EXACT).alias("kind"))  # one row each


def vq_estimate(presence: DataFrame, snapshots: list[int], match: TriplePattern | tuple | None = None) -> DataFrame:
    """(n, kind): the matches of every snapshot and, for every chain, the triples that it ever adds; a triple that several chains hold counts for each."""
    rows = pattern(match).filter(presence)
    starts = sorted(snapshots)
    spans = list(zip(starts, [*starts[1:], 2147483647], strict=True))
    flags = {f"x{a}": F.max(holds(a)) for a, _ in spans} | {f"y{a}": F.max((F.col("v_from") > a) & (F.col("v_from") < b)) for a, b in spans}
    sums = rows.groupBy(*TRIPLE).agg(*[c.alias(k) for k, c in flags.items()])
    total = sum((F.coalesce(F.sum(F.col(k).cast("bigint")), F.lit(0)) for k in flags), F.lit(0))
    return sums.agg(total.cast("bigint").alias("n")).select("n", F.lit(EXACT if len(starts) == 1 else UP_TO).alias("kind"))


__all__ = ["additions", "changes", "element_at", "first_deletion", "folded_delta", "index_of_triple", "latest_versions", "overwritten", "position_of", "position_of_pattern", "routed", "snapshot_delta", "version_index", "vm_estimate", "vq_estimate"]
