"""Triple-pattern queries at one version, between two, and over all, on the table of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versograph.operators.model import ANY, OPEN, TRIPLE, TriplePattern, pattern

EXACT, UP_TO = "EXACT", "UP_TO"


def holds(version: int | Column) -> Column:
    return (F.col("v_from") <= version) & (F.col("v_to") > version)


def page(df: DataFrame, order: list, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in a total order from ``offset``; without offset and limit the order is left open."""
    if not offset and limit is None:
        return df
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def vm(presence: DataFrame, version: int, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The triples that match at a version; one beyond the last version is as the last."""
    rows = pattern(match).filter(presence.where(holds(version))).select(*TRIPLE)
    return page(rows, TRIPLE, offset, limit)


def vm_in_chain_order(presence: DataFrame, version: int, snapshot: int, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """VM with the triples of the chain's snapshot first, each part in the order of the index that serves the pattern."""
    m = pattern(match)
    rows = m.filter(presence.where(holds(version) | holds(snapshot)))
    rows = rows.groupBy(*TRIPLE).agg(F.max(holds(version)).alias("now"), F.max(F.when(holds(snapshot), 0).otherwise(1)).alias("later"), F.min(F.when(holds(snapshot), 0).otherwise(1)).alias("segment")).where("now")
    first = [F.when(F.col("segment") == 0, F.col(c)) for c in m.snapshot_order()]
    rows = rows.orderBy("segment", *first, *m.order())
    rows = rows.offset(offset) if offset else rows
    return (rows if limit is None else rows.limit(limit)).select(*TRIPLE)


def vm_counts(presence: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, n) for each row of ``versions``: running sums of additions less deletions, so no row is expanded."""
    moves = presence.select(F.explode(F.array(F.struct(F.col("v_from").alias("at"), F.lit(1).alias("d")), F.struct(F.col("v_to").alias("at"), F.lit(-1).alias("d")))).alias("m"))
    steps = moves.groupBy("m.at").agg(F.sum("m.d").alias("d"))  # as many rows as versions
    both = versions.join(F.broadcast(steps), F.col("at") <= F.col("version"), "left")
    return both.groupBy("version").agg(F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("n"))


def dm(presence: DataFrame, start: int, end: int, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None, last: int | None = None) -> DataFrame:
    """Triples added (true) or deleted (false) between two versions; none unless start < end."""
    if last is not None:
        end = min(end, last)
    m = pattern(match)
    rows = m.filter(presence)
    if end <= start:
        return rows.where(F.lit(False)).select(*TRIPLE, F.lit(True).alias("addition"))
    rows = rows.where(holds(start) != holds(end))
    both = rows.groupBy(*TRIPLE).agg(F.max(holds(start)).alias("a"), F.max(holds(end)).alias("b")).where("a <> b")
    return page(both.select(*TRIPLE, F.col("b").alias("addition")), m.order(), offset, limit)


def dm_counts(presence: DataFrame, last: int) -> DataFrame:
    """(i, j, n): sizes of the deltas between all versions i < j up to ``last``.

    Two versions differ by what either holds, less twice what both hold.  Any two intervals of a
    triple (or one with itself) put it into a rectangle of such pairs; corners are summed, and running
    sums along both axes give the pairs.  So rows are few per triple, however many versions there are.
    """
    span = F.struct(F.greatest("v_from", F.lit(0)).alias("a"), F.least("v_to", F.lit(last + 1)).alias("b"))
    spans = presence.where((F.col("v_from") <= last) & (F.col("v_to") > 0)).groupBy(*TRIPLE).agg(F.collect_list(span).alias("x"))
    two = spans.select("x", F.explode("x").alias("r")).select("r", F.explode("x").alias("t"))
    corners = [F.struct(F.col(f"r.{i}").alias("i"), F.col(f"t.{j}").alias("j"), F.lit(1 if i == j else -1).alias("d")) for i in "ab" for j in "ab"]
    steps = two.select(F.explode(F.array(*corners)).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.d").alias("d"))
    cells = presence.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j"))
    held = cells.join(steps, ["i", "j"], "left").withColumn("d", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("j").orderBy("i")))
    held = held.select("i", "j", F.sum("d").over(Window.partitionBy("i").orderBy("j")).alias("both"))
    sizes = held.where("i = j")
    rows = held.where("i < j").join(sizes.select("i", F.col("both").alias("x")), "i").join(sizes.select("j", F.col("both").alias("y")), "j")
    return rows.select("i", "j", (F.col("x") + F.col("y") - 2 * F.col("both")).cast("bigint").alias("n"))


def dm_plain(presence: DataFrame, start: int, end: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """The same from the two whole versions, by a full outer join."""
    a = vm(presence, start, match).withColumn("a", F.lit(True))
    b = vm(presence, end, match).withColumn("b", F.lit(True))
    return a.join(b, TRIPLE, "full").where("a IS NULL OR b IS NULL").select(*TRIPLE, F.col("a").isNull().alias("addition"))


def vq(presence: DataFrame, last: int, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Every matching triple with the ascending list of versions in which it exists, up to ``last``."""
    m = pattern(match)
    rows = m.filter(presence).where(F.col("v_from") <= last)
    spans = F.sequence("v_from", F.least(F.col("v_to") - 1, F.lit(last)))
    out = rows.groupBy(*TRIPLE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(spans)))).alias("versions"))
    return page(out, m.order(), offset, limit)


def vq_count(presence: DataFrame, match: TriplePattern | tuple | None = None) -> DataFrame:
    return pattern(match).filter(presence).select(*TRIPLE).distinct().agg(F.count(F.lit(1)).alias("n"))


def _sizes(presence: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return presence.agg(*[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(k) for k, c in flags.items()])


def dm_estimate(presence: DataFrame, start: int, end: int, snapshots: list[int], match: TriplePattern | tuple | None = None) -> DataFrame:
    """(n, kind): an upper bound of the delta's size from the sizes of each end's delta to its snapshot, in one scan."""
    rows = pattern(match).filter(presence)
    a, b = routed(snapshots, start), routed(snapshots, end)
    if end <= start or a < 0 or b < 0:
        return rows.sparkSession.createDataFrame([(0, UP_TO)], "n bigint, kind string")
    rows = rows.groupBy(*TRIPLE).agg(*[F.max(holds(v)).alias(k) for k, v in (("i", start), ("j", end), ("a", a), ("b", b))])
    flags = {"x": F.col("i") != F.col("a") if start != a else F.lit(False), "y": F.col("j") != F.col("b") if end != b else F.lit(False)}
    if a != b:
        flags |= {"sa": F.col("a"), "sb": F.col("b")}
    sizes = _sizes(rows, flags)
    return sizes.select(sum((F.col(k) for k in flags), F.lit(0)).cast("bigint").alias("n"), F.lit(UP_TO).alias("kind"))


def routed(snapshots: list[int], version: int) -> int:
    """The greatest snapshot up to a version, or -1."""
    return max((s for s in snapshots if s <= version), default=-1)


__all__ = ["ANY", "EXACT", "OPEN", "UP_TO", "dm", "dm_counts", "dm_estimate", "dm_plain", "holds", "page", "routed", "vm", "vm_counts", "vm_in_chain_order", "vq", "vq_count"]
