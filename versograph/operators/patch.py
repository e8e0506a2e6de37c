"""Algebra of single change sets and of deltas relative to a snapshot."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versograph.operators.log import last_write_wins, net
from versograph.operators.model import TRIPLE, TriplePattern, pattern

#: The seven combinations of bound components other than the whole triple.
SHAPES = [tuple(c) for n in (2, 1, 0) for c in combinations(TRIPLE, n)]


def reconstruct(log: DataFrame, snapshot: int, version: int) -> DataFrame:
    """The patch of a version relative to its snapshot (s, p, o, op); changes that were undone don't show."""
    return net(log, snapshot, version)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """One delta after another: opposite signs cancel, equal ones count once."""
    both = first.select(*TRIPLE, "op").unionByName(second.select(*TRIPLE, "op"))
    return both.groupBy(*TRIPLE).agg(F.sum("op").alias("x")).where("x <> 0").select(*TRIPLE, F.signum("x").cast("int").alias("op"))


def rebase(first: DataFrame, second: DataFrame) -> DataFrame:
    """From the end of one delta to the end of another with the same start: the first undone, then the second."""
    a = first.select(*TRIPLE, F.col("op").alias("a"))
    b = second.select(*TRIPLE, F.col("op").alias("b"))
    rows = a.join(b, TRIPLE, "full").where("a IS NULL OR b IS NULL")
    return rows.select(*TRIPLE, F.coalesce(F.col("b"), -F.col("a")).cast("int").alias("op"))


def join_patches(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newer entry of each triple; ``local`` is toggled where it turns an older one round."""
    a = old.select(*TRIPLE, F.col("op").alias("a"), (F.col("local") if "local" in old.columns else F.lit(False)).alias("l"))
    b = new.select(*TRIPLE, F.col("op").alias("b"))
    turned = F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    local = F.coalesce("l", F.lit(False))
    return a.join(b, TRIPLE, "full").select(*TRIPLE, F.coalesce("b", "a").alias("op"), F.when(turned, ~local).otherwise(local).alias("local"))


def written_in_order(writes: DataFrame) -> DataFrame:
    """The element (s, p, o, op, local) that is left after ``writes`` (with seq and local) one after the other.

    A write of the same sign takes the place of the element with its flag; one of the other
    sign toggles the flag that was there.  After the last write that didn't turn its element
    round, signs alternate, so the flag is that write's, toggled if the last sign is another.
    Equal ``seq`` go by op, then by flag.
    """
    before = F.lag("op").over(Window.partitionBy(*TRIPLE).orderBy("seq", "op", "local"))
    rows = writes.withColumn("__b", before).withColumn("__w", F.struct("seq", "op", "local"))
    stays = F.coalesce(F.col("__b") == F.col("op"), F.lit(True))
    both = rows.groupBy(*TRIPLE).agg(F.max("__w").alias("w"), F.max(F.when(stays, F.col("__w"))).alias("k"))
    return both.select(*TRIPLE, F.col("w.op").alias("op"), (F.col("k.local") != (F.col("k.op") != F.col("w.op"))).alias("local"))


def contains(log: DataFrame, snapshot: int, version: int, triples: DataFrame) -> DataFrame:
    """``triples`` (s, p, o) with op of the version's patch, 0 where it has none."""
    return triples.join(reconstruct(log, snapshot, version), TRIPLE, "left").select(*TRIPLE, F.coalesce("op", F.lit(0)).alias("op"))


def clashes(log: DataFrame, version: int, changes: DataFrame) -> DataFrame:
    """The triples of ``changes`` that the log already names at that version."""
    return changes.join(log.where(F.col("version") == version), TRIPLE, "left_semi")


def deletion_count(log: DataFrame, snapshot: int, version: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    """(n, s, p, o): how many deletions match, and the last of them."""
    rows = pattern(match).filter(reconstruct(log, snapshot, version).where("op = -1"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*TRIPLE)).alias("t")).select("n", "t.*")


def addition_count(log: DataFrame, snapshot: int, version: int, match: TriplePattern | tuple | None = None) -> DataFrame:
    rows = pattern(match).filter(reconstruct(log, snapshot, version).where("op = 1"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


def addition_counts(log: DataFrame, snapshot: int, version: int, least: int = 100) -> DataFrame:
    """(s, p, o, n): counts of additions for the seven shapes with an unbound component, from ``least`` on."""
    adds = reconstruct(log, snapshot, version).where("op = 1")
    cells = adds.cube(*TRIPLE).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return cells.where((F.col("g") != 0) & (F.col("n") >= least)).select(*TRIPLE, "n")


def numbered(df: DataFrame, order: list[str], names: dict[str, int], partitions: int | None = None) -> DataFrame:
    """``df`` in a total ``order``: for each name, the place of a row, from 0, among those that agree in the first so many columns.

    The rows are sorted by range over all tasks and numbered by the sizes of the parts
    before, so that a key with any share of the rows never sits in one task.
    """
    ranked = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    ranked = ranked.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")).persist()
    sizes = ranked.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    at, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["__part"]):
        starts.append((r["__part"], at))
        at += r.n
    base = df.sparkSession.createDataFrame(starts, "__part int, __at bigint")
    rows = ranked.join(F.broadcast(base), "__part").withColumn("__n", F.col("__at") + F.col("__row"))
    places = []
    for name, keys in names.items():
        if keys:
            least = rows.groupBy(*order[:keys]).agg(F.min("__n").alias(f"__{name}"))
            rows = rows.join(least, order[:keys])
        places.append((F.col("__n") - (F.col(f"__{name}") if keys else 0)).alias(name))
    return rows.select(*df.columns, *places)


def deletion_positions(log: DataFrame, snapshot: int, version: int) -> DataFrame:
    """Each deletion of a version's patch with its place among those that share each of the seven shapes."""
    rows = reconstruct(log, snapshot, version).where("op = -1").select(*TRIPLE)
    for order, names in POSITIONS:
        rows = numbered(rows, list(order), names)
    return rows


#: The sorts from which all seven positions follow, and the numbers of leading columns that are bound.
POSITIONS = [("spo", {"pos_sp_": 2, "pos_s__": 1, "pos____": 0}), ("osp", {"pos_s_o": 2, "pos___o": 1}), ("pso", {"pos__p_": 1}), ("pos", {"pos__po": 2})]

__all__ = ["POSITIONS", "SHAPES", "addition_count", "addition_counts", "clashes", "compose", "contains", "deletion_count", "deletion_positions", "join_patches", "last_write_wins", "numbered", "rebase", "reconstruct", "written_in_order"]
