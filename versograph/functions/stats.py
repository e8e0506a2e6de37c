"""Change statistics between two versions, each as one row, with as few scans as it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versograph.operators.model import TRIPLE
from versograph.operators.query import dm, holds


def _ratio(a: str, b: str) -> F.Column:
    return F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))


def _states(presence: DataFrame, i: int, j: int) -> DataFrame:
    """Triples that hold at either version, with flags a and b."""
    return presence.where(holds(i) | holds(j)).groupBy(*TRIPLE).agg(F.max(holds(i)).alias("a"), F.max(holds(j)).alias("b"))


def change_ratio(presence: DataFrame, i: int, j: int) -> DataFrame:
    """Changes against the first version's size plus the changes."""
    rows = _states(presence, i, j).agg(F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("d"), F.sum(F.col("a").cast("bigint")).alias("n"))
    return rows.select(F.coalesce(F.col("d").cast("double") / (F.col("n") + F.col("d")), F.lit(0.0)).alias("value"))


def growth_ratio(presence: DataFrame, i: int, j: int) -> DataFrame:
    rows = presence.agg(F.sum(holds(i).cast("bigint")).alias("a"), F.sum(holds(j).cast("bigint")).alias("b"))
    return rows.select(_ratio("b", "a").alias("value"))


def dynamicity(presence: DataFrame, i: int, j: int) -> DataFrame:
    """Terms (of any position) in one version only, against the terms in either."""
    terms = presence.where(holds(i) | holds(j)).select(F.explode(F.array(*TRIPLE)).alias("t"), holds(i).alias("a"), holds(j).alias("b"))
    terms = terms.groupBy("t").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    rows = terms.agg(F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select(_ratio("x", "n").alias("value"))


def changed_entities(presence: DataFrame, i: int, j: int) -> DataFrame:
    """Subjects of one of the versions only."""
    rows = presence.where(holds(i) | holds(j)).groupBy("s").agg(F.max(holds(i)).alias("a"), F.max(holds(j)).alias("b"))
    return rows.where("a <> b").select("s")


def entity_changes(presence: DataFrame, i: int, j: int) -> DataFrame:
    return changed_entities(presence, i, j).agg(F.count(F.lit(1)).alias("value"))


def triple_to_entity_change(presence: DataFrame, i: int, j: int) -> DataFrame:
    """Changed triples whose subject came or went, for each such subject: one pass by subject."""
    rows = _states(presence, i, j).groupBy("s").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("n"))
    rows = rows.where("a <> b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"))
    return rows.select(_ratio("n", "k").alias("value"))


def object_updates(presence: DataFrame, i: int, j: int) -> DataFrame:
    """Pairs of a deletion and an addition with equal subject and predicate.

    Objects of a delta differ, so the pairs of a (subject, predicate) are a product of
    two counts and needn't be made.
    """
    rows = dm(presence, i, j).groupBy("s", "p").agg(F.sum(F.col("addition").cast("bigint")).alias("x"), F.sum((~F.col("addition")).cast("bigint")).alias("y"))
    return rows.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).cast("bigint").alias("value"))


def orphan_additions(presence: DataFrame, i: int, j: int) -> DataFrame:
    """Always 0."""
    return presence.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("value"))


orphan_deletions = orphan_additions


def consumed_statistics(presence: DataFrame, i: int, j: int) -> tuple[DataFrame, DataFrame]:
    """triple_to_entity_change and, over the triples that it did not count, the added triples that update an object."""
    delta = dm(presence, i, j)
    sigma = changed_entities(presence, i, j)
    rest = delta.join(sigma, "s", "left_anti")
    gone = rest.where("NOT addition").select("s", "p").distinct()
    return triple_to_entity_change(presence, i, j), rest.where("addition").join(gone, ["s", "p"], "left_semi").agg(F.count(F.lit(1)).alias("value"))


STATISTICS = {f.__name__: f for f in (change_ratio, dynamicity, growth_ratio, entity_changes, triple_to_entity_change, object_updates, orphan_additions)} | {"orphan_deletions": orphan_deletions}


def consecutive(presence: DataFrame, last: int) -> DataFrame:
    """(version, change_ratio, growth_ratio, n_added, n_deleted) of every version against the one before, in one aggregation."""
    moves = F.array(F.struct(F.col("v_from").alias("v"), F.lit(1).alias("d")), F.struct(F.col("v_to").alias("v"), F.lit(-1).alias("d")))
    steps = presence.select(F.explode(moves).alias("m")).where(F.col("m.v") <= last).groupBy("m.v").agg(F.sum((F.col("m.d") == 1).cast("bigint")).alias("n_added"), F.sum((F.col("m.d") == -1).cast("bigint")).alias("n_deleted"))
    versions = presence.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("version"))
    rows = versions.join(F.broadcast(steps), F.col("v") <= F.col("version"))  # a row per version
    rows = rows.groupBy("version").agg(
        F.sum(F.when(F.col("v") < F.col("version"), F.col("n_added") - F.col("n_deleted")).otherwise(0)).alias("before"),
        F.sum(F.when(F.col("v") == F.col("version"), F.col("n_added")).otherwise(0)).alias("n_added"),
        F.sum(F.when(F.col("v") == F.col("version"), F.col("n_deleted")).otherwise(0)).alias("n_deleted"),
    )
    d = F.col("n_added") + F.col("n_deleted")
    ratio = F.coalesce(d.cast("double") / (F.col("before") + d), F.lit(0.0))
    growth = F.when(F.col("before") > 0, (F.col("before") + F.col("n_added") - F.col("n_deleted")).cast("double") / F.col("before")).otherwise(0.0)
    return rows.select("version", ratio.alias("change_ratio"), growth.alias("growth_ratio"), "n_added", "n_deleted")


def _appearances(moves: DataFrame, key: str, *more: str) -> DataFrame:
    """``moves`` (a row per key and version, with d: triples won less triples lost) with came and went: whether the key's first triple comes or its last goes.

    A key has as many rows as versions in which it changes, so a frequent term is no hot key.
    """
    after = F.sum("d").over(Window.partitionBy(key).orderBy("version"))
    rows = moves.withColumn("after", after).withColumn("before", F.col("after") - F.col("d"))
    return rows.select(key, "version", *more, ((F.col("before") == 0) & (F.col("after") > 0)).alias("came"), ((F.col("before") > 0) & (F.col("after") == 0)).alias("went"))


def consecutive_table(log: DataFrame, presence: DataFrame, last: int) -> DataFrame:
    """(version, change_ratio, dynamicity, growth_ratio, entity_changes, triple_to_entity_change, object_updates) of every version
    against the one before.

    The last two share a set: a changed triple whose subject comes or goes is counted by
    the first only.  Everything comes from the log, in three aggregations over it.
    """
    n = lambda c: F.sum(c.cast("bigint"))
    by_pair = log.groupBy("s", "p", "version").agg(n(F.col("op") == 1).alias("x"), n(F.col("op") == -1).alias("y"))
    by_subject = by_pair.groupBy("s", "version").agg(F.sum(F.col("x") - F.col("y")).alias("d"), F.sum(F.col("x") + F.col("y")).alias("n"), F.sum(F.when(F.col("y") > 0, F.col("x")).otherwise(0)).alias("u"))
    moved = F.col("came") | F.col("went")
    subjects = _appearances(by_subject, "s", "n", "u").groupBy("version").agg(n(moved).alias("k"), F.sum(F.when(moved, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(~moved, F.col("u")).otherwise(0)).alias("u"))
    terms = log.select("version", "op", F.explode(F.array(*TRIPLE)).alias("t")).groupBy("t", "version").agg(F.sum("op").alias("d"))
    terms = _appearances(terms, "t").groupBy("version").agg(n(F.col("came")).alias("came"), n(F.col("went")).alias("went"))
    terms = terms.withColumn("before", F.sum(F.col("came") - F.col("went")).over(Window.orderBy("version")) - F.col("came") + F.col("went"))  # a row per version
    sizes = consecutive(presence, last)
    rows = sizes.join(F.broadcast(subjects), "version", "left").join(F.broadcast(terms), "version", "left").na.fill(0)
    either = F.col("before") + F.col("came")
    return rows.select(
        "version", "change_ratio", F.when(either > 0, (F.col("came") + F.col("went")).cast("double") / either).otherwise(0.0).alias("dynamicity"), "growth_ratio",
        F.col("k").alias("entity_changes"), F.when(F.col("k") > 0, F.col("n").cast("double") / F.col("k")).otherwise(0.0).alias("triple_to_entity_change"), F.col("u").alias("object_updates"),
    )
