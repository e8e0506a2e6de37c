"""Terms of an archive: numbers of them, shared ones, and an optional dictionary of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versograph.operators.model import TRIPLE
from versograph.operators.patch import numbered


def is_literal(c: str) -> F.Column:
    return F.col(c).startswith('"')


def roles(triples: DataFrame) -> DataFrame:
    """(t, s, p, o): each term with the positions it takes."""
    rows = triples.select(F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(c).alias("r")) for c in TRIPLE])).alias("x")).select("x.*")
    return rows.groupBy("t").agg(*[F.max(F.col("r") == c).alias(c) for c in TRIPLE])


def cardinalities(triples: DataFrame) -> DataFrame:
    """One row: elements, subjects, predicates, objects, shared, literals and non-literals."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    s, p, o, lit = F.col("s"), F.col("p"), F.col("o"), is_literal("t")
    return roles(triples).agg(F.count(F.lit(1)).alias("n_elements"), n(s).alias("n_subjects"), n(p).alias("n_predicates"), n(o).alias("n_objects"), n(s & o).alias("n_shared"), n(o & lit).alias("n_literals"), n(o & ~lit).alias("n_non_literals"))


def terms(triples: DataFrame, role: str) -> DataFrame:
    """Distinct subjects (s), predicates (p), objects (o) or terms that are both subject and object (shared)."""
    if role == "shared":
        both = triples.select(F.explode(F.array(*[F.struct(F.col(c).alias("term"), F.lit(c).alias("r")) for c in ("s", "o")])).alias("x")).select("x.*")
        return both.groupBy("term").agg(F.max(F.col("r") == "s").alias("s"), F.max(F.col("r") == "o").alias("o")).where("s AND o").select("term")
    return triples.select(F.col(role).alias("term")).distinct()


def dictionary(triples: DataFrame, partitions: int | None = None) -> DataFrame:
    """(term, term_id): ids from 1 in the order of the terms; 0 stays free for the wildcard.  ``partitions``: of the sort, else as many as Spark takes."""
    rows = triples.select(F.explode(F.array(*TRIPLE)).alias("term")).distinct()
    return numbered(rows, ["term"], {"term_id": 0}, partitions).select("term", (F.col("term_id") + 1).alias("term_id"))


#: A predicate or an object of more than 1/MANY of the rows is looked up by broadcast; there can't be more than MANY.
MANY = 10_000


def _looked_up(triples: DataFrame, ids: DataFrame, match: dict[str, DataFrame] | None, a: str, b: str) -> DataFrame:
    match, rows = match or {}, triples
    entry = lambda df, c, name: df.select(F.col(a).alias(c), F.col(b).alias(name))
    for c, one in match.items():
        rows = rows.join(F.broadcast(entry(one, c, f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
    given = rows
    for c in (c for c in TRIPLE if c not in match):
        key, found = F.col(c), F.lit(None)
        if c != "s":  # frequent values first; the shuffle deals their rows out by keys of their own, which can't change what was found
            n = given.agg(F.count(F.lit(1)).alias("n"))
            frequent = given.groupBy(c).agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).where(F.col("k") * MANY > F.col("n")).select(F.col(c).alias(a))
            rows = rows.join(F.broadcast(entry(ids.join(F.broadcast(frequent), a), c, "__f")), c, "left")
            own = F.monotonically_increasing_id()
            key, found = F.when(F.col("__f").isNull(), F.col(c)).otherwise(F.concat(F.lit("\0"), own.cast("string")) if a == "term" else -1 - own), F.col("__f")
        rows = rows.withColumn("__k", key).join(entry(ids, "__k", "__g"), "__k", "left").withColumn(c, F.coalesce(found, "__g")).drop("__k", "__f", "__g")
    return rows


def encode(triples: DataFrame, ids: DataFrame, match: dict[str, DataFrame] | None = None) -> DataFrame:
    """s, p and o as ids; an unknown term gives null.  ``match``: by column, the one entry (term, term_id) which it must have; the other rows are left out before they are encoded."""
    return _looked_up(triples, ids, match, "term", "term_id")


def decode(triples: DataFrame, ids: DataFrame, match: dict[str, DataFrame] | None = None) -> DataFrame:
    """The way back; ``match``: by column, the one entry that all rows have, if that is known."""
    return _looked_up(triples, ids, match, "term_id", "term")
