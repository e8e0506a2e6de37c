"""N-Triples in and out, and the text forms of query results.  Terms keep their brackets, quotes and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.operators.model import TRIPLE

_RESOURCE = r"(?:<[^>]*>|_:[^\s]+)"
_LITERAL = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?'
#: Subject, predicate, object; a comment may follow the final dot.
LINE = rf"^\s*({_RESOURCE})\s+(<[^>]*>)\s+({_RESOURCE}|{_LITERAL})\s*\.\s*(?:#.*)?$"


def parse(rows: DataFrame) -> DataFrame:
    """(s, p, o) of lines in a column ``value``; empty lines, comments and lines that aren't triples are left out."""
    hit = rows.where(F.col("value").rlike(LINE))
    return hit.select(*[F.regexp_extract("value", LINE, i + 1).alias(c) for i, c in enumerate(TRIPLE)])


def malformed(rows: DataFrame) -> DataFrame:
    """The lines that are neither triples nor empty nor comments."""
    return rows.where(~F.col("value").rlike(LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read(spark: SparkSession, *paths: str) -> DataFrame:
    return parse(spark.read.text(list(paths)))


def read_signed(spark: SparkSession, paths: list[tuple[str, str]]) -> DataFrame:
    """(s, p, o, op, seq) of files with a sign each, in their order."""
    out = None
    for k, (sign, path) in enumerate(paths):
        rows = read(spark, path).select(*TRIPLE, F.lit(1 if sign == "+" else -1).alias("op"), F.lit(k).alias("seq"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "s string, p string, o string, op int, seq int")


def lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", *TRIPLE, F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines(triples).write.mode(mode).text(path)


def _shown() -> F.Column:
    return F.concat(F.concat_ws(" ", *TRIPLE), F.lit("."))


def show_triples(df: DataFrame) -> DataFrame:
    return df.select(_shown().alias("line"))


def show_delta(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.when(F.col("addition"), F.lit("+ ")).otherwise(F.lit("- ")), _shown()).alias("line"))


def show_versions(df: DataFrame) -> DataFrame:
    listed = F.concat_ws(" ", F.transform("versions", lambda v: v.cast("string")))
    return df.select(F.concat(_shown(), F.lit(" :: [ "), listed, F.lit(" ]")).alias("line"))


def show_patch(df: DataFrame) -> DataFrame:
    """One line per entry: the triple, its sign and an L for a local change."""
    sign = F.when(F.col("op") == 1, F.lit(" (+)")).otherwise(F.lit(" (-)"))
    local = F.when(F.col("local"), F.lit(" L")).otherwise(F.lit("")) if "local" in df.columns else F.lit("")
    return df.select(F.concat(_shown(), sign, local).alias("line"))
