"""The two folder layouts in which histories are published, each read in one scan.

* ``read_versions``: a folder per version, with files ``*.nt.additions.txt`` and ``*.nt.deletions.txt``;
* ``read_changes``: ``alldata.IC.nt/1.nt`` (or ``000001.nt``) for version 0, then
  ``alldata.CB.nt/data-added_<v>-<v+1>.nt`` and ``data-deleted_<v>-<v+1>.nt`` for version v >= 1.

Version and sign come from the names of the files, so a history of any length is one
job; lines that aren't triples are left out.  Files may be compressed as Spark reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versograph.operators.model import CHANGE_DDL, TRIPLE
from versograph.sources import ntriples
from versograph.sources.store import Archive

_PER_VERSION = r"/([0-9]+)/[^/]*\.nt\.(additions|deletions)\.txt(?:\.[a-z0-9]+)?$"
_CHANGE = r"/alldata\.CB\.nt/data-(added|deleted)_([0-9]+)-[0-9]+\.nt(?:\.[a-z0-9]+)?$"


def _existing(spark: SparkSession, *patterns: str) -> list[str]:
    """Those of some glob patterns that name a file."""
    out = []
    for p in patterns:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        if found is not None and len(found):
            out.append(p)
    return out


def _read(spark: SparkSession, patterns: list[str], name: str, version: int, sign: int, plus: str) -> DataFrame:
    """(version, s, p, o, op) of files whose names match ``name``; ``version`` and ``sign`` are its groups."""
    if not patterns:
        return spark.createDataFrame([], CHANGE_DDL)
    rows = spark.read.text(patterns).withColumn("file", F.input_file_name()).where(F.col("file").rlike(name) & F.col("value").rlike(ntriples.LINE))
    triple = [F.regexp_extract("value", ntriples.LINE, i + 1).alias(c) for i, c in enumerate(TRIPLE)]
    op = F.when(F.regexp_extract("file", name, sign) == plus, 1).otherwise(-1).alias("op")
    return rows.select(F.regexp_extract("file", name, version).cast("int").alias("version"), *triple, op)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    root = path.rstrip("/")
    return _read(spark, _existing(spark, f"{root}/*/*.nt.additions.txt*", f"{root}/*/*.nt.deletions.txt*"), _PER_VERSION, 1, 2, "additions")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    root = path.rstrip("/")
    first = _existing(spark, f"{root}/alldata.IC.nt/1.nt*") or _existing(spark, f"{root}/alldata.IC.nt/000001.nt*")
    if not first:
        raise FileNotFoundError(f"{root}/alldata.IC.nt/1.nt")
    start = ntriples.read(spark, *first).select(F.lit(0).alias("version"), *TRIPLE, F.lit(1).alias("op"))
    later = _read(spark, _existing(spark, f"{root}/alldata.CB.nt/data-*.nt*"), _CHANGE, 2, 1, "added")
    return start.unionByName(later.where("version >= 1"))


LAYOUTS = {"versions": read_versions, "changes": read_changes}


def populate(archive: Archive, path: str, layout: str, first: int = 0, last: int | None = None, done: Callable[[int], None] | None = None) -> list[int]:
    """Appends the versions ``first`` to ``last`` of a folder, in order, except those that the archive has; ``done`` is called after each.

    In a version's change set an addition beats a deletion; the first version takes additions only.
    """
    log = LAYOUTS[layout](archive.spark, path)
    versions = [r.version for r in log.select("version").distinct().orderBy("version").collect()]  # a row per version
    new = []
    for v in versions:
        if v < first or last is not None and v > last or v <= archive.max_version():
            continue
        changes = log.where(F.col("version") == v).select(*TRIPLE, "op")
        archive.append(changes if archive.rows else changes.where("op = 1"), v, check_uniqueness=False)
        new.append(v)
        if done:
            done(v)
    return new
