"""What the text operators share: reading tables, mapping texts, written intermediate tables.

Defined results for odd input, used by every operator here:

* a null text counts as the empty text; a null ``doc_id`` stays null in the result;
* repeated rows give repeated result rows (near-duplicate classes excepted, see there);
* an empty table gives an empty result;
* columns other than the ones an operator names are ignored, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text handed to a Python function at once (a longer text goes alone).
SLICE_BYTES = 4 << 20
#: Whether Spark deletes the shuffle files of a plan, on all executors, when its execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is set, one of our own in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "/tmp/checkpoints/versograph"  # driver and executors are one process
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str, free: bool = False) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared folder, and a function that deletes it.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.  The
    folder goes when the application ends, if not before.  With ``free`` the shuffle
    files of ``df`` go as soon as it is written; otherwise they stay until the driver
    happens to collect the garbage that refers to them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/versograph-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(CLEANUP)
        elif free:
            spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), lambda: fs.delete(where, True)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which stays until the application ends."""
    return stored(df, name, free)[0]


#: Rows of a table of keys that may be sent to every task.
SENT_KEYS = 50_000
#: Rows that a key may have without being told apart in a small table.
FEW_ROWS = 200


def joined(rows: DataFrame, facts: DataFrame, key: list[str], total: int, how: str = "inner", size: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts`` (a written table of ``size`` rows, counted if not given; one row per key,
    ``__n`` rows of that key in ``rows``), without ``__n``.

    Few facts are sent to every task.  Of many, only those of keys with more than
    ``total`` / SENT_KEYS of the ``total`` rows are, of which there can't be more than
    SENT_KEYS; the others join by a shuffle, where no key has a large share.
    """
    plain = facts.drop("__n")
    if (facts.count() if size is None else size) <= SENT_KEYS:
        return rows.join(F.broadcast(plain), key, how)
    limit = max(FEW_ROWS, total // SENT_KEYS)
    if facts.agg(F.max("__n")).head()[0] <= limit:
        return rows.join(plain, key, how)
    hot = facts.where(F.col("__n") > limit).drop("__n")
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(facts.where(F.col("__n") <= limit).drop("__n"), key, how))


def parsed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes in a column each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(
    docs: DataFrame,
    fn: Callable[[list[bytes]], list],
    ddl: str,
    carry: tuple[str, ...] = ("doc_id",),
    size: int = SLICE_BYTES,
    done: Callable[[], None] | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """``carry`` columns of ``docs`` plus the columns ``ddl`` that ``fn`` makes of the texts.

    ``fn`` gets the UTF-8 bytes of whole texts (null: empty), about ``size`` bytes at
    once, then a list for each column of ``also``, and returns one list per new column.  ``done`` is called at the end of each task.
    """
    kept = [StructField("doc_id", LongType()) if c == "doc_id" else docs.schema[c] for c in carry]
    schema = StructType([*kept, *parsed(ddl)])
    arrow = to_arrow_schema(schema)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, n, size):
                    made = fn([x or b"" for x in part.column(n).to_pylist()], *(c.to_pylist() for c in part.columns[n + 1 :]))
                    new = [pa.array(x, type=t.type) for x, t in zip(made, list(arrow)[n:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], schema=arrow)
        finally:
            if done:
                done()

    chosen = [F.col("doc_id").cast("bigint").alias("doc_id") if c == "doc_id" else F.col(c) for c in carry]
    return docs.select(*chosen, F.col("text").cast("string").cast("binary").alias("__text"), *[F.col(c).alias(f"__also_{c}") for c in also]).mapInArrow(run, schema)


def training_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """The documents that at most ``limit`` labelled rows name, with the columns of ``labels``: those whose ids have the
    smallest hashes.  ``labels`` has doc_id (bigint) and small columns."""
    chosen = labels.where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), *labels.columns).limit(limit)
    named = [F.col(c).alias(c) for c in ("text", "n_chars")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *named).join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows


def bounded_features(rows: DataFrame, features: list[str], size: int, name: str) -> list:
    """``rows`` on the driver, sorted: a row for each combination of the columns other than ``features`` (binary; the
    smallest of a repeated id), in the order of the hashes of doc_id as far as their features have ``size`` bytes in all."""
    keys = [c for c in rows.columns if c not in features]
    made = written(rows.groupBy(*keys).agg(F.min(F.struct(*features)).alias("f")).select(*keys, "f.*"), name)
    order = [F.xxhash64("doc_id").alias("__h"), *keys]
    lengths = made.select(*order, sum((F.length(c) for c in features), F.lit(0)).alias("__size")).collect()  # as many numbers as labelled rows
    held, last = 0, None
    for r in sorted(lengths):
        held += r["__size"]
        if held > size:
            break
        last = r[:-1]
    if last is None:
        return []
    got = made.select(*order, *features).where(F.col("__h") <= last[0]).collect()
    return sorted((r for r in got if r[: len(order)] <= last), key=lambda r: r[1:])


def held_out(remainder: int) -> F.Column:
    """Whether crc32 of the doc_id as text, mod 5, is ``remainder`` (null ids: of the empty text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(5)) == remainder
