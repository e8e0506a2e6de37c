"""A persistent archive: one folder that Spark reads and writes, on any file system.

* ``log/version=<v>/gen=<n>``: the changes that took effect at each version;
* ``closed/v_to=<v>/gen=<n>``: intervals that ended at a version;
* ``open/bucket=<b>/gen=<n>``: triples that hold at the last version, by the hash of the subject;
* ``snapshots/version=<v>/gen=<n>``: versions that the strategy chose to materialise;
* ``manifest/gen=<n>``: a row per version with the sizes that strategies look at, the
  generation that wrote its folders, and the generation of each bucket.

Every write has a generation of its own and puts its files beside those of earlier
ones.  A reader takes the newest whole manifest, which is written last, and reads only
the generations that it names: a write that fails at any point leaves the archive as it
was.  An append rewrites the buckets that its changes fall into, and no other; a whole
history is loaded at once, so that no triple is written anew for each version.  A look
at one subject reads one bucket; a look at one object skips the row groups whose filter
or dictionary lacks it.  One writer at a time.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable
from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versograph.operators import chain as hybrid
from versograph.operators import lookup
from versograph.operators import query as q
from versograph.operators.log import intervals, last_write_wins, net, normalise
from versograph.operators.model import OPEN, TRIPLE, TRIPLE_DDL, TriplePattern
from versograph.plans.strategy import Chain, Strategy, Version, never

_META = "version int, snapshot_id int, is_snapshot boolean, delta_size bigint, agg_delta_size bigint, version_size bigint, change_ratio double, local_change_ratio double, ingest_ms bigint, snapshot_size bigint, generation int, buckets array<int>"
#: Folders of a version and the names of their parts.
_FOLDERS = {"log": "version", "closed": "v_to", "snapshots": "version"}
#: A filter of the objects in each row group, as large as they need; none is written where a dictionary of them is.
_OBJECTS = {"parquet.bloom.filter.enabled#o": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Rows that a task of a load sorts and writes, about.
_TASK_ROWS = 1_500_000


class Archive:
    def __init__(self, spark: SparkSession, path: str, strategy: Strategy | None = None, read_only: bool = False, progress: Callable[[str, int], None] | None = None, buckets: int = 64):
        """``progress`` is called with the name of a section of the work and how much of it is done, in percent.

        ``buckets`` holds for a new archive; choose it so that a bucket of the last version has some GB at most.
        """
        self.progress = progress or (lambda section, percent: None)
        self.spark, self.path, self.strategy, self.read_only = spark, path.rstrip("/"), strategy or never(), read_only
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._exists("") and not self._fs.getFileStatus(self._at("")).isDirectory():
            raise NotADirectoryError(path)
        self.generation = next((g for g in reversed(self._numbers("manifest")) if self._exists(f"manifest/gen={g}/_SUCCESS")), -1)
        self.rows = [r.asDict() for r in spark.read.schema(_META).parquet(f"{self.path}/manifest/gen={self.generation}").collect()] if self.generation >= 0 else []
        self.rows.sort(key=lambda r: r["version"])
        self.buckets = self.rows[-1]["buckets"] if self.rows else [-1] * buckets

    @classmethod
    def open(cls, spark: SparkSession, path: str, strategy: Strategy | None = None, read_only: bool = False, progress: Callable[[str, int], None] | None = None, buckets: int = 64) -> Archive:
        return cls(spark, path, strategy, read_only, progress, buckets)

    # --- files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def _numbers(self, name: str) -> list[int]:
        """The numbers in the names ``key=<number>`` of a folder's parts."""
        if not self._exists(name):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(name))]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def _read(self, name: str, ddl: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")

    def size(self) -> int:
        """Bytes of all files."""
        return self._fs.getContentSummary(self._at("")).getLength() if self._exists("") else 0

    def cleanup(self) -> None:
        """Deletes the archive."""
        self._writable()
        self._fs.delete(self._at(""), True)
        self.generation, self.rows, self.buckets = -1, [], [-1] * len(self.buckets)

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"{self.path} is open for reading only")

    # --- what it holds

    def max_version(self) -> int:
        """The last version, -1 if there is none."""
        return self.rows[-1]["version"] if self.rows else -1

    def snapshots(self) -> list[int]:
        return [r["version"] for r in self.rows if r["is_snapshot"]]

    def version_meta(self) -> DataFrame:
        return self._manifest().drop("generation", "buckets")

    def _manifest(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in _META.split(", ")) for r in self.rows], _META)

    def _row(self, version: int) -> dict | None:
        return next((r for r in self.rows if r["version"] == version), None)

    def _versions(self, name: str, ddl: str) -> DataFrame:
        """A folder's rows of all versions, of the generations in the manifest; a condition on the folders alone, so the rest isn't read."""
        key = _FOLDERS[name]
        rows = self._read(name, f"{ddl}, {key} int, gen int")
        if not self.rows:
            return rows.where(F.lit(False))
        known = F.create_map(*[F.lit(x) for r in self.rows for x in (r["version"], r["generation"])])
        return rows.where(known[F.col(key)] == F.col("gen"))

    def _version(self, name: str, version: int, ddl: str) -> DataFrame:
        row = self._row(version)
        return self._read(f"{name}/{_FOLDERS[name]}={version}/gen={row['generation']}", ddl) if row else self.spark.createDataFrame([], ddl)

    def log(self) -> DataFrame:
        return self._versions("log", f"{TRIPLE_DDL}, op int").select("version", *TRIPLE, "op")

    def presence(self, match: TriplePattern | tuple | None = None) -> DataFrame:
        """The intervals, without some that can't match."""
        closed = self._versions("closed", f"{TRIPLE_DDL}, v_from int")
        return closed.select(*TRIPLE, "v_from", "v_to").unionByName(self._open(match).withColumn("v_to", F.lit(OPEN)))

    def _bucket(self, subject: Column) -> Column:
        return F.pmod(F.xxhash64(subject), F.lit(len(self.buckets))).cast("int")

    def _open(self, match: TriplePattern | tuple | None = None, buckets: list[int] | None = None) -> DataFrame:
        rows = self._read("open", f"{TRIPLE_DDL}, v_from int, bucket int, gen int")
        rows = rows.where(F.array(*map(F.lit, self.buckets))[F.col("bucket")] == F.col("gen"))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        subject = hybrid.pattern(match).bound().get("s")
        if subject is not None:
            rows = rows.where(F.col("bucket") == self._bucket(F.lit(subject)))
        return rows.select(*TRIPLE, "v_from")

    def snapshot(self, version: int) -> DataFrame:
        return self._version("snapshots", version, TRIPLE_DDL)

    # --- queries

    def vm(self, version: int, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None, order: str = "canonical") -> DataFrame:
        """Versions beyond the last are as the last; before the first there is nothing.

        Read from the snapshot and its chain if these have fewer rows, by the manifest,
        than the intervals; ``order='chain'`` gives the snapshot's triples first.
        """
        version = min(version, self.max_version())
        start = q.routed(self.snapshots(), version)
        if order == "chain" and start >= 0:
            return q.vm_in_chain_order(self.presence(match), version, start, match, offset, limit)
        if start >= 0 and self._chain_rows(start, version) < self._interval_rows(version):
            return q.page(self.vm_hybrid(version, match), TRIPLE, offset, limit)
        return q.vm(self.presence(match), version, match, offset, limit)

    def _chain_rows(self, start: int, version: int) -> int:
        """Rows of a snapshot and of the changes after it up to a version."""
        return sum(r["version_size"] if r["version"] == start else r["delta_size"] for r in self.rows if start <= r["version"] <= version)

    def _interval_rows(self, version: int) -> int:
        """Rows that a look at the intervals reads at least: the open ones and those that ended after the version."""
        return self.rows[-1]["version_size"] + sum(r["delta_size"] for r in self.rows if r["version"] > version) // 2

    def vm_hybrid(self, version: int, match: TriplePattern | tuple | None = None) -> DataFrame:
        version = min(version, self.max_version())
        start = q.routed(self.snapshots(), version)
        if start < 0:
            return self.spark.createDataFrame([], TRIPLE_DDL)
        return hybrid.vm_hybrid(self.snapshot(start), self.log(), start, version, match)

    def vm_count(self, version: int, match: TriplePattern | tuple | None = None, estimate: bool = False) -> tuple[int, str]:
        """An estimate comes from the manifest if the pattern is unbounded, else from the snapshot's matches and the changes since."""
        row = next((r for r in reversed(self.rows) if r["version"] <= version), None)
        if estimate and row and not hybrid.pattern(match).bound():
            return row["version_size"], q.EXACT
        start = q.routed(self.snapshots(), min(version, self.max_version()))
        if estimate and start >= 0:
            return tuple(lookup.vm_estimate(self.log(), self.snapshot(start), start, min(version, self.max_version()), match).head())
        return self.vm(version, match).count(), q.EXACT

    def dm(self, start: int, end: int, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None, plain_diff: bool = False) -> DataFrame:
        """From the log between the two versions, which is all it reads; ``plain_diff`` compares the whole versions."""
        end = min(end, self.max_version())
        m = hybrid.pattern(match)
        if end <= start or start < min(self.snapshots(), default=0):
            return self.spark.createDataFrame([], f"{TRIPLE_DDL}, addition boolean")
        rows = q.dm_plain(self.presence(m), start, end, m) if plain_diff else hybrid.dm_hybrid(self.log(), start, end, m)
        return q.page(rows, m.order(), offset, limit)

    def dm_count(self, start: int, end: int, match: TriplePattern | tuple | None = None, estimate: bool = False) -> tuple[int, str]:
        if estimate:
            return tuple(q.dm_estimate(self.presence(match), start, min(end, self.max_version()), self.snapshots(), match).head())
        return self.dm(start, end, match).count(), q.EXACT

    def vq(self, match: TriplePattern | tuple | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
        return q.vq(self.presence(match), self.max_version(), match, offset, limit)

    def vq_count(self, match: TriplePattern | tuple | None = None, estimate: bool = False) -> tuple[int, str]:
        if estimate:
            return tuple(lookup.vq_estimate(self.presence(match), self.snapshots(), match).head())
        return q.vq_count(self.presence(match), match).head()["n"], q.EXACT

    # --- writing

    def ingest(self, version: int, additions: DataFrame | None = None, deletions: DataFrame | None = None) -> bool:
        """A version from triples to add and to delete; the first version takes additions only."""
        if not self.rows and deletions is not None and not deletions.isEmpty():
            return False
        ddl = f"{TRIPLE_DDL}, op int, seq int"
        parts = [d.select(*TRIPLE, F.lit(op).alias("op"), F.lit(k).alias("seq")) for k, (d, op) in enumerate(((deletions, -1), (additions, 1))) if d is not None]
        changes = self.spark.createDataFrame([], ddl)
        for p in parts:
            changes = changes.unionByName(p)
        return self.append(changes, version, check_uniqueness=False)

    def append(self, changes: DataFrame, version: int, check_uniqueness: bool = True) -> bool:
        """Adds a change set (s, p, o, op and perhaps seq) to the last version or a later one.

        Changes without effect are dropped.  With ``check_uniqueness``, a set that names
        a triple which the version already changed is refused as a whole.
        """
        self._writable()
        began = clock.time()
        if version < self.max_version():
            raise ValueError(f"version {version} comes before the last, {self.max_version()}")
        again = version == self.max_version()
        changes = last_write_wins(changes).withColumn("__bucket", self._bucket(F.col("s"))).persist()
        try:
            old_log = self._version("log", version, f"{TRIPLE_DDL}, op int")
            if check_uniqueness and again and not changes.join(old_log, TRIPLE, "left_semi").isEmpty():
                return False
            self.progress("open triples", 0)
            generation = max(self.generation, *self._numbers("attempts"), -1) + 1
            self._fs.mkdirs(self._at(f"attempts/gen={generation}"))  # so no other write takes this number
            touched = sorted(r[0] for r in changes.select("__bucket").distinct().collect())  # as many as buckets at most
            now, closed = self._open(buckets=touched), self._version("closed", version, f"{TRIPLE_DDL}, v_from int")
            plus, minus = changes.where("op = 1").select(*TRIPLE), changes.where("op = -1").select(*TRIPLE)
            new = plus.join(now, TRIPLE, "left_anti")
            back = closed.join(new, TRIPLE, "left_semi")
            open_now = now.join(minus, TRIPLE, "left_anti").unionByName(back).unionByName(new.join(closed, TRIPLE, "left_anti").withColumn("v_from", F.lit(version)))
            open_now = open_now.withColumn("bucket", self._bucket(F.col("s"))).withColumn("gen", F.lit(generation)).hint("rebalance", "bucket")
            if touched:
                open_now.sortWithinPartitions("bucket", "p", "o", "s").write.options(**_OBJECTS).partitionBy("bucket", "gen").mode("append").parquet(f"{self.path}/open")
            self.progress("change set", 40)
            closed_now = closed.join(new, TRIPLE, "left_anti").unionByName(now.join(minus, TRIPLE, "left_semi").where(F.col("v_from") < version))
            self._put("closed", version, generation, closed_now)
            before, self.buckets = self.buckets, [generation if b in touched else g for b, g in enumerate(self.buckets)]
            try:
                added = self._open(buckets=touched).where(F.col("v_from") == version).select(*TRIPLE)
                kept = old_log.where((F.col("op") == 1) & ~self._bucket(F.col("s")).isin(touched)).select(*TRIPLE)
                gone = self._read(f"closed/v_to={version}/gen={generation}", TRIPLE_DDL)
                self._put("log", version, generation, gone.withColumn("op", F.lit(-1)).unionByName(added.unionByName(kept).withColumn("op", F.lit(1))))
                self.progress("manifest", 80)
                self._note(version, generation, began)
            except BaseException:
                self.buckets = before
                raise
        finally:
            changes.unpersist()
        self._clean(version, generation, touched, before)
        self.progress("done", 100)
        return True

    def load(self, log: DataFrame, versions: list[int]) -> None:
        """A new archive from a whole log (version, s, p, o, op): what appends of its changes at ``versions``, one by one, would make.

        The intervals are made once, with one shuffle at most, and kept on the executors'
        disks; every folder is written from them.  ``ingest_ms`` is 0.
        """
        self._writable()
        versions = sorted(set(versions))
        if self.rows or not versions or versions[0] < 0:
            raise ValueError("a load takes a new archive and versions from 0 on")
        generation = max(self.generation, *self._numbers("attempts"), -1) + 1
        self._fs.mkdirs(self._at(f"attempts/gen={generation}"))
        spans = intervals(normalise(log.where(F.col("version").isin(versions)))).persist(StorageLevel.DISK_ONLY)
        try:
            self.progress("sizes", 0)
            moves = self._moves(spans, versions[0])
            size = moves.get(versions[0], (0, 0, 0))[0]
            self.progress("change sets", 20)
            n = {v: m[0] for v, m in moves.items()}
            ends = F.array(F.struct(F.col("v_from").alias("version"), F.lit(1).alias("op")), F.struct(F.col("v_to").alias("version"), F.lit(-1).alias("op")))
            self._fill("log", spans.select(*TRIPLE, F.explode(ends).alias("c")).where(F.col("c.version") != OPEN).select(*TRIPLE, "c.op", "c.version"), generation, sum(n.values()))
            self.progress("intervals", 40)
            self._fill("closed", spans.where(F.col("v_to") != OPEN), generation, sum(n.values()) // 2)
            rows = spans.where(F.col("v_to") == OPEN).select(*TRIPLE, "v_from").withColumn("bucket", self._bucket(F.col("s")))
            self._fill("open", rows, generation, sum(n.values()))
            self.progress("manifest", 80)
            row = asdict(Version(versions[0], size, 0, size)) | {"snapshot_id": versions[0], "is_snapshot": True, "snapshot_size": size}
            made, chain, start = [row], Chain(versions[0], size), versions[0]
            for v in versions[1:]:
                if start != chain.snapshot:
                    start, moves = chain.snapshot, self._moves(spans, chain.snapshot)
                upto = [m for k, m in moves.items() if start < k <= v]
                added = chain.add(v, n.get(v, 0), sum(m[1] for m in upto), sum(m[2] for m in upto))
                snap = self.strategy(chain)
                made.append(asdict(added) | {"snapshot_id": v if snap else start, "is_snapshot": snap, "snapshot_size": added.version_size if snap else chain.snapshot_size})
                chain = Chain(v, added.version_size) if snap else chain
            held = [F.when(q.holds(r["version"]), F.lit(r["version"])) for r in made if r["is_snapshot"]]
            self._fill("snapshots", spans.select(*TRIPLE, F.explode(F.array_compact(F.array(*held))).alias("version")), generation, sum(r["version_size"] for r in made if r["is_snapshot"]))
            buckets = [generation] * len(self.buckets)
            old, self.rows = self.rows, [r | {"generation": generation, "buckets": None} for r in made]
            self.rows[-1]["buckets"] = buckets
            try:
                self._manifest().coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/manifest/gen={generation}")
            except BaseException:
                self.rows = old
                raise
            self.generation, self.buckets = generation, buckets
        finally:
            spans.unpersist()
        if len(self._numbers("attempts")) > 1:  # of loads that failed
            self._sweep({f"open/bucket={b}": {generation} for b in range(len(buckets))} | {f"{name}/{key}={v}": {generation} for name, key in _FOLDERS.items() for v in versions} | {"manifest": {generation}, "attempts": {generation}})
        self.progress("done", 100)

    @staticmethod
    def _moves(spans: DataFrame, start: int) -> dict[int, tuple[int, int, int]]:
        """By version from ``start`` on: the number of changes (at ``start``: of triples that hold), and what they add to, and take from, the triples of ``start``."""
        base = F.max(q.holds(start)).over(Window.partitionBy(*TRIPLE))
        ends = F.array(F.struct(F.greatest("v_from", F.lit(start)).alias("version"), F.lit(1).alias("op")), F.struct(F.col("v_to").alias("version"), F.lit(-1).alias("op")))
        rows = spans.where(F.col("v_to") > start).select(base.alias("base"), F.explode(ends).alias("c")).groupBy("base", "c.version", "c.op").agg(F.count(F.lit(1)).alias("n")).collect()  # a few rows per version
        out: dict[int, tuple[int, int, int]] = {}
        for r in rows:
            if r["version"] != OPEN:
                n, a, d = out.get(r["version"], (0, 0, 0))
                out[r["version"]] = (n + r["n"], a + (0 if r["base"] else r["op"] * r["n"]), d - (r["op"] * r["n"] if r["base"] else 0))
        return out

    def _fill(self, name: str, rows: DataFrame, generation: int, n: int) -> None:
        """Writes all parts of a folder at once; ``n``: about how many rows there are."""
        key, order = _FOLDERS.get(name, "bucket"), ["p", "o", "s"] if name == "open" else TRIPLE
        tasks = max(n // _TASK_ROWS, self.spark.sparkContext.defaultParallelism)
        rows = rows.coalesce(tasks).withColumn("gen", F.lit(generation))
        rows.sortWithinPartitions(key, "gen", *order).write.options(**_OBJECTS).partitionBy(key, "gen").mode("append").parquet(f"{self.path}/{name}")

    def _put(self, name: str, version: int, generation: int, rows: DataFrame) -> None:
        rows.hint("rebalance").sortWithinPartitions(*TRIPLE).write.options(**_OBJECTS).parquet(f"{self.path}/{name}/{_FOLDERS[name]}={version}/gen={generation}")

    def _clean(self, version: int, generation: int, touched: list[int], before: list[int]) -> None:
        """Deletes what this write replaced or found left of failed ones, but for what a reader of the manifest before may still read."""
        keep = {f"open/bucket={b}": {self.buckets[b], before[b]} for b in touched}
        keep |= {f"{name}/{key}={version}": {generation, self._previous} for name, key in _FOLDERS.items()}
        keep |= {"manifest": {generation, *[g for g in self._numbers("manifest") if g < generation][-1:]}, "attempts": {generation}}
        self._sweep(keep)

    def _sweep(self, keep: dict[str, set[int]]) -> None:
        for name, stay in keep.items():
            for g in self._numbers(name):
                if g not in stay:
                    self._fs.delete(self._at(f"{name}/gen={g}"), True)

    def _chain(self, rows: list[dict]) -> Chain:
        start = max((i for i, r in enumerate(rows) if r["is_snapshot"]), default=0)
        c = Chain(rows[start]["version"], rows[start]["version_size"])
        names = list(asdict(Version(0)))
        c.versions = [Version(**{k: r[k] for k in names}) for r in rows[start + 1 :]]
        return c

    def _note(self, version: int, generation: int, began: float) -> None:
        """The manifest with a row for the version.  Its sizes come from the changes, no triple of another version is counted anew."""
        old, earlier = self.rows, [r for r in self.rows if r["version"] != version]
        sizes = lambda rows: [x or 0 for x in rows.agg(F.sum((F.col("op") == 1).cast("int")), F.sum((F.col("op") == -1).cast("int"))).head()]
        added, deleted = sizes(self._read(f"log/version={version}/gen={generation}", "op int"))
        now = (earlier[-1]["version_size"] if earlier else 0) + added - deleted
        self.rows = [*earlier, {"version": version, "generation": generation}]
        try:
            if not earlier:
                row = asdict(Version(version, now, 0, now, 0.0, 0.0, int((clock.time() - began) * 1000))) | {"snapshot_id": version, "is_snapshot": True, "snapshot_size": now}
            else:
                c = self._chain(earlier)
                v = c.add(version, added + deleted, *sizes(net(self.log(), c.snapshot, version)), int((clock.time() - began) * 1000))
                snap = self.strategy(c)
                row = asdict(v) | {"snapshot_id": version if snap else c.snapshot, "is_snapshot": snap, "snapshot_size": v.version_size if snap else c.snapshot_size}
            if row["is_snapshot"]:
                self._put("snapshots", version, generation, self._open().select(*TRIPLE))
            self.rows = [*[r | {"buckets": None} for r in earlier], row | {"generation": generation, "buckets": self.buckets}]
            self._manifest().coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/manifest/gen={generation}")
        except BaseException:
            self.rows = old
            raise
        self._previous = next((r["generation"] for r in old if r["version"] == version), generation)
        self.generation = generation

    # --- builders

    def new_patch(self, version: int | None = None) -> PatchBuilder:
        return PatchBuilder(self, self.max_version() + 1 if version is None else version)


class PatchBuilder:
    """Collects a small change set by hand: ``addition``, ``deletion`` or ``triple``, then ``commit``."""

    def __init__(self, archive: Archive, version: int):
        self.archive, self.version, self.rows = archive, version, []

    def patch_id(self, version: int) -> PatchBuilder:
        self.version = version
        return self

    def triple(self, s: str, p: str, o: str, addition: bool = True) -> PatchBuilder:
        self.rows.append((s, p, o, 1 if addition else -1, len(self.rows)))
        return self

    def addition(self, s: str, p: str, o: str) -> PatchBuilder:
        return self.triple(s, p, o, True)

    def deletion(self, s: str, p: str, o: str) -> PatchBuilder:
        return self.triple(s, p, o, False)

    def commit(self, check_uniqueness: bool = False) -> bool:
        changes = self.archive.spark.createDataFrame(self.rows, f"{TRIPLE_DDL}, op int, seq int")
        return self.archive.append(changes, self.version, check_uniqueness)
