"""Command line: ``insert``, ``populate``, ``vm``, ``dm``, ``vq``, ``statistics``, ``table`` and ``evaluate``.

    python -m versograph.cli insert PATH [-s STRATEGY PARAMETER] VERSION [+|- FILE...]...
    python -m versograph.cli populate PATH [-s STRATEGY PARAMETER] versions|changes FOLDER
    python -m versograph.cli vm PATH VERSION S P O [OFFSET]
    python -m versograph.cli dm PATH START END S P O [OFFSET]
    python -m versograph.cli vq PATH S P O [OFFSET]
    python -m versograph.cli statistics PATH NAME START END
    python -m versograph.cli table PATH
    python -m versograph.cli evaluate PATH QUERIES [REPLICATIONS]

``populate`` takes a folder of versions or of changes and prints version, changes, milliseconds and
bytes of the archive for each; ``table`` prints the statistics of every version against the one before.
``?`` stands for any term.  A file of queries has ``s p o [offset limit]`` per line.
"""

from __future__ import annotations

import statistics
import sys
import time

from pyspark.sql import SparkSession

from versograph.functions.stats import STATISTICS, consecutive_table
from versograph.operators.model import TriplePattern
from versograph.plans import strategy as strategies
from versograph.sources import layouts, ntriples
from versograph.sources.store import Archive

_TERM = rf"{ntriples._RESOURCE}|{ntriples._LITERAL}|\?\S*"


def signed_files(args: list[str]) -> list[tuple[str, str]]:
    """(sign, file): a sign holds for the files after it; + at first."""
    sign, out = "+", []
    for a in args:
        if a in "+-":
            sign = a
        else:
            out.append((sign, a))
    return out


def populate(spark: SparkSession, path: str, args: list[str]) -> int:
    strategy = None
    if args[:1] == ["-s"]:
        strategy, args = strategies.parse(args[1], args[2]), args[3:]
        if strategy is None:
            sys.exit("unknown strategy")
    archive = Archive.open(spark, path, strategy)
    print("Version,Changes,Milliseconds,Bytes")

    def done(version: int) -> None:
        row = archive.rows[-1]
        print(f"{version},{row['delta_size']},{row['ingest_ms']},{archive.size()}")

    layouts.populate(archive, args[1], args[0], done=done)
    return 0


def insert(spark: SparkSession, path: str, args: list[str]) -> int:
    strategy = None
    if args[:1] == ["-s"]:
        strategy, args = strategies.parse(args[1], args[2]), args[3:]
        if strategy is None:
            sys.exit("unknown strategy")
    archive = Archive.open(spark, path, strategy)
    version, files = int(args[0]), signed_files(args[1:])
    if not archive.rows and any(s == "-" for s, _ in files):
        return 1
    return 0 if archive.append(ntriples.read_signed(spark, files), version, check_uniqueness=False) else 1


def parse_query(line: str) -> tuple[TriplePattern, int, int | None] | None:
    """A pattern with offset and limit; terms may be quoted literals with spaces, or bare words."""
    import re

    parts = re.findall(rf"{_TERM}|\S+", line.strip())
    if len(parts) < 3:
        return None
    numbers = [int(x) for x in parts[3:5]]
    limit = numbers[1] if len(numbers) > 1 and numbers[1] != -2 else None
    return TriplePattern(*parts[:3]), numbers[0] if numbers else 0, limit


def evaluate(archive: Archive, queries: list[str], replications: int = 5) -> list[dict]:
    """Median milliseconds of each query atom over all versions, after one run that doesn't count."""
    out, last = [], archive.max_version()
    for line in queries:
        if (parsed := parse_query(line)) is None:
            continue
        m, offset, limit = parsed
        runs = [("vm", v, lambda v=v: archive.vm(v, m, offset, limit)) for v in range(last + 1)]
        runs += [("dm", v, lambda v=v: archive.dm(0, v, m, offset, limit)) for v in range(1, last + 1)]
        runs.append(("vq", last, lambda: archive.vq(m, offset, limit)))
        counts = [("vm_count", v, lambda v=v: archive.vm_count(v, m)) for v in range(last + 1)]
        counts += [("dm_count", v, lambda v=v: archive.dm_count(0, v, m)) for v in range(1, last + 1)]
        counts.append(("vq_count", last, lambda: archive.vq_count(m)))
        for kind, version, make in runs + counts:
            count = (lambda make=make: make()[0]) if kind.endswith("count") else (lambda make=make: make().count())
            rows, spent = count(), []
            for _ in range(replications):
                began = time.perf_counter()
                count()
                spent.append((time.perf_counter() - began) * 1000)
            out.append({"query": line.strip(), "kind": kind, "version": version, "rows": rows, "median_ms": statistics.median(spent)})
    return out


def run(spark: SparkSession, argv: list[str]) -> int:
    command, path, *rest = argv
    if command == "insert":
        return insert(spark, path, rest)
    if command == "populate":
        return populate(spark, path, rest)
    archive = Archive.open(spark, path, read_only=True)
    numbers = {"vm": 1, "dm": 2, "vq": 0}
    if command in numbers:
        k = numbers[command]
        m, offset = TriplePattern(*rest[k : k + 3]), int(rest[k + 3]) if len(rest) > k + 3 else 0
        versions = [int(x) for x in rest[:k]]
        rows = getattr(archive, command)(*versions, m, offset)
        shown = {"vm": ntriples.show_triples, "dm": ntriples.show_delta, "vq": ntriples.show_versions}[command](rows)
        for r in shown.toLocalIterator():
            print(r.line)
    elif command == "statistics":
        name, i, j = rest
        print(STATISTICS[name](archive.presence(), int(i), int(j)).head()["value"])
    elif command == "table":
        table = consecutive_table(archive.log(), archive.presence(), archive.max_version()).orderBy("version")
        print(",".join(table.columns))
        for r in table.collect():  # a row per version
            print(",".join(str(x) for x in r))
    elif command == "evaluate":
        lines = [r.value for r in spark.read.text(rest[0]).toLocalIterator()]
        for r in evaluate(archive, lines, int(rest[1]) if len(rest) > 1 else 5):
            print(",".join(str(x) for x in r.values()))
    else:
        print(__doc__)
        return 2
    return 0


def main() -> None:
    if len(sys.argv) < 3:
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("versograph").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
