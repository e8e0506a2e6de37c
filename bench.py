"""Times ingest and the headline queries over an archive on disk and prints one JSON line.

The archive is made of the tables at $BENCH_SF_DIR, on local[$BENCH_CPUS]; nothing is
cached, so each query lists, prunes and reads files.  Median of $BENCH_RUNS runs, 5 if not
given, after one that doesn't count.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])


def main() -> None:
    from pyspark.sql import SparkSession

    from versograph.plans.fixtures import LAST_ORDERS, ingest_orders

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-archive-")
    try:
        ends = [time.perf_counter()]
        archive = ingest_orders(spark, sf_dir, folder, done=lambda v: ends.append(time.perf_counter()))
        ingest = {f"ingest_v{v}": round(b - a, 4) for v, (a, b) in enumerate(zip(ends, ends[1:], strict=False))}
        measure(archive, ingest, sf_dir, cpus, runs, LAST_ORDERS)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()


def measure(archive, seconds: dict[str, float], sf_dir: str, cpus: str, runs: int, last: int) -> None:
    changes, ingest = sum(r["delta_size"] or r["version_size"] for r in archive.rows), sum(seconds.values())
    s, p, o = "ex:order/10", "ex:status", "F"
    shapes = {"spo": (s, p, o), "sp": (s, p, None), "so": (s, None, o), "s": (s, None, None), "po": (None, p, o), "p": (None, p, None), "o": (None, None, o), "all": ()}
    made = {}
    for name, m in shapes.items():
        for v in (0, 3, last):
            made[f"vm_{name}_v{v}"] = lambda m=m, v=v: archive.vm(v, m)
        made[f"vm_{name}_offset"] = lambda m=m: archive.vm(3, m, offset=100, limit=100)
        made[f"dm_{name}"] = lambda m=m: archive.dm(1, 5, m)
        made[f"vq_{name}"] = lambda m=m: archive.vq(m)
    made["vm_hybrid_all"] = lambda: archive.vm_hybrid(5)
    for name, make in made.items():
        make().write.format("noop").mode("overwrite").save()
        spent = []
        for _ in range(runs):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(spent), 4)
    print(json.dumps({
        "metric": "total seconds of all queries, median of runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "changes": changes, "changes_per_s": round(changes / ingest), "bytes": archive.size(), "runs": runs, "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
