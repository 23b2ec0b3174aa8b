"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the tables   (default /root/testdata/sf0.1)
BENCH_CPUS     executor threads         (default 8)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from blockledger.session import local_session  # noqa: E402
from blockledger.workload.fixtures import STORED, Tables  # noqa: E402
from blockledger.workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "reconcile",
    "gc",
    "gc_by_id",
    "restore_candidates",
    "dedupe",
    "drop_ignored",
    "has_block",
    "half_uploads",
    "to_validate",
    "replica_lookup",
    "assign_batches",
    "elect_owner",
    "pick_replica",
    "coalesce_requests",
    "queue_depth",
    "throughput",
    "checksum_meta",
    "backup_payload",
    "parse_keys",
    "sort_inventory",
    "block_check",
    "gc_run",
    "restore_run",
    "converge",
    "stream_backup_requests",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus))
    run = lambda name: QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    for name in STORED:  # the inventories are tables of their own: they are written before the clock starts
        getattr(Tables(spark, folder), name)()
    fixtures = round(time.perf_counter() - start, 3)
    run("reconcile")  # starts the JVM's compilers and the Python workers' parent
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": scale, "fixtures": fixtures}))


if __name__ == "__main__":
    main()
