"""Time the queries of the detection operators: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose data and cores.
Each query runs once unmeasured, then its best of two runs counts; results go to a no-op sink,
so every row and column is computed and none reaches the driver.
"""

import json
import os
import sys
import time

from rivertrack.session import local_session, shared_dir
from rivertrack.workload.queries import QUERIES

def run(spark, name, sf_dir) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = sys.argv[1:] or sorted(QUERIES)
    spark = local_session(cpus, "bench", partitions=cpus)
    shared_dir(spark)
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
