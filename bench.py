"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up and then a few times, to the end (every row and column is produced, into
Spark's no-op sink); its figure is the median. ``ns_per_row`` are nanoseconds per scanned row, as the
baseline counts, with the job's fixed costs in.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from quern import queries as engine
from quern.session import local

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
#: name: the table whose rows count
HEADLINE = {
    "scan_full": "lineitem", "cmp_eq": "lineitem", "cmp_gt": "lineitem", "and_or_not": "lineitem", "between": "lineitem", "in_int": "lineitem", "in_text": "orders", "like_contains": "part", "arith_mul_float": "lineitem",
    "arith_intdiv": "lineitem", "div_zero_guarded_or": "nation", "is_null": "orders", "three_valued_buckets": "orders", "count_matching": "lineitem", "ast_api": "lineitem", "fn_extract": "events", "fn_round": "customer",
    "fn_cast_decimal": "customer", "fn_trims": "part", "validate_literals": "orders", "flagship": "lineitem", "csv_source": "customer", "stream_select": "events",
}


def main() -> None:
    spark = local(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = engine.queries() | {"scan_full": lambda s, d: engine.table(s, d, "lineitem")}
    rows = {t: engine.table(spark, SF_DIR, t).count() for t in set(HEADLINE.values())}
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 4)
        print(name, seconds[name], file=sys.stderr)
    per_row = {n: round(1e9 * s / rows[HEADLINE[n]], 1) for n, s in seconds.items() if HEADLINE[n] != "nation"}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "ns_per_row": per_row, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
