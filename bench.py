"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query runs to the end
into a sink that discards rows. The stored experiment and split tables, which most queries read,
are timed as entries of their own.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from liftgrid.catalog import queries as catalog  # noqa: E402
from liftgrid.session import local_session  # noqa: E402

HEADLINES = (
    "ab_report",
    "balance_table",
    "quality_verdict",
    "sample_share",
    "split_summary",
    "scaled_features",
    "uplift_curve",
    "ranking_metrics",
    "uplift_at_k",
    "decile_table",
    "permutation_check",
    "bootstrap_interval_full",
    "bootstrap_means",
    "evaluation_report",
    "rank_agreement",
    "winsorize_report",
    "tail_diagnosis",
    "percentiles",
    "combined_report",
    "t_learner",
    "x_learner",
    "causal_forest",
    "dual_head",
    "placebo_test",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    def report(*stopped: object) -> None:
        """The JSON line; if the run is stopped from outside, of what has ended by then."""
        line = {
            "metric": "total_wall_seconds",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        }
        print(json.dumps(line | ({"complete": False} if stopped else {})), flush=True)
        if stopped:
            os._exit(1)

    signal.signal(signal.SIGTERM, report)

    timed("experiment_table", lambda: catalog.units(spark, folder))
    timed("split_tables", lambda: catalog.splits(spark, folder))
    for name in HEADLINES:
        if only and name not in only:
            continue
        query = catalog.ALL[name]
        timed(name, lambda: query(spark, folder).write.format("noop").mode("overwrite").save())
    report()
    spark.stop()


if __name__ == "__main__":
    main()
