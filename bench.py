"""Time the headline queries: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores).

Prints one JSON line. Each query is built and fully collected; the first, untimed query warms up the
JVM. Nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import time

from tillwright.catalog import MODELS, REPORTS
from tillwright.session import local_session
from tillwright.sources.star import StarSales

# Every report, and of the fitted models those that another query does not fit again.
HEADLINES = (*REPORTS, "fc_metrics", "fc_metrics_category", "fc_importance")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", **{"spark.ui.showConsoleProgress": "false"})
    plans = {**REPORTS, **MODELS}
    plans["category_revenue"](StarSales(spark, sf_dir)).collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        plans[name](StarSales(spark, sf_dir)).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    report = {"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": seconds}
    print(json.dumps({**report, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
