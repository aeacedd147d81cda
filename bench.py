"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tallyline.operators import extraction as ex
from tallyline.plans.corpus import utterances
from tallyline.plans.queries import QUERIES
from tallyline.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["obs_scan", "counts_rollup", "stock_by_location", "push_batches", "time_per_item",
            "merge_upsert", "corr_latest", "correction_rate", "latency_alert", "num_words",
            "corrections_inline", "commands", "resolve_exact", "resolve_fuzzy",
            "vad_segments"]


def main() -> None:
    spark = local_session(CPUS, int(CPUS), "16g")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    said = utterances(spark, SF_DIR)
    n = said.count()
    start = time.time()
    ex.extract(said).write.format("noop").mode("overwrite").save()
    rate = n / (time.time() - start)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cores": CPUS,
        "utterances_per_second": round(rate),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
