"""Time the headline queries: one JSON line with seconds per query and in total.

Each query's full result is computed and thrown away by the no-op sink. Every query runs once to
load and compile code and once for the clock; the first runs are reported apart.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialweave.catalogue import QUERIES  # noqa: E402
from trialweave.session import local_session  # noqa: E402

HEADLINE = (
    "worklist_counts", "worklist_cells", "round_diff", "cell_diff_verdicts", "cell_diff_updates",
    "link_master", "link_integrity", "link_multiway", "link_fuzzy_topn", "title_matches",
    "returned_audit", "translate_cells", "verify_live", "table1_by_site", "missingness_profile",
    "group_quartiles", "queue_diff", "hidden_values", "dictionary_lint", "last_wins",
    "target_numbers", "eav_roundtrip", "classify_text", "change_summary", "fingerprint",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold, seconds = {}, {}
    for name in (only.split(",") if only else HEADLINE):
        cold[name], seconds[name] = timed(name), timed(name)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "cold_queries": cold,
        "cold_total": round(sum(cold.values()), 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
