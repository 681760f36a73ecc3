"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quillog.plans import registry
from quillog.session import local_session

HEADLINE = (
    "flagship_policy_panel", "join_feature_table", "split_chrono_70_15_15", "win_tendency_encoder", "win_history_encoder", "win_opportunity_profile", "prob_softmax", "prob_baseline_history",
    "rank_panel", "style_cells", "qual_summary", "boot_paired_game", "ml_listwise_objective", "st_player_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    queries = registry.queries()
    queries["prob_uniform"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up isn't part of any query
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
