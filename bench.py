"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from clickpath.plans.queries import REGISTRY
from clickpath.runtime import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# one query per group of operators; BENCH_QUERIES="all" times every key
HEADLINE = """scan_impressions keyword_full_join user_histories users_without_rare_domains dwell_time sessionize
session_summary sessions_bounded flat_sessions collapse_runs run_keyword_mean session_vector item_cooccurrence item_knn
session_popular_scores session_vector_scores eval_popular eval_session_popular eval_knn eval_by_position loss_bpr_max
negative_samples training_examples""".split()


def main() -> None:
    spark = local_session(CPUS)
    # the first job of a session pays for class loading, not for the query
    REGISTRY["hour_of_day"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    names = list(REGISTRY) if chosen == ["all"] else chosen or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall-clock of the timed queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
