"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1) names the tables, BENCH_CPUS the local cores.
Each query runs once to warm up code generation and file caches, then
BENCH_REPEATS times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.checks.queries import REGISTERED  # noqa: E402
from tidemark.session import session_builder  # noqa: E402

HEADLINE = (
    "scan_text_roundtrip",
    "clean_required",
    "features_batch",
    "stratified_split",
    "class_weights",
    "confusion",
    "evaluate_scores",
    "auc_roc",
    "dense_row_id",
    "replay_slots",
    "replay_messages",
    "bootstrap_join",
    "bootstrap_cells",
    "ab_test",
    "prediction_envelope",
    "register_alias",
    "promote_alias",
    "run_log_pivot",
    "stream_scored",
    "score_forest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    builder = session_builder("tidemark-bench").master(f"local[{cpus}]")
    conf = {"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        # the sink takes every row and column, so nothing is optimised away
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        timed(name)
        seconds[name] = round(min(timed(name) for _ in range(repeats)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
