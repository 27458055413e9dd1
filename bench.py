"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each
query runs once to warm up and then BENCH_RUNS times into a no-op sink; the
median counts.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from tidemark.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = ("n2_fill_previous", "n4_collapse_duplicates", "l3_moving_average", "l9_fit_forecaster", "t19_bootstrap_t_test",
            "a3_residual_rounds", "a4_beta_params", "a5_beta_score", "i2_fit_iforest_sampled", "i3_score_iforest",
            "i5_label_iforest", "b3_fit_linear", "b3_fit_piecewise", "b5_label_band", "e1_join_models", "r2_timeline",
            "g6_objective_iforest", "x4_detect_moving_average", "x4_detect")


def timed(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__sql__shuffle__partitions=cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf)
        seconds[name] = round(statistics.median(timed(spark, name, sf) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
