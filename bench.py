"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ["reduce_mean_dim", "moving_average_odd", "moving_average_even", "anomaly", "diurnal_cycle", "quantiles_uniform", "quantiles_ranked", "lookup_nearest", "interp_linear", "bias_correct", "wind_speed_mean", "factor_separation", "regrid_affine", "overlap_blend_triangle", "group_complete", "skip_existing", "pack_unpack", "pandas_apply"]


def main() -> None:
    import cubeloom.queries as q

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            t = time.perf_counter()
            q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "sum of the median times of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
