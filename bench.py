"""Times of the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quernstone.queries import QUERIES

HEADLINE = (
    "hourly_rollup", "topk_customers", "filter_project_coerce", "ucount_exact", "ucount_multi", "weighted_ucount", "ucount_hll", "ntile_by_group", "ntile_weighted", "ntile_merge",
    "hist_fixed", "hist_dynamic", "hist_shared_range", "bins_explicit", "unpivot_fields", "local_over_global", "tagset_explode", "stratified_rates", "version_format",
    "summary_requery", "summary_merge", "summary_hour_split",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles code
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
