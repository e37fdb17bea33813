"""Times the headline queries and prints one line of JSON."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from strideline.plans.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "label_summary", "quantiles_all", "series_rebucket", "series_cells", "steady_window", "error_clusters", "error_onset", "top_slowest",
    "scalability_curve", "sla_eval", "mann_whitney", "regression_verdict", "posterior_shift", "price_sketch", "stream_label_counts",
    "stream_percentiles", "packed_sketches",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, most = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first run warms up
            spark.catalog.clearCache()  # a run's cube isn't taken over by the next run
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name], most[name] = round(statistics.median(times[1:]), 3), round(max(times[1:]), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "max": most, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
