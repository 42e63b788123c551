"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of three runs each, after one that warms the JVM; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["site_summary", "filter_sites_by_frequency", "ld_sliding_window", "ibs_distance", "sliding_diversity", "glm_association"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from allelix.plans.registry import QUERIES

    def run(name: str) -> float:
        at = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - at

    took = {}
    for name in HEADLINE:
        run(name)
        took[name] = round(sorted(run(name) for _ in range(3))[1], 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
