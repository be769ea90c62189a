"""Times the headline queries once each and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from graphloom.plans import registry, wide

HEADLINE = ("module_edges", "module_coupling", "file_churn", "change_coupling", "dead_code", "edge_diff", "search_ranked", "unenclosed_spans", "change_bursts", "impact", "pagerank", "strong_components_whole", "symbol_edges", "co_change_support")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        {**registry.QUERIES, **wide.QUERIES}[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
