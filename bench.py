"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")])

HEADLINE = ["flagship", "windows_sliding", "window_metrics", "bm25_topk", "vec_cosine_topk", "fuse_rrf", "rule_and_or_not", "rule_metrics", "cls_centroid", "an_group", "an_trend_hourly", "ir_ndcg", "ds_exclusivity"]


def main() -> None:
    from pyspark.sql import SparkSession

    from dialoom.catalog import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flagship"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the workers and compiles
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
