"""Time of the headline queries as one JSON line: after a warm-up run the median of three, or one run for queries whose warm-up takes over SLOW seconds."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from noticelake.plans import registry

HEADLINE = (
    "j04_unpushed_notices", "a05_org_occurrence", "a16_supplier_profile", "s02_concentration", "s06_cooccurrence", "w02_version_chain", "j02_nested_evidence",
    "j09_conflict_pairs", "a11_completeness", "k09_percentile_linear", "st09_session", "n01_normalize", "n11_simhash", "e06_cascade_locate", "p26_content_check",
    "v01_amount", "v09_amount_equal", "m07_first_occurrences", "m12_bootstrap",
)


SLOW = 4.0


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        while len(runs) < (2 if runs and runs[0] > SLOW else 4):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {n: round(docs / took[n]) for n in ("n01_normalize", "n11_simhash", "e06_cascade_locate")}
    line = {"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "docs_per_second": rates, "cpus": int(cpus), "sf": os.path.basename(sf_dir).removeprefix("sf")}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
