"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from segmenta.plans import registry

HEADLINE = ["progress_by_lang", "progress_by_doc", "sentence_records", "chunk_progress", "status_totals", "effective_lenient", "findings_rollup", "term_audit", "budget_prefix", "review_snapshot", "token_candidates", "phrase_candidates", "rebuild_document"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, taken = registry.queries(), {}
    registry.queries()["line_spans"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        taken[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
