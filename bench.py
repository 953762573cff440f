"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lectern import queries as engine

HEADLINE = ["fts_term", "fts_phrase", "fts_bm25_topk", "fts_prefix_topk", "fts_facets", "federated_topk", "vocab_counts", "did_you_mean", "html_text", "id_runs", "run_tally", "word_study_counts", "passage_relevance", "learned_lexicon", "sm2_state", "streaks", "latest_wins"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.time()
            engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "median seconds of the headline queries, summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
