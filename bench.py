"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.session import local_session

HEADLINES = ["backlog_intervals", "pit_as_of", "ttst_sync_result", "prune_noop_updates", "temporal_semi_join", "except_diff", "column_profile", "closure", "change_feed", "schema_anomalies", "staple_commits", "text_index_search"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "4"))
    spark = local_session(cpus, "bench", spark__sql__shuffle__partitions=str(cpus))
    from tidemark.plans import catalogue

    spark.read.parquet(f"{folder}/events.parquet").count()  # starts the readers; not timed
    seconds: dict[str, float] = {}
    medians: dict[str, float] = {}
    for name in HEADLINES:
        times = []
        for _ in range(5):  # later runs have their code compiled; the median tells a loaded machine from a slow query
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name], medians[name] = round(min(times), 3), round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline queries, best of five runs, summed", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "medians": medians, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
