"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (default 3; the median counts)."""

from __future__ import annotations

import json
import os
import statistics
import time

from chronoweave import queries
from chronoweave.session import session

HEADLINE = ("q_bm25_topk", "q_tfidf_topk", "q_cosine_topk", "q_rrf", "q_vote_rrf", "q_hier_events", "q_dedupe_overlap", "q_interval_overlap", "q_implicit_period_join", "q_chunk_fixed_char", "q_sentence_split", "q_graph_stats", "q_prior_sliding")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    found = queries.queries()
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for k in range(int(os.environ.get("BENCH_RUNS", "3")) + 1):
            began = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            if k:  # the first run warms the JVM up
                runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
