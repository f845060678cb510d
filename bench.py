"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPS (timed runs per query after one warm-up, default 1; median kept).
Each query is forced in full with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notelink.plans import queries as Q  # noqa: E402
from notelink.session import local_session  # noqa: E402

HEADLINE = [
    "q_p1_lookup",            # dictionary lookup annotate, documents x mined gazetteer
    "q_n5_merge_mean",        # gaps-and-islands merge over every word mention
    "q_x4_scope_attributes",  # negation / uncertainty interval join
    "q_f2_link_levenshtein",
    "q_f3_link_jaro_winkler",
    "q_b3_link_bm25",
    "q_d5_cosine_top10",
    "q_p2_pipeline_levenshtein",  # tagger -> chunks -> merge -> link -> records
    "q_p6_annotate_dir",      # documents as files -> lookup -> JSON records -> read back
]


def run(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    Q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    run(spark, names[0], sf)  # warm-up: JVM, Python workers
    out = {}
    for n in names:
        times = [run(spark, n, sf) for _ in range(reps)]
        out[n] = round(statistics.median(times), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf_name}))


if __name__ == "__main__":
    main()
