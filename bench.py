"""Time the headline queries; print one JSON line after each, the last of which holds all of them."""

import json
import os
import sys
import time

from evigraph.common import build_session
from evigraph.plans import QUERIES

HEADLINE = [
    "chunk_fixed", "sentences", "story_order", "entities_validated", "evidence_to_line", "chunk_paragraph_overlap", "graph_quality", "edge_dedup",
    "entity_resolve", "k_core", "bm25_top", "bm25_norm", "retrieve_khop", "rrf_three", "diverse_select", "dense_topk", "ppr", "chunk_mass",
    "vote_majority", "route_rules", "logo_rule", "gate_grid", "mcnemar", "cluster_bootstrap", "report_cube", "retrieval_recall", "hist_weighted",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["accuracy"](spark, sf).collect()  # start the JVM's workers before timing
    times, failed = {}, {}
    for name in names:
        start = time.time()
        try:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as e:  # one query's failure leaves the others' figures
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name} {times.get(name, 'failed')}", file=sys.stderr)
        line = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}
        print(json.dumps(line | ({"failed": failed} if failed else {})), flush=True)


if __name__ == "__main__":
    main()
