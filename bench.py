"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Every query runs in full (`noop` sink). The session is warmed up by one scan; nothing else is repeated.
"""

from __future__ import annotations

import json
import os
import time

from ragspark.operators.lexical import bm25_index
from ragspark.session import local_session, work_path
from workload import answers, bindings, graphs, retrieval, texts

HEADLINE = [
    ("bm25_topk", retrieval), ("dense_topk", retrieval), ("rrf_fusion", retrieval), ("keyword_search", retrieval),
    ("basic_retrieve", retrieval), ("rerank_topk", retrieval), ("multi_query_rrf", retrieval), ("graph_retrieve", retrieval),
    ("hybrid_search", retrieval), ("routed_retrieve", retrieval), ("substring_search", retrieval),
    ("ego_nodes", graphs), ("ego_edges", graphs), ("simple_paths", graphs), ("graph_stats", graphs), ("graph_validate", graphs),
    ("gap_batch", answers), ("context_block", answers), ("full_session", answers), ("question_route", answers),
    ("text_clean", texts), ("keyword_tags", texts), ("upload_ingest", texts),
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "bench")
    bindings.documents(spark, sf).selectExpr("sum(length(content))").collect()
    times: dict[str, float] = {}

    began = time.time()
    bm25_index(bindings.documents(spark, sf)).save(work_path(spark, "bench-index"))
    times["bm25_index_build"] = round(time.time() - began, 3)
    bindings.stored_index(spark, sf)  # the index the queries below share
    began = time.time()
    bindings.stored_graph(spark, sf)  # and the graph
    times["graph_store"] = round(time.time() - began, 3)

    for name, module in HEADLINE:
        began = time.time()
        module.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
