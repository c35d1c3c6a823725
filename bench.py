"""Benchmark of the headline queries: prints one JSON line.

Each entry is the wall time of the first run in the session, planning included, into a sink that
discards the rows. Tables that later queries start from are written first and timed as ``build_*``.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from legajo import queries as q  # noqa: E402
from legajo.session import local_session  # noqa: E402
from legajo.sources.tables import business_docs  # noqa: E402

BUILDS = {
    "build_docs": business_docs, "build_catalog": q.catalog, "build_label_model": lambda s, d: q.label_model(s, d).terms,
}
HEADLINE = [
    "flagship_types_confidence", "keyword_scores", "regex_scores", "agro_scores", "commercial_scores",
    "keyword_scores_documents", "doc_structure", "meta_all", "supplier_detect", "ensemble", "catalog_rows",
    "consensus_stats", "catalog_search_combined", "catalog_page", "review_apply", "stats_by_type",
    "stats_top_suppliers", "stats_avg_conf_by_type", "stats_overview", "nb_train", "nb_predict", "page_profile",
    "assemble_pages", "validate_manifest", "layout_scores", "export_methods_long", "op_timings",
]


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    times: dict[str, float] = {}
    for name, build in BUILDS.items():
        start = time.perf_counter()
        build(spark, SF_DIR)
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    documents = business_docs(spark, SF_DIR).count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cores": CPUS, "documents": documents,
        "ensemble_documents_per_second": round(documents / times["ensemble"]),
    }))


if __name__ == "__main__":
    main()
