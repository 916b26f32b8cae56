"""Headline timings. Prints one JSON line.

The corpus tables are prepared once (``prepare_*``); the queries then run on
the prepared tables, each on a fresh plan and with its whole result consumed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigrove.session import session  # noqa: E402
from lexigrove.plans.workspace import workspace  # noqa: E402
from lexigrove.workload import ingest, search, statistics  # noqa: E402,F401
from lexigrove.workload.registry import QUERIES  # noqa: E402

HEADLINE = [
    "stats_totals", "stats_by_domain", "stats_by_source", "stats_length_histogram", "stats_annotation_distribution",
    "stats_all_annotation_fields", "catalog_from_records", "compare_domain_share", "filter_conjunction",
    "browse_longest", "browse_deep", "record_numbering", "join_range_location", "range_groups",
    "tokenize_words", "index_doc_stats", "search_bm25", "search_bm25_filtered", "search_page", "search_with_snippet",
    "search_phrase", "encode_documents", "concept_coverage", "search_cosine_exact", "search_ivf_filtered",
    "search_hybrid_rerank", "semantic_page", "topic_assign_all", "topic_distribution", "topic_view", "topic_keywords",
    "audit_duplicate_record_keys", "audit_vector_coverage", "snapshot_fingerprint", "latest_review_tag",
]
PREPARED = ["records", "postings", "term_stats", "sources", "source_table", "vectors", "vocabulary", "encoded", "index", "encoded_index",
            "labelled", "assignments", "topic_terms", "topic_keywords", "tag_writes"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.range(1000).count()
    w = workspace(spark, folder)
    seconds: dict[str, float] = {}
    for name in PREPARED:
        started = time.perf_counter()
        getattr(w, name)
        seconds[f"prepare_{name}"] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](w).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    queries = sum(v for k, v in seconds.items() if not k.startswith("prepare_"))
    print(json.dumps({
        "metric": "total seconds of headline queries on prepared tables", "value": round(queries, 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
