"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma
separated names, or "all")."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "b2_meaningful_lines", "c1_classify_lines", "c3_extract_requirements", "c3_located_requirements", "c5_resolve_requirement_links",
    "c6_extract_standards", "c8_extract_facts", "c10_resolve_fact_links", "c11_merge_facts", "c12_detect_conflicts", "c15_extract_clauses",
    "c18_locate_excerpts", "c19_markdown_tables", "c22_extract_claims", "a4_mark_duplicates", "a9_page_blocks", "d2_response_matrix",
    "d5_section_basis", "d6_available_inputs", "d9_match_cases", "d10_pair_files", "d13_model_facts", "e1_coverage",
    "e4_block_unsupported_claims", "e5_block_table_quantities", "e11_build_review_queue", "e13_dedupe_review", "e16_run_metrics", "f5_upsert", "f6_cascade_delete",
    "f9_revision_history", "h3_job_timings",
]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("traceframe-bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from traceframe import catalog

    wanted = os.environ.get("BENCH_QUERIES", "")
    known = catalog.queries()
    names = list(known) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    known["b1_compact_text"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in names:
        t = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
