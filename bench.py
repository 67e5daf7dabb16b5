"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textwarden.plans.queries import QUERIES, stored  # noqa: E402

HEADLINE = (
    "gate_docs",
    "gate_docs_planted",
    "redact_corpus",
    "redact_pages",
    "redact_conversations",
    "secret_flag",
    "secret_findings",
    "injection_scan",
    "path_rules",
    "src_lines",
    "grep_literal",
    "win_head_tail",
    "gate_captures",
    "agg_run_stats",
    "agg_report",
    "win_line_index",
    "join_lookup",
    "join_retrieve",
    "join_search",
    "win_quota",
    "snk_commit",
    "set_delete",
    "set_snapshot_diff",
    "join_leak_check",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textwarden-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        # The tables are single files of one row group.
        .config("spark.textwarden.texts.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="textwarden-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors, warm the JVM up and build the store that lookups read; not timed.
    QUERIES["redact_conversations"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    stored(spark, sf_dir)
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline jobs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
