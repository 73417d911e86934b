"""Seconds per headline query, printed as one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pultwerk.plans import all_queries
from pultwerk.session import get_session
from pultwerk.sources.tables import TEXT_PARTITIONS

HEADLINE = [
    "ag_01_06_usage_rollups", "ag_03_usage_by_month", "jn_01_price_resolution", "wn_01_budget_alerts", "src_12_report_text",
    "sc_01_findings_docs", "sc_03_redact_docs", "sc_04_privacy_decision", "wn_12_sticky_privacy", "jn_03_grading_gate",
    "jn_04_skill_match", "sc_07_pseudonymize", "wn_11_aliases", "rc_02_latest_ratings", "jn_08_state_names",
    "sc_09_chunks", "rt_02_search_cutoff", "rt_04_chat_turns", "gr_01_class_report", "ls_01_lesson_report", "jn_06_topic_coverage",
    "sc_25_numbers", "cn_01_alignment", "cn_03_consensus_text", "cn_06_page_decision", "wn_06_word_lines", "rv_01_job_states",
    "src_10_streamed_output", "st_01_usage_rollups",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus), spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    # the text tables are one row group each at these sizes, so one task without this
    spark.conf.set(TEXT_PARTITIONS, cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    # the least of several runs: the first ones pay for warming up the JVM and the file cache
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    for name in wanted:
        took = []
        for _ in range(repeats):
            start = time.perf_counter()
            all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(min(took), 3)
        print(name, *[round(t, 3) for t in took], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
