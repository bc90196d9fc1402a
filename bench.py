"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the sample folder, ``BENCH_CPUS`` the number of cores. Each query runs once to
warm up and then up to ``BENCH_RUNS`` times, as long as these take ``BENCH_QUERY_SECONDS`` in all; the median of the
later runs counts, or the first where none followed. Every query is reported on the error stream as it ends, and once
``BENCH_SECONDS`` are over no further one begins, so there is a result line in any case. All rows are
computed and handed to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from kvitok.plans.queries import QUERIES
from kvitok.session import local_session

HEADLINE = (
    "charges_upsert",
    "address_month_service",
    "trailing_12_months",
    "previous_period",
    "month_over_month",
    "chart_long",
    "missing_analysis",
    "analysis_prompt",
    "report_text",
    "bill_text_services",
    "mail_triage",
    "bill_first_valid_part",
    "bill_quarantine",
    "html_visible_text",
    "stream_ingest",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    began = time.perf_counter()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    each = float(os.environ.get("BENCH_QUERY_SECONDS", "60"))
    most = float(os.environ.get("BENCH_SECONDS", "900"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "kvitok-bench", memory="12g")
    seconds, first, failed = {}, {}, {}
    for name in names:
        if time.perf_counter() - began > most:
            failed[name] = "not begun for lack of time"
            continue
        try:
            took = [run(spark, name, sf_dir)]
            while len(took) <= runs and sum(took) + took[-1] < each + took[0]:
                took.append(run(spark, name, sf_dir))
        except Exception as error:  # the other queries still count
            failed[name] = f"{type(error).__name__}: {error}"[:200]
            continue
        first[name] = round(took[0], 3)
        seconds[name] = round(statistics.median(took[1:] or took), 3)
        print(name, first[name], seconds[name], len(took), file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, warm median, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first": first,
                "failed": failed,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
