"""Times headline queries on one node and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from timeloom.plans import catalog
from timeloom.session import local_session

QUERIES = (
    "failed_requests", "web_clf_parse", "syslog_5424_parse", "syslog_3164_year", "winfirewall_parse", "cisco_asa_parse", "macos_asl_parse", "iis_parse", "zeek_conn",
    "log_sticky_pattern", "json_event_parse", "cloudtrail_parse", "csv_role_inference", "winxml_parse", "task_explode_union", "transcript_commands", "browser_chrome_join", "timeline_union",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "8g", 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["web_clf_parse"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts executors and compiles
    seconds = {}
    for name in QUERIES:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
