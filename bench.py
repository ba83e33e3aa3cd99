"""Time the headline queries and print one JSON line.

`BENCH_SF_DIR` names the data folder, `BENCH_CPUS` the cores, `BENCH_RUNS` the
timed runs after one warm-up (one by default); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from siftlog.operators import ensemble, evidence, incidents
from siftlog.plans import checks, detection, event_logs, reports
from siftlog.session import build_session, stage
from siftlog.sources import jsonl, profile

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def write_nowhere(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "5g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    logs = event_logs.event_logs(spark, SF_DIR)
    lines = checks.written_lines(spark, SF_DIR)
    scores = stage(event_logs.simple_scores(logs), "bench-scores")
    scored = event_logs.simple_scored(spark, SF_DIR)
    found = event_logs.simple_incidents(spark, SF_DIR)
    proof = checks.incident_evidence(spark, SF_DIR)

    timed = {
        "load_jsonl": lambda: write_nowhere(jsonl.canonical(jsonl.scan_jsonl(spark, lines, tolerant=True))),
        "profile_lines": lambda: profile.line_counts(profile.tally(profile.read_lines(spark, lines))).collect(),
        "features": lambda: write_nowhere(checks.features_of(spark, SF_DIR)),
        "detect": lambda: detection.detect(logs.drop("value")).evaluation.collect(),
        "combine_scores": lambda: stage(ensemble.combine(scores, detection.ROW).scored, "bench-scored"),
        "evaluation": lambda: ensemble.evaluation(scored).collect(),
        "incidents": lambda: incidents.build_incidents(scored).collect(),
        "incidents_by_severity": lambda: incidents.build_incidents(event_logs.severity_signals(spark, SF_DIR)).collect(),
        "evidence": lambda: write_nowhere(evidence.evidence(scored, found)),
        "summaries": lambda: write_nowhere(evidence.summaries(found, proof)),
        "prompts": lambda: write_nowhere(evidence.prompts(found, proof)),
        "summary": lambda: reports.summary(scored, found).collect(),
        "component_activity": lambda: reports.component_activity(scored).collect(),
        "hourly_activity": lambda: reports.hourly_activity(scored).collect(),
        "search": lambda: reports.search_messages(scored, "timeout|user 1[0-4]$").agg(F.count("*")).collect(),
        "record_page": lambda: reports.record_page(scored).collect(),
        "agreement": lambda: reports.pairwise_agreement(scored).collect(),
        "consensus_anomalies": lambda: reports.consensus_anomalies(scored).collect(),
    }
    medians = {}
    for name, run in timed.items():
        run()
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        medians[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
