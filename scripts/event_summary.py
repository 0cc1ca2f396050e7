"""Summarise a Spark event log written by ``BENCH_EVENT_LOG``: jobs, stages,
tasks and summed job time per job group (= bench query).

    python scripts/event_summary.py <event-log-file-or-folder>
"""

from __future__ import annotations

import collections
import json
import os
import sys


def _lines(path: str):
    """Lines of an event file, zstd-compressed ones included."""
    if path.endswith(".zstd"):
        import io
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main() -> None:
    path = sys.argv[1]
    if os.path.isdir(path):  # rolling (v2) event logs are folders of event files
        files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs
                       if f.startswith("events") or f.startswith("local-"))
    else:
        files = [path]
    start, group, stages = {}, {}, {}
    agg = collections.defaultdict(lambda: {"jobs": 0, "stages": 0, "tasks": 0, "job_sec": 0.0})
    for f in files:
        for line in _lines(f):
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    jid = ev["Job ID"]
                    props = ev.get("Properties") or {}
                    group[jid] = props.get("spark.jobGroup.id", "(none)")
                    start[jid] = ev["Submission Time"]
                    stages[jid] = ev.get("Stage Infos", [])
                elif kind == "SparkListenerJobEnd":
                    jid = ev["Job ID"]
                    g = agg[group.get(jid, "(none)")]
                    g["jobs"] += 1
                    g["job_sec"] += (ev["Completion Time"] - start.get(jid, ev["Completion Time"])) / 1000
                    infos = stages.get(jid, [])
                    g["stages"] += len(infos)
                    g["tasks"] += sum(s.get("Number of Tasks", 0) for s in infos)
    print(f"{'group':28s} {'jobs':>5s} {'stages':>7s} {'tasks':>7s} {'job_sec':>8s}")
    for name, g in sorted(agg.items(), key=lambda kv: -kv[1]["job_sec"]):
        print(f"{name:28s} {g['jobs']:5d} {g['stages']:7d} {g['tasks']:7d} {g['job_sec']:8.2f}")


if __name__ == "__main__":
    main()
