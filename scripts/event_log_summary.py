"""Summarise a Spark event log: jobs, stages, tasks and their durations.

Usage: python scripts/event_log_summary.py <event log dir or file> [top_n]

Reads plain or zstd-compressed event logs (Spark 4 writes rolling
``eventlog_v2_*`` folders).  Prints the slowest stages with task counts, shuffle
bytes and spill, the evidence to look at before tuning partitions.
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) if os.path.isdir(path) else [path]
    for f in files:
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                import zstandard

                raw = zstandard.ZstdDecompressor().stream_reader(fh).read()
            else:
                raw = fh.read()
        yield from raw.decode().splitlines()


def main(argv):
    path = argv[1]
    top = int(argv[2]) if len(argv) > 2 else 15
    jobs, stages = {}, {}
    for line in _lines(path):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "stages": len(e["Stage Infos"])}
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]]["ms"] = e["Completion Time"] - jobs[e["Job ID"]]["start"]
        elif ev == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            metrics = {m["Name"]: m.get("Value") for m in info.get("Accumulables", [])}
            stages[info["Stage ID"]] = {
                "name": info["Stage Name"][:60],
                "tasks": info["Number of Tasks"],
                "ms": (info.get("Completion Time") or 0) - (info.get("Submission Time") or 0),
                "shuffle_read": metrics.get("internal.metrics.shuffle.read.remoteBytesRead", 0)
                + (metrics.get("internal.metrics.shuffle.read.localBytesRead") or 0),
                "shuffle_write": metrics.get("internal.metrics.shuffle.write.bytesWritten", 0),
                "spill": metrics.get("internal.metrics.diskBytesSpilled", 0),
            }
    print(f"jobs: {len(jobs)}  total job time: {sum(j.get('ms', 0) for j in jobs.values())} ms  stages: {len(stages)}")
    print(f"{'stage':>5} {'ms':>7} {'tasks':>5} {'shuf read':>10} {'shuf write':>10} {'spill':>8}  name")
    for sid, s in sorted(stages.items(), key=lambda kv: -kv[1]["ms"])[:top]:
        print(
            f"{sid:>5} {s['ms']:>7} {s['tasks']:>5} {s['shuffle_read'] or 0:>10} {s['shuffle_write'] or 0:>10} "
            f"{s['spill'] or 0:>8}  {s['name']}"
        )


if __name__ == "__main__":
    main(sys.argv)
