"""Summarise stage durations from a Spark event log folder (zstd or plain)."""
import glob
import json
import sys

import zstandard


def events(path):
    for f in sorted(glob.glob(path + "/**/events_*", recursive=True)):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(open(f, "rb")).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def main(path, top=20):
    stages = {}
    for e in events(path):
        if e.get("Event") == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
            rdds = [r["Name"] for r in si.get("RDD Info", [])][:3]
            stages[si["Stage ID"]] = (dur, si["Number of Tasks"], rdds)
    total = sum(v[0] for v in stages.values())
    print(f"stages={len(stages)} sum_stage_seconds={total:.1f}")
    for sid, (dur, n, rdds) in sorted(stages.items(), key=lambda x: -x[1][0])[:top]:
        print(sid, round(dur, 1), n, rdds)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 20)
