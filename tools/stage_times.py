"""Per-stage durations from a Spark event log (no UI needed).

Usage: python tools/stage_times.py <event-log-dir-or-file> [top_n]
"""

from __future__ import annotations

import json
import os
import sys


def _lines(fp: str):
    if fp.endswith(".zstd"):
        import io

        import zstandard

        with open(fp, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(fp, encoding="utf-8") as fh:
            yield from fh


def _files(path: str) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    out = []
    for d, _, names in os.walk(path):
        out += [os.path.join(d, f) for f in names if f.startswith(("events_", "eventlog", "local-", "app-"))]
    return sorted(out)


def stages(path: str):
    """(seconds, stage id, tasks, stage name, SQL execution description)."""
    stage_sql, sql_desc, done = {}, {}, []
    for fp in _files(path):
        for line in _lines(fp):
            if not line.strip():
                continue
            ev = json.loads(line)
            kind = ev.get("Event", "")
            if kind == "SparkListenerJobStart":
                props = ev.get("Properties") or {}
                label = props.get("spark.job.description") or f"sql:{props.get('spark.sql.execution.id')}"
                for sid in ev.get("Stage IDs", []):
                    stage_sql[sid] = label
            elif kind.endswith("SparkListenerSQLExecutionStart"):
                sql_desc[str(ev.get("executionId"))] = (ev.get("description") or "").replace("\n", " ")
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                start, end = info.get("Submission Time"), info.get("Completion Time")
                if start is not None and end is not None:
                    done.append(((end - start) / 1000.0, info["Stage ID"], info["Number of Tasks"], info["Stage Name"]))
    for sec, sid, tasks, name in done:
        label = stage_sql.get(sid) or ""
        if label.startswith("sql:"):
            label = sql_desc.get(label[4:], label)
        yield sec, sid, tasks, name, label


def main(argv):
    top = int(argv[2]) if len(argv) > 2 else 20
    rows = sorted(stages(argv[1]), reverse=True)
    total = sum(r[0] for r in rows)
    print(f"{len(rows)} stages, {total:.1f} s summed stage time")
    for sec, sid, tasks, name, desc in rows[:top]:
        print(f"{sec:8.2f}s  stage {sid:<5} tasks {tasks:<5} {name[:40]:<40} | {desc[:70]}")


if __name__ == "__main__":
    main(sys.argv)
