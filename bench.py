"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is built and fully executed (a row count plus a value hash of all
columns, so no column is pruned away); ``value`` is the sum of the times.
Before timing, every query runs once on the smallest tables (``$BENCH_WARMUP_DIR``,
default sf0.001) so that JVM JIT and Spark's code generation are warm, as in a
long-running service; no result or table relation is shared between the two
runs (different paths).  Set BENCH_WARMUP_DIR="" to time cold runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "task_median", "latest_vote", "median_window", "zero_fill_votes", "room_snapshot", "room_snapshot_xml",
    "results_grid", "parse_messages", "xml_task_shred", "create_rooms", "register_users", "recovery_redeem",
    "credential_match", "stop_voting", "room_state_fold", "quarantine", "audit_foreign_keys", "stream_vote_counts",
    "snapshot_on_change", "fanout_updates", "room_snapshot_upsert", "stream_room_state_fold", "append_sinks",
    "register_users_batch", "resolve_messages", "slot_bitmaps", "results_grid_wide", "sql_functions", "stream_view_changes",
    "stream_fanout",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from estimark.plans.catalog import QUERIES
    from estimark.session import get_session

    spark = get_session(master=f"local[{cpus}]", app="estimark-bench")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for n in names if warm and os.path.isdir(warm) else []:
        try:
            df = QUERIES[n](spark, warm)
            df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).collect()
        except Exception:  # noqa: BLE001 - the timed run reports failures
            pass
    times, failed = {}, {}
    for n in names:
        t0 = time.perf_counter()
        try:
            df = QUERIES[n](spark, sf_dir)
            df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).collect()
            times[n] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report, keep the line
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
