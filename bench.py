"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8); BENCH_QUERIES: names,
comma-separated, or "all". Each query is run in full into a sink that drops its rows, once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timeline_lake.catalog import queries  # noqa: E402
from timeline_lake.session import build_session  # noqa: E402

HEADLINE = (
    "utterances gaps silence_segments word_flags transcript_rollup segment_timeline remap_multi caption_words builder_timeline interval_split "
    "keyframe_sample caption_windows upsert_assets parity_diff spec_segments spec_validate frame_stats usage_quota fts_index fts_search"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    known = queries()
    names = list(known) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            began = time.time()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
