"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

REPOSITORY = str(Path(__file__).resolve().parent)
sys.path.insert(0, REPOSITORY)
os.environ["PYTHONPATH"] = os.pathsep.join([REPOSITORY, *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINES = (
    "ohlcv_1h", "resample_4h_from_1h", "resample_1d_from_1h", "missing_slots", "coalesced_gaps", "footprint_levels", "source_priority_merge",
    "audit_strict", "intrabar_range_join", "series_manifest", "revision_select", "series_checksum", "kline_json_decode", "stream_commit_state",
)


def main() -> None:
    from candela.queries import QUERIES
    from candela.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        run(name)  # compile and warm up
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
