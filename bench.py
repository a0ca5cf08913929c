"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barloom.plans.catalog import queries
from barloom.session import local_session

HEADLINE = [
    "bars_hourly", "bars_path", "sma_cross", "rsi", "aroon", "atr", "bollinger", "hurst", "ema_align", "kalman_level", "cusum_regime",
    "supertrend", "single_asset", "rolling_corr", "pair_indicators", "positions", "param_sweep", "trade_ledger", "quarter_summary",
    "drawdown", "lead_lag", "regime_segments", "transitions", "policy_apply", "first_touch", "json_field",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = queries()
    catalog["bars_hourly"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
