"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) choose data and threads.
"""

import json
import os
import time

from barometry.plans import views
from barometry.plans.features import feature_pipeline
from barometry.session import build_session
from contract.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))

HEADLINE = [
    "scan_bars", "validate_records", "upsert_bars", "feature_store_write", "feature_store_read",
    "realized_vol", "atr", "rsi", "tsi", "trend_strength", "rolling_zscores",
    "join_macro_date_ffill", "join_macro_asof", "iv_skew_proxy", "gex_proxy",
    "all_features_without_macro", "all_features", "bars_daily", "duration_p95",
    "latest_n_per_ticker", "sliding_sequences", "regime_transitions", "alert_rules", "latest_signal_cache",
    "stream_regime_shift", "tumbling_bars", "ensemble_predict", "train_job", "infer_all",
]


def many_tickers(spark, folder):
    """Features of some hundred tickers: flag, status and supplier group instead of the flag alone."""
    items = views.table(spark, folder, "lineitem").selectExpr(
        "*", "concat(l_returnflag, l_linestatus, cast(l_suppkey % 50 as string)) as ticker",
        "l_extendedprice / l_quantity as px")
    bars = items.groupBy("l_shipdate", "ticker").agg(
        {"px": "max", "l_quantity": "sum", "l_extendedprice": "min", "l_tax": "max"}).selectExpr(
        "l_shipdate as time", "ticker", "`max(px)` as open", "`max(px)` * 1.1 as high",
        "`max(px)` * 0.9 as low", "`max(px)` as close", "cast(`sum(l_quantity)` as long) as volume")
    return feature_pipeline(bars)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": str(CPUS), "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["list_tickers"](spark, SF_DIR).collect()  # start-up is not part of any query

    def timed(run) -> float:
        start = time.time()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    times = {name: timed(QUERIES[name]) for name in HEADLINE}
    times["features_many_tickers"] = timed(many_tickers)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
