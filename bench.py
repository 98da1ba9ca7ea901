"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.plans import catalog
from millrace.session import build_session

HEADLINES = [
    "revenue_by_country", "payment_kpis", "numeric_profile", "payment_report", "repeat_offenders", "month_over_month",
    "lane_performance", "shipment_features", "carrier_prior_median", "predicted_arrivals", "track_shipments",
    "store_demand_forecast", "store_cover", "order_alerts", "priced_orders", "stock_projection", "backtest_summary",
    "forward_forecast", "expected_losses", "concentration", "value_at_risk", "stress_test", "woe_table",
    "score_metrics", "feature_drift", "page_sections", "table_aware_chunks", "fixed_windows", "keyword_top_k",
    "dense_top_k", "hybrid_fusion", "graph_neighbourhood", "evaluation_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "millrace-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog()
    names = sys.argv[1:] or HEADLINES
    # One small query warms the JVM, so that the first headline is not charged for it.
    known["revenue_by_country"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
