"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from segmill.plans.queries import queries
from segmill.session import build_session

HEADLINE = [
    "customer_metrics",
    "funnel_ratios",
    "user_distincts",
    "user_modal_values",
    "user_spend",
    "session_length",
    "decision_delay",
    "revisit_rate",
    "top_brands",
    "collapse_rare_brand",
    "win_value_counts",
    "win_cart_purchase_time",
    "win_session_bounds",
    "dedup_events",
    "clean_events",
    "ingest_folder",
    "append_events",
    "customers_by_id_range",
    "scaled_features",
    "feature_matrix",
    "assign_clusters",
    "minibatch_step",
    "minibatch_kmeans",
    "kmeans_fit_predict",
    "kmeans_elbow",
    "pca_2d",
    "density_core_points",
    "density_clusters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "segmill-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    # start-up of the JVM's compiler and of the file readers is not the queries' time
    registered["funnel_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
