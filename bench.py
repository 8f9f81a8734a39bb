"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from synthframe.plans import catalog  # noqa: E402
from synthframe.plans.synthesizer import Synthesizer  # noqa: E402
from synthframe.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CATALOGUE = ("profile_columns", "category_encode_values", "ffill_bfill", "ks_distances", "normal_scores", "mixture_scores",
             "quantile_roundtrip_mixture", "correlation_matrix", "descriptive_stats", "column_shapes", "class_auc")


def run(work) -> float:
    start = time.perf_counter()
    df = work()
    if df is not None:
        df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session("bench")
    registered = catalog.callables()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {name: run(lambda name=name: registered[name](spark, FOLDER)) for name in CATALOGUE}

    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").drop("o_custkey")
    rows = orders.count()
    fitted = {}

    def fit(preset: str, **options):
        fitted[preset] = Synthesizer(preset, row_id="o_orderkey", **options).fit(orders)

    for preset, options in (("mixture_copula", {"max_components": 8}), ("elbow_copula", {"k": 4})):
        times[f"fit_{preset}"] = run(lambda: fit(preset, **options))
        times[f"sample_{preset}"] = run(lambda: fitted[preset].sample(spark, rows))
    scale = float(re.search(r"sf([0-9.]+)", FOLDER).group(1)) if re.search(r"sf([0-9.]+)", FOLDER) else None
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": scale, "sampled_rows": rows,
                      "sampled_rows_per_sec": {p: round(rows / times[f"sample_{p}"]) for p in fitted}}))


if __name__ == "__main__":
    main()
