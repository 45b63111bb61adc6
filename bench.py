"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rowferry.queries import QUERIES, jobs
from rowferry.session import local_session

HEADLINES = (
    "entry_first_delivery", "k4_event_delivery", "k5_entity_refresh", "k5_order_refresh", "a10_upsert_newer", "a11_upsert_last",
    "a12_scoped_delete", "b21_checksum", "b22_external_reference", "c6_good_rows", "c12_referential_report",
    "d3_resolve_by_values", "d4_match_or_allocate", "d8_resolve_references", "d10_flatten", "d15_mismatch_counts",
    "d19_match_columns", "d20_rank_tables", "e12_job_failures", "f1_latest_per_key", "f3_allocate_ids", "f5_top_per_group",
    "f8_keep_last_duplicate", "h1_claim", "h3_retry_or_dead_letter", "h11_snapshot_diff", "i1_contract_diff",
    "i5_fingerprint_monitor", "j4_out_of_order_guard", "j8_change_apply",
)
REPEATED = ("k4_event_delivery", "k5_entity_refresh", "k5_order_refresh")


def timed(spark: SparkSession, folder: str, name: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def all_outputs(spark: SparkSession, folder: str) -> dict[str, float]:
    """Seconds of the composed jobs with every frame they return written: tables, crosswalk, outbox, notes of failures."""
    def write(frames: list) -> None:
        for frame in frames:
            if frame is not None:
                frame.write.format("noop").mode("overwrite").save()

    def delivered() -> None:
        done = jobs._delivered(spark, folder)
        write([*done.target.tables.values(), done.target.crosswalk, done.target.unresolved, done.outbox, done.quarantine, done.envelope,
               done.outcomes, done.audit])

    def refreshed() -> None:
        state, failed, deleted = jobs._refreshed(spark, folder)
        write([*state.tables.values(), state.crosswalk, state.unresolved, failed, deleted])

    def orders() -> None:
        state = jobs._orders_refreshed(spark, folder)
        write([*state.tables.values(), state.crosswalk, state.unresolved])

    seconds = {}
    for name, run in (("k4_event_delivery", delivered), ("k5_entity_refresh", refreshed), ("k5_order_refresh", orders)):
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # starts the session outside the timings
    seconds, warm = {}, {}
    for name in HEADLINES:
        seconds[name] = timed(spark, folder, name)
        if name in REPEATED:
            warm[name] = timed(spark, folder, name)
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "warm": warm, "warm_all_outputs": all_outputs(spark, folder),
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": cores,
        "refreshed_orders_per_sec": round(orders / warm["k5_order_refresh"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
