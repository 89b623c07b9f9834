"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from seamark.plans.queries import QUERIES

HEADLINES = (
    "latest_positions", "gate_counts", "live_merge", "movement_hysteresis", "coalesced", "rate_limited", "trail_outliers", "kalman_track", "dead_reckoning",
    "zone_membership", "geofence_events", "events_feed", "snapshot_history", "nearby_pairs", "static_as_of", "nmea_roundtrip", "json_adapter",
    "new_vessels_bucket", "gate_chain", "trusted_source", "source_failover", "presence_changes",
)


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINES[0]](spark, sf_dir).count()  # starts the session
    seconds = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "decoded_frames_per_s": round(frames / seconds["nmea_roundtrip"])}))


if __name__ == "__main__":
    main()
