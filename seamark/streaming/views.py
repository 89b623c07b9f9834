"""Streams for readers: a snapshot followed by what comes after it, and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamark.operators import reads, tracks


def snapshot_then_deltas(spark: SparkSession, path: str, schema: StructType, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(the latest row of each vessel, a stream of all rows after them) of a table of positions that grows.

    Both are cut at the largest ``order`` (arrival order) at the moment of joining, so that a row is in exactly one of
    them whenever its file is read; an empty table gives an empty snapshot and a stream of everything.
    """
    rows = spark.read.schema(schema).parquet(path)
    mark = rows.agg(F.max(order)).first()[0]
    before = F.lit(False) if mark is None else F.col(order) <= mark
    return tracks.latest(rows.where(before)), spark.readStream.schema(schema).parquet(path).where(~before)


def alert_stream(events: DataFrame, session_start_s: Column, path: str, checkpoint: str):
    """Start a JSON sink of the alerts in a stream of events (kind, mmsi, zone_id, at_s, silent_s)."""
    event_id = F.concat_ws("|", "kind", F.col("mmsi").cast("string"), "zone_id", F.col("at_s").cast("string"))
    rows = reads.alerts(events, session_start_s).withColumn("event_id", event_id)
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
