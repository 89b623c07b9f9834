"""Sinks: positions by day, dead letters, packed update frames, features, snapshots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.sources.vessel_table import VesselTable

#: Fixed layout of an update frame, little-endian, 40 bytes: absent numbers are NaN, 65535 or 255.
FRAME = np.dtype([("mmsi", "<u4"), ("t_s", "<u4"), ("lng", "<f8"), ("lat", "<f8"), ("sog", "<f4"), ("cog", "<f4"), ("heading", "<u2"), ("nav_status", "u1"), ("flags", "u1"), ("source_id", "u1"), ("spare", "u1", 3)])


def append_positions(positions: DataFrame, path: str) -> None:
    """Positions by day, ordered by vessel within a file, so that a vessel's history reads few row groups."""
    day = F.to_date(F.timestamp_seconds("t_s"))
    positions.withColumn("day", day).repartition("day", F.pmod(F.xxhash64("mmsi"), F.lit(16))).sortWithinPartitions("mmsi", "t_s").write.mode("append").partitionBy("day").parquet(path)


def load_reference(vessels: DataFrame, table: VesselTable, path: str, at_s: int) -> None:
    """Vessels (mmsi, seq, their fields, lng, lat) put into the vessel table, and one position of each at ``at_s`` appended.

    A run is known by its time. One that comes again after a failure adds only what isn't there: positions of vessels without one
    at that time, and the vessels unless they are in.
    """
    rows = vessels.select("mmsi", "seq", F.lit(at_s).cast("long").alias("t_s"), "lng", "lat")
    spark = vessels.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = spark.read.schema("mmsi long, t_s long, day date").parquet(path).where(F.col("day") == F.to_date(F.timestamp_seconds(F.lit(at_s)))).where(F.col("t_s") == at_s)
        rows = rows.join(there.select(F.col("mmsi").cast(vessels.schema["mmsi"].dataType)), "mmsi", "left_anti").select(rows.columns)
    append_positions(rows, path)
    table.upsert(vessels.drop("lng", "lat"), at_s, "reference")


def dead_letters(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """Quarantined rows as JSON lines by day, in files of a bounded number of rows."""
    rows.withColumn("day", F.to_date(F.timestamp_seconds("ts"))).write.mode("append").option("maxRecordsPerFile", most).partitionBy("day").json(path)


def expired_days(rows: DataFrame, as_of_day: str, keep_days: int) -> DataFrame:
    """The days of dead letters that are past their retention."""
    return rows.select("day").distinct().where(F.col("day") < F.date_sub(F.lit(as_of_day).cast("date"), keep_days))


def packed(updates: DataFrame) -> DataFrame:
    """(mmsi, frame): updates (mmsi, t_s, lng, lat, sog_t, cog_t, heading, nav_status, flags, source_id) as frames."""

    def pack(batches):
        for b in batches:
            get = lambda name, fill: b.column(name).fill_null(fill).to_numpy(zero_copy_only=False)
            out = np.zeros(b.num_rows, FRAME)
            for name, fill in (("mmsi", 0), ("t_s", 0), ("lng", float("nan")), ("lat", float("nan")), ("heading", 65535), ("nav_status", 255), ("flags", 0), ("source_id", 255)):
                out[name] = get(name, fill)
            out["sog"], out["cog"] = get("sog", float("nan")), get("cog", float("nan"))
            raw = out.tobytes()
            yield pa.record_batch([b.column("mmsi"), pa.array([raw[k : k + FRAME.itemsize] for k in range(0, len(raw), FRAME.itemsize)], pa.binary())], ["mmsi", "frame"])

    rows = updates.select(F.col("mmsi").cast("long"), F.col("t_s").cast("long"), "lng", "lat", (F.col("sog_t") / 10).alias("sog"), (F.col("cog_t") / 10).alias("cog"), F.col("heading").cast("int"), F.col("nav_status").cast("int"), F.col("flags").cast("int"), F.col("source_id").cast("int"))
    return rows.mapInArrow(pack, "mmsi long, frame binary")


def unpacked(frames: DataFrame) -> DataFrame:
    """frames (frame) as columns; one of another length gives a reason and nulls."""
    kind = "mmsi long, t_s long, lng double, lat double, sog double, cog double, heading int, nav_status int, flags int, source_id int, reason string"

    def unpack(batches):
        for b in batches:
            blobs = b.column(0).to_pylist()
            good = np.array([v is not None and len(v) == FRAME.itemsize for v in blobs], bool)
            got = np.zeros(len(blobs), FRAME)
            got[good] = np.frombuffer(b"".join(v for v, g in zip(blobs, good, strict=True) if g), FRAME)

            def column(name, kind, absent=None):
                bad = ~good | (np.isnan(got[name]) if absent == "nan" else got[name] == absent if absent is not None else False)  # noqa: B023
                return pa.array(got[name].astype(kind), mask=bad)  # noqa: B023

            cols = [column("mmsi", "int64"), column("t_s", "int64"), *(column(c, "float64", "nan") for c in ("lng", "lat", "sog", "cog")), column("heading", "int32", 65535), column("nav_status", "int32", 255), column("flags", "int32"), column("source_id", "int32", 255)]
            yield pa.record_batch([*cols, pa.array([None if g else "frame-length" for g in good], pa.string())], [c.split()[0] for c in kind.split(", ")])

    return frames.select("frame").mapInArrow(unpack, kind)
