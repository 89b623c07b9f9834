"""Snapshot and deltas, the alert stream, the load of reference rows, and texts on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators import quality, reads
from seamark.sources import fixtures, sinks
from seamark.sources.vessel_table import VesselTable
from seamark.streaming import tracks as live
from seamark.streaming import views


def test_snapshot_then_deltas(spark, sf_dir, tmp_path):
    """Rows that come after joining are deltas, whenever the snapshot is read."""
    path, kind = str(tmp_path / "p"), "mmsi long, t_s long, seq long, lng double, lat double"
    spark.createDataFrame([(1, 10, 1, 1.0, 1.0), (1, 20, 2, 2.0, 2.0), (2, 5, 3, 3.0, 3.0)], kind).write.parquet(path)
    schema = spark.read.parquet(path).schema
    shot, deltas = views.snapshot_then_deltas(spark, path, schema)
    spark.createDataFrame([(1, 30, 4, 4.0, 4.0), (3, 1, 5, 5.0, 5.0)], kind).write.mode("append").parquet(path)
    shot = shot.sparkSession.createDataFrame(shot.collect(), schema)
    deltas.writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["mmsi"], r["seq"]) for r in shot.collect()} == {(1, 2), (2, 3)}
    assert {r["seq"] for r in spark.table("deltas").collect()} == {4, 5}


def test_alert_stream(spark, tmp_path):
    rows = [("enter", 1, "A", 50, None), ("enter", 2, "A", 90, None), ("exit", 1, "A", 60, None), ("ghost-exit", 2, "B", 70, 600)]
    spark.createDataFrame(rows, "kind string, mmsi long, zone_id string, at_s long, silent_s long").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("kind string, mmsi long, zone_id string, at_s long, silent_s long").parquet(str(tmp_path / "e"))
    views.alert_stream(events, F.lit(0), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r["event_id"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"enter|2|A|90", "exit|1|A|60", "ghost-exit|2|B|70"}


def test_reference_load(spark, tmp_path):
    """A load that runs again changes no vessel and adds a position of each."""
    rows = spark.createDataFrame([(1, 1, "a", 14.0, 53.0), (2, 2, "b", 15.0, 54.0)], "mmsi long, seq long, vessel_name string, lng double, lat double")
    sink, path = live.upsert_versions(spark, str(tmp_path / "v")), str(tmp_path / "p")
    for at in (1704067200, 1704153600):
        sinks.load_reference(rows, sink, path, at)
    assert {(r["mmsi"], r["vessel_name"]) for r in sink.read().collect()} == {(1, "a"), (2, "b")}
    assert sorted((r["mmsi"], str(r["day"])) for r in spark.read.parquet(path).collect()) == [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-01"), (2, "2024-01-02")]


def test_reference_load_that_failed(spark, tmp_path):
    """Its positions are there, its vessels aren't: the second run adds only those. Then a stream's batches go on from it."""
    kind = "mmsi long, seq long, vessel_name string, lng double, lat double"
    rows = spark.createDataFrame([(1, 1, "a", 14.0, 53.0), (2, 2, "b", 15.0, 54.0)], kind)
    table, path = live.upsert_versions(spark, str(tmp_path / "v")), str(tmp_path / "p")

    class Broken:
        def upsert(self, *_):
            raise OSError

    with pytest.raises(OSError):
        sinks.load_reference(rows, Broken(), path, 1704067200)
    for _ in range(2):
        sinks.load_reference(rows, table, path, 1704067200)
    assert spark.read.parquet(path).count() == 2
    for batch_id in range(6):  # as numbers go, long before the time of the load
        table(spark.createDataFrame([(1, 10 + batch_id, None, None)], "mmsi long, seq long, vessel_name string, sog long"), batch_id)
    assert sorted(tuple(r) for r in table.read().select("mmsi", "seq", "vessel_name").collect()) == [(1, 15, "a"), (2, 2, "b")]
    assert table.manifest()["done"] == {"reference": 1704067200, "stream": 5}


def test_vessel_table(spark, tmp_path):
    kind = "mmsi long, seq long, name string, sog int"
    path = str(tmp_path / "t")
    table = VesselTable(spark, path, buckets=4, keep=2)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(k, k, f"n{k}", None) for k in range(40)], kind), 0)
    before, old = table.manifest(), table.read()
    table.upsert(spark.createDataFrame([(7, 100, None, 5)], kind), 1)
    after = table.manifest()
    changed = [b for b in after["buckets"] if after["buckets"][b] != before["buckets"][b]]
    assert len(changed) == 1 and after["version"] == 2  # one bucket is rewritten
    assert old.count() == 40 and {tuple(r) for r in table.read().where("mmsi = 7").collect()} == {(7, 100, "n7", 5)}
    assert not table._commit(before | {"version": 2})  # the number is taken
    # Two writers that start from one manifest: the second finds its number taken and goes again from the first one's result.
    other, taken = VesselTable(spark, path, buckets=4, keep=2), []

    def late(manifest, commit=table._commit):
        if not taken:
            taken.append(other.upsert(spark.createDataFrame([(50, 1, "new", 1)], kind), 9, "other"))
        return commit(manifest)

    table._commit = late
    table.upsert(spark.createDataFrame([(51, 1, "x", 2)], kind), 2)
    assert {r["mmsi"] for r in table.read().collect()} == {*range(40), 50, 51} and table.manifest()["done"] == {"stream": 2, "other": 9}
    assert len(table.versions()) == 2 and len(list((tmp_path / "t" / "data").iterdir())) <= 5
    table.upsert(spark.createDataFrame([(51, 9, "y", 2)], kind), 2)  # a batch that is done
    assert table.read().where("mmsi = 51").first()["name"] == "x"


def test_counts_and_slices(spark, sf_dir):
    p = fixtures.positions(spark, sf_dir)
    exact, rough = (quality.vessel_counts(p, approximate=a).first() for a in (False, True))
    assert abs(rough["vessels"] - exact["vessels"]) <= 0.1 * exact["vessels"]
    df = spark.createDataFrame([([{"t_s": t} for t in (1, 5, 9)],), ([],)], "p array<struct<t_s: long>>")
    got = df.select(F.size(reads.last_points(F.col("p"), 2)).alias("n"), F.size(reads.fresh_points(F.col("p"), F.lit(5))).alias("fresh")).collect()
    assert [tuple(r) for r in got] == [(2, 2), (0, 0)]
    keys = spark.createDataFrame([("5|A",), ("5",), ("5|A|B",), ("x|A",), (None,)], "k string").select(ais.parsed_key(F.col("k")).alias("k")).collect()
    assert [tuple(r["k"]) if r["k"] else None for r in keys] == [(5, "A"), None, None, None, None]
