"""Streams give what the batch operators give over the same rows."""

import pytest
from pyspark.sql import functions as F

from seamark.operators import geo, tracks
from seamark.sources import fixtures
from seamark.streaming import tracks as live


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed") / "positions")
    fixtures.positions(spark, sf_dir).where("mmsi < 261000006").repartition(3).write.parquet(path)
    return path


def test_coalesce_stream(spark, landed, tmp_path):
    rows = spark.read.parquet(landed)
    stream = live.coalesced(live.timed(spark.readStream.schema(rows.schema).parquet(landed), "10 days"), "60 seconds")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("coalesced").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["mmsi"], r["last_seq"], r["n_frames"]) for r in spark.table("coalesced").collect()}
    want = {(r["mmsi"], r["last_seq"], r["n_frames"]) for r in tracks.coalesce_window(rows, ["sog_t"], 60).collect()}
    assert got == want and got


def test_dwell_stream(spark, landed, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    rows = spark.read.parquet(landed)
    pairs = geo._pairs(rows, geo.operational(fixtures.zones(spark))).select("mmsi", "zone_id", "t_s", "seq", "inside")
    pairs.coalesce(1).write.parquet(str(tmp_path / "pairs"))
    stream = live.timed(spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "pairs")), "10 days")
    q = live.geofence_events(stream).writeStream.outputMode("append").format("memory").queryName("dwell").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r["kind"], r["mmsi"], r["zone_id"], r["at_s"]) for r in spark.table("dwell").collect()}
    want = {(r["kind"], r["mmsi"], r["zone_id"], r["at_s"]) for r in geo.geofence_events(rows, fixtures.zones(spark)).collect()}
    assert got == want and got


def test_upsert_is_idempotent(spark, tmp_path):
    kind = "mmsi int, seq long, name string, sog int"
    sink = live.upsert_versions(spark, str(tmp_path / "v"))
    sink(spark.createDataFrame([(1, 1, "a", 5), (2, 2, "b", None)], kind), 0)
    second = spark.createDataFrame([(1, 3, None, 7), (3, 4, "c", 1)], kind)
    sink(second, 1)
    sink(second, 1)
    got = {tuple(r) for r in sink.read().collect()}
    assert got == {(1, 3, "a", 7), (2, 2, "b", None), (3, 4, "c", 1)}


@pytest.mark.parametrize("name", ["kalman", "rate_limit", "hysteresis"])
def test_carried_state_stream(spark, landed, tmp_path, name):
    """Two batches, the second of which goes on from the first one's state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    rows = spark.read.parquet(landed).withColumn("sog", F.col("sog_t") / 10).cache()
    half = int(rows.approxQuantile("t_s", [0.5], 0)[0])
    for part in (rows.where(F.col("t_s") <= half), rows.where(F.col("t_s") > half)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        stream = getattr(live, name)(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    want = tracks.hysteresis(rows, F.col("sog")).select("mmsi", "seq", "session", "moving") if name == "hysteresis" else getattr(tracks, name)(rows)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(want.columns).collect()}
    assert got == {tuple(r) for r in want.collect()} and got


@pytest.fixture
def small_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _append(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return stream.sparkSession.read.parquet(str(tmp_path / "out")).collect()


def test_dwell_over_many_frames(spark, small_frames, tmp_path):
    """A vessel in and out by turns, its rows in no order and in frames of three: events as of the rows in order."""
    rows = [(1, "A", 1000 + 20 * k, k, k // 10 % 2 == 0) for k in range(60)]
    spark.createDataFrame([rows[(7 * k) % 60] for k in range(60)], "mmsi long, zone_id string, t_s long, seq long, inside boolean").coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = live.timed(spark.readStream.schema("mmsi long, zone_id string, t_s long, seq long, inside boolean").parquet(str(tmp_path / "rows")), "10 days")
    got = sorted((r["at_s"], r["kind"]) for r in _append(live.geofence_events(stream), tmp_path))
    assert got == [(1000 + 20 * (10 * j + 2), "exit" if j % 2 else "enter") for j in range(6)]


def test_reassembly_over_many_frames(spark, small_frames, tmp_path):
    """Messages of four parts one after another under one id: none is lost, whatever the frames they come in."""
    from seamark.streaming import reassembly

    kind = "source_id int, channel string, message_id string, seq long, t_s long, fragments int, fragment int, payload string"
    rows = [(0, "A", "7", k, 100 + k // 4 * 3, 4, k % 4 + 1, f"p{k};") for k in range(40)]
    spark.createDataFrame([rows[(13 * k) % 40] for k in range(40)], kind).coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = live.timed(spark.readStream.schema(kind).parquet(str(tmp_path / "rows")), "10 days")
    got = {r["seq"]: r["payload"] for r in _append(reassembly.reassembled(stream), tmp_path)}
    assert got == {4 * m + 3: "".join(f"p{4 * m + j};" for j in range(4)) for m in range(10)}


def _in_batches(spark, tmp_path, kind, batches, operator):
    """The rows of a stream over batches that come one after another."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        stream = live.timed(spark.readStream.schema(kind).parquet(str(tmp_path / "rows")), "1 second")
        got = _append(operator(stream), tmp_path)
    return got


def test_state_expires(spark, small_frames, tmp_path):
    """Vessels 1 and 2 fall silent; the clock of vessel 3 goes on, and their state goes. Answers stay those of the batch operator."""
    kind = "mmsi long, t_s long, seq long, sog double"
    burst = [(1, 1000, k, 1.0) for k in range(8)] + [(2, 1001, 8, 0.4), (3, 1001, 9, 1.0)]
    later = [(3, 3000 + k, 20 + k, 0.4) for k in range(3)]
    back = [(1, 4000, 30 + k, 0.4) for k in range(8)] + [(3, 4000, 40, 0.4)]
    got = {r["seq"]: r["accepted"] for r in _in_batches(spark, tmp_path / "a", kind, [burst, later, back], lambda s: live.rate_limit(s, expire=True))}
    want = {r["seq"]: r["accepted"] for r in tracks.rate_limit(spark.createDataFrame(burst + later + back, kind)).collect()}
    assert got == want and not got[7] and got[30]
    got = {r["seq"]: (r["session"], r["moving"]) for r in _in_batches(spark, tmp_path / "b", kind, [burst, later, back], lambda s: live.hysteresis(s, expire=True))}
    assert got[7] == (0, True) and got[30] == (0, False) and got[20] == (0, False)  # afresh: 0.4 knots don't start a vessel


def test_evictions(spark, small_frames, tmp_path):
    kind = "mmsi long, t_s long, seq long"
    batches = [[(1, 1000, 0), (2, 1000, 1), (2, 1500, 2)], [(3, 1700, 3), (1, 1601, 4)], [(3, 2300, 5)], [(3, 2301, 6)]]
    got = sorted((r["mmsi"], r["last_seen_s"], r["gone_s"]) for r in _in_batches(spark, tmp_path, kind, batches, live.evictions))
    assert got == [(1, 1000, 1600), (1, 1601, 2201), (2, 1500, 2100)]  # 600 s exactly are kept, as vessel 3 shows
