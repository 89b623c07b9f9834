"""Streams of positions: windows with late data, keyed state per vessel, upserts by version."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seamark.operators import tracks
from seamark.operators.geo import DWELL_S, SILENCE_S
from seamark.sources.vessel_table import VesselTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(positions: DataFrame, late: str = "10 seconds") -> DataFrame:
    """positions with ``received_at`` and a watermark on it."""
    return positions.withColumn("received_at", F.timestamp_seconds("t_s")).withWatermark("received_at", late)


def coalesced(positions: DataFrame, window: str = "1 second") -> DataFrame:
    """The newest frame of each vessel in each window; positions need a watermark."""
    return positions.groupBy(F.window("received_at", window), "mmsi").agg(F.count("*").alias("n_frames"), F.max("seq").alias("last_seq"), F.max_by(F.struct("lng", "lat", "sog_t", "source_id"), "seq").alias("newest")).select("mmsi", F.col("window.start").alias("window_start"), "n_frames", "last_seq", "newest.*")


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch in order: they may come in several frames, which aren't in order among themselves."""
    return pd.concat(frames).sort_values(["t_s", "seq"])


class DwellProcessor(StatefulProcessor):
    """Geofence state of one vessel and zone: the run it is in, what was told last, when it was last heard.

    Rows (t_s, seq, inside) give enter and exit after DWELL_S in a row; an event-time timer SILENCE_S after the
    last row gives ghost-exit. State of a silent vessel is dropped, so it is bounded by the vessels on air.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("dwell", "told boolean, run boolean, since long, last long")

    def _silent(self, key, at: int) -> pd.DataFrame:
        told, _, _, last = self.state.get()
        self.state.clear()
        rows = [("ghost-exit", key[0], key[1], last + SILENCE_S, SILENCE_S)] if told and at - last >= SILENCE_S else []
        return _frame(rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in _in_order(rows).itertuples():
            t, inside = int(r.t_s), bool(r.inside)
            if self.state.exists() and t - self.state.get()[3] >= SILENCE_S:
                yield self._silent(key, t)
            told, run, since, last = self.state.get() if self.state.exists() else (False, not inside, t, t)
            if inside != run:
                run, since = inside, t
            if inside != told and t - since >= DWELL_S:
                told = inside
                yield _frame([("enter" if inside else "exit", key[0], key[1], t, None)])
            self.state.update((told, run, since, max(last, t)))
        if self.state.exists():
            _only_timer(self.handle, (self.state.get()[3] + SILENCE_S) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self._silent(key, expiredTimerInfo.getExpiryTimeInMs() // 1000)

    def close(self) -> None:
        pass


_EVENT = "kind string, mmsi long, zone_id string, at_s long, silent_s long"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "mmsi", "zone_id", "at_s", "silent_s"])
    return out.astype({"mmsi": "int64", "at_s": "int64", "silent_s": "Int64"})


def geofence_events(memberships: DataFrame) -> DataFrame:
    """Events of a stream (mmsi, zone_id, t_s, seq, inside, received_at with a watermark). Needs the RocksDB state store."""
    rows = memberships.select("mmsi", "zone_id", "t_s", "seq", "inside", "received_at")
    return rows.groupBy("mmsi", "zone_id").transformWithStateInPandas(DwellProcessor(), outputStructType=_EVENT, outputMode="Append", timeMode="EventTime")


class Carried(StatefulProcessor):
    """A step of ``operators.tracks`` over the rows of one vessel as they come, sorted within a batch; its state stays.

    expire_s: a vessel that is silent for longer starts afresh, whenever that is noticed, and an event-time timer drops its state.
    """

    def __init__(self, step, state: str, fields: list[str], columns: list[str], expire_s: int | None = None) -> None:
        self.step, self.kind, self.fields, self.columns, self.expire_s = step, state, fields, columns, expire_s
        self.time = [c.split()[0] for c in state.split(", ")].index("t")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("carried", self.kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)[self.fields]
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
            if state is not None and self.expire_s is not None and row[0] - state[self.time] > self.expire_s:
                state = None
            state, got = self.step(state, row)
            out.append((*key, *got))
        self.state.update(state)
        if self.expire_s is not None:
            _only_timer(self.handle, (state[self.time] + self.expire_s + 1) * 1000)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _only_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(int(at_ms))


def _carried(fixes: DataFrame, step, state: str, fields: list[str], kind: str, expire_s: int | None = None) -> DataFrame:
    columns = ["mmsi", *(c.split()[0] for c in kind.split(", "))]
    rows = fixes.select("mmsi", *fields, *(["received_at"] if expire_s is not None else [])).groupBy("mmsi")
    mode = "None" if expire_s is None else "EventTime"
    return rows.transformWithStateInPandas(Carried(step, state, fields, columns, expire_s), outputStructType=f"mmsi {fixes.schema['mmsi'].dataType.simpleString()}, {kind}", outputMode="Append", timeMode=mode)


def kalman(positions: DataFrame) -> DataFrame:
    """``operators.tracks.kalman`` of a stream; a vessel's filter never starts afresh. This and those below need the RocksDB state store."""
    names = "lng double, lat double, vlng double, vlat double, p00 double, p01 double, p11 double"
    return _carried(positions.where("lng IS NOT NULL AND lat IS NOT NULL"), tracks.kalman_step, f"t long, {names}", ["t_s", "seq", "lng", "lat"], f"seq long, {names}")


def rate_limit(frames: DataFrame, expire: bool = False) -> DataFrame:
    """expire: buckets that have filled up again are dropped, which changes no answer; frames need a watermark (``timed``)."""
    full_after = -(-tracks.BUCKET_SIZE // tracks.BUCKET_PER_S) if expire else None
    return _carried(frames, tracks.rate_step(), "tokens long, t long", ["t_s", "seq"], "seq long, accepted boolean", full_after)


def hysteresis(positions: DataFrame, expire: bool = False) -> DataFrame:
    """(mmsi, seq, session, moving) of a stream with ``sog`` in knots.

    expire: state of vessels that have left is dropped, and sessions are numbered from 0 since a vessel came back; positions need a watermark.
    """
    return _carried(positions, tracks.moving_step(), "session long, t long, moving boolean", ["t_s", "seq", "sog"], "seq long, session long, moving boolean", tracks.EVICT_S if expire else None)


class Evictions(StatefulProcessor):
    """The last time of one vessel; a row when it has been silent for longer than ``after_s``, by a timer or by its next row."""

    def __init__(self, after_s: int) -> None:
        self.after_s = after_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "t long")

    def _gone(self, key, last: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], last, last + self.after_s)], columns=["mmsi", "last_seen_s", "gone_s"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        for t in sorted(int(t) for pdf in rows for t in pdf["t_s"]):
            if last is not None and t - last > self.after_s:
                yield self._gone(key, last)
            last = t if last is None else max(last, t)
        self.state.update((last,))
        _only_timer(self.handle, (last + self.after_s + 1) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self._gone(key, self.state.get()[0])
            self.state.clear()

    def close(self) -> None:
        pass


def evictions(positions: DataFrame, after_s: int = tracks.EVICT_S) -> DataFrame:
    """(mmsi, last_seen_s, gone_s) of vessels that have left: what static rows, filters and memberships are dropped by. Needs a watermark."""
    kind = f"mmsi {positions.schema['mmsi'].dataType.simpleString()}, last_seen_s long, gone_s long"
    return positions.select("mmsi", "t_s", "received_at").groupBy("mmsi").transformWithStateInPandas(Evictions(after_s), outputStructType=kind, outputMode="Append", timeMode="EventTime")


def upsert_versions(spark: SparkSession, path: str, key: str = "mmsi", order: str = "seq") -> VesselTable:
    """A foreachBatch sink that keeps one row per key under path; ``read`` gives its rows to readers."""
    return VesselTable(spark, path, key, order)


def dead_letters(rows: DataFrame, path: str, checkpoint: str):
    """Start a JSON sink of quarantined rows, partitioned by day."""
    day = F.to_date(F.timestamp_seconds("ts")).alias("day")
    return rows.select("*", day).writeStream.format("json").partitionBy("day").option("maxRecordsPerFile", 100_000).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")

