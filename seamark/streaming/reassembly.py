"""Exact reassembly of sentences in several parts, in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_S = 5


def step(state: tuple | None, row: tuple, ttl_s: int = TTL_S) -> tuple[tuple | None, str | None]:
    """One part against the buffer of its key: (new buffer, whole payload if it is complete).

    buffer: (parts wanted, time of its first part, parts held by number). It is dropped more than ttl_s after its first part,
    and starts anew when the number of parts changes; a part that it holds already is ignored.
    """
    t, wanted, number, payload = row
    if state is not None and (t - state[1] > ttl_s or state[0] != wanted):
        state = None
    # By number: a sentence may claim any number of parts, and room is taken only for those that came.
    wanted, first, held = state if state is not None else (wanted, t, {})
    held = {number: payload} | held
    if len(held) == wanted:
        return None, "".join(held[k] for k in range(1, wanted + 1))
    return (wanted, first, held), None


class Reassembly(StatefulProcessor):
    """Buffer of one (source, channel, message id); an event-time timer drops what never completes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("parts", "wanted int, first long, numbers array<int>, held array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = None
        if self.state.exists():
            wanted, first, numbers, held = self.state.get()
            now = wanted, first, dict(zip(numbers, held, strict=True))
        out = []
        # They may come in several frames, which aren't in order among themselves.
        for r in pd.concat(rows).sort_values(["t_s", "seq"]).itertuples():
            now, whole = step(now, (int(r.t_s), int(r.fragments), int(r.fragment), r.payload))
            if whole is not None:
                out.append((*key, int(r.seq), int(r.t_s), int(r.fragments), whole))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is None:
            self.state.clear()
        else:
            self.state.update((*now[:2], list(now[2]), list(now[2].values())))
            self.handle.registerTimer((now[1] + TTL_S + 1) * 1000)
        yield pd.DataFrame(out, columns=["source_id", "channel", "message_id", "seq", "t_s", "fragments", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def reassembled(parts: DataFrame) -> DataFrame:
    """Whole messages of a stream of enveloped parts with ``received_at`` and a watermark. Needs the RocksDB state store."""
    rows = parts.select("source_id", "channel", "message_id", "seq", "t_s", "fragments", "fragment", "payload", "received_at")
    return rows.groupBy("source_id", "channel", "message_id").transformWithStateInPandas(Reassembly(), outputStructType="source_id int, channel string, message_id string, seq long, t_s long, fragments int, payload string", outputMode="Append", timeMode="EventTime")
