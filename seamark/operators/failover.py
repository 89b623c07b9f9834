"""Which source is trusted, by an automaton over the accepted frames of all sources.

The current source is healthy while its frames come. Without one for HEALTHY_S it is degraded, and GRACE_S later it is set aside as
warm, and the next one in order of priority that isn't warm takes its place; if there is none, all are exhausted, and RETRY_S
later the search starts afresh from the first. A frame of a warm source that ranks above the current one makes it current at
once, and the one before it warm. A source that fails is tried: it takes no part until the next fresh start. Connecting takes no time.

Time goes in seconds; of one second, the first event of each source counts, in order of arrival, before anything is asked of that
second. The automaton is in one of few states (mode, current source, warm and tried sources, age in seconds), so a slice of time is a
map from states to states. Maps of slices are made at the same time, composed in order, and the slices replayed from where they start.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.sources.landing import landed

HEALTHY_S, GRACE_S, RETRY_S = 300, 600, 60
PRIORITY = (3, 2, 0, 1)
ACTIVE, DEGRADED, EXHAUSTED = 0, 1, 2
SLICE_S = 6 * 3600
_LIMIT = np.array([HEALTHY_S, GRACE_S, RETRY_S])


class States:
    """Many states side by side: mode, rank of the current source, bits of warm and of tried ranks, seconds in the mode."""

    def __init__(self, mode, current, warm, tried, age, n: int):
        self.mode, self.current, self.warm, self.tried, self.age = (np.asarray(x, np.int64) for x in (mode, current, warm, tried, age))
        self.n = n

    @classmethod
    def every(cls, n: int, failing: bool) -> States:
        """All states that n sources can be in, and some more; without failures none is tried.

        What ranks above the current source is warm or tried, and all are once they are exhausted.
        """
        rows = []
        for current, warm, tried in itertools.product(range(n), range(1 << n), range(1 << n if failing else 1)):
            blocked, above = warm | tried, (1 << current) - 1
            modes = [m for m in (ACTIVE, DEGRADED) if not blocked >> current & 1 and blocked & above == above] + [EXHAUSTED] * (blocked == (1 << n) - 1)
            rows += [(m, current, warm, tried, a) for m in modes for a in range(_LIMIT[m])]
        return cls(*np.array(rows).T, n)

    @classmethod
    def fresh(cls, n: int) -> States:
        return cls([ACTIVE], [0], [0], [0], [0], n)

    def numbers(self) -> np.ndarray:
        """Each state as one number, which tells it from all others."""
        return (((self.mode * self.n + self.current << self.n | self.warm) << self.n) | self.tried) * (int(_LIMIT.max()) + 1) + self.age

    def take(self, at: np.ndarray) -> States:
        return States(self.mode[at], self.current[at], self.warm[at], self.tried[at], self.age[at], self.n)

    def _switch(self, at: np.ndarray) -> None:
        """The next source in order that is neither warm nor tried takes over, or all are exhausted."""
        blocked = self.warm[at] | self.tried[at]
        free = (blocked[:, None] >> np.arange(self.n) & 1) == 0
        some = free.any(1)
        self.mode[at] = np.where(some, ACTIVE, EXHAUSTED)
        self.current[at] = np.where(some, free.argmax(1), self.current[at])
        self.age[at] = 0

    def wait(self, seconds: int) -> None:
        """Time passes, and what falls due comes about in order; a mode ends when its last second does."""
        # In silence each source has its turn, then comes a fresh start, which any state has come to after one round.
        round_ = self.n * (HEALTHY_S + GRACE_S) + RETRY_S
        left = np.full(len(self.mode), seconds if seconds <= round_ else round_ + (seconds - round_) % round_, np.int64)
        while True:
            due = _LIMIT[self.mode] - self.age
            over = np.flatnonzero(left >= due)
            if not len(over):
                break
            left[over] -= due[over]
            mode = self.mode[over]
            self.age[over] = 0
            self.mode[over[mode == ACTIVE]] = DEGRADED
            gone = over[mode == DEGRADED]
            self.warm[gone] |= 1 << self.current[gone]
            anew = over[mode == EXHAUSTED]
            self.warm[anew] = self.tried[anew] = 0
            self._switch(np.concatenate([gone, anew]))
        self.age += left

    def frame(self, rank: int) -> None:
        """A frame of a source came."""
        own = (self.current == rank) & (self.mode != EXHAUSTED)
        back = (self.warm >> rank & 1 == 1) & (rank < self.current)
        at = np.flatnonzero(back)
        self.warm[at] = self.warm[at] & ~(1 << rank) | 1 << self.current[at]
        self.tried[at] &= ~(1 << rank)
        self.current[at] = rank
        self.mode[own | back], self.age[own | back] = ACTIVE, 0

    def failure(self, rank: int) -> None:
        """A source failed: if it is current the next one takes over, if it is warm it can't come back by itself."""
        own = np.flatnonzero((self.current == rank) & (self.mode != EXHAUSTED))
        warm = np.flatnonzero(self.warm >> rank & 1 == 1)
        self.warm[warm] &= ~(1 << rank)
        self.tried[warm] |= 1 << rank
        self.tried[own] |= 1 << rank
        self._switch(own)


def _events(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "rank", "failed")), strict=True)


def _happened(states: States, waited: int, rank: int, failed: bool) -> None:
    states.wait(waited)
    if rank >= 0:
        (states.failure if failed else states.frame)(rank)


def _maps(n: int, failing: bool, slice_s: int):
    """For each slice the state, as a number, that every state at its start has come to at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = States.every(n, failing)
        now = states = back = at = None

        def ended():
            states.wait((now + 1) * slice_s - at)
            # Most states have met by now, so the numbers pack well.
            ends = zlib.compress(states.numbers()[back].tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ends], pa.binary())], ["slice", "ends"])

        for batch in batches:
            for s, t, rank, failed in _events(batch):
                if s != now:
                    if now is not None:
                        yield ended()
                    now, at, states, back = s, s * slice_s, every.take(np.arange(len(every.mode))), np.arange(len(every.mode))
                _happened(states, t - at, rank, failed)
                at = t
                if len(states.mode) > 1:  # states that have met stay together
                    _, first, same = np.unique(states.numbers(), return_index=True, return_inverse=True)
                    if len(first) < len(states.mode):
                        states, back = states.take(first), same[back]
        if now is not None:
            yield ended()

    return run


def _starts(n: int, failing: bool):
    """The state in which each slice starts: the maps one after another, with silence where slices have no events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = States.every(n, failing)
        number = every.numbers()
        order = np.argsort(number)
        state, next_ = States.fresh(n), 0
        for batch in batches:
            out = []
            for k, s in enumerate(batch.column("slice").to_pylist()):
                state.wait((s - next_) * batch.column("slice_s")[k].as_py())
                own = order[np.searchsorted(number[order], state.numbers()[0])]
                out.append((s, int(number[own])))
                ends = np.frombuffer(zlib.decompress(batch.column("ends")[k].as_py()), np.int64)
                state, next_ = every.take(order[np.searchsorted(number[order], ends[[own]])]), s + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in (0, 1)], ["slice", "start"])

    return run


def _replay(n: int, failing: bool, slice_s: int):
    """(at, mode, rank) of each second with events, after all of them; a slice's start comes as a row of its own before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = States.every(n, failing)
        number = every.numbers()
        state = at = held = None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["at", "mode", "rank"])

        for batch in batches:
            out = []
            for (s, t, rank, failed), start in zip(_events(batch), batch.column("start").to_pylist(), strict=True):
                if held is not None and (start is not None or t != at):
                    out.append(held)
                    held = None
                if start is not None:
                    state, at = every.take(np.flatnonzero(number == start)), s * slice_s
                    continue
                _happened(state, t - at, rank, failed)
                at, held = t, (t, int(state.mode[0]), int(state.current[0]))
            yield table(out)
        if held is not None:
            yield table([held])

    return run


def active_seconds(events: DataFrame, asked: DataFrame | None = None, priority: tuple[int, ...] = PRIORITY, slice_s: int = SLICE_S) -> DataFrame:
    """(t_s, mode, active) of each second with events (t_s, seq, source_id, failed), or in ``asked`` (t_s): what is trusted after it.

    ``mode`` is active, degraded or exhausted, and active is null while all sources are. The automaton starts with the first event; ones of
    sources that aren't in ``priority`` don't count.
    """
    n = len(priority)
    rank = F.array_position(F.array(*(F.lit(s).cast("long") for s in priority)), F.col("source_id").cast("long")) - 1
    first = events.where(F.col("t_s").isNotNull()).select("t_s", "seq", rank.alias("rank"), F.coalesce("failed", F.lit(False)).alias("failed")).where("rank >= 0")
    first = landed(first.groupBy("t_s", "rank", "failed").agg(F.min("seq").alias("seq")))
    start, failing = first.agg(F.min("t_s"), F.max("failed")).first()
    empty = "t_s long, mode string, active long"
    if start is None:
        return events.sparkSession.createDataFrame([], empty)
    rows = first.withColumn("at", (F.col("t_s") - start).cast("long")).withColumn("slice", F.floor(F.col("at") / slice_s)).select("slice", "at", F.col("rank").cast("int").alias("rank"), "failed", "seq")
    asks = (asked if asked is not None else events.limit(0)).select((F.col("t_s") - start).cast("long").alias("at")).where("at >= 0").distinct()
    asks = asks.select(F.floor(F.col("at") / slice_s).alias("slice"), "at", F.lit(-1).alias("rank"), F.lit(False).alias("failed"), F.lit((1 << 63) - 1).alias("seq"))
    rows = rows.withColumn("seq", F.col("seq").cast("long")).unionByName(asks)
    dealt = rows.repartition("slice").sortWithinPartitions("slice", "at", "seq")
    maps = landed(dealt.mapInArrow(_maps(n, failing, slice_s), "slice long, ends binary"))
    starts = maps.withColumn("slice_s", F.lit(slice_s).cast("long")).repartition(1).sortWithinPartitions("slice").mapInArrow(_starts(n, failing), "slice long, start long")
    marks = landed(starts).select("slice", F.lit(-1).cast("long").alias("at"), "start")
    both = rows.withColumn("start", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    told = both.repartition("slice").sortWithinPartitions("slice", "at", "seq").mapInArrow(_replay(n, failing, slice_s), "at long, mode long, rank long")
    names = F.array(*map(F.lit, ("active", "degraded", "exhausted")))
    sources = F.array(*(F.lit(s).cast("long") for s in priority))
    return told.select((F.col("at") + start).alias("t_s"), F.get(names, F.col("mode").cast("int")).alias("mode"), F.when(F.col("mode") != EXHAUSTED, F.get(sources, F.col("rank").cast("int"))).alias("active"))


def trusted(frames: DataFrame, priority: tuple[int, ...] = PRIORITY, slice_s: int = SLICE_S) -> DataFrame:
    """frames (t_s, seq, source_id, reason) with ``mode``, ``active`` and ``trusted``: whether a frame came from the active source.

    Accepted frames, those without a reason, are the proof that a source lives. Before the first of them nothing is trusted.
    """
    alive = active_seconds(frames.where("reason IS NULL").withColumn("failed", F.lit(False)), frames, priority, slice_s)
    states = frames.join(alive, "t_s", "left")
    return states.withColumn("trusted", F.coalesce(F.col("active") == F.col("source_id"), F.lit(False)))
