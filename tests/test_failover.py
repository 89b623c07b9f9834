"""The failover automaton against one that goes event by event, over random outages and failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.operators import failover

PRIORITY = (3, 2, 0, 1)


def _slow(events, asked):
    """{second: (mode, source)} by definition; events: (t, rank, failed) in order."""
    n = len(PRIORITY)
    mode, cur, warm, tried, since = "active", 0, set(), set(), events[0][0]
    out = {}

    def switch(t):
        nonlocal mode, cur, since
        free = [r for r in range(n) if r not in warm and r not in tried]
        mode, since = ("active", t) if free else ("exhausted", t)
        cur = free[0] if free else cur

    def pass_time(t):
        nonlocal mode, since
        while since + {"active": 300, "degraded": 600, "exhausted": 60}[mode] <= t:
            if mode == "active":
                mode, since = "degraded", since + 300
            elif mode == "degraded":
                warm.add(cur)
                switch(since + 600)
            else:
                warm.clear()
                tried.clear()
                switch(since + 60)

    todo = sorted([(t, 0, k, r, f) for k, (t, r, f) in enumerate(events)] + [(t, 1, 0, None, None) for t in asked if t >= events[0][0]])
    for t, _, _, r, failed in todo:
        pass_time(t)
        if r is not None and not failed:
            if r == cur and mode != "exhausted":
                mode, since = "active", t
            elif r in warm and r < cur:
                warm.discard(r)
                tried.discard(r)
                warm.add(cur)
                mode, cur, since = "active", r, t
        elif r is not None:
            if r == cur and mode != "exhausted":
                tried.add(r)
                switch(t)
            elif r in warm:
                warm.discard(r)
                tried.add(r)
        out[t] = (mode, None if mode == "exhausted" else PRIORITY[cur])
    return out


@pytest.mark.parametrize("failing", [False, True])
def test_failover(spark, failing):
    rng = np.random.default_rng(4 + failing)
    events, t = [], 5000
    for stretch in range(25):
        live = [r for r in range(4) if rng.random() < 0.45]
        for _ in range(int(rng.integers(1, 40))):
            t += int(rng.choice([0, 1, 20, 250, 500, 901, 5000], p=[0.25, 0.25, 0.25, 0.14, 0.06, 0.04, 0.01]))
            if live:
                events.append((t, int(rng.choice(live)), False))
            if failing and rng.random() < 0.1:
                events.append((t, int(rng.integers(0, 4)), True))
        t += int(rng.choice([10, 950, 40_000]))
    # Of one second the first event of each source and kind counts.
    seen, first = set(), []
    for e in events:
        if e not in seen:
            seen.add(e)
            first.append(e)
    asked = sorted({int(x) for x in rng.integers(4000, t, 60)})
    want = _slow(first, asked)
    df = spark.createDataFrame([(t, k, PRIORITY[r], f) for k, (t, r, f) in enumerate(events)] + [(6000, 10**6, 9, False)], "t_s long, seq long, source_id int, failed boolean").repartition(5)
    ask = spark.createDataFrame([(a,) for a in asked], "t_s long")
    for slice_s in (3600,) if failing else (777, 10**7):
        got = {r["t_s"]: (r["mode"], r["active"]) for r in failover.active_seconds(df, ask, slice_s=slice_s).collect()}
        assert got == want
    assert {m for m, _ in want.values()} == {"active", "degraded", "exhausted"} and {s for _, s in want.values()} == {None, 0, 1, 2, 3}


def test_trusted_frames(spark):
    rows = [(100, 1, 3, None), (100, 2, 2, None), (150, 3, 3, "bad"), (1001, 4, 2, None), (1001, 5, 3, "bad"), (1100, 6, 3, None), (1100, 7, 2, None), (50, 8, 3, "bad")]
    got = failover.trusted(spark.createDataFrame(rows, "t_s long, seq long, source_id long, reason string"))
    # Source 3 is silent for 900 s after second 100; source 2 is current then, until 3 comes back.
    assert {r["seq"]: r["trusted"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: False}
    none = got.sparkSession.createDataFrame([], got.select("t_s", "seq", "source_id", "reason").schema)
    assert failover.trusted(none).count() == 0
    assert failover.active_seconds(none.withColumn("failed", F.lit(False))).count() == 0
