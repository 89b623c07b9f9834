"""Recurrences cut into slices of time against the same steps one after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.operators import scans, tracks

FIXES = "mmsi long, t_s long, seq long, lng double, lat double"


@pytest.fixture(scope="module")
def walks(spark):
    """One vessel with most of the rows, others with a few; jumps, silences, equal times, rows without an id."""
    rng = np.random.default_rng(1)
    out, seq = [], 0
    for mmsi, n in [(1, 1500), (2, 200), (3, 40), (4, 1), (None, 30)]:
        t, at = 1_000_000 + 7 * (mmsi or 0), np.array([14.5, 53.4])
        for _ in range(n):
            t += int(rng.choice([0, 1, 2, 9, 30, 601, 4000], p=[0.2, 0.3, 0.2, 0.2, 0.08, 0.01, 0.01]))
            at = at + rng.normal(0, 2e-4, 2)
            jump = rng.random() < 0.1
            out.append((mmsi, t, seq, float(at[0] + jump * 0.2), float(at[1])))
            seq += 1
    return out


@pytest.fixture(scope="module")
def fixes(spark, walks):
    return spark.createDataFrame(walks, FIXES).repartition(6)


def _by_vessel(walks):
    for mmsi in {w[0] for w in walks}:
        yield mmsi, sorted((w[1:] for w in walks if w[0] == mmsi), key=lambda r: r[:2])


@pytest.mark.parametrize("slice_s", [60, 3600, 10**9])
def test_bucket(spark, walks, fixes, slice_s):
    want = {}
    for _, rows in _by_vessel(walks):
        state = None
        for t, seq, *_ in rows:
            state, (_, ok) = tracks.rate_step()(state, (t, seq))
            want[seq] = ok
    got = tracks.rate_limit(fixes, slice_s=slice_s)
    assert {r["seq"]: r["accepted"] for r in got.collect()} == want and {*want.values()} == {True, False}


@pytest.mark.parametrize("slice_s", [60, 3600])
def test_filter(spark, walks, fixes, slice_s):
    got = {r["seq"]: r for r in tracks.kalman(fixes, slice_s=slice_s).collect()}
    for _, rows in _by_vessel(walks):
        state = None
        for row in rows:
            state, (seq, *want) = tracks.kalman_step(state, row)
            assert np.allclose([got[seq][c] for c in ("lng", "lat", "vlng", "vlat", "p00", "p01", "p11")], want, rtol=1e-9, atol=1e-13)
    assert len(got) == len(walks)


@pytest.mark.parametrize("slice_s", [60, 3600])
def test_trail(spark, walks, fixes, slice_s):
    got = {r["seq"]: (r["session"], r["accepted"]) for r in tracks.trail_outliers(fixes.where("mmsi IS NOT NULL"), slice_s=slice_s).collect()}
    for mmsi, rows in _by_vessel(walks):
        state, session, before = None, 0, None
        for t, seq, lng, lat in rows if mmsi else ():
            session += before is not None and t - before > 600
            before = t
            state, out = tracks.outlier_step(state, (session, t, seq, lng, lat))
            assert got[seq] == (session, out[-1])
    assert {a for _, a in got.values()} == {True, False}


def test_ends_that_never_settle(spark):
    """A sum forgets nothing: each slice's end depends on all before it, and the result is still exact."""
    df = spark.createDataFrame([(1, t, t) for t in range(40)], "k int, t_s long, seq long")
    got = scans.in_slices(df, ["k"], ["seq"], lambda s, r: (((s or (0,))[0] + r[0],), (r[0], (s or (0,))[0] + r[0])), "total long", "seq long, total long", slice_s=5)
    assert {r["seq"]: r["total"] for r in got.collect()} == {t: t * (t + 1) // 2 for t in range(40)}


def test_one_vessel_is_many_tasks(spark, fixes):
    """The rows of the vessel with most rows are spread over partitions by slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be put together again
    try:
        own, marks = scans.sliced(fixes, ["mmsi"], "t_s", ["seq"], ("t_s", "seq"), 600)
        tasks = scans._dealt(own, marks, ["mmsi"]).where("mmsi = 1 AND NOT __mark").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 0.6 * 1500


@pytest.mark.parametrize("slice_s", [60, 3600])
def test_sessions(spark, walks, fixes, slice_s):
    for inclusive in (False, True):
        got = {r["seq"]: r["session"] for r in tracks.sessions(fixes.where("mmsi IS NOT NULL"), 601, inclusive, slice_s).collect()}
        for mmsi, rows in _by_vessel(walks):
            session, before = 0, None
            for t, seq, *_ in rows if mmsi else ():
                session += before is not None and (t - before >= 601 if inclusive else t - before > 601)
                before = t
                assert got[seq] == session


def test_rows_are_made_once(spark, fixes):
    """What comes before the slices is not made again by each use of the rows."""
    made, n = spark.sparkContext.accumulator(0), fixes.count()
    counted = fixes.mapInArrow(lambda batches: (made.add(b.num_rows) or b for b in batches), FIXES)
    got = scans.in_slices(counted, ["mmsi"], ["seq"], lambda s, r: (r, r), "last long", "seq long", slice_s=3600)
    assert got.count() == n == made.value


def test_empty(spark):
    none = spark.createDataFrame([], FIXES)
    assert [f(none).count() for f in (tracks.rate_limit, tracks.kalman, tracks.trail_outliers)] == [0, 0, 0]
