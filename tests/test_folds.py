"""Recurrences against plain Python steps over the same rows."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seamark.operators import geo, quality, tracks
from seamark.sources import fixtures


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    by = defaultdict(list)
    for r in fixtures.positions(spark, sf_dir).collect():
        by[r["mmsi"]].append(r)
    return {k: sorted(v, key=lambda r: (r["t_s"], r["seq"])) for k, v in by.items()}


def test_rate_limit(spark, sf_dir, rows):
    fast = fixtures.positions(spark, sf_dir).withColumn("t_s", F.floor(F.col("t_s") / 15))
    got = {r["seq"]: r["accepted"] for r in tracks.rate_limit(fast).collect()}
    n = 0
    for track in rows.values():
        tokens, last = 5.0, None
        for t, seq in sorted((r["t_s"] // 15, r["seq"]) for r in track):
            tokens = min(5.0, tokens + (t - (last if last is not None else t)))
            ok, last = tokens >= 1, t
            tokens -= ok
            n += not ok
            assert got[seq] == ok
    assert n > 0


def test_trail_outliers(spark, sf_dir, rows):
    got = {r["seq"]: r["accepted"] for r in tracks.trail_outliers(fixtures.positions(spark, sf_dir)).collect()}
    rejected = 0
    for track in rows.values():
        last = before = None
        for r in (r for r in track if r["lng"] is not None):
            if before is not None and r["t_s"] - before > 600:
                last = None
            before, ok = r["t_s"], True
            if last is not None and r["t_s"] > last["t_s"]:
                east = (r["lng"] - last["lng"]) * 111_000 * math.cos(math.radians((r["lat"] + last["lat"]) / 2))
                ok = math.hypot(east, (r["lat"] - last["lat"]) * 111_000) <= 60 * 0.5144 * (r["t_s"] - last["t_s"]) + 75
            if ok:
                last = r
            rejected += not ok
            assert got[r["seq"]] == ok
    assert rejected > 0


def test_kalman(spark, sf_dir, rows):
    """Against a full 4 x 4 filter in numpy."""
    import numpy as np

    got = {r["seq"]: r for r in tracks.kalman(fixtures.positions(spark, sf_dir)).collect()}
    for track in list(rows.values())[:4]:
        x = p = last = None
        for r in (r for r in track if r["lng"] is not None):
            z = np.array([r["lng"], r["lat"]])
            if x is None:
                x, p = np.array([*z, 0, 0]), np.diag([9e-4**2] * 2 + [1e-5**2] * 2)
            else:
                dt = max(0, min(r["t_s"] - last, 60))
                f = np.eye(4)
                f[0, 2] = f[1, 3] = dt
                g = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
                x, p = f @ x, f @ p @ f.T + 9e-7**2 * g @ g.T
                h = np.eye(2, 4)
                k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 9e-5**2 * np.eye(2))
                x, p = x + k @ (z - h @ x), (np.eye(4) - k @ h) @ p
            last = r["t_s"]
            out = got[r["seq"]]
            assert np.allclose([out["lng"], out["lat"], out["vlng"], out["vlat"]], x, rtol=1e-9, atol=1e-12)


def test_dwell(spark, sf_dir, rows):
    """Enter, exit and silence against a state machine per vessel and zone."""
    zones = fixtures.zones(spark)
    p = fixtures.positions(spark, sf_dir)
    inside = {(r["seq"], r["zone_id"]) for r in geo.membership(p, geo.operational(zones)).collect()}
    want = set()
    for mmsi, track in rows.items():
        for zone in {z for s, z in inside if s in {r["seq"] for r in track}}:
            told, run, since, last = False, None, None, None
            for r in (r for r in track if r["lng"] is not None):
                if last is not None and r["t_s"] - last >= 600:
                    if told:
                        want.add(("ghost-exit", mmsi, zone, last + 600))
                    told, run = False, None
                last, now = r["t_s"], (r["seq"], zone) in inside
                if now != run:
                    run, since = now, r["t_s"]
                if now != told and r["t_s"] - since >= 30:
                    told = now
                    want.add(("enter" if now else "exit", mmsi, zone, r["t_s"]))
    got = {(r["kind"], r["mmsi"], r["zone_id"], r["at_s"]) for r in geo.geofence_events(p, zones).collect()}
    assert got == want and len(got) > 10


def test_grid_join_equals_broadcast(spark, sf_dir, monkeypatch):
    p, zones = fixtures.positions(spark, sf_dir), fixtures.zones(spark)
    small = {(r["seq"], r["zone_id"]) for r in geo.membership(p, zones).collect()}
    monkeypatch.setattr(geo, "BROADCAST_BYTES", 0)
    assert {(r["seq"], r["zone_id"]) for r in geo.membership(p, zones).collect()} == small


def test_evict_policy_and_zone_checks(spark, sf_dir):
    p, zones = fixtures.positions(spark, sf_dir), fixtures.zones(spark)
    kinds = {r["kind"] for r in geo.geofence_events(p, zones, silence_policy="evict").collect()}
    assert kinds == {"enter", "exit"}
    assert {r["check"]: r["failures"] for r in geo.zone_problems(zones).collect()} == {"pipe_in_id": 0, "too_many": 0, "too_long": 0}
    added = zones.limit(1).withColumn("id", F.lit("x|y"))
    edited = geo.edited_zones(zones, added=added, deleted=zones.where("id = 'A'"))
    assert {r["id"] for r in edited.collect()} == {"x|y", "B", "C", "D", "E"}
    assert {r["check"]: r["failures"] for r in geo.zone_problems(edited).collect()}["pipe_in_id"] == 1


@pytest.mark.parametrize("round_rows", [100, quality.ROUND_ROWS])
def test_admission_tries_again(spark, sf_dir, rows, round_rows):
    """Against one bucket over all frames: vessels beyond the burst get in as it refills, whatever the rounds."""
    got = {r["seq"]: r["admitted"] for r in quality.admitted_by_bucket(fixtures.positions(spark, sf_dir), burst=3, per_minute=2, round_rows=round_rows).collect()}
    tokens, last, known, late = 3 * 60, None, set(), 0
    for t, seq, mmsi in sorted((r["t_s"], r["seq"], r["mmsi"]) for track in rows.values() for r in track):
        tokens, last = min(3 * 60, tokens + (t - (last if last is not None else t)) * 2), t
        if mmsi not in known and tokens >= 60:
            tokens -= 60
            late += any(got[r["seq"]] is False for r in rows[mmsi])
            known.add(mmsi)
        assert got[seq] == (mmsi in known)
    assert known == set(rows) and late > 0 and len(got) == sum(map(len, rows.values()))


@pytest.mark.parametrize("operator", [tracks.rate_limit, tracks.trail_outliers, tracks.kalman])
def test_a_vessel_on_air_without_a_break(spark, operator):
    """One vessel's unbroken 200,000 fixes, dealt over many partitions, without gathering them in a row."""
    fixes = spark.range(0, 200_000, 1, 8).select(F.lit(261000001).alias("mmsi"), (F.col("id") + 1704067200).alias("t_s"), F.col("id").alias("seq"), F.lit(14.5).alias("lng"), F.lit(53.4).alias("lat"))
    got = operator(fixes)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert got.agg(F.count("*"), F.countDistinct("seq")).first() == (200_000, 200_000)


@pytest.mark.parametrize("metres", [1000.0, 5000.0])
def test_nearby_pairs_anywhere(spark, metres):
    """Against every pair: at all latitudes, across the 180th meridian and around the poles."""
    import random

    draw, spots = random.Random(7), []
    for lat in (0.0, 53.0, -64.0, 75.0, 85.0, 89.5, 89.99, -89.995):
        for lng in (14.5, 179.99, -180.0):
            for _ in range(12):
                east = draw.uniform(-0.1, 0.1) / max(math.cos(math.radians(lat)), 1e-3)
                spots.append(((lng + east + 180) % 360 - 180, max(-90.0, min(90.0, lat + draw.uniform(-0.05, 0.05)))))
    fixes = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(spots)], "mmsi int, lng double, lat double")
    want = set()
    for a, (x, y) in enumerate(spots):
        for b, (u, v) in enumerate(spots[a + 1 :], a + 1):
            h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
            if 2 * 6_371_008.8 * math.asin(math.sqrt(h)) <= metres:
                want.add((a, b))
    got = [(r["a"], r["b"]) for r in geo.nearby_pairs(fixes, metres).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_nearby_pairs_of_a_crowd(spark):
    """Of vessels in one spot every pair comes once, and no task has most of them."""
    crowd = spark.range(0, 2500, 1, 1).selectExpr("CAST(id AS INT) AS mmsi", "14.5 + id * 1e-7 AS lng", "53.405 AS lat")
    tasks = geo.nearby_pairs(crowd, 1000.0).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("a", "b").alias("pairs")).collect()
    assert sum(r["n"] for r in tasks) == sum(r["pairs"] for r in tasks) == 2500 * 2499 // 2
    assert max(r["n"] for r in tasks) < 0.7 * 2500 * 2499 // 2


def test_round_ends(spark):
    df = spark.createDataFrame([(t,) for t in [5] * 9 + [6, 7, 4000, 4001]], "t_s long")
    assert quality._until(df, 100) == 4001 and quality._until(df, 3, 4) == 5 and 7 <= quality._until(df, 11, 4) < 4000
    assert quality._until(df.limit(0), 3) is None


def test_admission_of_a_crowd(spark):
    """Thousands of ids in one second: the bucket admits its burst, and a round carries no more of them than can matter."""
    crowd = spark.range(3000).selectExpr("id AS mmsi", "100 + id DIV 1500 AS t_s", "id AS seq")
    got = quality.admitted_by_bucket(crowd, burst=7, per_minute=60, round_rows=50)
    assert sorted(r["seq"] for r in got.where("admitted").collect()) == [*range(7), 1500]
