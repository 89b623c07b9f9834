"""Zone cells and dwell runs against definitions, on random shapes and walks."""

import collections
import math

import numpy as np
import pytest

from seamark.operators import geo

ZONE = "id string, label string, kind string, visible boolean, decorative boolean, rings array<array<array<double>>>"


def _in_rings(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return odd and min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)


def _star(rng, x, y, size, n):
    """A concave ring of n corners."""
    at = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = size * rng.uniform(0.3, 1, n)
    return [[float(x + a * math.cos(t)), float(y + a * math.sin(t))] for a, t in zip(r, at, strict=True)]


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(7)
    out = {"coast": [_star(rng, 14.5, 53.4, 0.6, 300)], "continent": [_star(rng, 20, 40, 35, 120), _star(rng, 20, 40, 3, 50)], "speck": [_star(rng, 14.4, 53.3, 1e-5, 5)], "point": [[[14.0, 53.0]] * 3]}
    return out | {f"z{k}": [_star(rng, rng.uniform(13, 16), rng.uniform(52, 55), rng.uniform(0.01, 0.4), int(rng.integers(3, 40)))] for k in range(20)}


@pytest.mark.parametrize("most_edges, broadcast", [(16, True), (3, False), (10_000, True)])
def test_membership(spark, shapes, monkeypatch, most_edges, broadcast):
    if not broadcast:
        monkeypatch.setattr(geo, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(8)
    points = [(k, 1, float(x), float(y)) for k, (x, y) in enumerate(np.column_stack([rng.uniform(12.9, 16.1, 1500), rng.uniform(51.9, 55.1, 1500)]))]
    points += [(5000 + k, 1, float(x), float(y)) for k, (x, y) in enumerate(np.column_stack([rng.uniform(-180, 180, 500), rng.uniform(-91, 91, 500)]))]
    points += [(6000 + k, 1, float(14.4 + a), float(53.3 + b)) for k, (a, b) in enumerate(rng.uniform(-1e-5, 1e-5, (100, 2)))]
    points += [(7000, 1, None, 53.0), (7001, 1, float("nan"), 53.0), (7002, 1, 180.0, 90.0)]
    zones = spark.createDataFrame([(i, i, "port", True, False, r) for i, r in shapes.items()] + [("none", "", "", True, False, None), ("empty", "", "", True, False, [])], ZONE)
    fixes = spark.createDataFrame(points, "seq long, mmsi long, lng double, lat double")
    got = collections.Counter((r["seq"], r["zone_id"]) for r in geo.membership(fixes, zones, most_edges).collect())
    want = {(s, i) for s, _, x, y in points if x is not None and x == x for i, rings in shapes.items() if _in_rings(x, y, rings)}
    assert set(got) == want and set(got.values()) == {1} and len({i for _, i in want}) > 15


def test_cells_are_few(spark, shapes):
    """A zone's cells grow with its outline, not with its area; whole cells need no edges."""
    zones = spark.createDataFrame([(i, i, "port", True, False, shapes[i]) for i in ("coast", "continent", "speck")], ZONE)
    cells = geo.zone_cells(zones).groupBy("zone_id").count().collect()
    assert {r["zone_id"]: r["count"] < 4000 for r in cells} == {"coast": True, "continent": True, "speck": True}
    inner = geo.zone_cells(zones, most_edges=1).where("inside AND size(edges) = 0 AND zone_id = 'continent'").count()
    assert inner > 10


def test_no_nested_loop(spark, shapes, monkeypatch):
    zones = spark.createDataFrame([(i, i, "port", True, False, r) for i, r in shapes.items()], ZONE)
    fixes = spark.createDataFrame([(1, 1, 14.5, 53.4)], "seq long, mmsi long, lng double, lat double")
    assert "NestedLoop" not in geo.membership(fixes, zones)._jdf.queryExecution().toString()


def _dwell(track, inside, dwell=30, silence=600):
    """(kind, at) of one vessel and zone by a machine that goes fix by fix."""
    out, told, run, since, last = [], False, None, None, None
    for t, _, x, y in track:
        here = inside(x, y)
        if last is not None and t - last >= silence:
            if told:
                out.append(("ghost-exit", last + silence))
            told, run = False, None
        if here != run:
            run, since = here, t
        if here != told and t - since >= dwell:
            told = here
            out.append(("enter" if here else "exit", t))
        last = t
    return out


@pytest.mark.parametrize("slice_s", [90, 6 * 3600])
def test_dwell(spark, slice_s):
    """Walks over a border, some with many fixes a second or equal times, cut into slices shorter than a stay."""
    rng = np.random.default_rng(3)
    rows, seq = [], 0
    for mmsi in range(6):
        t, x = 10_000 * (mmsi + 1), 0.0
        for _ in range(250):
            t += int(rng.choice([0, 1, 7, 12, 29, 31, 599, 600, 900], p=[0.1, 0.2, 0.3, 0.2, 0.08, 0.06, 0.02, 0.02, 0.02]))
            x = float(np.clip(x + rng.normal(0, 0.4), -3, 3))
            rows.append((mmsi, t, seq, x, 0.25))
            seq += 1
    zones = {"east": [[[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [0.0, 1.0]]], "strip": [[[-0.5, 0.0], [0.5, 0.0], [0.5, 1.0], [-0.5, 1.0]]]}
    df = spark.createDataFrame(rows, "mmsi long, t_s long, seq long, lng double, lat double").repartition(5)
    table = spark.createDataFrame([(i, i, "port", True, False, r) for i, r in zones.items()], ZONE)
    want = collections.Counter()
    for mmsi in range(6):
        track = sorted((t, s, x, y) for m, t, s, x, y in rows if m == mmsi)
        for i, rings in zones.items():
            want.update((k, mmsi, i, at) for k, at in _dwell(track, lambda x, y: _in_rings(x, y, rings)))  # noqa: B023
    got = collections.Counter((r["kind"], r["mmsi"], r["zone_id"], r["at_s"]) for r in geo.geofence_events(df, table, slice_s=slice_s).collect())
    assert got == want and {k for k, *_ in want} == {"enter", "exit", "ghost-exit"}
