"""State operators and zone files on hand-made rows."""

import json

from pyspark.sql import functions as F

from seamark.operators import state
from seamark.sources import zones


def test_halves_come_together(spark):
    kind = "mmsi int, seq long, part int, vessel_name string, call_sign string, ship_type int, eta_month int, eta_day int, eta_hour int, eta_minute int"
    rows = [(1, 1, 0, "OLD", None, None, 1, 2, 3, 4), (1, 2, 1, None, "CALL", 70, None, None, None, None), (1, 3, 0, "  ", None, 0, 5, None, None, None), (2, 4, 1, None, " ", 0, None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = {r["mmsi"]: r for r in state.static_merge(df).collect()}
    assert (got[1]["vessel_name"], got[1]["call_sign"], got[1]["ship_type"]) == ("OLD", "CALL", 70)
    assert tuple(got[1]["eta"]) == (5, None, None, None) and got[2]["call_sign"] is None and got[2]["eta"] is None
    assert [r["vessel_name"] for r in state.static_history(df).where("mmsi = 1").orderBy("seq").collect()] == ["OLD"] * 3
    wire = {r["seq"]: r for r in state.wire_static(df.withColumns({s: F.lit(1) for s in state.SIZES})).collect()}
    assert wire[1]["vessel_name"] == "OLD" and wire[1]["ship_type"] is None and wire[2]["vessel_name"] == "" and wire[2]["to_bow"] == 1


def test_values(spark):
    c = F.col
    df = spark.createDataFrame([(5, 6, 1, 2, -128.0, 360), (6, 6, 1, 2, 127.0, 359), (None, 6, 1, 2, 127.5, 0)], "p long, s long, ps int, ss int, rot double, heading int")
    got = df.select(state.row_stamp(c("p"), c("s"), c("ps"), c("ss")).alias("r"), state.stored_turn(c("rot")).alias("rot"), state.stored_heading(c("heading")).alias("h")).collect()
    assert [(tuple(r["r"]), r["rot"], r["h"]) for r in got] == [((6, 2), None, None), ((6, 1), 127.0, 359), ((6, 2), None, 0)]


def test_zone_files(spark, tmp_path):
    ring = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    feature = lambda i: {"type": "Feature", "properties": {"id": i, "label": "Custom Zone 7", "kind": "general"}, "geometry": {"type": "Polygon", "coordinates": ring}}
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("a"), feature(None), feature("b")]}))
    got = zones.read(spark, str(tmp_path / "z.json"))
    assert {r["id"] for r in got.collect()} == {"a", "b"} and got.first()["rings"] == ring
    assert state.next_zone_number(got).first()["next"] == 8
    zones.write(got, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["geometry"]["coordinates"] == ring


def test_selection(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "mmsi int")
    ids = lambda x: sorted(r["mmsi"] for r in x.collect())
    assert ids(state.shown_trails(df, [1], None, True)) == [2, 3] and ids(state.shown_trails(df, [1], 2, False)) == [2] and ids(state.without(df, [3])) == [1, 2]
    watch = spark.createDataFrame([(2, "model")], "mmsi int, shape string")
    assert [(r["mmsi"], r["shape"]) for r in state.watched(df, watch).collect()] == [(2, "model")]
