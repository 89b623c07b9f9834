"""Feeds, the ordered gates, and small zone and vessel reads on hand-made rows."""

from pyspark.sql import functions as F

from seamark.operators import feeds, geo, reads
from seamark.sources import fixtures


def test_json_kinds_and_rejects(spark):
    raw = [
        '{"Message": {"PositionReport": {"UserID": 211000001, "Sog": "12", "Cog": 360, "Latitude": 91, "Longitude": 181, "TrueHeading": 511, "RateOfTurn": -128, "PositionAccuracy": 1, "Timestamp": 63}}}',
        '{"Message": {"StandardClassBPositionReport": {"Sog": 102.3, "Cog": 12.34, "Latitude": 53.5, "Longitude": 14.5, "TrueHeading": 12.7}}, "MetaData": {"MMSI": 211000002}}',
        '{"Message": {"PositionReport": {}, "ShipStaticData": {"UserID": 1}}, "MetaData": {}}', '{"Message": {"Other": {}}, "MetaData": {"MMSI": 1}}', '{"MetaData": {}}', "{", None,
        '{"Message": {"ShipStaticData": {"UserID": 211000003, "Name": " A ", "ImoNumber": 0, "Dimension": {"A": 0}, "MaximumStaticDraught": 0}}}',
        '{"Message": {"StaticDataReport": {"UserID": 211000004, "PartNumber": true, "ReportA": {"Name": "B"}, "ReportB": {"CallSign": "C", "ShipType": 36}}}}',
    ]
    got = [r.asDict(True) for r in feeds.adapted(spark.createDataFrame(list(enumerate(raw)), "k int, raw string")).orderBy("k").collect()]
    assert [r["outcome"] for r in got] == ["accepted", "accepted", "missing-mmsi", "unsupported-type", "missing-message", "parse-error", "parse-error", "accepted", "accepted"]
    assert [r["message_type"] for r in got] == [1, 18, None, None, None, None, None, 5, 24]
    a, b = got[0]["position"], got[1]["position"]
    assert (a["lng"], a["lat"], a["sog_t"], a["cog_t"], a["heading"], a["rot"], a["accurate"], a["second"]) == (None, None, None, None, None, None, False, 63)
    assert (b["lng"], b["sog_t"], b["cog_t"], b["heading"], b["nav_status"]) == (14.5, None, 123, 12, None) and got[1]["mmsi"] == 211000002
    assert (got[7]["static"]["vessel_name"], got[7]["static"]["imo"], got[7]["static"]["to_bow"], got[7]["static"]["draught_t"]) == ("A", 0, 0, 0)
    assert (got[8]["static"]["part"], got[8]["static"]["vessel_name"], got[8]["static"]["call_sign"], got[8]["static"]["ship_type"]) == (1, "B", "C", 36)


def test_gate_chain_against_a_fold(spark):
    """Frame by frame: a vessel becomes known at the new-vessel gate even if its rate rejects the frame."""
    rows = [(k, 261_000_000 + k % 7, k // 4, 0, 1, 0, 10, 0, 0, 14.5, 53.4 if k % 11 else 95.0) for k in range(200)]
    got = feeds.gate_chain(spark.createDataFrame(rows, "seq long, mmsi long, t_s long, source_id long, msg_type int, nav_status int, sog_t long, cog_t long, heading long, lng double, lat double"), burst=2, per_minute=6)
    tokens, last, known, own, want = 2 * 60, 0, set(), {}, {}
    for seq, mmsi, t, *_, lat in rows:
        if lat > 90:
            want[seq] = "lat-out-of-range"
            continue
        if mmsi not in known:
            tokens, last = min(120, tokens + (t - last) * 6), t
            if tokens < 60:
                want[seq] = "new-vessel-limited"
                continue
            tokens -= 60
            known.add(mmsi)
        have, at = own.get(mmsi, (5, t))
        have = min(5, have + t - at)
        want[seq] = None if have >= 1 else "rate-limited"
        own[mmsi] = (have - 1 if have >= 1 else have, t)
    assert {r["seq"]: r["reason"] for r in got.collect()} == want


def test_zone_reads(spark):
    zones = fixtures.zones(spark)
    assert [(r["kind"], r["n"]) for r in geo.zone_counts(zones).collect()] == [("port", 1), ("anchorage", 1), ("general", 3)]
    drawn = geo.with_defaults(zones.where("id < 'C'").select("id", "rings"), 4).orderBy("id").collect()
    assert [(r["label"], r["kind"]) for r in drawn] == [("Custom Zone 4", "general"), ("Custom Zone 5", "general")]
    frames = feeds.static_frames(spark.createDataFrame([('{"type": "static", "mmsi": 5, "name": "A"}',), ('{"type": "other", "mmsi": 5}',), ('{"type": "static", "mmsi": "x"}',), ("{",), (None,)], "raw string"))
    assert [r["frame"]["mmsi"] if r["frame"] else None for r in frames.collect()] == [5, None, None, None, None]


def test_one_vessel(spark, sf_dir):
    statics, positions = fixtures.statics(spark, sf_dir), fixtures.positions(spark, sf_dir)
    mmsi = positions.join(statics, "mmsi", "left_semi").agg(F.min("mmsi")).first()[0]
    got = reads.vessel(statics, positions, mmsi).collect()
    assert [r["mmsi"] for r in got] == [mmsi] and got[0]["last_seen_s"] is not None
    assert reads.vessel(statics, positions, -1).count() == 0
