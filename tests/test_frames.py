"""Sentences, JSON messages, reassembly and packed frames on hand-made rows."""

import math

from pyspark.sql import functions as F

from seamark.operators import frames, quality
from seamark.sources import sinks
from seamark.streaming.reassembly import step


def _sum(body):
    total = 0
    for c in body:
        total ^= ord(c)
    return f"!{body}*{total:02X}"


def test_first_reasons(spark):
    good = "AIVDM,1,1,,A,15M67F0000G?Uf6E`FepT@3n0000,0"
    rows = {
        _sum(good): None, "": "checksum-no-start", "abc": "checksum-no-start", "!" + good: "checksum-no-marker", "!" + good + "*G1": "checksum-malformed", "!" + good + "*00": "checksum-mismatch",
        "$" + _sum(good)[1:]: "parse-error", _sum("AIVDM,1,1,,A,15M"): "envelope-fields", _sum("XXVDM,1,1,,A,15M,0"): "envelope-tag", _sum("AIVDM,0,1,,A,15M,0"): "envelope-fragments",
        _sum("AIVDM,1,2,,A,15M,0"): "envelope-fragment", _sum("AIVDM,1,1,,A,15M,6"): "envelope-fill", _sum("AIVDM,1x,1,,A,15M,0"): None,
    }
    df = spark.createDataFrame([(k, 0, 0, r) for k, r in enumerate(rows)], "seq long, t_s long, source_id int, raw string")
    assert {r["raw"]: r["reason"] for r in frames.enveloped(df).collect()} == rows


def test_public_example(spark):
    """A position report that is widely used as an example."""
    raw = "!AIVDM,1,1,,B,177KQJ5000G?tO`K>RA1wUbN0TKH,0*5C"
    df = spark.createDataFrame([(1, 0, 0, raw)], "seq long, t_s long, source_id int, raw string")
    r = frames.decoded(df).first()
    assert (r["mmsi"], r["nav_status"], r["sog_t"], r["cog_t"], r["heading"]) == (477553000, 5, 0, 510, 181)
    assert math.isclose(r["lng_600k"] / 600000, -122.345833, abs_tol=1e-5) and math.isclose(r["lat_600k"] / 600000, 47.582833, abs_tol=1e-5)


def test_json_is_strict(spark):
    rows = ['{"Message": {"PositionReport": {"UserID": "12", "Sog": "3"}}, "MetaData": {"MMSI": 261000001}}', '{"Message": {"PositionReport": {"UserID": 261000002, "Sog": 12.34}}}', "[]", "{", '{"MetaData": {}}', '{"Message": {"PositionReport": {}}}']
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = {r["raw"]: (r["outcome"], r["mmsi"], r["sog_t"]) for r in frames.adapted_json(df).collect()}
    assert [got[r] for r in rows] == [("accepted", 261000001, None), ("accepted", 261000002, 123), ("missing-message", None, None), ("parse-error", None, None), ("missing-message", None, None), ("missing-mmsi", None, None)]


def test_reassembly_step():
    def run(rows):
        state, out = None, []
        for r in rows:
            state, whole = step(state, r)
            out.append(whole)
        return out

    assert run([(0, 2, 1, "a"), (5, 2, 2, "b")]) == [None, "ab"]
    assert run([(0, 2, 2, "b"), (0, 2, 1, "a")]) == [None, "ab"]
    assert run([(0, 2, 1, "a"), (6, 2, 2, "b"), (7, 2, 1, "c")]) == [None, None, "cb"]
    assert run([(0, 2, 1, "a"), (1, 2, 1, "x"), (2, 2, 2, "b")]) == [None, None, "ab"]
    assert run([(0, 2, 1, "a"), (1, 3, 2, "x"), (2, 2, 2, "b")]) == [None, None, None]


def test_frames_round_trip(spark):
    rows = [(261000001, 1704067200, 14.5, 53.4, 12, 3599, 359, 0, 7, 3), (261000002, 5, None, None, None, None, None, None, 4, None)]
    df = spark.createDataFrame(rows, "mmsi int, t_s long, lng double, lat double, sog_t int, cog_t int, heading int, nav_status int, flags int, source_id int")
    packed = sinks.packed(df)
    assert {len(r["frame"]) for r in packed.collect()} == {40}
    back = sinks.unpacked(packed.select("frame").union(spark.createDataFrame([(bytearray(b"short"),)], "frame binary"))).collect()
    got = {r["mmsi"]: r for r in back}
    assert got[261000001]["heading"] == 359 and math.isclose(got[261000001]["cog"], 359.9, abs_tol=1e-4) and got[261000001]["lng"] == 14.5
    assert got[261000002]["lng"] is None and got[261000002]["nav_status"] is None and got[261000002]["source_id"] is None
    assert [r["reason"] for r in back if r["mmsi"] is None] == ["frame-length"]


def test_lines(spark):
    df = spark.createDataFrame([("a\r\n\n b \n" + "x" * 90,)], "value string")
    assert [r["value"] for r in quality.lines(df).where(~quality.too_long(F.col("value"), True)).collect()] == ["a", "b"]


def _parts(spark, rows):
    """Rows (t_s, fragments, fragment, payload) of one source, channel and message id, in order of seq."""
    kind = "seq long, t_s long, source_id int, channel string, message_id string, fragments int, fragment int, payload string, reason string"
    return spark.createDataFrame([(k, t, 0, "A", "3", n, i, p, None) for k, (t, n, i, p) in enumerate(rows)], kind)


def test_reassembly_of_ids_that_come_again(spark):
    """A busy id never falls silent: every message counts, as do dropped, repeated, late and swapped parts."""
    rows = [(4 * k + j, 2, j + 1, f"{k}{'ab'[j]}") for k in range(50) for j in (0, 1)]
    got = {(r["seq"], r["t_s"], r["payload"]) for r in frames.reassembled(_parts(spark, rows)).collect()}
    assert got == {(2 * k + 1, 4 * k + 1, f"{k}a{k}b") for k in range(50)}
    faults = [(0, 2, 1, "a"), (3, 2, 2, "b"), (4, 2, 2, "d"), (4, 2, 2, "x"), (5, 2, 1, "c"), (8, 2, 1, "dropped"), (14, 2, 2, "late"), (15, 3, 1, "e"), (15, 3, 3, "g"), (16, 3, 2, "f"), (17, 2_000_000_000, 1, "h")]
    assert sorted(r["payload"] for r in frames.reassembled(_parts(spark, faults)).collect()) == ["ab", "cd", "efg"]


def test_reassembly_stream(spark, tmp_path):
    from seamark.streaming import reassembly, tracks

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracks.ROCKSDB)
    rows = _parts(spark, [(1704067200 + 4 * k + j, 2, j + 1, f"{k}{'ab'[j]}") for k in range(20) for j in (1, 0) if (k, j) != (7, 0)])
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    stream = tracks.timed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "parts")), "10 days")
    q = reassembly.reassembled(stream).writeStream.outputMode("append").format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["seq"], r["payload"]) for r in spark.table("whole").collect()}
    assert got == {(r["seq"], r["payload"]) for r in frames.reassembled(rows).collect()} and len(got) > 15


def test_texts_of_six_bits(spark):
    """Texts of every length and place, through bits, armour and hex digits, on few plain expressions without a lambda for each character."""
    chars = "".join(chr(k) for k in (*range(32, 64), *range(65, 96)))
    rows = [(chars[k:] + chars[:k], k) for k in range(63)] + [("", 63), ("A B ", 64), ("@@A@B", 65), ("a\x7f", 66)]
    df = spark.createDataFrame(rows, "text string, k int")
    for before in (40, 70, 112, 2):
        for n in (1, 7, 8, 19, 20):
            bits = F.concat(F.lit("1" * before), frames.text_bits(F.col("text"), n), F.lit("11"))
            digits = frames.armoured(df, bits).withColumn("hex", frames.hex_of(F.col("payload")))
            got = {r["k"]: r["t"] for r in digits.select("k", frames.text_at(F.col("hex"), before, n).alias("t")).collect()}
            want = {k: "".join(frames.SIX_BITS[ord(x) % 64] for x in text[:n]).replace("@", "") for text, k in rows}
            assert got == want
    text = frames.fields(F.col("hex"), frames.STATIC_A, ("vessel_name",))["vessel_name"]
    assert "lambda" not in str(text) + str(frames.text_bits(F.col("text"), 20))


def test_statics_are_dealt_before_and_after_their_keys(spark):
    """Messages of one file are encoded by many tasks, and those of one key decoded by many."""
    from seamark.sources import fixtures

    few = fixtures.statics(spark, "/root/testdata/sf0.001").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be put together again
    try:
        for sentences in (frames.static_sentences(few), frames.static_b_sentences(few)):
            assert sentences.select(F.spark_partition_id().alias("p")).distinct().count() == 4
        rows = [(4 * k + j, 2, j + 1, f"{k}{'ab'[j]}") for k in range(50) for j in (0, 1)]
        assert frames.reassembled(_parts(spark, rows)).select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
