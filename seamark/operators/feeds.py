"""Feeds: several sources as one table, raw frames by format, JSON messages of all kinds, what each source lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators import quality, tracks
from seamark.operators.frames import KINDS, NO_HEADING, strict

#: The message type that each kind of JSON message stands for.
TYPES = {"PositionReport": 1, "StandardClassBPositionReport": 18, "ShipStaticData": 5, "StaticDataReport": 24}
#: Sources by trust, and how long one counts as alive after its last accepted frame: healthy for 300 s, then 600 s of grace.
PRIORITY, ALIVE_S = (3, 2, 0, 1), 900
_NUMBER = ("BIGINT", "DECIMAL", "DOUBLE")


def merged(sources: dict[int, DataFrame]) -> DataFrame:
    """Frames of all sources with ``source_id``, its name and its rank by trust; columns that a source lacks are null."""
    tagged = [df.withColumn("source_id", F.lit(k).cast("long")) for k, df in sorted(sources.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rank = F.array_position(F.array(*(F.lit(s).cast("long") for s in PRIORITY)), F.col("source_id"))
    return rows.withColumns({"source": ais.source_name(F.col("source_id")), "trust": F.nullif(rank, F.lit(0).cast("long"))})


def frame_format(raw: Column) -> Column:
    """nmea, json, or parse-error, by the first character."""
    first = F.substring(F.ltrim(raw), 1, 1)
    return F.when(first.isin("!", "$"), "nmea").when(first == "{", "json").otherwise("parse-error")


def drop_counts(lines: DataFrame, value: str = "value", trimmed: bool = False, in_rate: Column | None = None) -> DataFrame:
    """Per source: lines over the longest length, those over its rate (of the others), and those passed on."""
    long = F.coalesce(quality.too_long(F.col(value), trimmed), F.lit(False))
    late = ~F.coalesce(in_rate, F.lit(True)) if in_rate is not None else F.lit(False)
    return lines.groupBy("source_id").agg(F.count_if(long).alias("too_long"), F.count_if(~long & late).alias("over_rate"), F.count_if(~long & ~late).alias("emitted"))


def adapted(frames: DataFrame) -> DataFrame:
    """frames (raw) with outcome, message_type, mmsi and ``position`` or ``static`` with the fields of the kind.

    A message holds one body; of several the first of KINDS counts, and it is taken out of the text once. Numbers in
    quotes and other types than asked for count as missing. Sentinels become null; an IMO number, sizes and a draught
    of 0 stay, as feeds send them.
    """
    v, b = F.col("__v"), F.col("__b")
    message = F.try_variant_get(v, "$.Message", "variant")
    kind = F.coalesce(*(F.when(F.try_variant_get(v, f"$.Message.{k}", "variant").isNotNull(), k) for k in KINDS))
    body = F.coalesce(*(F.when(F.col("kind") == k, F.try_variant_get(v, f"$.Message.{k}", "variant")) for k in KINDS))
    rows = frames.withColumn("__v", F.try_parse_json("raw")).withColumn("kind", kind).withColumn("__b", body)
    number = lambda path: strict(b, f"$.{path}", _NUMBER, "double")
    whole = lambda path: number(path).cast("long")
    text = lambda path: F.coalesce(F.trim(strict(b, f"$.{path}", ("STRING",), "string")), F.lit(""))
    flag = lambda path: F.coalesce(strict(b, f"$.{path}", ("BOOLEAN",), "boolean"), F.lit(False))
    mmsi = F.coalesce(whole("UserID"), strict(v, "$.MetaData.MMSI", _NUMBER, "double").cast("long"))
    sog, rot = number("Sog"), number("RateOfTurn")
    class_a = F.col("kind") == KINDS[0]
    position = F.struct(
        F.nullif(number("Longitude"), F.lit(181.0)).alias("lng"), F.nullif(number("Latitude"), F.lit(91.0)).alias("lat"), F.when(sog < 102.3, F.round(sog * 10).cast("long")).alias("sog_t"),
        F.when(number("Cog") < 360, F.round(number("Cog") * 10).cast("long")).alias("cog_t"), F.nullif(whole("TrueHeading"), F.lit(NO_HEADING).cast("long")).alias("heading"),
        F.when(class_a, whole("NavigationalStatus")).alias("nav_status"), F.when(class_a & (rot != -128) & (F.abs(rot) < 127.5), rot).alias("rot"),
        flag("PositionAccuracy").alias("accurate"), whole("Timestamp").alias("second"),
    )
    half = F.col("kind") == KINDS[3]
    part = F.when(half, F.when(flag("PartNumber"), 1).otherwise(0))
    where = lambda a, b_: F.when(half, b_).otherwise(a)
    static = F.struct(
        part.alias("part"), where(text("Name"), text("ReportA.Name")).alias("vessel_name"), where(text("CallSign"), text("ReportB.CallSign")).alias("call_sign"),
        F.when(~half, whole("ImoNumber")).alias("imo"), where(whole("Type"), whole("ReportB.ShipType")).alias("ship_type"),
        *(where(whole(f"Dimension.{x}"), whole(f"ReportB.Dimension.{x}")).alias(name) for x, name in zip("ABCD", ("to_bow", "to_stern", "to_port", "to_starboard"), strict=True)),
        F.when(~half, F.round(number("MaximumStaticDraught") * 10).cast("long")).alias("draught_t"), F.when(~half, text("Destination")).alias("destination"),
        *(F.when(~half, whole(f"Eta.{x}")).alias(f"eta_{x.lower()}") for x in ("Month", "Day", "Hour", "Minute")),
    )
    outcome = F.when(v.isNull(), "parse-error").when(message.isNull(), "missing-message").when(F.col("kind").isNull(), "unsupported-type").when(F.col("mmsi").isNull(), "missing-mmsi").otherwise("accepted")
    rows = rows.withColumn("mmsi", mmsi).withColumn("outcome", outcome)
    taken = F.col("outcome") == "accepted"
    types = F.coalesce(*(F.when(taken & (F.col("kind") == k), F.lit(t)) for k, t in TYPES.items()))
    return rows.withColumns({"message_type": types, "position": F.when(types.isin(1, 18), position), "static": F.when(types.isin(5, 24), static)}).drop("__v", "__b", "kind")


def json_feed(positions: DataFrame, statics: DataFrame) -> DataFrame:
    """(key, raw): a JSON message of each kind from the fixture tables."""
    c = F.col
    own = [c("mmsi").alias("UserID"), (c("sog_t") / 10).alias("Sog"), (c("cog_t") / 10).alias("Cog"), c("lng").alias("Longitude"), c("lat").alias("Latitude"), c("heading").alias("TrueHeading")]
    a = F.struct(*own, c("nav_status").alias("NavigationalStatus"), (c("seq") % 256 - 128).alias("RateOfTurn"), (c("seq") % 2 == 0).alias("PositionAccuracy"), (c("seq") % 64).alias("Timestamp"))
    meta = F.struct(c("mmsi").alias("MMSI")).alias("MetaData")
    wrap = lambda kind, body: F.to_json(F.struct(F.struct(body.alias(kind)).alias("Message"), meta))
    reports = positions.select(F.concat(F.lit("p"), c("seq")).alias("key"), F.when(c("msg_type") == 18, wrap(KINDS[1], F.struct(*own))).otherwise(wrap(KINDS[0], a)).alias("raw"))
    size = F.struct(c("to_bow").alias("A"), c("to_stern").alias("B"), c("to_port").alias("C"), c("to_starboard").alias("D")).alias("Dimension")
    eta = F.struct(*(c(f"eta_{x.lower()}").alias(x) for x in ("Month", "Day", "Hour", "Minute"))).alias("Eta")
    full = F.struct(c("vessel_name").alias("Name"), c("call_sign").alias("CallSign"), c("imo").alias("ImoNumber"), c("ship_type").alias("Type"), size, (c("draught_t") / 10).alias("MaximumStaticDraught"), c("destination").alias("Destination"), eta)
    two = F.struct((c("seq") % 4 == 2).alias("PartNumber"), F.struct(c("vessel_name").alias("Name")).alias("ReportA"), F.struct(c("call_sign").alias("CallSign"), c("ship_type").alias("ShipType"), size).alias("ReportB"))
    data = statics.select(F.concat(F.lit("s"), c("seq")).alias("key"), F.when(c("seq") % 2 == 0, wrap(KINDS[3], two)).otherwise(wrap(KINDS[2], full)).alias("raw"))
    return reports.union(data)


def static_reason(mmsi: Column, imo: Column, ship_type: Column) -> Column:
    """The first check that a static message fails: id, IMO number (where one is given), ship type 0 to 255."""
    return ais.first_reason((~ais.mmsi_in_format(mmsi), "mmsi-invalid-format"), (imo.isNotNull() & ~ais.imo_checks(imo), "invalid-imo"), (ship_type.isNotNull() & ~ship_type.between(0, 255), "invalid-ship-type"))


def gate_chain(positions: DataFrame, burst: int = 200, per_minute: int = 100) -> DataFrame:
    """positions with the first ``reason`` of the gates in order: id, ranges, new vessels, rate of a vessel.

    Each gate sees only what the ones before it let through; a vessel stays known to the new-vessel gate even if the
    next one rejects its frame.
    """
    rows = quality.gated(positions)
    passed = quality.admitted_by_bucket(rows.where("reason IS NULL"), burst, per_minute).select("mmsi", "seq", "admitted")
    rows = rows.join(passed, ["mmsi", "seq"], "left").withColumn("reason", F.coalesce("reason", F.when(~F.col("admitted"), "new-vessel-limited"))).drop("admitted")
    in_rate = tracks.rate_limit(rows.where("reason IS NULL")).select("mmsi", "seq", F.col("accepted").alias("__in_rate"))
    return rows.join(in_rate, ["mmsi", "seq"], "left").withColumn("reason", F.coalesce("reason", F.when(~F.col("__in_rate"), "rate-limited"))).drop("__in_rate")


def storable(frames: DataFrame) -> DataFrame:
    """Accepted frames of the position channel that have a position."""
    return frames.where("reason IS NULL AND lng IS NOT NULL AND lat IS NOT NULL").where(F.col("msg_type").isin(1, 2, 3, 18))


def trusted(frames: DataFrame, alive_s: int = ALIVE_S, priority: tuple[int, ...] = PRIORITY) -> DataFrame:
    """frames (seq, t_s, source_id, reason) with ``active``: of the sources with an accepted frame in the last alive_s
    seconds, whatever its vessel, the first by priority; null if none has.

    Accepted seconds of a source become spans in which it is alive, and a frame meets the spans of its stretch of time.
    """
    seconds = frames.where("reason IS NULL").select("source_id", "t_s").distinct()
    w = Window.partitionBy("source_id", "stretch").orderBy("t_s")
    stretch = F.floor(F.col("t_s") / alive_s)
    # Spans within a stretch of time; those of the next stretch begin anew, so that no window holds a source's history.
    new = F.coalesce(F.col("t_s") - F.lag("t_s").over(w) > alive_s, F.lit(True)).cast("int")
    spans = seconds.withColumn("stretch", stretch).withColumn("new", new).withColumn("span", F.sum("new").over(w))
    spans = spans.groupBy("source_id", "stretch", "span").agg(F.min("t_s").alias("from_s"), (F.max("t_s") + alive_s).alias("to_s"))
    rank = F.array_position(F.array(*(F.lit(s).cast("long") for s in priority)), F.col("source_id").cast("long"))
    spans = spans.select(rank.alias("rank"), "from_s", "to_s", F.explode(F.sequence(F.floor(F.col("from_s") / alive_s), F.floor(F.col("to_s") / alive_s))).alias("__at"))
    # All frames of one second have the same answer.
    asked = frames.select("t_s").distinct().withColumn("__at", F.floor(F.col("t_s") / alive_s))
    best = asked.join(spans, "__at").where(F.col("t_s").between(F.col("from_s"), F.col("to_s")) & (F.col("rank") > 0)).groupBy("t_s").agg(F.min("rank").alias("rank"))
    active = best.select("t_s", F.get(F.array(*(F.lit(s).cast("long") for s in priority)), (F.col("rank") - 1).cast("int")).alias("active"))
    return frames.join(active, "t_s", "left")


STATIC_FRAME = "type string, mmsi long, name string, callSign string, shipType int, destination string"


def static_frames(raw: DataFrame, value: str = "raw") -> DataFrame:
    """raw with ``frame``: static frames whose text has the right shape; null for any other text."""
    got = F.from_json(F.col(value), f"{STATIC_FRAME}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    ok = got["__bad"].isNull() & (got["type"] == "static") & got["mmsi"].isNotNull()
    return raw.withColumn("frame", F.when(ok, got.dropFields("__bad")))
