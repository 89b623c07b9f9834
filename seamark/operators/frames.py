"""Radio sentences and JSON messages: encoding, checks, reassembly and decoding, as column expressions.

Bit layouts follow ITU-R M.1371. The armour of a payload is one-to-one with base64, so that its bits are read as hex
digits; fields are cut out of these by shifts and masks.
Rows that fail keep the first reason and go to quarantine; rows that wait for another part are pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.operators.replay import replayed
from seamark.streaming import reassembly

# Fixed values of the standard: field widths, in order.
POSITION_A = (("type", 6), ("repeat", 2), ("mmsi", 30), ("nav_status", 4), ("rot", 8), ("sog", 10), ("accuracy", 1), ("lng", 28), ("lat", 27), ("cog", 12), ("heading", 9), ("second", 6), ("maneuver", 2), ("spare", 3), ("raim", 1), ("radio", 19))
POSITION_B = (("type", 6), ("repeat", 2), ("mmsi", 30), ("reserved", 8), ("sog", 10), ("accuracy", 1), ("lng", 28), ("lat", 27), ("cog", 12), ("heading", 9), ("second", 6), ("spare", 2), ("cs_unit", 1), ("display", 1), ("dsc", 1), ("band", 1), ("message_22", 1), ("assigned", 1), ("raim", 1), ("radio", 20))
STATIC_A = (("type", 6), ("repeat", 2), ("mmsi", 30), ("version", 2), ("imo", 30), ("call_sign", 42), ("vessel_name", 120), ("ship_type", 8), ("to_bow", 9), ("to_stern", 9), ("to_port", 6), ("to_starboard", 6), ("fix_type", 4), ("eta_month", 4), ("eta_day", 5), ("eta_hour", 5), ("eta_minute", 6), ("draught", 8), ("destination", 120), ("dte", 1), ("spare", 1))
STATIC_B_NAME = (("type", 6), ("repeat", 2), ("mmsi", 30), ("part", 2), ("vessel_name", 120))
STATIC_B_REST = (("type", 6), ("repeat", 2), ("mmsi", 30), ("part", 2), ("ship_type", 8), ("vendor", 42), ("call_sign", 42), ("to_bow", 9), ("to_stern", 9), ("to_port", 6), ("to_starboard", 6), ("spare", 6))
TEXTS = ("call_sign", "vessel_name", "destination", "vendor")
ARMOUR = "".join(chr(k + (48 if k < 40 else 56)) for k in range(64))
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The character of each six bits of a text.
SIX_BITS = "".join(chr(k + 64 if k < 32 else k) for k in range(64))
NO_TURN = -128
NO_LNG, NO_LAT, NO_SOG, NO_COG, NO_HEADING = 181 * 600_000, 91 * 600_000, 1023, 3600, 511
PART_CHARS, PART_TTL_S = 56, 5


# Encoding (fixtures)


def uint_bits(value: Column, width: int) -> Column:
    return F.lpad(F.bin(value.cast("long")), width, "0")


def int_bits(value: Column, width: int) -> Column:
    return uint_bits(F.when(value < 0, value + (1 << width)).otherwise(value), width)


def text_bits(value: Column, chars: int) -> Column:
    """Six bits a character, filled up with @; characters that aren't ASCII are question marks."""
    padded = F.regexp_replace(F.rpad(F.coalesce(value, F.lit("")), chars, "@"), r"[^\x00-\x7F]", "?")
    ascii_ = [chr(k) for k in range(128)]
    whole = F.rpad(F.translate(padded, "".join(ascii_), "".join(BASE64[ord(c) % 64] for c in ascii_)), -(-chars // 4) * 4, "A")
    digits, n = F.hex(F.unbase64(whole)), -(-chars // 4) * 6
    parts = [F.lpad(F.conv(F.substring(digits, i + 1, 15), 16, 2), 4 * min(15, n - i), "0") for i in range(0, n, 15)]
    return F.substring(F.concat(*parts), 1, 6 * chars)


def armoured(rows: DataFrame, bits: Column) -> DataFrame:
    """rows with ``payload``: six bits to a character; the last group is filled with 0s."""
    # A column of its own, so that the bits aren't made again for every group; 120 of them are whole hex and base64 digits.
    rows = rows.withColumn("__bits", bits).withColumns({"__n": F.ceil(F.length("__bits") / 6).cast("int"), "__bits": F.rpad("__bits", (F.ceil(F.length("__bits") / 120) * 120).cast("int"), F.lit("0"))})
    digits = lambda i: F.lpad(F.conv(F.substring("__bits", i * 60 + 1, F.lit(60)), 2, 16), 15, "0")
    text = F.array_join(F.transform(F.sequence(F.lit(0), (F.length("__bits") / 60).cast("int") - 1), digits), "")
    # Up to 480 bits without a lambda function; digits of none are null.
    text = F.when(F.length("__bits") <= 480, F.concat_ws("", *(digits(i) for i in range(8)))).otherwise(text)
    return rows.withColumn("payload", F.substring(F.translate(F.base64(F.unhex(text)), BASE64, ARMOUR), F.lit(1), F.col("__n"))).drop("__bits", "__n")


def checksum(body: Column) -> Column:
    """Exclusive or of the characters: of ASCII texts by eight at once."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda i: F.ascii(F.substring(body, i, 1)))
    each = F.aggregate(codes, F.lit(0), lambda a, b: a.bitwiseXOR(b))
    word = lambda i: F.coalesce(F.conv(F.hex(F.substring(body, i * 8 + 1, F.lit(8))), 16, 10).cast("long"), F.lit(0).cast("long"))
    words = F.transform(F.sequence(F.lit(0), F.floor(F.length(body) / 8).cast("int")), word)
    # Of a sum of words the bytes are added in three halvings.
    fold = F.aggregate(words, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b), lambda a: _halved(_halved(_halved(a, 32), 16), 8).bitwiseAND(255).cast("int"))
    return F.when(F.octet_length(body) == F.length(body), fold).otherwise(each)


def _halved(value: Column, width: int) -> Column:
    return value.bitwiseXOR(F.shiftrightunsigned(value, width))


def sentence(body: Column, flip: Column | None = None) -> Column:
    total = checksum(body) if flip is None else checksum(body).bitwiseXOR(F.when(flip, 1).otherwise(0))
    return F.concat(F.lit("!"), body, F.lit("*"), F.lpad(F.hex(total), 2, "0"))


def position_sentences(positions: DataFrame) -> DataFrame:
    """(seq, t_s, source_id, raw): every 41st with a wrong checksum, every 43rd without one of its fields."""
    c = F.col
    lng, lat = F.round(c("lng_u") * 0.6).cast("long"), F.round(c("lat_u") * 0.6).cast("long")
    sog, cog, heading = F.coalesce(c("sog_t"), F.lit(NO_SOG)), F.coalesce(c("cog_t"), F.lit(NO_COG)), F.coalesce(c("heading"), F.lit(NO_HEADING))
    tail = [uint_bits(sog, 10), uint_bits(c("seq") % 2, 1), int_bits(lng, 28), int_bits(lat, 27), uint_bits(cog, 12), uint_bits(heading, 9), uint_bits(c("t_s") % 60, 6)]
    head = [uint_bits(c("msg_type"), 6), F.lit("00"), uint_bits(c("mmsi"), 30)]
    a = F.concat(*head, uint_bits(c("nav_status"), 4), int_bits(c("seq") % 256 - 128, 8), *tail, uint_bits(c("seq") % 3, 2), F.lit("000"), uint_bits(c("seq") % 5 % 2, 1), uint_bits(c("seq") % 500_000, 19))
    b = F.concat(*head, F.lit("0" * 8), *tail, F.lit("00"), uint_bits(c("seq") % 128, 7), uint_bits(c("seq") % 1_000_000, 20))
    rows = armoured(positions, F.when(c("msg_type") == 18, b).otherwise(a))
    body = F.concat(F.when(c("seq") % 43 == 0, "AIVDM,1,1,,").otherwise("AIVDM,1,1,,A,"), c("payload"), F.lit(",0"))
    return rows.withColumn("body", body).select("seq", "t_s", "source_id", sentence(c("body"), c("seq") % 41 == 0).alias("raw"))


def static_sentences(statics: DataFrame) -> DataFrame:
    """(seq, t_s, source_id, raw): each message of type 5 in two parts, a second apart; every third in reverse order."""
    c = F.col
    bits = F.concat(
        uint_bits(F.lit(5), 6), F.lit("00"), uint_bits(c("mmsi"), 30), F.lit("00"), uint_bits(F.coalesce("imo", F.lit(0)), 30), text_bits(c("call_sign"), 7), text_bits(c("vessel_name"), 20),
        uint_bits(c("ship_type"), 8), uint_bits(c("to_bow"), 9), uint_bits(c("to_stern"), 9), uint_bits(c("to_port"), 6), uint_bits(c("to_starboard"), 6), uint_bits(c("seq") % 16, 4), uint_bits(c("eta_month"), 4),
        uint_bits(c("eta_day"), 5), uint_bits(c("eta_hour"), 5), uint_bits(c("eta_minute"), 6), uint_bits(c("draught_t"), 8), text_bits(c("destination"), 20), uint_bits(c("seq") % 2, 1), F.lit("0"),
    )
    rows = armoured(statics.repartition("seq"), bits).withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
    piece = F.when(c("part") == 1, F.substring("payload", F.lit(1), F.lit(PART_CHARS))).otherwise(F.substring("payload", F.lit(PART_CHARS + 1), F.lit(100)))
    body = F.concat(F.lit("AIVDM,2,"), c("part"), F.lit(","), c("seq") % 10, F.lit(",A,"), piece, F.lit(","), F.when(c("part") == 2, 2).otherwise(0))
    late = F.when(c("seq") % 3 == 0, 2 - c("part")).otherwise(c("part") - 1)
    # Messages take ten ids in turn, five in two seconds: an id comes again three seconds after its last part.
    return rows.withColumn("body", body).select((c("seq") * 2 + late).alias("seq"), (F.lit(1704067200) + F.floor(c("seq") * 2 / 5) + late).cast("long").alias("t_s"), F.lit(0).alias("source_id"), sentence(c("body")).alias("raw"))


def static_b_sentences(statics: DataFrame) -> DataFrame:
    """(seq, t_s, source_id, raw): both messages of type 24 of each vessel, as class B sends its static data."""
    c = F.col
    head = [uint_bits(F.lit(24), 6), F.lit("00"), uint_bits(c("mmsi"), 30)]
    name = F.concat(*head, F.lit("00"), text_bits(c("vessel_name"), 20))
    sizes = [uint_bits(c(s), w) for s, w in (("to_bow", 9), ("to_stern", 9), ("to_port", 6), ("to_starboard", 6))]
    rest = F.concat(*head, F.lit("01"), uint_bits(c("ship_type"), 8), text_bits(F.concat(F.lit("V"), c("seq") % 1000), 7), text_bits(c("call_sign"), 7), *sizes, F.lit("0" * 6))
    both = statics.repartition("seq").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = armoured(both, F.when(c("part") == 0, name).otherwise(rest))
    # 160 bits are four more than 26 characters: the 27th has two to spare.
    body = F.concat(F.lit("AIVDM,1,1,,B,"), c("payload"), F.when(c("part") == 0, ",2").otherwise(",0"))
    return rows.withColumn("body", body).select((c("seq") * 2 + c("part")).alias("seq"), (F.lit(1704067200) + c("seq")).cast("long").alias("t_s"), F.lit(0).alias("source_id"), sentence(c("body")).alias("raw"))


# Checks and decoding


def checksum_reason(raw: Column, body: Column, digits: Column) -> Column:
    return (
        F.when(~F.coalesce(F.substring(raw, 1, 1).isin("$", "!"), F.lit(False)), "checksum-no-start").when(F.instr(raw, "*") <= 1, "checksum-no-marker")
        .when(~digits.rlike("^[0-9A-Fa-f]{2}$"), "checksum-malformed").when(checksum(body) != F.conv(digits, 16, 10).cast("int"), "checksum-mismatch")
    )


def enveloped(frames: DataFrame) -> DataFrame:
    """frames (raw) with their first ``reason`` and the fields of the envelope."""
    raw, star = F.col("__raw"), F.col("__star")
    out = frames.withColumn("__raw", F.trim("raw")).withColumn("__star", F.length("__raw") - F.instr(F.reverse("__raw"), "*") + 1)
    out = out.withColumns({"__body": F.substring(raw, F.lit(2), star - 2), "__digits": F.substring(raw, star + 1, F.lit(2))}).withColumn("__f", F.split("__body", ","))
    p = F.col("__f")
    leading = lambda i: F.nullif(F.regexp_extract(F.coalesce(F.get(p, F.lit(i)), F.lit("")), r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")
    out = out.withColumns({"__sum": checksum_reason(raw, F.col("__body"), F.col("__digits")), "fragments": leading(1), "fragment": leading(2), "fill": leading(6)})
    bad = (
        F.when(F.substring(raw, 1, 1) != "!", "parse-error").when(F.size(p) != 7, "envelope-fields").when(~F.get(p, F.lit(0)).isin("AIVDM", "AIVDO"), "envelope-tag")
        .when(F.coalesce(F.col("fragments") < 1, F.lit(True)), "envelope-fragments").when(F.coalesce(~F.col("fragment").between(1, F.col("fragments")), F.lit(True)), "envelope-fragment")
        .when(F.coalesce(~F.col("fill").between(0, 5), F.lit(True)), "envelope-fill")
    )
    out = out.withColumns({"reason": F.coalesce("__sum", bad), "message_id": F.nullif(F.get(p, F.lit(3)), F.lit("")), "channel": F.get(p, F.lit(4)), "payload": F.get(p, F.lit(5))})
    return out.drop("__raw", "__star", "__body", "__digits", "__sum", "__f")


def reassembled(frames: DataFrame, ttl_s: int = PART_TTL_S) -> DataFrame:
    """Sentences of one part as they are; of several parts one row per complete message, its payload joined.

    The buffer of ``streaming.reassembly`` runs over the parts of each key (source, channel, message id) in order:
    a message ends with its last part, so the next one of its id starts anew however soon it comes. Its row has
    that part's time and seq. Incomplete ones stay out. Keys are few, so messages are dealt anew before they are decoded.
    """
    single = frames.where("reason IS NOT NULL OR fragments = 1")
    parts = frames.where("reason IS NULL AND fragments > 1")
    key = ["source_id", "channel", "message_id"]

    def whole(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        seq, t, *part = row
        state, payload = reassembly.step(state, (t, *part), ttl_s)
        return state, None if payload is None else (seq, t, part[0], payload)

    joined = replayed(parts, key, ["seq", "t_s", "fragments", "fragment", "payload"], whole, "seq long, t_s long, fragments int, payload string")
    return single.unionByName(joined.repartition("seq"), allowMissingColumns=True)


def hex_of(payload: Column) -> Column:
    """The bits of a payload as hex digits, filled up with 0s; null if a character is not of the armour."""
    whole = F.rpad(F.translate(payload, ARMOUR, BASE64), (F.ceil(F.length(payload) / 4) * 4).cast("int"), F.lit("A"))
    return F.when(_armoured(payload), F.hex(F.unbase64(whole)))


def _armoured(payload: Column) -> Column:
    return F.coalesce(payload.rlike("^[0-W`-w]+$"), F.lit(False))


def six_at(payload: Column, i: int) -> Column:
    """The six bits of character i, from 1 on."""
    return F.instr(F.lit(ARMOUR), F.substring(payload, i, 1)) - 1


def bits_at(digits: Column, start: int, width: int) -> Column:
    """The unsigned number of ``width`` bits (60 at most) from bit ``start`` on, out of hex digits."""
    first, last = start // 4, (start + width - 1) // 4
    value = F.conv(F.substring(digits, first + 1, last - first + 1), 16, 10).cast("long")
    return F.shiftright(value, 4 * (last + 1) - start - width).bitwiseAND((1 << width) - 1)


def text_at(digits: Column, start: int, chars: int) -> Column:
    """The text of six-bit characters from bit ``start`` on without any @: eight at once, by way of base64."""
    parts = []
    for k in range(0, chars, 8):
        n = min(8, chars - k)
        first, last = (start + 6 * k) // 4, (start + 6 * (k + n) - 1) // 4
        own = F.conv(F.rpad(F.substring(digits, first + 1, last - first + 1), last - first + 1, "0"), 16, 10).cast("long")
        own = F.shiftright(own, 4 * (last + 1) - start - 6 * (k + n)).bitwiseAND((1 << 6 * n) - 1)
        whole = -(-n // 4) * 4
        parts.append(F.lpad(F.hex(F.shiftleft(own, 6 * (whole - n))), whole * 6 // 4, "0"))
    # What fills up the last part is left out as an @ is.
    return F.translate(F.base64(F.unhex(F.concat_ws("", *parts))), BASE64[1:] + BASE64[0], SIX_BITS[1:])


def fields(digits: Column, layout: tuple, wanted: tuple[str, ...]) -> dict[str, Column]:
    """Fields by name out of hex digits: texts as texts without their filling, everything else as unsigned numbers."""
    at, out = 0, {}
    for name, width in layout:
        if name in wanted:
            if name in TEXTS:
                out[name] = F.rtrim(text_at(digits, at, width // 6))
            else:
                out[name] = bits_at(digits, at, width)
        at += width
    return out


def signed(value: Column, width: int) -> Column:
    return F.when(value >= 1 << (width - 1), value - (1 << width)).otherwise(value)


def _length_reason(layouts: dict[int, int]) -> Column:
    n = F.length("payload") * 6
    part = F.shiftright(six_at(F.col("payload"), 7), 2).bitwiseAND(3)
    out = F.when(~F.col("type").isin(*layouts), "unsupported-type")
    for kind, least in layouts.items():
        out = out.when((F.col("type") == kind) & (n < least), "truncated")
    # The second half of class B's static data is longer than the first.
    return out.when((F.col("type") == 24) & (n < 168) & (part == 1), "truncated")


UNIT_FLAGS = ("cs_unit", "display", "dsc", "band", "message_22", "assigned")
_LEAST = {1: 168, 2: 168, 3: 168, 18: 168, 5: 424, 24: 160}


def typed(frames: DataFrame) -> DataFrame:
    """reassembled frames with ``hex``, ``type`` and the first reason so far; frames may be enveloped already."""
    rows = reassembled(frames if "payload" in frames.columns else enveloped(frames)).withColumn("hex", F.when(F.col("reason").isNull(), hex_of(F.col("payload"))))
    # What filters ask for is told from single characters, so that no filter makes the digits again.
    rows = rows.withColumn("type", F.when(F.col("reason").isNull() & _armoured(F.col("payload")), six_at(F.col("payload"), 1)))
    return rows.withColumn("reason", F.coalesce("reason", F.when(~_armoured(F.col("payload")), "payload-character"), _length_reason(_LEAST)))


def decoded(frames: DataFrame) -> DataFrame:
    """Position reports of types 1 to 3 and 18: wire integers, null where the standard says not available."""
    rows = typed(frames)
    want = ("repeat", "mmsi", "nav_status", "rot", "sog", "accuracy", "lng", "lat", "cog", "heading", "second", "maneuver", "raim", "radio", *UNIT_FLAGS)
    a, b = fields(F.col("hex"), POSITION_A, want), fields(F.col("hex"), POSITION_B, want)
    class_a = F.col("type") != 18
    pick = lambda name: F.when(F.col("type") == 18, b[name]).otherwise(a[name])
    return rows.where(F.col("reason").isNotNull() | F.col("type").isin(1, 2, 3, 18)).select(
        "seq", "t_s", "source_id", "raw", "reason", "type", pick("mmsi").alias("mmsi"), F.when(class_a, a["nav_status"]).alias("nav_status"),
        F.nullif(pick("sog"), F.lit(NO_SOG)).alias("sog_t"), F.nullif(signed(pick("lng"), 28), F.lit(NO_LNG)).alias("lng_600k"), F.nullif(signed(pick("lat"), 27), F.lit(NO_LAT)).alias("lat_600k"),
        F.nullif(pick("cog"), F.lit(NO_COG)).alias("cog_t"), F.nullif(pick("heading"), F.lit(NO_HEADING)).alias("heading"), F.when(pick("second") < 60, pick("second")).alias("second"),
        pick("repeat").alias("repeat"), F.when(class_a, F.nullif(signed(a["rot"], 8), F.lit(NO_TURN))).alias("rot"), (pick("accuracy") == 1).alias("accurate"), F.when(class_a, a["maneuver"]).alias("maneuver"),
        (pick("raim") == 1).alias("raim"), pick("radio").alias("radio"), *(F.when(~class_a, b[f] == 1).alias(f) for f in UNIT_FLAGS),
    )


def decoded_statics(frames: DataFrame) -> DataFrame:
    """Messages of type 5: empty and zero values are null, as are sizes if all are zero."""
    rows = typed(frames).where("reason IS NULL AND type = 5")
    want = ("mmsi", "imo", "call_sign", "vessel_name", "ship_type", "to_bow", "to_stern", "to_port", "to_starboard", "eta_month", "eta_day", "eta_hour", "eta_minute", "draught", "destination", "version", "fix_type", "dte")
    f = fields(F.col("hex"), STATIC_A, want)
    sizes = ("to_bow", "to_stern", "to_port", "to_starboard")
    some = sum(f[s] for s in sizes) > 0
    return rows.select(
        "seq", "t_s", "source_id", f["mmsi"].alias("mmsi"), F.nullif(f["imo"], F.lit(0)).alias("imo"), *(f[t].alias(t) for t in ("call_sign", "vessel_name", "destination")), f["ship_type"].alias("ship_type"),
        *(F.when(some, f[s]).alias(s) for s in sizes), F.nullif(f["draught"], F.lit(0)).alias("draught_t"),
        F.when(f["eta_month"].between(1, 12), f["eta_month"]).alias("eta_month"), F.when(f["eta_day"].between(1, 31), f["eta_day"]).alias("eta_day"),
        F.when(f["eta_hour"] < 24, f["eta_hour"]).alias("eta_hour"), F.when(f["eta_minute"] < 60, f["eta_minute"]).alias("eta_minute"),
        f["version"].alias("version"), f["fix_type"].alias("fix_type"), (f["dte"] == 0).alias("dte"),
    )


def decoded_statics_b(frames: DataFrame) -> DataFrame:
    """Messages of type 24: part 1 has type, vendor, call sign and sizes (null if all are 0); any other part number the name."""
    rows = typed(frames).where("reason IS NULL AND type = 24")
    sizes = ("to_bow", "to_stern", "to_port", "to_starboard")
    name = fields(F.col("hex"), STATIC_B_NAME, ("mmsi", "part", "vessel_name"))
    rest = fields(F.col("hex"), STATIC_B_REST, ("ship_type", "vendor", "call_sign", *sizes))
    is_b = name["part"] == 1
    some = sum(rest[s] for s in sizes) > 0
    rest |= {s: F.when(some, rest[s]) for s in sizes}
    return rows.select("seq", "t_s", "source_id", name["mmsi"].alias("mmsi"), name["part"].alias("part"), F.when(~is_b, name["vessel_name"]).alias("vessel_name"), *(F.when(is_b, v).alias(k) for k, v in rest.items()))


# JSON feed


def json_messages(positions: DataFrame) -> DataFrame:
    """(seq, seq_mmsi, raw): every 7th is no JSON, every other 5th of an unknown kind; every third has its id in the metadata only."""
    c = F.col
    own = F.when(c("seq") % 3 != 0, c("mmsi"))
    report = F.struct(own.alias("UserID"), (c("sog_t") / 10).alias("Sog"), c("lng").alias("Longitude"), c("lat").alias("Latitude"), c("heading").alias("TrueHeading"))
    kinds = F.when(c("seq") % 5 == 0, F.to_json(F.struct(F.struct(report.alias("AidsToNavigation")).alias("Message"), F.struct(c("mmsi").alias("MMSI")).alias("MetaData"))))
    text = kinds.otherwise(F.to_json(F.struct(F.struct(report.alias("PositionReport")).alias("Message"), F.struct(c("mmsi").alias("MMSI")).alias("MetaData"))))
    return positions.select("seq", c("mmsi").alias("seq_mmsi"), F.when(c("seq") % 7 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("raw"))


KINDS = ("PositionReport", "StandardClassBPositionReport", "ShipStaticData", "StaticDataReport")


def strict(variant: Column, path: str, kinds: tuple[str, ...], to: str) -> Column:
    """The value at path if it has one of these JSON types; numbers in quotes and such are not taken."""
    value = F.try_variant_get(variant, path, "variant")
    return F.when(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*kinds), F.try_variant_get(variant, path, to))


_NUMBER = ("BIGINT", "DECIMAL", "DOUBLE")


def adapted_json(frames: DataFrame) -> DataFrame:
    """frames (raw) with outcome, mmsi (the report's own id, else the metadata's) and the fields of position reports."""
    v = F.col("__v")
    rows = frames.withColumn("__v", F.try_parse_json("raw"))
    kind = F.coalesce(*(F.when(F.try_variant_get(v, f"$.Message.{k}", "variant").isNotNull(), k) for k in KINDS))
    body = F.try_variant_get(v, "$.Message", "variant")
    mmsi = F.coalesce(*(strict(v, f"$.Message.{k}.UserID", _NUMBER, "double") for k in KINDS), strict(v, "$.MetaData.MMSI", _NUMBER, "double"))
    rows = rows.withColumns({"kind": kind, "mmsi": mmsi.cast("long")})
    outcome = F.when(v.isNull(), "parse-error").when(body.isNull(), "missing-message").when(F.col("kind").isNull(), "unsupported-type").when(F.col("mmsi").isNull(), "missing-mmsi").otherwise("accepted")
    number = lambda name: F.coalesce(*(strict(v, f"$.Message.{k}.{name}", _NUMBER, "double") for k in KINDS[:2]))
    sog = number("Sog")
    lat, lng, heading = number("Latitude"), number("Longitude"), number("TrueHeading")
    return rows.withColumn("outcome", outcome).withColumns({
        "sog_t": F.when((F.col("outcome") == "accepted") & (sog < 102.3), F.round(sog * 10).cast("long")), "lat": F.nullif(lat, F.lit(91.0)), "lng": F.nullif(lng, F.lit(181.0)),
        "heading": F.nullif(heading.cast("int"), F.lit(NO_HEADING)),
    }).drop("__v")
