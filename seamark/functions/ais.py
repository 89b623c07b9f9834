"""Column functions of ship-radio data: gates, look-ups, geometry, formats. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ITU-R and IMO standards and of the data contract.
KNOT_M_PER_S = 0.5144
METRES_PER_DEGREE = 111_000.0
SHIP_TYPE_LABELS = (
    (20, 29, "WIG craft"), (30, 30, "Fishing"), (31, 32, "Tug"), (33, 33, "Dredger"), (34, 34, "Diving"), (35, 35, "Military"), (36, 36, "Sailing"),
    (37, 37, "Pleasure craft"), (40, 49, "High-speed craft"), (50, 50, "Pilot"), (51, 51, "Search & rescue"), (52, 52, "Tug"), (53, 53, "Port tender"),
    (54, 54, "Anti-pollution"), (55, 55, "Law enforcement"), (58, 58, "Medical transport"), (60, 69, "Passenger"), (70, 79, "Cargo"), (80, 89, "Tanker"), (90, 99, "Other"),
)
SOURCES = {0: "LocalUdp", 1: "WebSdr", 2: "AisStream", 3: "EdgeBridge"}
SOURCE_DESCRIPTIONS = {0: "Local dev UDP feed", 1: "Regional WebSDR fallback", 2: "Public AisStream fallback", 3: "Own RTL-SDR antenna over mTLS edge bridge"}
NO_SOURCE = ("Unknown", "Source not recorded (pre sourceId tracking)")
STALE_S = 120
AGE_WEIGHTS = ((0, 0.95), (60, 0.92), (180, 0.7), (360, 0.45), (540, 0.15), (600, 0.0))
SOURCE_WEIGHTS = {3: 1.0, 0: 0.55, 1: 0.55, 2: 0.55}
UNKNOWN_SOURCE_WEIGHT = 0.4
FLAG_MOVING, FLAG_FIX, FLAG_IDENTITY = 1, 2, 4
DASH = "—"


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The name of the first test that holds; null if none does."""
    out = None
    for test, name in tests:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


# Gates


def mmsi_in_format(mmsi: Column) -> Column:
    """Gate A: nine digits at most, country code 200 to 799."""
    return F.coalesce(mmsi.between(0, 999_999_999) & F.floor(mmsi / 1_000_000).between(200, 799), F.lit(False))


def mmsi_reason(mmsi: Column) -> Column:
    """Gate B: why an id isn't a ship's; null if it is one."""
    mid = F.floor(mmsi / 1_000_000)
    known = mid.between(201, 775) | mid.isin(111, 970, 972, 974) | mid.between(990, 999)
    return first_reason((mmsi.isNull() | ~mmsi.between(100_000_000, 999_999_999), "mmsi-out-of-range"), (~known, "mmsi-invalid-mid"))


def imo_checks(imo: Column) -> Column:
    """Seven digits whose last is the weighted sum of the others."""
    digit = lambda k: F.floor(imo / 10**k) % 10
    return F.coalesce(imo.between(1_000_000, 9_999_999) & (sum(digit(k) * (k + 1) for k in range(1, 7)) % 10 == imo % 10), F.lit(False))


def position_reason(lat: Column, lng: Column, sog: Column, cog: Column, heading: Column) -> Column:
    """The first physical range that a fix breaks."""
    out = lambda c, lo, hi: c.isNotNull() & (F.isnan(c.cast("double")) | ~c.between(lo, hi))
    return first_reason(
        (out(lat, -90, 90), "lat-out-of-range"), (out(lng, -180, 180), "lng-out-of-range"), (out(sog, 0, 102.2), "sog-out-of-range"),
        (out(cog, 0, 360), "cog-out-of-range"), (out(heading, 0, 359), "heading-out-of-range"),
    )


def coarse_reason(reason: Column) -> Column:
    """Rejects rolled up to the kinds that a source's counters tell apart; other reasons stay as they are."""
    return (
        F.when(reason.startswith("mmsi"), "invalid-mmsi").when(reason == "lat-out-of-range", "out-of-range-lat").when(reason == "lng-out-of-range", "out-of-range-lng")
        .when(reason.isin("sog-out-of-range", "cog-out-of-range", "heading-out-of-range"), "invalid-payload").when(reason.isin("rate-limited", "new-vessel-limited"), "rate-limit").otherwise(reason)
    )


# Look-ups


def ship_type_label(code: Column) -> Column:
    return first_reason(*((code.between(lo, hi), name) for lo, hi, name in SHIP_TYPE_LABELS))


def ship_category(code: Column) -> Column:
    named = first_reason(
        (code == 30, "fishing"), (code.isin(36, 37), "sailing"), (code.isin(31, 32, 33, 34, 35, 50, 51, 52, 53, 54, 55, 58), "service"),
        (code.between(60, 69), "passenger"), (code.between(70, 79), "cargo"), (code.between(80, 89), "tanker"),
    )
    return named.otherwise("other")


def vessel_status(nav_status: Column, moving: Column, sog: Column) -> Column:
    return F.when(nav_status.isin(1, 5), "anchored").when(nav_status == 2, "nuc").when(moving, "underway").when(sog.isNull(), "anchored").otherwise("stopped")


def source_name(source_id: Column) -> Column:
    named = first_reason(*((source_id == k, v) for k, v in SOURCES.items()))
    return F.when(source_id.isNull(), "Unknown").otherwise(F.coalesce(named, F.concat(F.lit("#"), source_id.cast("string"))))


def source_label(source_id: Column) -> Column:
    """Name for lists: any id that isn't listed is unknown."""
    return F.coalesce(first_reason(*((source_id == k, v) for k, v in SOURCES.items())), F.lit(NO_SOURCE[0]))


def source_description(source_id: Column) -> Column:
    return F.coalesce(first_reason(*((source_id == k, v) for k, v in SOURCE_DESCRIPTIONS.items())), F.lit(NO_SOURCE[1]))


def stale(age_s: Column) -> Column:
    return age_s >= STALE_S


# Flags and keys


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(flag) != 0


def with_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseOR(flag)


def without_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(~flag)


def membership_key(mmsi: Column, zone_id: Column) -> Column:
    return F.concat_ws("|", mmsi.cast("string"), zone_id)


def parsed_key(key: Column) -> Column:
    """struct<mmsi, zone_id> of a key of two parts whose first is a number; null for any other."""
    parts = F.split(key, r"\|")
    mmsi = F.get(parts, F.lit(0)).try_cast("long")
    return F.when((F.size(parts) == 2) & mmsi.isNotNull(), F.struct(mmsi.alias("mmsi"), F.get(parts, F.lit(1)).alias("zone_id")))


# Geometry and time


def distance_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Equirectangular distance at the mean latitude."""
    east = (lng2 - lng1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(east, (lat2 - lat1) * METRES_PER_DEGREE)


def great_circle_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Haversine distance on the mean sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * 6_371_008.8) * F.asin(F.sqrt(a))


def dead_reckoned(lng: Column, lat: Column, sog: Column, course: Column, age_s: Column) -> Column:
    """struct<lng, lat> after age_s: damped by half every 30 s, 30 m at most, for 60 s at most."""
    metres = F.least(sog * KNOT_M_PER_S * age_s * F.pow(F.lit(0.5), age_s / 30), F.lit(30.0))
    north = metres * F.cos(F.radians(course)) / METRES_PER_DEGREE
    east = metres * F.sin(F.radians(course)) / (F.cos(F.radians(lat)) * METRES_PER_DEGREE)
    go = F.coalesce((sog > 0.5) & course.isNotNull() & age_s.between(0, 60), F.lit(False))
    return F.struct(F.when(go, lng + east).otherwise(lng).alias("lng"), F.when(go, lat + north).otherwise(lat).alias("lat"))


def freshness(age_s: Column, source_id: Column) -> Column:
    """Weight of a fix: a ramp over its age, times that of its source."""
    ramp = F.when(age_s <= 0, AGE_WEIGHTS[0][1])
    for (t0, w0), (t1, w1) in zip(AGE_WEIGHTS, AGE_WEIGHTS[1:], strict=False):
        ramp = ramp.when(age_s < t1, w0 + (age_s - t0) * ((w1 - w0) / (t1 - t0)))
    weight = F.coalesce(first_reason(*((source_id == k, v) for k, v in SOURCE_WEIGHTS.items())), F.lit(UNKNOWN_SOURCE_WEIGHT))
    return ramp.otherwise(AGE_WEIGHTS[-1][1]) * weight


def eased(share: Column) -> Column:
    """Cubic ease in and out of 0 to 1."""
    return F.when(share < 0.5, 4 * share * share * share).otherwise(1 - F.pow(2 - 2 * share, 3) / 2)


def eta_time(year: int, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Arrival as a timestamp of the year; day 0 and hour 24 roll over the calendar; null without month or day."""
    date = F.date_add(F.add_months(F.make_date(F.lit(year), F.lit(1), F.lit(1)), month - 1), day - 1)
    minutes = F.coalesce(hour, F.lit(0)) * 60 + F.coalesce(minute, F.lit(0))
    return F.when(month.isNotNull() & day.isNotNull(), F.timestamp_seconds(F.unix_seconds(date.cast("timestamp")) + minutes * 60))


# Texts


def relative_time(then_s: Column, now_s: Column) -> Column:
    age = F.greatest(F.floor(now_s - then_s), F.lit(0))
    return F.when(age < 60, F.concat(age, F.lit("s ago"))).when(age < 3600, F.concat(F.floor(age / 60), F.lit("m ago"))).otherwise(F.concat(F.floor(age / 3600), F.lit("h ago")))


def event_time(then_s: Column, now_s: Column) -> Column:
    """Relative for a day, then the moment."""
    return F.when(now_s - then_s < 86_400, relative_time(then_s, now_s)).otherwise(F.date_format(F.timestamp_seconds(then_s), "yyyy-MM-dd HH:mm"))


def whole_seconds(millis: Column) -> Column:
    return F.floor(millis / 1000)


def iso_text(millis: Column) -> Column:
    """A moment in ISO 8601; the session's time zone has to be UTC, as for all timestamps here."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sog_text(sog: Column) -> Column:
    return or_dash(F.format_string("%.1f kn", sog), sog.isNull())


def cog_text(cog: Column) -> Column:
    return or_dash(F.format_string("%.1f°", cog), cog.isNull())


def heading_text(heading: Column) -> Column:
    return or_dash(F.concat(heading.cast("string"), F.lit("°")))


def ship_type_text(code: Column) -> Column:
    return or_dash(F.concat(ship_type_label(code), F.lit(" ("), code.cast("string"), F.lit(")")))


def or_dash(value: Column, blank: Column | None = None) -> Column:
    return F.when(value.isNull() if blank is None else value.isNull() | blank, DASH).otherwise(value)


def degrees_text(value: Column, axis: str) -> Column:
    side = F.when(value >= 0, "N" if axis == "lat" else "E").otherwise("S" if axis == "lat" else "W")
    return or_dash(F.concat(F.format_string("%.6f", F.abs(value)), F.lit("° "), side), value.isNull())


def eta_text(month: Column, day: Column, hour: Column, minute: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.when((month != 0) & (day != 0), F.concat(two(month), F.lit("-"), two(day)))
    time = F.when((hour < 24) & (minute < 60), F.concat(two(hour), F.lit(":"), two(minute)))
    return or_dash(F.nullif(F.concat_ws(" ", date, time), F.lit("")))
