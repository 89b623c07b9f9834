"""Registered queries of vessel state, sinks, lines, live views and texts, each with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators import geo, quality, reads, state, tracks
from seamark.plans.queries import _CATEGORY_SQL, _COARSE_REASON, _EVENTS, _FIRST_REASON, _HITS, _LABEL_SQL, _LABELS, _TRAIL_POINTS, _query
from seamark.sources import fixtures, sinks
from seamark.sources.fixtures import AS_OF, MESSAGES, POSITIONS, STATICS
from seamark.sources.landing import shared_path

_P = f"WITH p AS ({POSITIONS})"
_PS = f"WITH p AS ({POSITIONS}), s AS ({STATICS})"
_M = f"WITH m AS ({MESSAGES})"
_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p) WHERE rn = 1)"

#: A moment at which some vessels have been silent for long; and a clock 50 times as fast, whose events span some days.
_EARLY = 1704067200 + 1500
_FAST = "1704067200 + (t_s - 1704067200) * 50"


# State


def _last(value: str, name: str) -> str:
    return f"arg_max({value}, seq) FILTER ({value} IS NOT NULL) AS {name}"


@_query(f"""{_M} SELECT mmsi, max(seq) AS seq, {", ".join(_last(f"nullif(trim({c}), '')", c) for c in ("vessel_name", "call_sign", "destination"))}, {_last("nullif(ship_type, 0)", "ship_type")},
  {", ".join(_last(c, c) for c in ("imo", "to_bow", "to_stern", "to_port", "to_starboard", "draught_t"))}, {", ".join(f"arg_max([{c}], seq) FILTER (eta_month IS NOT NULL OR eta_day IS NOT NULL OR eta_hour IS NOT NULL OR eta_minute IS NOT NULL)[1] AS {c}" for c in ("eta_month", "eta_day", "eta_hour", "eta_minute"))}
FROM m GROUP BY mmsi""")
def static_merged(spark, sf_dir):
    """One row per vessel out of full and partial static messages; an arrival time is replaced as a whole."""
    rows = state.static_merge(fixtures.static_messages(spark, sf_dir))
    return rows.select(*(c for c in rows.columns if c != "eta"), *(f"eta.{c}" for c in state.ETA))


@_query(f"""{_M} SELECT seq, mmsi, {", ".join(f"last_value({v} IGNORE NULLS) OVER w AS {c}" for c, v in (("vessel_name", "nullif(trim(vessel_name), '')"), ("call_sign", "nullif(trim(call_sign), '')"), ("ship_type", "nullif(ship_type, 0)"), ("imo", "imo"), ("to_bow", "to_bow")))}
FROM m WINDOW w AS (PARTITION BY mmsi ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def static_carried(spark, sf_dir):
    return state.static_history(fixtures.static_messages(spark, sf_dir)).select("seq", "mmsi", "vessel_name", "call_sign", "ship_type", "imo", "to_bow")


@_query(f"""{_P}, m AS ({MESSAGES}), {_LATEST}, d AS (SELECT mmsi, arg_max(t_s, seq) AS static_s, arg_max(source_id, seq) AS static_source FROM m GROUP BY mmsi)
SELECT mmsi, greatest(l.t_s, static_s) AS last_seen_s, CASE WHEN l.t_s IS NULL OR static_s > l.t_s THEN static_source ELSE l.source_id END AS last_source FROM l FULL JOIN d USING (mmsi)""")
def row_stamps(spark, sf_dir):
    """Of each vessel's last position and last static message, the newer one's time and source."""
    seen = tracks.latest(fixtures.positions(spark, sf_dir)).select("mmsi", F.col("t_s").alias("p_s"), F.col("source_id").alias("p_source"))
    told = fixtures.static_messages(spark, sf_dir).groupBy("mmsi").agg(F.max_by("t_s", "seq").alias("s_s"), F.max_by("source_id", "seq").alias("s_source"))
    c = F.col
    return seen.join(told, "mmsi", "full").select("mmsi", state.row_stamp(c("p_s"), c("s_s"), c("p_source"), c("s_source")).alias("r")).select("mmsi", "r.*")


@_query(f"{_P} SELECT seq, CASE WHEN heading BETWEEN 0 AND 359 THEN heading END AS heading, CASE WHEN seq % 256 <> 0 THEN seq % 256 - 128 END AS rot FROM p")
def stored_values(spark, sf_dir):
    """Headings and rates of turn as they are stored: without values out of range and sentinels; 127 either way stays."""
    rot = (F.col("seq") % 256 - 128).cast("double")
    return fixtures.positions(spark, sf_dir).select("seq", state.stored_heading(F.col("heading")).alias("heading"), state.stored_turn(rot).cast("long").alias("rot"))


@_query(f"""WITH s AS ({STATICS}), h AS (SELECT *, CASE seq % 3 WHEN 0 THEN NULL ELSE seq % 3 - 1 END AS part FROM s)
SELECT seq, part, CASE WHEN part = 1 THEN '' ELSE vessel_name END AS vessel_name, CASE WHEN part IS NULL OR part = 1 THEN call_sign END AS call_sign, CASE WHEN part IS NULL OR part = 1 THEN to_bow END AS to_bow FROM h""")
def wire_statics(spark, sf_dir):
    """Static frames of class A (part null) and of both halves of class B."""
    part = F.when(F.col("seq") % 3 != 0, F.col("seq") % 3 - 1)
    return state.wire_static(fixtures.statics(spark, sf_dir).withColumn("part", part)).select("seq", "part", "vessel_name", "call_sign", "to_bow")


@_query(f"""{_M} SELECT seq, vessel_name IS NOT NULL OR call_sign IS NOT NULL OR destination IS NOT NULL OR imo IS NOT NULL OR ship_type IS NOT NULL OR draught_t IS NOT NULL OR sized AS present,
  CASE WHEN sized THEN coalesce(to_bow, 0) END AS to_bow, CASE WHEN sized THEN coalesce(to_port, 0) END AS to_port
FROM (SELECT seq, nullif(trim(vessel_name), '') AS vessel_name, nullif(trim(call_sign), '') AS call_sign, nullif(trim(destination), '') AS destination, imo, nullif(ship_type, 0) AS ship_type, draught_t, to_bow, to_port,
  to_bow IS NOT NULL OR to_stern IS NOT NULL OR to_port IS NOT NULL OR to_starboard IS NOT NULL AS sized FROM m)""")
def static_payloads(spark, sf_dir):
    rows = state.static_payload(state.carried(fixtures.static_messages(spark, sf_dir)))
    return rows.select("seq", F.col("static").isNotNull().alias("present"), "static.sizes.to_bow", "static.sizes.to_port")


@_query(f"""{_PS}, {_LATEST} SELECT mmsi, round(coalesce(l.lng, s.seq / 1000.0e0), 6) AS lng, round(coalesce(l.lat, s.seq / 2000.0e0), 6) AS lat, l.sog_t FROM s LEFT JOIN (SELECT * FROM l WHERE lng IS NOT NULL) l USING (mmsi)
WHERE l.lng IS NOT NULL OR s.seq % 3 <> 0""")
def archived_fixes(spark, sf_dir):
    """The last fix of each vessel, else its stored filter, which counts only if it is whole."""
    c = F.col
    fixes = tracks.latest(fixtures.positions(spark, sf_dir)).where("lng IS NOT NULL").select("mmsi", F.struct("lng", "lat", "sog_t", "cog_t").alias("position"))
    covariance = tracks.covariance16(F.lit(1.0), F.lit(0.0), F.lit(1.0))
    whole = F.when(c("seq") % 3 != 0, covariance).otherwise(F.array(F.lit(1.0)))
    stored = fixtures.statics(spark, sf_dir).select("mmsi", state.filter_payload(c("seq") / 1000, c("seq") / 2000, F.lit(0.0), F.lit(0.0), whole).alias("filter"))
    rows = stored.join(fixes, "mmsi", "left").select("mmsi", state.archived_fix(c("position"), c("filter")).alias("f")).where("f IS NOT NULL")
    return rows.select("mmsi", F.round("f.lng", 6).alias("lng"), F.round("f.lat", 6).alias("lat"), "f.sog_t")


@_query(f"""{_PS} SELECT p.seq, p.mmsi, s.seq AS stored FROM p LEFT JOIN s ON s.mmsi = p.mmsi AND s.seq % 2 = 0""")
def batch_with_filters(spark, sf_dir):
    """A batch of positions with what is stored of its vessels."""
    stored = fixtures.statics(spark, sf_dir).where("seq % 2 = 0").select("mmsi", F.col("seq").alias("stored"))
    return state.with_stored_filter(fixtures.positions(spark, sf_dir).select("seq", "mmsi"), stored).select("seq", "mmsi", "stored")


@_query(f"{_PS} SELECT p.seq, p.mmsi, vessel_name FROM p JOIN s ON s.mmsi = p.mmsi WHERE destination = 'MACHINERY'")
def watched(spark, sf_dir):
    """Positions of the vessels on a list."""
    listed = fixtures.statics(spark, sf_dir).where("destination = 'MACHINERY'").select("mmsi", "vessel_name")
    return state.watched(fixtures.positions(spark, sf_dir).select("seq", "mmsi"), listed).select("seq", "mmsi", "vessel_name")


@_query(f"{_PS} SELECT mmsi, vessel_name FROM s WHERE mmsi IN (SELECT mmsi FROM p)")
def kept_vessels(spark, sf_dir):
    return reads.kept_of(fixtures.statics(spark, sf_dir), fixtures.positions(spark, sf_dir)).select("mmsi", "vessel_name")


@_query("SELECT coalesce(max(c_custkey), 0) + 1 AS next FROM customer WHERE c_custkey % 3 = 0")
def next_zone_number(spark, sf_dir):
    """Labels of which every third is numbered."""
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Custom Zone "), F.col("c_custkey"))).otherwise(F.col("c_name"))
    return state.next_zone_number(spark.read.parquet(f"{sf_dir}/customer.parquet").select(label.alias("label")))


# Lines and boxes


@_query(f"{_P} SELECT seq, concat('!A,', seq) AS value FROM p UNION ALL SELECT seq, concat('$B,', seq) FROM p")
def split_lines(spark, sf_dir):
    """Datagrams of two sentences, with blank lines and spaces around."""
    seq = F.col("seq").cast("string")
    return quality.lines(fixtures.positions(spark, sf_dir).select("seq", F.concat(F.lit("  !A,"), seq, F.lit("\r\n\r\n"), F.lit("$B,"), seq, F.lit(" \n")).alias("value"))).select("seq", "value")


@_query(f"{_P} SELECT seq, 2 * (35 + seq % 20) + 2 > 82 AS datagram, 35 + seq % 20 > 82 AS relay FROM p")
def long_lines(spark, sf_dir):
    """Lines of two-byte characters: datagrams count bytes as they come, the relay's lines characters after trimming."""
    value = F.expr("concat(' ', repeat('é', CAST(35 + seq % 20 AS INT)), ' ')")
    return fixtures.positions(spark, sf_dir).select("seq", quality.too_long(value, False).alias("datagram"), quality.too_long(value, True).alias("relay"))


@_query(f"{_P} SELECT seq FROM p WHERE lng BETWEEN 14.55e0 AND 14.7e0 AND lat BETWEEN 53.38e0 AND 53.5e0")
def boxed(spark, sf_dir):
    return fixtures.positions(spark, sf_dir).where(quality.in_box(F.col("lng"), F.col("lat"), 14.55, 53.38, 14.7, 53.5)).select("seq")


# Sinks, read back


@_query(f"""{_P} SELECT mmsi, t_s, round(lng, 6) AS lng, round(lat, 6) AS lat, sog_t, cog_t, heading, nav_status, source_id,
  CASE WHEN coalesce(sog_t > 5, FALSE) THEN 1 ELSE 0 END + CASE WHEN lng IS NOT NULL AND lat IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN floor(mmsi / 1000000) BETWEEN 200 AND 799 THEN 4 ELSE 0 END AS flags FROM p""")
def packed_updates(spark, sf_dir):
    """Updates packed to frames of 40 bytes and unpacked again."""
    out = sinks.unpacked(sinks.packed(reads.updates(fixtures.positions(spark, sf_dir)))).where("reason IS NULL")
    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    return out.select("mmsi", "t_s", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), tenths("sog").alias("sog_t"), tenths("cog").alias("cog_t"), "heading", "nav_status", "source_id", "flags")


@_query(f"{_P} SELECT strftime(make_timestamp(({_FAST}) * 1000000), '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT mmsi) AS vessels, sum(seq) AS seqs FROM p GROUP BY 1")
def positions_by_day(spark, sf_dir):
    """Positions appended to a table by day, and read back."""
    path = shared_path(spark, "positions")
    sinks.append_positions(fixtures.positions(spark, sf_dir).withColumn("t_s", F.expr(_FAST)), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"), F.sum("seq").alias("seqs"))


@_query(f"""{_P}, g AS (SELECT *, {_FIRST_REASON} AS reason FROM p)
SELECT seq, t_s AS ts, source_id, reason AS kind, {_COARSE_REASON} AS gate, strftime(make_timestamp(t_s * 1000000), '%Y-%m-%d') AS day FROM g WHERE reason IS NOT NULL""")
def dead_letters(spark, sf_dir):
    """Quarantined rows written as JSON lines by day, and read back."""
    path = shared_path(spark, "dead-letters")
    sinks.dead_letters(quality.quarantine(quality.gated(fixtures.positions(spark, sf_dir))), path)
    rows = spark.read.schema("ts long, source_id long, reason struct<kind: string, gate: string>, raw string, day date").json(path)
    return rows.select(F.get_json_object("raw", "$.seq").cast("long").alias("seq"), "ts", "source_id", "reason.kind", "reason.gate", F.col("day").cast("string").alias("day"))


@_query(f"{_P} SELECT DISTINCT strftime(make_timestamp(({_FAST}) * 1000000), '%Y-%m-%d') AS day FROM p WHERE CAST(make_timestamp(({_FAST}) * 1000000) AS DATE) < DATE '2024-01-03' - 1")
def expired_days(spark, sf_dir):
    rows = fixtures.positions(spark, sf_dir).select(F.to_date(F.timestamp_seconds(F.expr(_FAST))).alias("day"))
    return sinks.expired_days(rows, "2024-01-03", 1).select(F.col("day").cast("string").alias("day"))


@_query(f"{_TRAIL_POINTS} SELECT mmsi, count(*) AS n, round(arg_max(lng, i), 6) AS last_lng, round(arg_min(lat, i), 6) AS first_lat FROM tp GROUP BY mmsi HAVING count(*) >= 2")
def trail_lines(spark, sf_dir):
    """Trails as GeoJSON lines, read back."""
    rows = reads.trail_features(tracks.trails(fixtures.positions(spark, sf_dir)))
    line = F.from_json("feature", "geometry struct<coordinates: array<array<double>>>")["geometry"]["coordinates"]
    at = lambda i, j: F.round(F.element_at(F.element_at(line, i), j), 6)
    return rows.select("mmsi", F.size(line).cast("long").alias("n"), at(-1, 1).alias("last_lng"), at(1, 2).alias("first_lat"))


@_query(f"""{_TRAIL_POINTS}, s AS ({STATICS}), ends AS (SELECT mmsi, arg_max(seq, i) AS seq FROM tp GROUP BY mmsi HAVING count(*) >= 2)
SELECT n.mmsi, CASE WHEN s.ship_type IS NULL THEN 'other' ELSE {_CATEGORY_SQL} END AS category, n.mmsi = 261000007 AS selected, coalesce(p.sog_t > 5, FALSE) AS is_moving
FROM ends n LEFT JOIN s ON s.mmsi = n.mmsi JOIN p ON p.mmsi = n.mmsi AND p.seq = n.seq WHERE n.mmsi % 3 <> 0""")
def trail_properties(spark, sf_dir):
    """What trails say of their vessels, of the vessels whose trails are shown; read back from the features."""
    p = fixtures.positions(spark, sf_dir)
    shown = p.select("mmsi").where("mmsi % 3 <> 0")
    rows = reads.trail_features(tracks.trails(p), p, fixtures.statics(spark, sf_dir), 261000007, shown)
    about = F.from_json("feature", "properties struct<category: string, selected: boolean, isMoving: boolean>")["properties"]
    return rows.select("mmsi", about["category"].alias("category"), about["selected"].alias("selected"), about["isMoving"].alias("is_moving"))


@_query(f"""{_P}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p) WHERE rn = 1)
SELECT mmsi, round(lng, 6) AS lng FROM l WHERE lng IS NOT NULL AND lat IS NOT NULL""")
def collected_features(spark, sf_dir):
    """All features in collections of about twenty, read back."""
    rows = reads.feature_collections(reads.vessel_features(tracks.latest(fixtures.positions(spark, sf_dir)), fixtures.statics(spark, sf_dir), AS_OF), 20)
    kind = "features array<struct<properties: struct<mmsi: long>, geometry: struct<coordinates: array<double>>>>"
    each = rows.select(F.explode(F.from_json("collection", kind)["features"]).alias("f"))
    return each.select("f.properties.mmsi", F.round(F.get("f.geometry.coordinates", F.lit(0)), 6).alias("lng"))


# Live views


@_query(f"{_P}, {_LATEST.replace('FROM p)', f'FROM p WHERE t_s <= {_EARLY})')} SELECT mmsi, t_s FROM l WHERE {_EARLY} - t_s <= 600")
def live_vessels(spark, sf_dir):
    """Vessels whose last fix is at most 600 s old."""
    seen = fixtures.positions(spark, sf_dir).where(F.col("t_s") <= _EARLY)
    return reads.live(tracks.latest(seen), _EARLY).select("mmsi", "t_s")


@_query(f"""{_P}, {_LATEST}, h AS ({_HITS}), z AS (SELECT l.mmsi FROM l WHERE lng BETWEEN 14.4000005e0 AND 14.9000005e0 AND lat BETWEEN 53.3000005e0 AND 53.6000005e0
  UNION SELECT l.mmsi FROM l JOIN h ON h.mmsi = l.mmsi AND h.seq = l.seq WHERE zone_id <> 'E') SELECT mmsi FROM z""")
def in_visible_zone(spark, sf_dir):
    """Vessels whose last fix is in any visible zone; backdrops count too."""
    return geo.in_any(tracks.latest(fixtures.positions(spark, sf_dir)), geo.rendered(fixtures.zones(spark))).select("mmsi")


@_query(f"{_P} SELECT source_id, count(DISTINCT mmsi) AS vessels, count(DISTINCT mmsi) FILTER (WHERE lng IS NOT NULL AND lat IS NOT NULL) AS with_fix FROM p GROUP BY source_id")
def vessel_counts(spark, sf_dir):
    return quality.vessel_counts(fixtures.positions(spark, sf_dir), "source_id")


@_query(f"""{_PS}, {_LATEST} SELECT l.mmsi, coalesce(heading IS NOT NULL OR cog_t IS NOT NULL, FALSE) AS has_heading, sog_t, cog_t, coalesce(sog_t > 5, FALSE) AS moving, l.mmsi = (SELECT min(mmsi) FROM s) AS selected
FROM l WHERE lng IS NOT NULL AND lat IS NOT NULL""")
def feature_properties(spark, sf_dir):
    """The further properties of the GeoJSON features, read back, with the first vessel selected."""
    s = fixtures.statics(spark, sf_dir)
    chosen = s.agg(F.min("mmsi")).first()[0]
    rows = reads.vessel_features(tracks.latest(reads.updates(fixtures.positions(spark, sf_dir))), s, AS_OF, chosen)
    p = F.from_json("feature", "properties struct<hasHeading: boolean, sog: double, cog: double, isMoving: boolean, selected: boolean>")["properties"]
    tenths = lambda c: F.round(p[c] * 10).cast("long")
    return rows.select("mmsi", p["hasHeading"].alias("has_heading"), tenths("sog").alias("sog_t"), tenths("cog").alias("cog_t"), p["isMoving"].alias("moving"), p["selected"].alias("selected"))


@_query(f"""{_P} SELECT seq, (seq % 8) & 1 = 1 AS moving, (seq % 8) | 4 AS with_identity, (seq % 8) & ~2 AS without_fix FROM p""")
def flag_changes(spark, sf_dir):
    flags = (F.col("seq") % 8).cast("int")
    return fixtures.positions(spark, sf_dir).select("seq", ais.has_flag(flags, ais.FLAG_MOVING).alias("moving"), ais.with_flag(flags, ais.FLAG_IDENTITY).alias("with_identity"), ais.without_flag(flags, ais.FLAG_FIX).alias("without_fix"))


@_query(f"""{_P}, {_EVENTS}, n AS (SELECT mmsi, zone_id, arg_max(kind, at_s * 2 + CASE WHEN kind = 'enter' THEN 1 ELSE 0 END) AS kind FROM e GROUP BY ALL)
SELECT mmsi, zone_id FROM n WHERE kind = 'enter' AND mmsi NOT IN (SELECT mmsi FROM p WHERE t_s <= {_EARLY} GROUP BY mmsi HAVING {_EARLY} - max(t_s) <= 600)""")
def forced_exits(spark, sf_dir):
    """Confirmed stays in zones of vessels that aren't live at the moment."""
    p, zones = fixtures.positions(spark, sf_dir), fixtures.zones(spark)
    inside = geo.badges(geo.presence(geo.geofence_events(p, zones)), zones)
    return reads.orphans(inside, reads.live(tracks.latest(p.where(F.col("t_s") <= _EARLY)), _EARLY)).select("mmsi", "zone_id")


# Texts


@_query(f"""{_PS} SELECT p.seq, coalesce(printf('%.1f kn', sog_t / 10.0e0), '—') AS sog, coalesce(printf('%.1f°', cog_t / 10.0e0), '—') AS cog, coalesce(heading || '°', '—') AS heading,
  coalesce(printf('%.6f', abs(lat)) || CASE WHEN lat >= 0 THEN '° N' ELSE '° S' END, '—') AS lat, coalesce(printf('%.6f', abs(lng - 14.6e0)) || CASE WHEN lng - 14.6e0 >= 0 THEN '° E' ELSE '° W' END, '—') AS lng,
  CASE WHEN vessel_name <> '' THEN vessel_name ELSE '—' END AS name, coalesce({_LABEL_SQL} || ' (' || ship_type || ')', '—') AS ship_type FROM p LEFT JOIN s ON s.mmsi = p.mmsi""")
def position_texts(spark, sf_dir):
    c = F.col
    rows = fixtures.positions(spark, sf_dir).join(fixtures.statics(spark, sf_dir).select("mmsi", "vessel_name", "ship_type"), "mmsi", "left")
    return rows.select(
        "seq", ais.sog_text(c("sog_t") / 10).alias("sog"), ais.cog_text(c("cog_t") / 10).alias("cog"), ais.heading_text(c("heading")).alias("heading"), ais.degrees_text(c("lat"), "lat").alias("lat"),
        ais.degrees_text(c("lng") - 14.6, "lng").alias("lng"), ais.or_dash(c("vessel_name"), c("vessel_name") == "").alias("name"), ais.ship_type_text(c("ship_type")).alias("ship_type"),
    )


@_query(f"""{_P}, a AS (SELECT seq, t_s, t_s + seq * 37 % 200000 - 50 AS now_s FROM p), b AS (SELECT *, greatest(now_s - t_s, 0) AS age FROM a)
SELECT seq, CASE WHEN age < 60 THEN age || 's ago' WHEN age < 3600 THEN age // 60 || 'm ago' ELSE age // 3600 || 'h ago' END AS relative,
  CASE WHEN age < 60 THEN age || 's ago' WHEN age < 3600 THEN age // 60 || 'm ago' WHEN age < 86400 THEN age // 3600 || 'h ago' ELSE strftime(make_timestamp(t_s * 1000000), '%Y-%m-%d %H:%M') END AS event_time,
  strftime(make_timestamp(t_s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, (t_s * 1000 + seq % 1000) // 1000 AS seconds FROM b""")
def time_texts(spark, sf_dir):
    rows = fixtures.positions(spark, sf_dir).withColumn("now_s", F.expr("t_s + seq * 37 % 200000 - 50"))
    t, now = F.col("t_s"), F.col("now_s")
    return rows.select("seq", ais.relative_time(t, now).alias("relative"), ais.event_time(t, now).alias("event_time"), ais.iso_text(t * 1000).alias("iso"), ais.whole_seconds(t * 1000 + F.col("seq") % 1000).alias("seconds"))


@_query(f"""{_PS}, {_EVENTS}, {_LATEST}, n AS (SELECT kind, e.mmsi, zone_id, at_s, silent_s, coalesce(nullif(trim(vessel_name), ''), 'MMSI ' || e.mmsi) AS vessel, CASE {_LABELS} END AS zone,
  nullif(concat_ws(' · ', printf('%.1f kn', sog_t / 10.0e0), CAST(floor(cog_t / 10.0e0 + 0.5) AS BIGINT) || '°', nullif(trim(call_sign), '')), '') AS about FROM e LEFT JOIN s ON s.mmsi = e.mmsi LEFT JOIN l ON l.mmsi = e.mmsi)
SELECT kind || '|' || mmsi || '|' || zone_id || '|' || at_s AS event_id, CASE kind WHEN 'enter' THEN vessel || ' entered ' || zone WHEN 'exit' THEN vessel || ' left ' || zone
  ELSE vessel || ' silent in ' || zone || ' for ' || CAST(floor(silent_s / 60.0e0 + 0.5) AS BIGINT) || ' min' END AS title, about FROM n""")
def alert_texts(spark, sf_dir):
    """Events as alerts: a title, and what is known of the vessel."""
    p = fixtures.positions(spark, sf_dir)
    zones = fixtures.zones(spark)
    return reads.alert_texts(geo.geofence_events(p, zones), fixtures.statics(spark, sf_dir), zones, tracks.latest(p)).select("event_id", "title", "about")


@_query(f"""{_P} SELECT seq, CASE seq % 6 WHEN 0 THEN 'LocalUdp' WHEN 1 THEN 'WebSdr' WHEN 2 THEN 'AisStream' WHEN 3 THEN 'EdgeBridge' ELSE 'Unknown' END AS label,
  CASE seq % 6 WHEN 0 THEN 'Local dev UDP feed' WHEN 1 THEN 'Regional WebSDR fallback' WHEN 2 THEN 'Public AisStream fallback' WHEN 3 THEN 'Own RTL-SDR antenna over mTLS edge bridge' ELSE 'Source not recorded (pre sourceId tracking)' END AS about FROM p""")
def source_texts(spark, sf_dir):
    source = F.when(F.col("seq") % 6 != 5, F.col("seq") % 6)
    return fixtures.positions(spark, sf_dir).select("seq", ais.source_label(source).alias("label"), ais.source_description(source).alias("about"))


@_query(f"""{_P} SELECT seq, CASE WHEN seq % 3 = 0 THEN mmsi END AS mmsi, CASE WHEN seq % 3 = 0 THEN 'A' END AS zone_id FROM p""")
def membership_keys(spark, sf_dir):
    """Keys of vessel and zone, of which two of three are broken, taken apart."""
    k = F.col("seq") % 3
    key = F.when(k == 0, ais.membership_key(F.col("mmsi"), F.lit("A"))).when(k == 1, F.lit("x|A")).otherwise(F.concat(F.col("mmsi").cast("string"), F.lit("|A|B")))
    return fixtures.positions(spark, sf_dir).select("seq", ais.parsed_key(key).alias("k")).select("seq", "k.mmsi", "k.zone_id")


@_query(f"""{_P}, {_LATEST}, t AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rk, max(t_s) OVER (PARTITION BY mmsi) AS end_s FROM p)
SELECT mmsi, string_agg(CASE WHEN rk <= 3 THEN CAST(seq AS VARCHAR) END, ',' ORDER BY rk) AS newest, CAST(count(*) FILTER (WHERE rk <= 10 AND t_s >= end_s - 60) AS INTEGER) AS fresh FROM t GROUP BY mmsi""")
def history_slices(spark, sf_dir):
    """Of the last ten fixes of each vessel: the newest three first, and how many are at most 60 s older than the last."""
    points = tracks.latest(fixtures.positions(spark, sf_dir), 10).groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("t_s", "seq"))).alias("points"))
    p = F.col("points")
    newest = F.transform(F.reverse(reads.last_points(p, 3)), lambda x: x["seq"].cast("string"))
    return points.select("mmsi", F.array_join(newest, ",").alias("newest"), F.size(reads.fresh_points(p, F.element_at(p, -1)["t_s"] - 60)).alias("fresh"))
