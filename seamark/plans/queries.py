"""Registered queries of the ship-radio engine, each with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators import failover, feeds, frames, geo, quality, reads, tracks
from seamark.sources import fixtures
from seamark.sources.fixtures import AS_OF, POSITIONS, STATICS, ZONES
from seamark.sources.landing import landed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_P = f"WITH p AS ({POSITIONS})"
_PS = f"WITH p AS ({POSITIONS}), s AS ({STATICS})"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FIRST_REASON = """CASE
    WHEN NOT (mmsi BETWEEN 0 AND 999999999 AND floor(mmsi / 1000000) BETWEEN 200 AND 799) THEN 'mmsi-invalid-format'
    WHEN NOT (mmsi BETWEEN 100000000 AND 999999999) THEN 'mmsi-out-of-range'
    WHEN NOT (floor(mmsi / 1000000) BETWEEN 201 AND 775 OR floor(mmsi / 1000000) IN (111, 970, 972, 974) OR floor(mmsi / 1000000) BETWEEN 990 AND 999) THEN 'mmsi-invalid-mid'
    WHEN lng IS NULL OR lat IS NULL THEN NULL
    WHEN NOT lat BETWEEN -90 AND 90 THEN 'lat-out-of-range'
    WHEN NOT lng BETWEEN -180 AND 180 THEN 'lng-out-of-range'
    WHEN sog_t IS NOT NULL AND NOT sog_t BETWEEN 0 AND 1022 THEN 'sog-out-of-range'
    WHEN cog_t IS NOT NULL AND NOT cog_t BETWEEN 0 AND 3600 THEN 'cog-out-of-range'
    WHEN heading IS NOT NULL AND NOT heading BETWEEN 0 AND 359 THEN 'heading-out-of-range' END"""


_COARSE_REASON = """CASE WHEN reason LIKE 'mmsi%' THEN 'invalid-mmsi' WHEN reason = 'lat-out-of-range' THEN 'out-of-range-lat' WHEN reason = 'lng-out-of-range' THEN 'out-of-range-lng'
    WHEN reason IN ('sog-out-of-range', 'cog-out-of-range', 'heading-out-of-range') THEN 'invalid-payload' WHEN reason IN ('rate-limited', 'new-vessel-limited') THEN 'rate-limit' ELSE reason END"""


@_query(f"""{_PS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p) WHERE rn = 1)
SELECT s.mmsi, vessel_name, CASE WHEN lng IS NOT NULL AND lat IS NOT NULL THEN round(lng, 6) END AS lng,
  CASE WHEN lng IS NOT NULL AND lat IS NOT NULL THEN round(lat, 6) END AS lat, to_bow + to_stern AS length_m, t_s AS updated_s
FROM s LEFT JOIN l ON s.mmsi = l.mmsi ORDER BY t_s DESC NULLS LAST, s.mmsi LIMIT 100""")
def latest_positions(spark, sf_dir):
    rows = reads.summary(reads.list_vessels(fixtures.statics(spark, sf_dir), fixtures.positions(spark, sf_dir)))
    return rows.select("mmsi", "vessel_name", F.round("position.lng", 6).alias("lng"), F.round("position.lat", 6).alias("lat"), (F.col("dimensions.to_bow") + F.col("dimensions.to_stern")).alias("length_m"), "updated_s")


@_query(f"""{_P}, g AS (SELECT *, {_FIRST_REASON} AS reason FROM p)
SELECT coalesce(reason, 'accepted') AS outcome, coalesce({_COARSE_REASON}, 'accepted') AS gate,
  count(*) AS n, count(DISTINCT mmsi) AS vessels FROM g GROUP BY 1, 2""")
def gate_counts(spark, sf_dir):
    rows = quality.gated(fixtures.positions(spark, sf_dir))
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"), F.coalesce(ais.coarse_reason(F.col("reason")), F.lit("accepted")).alias("gate")).agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"))


@_query(f"""{_P}, g AS (SELECT *, {_FIRST_REASON} AS reason FROM p)
SELECT seq, mmsi, source_id, reason FROM g WHERE reason IS NOT NULL""")
def quarantined(spark, sf_dir):
    return quality.gated(fixtures.positions(spark, sf_dir)).where("reason IS NOT NULL").select("seq", "mmsi", "source_id", "reason")


@_query(f"""{_P}, g AS (SELECT *, {_FIRST_REASON} AS reason FROM p)
SELECT source_id, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected, max(t_s) AS last_frame_s FROM g GROUP BY source_id""")
def source_counts(spark, sf_dir):
    return quality.source_counts(quality.gated(fixtures.positions(spark, sf_dir)))


@_query(f"""WITH s AS ({STATICS})
SELECT mmsi, imo, coalesce(imo BETWEEN 1000000 AND 9999999 AND (floor(imo / 1000000) * 7 + floor(imo / 100000) % 10 * 6 + floor(imo / 10000) % 10 * 5
  + floor(imo / 1000) % 10 * 4 + floor(imo / 100) % 10 * 3 + floor(imo / 10) % 10 * 2) % 10 = imo % 10, FALSE) AS imo_ok FROM s""")
def imo_check(spark, sf_dir):
    return fixtures.statics(spark, sf_dir).select("mmsi", "imo", ais.imo_checks(F.col("imo")).alias("imo_ok"))


_SESSION = """x AS (SELECT *, sum(CASE WHEN gap > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS session
  FROM (SELECT *, t_s - lag(t_s) OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS gap FROM p))"""


@_query(f"""{_P}, {_SESSION}
SELECT seq, mmsi, last_value(sog_t IGNORE NULLS) OVER w AS sog_t, last_value(heading IGNORE NULLS) OVER w AS heading, round(last_value(lng IGNORE NULLS) OVER w, 6) AS lng,
  round(last_value(lat IGNORE NULLS) OVER w, 6) AS lat FROM x WINDOW w AS (PARTITION BY mmsi, session ORDER BY t_s, seq ROWS UNBOUNDED PRECEDING)""")
def live_merge(spark, sf_dir):
    rows = tracks.live_merge(fixtures.positions(spark, sf_dir), ["sog_t", "heading", "lng", "lat"])
    return rows.select("seq", "mmsi", "sog_t", "heading", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


_MOVING = f"""{_SESSION}, mv AS (SELECT *, coalesce(last_value(CASE WHEN sog_t > 5 THEN TRUE WHEN sog_t < 3 THEN FALSE END IGNORE NULLS)
  OVER (PARTITION BY mmsi, session ORDER BY t_s, seq ROWS UNBOUNDED PRECEDING), FALSE) AS moving FROM x)"""


@_query(f"{_P}, {_MOVING} SELECT seq, mmsi, CAST(session AS BIGINT) AS session, moving FROM mv")
def movement_hysteresis(spark, sf_dir):
    return tracks.hysteresis(fixtures.positions(spark, sf_dir), F.col("sog_t") / 10).select("seq", "mmsi", "session", "moving")


@_query(f"""{_P}
SELECT mmsi, CAST(floor(t_s / 60) * 60 AS BIGINT) AS window_s, count(*) AS n_frames, max(seq) AS last_seq, max(t_s) AS last_seen_s, arg_max(source_id, seq) AS last_source,
  arg_max(sog_t, seq) FILTER (WHERE sog_t IS NOT NULL) AS sog_t, arg_max(heading, seq) FILTER (WHERE heading IS NOT NULL) AS heading FROM p GROUP BY 1, 2""")
def coalesced(spark, sf_dir):
    return tracks.coalesce_window(fixtures.positions(spark, sf_dir), ["sog_t", "heading"], 60)



# Recurrences as recursive SQL: a step joins each vessel's row k to what row k - 1 left.


def _rate_sql(rows: str) -> str:
    """CTEs r0 and rate (mmsi, seq, accepted): a bucket of 5 a vessel, a token a second, over ``rows`` (mmsi, t_s, seq)."""
    return f"""r0 AS MATERIALIZED (SELECT mmsi, seq, t_s, row_number() OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS k FROM {rows}),
rate AS (SELECT mmsi, seq, t_s, k, CAST(4 AS BIGINT) AS tokens, TRUE AS accepted FROM r0 WHERE k = 1
  UNION ALL SELECT mmsi, seq, t_s, k, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1
  FROM (SELECT r0.*, CAST(least(5, rate.tokens + r0.t_s - rate.t_s) AS BIGINT) AS have FROM rate JOIN r0 ON r0.mmsi = rate.mmsi AND r0.k = rate.k + 1) h)"""


def _bucket_sql(rows: str, burst: int, per_minute: int) -> str:
    """CTEs known and since (mmsi, from_t, from_seq): a step is the next frame of an unknown vessel that finds a token."""
    return f"""known AS (SELECT CAST(0 AS BIGINT) AS n, CAST({60 * burst} AS BIGINT) AS tokens, (SELECT min(t_s) FROM {rows}) AS t, CAST(-1 AS BIGINT) AS s, CAST([] AS BIGINT[]) AS ids
  UNION ALL SELECT n + 1, CAST(least({60 * burst}, tokens + (f.t_s - t) * {per_minute}) - 60 AS BIGINT), f.t_s, f.seq, list_append(ids, f.mmsi)
  FROM (SELECT k.n, k.tokens, k.t, k.ids, min({{'t_s': f.t_s, 'seq': f.seq, 'mmsi': f.mmsi}}) AS f FROM known k JOIN {rows} f ON (f.t_s > k.t OR (f.t_s = k.t AND f.seq > k.s))
    AND least({60 * burst}, k.tokens + (f.t_s - k.t) * {per_minute}) >= 60 AND NOT list_contains(k.ids, f.mmsi) GROUP BY ALL) g),
since AS (SELECT ids[n] AS mmsi, t AS from_t, s AS from_seq FROM known WHERE n > 0)"""


_TRAIL = f"""WITH RECURSIVE p AS ({POSITIONS}),
f AS MATERIALIZED (SELECT mmsi, seq, t_s, lng, lat, row_number() OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS k FROM p WHERE lng IS NOT NULL AND lat IS NOT NULL),
o AS (SELECT mmsi, seq, t_s, lng, lat, k, CAST(0 AS BIGINT) AS session, TRUE AS accepted, t_s AS t0, lng AS lng0, lat AS lat0 FROM f WHERE k = 1
  UNION ALL SELECT mmsi, seq, t_s, lng, lat, k, session, ok, CASE WHEN ok THEN t_s ELSE t0 END, CASE WHEN ok THEN lng ELSE lng0 END, CASE WHEN ok THEN lat ELSE lat0 END
  FROM (SELECT *, t0 IS NULL OR t_s <= t0 OR sqrt(pow((lng - lng0) * 111000.0e0 * cos(radians((lat0 + lat) / 2)), 2) + pow((lat - lat0) * 111000.0e0, 2)) <= 60.0e0 * 0.5144e0 * (t_s - t0) + 75.0e0 AS ok
    FROM (SELECT f.*, o.session + CASE WHEN f.t_s - o.t_s > 600 THEN 1 ELSE 0 END AS session, CASE WHEN f.t_s - o.t_s <= 600 THEN o.t0 END AS t0, o.lng0, o.lat0 FROM o JOIN f ON f.mmsi = o.mmsi AND f.k = o.k + 1) h) g)"""
_TRAIL_POINTS = f"""{_TRAIL}, a AS (SELECT *, max(t_s) OVER (PARTITION BY mmsi) AS end_s, max(session) OVER (PARTITION BY mmsi) AS newest FROM o WHERE accepted),
n AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM a WHERE session = newest AND t_s >= end_s - 300),
tp AS (SELECT mmsi, CAST(row_number() OVER (PARTITION BY mmsi ORDER BY t_s, seq) - 1 AS INTEGER) AS i, t_s, seq, lng, lat FROM n WHERE rn <= 30)"""

_KALMAN = f"""WITH RECURSIVE p AS ({POSITIONS}),
f AS MATERIALIZED (SELECT mmsi, seq, t_s, lng, lat, row_number() OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS k FROM p WHERE lng IS NOT NULL AND lat <= 90),
kf AS (SELECT mmsi, seq, t_s, k, lng, lat, 0.0e0 AS vlng, 0.0e0 AS vlat, 9e-4 * 9e-4 AS p00, 0.0e0 AS p01, 1e-5 * 1e-5 AS p11 FROM f WHERE k = 1
  UNION ALL SELECT mmsi, seq, t_s, k, CASE WHEN fit THEN x + g0 * (lng - x) ELSE lng END, CASE WHEN fit THEN y + g0 * (lat - y) ELSE lat END, CASE WHEN fit THEN vlng + g1 * (lng - x) ELSE 0.0e0 END, CASE WHEN fit THEN vlat + g1 * (lat - y) ELSE 0.0e0 END,
    CASE WHEN fit THEN n00 ELSE 9e-4 * 9e-4 END, CASE WHEN fit THEN n01 ELSE 0.0e0 END, CASE WHEN fit THEN n11 ELSE 1e-5 * 1e-5 END
  FROM (SELECT *, abs(n00) <= 1000 AND abs(n01) <= 1000 AND abs(n11) <= 1000 AS fit
    FROM (SELECT *, (1 - g0) * q00 AS n00, (1 - g0) * q01 AS n01, q11 - g1 * q01 AS n11
      FROM (SELECT *, q00 / (q00 + 9e-5 * 9e-5) AS g0, q01 / (q00 + 9e-5 * 9e-5) AS g1
        FROM (SELECT *, x0 + vlng * dt AS x, y0 + vlat * dt AS y, p00 + 2 * dt * p01 + dt * dt * p11 + 9e-7 * 9e-7 * dt * dt * dt * dt / 4 AS q00,
            p01 + dt * p11 + 9e-7 * 9e-7 * dt * dt * dt / 2 AS q01, p11 + 9e-7 * 9e-7 * dt * dt AS q11
          FROM (SELECT f.*, kf.lng AS x0, kf.lat AS y0, kf.vlng, kf.vlat, kf.p00, kf.p01, kf.p11, CAST(greatest(least(f.t_s - kf.t_s, 60), 0) AS DOUBLE) AS dt FROM kf JOIN f ON f.mmsi = kf.mmsi AND f.k = kf.k + 1) a) b) c) d) e)"""


@_query(f"""WITH RECURSIVE p AS ({POSITIONS}), slow AS (SELECT mmsi, seq, CAST(floor(t_s / 15) AS BIGINT) AS t_s FROM p), {_rate_sql('slow')} SELECT mmsi, seq, accepted FROM rate""")
def rate_limited(spark, sf_dir):
    """Frames on a clock fifteen times as slow, so that the bucket runs dry."""
    fast = fixtures.positions(spark, sf_dir).withColumn("t_s", F.floor(F.col("t_s") / 15))
    return tracks.rate_limit(fast).select("mmsi", "seq", "accepted")


@_query(f"{_TRAIL} SELECT mmsi, session, seq, accepted FROM o")
def trail_outliers(spark, sf_dir):
    return tracks.trail_outliers(fixtures.positions(spark, sf_dir)).select("mmsi", "session", "seq", "accepted")


@_query(f"{_TRAIL_POINTS} SELECT mmsi, i, t_s, seq, round(lng, 6) AS lng, round(lat, 6) AS lat FROM tp")
def trail_points(spark, sf_dir):
    rows = tracks.trails(fixtures.positions(spark, sf_dir)).select("mmsi", F.posexplode("trail").alias("i", "p"))
    return rows.select("mmsi", "i", "p.t_s", "p.seq", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))


@_query(f"{_KALMAN} SELECT mmsi, seq, round(lng, 7) AS lng, round(lat, 7) AS lat, round(vlng * 1e6, 4) AS vlng_u, round(vlat * 1e6, 4) AS vlat_u FROM kf")
def kalman_track(spark, sf_dir):
    rows = tracks.kalman(fixtures.positions(spark, sf_dir).where("lat <= 90"))
    return rows.select("mmsi", "seq", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"), F.round(F.col("vlng") * 1e6, 4).alias("vlng_u"), F.round(F.col("vlat") * 1e6, 4).alias("vlat_u"))


@_query(f"""{_P}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p) WHERE rn = 1 AND lng IS NOT NULL),
m AS (SELECT *, sog_t / 10.0e0 AS sog, cog_t / 10.0e0 AS cog, seq % 75 AS age FROM l),
d AS (SELECT *, least(sog * 0.5144e0 * age * pow(0.5e0, age / 30.0e0), 30.0e0) AS m, coalesce(sog > 0.5 AND age <= 60, FALSE) AS go FROM m)
SELECT mmsi, round(CASE WHEN go THEN lng + m * sin(radians(cog)) / (cos(radians(lat)) * 111000.0e0) ELSE lng END, 5) AS lng,
  round(CASE WHEN go THEN lat + m * cos(radians(cog)) / 111000.0e0 ELSE lat END, 5) AS lat FROM d""")
def dead_reckoning(spark, sf_dir):
    rows = tracks.latest(fixtures.positions(spark, sf_dir)).where("lng IS NOT NULL")
    at = ais.dead_reckoned(F.col("lng"), F.col("lat"), F.col("sog_t") / 10, F.col("cog_t") / 10, F.col("seq") % 75)
    return rows.select("mmsi", F.round(at["lng"], 5).alias("lng"), F.round(at["lat"], 5).alias("lat"))


def _ring_sql(ring) -> str:
    edges = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        edges.append(f"CASE WHEN ({ay}e0 > lat) <> ({by}e0 > lat) AND lng < ({bx}e0 - {ax}e0) * (lat - {ay}e0) / ({by}e0 - {ay}e0) + {ax}e0 THEN 1 ELSE 0 END")
    return " + ".join(edges)


def _inside_sql(rings) -> str:
    return "(" + " + ".join(_ring_sql(r) for r in rings) + ") % 2 = 1"


_HITS = " UNION ALL ".join(f"SELECT mmsi, seq, t_s, '{z[0]}' AS zone_id FROM p WHERE lng IS NOT NULL AND lat IS NOT NULL AND {_inside_sql(z[5])}" for z in ZONES if not z[4])


@_query(f"{_P}, h AS ({_HITS}) SELECT seq, mmsi, zone_id FROM h")
def zone_membership(spark, sf_dir):
    return geo.membership(fixtures.positions(spark, sf_dir), geo.operational(fixtures.zones(spark))).select("seq", "mmsi", "zone_id")


@_query(f"""{_P}, h AS ({_HITS}) SELECT count(DISTINCT p.mmsi) AS tracked, count(DISTINCT h.mmsi) AS in_zone FROM p LEFT JOIN h ON p.mmsi = h.mmsi AND p.seq = h.seq AND h.zone_id <> 'E'""")
def in_zone_summary(spark, sf_dir):
    p = fixtures.positions(spark, sf_dir)
    zones = geo.rendered(geo.operational(fixtures.zones(spark)))
    hit = geo.membership(p, zones).select("mmsi").distinct().withColumn("hit", F.lit(1))
    return p.select("mmsi").distinct().join(hit, "mmsi", "left").agg(F.count("*").alias("tracked"), F.count("hit").alias("in_zone"))


_EVENTS = f"""h AS ({_HITS}),
f AS (SELECT mmsi, t_s, seq, sum(CASE WHEN gap >= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS session
  FROM (SELECT *, t_s - lag(t_s) OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS gap FROM p WHERE lng IS NOT NULL AND lat IS NOT NULL)),
a AS (SELECT f.*, z.zone_id, h.seq IS NOT NULL AS inside FROM f JOIN (SELECT DISTINCT mmsi, zone_id FROM h) z USING (mmsi) LEFT JOIN h ON h.mmsi = f.mmsi AND h.seq = f.seq AND h.zone_id = z.zone_id),
r AS (SELECT *, sum(CASE WHEN inside IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi, zone_id, session ORDER BY t_s, seq) AS run
  FROM (SELECT *, lag(inside) OVER (PARTITION BY mmsi, zone_id, session ORDER BY t_s, seq) AS was FROM a)),
q AS (SELECT *, t_s - min(t_s) OVER (PARTITION BY mmsi, zone_id, session, run) AS held FROM r),
d AS (SELECT mmsi, zone_id, session, run, inside, min(t_s) AS at_s FROM q WHERE held >= 30 GROUP BY ALL),
c AS (SELECT *, coalesce(lag(inside) OVER (PARTITION BY mmsi, zone_id, session ORDER BY run), FALSE) AS before FROM d),
e AS (
  SELECT CASE WHEN inside THEN 'enter' ELSE 'exit' END AS kind, mmsi, zone_id, at_s, CAST(NULL AS BIGINT) AS silent_s FROM c WHERE inside <> before
  UNION ALL
  SELECT 'ghost-exit', l.mmsi, l.zone_id, g.last_s + 600, 600 FROM (SELECT mmsi, zone_id, session, arg_max(inside, run) AS inside FROM d GROUP BY ALL) l
  JOIN (SELECT mmsi, session, max(t_s) AS last_s, max(max(session)) OVER (PARTITION BY mmsi) AS newest FROM f GROUP BY mmsi, session) g ON g.mmsi = l.mmsi AND g.session = l.session
  WHERE l.inside AND l.session < g.newest)"""


def _events(spark, sf_dir):
    return geo.geofence_events(fixtures.positions(spark, sf_dir), fixtures.zones(spark))


@_query(f"{_P}, {_EVENTS} SELECT kind, mmsi, zone_id, at_s, silent_s FROM e")
def geofence_events(spark, sf_dir):
    return _events(spark, sf_dir)


@_query(f"""{_P}, {_EVENTS}, n AS (SELECT mmsi, zone_id, arg_max(kind, at_s * 2 + CASE WHEN kind = 'enter' THEN 1 ELSE 0 END) AS kind FROM e GROUP BY ALL)
SELECT mmsi, coalesce(string_agg(CASE WHEN kind = 'enter' THEN zone_id END, ',' ORDER BY zone_id), '') AS zones FROM n GROUP BY mmsi""")
def presence(spark, sf_dir):
    return geo.presence(_events(spark, sf_dir)).select("mmsi", F.array_join("zones", ",").alias("zones"))


@_query(f"""{_P}, h AS ({_HITS}), z AS (SELECT mmsi, seq, string_agg(zone_id, ',' ORDER BY zone_id) AS zones FROM h GROUP BY ALL),
f AS (SELECT p.mmsi, p.seq, p.t_s, coalesce(zones, '') AS zones FROM p LEFT JOIN z USING (mmsi, seq) WHERE lng IS NOT NULL AND lat IS NOT NULL),
g AS (SELECT *, coalesce(lag(zones) OVER (PARTITION BY mmsi ORDER BY t_s, seq), '') AS was FROM f) SELECT mmsi, seq, zones FROM g WHERE zones <> was""")
def presence_changes(spark, sf_dir):
    return geo.presence_changes(fixtures.positions(spark, sf_dir), fixtures.zones(spark)).select("mmsi", "seq", F.array_join("zones", ",").alias("zones"))


_LABELS = " ".join(f"WHEN zone_id = '{z[0]}' THEN '{z[1]}'" for z in ZONES)


@_query(f"""{_PS}, {_EVENTS}, n AS (SELECT kind, e.mmsi, zone_id, at_s, coalesce(nullif(trim(vessel_name), ''), 'MMSI ' || e.mmsi) AS vessel, CASE {_LABELS} END AS zone,
  kind || '|' || e.mmsi || '|' || zone_id || '|' || at_s AS event_id FROM e LEFT JOIN s ON s.mmsi = e.mmsi WHERE kind <> 'enter' OR at_s - 1704067200 >= 90)
SELECT * FROM n ORDER BY at_s DESC, event_id LIMIT 100""")
def events_feed(spark, sf_dir):
    events = reads.alerts(_events(spark, sf_dir), F.lit(1704067200))
    return reads.events_feed(events, fixtures.statics(spark, sf_dir), fixtures.zones(spark))


_STATUS = f"""{_MOVING}, st AS (SELECT *, CASE WHEN nav_status IN (1, 5) THEN 'anchored' WHEN nav_status = 2 THEN 'nuc' WHEN moving THEN 'underway' WHEN sog_t IS NULL THEN 'anchored' ELSE 'stopped' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM mv) WHERE rn = 1)"""


@_query(f"""{_P}, {_STATUS} SELECT g.status, g.ord, count(st.mmsi) AS n FROM (VALUES ('underway', 0), ('anchored', 1), ('stopped', 2), ('nuc', 3)) g(status, ord) LEFT JOIN st ON st.status = g.status GROUP BY 1, 2""")
def status_groups(spark, sf_dir):
    return reads.status_groups(reads.with_status(fixtures.positions(spark, sf_dir)))


@_query(f"""{_PS}, {_STATUS} SELECT st.mmsi, status, nullif(trim(vessel_name), '') AS name, CASE WHEN moving THEN 1 ELSE 0 END AS moving FROM st LEFT JOIN s ON s.mmsi = st.mmsi""")
def sidebar(spark, sf_dir):
    rows = reads.sidebar(reads.with_status(fixtures.positions(spark, sf_dir)), fixtures.statics(spark, sf_dir))
    return rows.select("mmsi", "status", "name", F.col("moving").cast("int").alias("moving"))


_LABEL_SQL = "CASE " + " ".join(f"WHEN ship_type BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in ais.SHIP_TYPE_LABELS) + " END"
_CATEGORY_SQL = """CASE WHEN ship_type = 30 THEN 'fishing' WHEN ship_type IN (36, 37) THEN 'sailing' WHEN ship_type IN (31, 32, 33, 34, 35, 50, 51, 52, 53, 54, 55, 58) THEN 'service'
  WHEN ship_type BETWEEN 60 AND 69 THEN 'passenger' WHEN ship_type BETWEEN 70 AND 79 THEN 'cargo' WHEN ship_type BETWEEN 80 AND 89 THEN 'tanker' ELSE 'other' END"""


@_query(f"WITH s AS ({STATICS}) SELECT {_CATEGORY_SQL} AS category, {_LABEL_SQL} AS label, count(*) AS n FROM s GROUP BY 1, 2")
def ship_categories(spark, sf_dir):
    code = F.col("ship_type")
    return fixtures.statics(spark, sf_dir).groupBy(ais.ship_category(code).alias("category"), ais.ship_type_label(code).alias("label")).agg(F.count("*").alias("n"))


@_query(f"""{_PS}, seen AS (SELECT * FROM p WHERE t_s <= {AS_OF}), top AS (SELECT mmsi, max(t_s) AS last_seen_s FROM seen GROUP BY mmsi HAVING max(t_s) >= {AS_OF} - 86400 ORDER BY 2 DESC, 1 LIMIT 500),
h AS (SELECT * FROM (SELECT seen.*, last_seen_s, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM seen JOIN top USING (mmsi)) WHERE rn <= 30)
SELECT h.mmsi, last_seen_s, count(*) AS n, string_agg(CAST(h.seq AS VARCHAR), ',' ORDER BY t_s, h.seq) AS seqs, max(vessel_name) AS vessel_name FROM h LEFT JOIN s ON s.mmsi = h.mmsi GROUP BY 1, 2""")
def snapshot_history(spark, sf_dir):
    rows = reads.snapshot(fixtures.statics(spark, sf_dir), fixtures.positions(spark, sf_dir), AS_OF, fresh_s=86400)
    seqs = F.array_join(F.transform("history", lambda p: p["seq"].cast("string")), ",")
    return rows.select("mmsi", "last_seen_s", F.size("history").cast("long").alias("n"), seqs.alias("seqs"), "vessel_name")


@_query(f"""{_P}, l AS (SELECT * FROM (SELECT mmsi, t_s, lng, lat, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p WHERE lng IS NOT NULL AND lat IS NOT NULL) WHERE rn = 1),
a AS (SELECT max(t_s) AS anchor_s FROM l) SELECT mmsi, t_s, round(lng, 6) AS lng, round(lat, 6) AS lat, anchor_s FROM l, a WHERE anchor_s - t_s <= 600""")
def archive_snapshot(spark, sf_dir):
    p = fixtures.positions(spark, sf_dir)
    rows = reads.archive(p.where("FALSE"), p, as_of_s=4_000_000_000)
    return rows.select("mmsi", "t_s", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "anchor_s")


@_query(f"{_PS} SELECT mmsi, vessel_name FROM s WHERE mmsi NOT IN (SELECT mmsi FROM p)")
def orphans(spark, sf_dir):
    return reads.orphans(fixtures.statics(spark, sf_dir), fixtures.positions(spark, sf_dir)).select("mmsi", "vessel_name")


@_query(f"""WITH s AS ({STATICS}) SELECT mmsi, epoch_ms(CAST(DATE '2024-01-01' + to_months(CAST(eta_month - 1 AS INTEGER)) + to_days(CAST(eta_day - 1 AS INTEGER)) + to_minutes(eta_hour * 60 + eta_minute) AS TIMESTAMP)) AS eta_ms FROM s""")
def eta_timestamps(spark, sf_dir):
    eta = ais.eta_time(2024, F.col("eta_month").cast("int"), F.col("eta_day").cast("int"), F.col("eta_hour"), F.col("eta_minute"))
    return fixtures.statics(spark, sf_dir).select("mmsi", F.unix_millis(eta).alias("eta_ms"))


@_query(f"""{_P}, a AS (SELECT seq, source_id, (seq * 7) % 700 AS age FROM p)
SELECT seq, age >= 120 AS stale, round(CASE WHEN age <= 0 THEN 0.95 WHEN age < 60 THEN 0.95 + age * (0.92 - 0.95) / 60 WHEN age < 180 THEN 0.92 + (age - 60) * (0.7 - 0.92) / 120 WHEN age < 360 THEN 0.7 + (age - 180) * (0.45 - 0.7) / 180
  WHEN age < 540 THEN 0.45 + (age - 360) * (0.15 - 0.45) / 180 WHEN age < 600 THEN 0.15 + (age - 540) * (0 - 0.15) / 60 ELSE 0 END * CASE WHEN source_id = 3 THEN 1.0e0 ELSE 0.55e0 END, 9) AS weight FROM a""")
def freshness_weight(spark, sf_dir):
    age = (F.col("seq") * 7) % 700
    return fixtures.positions(spark, sf_dir).select("seq", ais.stale(age).alias("stale"), F.round(ais.freshness(age, F.col("source_id")), 9).alias("weight"))


@_query(f"""{_P}, l AS (SELECT * FROM (SELECT mmsi, lng, lat, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p) WHERE rn = 1 AND lng IS NOT NULL AND lat <= 90),
d AS (SELECT a.mmsi AS a, b.mmsi AS b, 2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) AS metres FROM l a JOIN l b ON a.mmsi < b.mmsi)
SELECT a, b, round(metres, 1) AS metres FROM d WHERE metres <= 1000""")
def nearby_pairs(spark, sf_dir):
    rows = tracks.latest(fixtures.positions(spark, sf_dir)).where("lat <= 90")
    return geo.nearby_pairs(rows, 1000.0).select("a", "b", F.round("metres", 1).alias("metres"))


@_query(f"""{_P} SELECT seq, mmsi, source_id, coalesce(
  CASE WHEN max(CASE WHEN source_id = 3 THEN 1 END) OVER w = 1 THEN 3 END, CASE WHEN max(CASE WHEN source_id = 2 THEN 1 END) OVER w = 1 THEN 2 END,
  CASE WHEN max(CASE WHEN source_id = 0 THEN 1 END) OVER w = 1 THEN 0 END, 1) AS active
FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY t_s RANGE BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def active_source(spark, sf_dir):
    return tracks.active_source(fixtures.positions(spark, sf_dir), alive_s=20).select("seq", "mmsi", "source_id", "active")


@_query(f"""WITH RECURSIVE p AS MATERIALIZED ({POSITIONS}), {_bucket_sql('p', 20, 10)}
SELECT p.seq, p.mmsi, coalesce(p.t_s > from_t OR (p.t_s = from_t AND p.seq >= from_seq), FALSE) AS admitted FROM p LEFT JOIN since ON since.mmsi = p.mmsi""")
def new_vessels_bucket(spark, sf_dir):
    """The same quotas as one bucket, at which rejected vessels try again."""
    return quality.admitted_by_bucket(fixtures.positions(spark, sf_dir), burst=20, per_minute=10).select("seq", "mmsi", "admitted")


@_query(f"""{_P} SELECT seq, CASE WHEN coalesce(sog_t > 5, FALSE) THEN 1 ELSE 0 END + CASE WHEN lng IS NOT NULL AND lat IS NOT NULL THEN 2 ELSE 0 END
  + CASE WHEN floor(mmsi / 1000000) BETWEEN 200 AND 799 THEN 4 ELSE 0 END AS flags FROM p""")
def update_flags(spark, sf_dir):
    return reads.updates(fixtures.positions(spark, sf_dir)).select("seq", "flags")


@_query(f"""{_P} SELECT mmsi, CAST(floor(t_s / 30) AS BIGINT) AS slot, max(seq) AS seq FROM p GROUP BY 1, 2""")
def throttled(spark, sf_dir):
    return tracks.throttled(fixtures.positions(spark, sf_dir), 30_000).select("mmsi", "slot", "seq")


@_query(f"""{_P}, {_SESSION.replace('FROM p)', 'FROM p WHERE lng IS NOT NULL AND lat IS NOT NULL)')},
n AS (SELECT mmsi, seq, lng, lead(lng) OVER (PARTITION BY mmsi, session ORDER BY t_s, seq) AS lng2 FROM x),
e AS (SELECT mmsi, seq, ms, lng, lng2, ms / 1500.0e0 AS s FROM n, (VALUES (0), (500), (1000), (1500)) v(ms) WHERE lng2 IS NOT NULL)
SELECT mmsi, seq, ms, round(lng + (lng2 - lng) * CASE WHEN s < 0.5 THEN 4 * s * s * s ELSE 1 - pow(2 - 2 * s, 3) / 2 END, 6) AS lng FROM e""")
def resampled(spark, sf_dir):
    return tracks.resampled(fixtures.positions(spark, sf_dir)).select("mmsi", "seq", "ms", F.round("lng", 6).alias("lng"))


@_query(f"""{_PS}, c AS (SELECT mmsi, 1704067200 + seq * 60 AS t_s, seq, vessel_name, ship_type FROM s WHERE vessel_name <> ''),
m AS (SELECT p.seq, p.mmsi, c.vessel_name, c.ship_type FROM p LEFT JOIN c ON c.mmsi = p.mmsi AND c.t_s <= p.t_s) SELECT * FROM m""")
def static_as_of(spark, sf_dir):
    changes = fixtures.statics(spark, sf_dir).where("vessel_name <> ''").withColumn("t_s", F.lit(1704067200) + F.col("seq") * 60)
    return reads.with_static_as_of(fixtures.positions(spark, sf_dir), changes, ["vessel_name", "ship_type"]).select("seq", "mmsi", "vessel_name", "ship_type")


@_query(f"""WITH s AS ({STATICS}) SELECT mmsi, CASE WHEN call_sign = '' THEN '—' ELSE call_sign END AS call_sign, coalesce(CAST(imo AS VARCHAR), '—') AS imo,
  CASE WHEN draught_t = 0 THEN '—' ELSE printf('%.1f m', draught_t / 10.0e0) END AS draught,
  CASE WHEN to_bow + to_stern = 0 AND to_port + to_starboard = 0 THEN '—' ELSE (to_bow + to_stern) || ' × ' || (to_port + to_starboard) || ' m' END AS dimensions,
  coalesce(nullif(concat_ws(' ', CASE WHEN eta_month <> 0 AND eta_day <> 0 THEN lpad(CAST(eta_month AS VARCHAR), 2, '0') || '-' || lpad(CAST(eta_day AS VARCHAR), 2, '0') END,
    CASE WHEN eta_hour < 24 AND eta_minute < 60 THEN lpad(CAST(eta_hour AS VARCHAR), 2, '0') || ':' || lpad(CAST(eta_minute AS VARCHAR), 2, '0') END), ''), '—') AS eta FROM s""")
def display_texts(spark, sf_dir):
    length, width = F.col("to_bow") + F.col("to_stern"), F.col("to_port") + F.col("to_starboard")
    return fixtures.statics(spark, sf_dir).select(
        "mmsi", ais.or_dash(F.col("call_sign"), F.col("call_sign") == "").alias("call_sign"), ais.or_dash(F.col("imo").cast("string")).alias("imo"),
        ais.or_dash(F.format_string("%.1f m", F.col("draught_t") / 10), F.col("draught_t") == 0).alias("draught"),
        ais.or_dash(F.concat(length, F.lit(" × "), width, F.lit(" m")), (length == 0) & (width == 0)).alias("dimensions"),
        ais.eta_text(F.col("eta_month"), F.col("eta_day"), F.col("eta_hour"), F.col("eta_minute")).alias("eta"),
    )


@_query(f"""{_PS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p) WHERE rn = 1 AND lng IS NOT NULL AND lat IS NOT NULL)
SELECT l.mmsi, trim(coalesce(vessel_name, '')) AS name, CASE WHEN ship_type IS NULL THEN 'other' ELSE {_CATEGORY_SQL} END AS category,
  CAST(coalesce(heading, floor(cog_t / 10)) AS INTEGER) AS heading FROM l LEFT JOIN s ON s.mmsi = l.mmsi""")
def vessel_features(spark, sf_dir):
    """The GeoJSON features, read back."""
    rows = reads.vessel_features(tracks.latest(fixtures.positions(spark, sf_dir)), fixtures.statics(spark, sf_dir), AS_OF)
    p = F.from_json("feature", "properties struct<name: string, category: string, heading: int>")["properties"]
    return rows.select("mmsi", p["name"].alias("name"), p["category"].alias("category"), p["heading"].alias("heading"))


def _landed_frames(sentences: DataFrame) -> DataFrame:
    """Sentences as they land, and landed again with their envelope: filters on it then don't check each sentence anew."""
    return landed(frames.enveloped(landed(sentences)))


def _sized(n: str) -> str:
    return f"CAST({n} AS BIGINT)"


@_query(f"""{_P} SELECT seq, mmsi, msg_type, {_sized('round(lng_u * 0.6e0)')} AS lng_600k, {_sized('round(lat_u * 0.6e0)')} AS lat_600k, sog_t, cog_t, heading, CASE WHEN msg_type = 18 THEN NULL ELSE nav_status END AS nav_status
FROM p WHERE seq % 41 <> 0 AND seq % 43 <> 0""")
def nmea_roundtrip(spark, sf_dir):
    """Positions encoded to sentences, some broken, and decoded again; the wire integers of those accepted."""
    out = frames.decoded(_landed_frames(frames.position_sentences(fixtures.positions(spark, sf_dir))))
    return out.where("reason IS NULL").select("seq", "mmsi", F.col("type").alias("msg_type"), "lng_600k", "lat_600k", "sog_t", "cog_t", "heading", "nav_status")


@_query(f"""{_P} SELECT CASE WHEN seq % 41 = 0 AND seq % 43 <> 0 THEN 'checksum-mismatch' WHEN seq % 43 = 0 AND seq % 41 = 0 THEN 'checksum-mismatch' ELSE 'envelope-fields' END AS reason, count(*) AS n
FROM p WHERE seq % 41 = 0 OR seq % 43 = 0 GROUP BY 1""")
def nmea_rejects(spark, sf_dir):
    out = frames.decoded(_landed_frames(frames.position_sentences(fixtures.positions(spark, sf_dir))))
    return out.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@_query(f"""WITH s AS ({STATICS}) SELECT mmsi, imo, rtrim(vessel_name) AS vessel_name, call_sign, ship_type, CASE WHEN to_bow + to_stern + to_port + to_starboard = 0 THEN NULL ELSE to_bow END AS to_bow,
  CASE WHEN draught_t = 0 THEN NULL ELSE draught_t END AS draught_t, destination FROM s""")
def nmea_static_roundtrip(spark, sf_dir):
    """Static data encoded to two-part sentences, put together again and decoded."""
    return frames.decoded_statics(_landed_frames(frames.static_sentences(fixtures.statics(spark, sf_dir)))).select("mmsi", "imo", "vessel_name", "call_sign", "ship_type", "to_bow", "draught_t", "destination")


@_query(f"""{_P} SELECT seq, CASE WHEN msg_type <> 18 AND seq % 256 <> 0 THEN seq % 256 - 128 END AS rot, seq % 2 = 1 AS accurate, t_s % 60 AS second, CASE WHEN msg_type <> 18 THEN seq % 3 END AS maneuver,
  CASE WHEN msg_type = 18 THEN seq % 2 = 1 ELSE seq % 5 % 2 = 1 END AS raim, CASE WHEN msg_type = 18 THEN seq % 1000000 ELSE seq % 500000 END AS radio, CASE WHEN msg_type = 18 THEN (seq % 128) & 64 > 0 END AS cs_unit, CASE WHEN msg_type = 18 THEN (seq % 128) & 2 > 0 END AS assigned
FROM p WHERE seq % 41 <> 0 AND seq % 43 <> 0""")
def nmea_position_fields(spark, sf_dir):
    """The further fields of position reports of both classes."""
    out = frames.decoded(_landed_frames(frames.position_sentences(fixtures.positions(spark, sf_dir))))
    return out.where("reason IS NULL").select("seq", "rot", "accurate", "second", "maneuver", "raim", "radio", "cs_unit", "assigned")


@_query(f"""WITH s AS ({STATICS}) SELECT mmsi, seq % 16 AS fix_type, seq % 2 = 0 AS dte, 0 AS version, CASE WHEN eta_month BETWEEN 1 AND 12 THEN eta_month END AS eta_month, CASE WHEN eta_day BETWEEN 1 AND 31 THEN eta_day END AS eta_day,
  CASE WHEN eta_hour < 24 THEN eta_hour END AS eta_hour, CASE WHEN eta_minute < 60 THEN eta_minute END AS eta_minute FROM s""")
def nmea_static_fields(spark, sf_dir):
    return frames.decoded_statics(_landed_frames(frames.static_sentences(fixtures.statics(spark, sf_dir)))).select("mmsi", "fix_type", "dte", "version", *(f"eta_{x}" for x in ("month", "day", "hour", "minute")))


@_query(f"""WITH s AS ({STATICS}) SELECT mmsi, 0 AS part, rtrim(vessel_name) AS vessel_name, NULL AS call_sign, NULL AS vendor, CAST(NULL AS BIGINT) AS ship_type, CAST(NULL AS BIGINT) AS to_bow, CAST(NULL AS BIGINT) AS to_starboard FROM s
UNION ALL SELECT mmsi, 1, NULL, call_sign, concat('V', seq % 1000), ship_type, CASE WHEN to_bow + to_stern + to_port + to_starboard > 0 THEN to_bow END, CASE WHEN to_bow + to_stern + to_port + to_starboard > 0 THEN to_starboard END FROM s""")
def nmea_static_b_roundtrip(spark, sf_dir):
    """Both halves of class B's static data, encoded and decoded again."""
    out = frames.decoded_statics_b(_landed_frames(frames.static_b_sentences(fixtures.statics(spark, sf_dir))))
    return out.select("mmsi", "part", "vessel_name", "call_sign", "vendor", "ship_type", "to_bow", "to_starboard")


@_query(f"""{_P} SELECT seq, mmsi, CASE WHEN seq % 7 = 0 THEN 'parse-error' WHEN seq % 5 = 0 THEN 'unsupported-type' ELSE 'accepted' END AS outcome,
  CASE WHEN seq % 7 <> 0 AND seq % 5 <> 0 THEN sog_t END AS sog_t FROM p""")
def json_adapter(spark, sf_dir):
    out = frames.adapted_json(landed(frames.json_messages(fixtures.positions(spark, sf_dir))))
    return out.select("seq", F.coalesce("mmsi", "seq_mmsi").alias("mmsi"), "outcome", "sog_t")


# Feeds


@_query(f"""{_P} SELECT source_id, CASE source_id WHEN 0 THEN 'LocalUdp' WHEN 1 THEN 'WebSdr' WHEN 2 THEN 'AisStream' ELSE 'EdgeBridge' END AS source,
  CASE source_id WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 0 THEN 3 ELSE 4 END AS trust, count(*) AS n, count(CASE WHEN source_id <> 2 THEN heading END) AS headings FROM p GROUP BY 1, 2, 3""")
def source_union(spark, sf_dir):
    """The frames of four sources, one of which has no headings, as one table with their provenance."""
    p = fixtures.positions(spark, sf_dir)
    parts = {k: p.where(F.col("source_id") == k).drop("source_id", *(["heading"] if k == 2 else [])) for k in range(4)}
    return feeds.merged(parts).groupBy("source_id", "source", "trust").agg(F.count("*").alias("n"), F.count("heading").alias("headings"))


@_query(f"""{_P}, r AS (SELECT seq, CASE seq % 4 WHEN 0 THEN concat('!AIVDM,', seq) WHEN 1 THEN concat(' {{', seq, '}}') WHEN 2 THEN concat('$GPGGA,', seq) ELSE concat('x', seq) END AS raw, seq % 4 AS k FROM p)
SELECT CASE k WHEN 0 THEN 'nmea' WHEN 1 THEN 'json' WHEN 2 THEN 'nmea' ELSE 'parse-error' END AS format, count(*) AS n FROM r GROUP BY 1""")
def frame_formats(spark, sf_dir):
    k, seq = F.col("seq") % 4, F.col("seq").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("!AIVDM,"), seq)).when(k == 1, F.concat(F.lit(" {"), seq, F.lit("}"))).when(k == 2, F.concat(F.lit("$GPGGA,"), seq)).otherwise(F.concat(F.lit("x"), seq))
    return fixtures.positions(spark, sf_dir).select(feeds.frame_format(raw).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


@_query(f"""{_P} SELECT source_id, count(*) FILTER (WHERE 70 + seq % 20 > 82) AS too_long, count(*) FILTER (WHERE 70 + seq % 20 <= 82 AND seq % 9 = 0) AS over_rate,
  count(*) FILTER (WHERE 70 + seq % 20 <= 82 AND seq % 9 <> 0) AS emitted FROM p GROUP BY source_id""")
def drop_counts(spark, sf_dir):
    lines = fixtures.positions(spark, sf_dir).select("source_id", "seq", F.expr("repeat('a', CAST(70 + seq % 20 AS INT))").alias("value"))
    return feeds.drop_counts(lines, in_rate=F.col("seq") % 9 != 0)


@_query(f"""{_PS} SELECT concat('p', seq) AS key, mmsi, CASE WHEN msg_type = 18 THEN 18 ELSE 1 END AS message_type, round(lng, 6) AS lng, round(lat, 6) AS lat, sog_t, cog_t, CASE WHEN heading = 511 THEN NULL ELSE heading END AS heading,
  CASE WHEN msg_type <> 18 THEN nav_status END AS nav_status, CASE WHEN msg_type <> 18 AND seq % 256 <> 0 THEN seq % 256 - 128 END AS rot, msg_type <> 18 AND seq % 2 = 0 AS accurate, CASE WHEN msg_type <> 18 THEN seq % 64 END AS second
FROM p""")
def json_positions(spark, sf_dir):
    """Position reports of both classes through the JSON adapter, every field."""
    out = feeds.adapted(landed(feeds.json_feed(fixtures.positions(spark, sf_dir), fixtures.statics(spark, sf_dir)))).where("position IS NOT NULL")
    return out.select("key", "mmsi", "message_type", F.round("position.lng", 6).alias("lng"), F.round("position.lat", 6).alias("lat"), *(f"position.{c}" for c in ("sog_t", "cog_t", "heading", "nav_status", "rot", "accurate", "second")))


@_query(f"""WITH s AS ({STATICS}) SELECT concat('s', seq) AS key, mmsi, CASE WHEN seq % 2 = 0 THEN 24 ELSE 5 END AS message_type, CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 4 = 2 THEN 1 ELSE 0 END END AS part,
  trim(vessel_name) AS vessel_name, call_sign, CASE WHEN seq % 2 = 1 THEN imo END AS imo, ship_type, to_bow, to_stern, to_port, to_starboard, CASE WHEN seq % 2 = 1 THEN draught_t END AS draught_t,
  CASE WHEN seq % 2 = 1 THEN trim(destination) END AS destination, CASE WHEN seq % 2 = 1 THEN eta_month END AS eta_month, CASE WHEN seq % 2 = 1 THEN eta_minute END AS eta_minute FROM s""")
def json_statics(spark, sf_dir):
    """Static data of both classes through the JSON adapter."""
    out = feeds.adapted(landed(feeds.json_feed(fixtures.positions(spark, sf_dir), fixtures.statics(spark, sf_dir)))).where("static IS NOT NULL")
    fields = ("part", "vessel_name", "call_sign", "imo", "ship_type", "to_bow", "to_stern", "to_port", "to_starboard", "draught_t", "destination", "eta_month", "eta_minute")
    return out.select("key", "mmsi", "message_type", *(f"static.{c}" for c in fields))


@_query(f"""WITH s AS ({STATICS}), c AS (SELECT mmsi, ship_type * 3 AS ship_type, imo, CASE WHEN imo IS NOT NULL AND NOT coalesce(imo BETWEEN 1000000 AND 9999999 AND (floor(imo / 1000000) * 7 + floor(imo / 100000) % 10 * 6 + floor(imo / 10000) % 10 * 5
  + floor(imo / 1000) % 10 * 4 + floor(imo / 100) % 10 * 3 + floor(imo / 10) % 10 * 2) % 10 = imo % 10, false) THEN 'invalid-imo' WHEN ship_type * 3 > 255 THEN 'invalid-ship-type' ELSE 'accepted' END AS outcome FROM s)
SELECT outcome, count(*) AS n FROM c GROUP BY 1""")
def static_gate(spark, sf_dir):
    s = fixtures.statics(spark, sf_dir)
    return s.select(F.coalesce(feeds.static_reason(F.col("mmsi"), F.col("imo"), F.col("ship_type") * 3), F.lit("accepted")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@_query(f"""WITH RECURSIVE p AS ({POSITIONS}), g AS MATERIALIZED (SELECT seq, mmsi, t_s, {_FIRST_REASON} AS reason FROM p), ok AS MATERIALIZED (SELECT * FROM g WHERE reason IS NULL), {_bucket_sql('ok', 20, 10)},
adm AS MATERIALIZED (SELECT ok.* FROM ok JOIN since ON since.mmsi = ok.mmsi AND (ok.t_s > from_t OR (ok.t_s = from_t AND ok.seq >= from_seq))), {_rate_sql('adm')}
SELECT coalesce(reason, 'accepted') AS outcome, coalesce({_COARSE_REASON}, 'accepted') AS gate, count(*) AS n
FROM (SELECT CASE WHEN g.reason IS NOT NULL THEN g.reason WHEN rate.seq IS NULL THEN 'new-vessel-limited' WHEN NOT accepted THEN 'rate-limited' END AS reason FROM g LEFT JOIN rate ON rate.mmsi = g.mmsi AND rate.seq = g.seq) GROUP BY 1, 2""")
def gate_chain(spark, sf_dir):
    """Outcomes of the ordered gates, new vessels and the rate of each vessel included, and the kinds they are counted as."""
    rows = feeds.gate_chain(fixtures.positions(spark, sf_dir), burst=20, per_minute=10)
    gate = F.coalesce(ais.coarse_reason(F.col("reason")), F.lit("accepted"))
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"), gate.alias("gate")).agg(F.count("*").alias("n"))


@_query(f"""{_P}, g AS (SELECT *, {_FIRST_REASON} AS reason FROM p) SELECT msg_type, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM g
WHERE reason IS NULL AND lng IS NOT NULL AND lat IS NOT NULL AND msg_type IN (1, 2, 3, 18) GROUP BY msg_type""")
def storable(spark, sf_dir):
    return feeds.storable(quality.gated(fixtures.positions(spark, sf_dir))).groupBy("msg_type").agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"))


@_query(f"""{_P}, g AS (SELECT seq, t_s, source_id, {_FIRST_REASON} AS reason FROM p), a AS (SELECT DISTINCT source_id, t_s FROM g WHERE reason IS NULL),
l AS (SELECT t_s, max(t_s) FILTER (WHERE source_id = 3) OVER w AS l3, max(t_s) FILTER (WHERE source_id = 2) OVER w AS l2, max(t_s) FILTER (WHERE source_id = 0) OVER w AS l0, max(t_s) FILTER (WHERE source_id = 1) OVER w AS l1
  FROM (SELECT * FROM a UNION ALL SELECT NULL, t_s FROM g GROUP BY t_s) WINDOW w AS (ORDER BY t_s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT DISTINCT t_s, CASE WHEN t_s - l3 <= 900 THEN 3 WHEN t_s - l2 <= 900 THEN 2 WHEN t_s - l0 <= 900 THEN 0 WHEN t_s - l1 <= 900 THEN 1 END AS active FROM l)
SELECT g.seq, b.active FROM g JOIN b USING (t_s)""")
def trusted_source(spark, sf_dir):
    """For each frame the source that is trusted at its moment, by every source's own accepted frames."""
    return feeds.trusted(quality.gated(fixtures.positions(spark, sf_dir))).select("seq", "active")


@_query(f"""{_P} SELECT mmsi, round(lng, 6) AS lng, round(lat, 6) AS lat, t_s AS fix_s, {AS_OF} AS t_s, 3 AS source_id FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS rn FROM p WHERE t_s <= {AS_OF}) WHERE rn = 1
  AND mmsi IN (SELECT mmsi FROM p WHERE t_s <= {AS_OF} GROUP BY mmsi HAVING max(t_s) >= {AS_OF} - 86400 ORDER BY max(t_s) DESC, mmsi LIMIT 500)""")
def live_from_history(spark, sf_dir):
    shots = reads.snapshot(fixtures.statics(spark, sf_dir), fixtures.positions(spark, sf_dir), AS_OF, fresh_s=86400)
    return reads.live_from_history(shots, AS_OF).select("mmsi", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "fix_s", "t_s", "source_id")


@_query(f"""{_P}, {_EVENTS}, n AS (SELECT mmsi, zone_id, arg_max(kind, at_s * 2 + CASE WHEN kind = 'enter' THEN 1 ELSE 0 END) AS kind FROM e GROUP BY ALL)
SELECT mmsi, n.zone_id, label, v.kind FROM n JOIN (VALUES {", ".join(f"('{z[0]}', '{z[1]}', '{z[2]}')" for z in ZONES)}) v(zone_id, label, kind) ON v.zone_id = n.zone_id WHERE n.kind = 'enter' """)
def zone_badges(spark, sf_dir):
    return geo.badges(geo.presence(_events(spark, sf_dir)), fixtures.zones(spark))


@_query(f"{_P}, h AS ({_HITS}) SELECT mmsi, max(t_s) AS last_seen_s FROM p JOIN (SELECT DISTINCT mmsi, seq FROM h) USING (mmsi, seq) GROUP BY mmsi")
def last_seen_in_zones(spark, sf_dir):
    return geo.last_seen_in_zones(fixtures.positions(spark, sf_dir), fixtures.zones(spark))


#: Frames on a clock six times as fast, with stretches in which a source, or every source, is silent.
_OUTAGES = "SELECT seq, 1704067200 + (t_s - 1704067200) * 6 AS t_s, source_id, reason FROM g WHERE (CAST(floor((t_s - 1704067200) * 6 / 2400) AS BIGINT) + source_id) % 3 <> 0 AND CAST(floor((t_s - 1704067200) * 6 / 5000) AS BIGINT) % 4 <> 3"
_FREE = lambda warm: f"CASE WHEN {warm} % 2 = 0 THEN 0 WHEN {warm} // 2 % 2 = 0 THEN 1 WHEN {warm} // 4 % 2 = 0 THEN 2 WHEN {warm} // 8 % 2 = 0 THEN 3 END"


@_query(f"""WITH RECURSIVE p AS ({POSITIONS}), g AS (SELECT seq, t_s, source_id, {_FIRST_REASON} AS reason FROM p), f AS MATERIALIZED ({_OUTAGES}),
a AS (SELECT t_s, CASE source_id WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS rank, min(seq) AS seq FROM f WHERE reason IS NULL GROUP BY ALL),
q AS (SELECT DISTINCT t_s, -1 AS rank, CAST(9000000000000000000 AS BIGINT) AS seq FROM f WHERE t_s >= (SELECT min(t_s) FROM a)),
ev AS MATERIALIZED (SELECT t_s, rank, row_number() OVER (ORDER BY t_s, seq) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM q)),
st AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT min(t_s) FROM a) AS t_s, 0 AS mode, 0 AS cur, 0 AS warm, (SELECT min(t_s) FROM a) AS since
  UNION ALL SELECT CASE WHEN due <= et THEN k ELSE k + 1 END, CASE WHEN due <= et THEN t_s ELSE et END,
    CASE WHEN due <= et THEN CASE WHEN mode = 0 THEN 1 WHEN mode = 1 THEN CASE WHEN nxt IS NULL THEN 2 ELSE 0 END ELSE 0 END WHEN own OR back THEN 0 ELSE mode END,
    CASE WHEN due <= et THEN CASE WHEN mode = 0 THEN cur WHEN mode = 1 THEN coalesce(nxt, cur) ELSE 0 END WHEN back THEN rank ELSE cur END,
    CASE WHEN due <= et THEN CASE WHEN mode = 0 THEN warm WHEN mode = 1 THEN warm2 ELSE 0 END WHEN back THEN warm - bit + CASE WHEN warm // curbit % 2 = 0 THEN curbit ELSE 0 END ELSE warm END,
    CASE WHEN due <= et THEN due WHEN own OR back THEN et ELSE since END
  FROM (SELECT *, {_FREE('warm2')} AS nxt, coalesce(rank = cur AND mode <> 2, FALSE) AS own, coalesce(rank >= 0 AND rank < cur AND warm // bit % 2 = 1, FALSE) AS back FROM (
    SELECT st.*, ev.t_s AS et, ev.rank, since + CASE mode WHEN 0 THEN 300 WHEN 1 THEN 600 ELSE 60 END AS due, CAST(1 << cur AS INTEGER) AS curbit, CAST(1 << greatest(ev.rank, 0) AS INTEGER) AS bit,
      warm + CASE WHEN warm // CAST(1 << cur AS INTEGER) % 2 = 0 THEN CAST(1 << cur AS INTEGER) ELSE 0 END AS warm2 FROM st JOIN ev ON ev.k = st.k + 1) x) y),
l AS (SELECT t_s, mode, cur FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY since DESC) AS r1 FROM st WHERE k > 0) WHERE r1 > 0 AND k IN (SELECT max(k) FROM ev GROUP BY t_s) QUALIFY row_number() OVER (PARTITION BY k ORDER BY since) = 1),
o AS (SELECT t_s, CASE mode WHEN 0 THEN 'active' WHEN 1 THEN 'degraded' ELSE 'exhausted' END AS mode, CASE WHEN mode <> 2 THEN CASE cur WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END END AS active FROM l)
SELECT f.seq, o.mode, CAST(o.active AS BIGINT) AS active, coalesce(o.active = f.source_id, FALSE) AS trusted FROM f LEFT JOIN o USING (t_s)""")
def source_failover(spark, sf_dir):
    """For each frame the state of the failover automaton, and whether its source is the one that is trusted then."""
    quality.gated(fixtures.positions(spark, sf_dir)).createOrReplaceTempView("seamark_gated")
    frames_ = spark.sql(_OUTAGES.replace("FROM g ", "FROM seamark_gated "))
    return failover.trusted(frames_).select("seq", "mode", "active", "trusted")


@_query(f"""WITH RECURSIVE p AS ({POSITIONS}), slow AS (SELECT source_id * 8 + CAST(mmsi % 8 AS BIGINT) AS mmsi, seq, CAST(floor(t_s / 15) AS BIGINT) AS t_s FROM p), {_rate_sql('slow')}
SELECT seq, mmsi // 8 AS source_id, mmsi % 8 AS connection, accepted FROM rate""")
def source_rate_limited(spark, sf_dir):
    """A bucket for each connection of each source, on a slow clock so that it runs dry."""
    rows = fixtures.positions(spark, sf_dir).withColumns({"t_s": F.floor(F.col("t_s") / 15), "connection": F.col("mmsi") % 8})
    return tracks.rate_limit(rows, ["source_id", "connection"], size=5, per_s=1).select("seq", "source_id", "connection", "accepted")


@_query(ORACLE_SQL["rate_limited"])
def rate_limited_sliced(spark, sf_dir):
    """The buckets of rate_limited, each vessel's history in slices of ten seconds of the slow clock."""
    slow = fixtures.positions(spark, sf_dir).withColumn("t_s", F.floor(F.col("t_s") / 15))
    return tracks.rate_limit(slow, slice_s=10).select("mmsi", "seq", "accepted")


@_query(ORACLE_SQL["trail_outliers"])
def trail_outliers_sliced(spark, sf_dir):
    """trail_outliers with each vessel's history in slices of five minutes."""
    return tracks.trail_outliers(fixtures.positions(spark, sf_dir), slice_s=300).select("mmsi", "session", "seq", "accepted")


@_query(ORACLE_SQL["kalman_track"])
def kalman_track_sliced(spark, sf_dir):
    """kalman_track with each vessel's history in slices of five minutes; digits that rounding can't reach."""
    rows = tracks.kalman(fixtures.positions(spark, sf_dir).where("lat <= 90"), slice_s=300)
    return rows.select("mmsi", "seq", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"), F.round(F.col("vlng") * 1e6, 4).alias("vlng_u"), F.round(F.col("vlat") * 1e6, 4).alias("vlat_u"))
