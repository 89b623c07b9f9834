"""Ship data derived from the general test tables, by integer arithmetic.

The texts below are plain SQL that means the same to Spark and to other engines, so that a check can derive
the same rows. A table name stands for the table or view of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row per event: arrival order, vessel, synthetic clock, and a random walk in micro-degrees with faults.
POSITIONS = """
SELECT seq, mmsi, t_s, source_id, msg_type, nav_status, sog_t, cog_t, heading, lng_u, lat_u,
  CASE WHEN seq % 89 = 0 THEN NULL ELSE lng_u / 1e6 END AS lng,
  CASE WHEN seq % 89 = 0 THEN NULL WHEN seq % 97 = 0 THEN 90.5e0 WHEN seq % 83 = 0 THEN (lat_u + 50000) / 1e6 ELSE lat_u / 1e6 END AS lat
FROM (
  SELECT event_id AS seq,
    CASE user_id % 50 WHEN 0 THEN 199000000 + user_id WHEN 1 THEN 776000000 + user_id ELSE 261000000 + user_id END AS mmsi,
    CAST(1704067200 + sum(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 700 ELSE 5 + event_id % 11 END)
      OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS t_s,
    CAST(14500000 + (user_id * 104729) % 300000 + sum((event_id * 7919) % 4001 - 2000)
      OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS lng_u,
    CAST(53350000 + (user_id * 15485863) % 200000 + sum((event_id * 6101) % 2001 - 1000)
      OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS lat_u,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id * 31) % 12 END AS sog_t,
    (event_id * 37) % 3600 AS cog_t,
    CASE WHEN (event_id * 53) % 512 = 511 THEN NULL ELSE (event_id * 53) % 512 END AS heading,
    event_id % 16 AS nav_status,
    CASE WHEN event_id % 4 = 3 THEN 18 ELSE 1 + event_id % 3 END AS msg_type,
    event_id % 4 AS source_id
  FROM events) walk
"""

#: One row per customer: name, identity, type, size and voyage of a vessel, with missing and bad values.
STATICS = """
SELECT c_custkey AS seq, 261000000 + c_custkey AS mmsi,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE substring(upper(c_name), 1, 20) END AS vessel_name,
  concat('X', c_custkey) AS call_sign,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE d6 * 10 + (
    (CAST(floor(d6 / 100000) AS BIGINT) % 10) * 7 + (CAST(floor(d6 / 10000) AS BIGINT) % 10) * 6
    + (CAST(floor(d6 / 1000) AS BIGINT) % 10) * 5 + (CAST(floor(d6 / 100) AS BIGINT) % 10) * 4
    + (CAST(floor(d6 / 10) AS BIGINT) % 10) * 3 + (d6 % 10) * 2 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 10 END AS imo,
  c_custkey % 100 AS ship_type,
  CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE (c_custkey * 3) % 200 END AS to_bow,
  CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 50 END AS to_stern,
  CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 20 END AS to_port,
  CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE (c_custkey * 7) % 20 END AS to_starboard,
  c_custkey % 120 AS draught_t, c_mktsegment AS destination,
  c_custkey % 13 AS eta_month, c_custkey % 32 AS eta_day, c_custkey % 25 AS eta_hour, c_custkey % 61 AS eta_minute
FROM (SELECT c_custkey, c_name, c_mktsegment, 100000 + c_custkey AS d6 FROM customer) base
"""

#: Two static messages per vessel: a full one, then one with some fields, blanks and a part of an arrival time.
MESSAGES = f"""
SELECT seq * 2 AS seq, mmsi, 1704067200 + seq * 60 AS t_s, seq % 4 AS source_id, vessel_name, call_sign, imo, ship_type, to_bow, to_stern, to_port, to_starboard, draught_t, destination, eta_month, eta_day, eta_hour, eta_minute
FROM ({STATICS}) full_one
UNION ALL SELECT seq * 2 + 1, mmsi, 1704067200 + seq * 60 + 7 * (seq % 3), (seq + 1) % 4, CASE WHEN seq % 3 = 0 THEN concat('NEW ', seq) ELSE ' ' END, '', CASE WHEN seq % 2 = 0 THEN imo END,
  CASE WHEN seq % 5 = 0 THEN 0 WHEN seq % 5 < 3 THEN (seq + 1) % 100 END, CASE WHEN seq % 4 = 0 THEN to_bow + 1 END, CASE WHEN seq % 8 = 0 THEN to_stern END, CASE WHEN seq % 8 = 1 THEN to_port END, CASE WHEN seq % 8 = 9 THEN to_starboard END,
  CASE WHEN seq % 7 = 0 THEN draught_t END, CASE WHEN seq % 3 = 1 THEN '' ELSE destination END, CASE WHEN seq % 6 = 0 THEN eta_month END, CASE WHEN seq % 6 = 1 THEN eta_day END, CASE WHEN seq % 6 = 9 THEN eta_hour END, CASE WHEN seq % 12 = 0 THEN eta_minute END
FROM ({STATICS}) part_of
"""

#: Rings of synthetic zones; corners lie between micro-degrees, so that no fixture point is on an edge.
ZONES = (
    ("A", "Basin A", "port", True, False, [[(14.5000005, 53.3500005), (14.6500005, 53.3500005), (14.6500005, 53.4500005), (14.5000005, 53.4500005)]]),
    ("B", "Basin B", "anchorage", True, False, [[(14.6000005, 53.4000005), (14.7500005, 53.4000005), (14.7500005, 53.5200005), (14.6000005, 53.5200005)], [(14.6600005, 53.4400005), (14.6800005, 53.4400005), (14.6800005, 53.4600005), (14.6600005, 53.4600005)]]),
    ("C", "Channel C", "general", True, False, [[(14.5500005, 53.3800005), (14.6000005, 53.3800005), (14.6000005, 53.4000005), (14.5700005, 53.4000005), (14.5700005, 53.4200005), (14.5500005, 53.4200005)]]),
    ("D", "Backdrop D", "general", None, True, [[(14.4000005, 53.3000005), (14.9000005, 53.3000005), (14.9000005, 53.6000005), (14.4000005, 53.6000005)]]),
    ("E", "Hidden E", "general", False, False, [[(14.7000005, 53.4200005), (14.8000005, 53.4200005), (14.8000005, 53.5000005), (14.7000005, 53.5000005)]]),
)

#: End of the synthetic clock's first day: the moment at which ages are taken.
AS_OF = 1704067200 + 86400


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    name = f"seamark_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {name}"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", POSITIONS)


def statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", STATICS)


def static_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", MESSAGES)


def zones(spark: SparkSession) -> DataFrame:
    rows = [(i, label, kind, visible, decorative, [[[x, y] for x, y in ring] for ring in rings]) for i, label, kind, visible, decorative, rings in ZONES]
    return spark.createDataFrame(rows, "id string, label string, kind string, visible boolean, decorative boolean, rings array<array<array<double>>>")
