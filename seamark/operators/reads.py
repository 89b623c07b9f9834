"""Read models: vessel list, snapshot, archive, events feed, status groups, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators import tracks

FRESH_S, HISTORY, SNAPSHOT, RING, SUPPRESS_S = 600, 30, 500, 100, 90
STATUSES = ("underway", "anchored", "stopped", "nuc")


def list_vessels(statics: DataFrame, positions: DataFrame, limit: int = 100) -> DataFrame:
    """Vessels with their latest fix, the last seen first; those never seen come last."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    newest = tracks.latest(positions).select("mmsi", F.col("t_s").alias("last_seen_s"), "lng", "lat", "sog_t")
    return statics.join(newest, "mmsi", "left").orderBy(F.col("last_seen_s").desc_nulls_last(), "mmsi").limit(limit)


def summary(rows: DataFrame) -> DataFrame:
    """Nested form of a listed vessel: position only with both coordinates, dimensions only with all four."""
    have = lambda *c: F.lit(True) if not c else F.expr(" AND ".join(f"{x} IS NOT NULL" for x in c))
    dims = ("to_bow", "to_stern", "to_port", "to_starboard")
    return rows.select("mmsi", "vessel_name", F.when(have("lng", "lat"), F.struct("lng", "lat")).alias("position"), F.when(have(*dims), F.struct(*dims)).alias("dimensions"), F.col("last_seen_s").alias("updated_s"))


def snapshot(statics: DataFrame, positions: DataFrame, as_of_s: int, fresh_s: int = FRESH_S, history: int = HISTORY, limit: int = SNAPSHOT) -> DataFrame:
    """Vessels seen in the last fresh_s seconds with their newest fixes in order."""
    seen = positions.where(F.col("t_s") <= as_of_s)
    top = seen.groupBy("mmsi").agg(F.max("t_s").alias("last_seen_s")).where(F.col("last_seen_s") >= as_of_s - fresh_s).orderBy(F.col("last_seen_s").desc(), "mmsi").limit(limit)
    points = tracks.latest(seen.join(F.broadcast(top), "mmsi"), history)
    array = points.groupBy("mmsi", "last_seen_s").agg(F.sort_array(F.collect_list(F.struct("t_s", "seq", "lng", "lat"))).alias("history"))
    return array.join(statics.select("mmsi", "vessel_name", "ship_type"), "mmsi", "left")


def vessel(statics: DataFrame, positions: DataFrame, mmsi: int) -> DataFrame:
    """One vessel with its latest fix, or no row; both tables are read by the id."""
    return list_vessels(statics.where(F.col("mmsi") == mmsi), positions.where(F.col("mmsi") == mmsi), 1)


def live_from_history(snapshots: DataFrame, served_s: int, source_id: int = 3) -> DataFrame:
    """A live vessel from the last point of each history, stamped with the server's time and a default source."""
    last = F.element_at("history", -1)
    return snapshots.where(F.size("history") > 0).select("mmsi", last["lng"].alias("lng"), last["lat"].alias("lat"), last["t_s"].alias("fix_s"), F.lit(served_s).cast("long").alias("t_s"), F.lit(source_id).alias("source_id"))


def archive(live: DataFrame, positions: DataFrame, as_of_s: int, stale_s: int = FRESH_S) -> DataFrame:
    """Last known fixes for when nothing is live: those within stale_s of the newest one, if that is older than stale_s."""
    fixes = tracks.latest(positions.where("lng IS NOT NULL AND lat IS NOT NULL")).select("mmsi", "t_s", "lng", "lat")
    anchor = fixes.agg(F.max("t_s").alias("anchor_s")).join(live.agg(F.count("*").alias("n_live")))
    kept = fixes.join(F.broadcast(anchor)).where((F.col("n_live") == 0) & (as_of_s - F.col("anchor_s") > stale_s) & (F.col("anchor_s") - F.col("t_s") <= stale_s))
    return kept.drop("n_live")


def orphans(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows whose vessel is gone."""
    return rows.join(live.select("mmsi").distinct(), "mmsi", "left_anti")


def kept_of(rows: DataFrame, live: DataFrame) -> DataFrame:
    return rows.join(live.select("mmsi").distinct(), "mmsi", "left_semi")


def with_static_as_of(positions: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Each position with the static fields known at its moment: both streams in one order, last values carried on.

    changes: (mmsi, t_s, seq, *fields); at one moment a change comes before a position.
    """
    both = positions.withColumn("__p", F.lit(1)).unionByName(changes.select("mmsi", "t_s", "seq", *fields).withColumn("__p", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("mmsi").orderBy("t_s", "__p", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields}).where("__p = 1").drop("__p")


def alerts(events: DataFrame, session_start_s: Column, suppress_s: int = SUPPRESS_S) -> DataFrame:
    """events without the enters of the first suppress_s seconds."""
    return events.where((F.col("kind") != "enter") | (F.col("at_s") - session_start_s >= suppress_s))


def events_feed(events: DataFrame, statics: DataFrame, zones: DataFrame, limit: int = RING) -> DataFrame:
    """The newest events with names: of vessel and zone, or their ids."""
    named = events.join(statics.select("mmsi", "vessel_name"), "mmsi", "left").join(F.broadcast(zones.select(F.col("id").alias("zone_id"), "label")), "zone_id", "left")
    vessel = F.coalesce(F.nullif(F.trim("vessel_name"), F.lit("")), F.concat(F.lit("MMSI "), F.col("mmsi").cast("string")))
    event_id = F.concat_ws("|", "kind", F.col("mmsi").cast("string"), "zone_id", F.col("at_s").cast("string"))
    out = named.select("kind", "mmsi", "zone_id", "at_s", vessel.alias("vessel"), F.coalesce("label", "zone_id").alias("zone"), event_id.alias("event_id"))
    return out.orderBy(F.col("at_s").desc(), "event_id").limit(limit)


def alert_texts(events: DataFrame, statics: DataFrame, zones: DataFrame, latest: DataFrame) -> DataFrame:
    """events with ``event_id``, ``title`` and ``about``: speed, course and call sign of the vessel, null if none is known."""
    names = statics.select("mmsi", "vessel_name", "call_sign")
    rows = events.join(names, "mmsi", "left").join(latest.select("mmsi", "sog_t", "cog_t"), "mmsi", "left").join(zones.select(F.col("id").alias("zone_id"), "label"), "zone_id", "left")
    vessel = F.coalesce(F.nullif(F.trim("vessel_name"), F.lit("")), F.concat(F.lit("MMSI "), F.col("mmsi").cast("string")))
    zone = F.coalesce("label", "zone_id")
    # Halves go up, as they do on screens.
    whole = lambda c: F.floor(c + 0.5).cast("string")
    title = F.when(F.col("kind") == "enter", F.concat(vessel, F.lit(" entered "), zone)).when(F.col("kind") == "exit", F.concat(vessel, F.lit(" left "), zone))
    title = title.otherwise(F.concat(vessel, F.lit(" silent in "), zone, F.lit(" for "), whole(F.col("silent_s") / 60), F.lit(" min")))
    speed = F.when(F.col("sog_t").isNotNull(), ais.sog_text(F.col("sog_t") / 10))
    course = F.when(F.col("cog_t").isNotNull(), F.concat(whole(F.col("cog_t") / 10), F.lit("°")))
    about = F.nullif(F.concat_ws(" · ", speed, course, F.nullif(F.trim("call_sign"), F.lit(""))), F.lit(""))
    event_id = F.concat_ws("|", "kind", F.col("mmsi").cast("string"), "zone_id", F.col("at_s").cast("string"))
    return rows.select(*(events[c] for c in events.columns), event_id.alias("event_id"), title.alias("title"), about.alias("about"))


def with_status(positions: DataFrame) -> DataFrame:
    """The latest fix of each vessel with moving (after hysteresis) and status."""
    sog = F.col("sog_t") / 10
    rows = tracks.latest(tracks.hysteresis(positions, sog))
    return rows.withColumn("status", ais.vessel_status(F.col("nav_status"), F.col("moving"), sog))


def status_groups(vessels: DataFrame) -> DataFrame:
    """(status, position in the list, vessels) for every status, empty ones too."""
    spark = vessels.sparkSession
    order = spark.createDataFrame(list(enumerate(STATUSES)), "ord int, status string")
    return F.broadcast(order).join(vessels.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def sidebar(vessels: DataFrame, statics: DataFrame) -> DataFrame:
    """Vessels by status, then named ones first, by name whatever its case, then by id."""
    name = F.nullif(F.trim("vessel_name"), F.lit(""))
    rows = vessels.join(statics.select("mmsi", "vessel_name"), "mmsi", "left").withColumn("name", name)
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return rows.orderBy(rank, F.col("name").isNull(), F.lower("name"), "mmsi")


def updates(positions: DataFrame) -> DataFrame:
    """positions with the flags of an update: moving, has a fix, has a ship's id."""
    fix = F.col("lng").isNotNull() & F.col("lat").isNotNull() & ~F.col("msg_type").isin(5, 24)
    moving = F.coalesce(F.col("sog_t") > 5, F.lit(False))
    ship = F.floor(F.col("mmsi") / 1_000_000).between(200, 799)
    flag = lambda c, v: F.when(c, v).otherwise(0)
    return positions.withColumn("flags", flag(moving, ais.FLAG_MOVING).bitwiseOR(flag(fix, ais.FLAG_FIX)).bitwiseOR(flag(ship, ais.FLAG_IDENTITY)))


def live(latest: DataFrame, as_of_s: int, stale_s: int = FRESH_S) -> DataFrame:
    """The vessels that aren't stale: a fix of exactly stale_s is kept."""
    return latest.where(as_of_s - F.col("t_s") <= stale_s)


def last_points(points: Column, n: int) -> Column:
    """The last n of an array in its order."""
    return F.slice(points, F.greatest(F.size(points) - n + 1, F.lit(1)), F.lit(n))


def fresh_points(points: Column, from_s: Column) -> Column:
    """points (in order of time) from the first one on that isn't before from_s."""
    old = F.size(F.filter(points, lambda p: p["t_s"] < from_s))
    return F.slice(points, old + 1, F.size(points))


def vessel_features(latest: DataFrame, statics: DataFrame, as_of_s: int, selected: int | None = None) -> DataFrame:
    """(mmsi, feature): one GeoJSON point per vessel with a fix. Without ``flags`` a vessel moves above 0.5 knots."""
    flagged = ais.has_flag(F.col("flags"), ais.FLAG_MOVING) if "flags" in latest.columns else F.coalesce(F.col("sog_t") > 5, F.lit(False))
    rows = latest.where("lng IS NOT NULL AND lat IS NOT NULL").join(statics.select("mmsi", "vessel_name", "ship_type"), "mmsi", "left")
    age = F.greatest(F.lit(as_of_s) - F.col("t_s"), F.lit(0))
    about = F.struct(
        "mmsi", F.coalesce(F.trim("vessel_name"), F.lit("")).alias("name"), ais.ship_category(F.coalesce("ship_type", F.lit(0))).alias("category"), age.alias("ageSeconds"),
        F.coalesce("heading", (F.col("cog_t") / 10).cast("int"), F.lit(0)).cast("int").alias("heading"), "source_id",
        (F.col("heading").isNotNull() | F.col("cog_t").isNotNull()).alias("hasHeading"), (F.col("sog_t") / 10).alias("sog"), (F.col("cog_t") / 10).alias("cog"),
        flagged.alias("isMoving"), F.coalesce(F.col("mmsi") == F.lit(selected).cast("long"), F.lit(False)).alias("selected"),
    )
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return rows.select("mmsi", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), about.alias("properties"))).alias("feature"))


def trail_features(trails: DataFrame, positions: DataFrame | None = None, statics: DataFrame | None = None, selected: int | None = None, visible: DataFrame | None = None) -> DataFrame:
    """(mmsi, feature): one GeoJSON line per trail of two points or more, of the vessels in ``visible`` (mmsi) if it is given.

    Properties as its marker has them: the category by ``statics``, whether it is selected, and whether it moved above 0.5 knots at
    its newest point, by ``positions``.
    """
    rows = trails.where(F.size("trail") >= 2)
    if visible is not None:
        rows = rows.join(visible.select("mmsi").distinct(), "mmsi", "left_semi")
    about = [F.col("mmsi")]
    if statics is not None:
        rows = rows.join(statics.select("mmsi", "ship_type"), "mmsi", "left")
        about.append(ais.ship_category(F.coalesce("ship_type", F.lit(0))).alias("category"))
    about.append(F.coalesce(F.col("mmsi") == F.lit(selected).cast("long"), F.lit(False)).alias("selected"))
    if positions is not None:
        rows = rows.withColumn("seq", F.element_at("trail", -1)["seq"]).join(positions.select("mmsi", "seq", "sog_t"), ["mmsi", "seq"], "left")
        about.append(F.coalesce(F.col("sog_t") > 5, F.lit(False)).alias("isMoving"))
    line = F.struct(F.lit("LineString").alias("type"), F.transform("trail", lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))
    return rows.select("mmsi", F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct(*about).alias("properties"))).alias("feature"))


def feature_collections(features: DataFrame, most: int = 5000) -> DataFrame:
    """(part, collection): all features as GeoJSON collections of about ``most`` each, in order of id; a small table is one part."""
    parts = max(1, -(-features.count() // most))
    rows = features.groupBy(F.pmod(F.xxhash64("mmsi"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("mmsi", "feature"))).alias("rows"))
    return rows.select("part", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("rows", lambda r: r["feature"]), ","), F.lit("]}")).alias("collection"))
