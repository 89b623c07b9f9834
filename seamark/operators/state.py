"""Vessel state: carried static fields, merges of partial messages, stored filters, watch lists, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATIC_TEXTS = ("vessel_name", "call_sign", "destination")
SIZES = ("to_bow", "to_stern", "to_port", "to_starboard")
ETA = ("eta_month", "eta_day", "eta_hour", "eta_minute")


def carried(statics: DataFrame) -> DataFrame:
    """Static fields that a message carries: blank texts and type 0 count as absent."""
    texts = {c: F.nullif(F.trim(c), F.lit("")) for c in STATIC_TEXTS if c in statics.columns}
    return statics.withColumns(texts | ({"ship_type": F.nullif("ship_type", F.lit(0))} if "ship_type" in statics.columns else {}))


def stored_heading(heading: Column) -> Column:
    return F.when(heading.between(0, 359), heading)


def stored_turn(rot: Column) -> Column:
    """Rate of turn without the sentinel; 127 either way is kept."""
    return F.when((rot != -128) & (F.abs(rot) < 127.5), rot)


def static_merge(messages: DataFrame) -> DataFrame:
    """One row per vessel: of every field the last that was carried; an arrival time is replaced as a whole.

    So the halves of a class B vessel's static data come together, in any order.
    """
    rows = carried(messages)
    fields = [c for c in rows.columns if c not in ("mmsi", "seq", "t_s", "source_id", "part", *ETA)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    if set(ETA) <= set(rows.columns):
        some = F.coalesce(*(F.col(c) for c in ETA)).isNotNull()
        last.append(F.max_by(F.struct(*ETA), F.when(some, F.col("seq"))).alias("eta"))
    return rows.groupBy("mmsi").agg(F.max("seq").alias("seq"), *last)


def static_history(messages: DataFrame) -> DataFrame:
    """messages with every field filled from the last one before that carried it."""
    rows = carried(messages)
    w = Window.partitionBy("mmsi").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in rows.columns if c not in ("mmsi", "seq", "t_s", "source_id", "part")})


def with_stored_filter(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """A batch with the stored filter of each of its vessels; the join reads the vessels of the batch only."""
    keys = batch.select("mmsi").distinct()
    return batch.join(filters.join(keys, "mmsi", "left_semi"), "mmsi", "left")


def row_stamp(position_s: Column, static_s: Column, position_source: Column, static_source: Column) -> Column:
    """struct<last_seen_s, last_source> of the newer of two messages; of equals the position's."""
    static_newer = F.coalesce(static_s > position_s, position_s.isNull())
    return F.struct(F.greatest(position_s, static_s).alias("last_seen_s"), F.when(static_newer, static_source).otherwise(position_source).alias("last_source"))


def watched(positions: DataFrame, watch_list: DataFrame) -> DataFrame:
    """Positions of the vessels on a curated list, with the list's columns; Spark sends the list to all tasks while it is small."""
    return positions.join(watch_list, "mmsi")


def wire_static(statics: DataFrame) -> DataFrame:
    """Static frames: class A in full; a class B half has blanks for what the other half holds."""
    is_b, part = F.col("part").isNotNull(), F.col("part")
    name = F.when(is_b & (part == 1), "").otherwise(F.coalesce("vessel_name", F.lit("")))
    rest = {c: F.when(is_b & (part != 1), None).otherwise(F.col(c)) for c in ("call_sign", "ship_type", *SIZES)}
    return statics.withColumns({"vessel_name": name, **rest})


def static_payload(row: DataFrame) -> DataFrame:
    """row with ``static``: null if all its fields are empty, sizes with 0 for what is missing if any is there."""
    c = F.col
    any_size = F.coalesce(*(c(s) for s in SIZES)).isNotNull()
    sizes = F.when(any_size, F.struct(*(F.coalesce(c(s), F.lit(0)).alias(s) for s in SIZES)))
    fields = [c("vessel_name"), c("call_sign"), c("destination"), c("imo"), c("ship_type"), c("draught_t")]
    empty = ~any_size
    for f in fields:
        empty = empty & f.isNull()
    return row.withColumn("static", F.when(~empty, F.struct(*fields, sizes.alias("sizes"))))


def filter_payload(lng: Column, lat: Column, vlng: Column, vlat: Column, covariance: Column) -> Column:
    """A stored filter, only if it is whole."""
    whole = lng.isNotNull() & lat.isNotNull() & vlng.isNotNull() & vlat.isNotNull() & (F.size(covariance) == 16)
    return F.when(whole, F.struct(lng.alias("lng"), lat.alias("lat"), vlng.alias("vlng"), vlat.alias("vlat"), covariance.alias("covariance")))


def archived_fix(position: Column, filtered: Column) -> Column:
    """struct<lng, lat, sog_t, cog_t> of the last position, else of the filter, which knows no speed over ground."""
    own = F.when(position.isNotNull(), F.struct(position["lng"].alias("lng"), position["lat"].alias("lat"), position["sog_t"].cast("long").alias("sog_t"), position["cog_t"].cast("long").alias("cog_t")))
    none = F.lit(None).cast("long")
    return F.coalesce(own, F.when(filtered.isNotNull(), F.struct(filtered["lng"].alias("lng"), filtered["lat"].alias("lat"), none.alias("sog_t"), none.alias("cog_t"))))


def shown_trails(trails: DataFrame, disabled: list[int], selected: int | None, show_all: bool) -> DataFrame:
    """Trails that aren't switched off, of all vessels or of the selected one."""
    on = ~F.col("mmsi").isin(disabled) if disabled else F.lit(True)
    return trails.where(on & (F.lit(show_all) | (F.col("mmsi") == F.lit(selected if selected is not None else -1))))


def without(live: DataFrame, keys: list[int]) -> DataFrame:
    return live.where(~F.col("mmsi").isin(keys)) if keys else live


def next_zone_number(zones: DataFrame, prefix: str = "Custom Zone ") -> DataFrame:
    """One row: the number for the next zone that is named after the prefix."""
    number = F.regexp_extract("label", rf"^{prefix}(\d+)$", 1).try_cast("long")
    return zones.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))
