"""Gates between decoded frames and storage: each frame is accepted, or quarantined with its first reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators import tracks
from seamark.operators.replay import replayed
from seamark.sources.landing import landed, shared_path

LONGEST_LINE = 82


def lines(text: DataFrame, value: str = "value") -> DataFrame:
    """One row per trimmed line that isn't empty."""
    return text.withColumn(value, F.explode(F.split(F.col(value), "\n"))).withColumn(value, F.trim(F.regexp_replace(F.col(value), "\r", ""))).where(F.length(value) > 0)


def too_long(value: Column, trimmed: bool) -> Column:
    """Datagrams count bytes before they are trimmed, the relay's lines characters after."""
    return F.char_length(F.trim(value)) > LONGEST_LINE if trimmed else F.octet_length(value) > LONGEST_LINE


def in_box(lng: Column, lat: Column, west: float = 13.5, south: float = 52.5, east: float = 16.5, north: float = 54.5) -> Column:
    return lng.between(west, east) & lat.between(south, north)


def gated(positions: DataFrame) -> DataFrame:
    """positions with ``reason``: null if accepted. Gates in order: id format, id country, physical ranges (with a fix only)."""
    sog, cog = F.col("sog_t") / 10, F.col("cog_t") / 10
    fix = F.col("lng").isNotNull() & F.col("lat").isNotNull()
    ranges = F.when(fix, ais.position_reason(F.col("lat"), F.col("lng"), sog, cog, F.col("heading")))
    form = F.when(~ais.mmsi_in_format(F.col("mmsi")), "mmsi-invalid-format")
    return positions.withColumn("reason", F.coalesce(form, ais.mmsi_reason(F.col("mmsi")), ranges))


def admission_step(burst: int, per_minute: int, start: tuple[int, int] | None = None):
    """(bucket, (mmsi, t_s, seq)) -> (bucket, the row and the tokens left if it admits a vessel so far unknown).

    bucket: (sixtieths of tokens, time, known vessels). It starts full, or with ``start``; a known vessel costs nothing, and one
    that finds no token stays unknown.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        mmsi, t, _ = row
        tokens, last, known = state if state is not None else (*(start or (60 * burst, t)), set())
        if mmsi in known:
            return (tokens, last, known), None
        tokens = min(60 * burst, tokens + (t - last) * per_minute)
        if tokens < 60:
            return (tokens, t, known), None
        known.add(mmsi)
        return (tokens - 60, t, known), (*row, tokens - 60)

    return step


#: Rows that the one task of a round goes over, unless a single second needs more.
ROUND_ROWS = 1_000_000


def _until(tried: DataFrame, at_most: int, bins: int = 1024) -> int | None:
    """The last second up to which tried (t_s) has about at_most rows, and the first second at least; null without rows."""
    low, high, n = tried.agg(F.min("t_s"), F.max("t_s"), F.count("*")).first()
    while n and n > at_most and low < high:
        width = -(-(high - low + 1) // bins)
        counts = tried.where(F.col("t_s") <= high).groupBy(F.floor((F.col("t_s") - low) / width).alias("b")).count().collect()  # bins rows at most
        total, end = 0, -1
        for b, c in sorted(counts):
            total += c
            if total > at_most:
                break
            end = b
        if end >= 0:
            return low + (end + 1) * width - 1
        high = low + width - 1
    return high


def admitted_by_bucket(positions: DataFrame, burst: int = 200, per_minute: int = 100, round_rows: int = ROUND_ROWS) -> DataFrame:
    """positions with ``admitted``: vessels so far unknown share one bucket of ``burst`` tokens, refilled by per_minute.

    A vessel is tried again at each frame until it gets a token, and all its frames pass from that one on. One bucket has one order,
    so time goes in rounds, each a task over the frames that may take a token in it: of vessels that no round before
    admitted, the first frame in each second, and of those in one second no more than can matter, as a round admits
    no more vessels than the bucket gives in its time. A round ends after about round_rows of them. Between rounds
    only the bucket is carried, and the vessels it admitted leave the rows by a join; rounds get longer as vessels get known.
    Rows without an id are no vessel's and aren't admitted.
    """
    spark = positions.sparkSession
    tried = landed(positions.where("mmsi IS NOT NULL").groupBy("mmsi", "t_s").agg(F.min("seq").alias("seq")))
    kind = ", ".join(f"{as_} {tried.schema[c].dataType.simpleString()}" for c, as_ in (("mmsi", "mmsi"), ("t_s", "from_t"), ("seq", "from_seq"))) + ", tokens long"
    path = shared_path(spark, "admitted")
    since = spark.createDataFrame([], kind)
    since.write.parquet(path)
    start, end, left = None, None, tried
    while (end := _until(left, round_rows)) is not None:
        part = left.where(F.col("t_s") <= end)
        span = end - part.agg(F.min("t_s")).first()[0]
        # In one second: all tokens of a full bucket, behind vessels that this round has admitted before.
        matter = 2 * burst + per_minute * span // 60 + 1
        rank = F.row_number().over(Window.partitionBy("t_s").orderBy("seq"))
        part = part.withColumn("rank", rank).where(F.col("rank") <= matter).select(F.lit(0).alias("bucket"), "mmsi", "t_s", "seq")
        replayed(part, ["bucket"], ["mmsi", "t_s", "seq"], admission_step(burst, per_minute, start), kind).drop("bucket").write.mode("append").parquet(path)
        since = spark.read.schema(since.schema).parquet(path)
        # Refills up to the brim add up, so the last admission is all that the next round needs to know of the bucket.
        last = since.agg(F.max(F.struct("from_t", "from_seq", "tokens")).alias("s")).first()["s"]
        start = None if last is None else (last["tokens"], last["from_t"])
        left = tried.where(F.col("t_s") > end).join(since.select("mmsi"), "mmsi", "left_anti")
    passed = F.struct("t_s", "seq") >= F.struct(F.col("from_t").alias("t_s"), F.col("from_seq").alias("seq"))
    return positions.join(since.drop("tokens"), "mmsi", "left").withColumn("admitted", F.coalesce(passed, F.lit(False)) & F.col("from_t").isNotNull()).drop("from_t", "from_seq")


def limited(positions: DataFrame) -> DataFrame:
    """gated positions with the per-vessel rate limit applied to those that passed."""
    rows = gated(positions)
    passed = tracks.rate_limit(rows.where("reason IS NULL")).withColumnRenamed("accepted", "__in_rate")
    joined = rows.join(passed, ["mmsi", "seq"], "left")
    return joined.withColumn("reason", F.coalesce("reason", F.when(~F.col("__in_rate"), "rate-limited"))).drop("__in_rate")


def quarantine(rows: DataFrame) -> DataFrame:
    """Rejected rows as dead letters: time, source, reason and the row itself as JSON."""
    body = F.to_json(F.struct(*(c for c in rows.columns if c != "reason")))
    return rows.where("reason IS NOT NULL").select(F.col("t_s").alias("ts"), "source_id", F.struct(F.col("reason").alias("kind"), ais.coarse_reason(F.col("reason")).alias("gate")).alias("reason"), body.alias("raw"))


def vessel_counts(rows: DataFrame, *by: str, approximate: bool = False) -> DataFrame:
    """Vessels, and vessels with a fix; ``approximate`` counts them in sketches, which merge without a shuffle of ids."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    fix = F.when(F.col("lng").isNotNull() & F.col("lat").isNotNull(), F.col("mmsi"))
    return rows.groupBy(*by).agg(count("mmsi").alias("vessels"), count(fix).alias("with_fix"))


def source_counts(rows: DataFrame) -> DataFrame:
    """Accepted and rejected frames of each source, and the time of its last frame."""
    return rows.groupBy("source_id").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.max("t_s").alias("last_frame_s"))
