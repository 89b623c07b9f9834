"""Operators on the ordered fixes of each vessel: latest, merge, hysteresis, rate limit, trails, filter.

Rows need (mmsi, t_s, seq); every order is (t_s, seq) or seq, so results don't depend on partitioning.
A vessel's history is cut into slices of time (``slice_s``), so that it is the work of many tasks: what carries over
from slice to slice is a row each (``operators.scans``). Streams run the same recurrences step by step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators.scans import SLICE_S, Element, Scan, in_slices, scanned

EVICT_S = 600
OUTLIER_KNOTS, OUTLIER_SLACK_M = 60.0, 75.0
TRAIL_S, TRAIL_POINTS = 300, 30
BUCKET_SIZE, BUCKET_PER_S = 5, 1


def by_vessel(*more: str):
    return Window.partitionBy("mmsi", *more).orderBy("t_s", "seq")


def latest(positions: DataFrame, n: int = 1) -> DataFrame:
    """The n newest fixes of each vessel."""
    w = Window.partitionBy("mmsi").orderBy(F.col("t_s").desc(), F.col("seq").desc())
    return positions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def numbered(positions: DataFrame, gap_s: int = EVICT_S, inclusive: bool = False, slice_s: int = SLICE_S) -> DataFrame:
    """positions with ``session``, the number of silences before; ``rank``, from 0 on in a vessel's history; ``next_t``, the time of its next row.

    A silence is one of more than gap_s (or of gap_s: inclusive). Rows are counted within slices; what came before a slice and
    comes after it is a row of a table of slices. Rows without an id are no vessel's: their numbers mean nothing.
    """
    key = ["mmsi", "__slice"]
    rows = positions.withColumn("__slice", F.floor(F.col("t_s") / slice_s))
    over_slices = Window.partitionBy("mmsi").orderBy("__slice")
    ends = rows.groupBy(*key).agg(F.min("t_s").alias("lo"), F.max("t_s").alias("hi"), F.count("*").alias("n"))
    so_far = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, F.lag("hi").over(over_slices).alias("__before"), F.lead("lo").over(over_slices).alias("__after"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("__rows"))
    w = Window.partitionBy(*key).orderBy("t_s", "seq")
    rows = rows.join(ends, key, "left")
    silent = F.col("t_s") - F.coalesce(F.lag("t_s").over(w), F.col("__before"))
    cut = F.when((silent >= gap_s) if inclusive else (silent > gap_s), 1).otherwise(0)
    rows = rows.withColumns({"__cut": cut, "rank": F.col("__rows") + F.row_number().over(w) - 1, "next_t": F.coalesce(F.lead("t_s").over(w), F.col("__after"))})
    counts = rows.groupBy(*key).agg(F.sum("__cut").alias("n"))
    earlier = counts.select(*key, F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("__earlier"))
    rows = rows.join(earlier, key, "left").withColumn("session", F.coalesce("__earlier", F.lit(0)) + F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("__cut", "__earlier", "__slice", "__before", "__after", "__rows")


def sessions(positions: DataFrame, gap_s: int = EVICT_S, inclusive: bool = False, slice_s: int = SLICE_S) -> DataFrame:
    """positions with ``session``: a new one after a silence of more than gap_s (or of gap_s: inclusive)."""
    return numbered(positions, gap_s, inclusive, slice_s).drop("rank", "next_t")


def moving_step(on: float = 0.5, off: float = 0.3):
    """(state, (t_s, seq, knots)) -> (state, (seq, session, moving)): ``hysteresis`` a fix at a time; state: (session, time, moving)."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        t, seq, sog = row
        session, last, moving = state if state is not None else (0, t, False)
        if t - last > EVICT_S:
            session, moving = session + 1, False
        if sog is not None:
            moving = sog > on or (moving and sog >= off)
        return (session, t, moving), (seq, session, moving)

    return step


def live_merge(positions: DataFrame, fields: list[str]) -> DataFrame:
    """Each fix with the last known value of every field in its session."""
    w = by_vessel("session").rowsBetween(Window.unboundedPreceding, 0)
    return sessions(positions).withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})


def hysteresis(positions: DataFrame, sog: Column, on: float = 0.5, off: float = 0.3) -> DataFrame:
    """positions with ``moving``: above on it starts, below off it stops, between them it stays as it was."""
    w = by_vessel("session").rowsBetween(Window.unboundedPreceding, 0)
    told = F.when(sog > on, True).when(sog < off, False)
    return sessions(positions).withColumn("moving", F.coalesce(F.last(told, ignorenulls=True).over(w), F.lit(False)))


def coalesce_window(frames: DataFrame, fields: list[str], seconds: int = 1) -> DataFrame:
    """One row per vessel and window: of every field the newest value that was carried."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return frames.groupBy("mmsi", (F.floor(F.col("t_s") / seconds) * seconds).alias("window_s")).agg(F.count("*").alias("n_frames"), F.max("seq").alias("last_seq"), F.max("t_s").alias("last_seen_s"), F.max_by("source_id", "seq").alias("last_source"), *last)


def rate_step(size: int = BUCKET_SIZE, per_s: int = BUCKET_PER_S):
    """(bucket, (t_s, seq)) -> (bucket, (seq, accepted)); bucket: (thousandths of tokens, time)."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        t, seq = row
        tokens, last = state if state is not None else (1000 * size, t)
        tokens = min(1000 * size, tokens + (t - last) * 1000 * per_s)
        ok = tokens >= 1000
        return (tokens - 1000 * ok, t), (seq, ok)

    return step


class Bucket(Scan):
    """A token bucket: a row's element adds c and keeps the tokens between lo and hi; such functions compose to such functions."""

    names, number, result = ("c", "lo", "hi"), "long", "seq long, accepted boolean"

    def __init__(self, size: int, per_s: int):
        self.size, self.per_s = size, per_s

    def elements(self, t: np.ndarray, before: np.ndarray, first: np.ndarray, fields: list[np.ndarray]) -> Element:
        # Refill, then take one if there is one; the bucket of a first row is full.
        add = np.where(first, 0, (t - before) * self.per_s) - 1
        return add, np.where(first, self.size - 1, 0), np.full(len(t), self.size - 1)

    def combine(self, a: Element, b: Element) -> Element:
        (ca, la, ha), (cb, lb, hb) = a, b
        return ca + cb, np.minimum(np.maximum(la + cb, lb), hb), np.minimum(np.maximum(ha + cb, lb), hb)

    def identity(self, n: int) -> Element:
        return np.zeros(n, np.int64), np.full(n, -(1 << 40)), np.full(n, 1 << 40)

    def told(self, before, after, t, before_t, first, fields):
        tokens = np.where(first, self.size, before[1] + (t - before_t) * self.per_s)
        return [fields[0], tokens >= 1]


def rate_limit(frames: DataFrame, key: str | list[str] = "mmsi", size: int = BUCKET_SIZE, per_s: int = BUCKET_PER_S, slice_s: int = SLICE_S) -> DataFrame:
    """(*key, seq, accepted) of a token bucket per key that starts full."""
    return scanned(frames, [key] if isinstance(key, str) else key, ["seq"], Bucket(size, per_s), slice_s=slice_s)


def outlier_step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    """(state, (session, t_s, seq, lng, lat)) -> (state, row of trail_outliers); state: session, t, lng and lat of the last accepted fix."""
    session, t, seq, lng, lat = row
    now, t0, lng0, lat0 = state if state is not None else (session, t, lng, lat)
    ok = True
    if now == session and t > t0:
        east = (lng - lng0) * ais.METRES_PER_DEGREE * math.cos(math.radians((lat0 + lat) / 2))
        # A distance that is no number is far.
        ok = math.hypot(east, (lat - lat0) * ais.METRES_PER_DEGREE) <= OUTLIER_KNOTS * ais.KNOT_M_PER_S * (t - t0) + OUTLIER_SLACK_M
    return ((session, t, lng, lat) if ok else state), (session, seq, t, lng, lat, ok)


def trail_outliers(positions: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """(mmsi, session, seq, t_s, lng, lat, accepted): a fix too far from the last accepted one is an outlier."""
    fixes = sessions(positions.where("lng IS NOT NULL AND lat IS NOT NULL"), slice_s=slice_s)
    kind = "session long, seq long, t_s long, lng double, lat double, accepted boolean"
    return in_slices(fixes, ["mmsi"], ["session", "t_s", "seq", "lng", "lat"], outlier_step, "session long, t long, lng double, lat double", kind, slice_s=slice_s)


def trails(positions: DataFrame, age_s: int = TRAIL_S, points: int = TRAIL_POINTS) -> DataFrame:
    """(mmsi, trail): the accepted fixes of the last age_s seconds of a vessel's last session, newest ``points``."""
    ok = trail_outliers(positions).where("accepted")
    w = Window.partitionBy("mmsi")
    ok = ok.withColumn("end_s", F.max("t_s").over(w)).withColumn("last", F.max("session").over(w)).where((F.col("session") == F.col("last")) & (F.col("t_s") >= F.col("end_s") - age_s))
    newest = Window.partitionBy("mmsi").orderBy(F.col("t_s").desc(), F.col("seq").desc())
    ok = ok.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= points)
    return ok.groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("t_s", "seq", "lng", "lat"))).alias("trail"))


MEASURE_SIGMA, ACCEL_SIGMA, START_SIGMA, START_SPEED_SIGMA, COVARIANCE_CAP, MOST_S = 9e-5, 9e-7, 9e-4, 1e-5, 1000.0, 60


def kalman_step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    """(state, (t_s, seq, lng, lat)) -> (state, row of kalman); state: time and the row's values."""
    t, seq, lng, lat = row
    new = None
    if state is not None:
        last, x, y, vx, vy, p00, p01, p11 = state
        dt, q, r = float(max(min(t - last, MOST_S), 0)), ACCEL_SIGMA**2, MEASURE_SIGMA**2
        p00 = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt * dt * dt * dt / 4
        p01 = p01 + dt * p11 + q * dt * dt * dt / 2
        p11 = p11 + q * dt * dt
        k0, k1 = p00 / (p00 + r), p01 / (p00 + r)
        e_lng, e_lat = lng - (x + vx * dt), lat - (y + vy * dt)
        n00, n01, n11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
        if abs(n00) <= COVARIANCE_CAP and abs(n01) <= COVARIANCE_CAP and abs(n11) <= COVARIANCE_CAP:
            new = (x + vx * dt + k0 * e_lng, y + vy * dt + k0 * e_lat, vx + k1 * e_lng, vy + k1 * e_lat, n00, n01, n11)
    if new is None:
        new = (lng, lat, 0.0, 0.0, START_SIGMA**2, 0.0, START_SPEED_SIGMA**2)
    return (t, *new), (seq, *new)


class Kalman(Scan):
    """The filter as a scan: elements (A, b, C, eta, J) of a filtering step and their composition as in Saerkkae and
    Garcia-Fernandez, Temporal Parallelization of Bayesian Smoothers (2021). The axes share A, C and J.

    Slices start from the scan and go on by steps. With measurements at every step no covariance comes near COVARIANCE_CAP, at which a step would begin anew.
    """

    names = ("a00", "a01", "a10", "a11", "x0", "x1", "y0", "y1", "c00", "c01", "c11", "ex0", "ex1", "ey0", "ey1", "j00", "j01", "j11")
    number, result = "double", "seq long, lng double, lat double, vlng double, vlat double, p00 double, p01 double, p11 double"

    def elements(self, t: np.ndarray, before: np.ndarray, first: np.ndarray, fields: list[np.ndarray]) -> Element:
        _, _, x, y = fields
        dt, q, r = np.clip(t - before, 0, MOST_S).astype(np.float64), ACCEL_SIGMA**2, MEASURE_SIGMA**2
        q00, q01, q11 = q * dt**4 / 4, q * dt**3 / 2, q * dt**2
        s = q00 + r
        k0, k1, o = q00 / s, q01 / s, np.zeros(len(t))
        out = (1 - k0, (1 - k0) * dt, -k1, 1 - k1 * dt, k0 * x, k1 * x, k0 * y, k1 * y, (1 - k0) * q00, (1 - k0) * q01, q11 - k1 * q01, x / s, dt * x / s, y / s, dt * y / s, 1 / s, dt / s, dt * dt / s)
        start = (o, o, o, o, x, o, y, o, o + START_SIGMA**2, o, o + START_SPEED_SIGMA**2, o, o, o, o, o, o, o)
        return tuple(np.where(first, z, e) for z, e in zip(start, out, strict=True))

    def combine(self, a: Element, b: Element) -> Element:
        a00, a01, a10, a11, x0, x1, y0, y1, c00, c01, c11, ex0, ex1, ey0, ey1, j00, j01, j11 = a
        b00, b01, b10, b11, u0, u1, v0, v1, d00, d01, d11, fx0, fx1, fy0, fy1, k00, k01, k11 = b
        # M = inverse of I + C J', with C of the first and J' of the second.
        m00, m01, m10, m11 = 1 + c00 * k00 + c01 * k01, c00 * k01 + c01 * k11, c01 * k00 + c11 * k01, 1 + c01 * k01 + c11 * k11
        det = m00 * m11 - m01 * m10
        m00, m01, m10, m11 = m11 / det, -m01 / det, -m10 / det, m00 / det
        # B = A' M
        p00, p01, p10, p11 = b00 * m00 + b01 * m10, b00 * m01 + b01 * m11, b10 * m00 + b11 * m10, b10 * m01 + b11 * m11

        def mean(z0, z1, f0, f1, w0, w1):
            s0, s1 = z0 + c00 * f0 + c01 * f1, z1 + c01 * f0 + c11 * f1
            return p00 * s0 + p01 * s1 + w0, p10 * s0 + p11 * s1 + w1

        # G = A^T M^T
        g00, g01, g10, g11 = a00 * m00 + a10 * m01, a00 * m10 + a10 * m11, a01 * m00 + a11 * m01, a01 * m10 + a11 * m11

        def information(z0, z1, f0, f1, e0, e1):
            s0, s1 = f0 - k00 * z0 - k01 * z1, f1 - k01 * z0 - k11 * z1
            return g00 * s0 + g01 * s1 + e0, g10 * s0 + g11 * s1 + e1

        q00, q01, q10, q11 = p00 * c00 + p01 * c01, p00 * c01 + p01 * c11, p10 * c00 + p11 * c01, p10 * c01 + p11 * c11
        h00, h01, h10, h11 = g00 * k00 + g01 * k01, g00 * k01 + g01 * k11, g10 * k00 + g11 * k01, g10 * k01 + g11 * k11
        return (
            p00 * a00 + p01 * a10, p00 * a01 + p01 * a11, p10 * a00 + p11 * a10, p10 * a01 + p11 * a11,
            *mean(x0, x1, fx0, fx1, u0, u1), *mean(y0, y1, fy0, fy1, v0, v1),
            q00 * b00 + q01 * b01 + d00, q00 * b10 + q01 * b11 + d01, q10 * b10 + q11 * b11 + d11,
            *information(x0, x1, fx0, fx1, ex0, ex1), *information(y0, y1, fy0, fy1, ey0, ey1),
            h00 * a00 + h01 * a10 + j00, h00 * a01 + h01 * a11 + j01, h10 * a01 + h11 * a11 + j11,
        )

    def identity(self, n: int) -> Element:
        o, one = np.zeros(n), np.ones(n)
        return (one, o, o, one, *(o,) * 14)

    def state(self) -> Column:
        return F.struct("__t", "x0", "y0", "x1", "y1", "c00", "c01", "c11")


def kalman(positions: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """(mmsi, seq, lng, lat, vlng, vlat, p00, p01, p11): constant-velocity filter of each vessel's fixes; ones that are no numbers are left out.

    The axes share one gain, as they start alike and never mix; so the state is one 2 x 2 covariance and
    two positions and speeds.
    """
    fixes = positions.withColumns({c: F.col(c).cast("double") for c in ("lng", "lat")}).where("abs(lng) < double('Infinity') AND abs(lat) < double('Infinity')")
    return scanned(fixes, ["mmsi"], ["t_s", "seq", "lng", "lat"], Kalman(), slice_s=slice_s, step=kalman_step)


def covariance16(p00: Column, p01: Column, p11: Column) -> Column:
    """The 4 x 4 covariance of (lng, lat, vlng, vlat), row by row."""
    o = F.lit(0.0)
    return F.array(p00, o, p01, o, o, p00, o, p01, p01, o, p11, o, o, p01, o, p11)


def throttled(positions: DataFrame, millis: int = 250) -> DataFrame:
    """The last state of each vessel in every interval of ``millis``."""
    slot = F.floor(F.col("t_s") * 1000 / millis)
    return positions.groupBy("mmsi", slot.alias("slot")).agg(F.max("seq").alias("seq"), F.max_by("lng", "seq").alias("lng"), F.max_by("lat", "seq").alias("lat"))


def resampled(positions: DataFrame, step_ms: int = 500, most_ms: int = 1500) -> DataFrame:
    """Points between a fix and the next one, eased over ``most_ms``."""
    w = by_vessel("session")
    fixes = sessions(positions.where("lng IS NOT NULL AND lat IS NOT NULL")).select("mmsi", "seq", "lng", "lat", F.lead("lng").over(w).alias("lng2"), F.lead("lat").over(w).alias("lat2")).where("lng2 IS NOT NULL")
    out = fixes.withColumn("ms", F.explode(F.sequence(F.lit(0), F.lit(most_ms), F.lit(step_ms))))
    e = ais.eased(F.col("ms") / most_ms)
    return out.select("mmsi", "seq", "ms", (F.col("lng") + (F.col("lng2") - F.col("lng")) * e).alias("lng"), (F.col("lat") + (F.col("lat2") - F.col("lat")) * e).alias("lat"))


def active_source(frames: DataFrame, priority: tuple[int, ...] = (3, 2, 0, 1), alive_s: int = 900) -> DataFrame:
    """frames with ``active``: of the sources heard in the last alive_s seconds of the vessel's frames, the first by priority."""
    w = Window.partitionBy("mmsi").orderBy("t_s").rangeBetween(-alive_s, 0)
    heard = [F.when(F.max(F.when(F.col("source_id") == s, 1)).over(w) == 1, s) for s in priority]
    return frames.withColumn("active", F.coalesce(*heard))
