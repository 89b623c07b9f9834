"""Zones: membership, dwell events, silence, presence; and vessels near each other."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.functions import ais
from seamark.operators import tracks
from seamark.sources.landing import landed

DWELL_S, SILENCE_S = 30, 600
#: A table of cells goes to every task up to this many bytes; beyond that it is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: A cell is cut further while it has more edges, so many times at most.
CELL_EDGES, CELL_CUTS = 16, 10
#: Rows of one side of a key in which neighbours meet, and pairs that a task looks at, both about so many.
BLOCK_ROWS, TASK_PAIRS = 2_000, 20_000_000
#: Beyond a cell's bounds, more than rounding can move a point or a crossing.
_MARGIN = 1e-9


def in_rings(lng: Column, lat: Column, rings: Column) -> Column:
    """Whether a point is inside an outer ring and outside its holes: the parity of the edges that a ray to the east crosses."""

    def crossings(total, ring):
        n = F.size(ring)

        def edge(i):
            a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
            ax, ay, bx, by = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
            return ((ay > lat) != (by > lat)) & (lng < (bx - ax) * (lat - ay) / (by - ay) + ax)

        return total + F.size(F.filter(F.sequence(F.lit(0), n - 1), edge))

    return F.aggregate(rings, F.lit(0), crossings) % 2 == 1


def with_bounds(zones: DataFrame) -> DataFrame:
    outer = F.get("rings", F.lit(0))
    xs, ys = F.transform(outer, lambda p: F.get(p, F.lit(0))), F.transform(outer, lambda p: F.get(p, F.lit(1)))
    return zones.withColumns({"west": F.array_min(xs), "east": F.array_max(xs), "south": F.array_min(ys), "north": F.array_max(ys)})


def operational(zones: DataFrame) -> DataFrame:
    return zones.where(F.coalesce(F.col("decorative"), F.lit(False)) == F.lit(False))


def rendered(zones: DataFrame) -> DataFrame:
    return zones.where(F.coalesce(F.col("visible"), F.lit(True)))


def zone_problems(zones: DataFrame, most: int = 50, most_chars: int = 500_000) -> DataFrame:
    """(check, failures) of a zone table: ids with a pipe, too many zones, too long when written out."""
    text = F.sum(F.length(F.to_json(F.struct(*zones.columns))))
    got = zones.agg(F.count_if(F.contains("id", F.lit("|"))).alias("pipe_in_id"), F.when(F.count("*") > most, 1).otherwise(0).cast("long").alias("too_many"), F.when(text > most_chars, 1).otherwise(0).cast("long").alias("too_long"))
    return got.select(F.expr("stack(3, 'pipe_in_id', pipe_in_id, 'too_many', too_many, 'too_long', too_long) AS (check, failures)"))


def edited_zones(zones: DataFrame, added: DataFrame | None = None, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """zones after rows were deleted by id, replaced by id and added."""
    for rows in (deleted, changed):
        if rows is not None:
            zones = zones.join(rows.select("id").distinct(), "id", "left_anti")
    for rows in (changed, added):
        if rows is not None:
            zones = zones.unionByName(rows, allowMissingColumns=True)
    return zones


_CELL = "zone_id string, level int, cx long, cy long, inside boolean, edges array<struct<ax: double, ay: double, bx: double, by: double>>, west double, east double, south double, north double"


def _crossings(edges: np.ndarray, x: float, y: float) -> int:
    """How many edges (ax, ay, bx, by) a ray from a point to the east crosses."""
    ax, ay, bx, by = edges[(edges[:, 1] > y) != (edges[:, 3] > y)].T
    return int((x < (bx - ax) * (y - ay) / (by - ay) + ax).sum())


def _cover(edges: np.ndarray, bounds: tuple[float, float, float, float], most_edges: int, cuts: int) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(level, cx, cy, inside, edges) of the cells of one zone, as ``zone_cells`` has them."""
    west, east, south, north = bounds
    level = max(0, math.floor(math.log2(360 / max(east - west, north - south, 1e-6))))
    at = lambda v: math.floor((v + 180) / (360 / 2.0**level))
    todo = [(level, x, y, False, edges) for x in range(at(west), at(east) + 1) for y in range(at(south), at(north) + 1)]
    while todo:
        k, cx, cy, inside, e = todo.pop()
        size = 360 / 2.0**k
        w, s = cx * size - 180 - _MARGIN, cy * size - 180 - _MARGIN
        right, top = w + size + 2 * _MARGIN, s + size + 2 * _MARGIN
        low_x, high_x, low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
        across = (low_x > right) & (low <= s) & (high > top)
        inside ^= bool(across.sum() % 2)
        keep = (high >= s) & (low <= top) & (high_x >= w) & ~across
        e, low_x = e[keep], low_x[keep]
        # An edge whose line has all corners of the cell on one side isn't in the cell.
        sides = np.array([(e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0]) for x in (w, right) for y in (s, top)]).reshape(4, -1)
        touching = int(((low_x <= right) & ~(sides > 0).all(0) & ~(sides < 0).all(0)).sum())
        if not touching:
            if inside ^ bool(_crossings(e, (w + right) / 2, (s + top) / 2) % 2):
                yield k, cx, cy, True, e[:0]
        elif touching <= most_edges or k >= level + cuts:
            yield k, cx, cy, inside, e
        else:
            todo += [(k + 1, 2 * cx + i, 2 * cy + j, inside, e) for i in (0, 1) for j in (0, 1)]


def zone_cells(zones: DataFrame, most_edges: int = CELL_EDGES, cuts: int = CELL_CUTS) -> DataFrame:
    """(zone_id, level, cx, cy, inside, edges, and the zone's bounds): cells of a quadtree that cover each zone; one of level k is 360 / 2^k degrees wide.

    A zone starts with the four cells at most that are as wide as it is. A cell without edges in it is dropped or, where its middle is
    inside, all inside; one with many edges in it is cut in four. ``edges`` are those that decide for points of the cell which a ray to the east
    crosses, and ``inside`` the parity of the others: edges east of the cell from its southern to its northern bound count for all its points.
    A zone is as many rows as its outline needs, whatever its area; ones without a ring, or with corners that are no numbers, have none.
    """
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for zone, rings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                corners = [np.array([p[:2] for p in r or () if p is not None and len(p) > 1], np.float64).reshape(-1, 2) for r in rings or ()]
                if not corners or not len(corners[0]) or not all(np.isfinite(r).all() for r in corners):
                    continue
                edges = np.concatenate([np.hstack([r, np.roll(r, -1, 0)]) for r in corners])
                (west, south), (east, north) = corners[0].min(0), corners[0].max(0)
                cells = _cover(edges, (west, east, south, north), most_edges, cuts)
                while some := list(itertools.islice(cells, 1000)):
                    ends = np.cumsum([0, *(len(c[4]) for c in some)])
                    flat = np.concatenate([c[4] for c in some])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(4)], fields=list(kind.value_type)))
                    same = lambda v, n=len(some): pa.array([v] * n)
                    yield pa.record_batch([same(zone), pa.array([c[0] for c in some], pa.int32()), *(pa.array([c[j] for c in some], pa.int64()) for j in (1, 2)), pa.array([c[3] for c in some]), lists, same(west), same(east), same(south), same(north)], ["zone_id", "level", "cx", "cy", "inside", "edges", "west", "east", "south", "north"])

    return zones.select("id", "rings").mapInArrow(run, _CELL)


def _crossed(edges: Column, lng: Column, lat: Column) -> Column:
    """How many edges a ray from a point to the east crosses."""
    return F.size(F.filter(edges, lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (lng < (e["bx"] - e["ax"]) * (lat - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])))


def membership(positions: DataFrame, zones: DataFrame, most_edges: int = CELL_EDGES) -> DataFrame:
    """(every position with a fix) x (zone that holds it): zone_id. Fixes meet zones in the cells of ``zone_cells``."""
    fixes = positions.where("lng IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lng) AND NOT isnan(lat)")
    cells = landed(zone_cells(zones, most_edges))
    n, edges, levels = cells.agg(F.count("*"), F.sum(F.size("edges")), F.collect_set("level")).first()  # some thirty levels at most
    here = fixes.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))) if levels else F.array().cast("array<int>")))
    wide = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    here = here.withColumns({"cx": F.floor((F.col("lng") + 180) / wide), "cy": F.floor((F.col("lat") + 180) / wide)})
    met = here.join(F.broadcast(cells) if 96 * n + 40 * (edges or 0) <= BROADCAST_BYTES else cells, ["level", "cx", "cy"])
    lng, lat = F.col("lng"), F.col("lat")
    met = met.where(lng.between(F.col("west"), F.col("east")) & lat.between(F.col("south"), F.col("north")))
    return met.where(F.col("inside") != (_crossed(F.col("edges"), lng, lat) % 2 == 1)).drop("level", "cx", "cy", "inside", "edges", "west", "east", "south", "north")


def _pairs(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """Every fix of a vessel against each zone that the vessel was ever in, with ``inside`` and the session of silence."""
    fixes = positions.where("lng IS NOT NULL AND lat IS NOT NULL").select("mmsi", "t_s", "seq", "lng", "lat")
    gap = F.col("t_s") - F.lag("t_s").over(Window.partitionBy("mmsi").orderBy("t_s", "seq"))
    w = Window.partitionBy("mmsi").orderBy("t_s", "seq").rowsBetween(Window.unboundedPreceding, 0)
    fixes = fixes.withColumn("session", F.sum(F.when(gap >= SILENCE_S, 1).otherwise(0)).over(w))
    hits = membership(fixes, zones).select("mmsi", "seq", "zone_id")
    return fixes.join(hits.select("mmsi", "zone_id").distinct(), "mmsi").join(hits.withColumn("inside", F.lit(True)), ["mmsi", "seq", "zone_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def _stays(hits: DataFrame, slice_s: int) -> DataFrame:
    """(mmsi, zone_id, session, r0, r1, since, left_s): runs of hits of following ranks, and the time of the fix after each.

    Runs are found within slices of time, and those that go on in the next slice are joined.
    """
    key = ["mmsi", "zone_id", "session"]
    hits = hits.withColumn("slice", F.floor(F.col("t_s") / slice_s))
    island = F.col("rank") - F.row_number().over(Window.partitionBy(*key, "slice").orderBy("rank"))
    parts = hits.withColumn("island", island).groupBy(*key, "slice", "island").agg(F.min("rank").alias("r0"), F.max("rank").alias("r1"), F.min("t_s").alias("since"), F.max_by("next_t", "rank").alias("left_s"))
    w = Window.partitionBy(*key).orderBy("r0")
    new = F.when(F.col("r0") == F.lag("r1").over(w) + 1, 0).otherwise(1)
    parts = parts.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*key, "run").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("since").alias("since"), F.max_by("left_s", "r1").alias("left_s")).drop("run")


def geofence_events(positions: DataFrame, zones: DataFrame, dwell_s: int = DWELL_S, silence_s: int = SILENCE_S, silence_policy: str = "ghost", slice_s: int = tracks.SLICE_S) -> DataFrame:
    """(kind, mmsi, zone_id, at_s, silent_s): enter and exit after dwell_s in or out without a break; what silence ends.

    A run is a stretch of equal membership; its first fix at least dwell_s after its start tells, if it differs
    from what was told last (at first: outside). A silence of silence_s starts afresh; if the vessel was inside by
    then, it gives ``ghost-exit`` silence_s after its last fix, or with the policy ``evict`` a plain ``exit`` at that fix.

    Only fixes in zones are looked at by zone: runs inside are stretches of their ranks, and runs outside the gaps between.
    """
    key = ["mmsi", "zone_id", "session"]
    fixes = positions.where("lng IS NOT NULL AND lat IS NOT NULL AND mmsi IS NOT NULL").select("mmsi", "t_s", "seq", "lng", "lat")
    fixes = landed(tracks.numbered(fixes, silence_s, True, slice_s))
    hits = membership(fixes, operational(zones)).select(*key, "t_s", "rank", "next_t")
    spans = fixes.groupBy("mmsi", "session").agg(F.max("t_s").alias("last_s"), F.max("rank").alias("last_rank"))
    stays = landed(_stays(hits, slice_s))
    w = Window.partitionBy(*key).orderBy("r0")
    inside = stays.select(*key, F.lit(True).alias("inside"), "r0", "r1", "since")
    gaps = stays.withColumn("next", F.lead("r0").over(w)).join(spans, ["mmsi", "session"]).where("r1 < last_rank")
    outside = gaps.select(*key, F.lit(False).alias("inside"), (F.col("r1") + 1).alias("r0"), (F.coalesce("next", F.col("last_rank") + 1) - 1).alias("r1"), F.col("left_s").alias("since"))
    # A session has no silence of silence_s, so the first fix dwell_s after a run's start is in one of a few minutes.
    minute = lambda t: F.floor(t / 60)
    runs = inside.union(outside).withColumn("minute", F.explode(F.sequence(minute(F.col("since") + dwell_s), minute(F.col("since") + dwell_s + silence_s))))
    moments = fixes.select(F.col("mmsi").alias("__mmsi"), minute(F.col("t_s")).alias("__minute"), "rank", "t_s")
    met = runs.join(moments, (F.col("mmsi") == F.col("__mmsi")) & (F.col("minute") == F.col("__minute")) & (F.col("t_s") >= F.col("since") + dwell_s) & F.col("rank").between(F.col("r0"), F.col("r1")))
    told = met.groupBy(*key, "r0", "inside").agg(F.min("t_s").alias("t_s"))
    was = F.coalesce(F.lag("inside").over(w), F.lit(False))
    told = told.withColumn("new", F.col("inside") != was)
    crossings = told.where("new").select(F.when(F.col("inside"), "enter").otherwise("exit").alias("kind"), "mmsi", "zone_id", F.col("t_s").alias("at_s"), F.lit(None).cast("long").alias("silent_s"))
    # Sessions that end inside, but for a vessel's last one: that is still open.
    state = told.groupBy(*key).agg(F.max_by("inside", "r0").alias("inside")).where("inside")
    newest = spans.groupBy("mmsi").agg(F.max("session").alias("newest"))
    ended = spans.join(newest, "mmsi").where("session < newest")
    kind, at = ("ghost-exit", F.col("last_s") + silence_s) if silence_policy == "ghost" else ("exit", F.col("last_s"))
    silent = F.lit(silence_s if silence_policy == "ghost" else None).cast("long")
    gone = state.join(ended, ["mmsi", "session"]).select(F.lit(kind).alias("kind"), "mmsi", "zone_id", at.cast("long").alias("at_s"), silent.alias("silent_s"))
    return crossings.unionByName(gone)


def presence(events: DataFrame) -> DataFrame:
    """(mmsi, zones): the zones that each vessel is confirmed in after all its events."""
    last = events.groupBy("mmsi", "zone_id").agg(F.max_by("kind", F.struct("at_s", F.when(F.col("kind") == "enter", 1).otherwise(0))).alias("kind"))
    return last.groupBy("mmsi").agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "enter", F.col("zone_id")))).alias("zones"))


def in_any(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """The positions in any of the zones at their moment, without dwell."""
    return positions.join(membership(positions, zones).select("mmsi", "seq").distinct(), ["mmsi", "seq"], "left_semi")


#: Kinds of zones in the order in which lists show them.
KIND_ORDER = ("port", "anchorage", "general")


def badges(present: DataFrame, zones: DataFrame) -> DataFrame:
    """(mmsi, zone_id, label, kind): the zones that each vessel of ``present`` (mmsi, zones) is in, with their attributes."""
    rows = present.select("mmsi", F.explode("zones").alias("zone_id"))
    return rows.join(zones.select(F.col("id").alias("zone_id"), "label", "kind"), "zone_id", "left").select("mmsi", "zone_id", F.coalesce("label", "zone_id").alias("label"), "kind")


def last_seen_in_zones(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """(mmsi, last_seen_s): the newest fix of each vessel in any zone."""
    return membership(positions, operational(zones)).groupBy("mmsi").agg(F.max("t_s").alias("last_seen_s"))


def zone_counts(zones: DataFrame) -> DataFrame:
    """(kind, ord, n) in the order of kinds; other kinds come last."""
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    return zones.groupBy("kind").agg(F.count("*").alias("n")).withColumn("ord", F.when(rank > 0, rank).otherwise(len(KIND_ORDER) + 1)).orderBy("ord", "kind")


def with_defaults(drawn: DataFrame, first: int) -> DataFrame:
    """Zones as drawn (id, rings) with the properties of new ones: numbered labels from ``first`` on in order of id."""
    number = F.row_number().over(Window.orderBy("id")) + (first - 1)
    return drawn.withColumns({"label": F.concat(F.lit("Custom Zone "), number), "kind": F.lit("general"), "visible": F.lit(True), "decorative": F.lit(False)})


def presence_changes(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """(mmsi, seq, zones) of the fixes at which the set of zones around a vessel differs from before."""
    hits = membership(positions, operational(zones)).groupBy("mmsi", "seq").agg(F.sort_array(F.collect_set("zone_id")).alias("zones"))
    fixes = positions.where("lng IS NOT NULL AND lat IS NOT NULL").select("mmsi", "seq", "t_s").join(hits, ["mmsi", "seq"], "left").withColumn("zones", F.coalesce("zones", F.array().cast("array<string>")))
    before = F.coalesce(F.lag("zones").over(Window.partitionBy("mmsi").orderBy("t_s", "seq")), F.array().cast("array<string>"))
    return fixes.withColumn("was", before).where("zones <> was").drop("was", "t_s")


def near(positions: DataFrame, lng: float, lat: float, metres: float) -> DataFrame:
    """Positions within metres of a point; the box in front of the distance reaches the scan."""
    d_lat = metres / 110_000
    d_lng = F.lit(metres / 110_000) / F.cos(F.radians(F.lit(lat)))
    box = F.col("lat").between(lat - d_lat, lat + d_lat) & F.col("lng").between(F.lit(lng) - d_lng, F.lit(lng) + d_lng)
    return positions.where(box & (ais.great_circle_m(F.lit(lng), F.lit(lat), F.col("lng"), F.col("lat")) <= metres))


def nearby_pairs(fixes: DataFrame, metres: float, cell_deg: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, metres) of vessels, a < b, at most metres apart: rows meet in grid cells, one side also in the cells around.

    Cells span cell_deg, or what metres need: latitude is cut in bands, and each band's circle in equal
    cells as wide as metres reach at its end nearer to a pole. They wrap at 180 degrees; at a pole one cell is a band.
    Of two neighbouring bands only the rows of the northern one go to the other.

    Cells of more than block_rows rows are cut by hashes of the ids: on both sides into blocks of about as many, and each block
    of one side meets each of the other in a key of its own. Keys are dealt over as many tasks as the pairs to look at ask for.
    """
    # A trifle more than metres, so that rounding loses no pair.
    angle = metres / 6_371_008.8 * (1 + 1e-9) + 1e-12
    height = max(cell_deg or 0, math.degrees(angle))
    fixes = landed(fixes.where("lng IS NOT NULL AND lat IS NOT NULL").select("mmsi", "lng", "lat"))
    rows = fixes.withColumn("cy", F.floor(F.col("lat") / height))

    def cells(band: Column) -> Column:
        end = F.greatest(F.abs(band * height), F.abs((band + 1) * height))
        reach = F.degrees(F.asin(F.lit(math.sin(angle)) / F.cos(F.radians(end)))) * (1 + 1e-9)
        return F.when(end + math.degrees(angle) >= 90, 1).otherwise(F.greatest(F.floor(360 / F.greatest(reach, F.lit(cell_deg or 0.0))), F.lit(1))).cast("long")

    def cell(band: Column) -> Column:
        return F.floor((F.col("lng") + 180) / 360 * cells(band))

    left = rows.select(F.col("mmsi").alias("a"), F.col("lng").alias("lng_a"), F.col("lat").alias("lat_a"), "cy", F.pmod(cell(F.col("cy")), cells(F.col("cy"))).alias("cx"))
    right = rows.withColumn("south", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("cy", F.col("cy") - F.col("south").cast("int"))
    # Of three cells or fewer in a band, some are the same on both sides.
    around = F.array_distinct(F.array(*(F.pmod(cell(F.col("cy")) + k, cells(F.col("cy"))) for k in (-1, 0, 1))))
    right = right.select(F.col("mmsi").alias("b"), F.col("lng").alias("lng_b"), F.col("lat").alias("lat_b"), "cy", "south", F.explode(around).alias("cx"))

    key = ["cx", "cy"]
    counts = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = landed(counts.groupBy(*key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l > 0"))
    pairs = counts.agg(F.sum(F.col("l").cast("double") * F.col("r"))).first()[0] or 0.0
    tasks = max(1, math.ceil(pairs / TASK_PAIRS), int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # There is no more than a row of it for every block_rows rows.
    crowded = counts.where(F.greatest("l", "r") > block_rows).select(*key, *(F.ceil(F.col(c) / block_rows).alias(c) for c in ("l", "r")))
    left, right = (side.join(F.broadcast(crowded), key, "left").na.fill(1, ["l", "r"]) for side in (left, right))

    def blocked(side: DataFrame, own: str, other: str, id_: str) -> DataFrame:
        """side once for each block of the other side, with ``l`` and ``r`` the numbers of both blocks."""
        block, all_ = F.pmod(F.xxhash64(id_), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return side.withColumn(own, block).withColumn(other, all_).repartition(tasks, *key, "l", "r")

    met = blocked(left, "l", "r", "a").join(blocked(right, "r", "l", "b"), [*key, "l", "r"]).where("a <> b AND (south OR a < b)")
    d = ais.great_circle_m(F.col("lng_a"), F.col("lat_a"), F.col("lng_b"), F.col("lat_b"))
    met = met.withColumn("metres", d).where(F.col("metres") <= metres)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "metres")
