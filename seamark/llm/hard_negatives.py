"""Hard-negative mining by Kronecker-packed products of integer vectors.

Components become floor(scale * x). In a task the components of several candidates are biased to be non-negative and
laid side by side, in separated fields of one wide integer; one multiplication by an anchor's component serves all
of them, and the fields of the sum over components unpack to exact inner products. A wide integer is held in the 53
bits of a double where at least two fields fit, so that the products of a block of anchors are one matrix product;
otherwise it is a Python integer of any width.

Anchors are sent to the tasks in blocks of at most ``block_bytes``, each of which meets every row in two scans: the
first finds its positives, the second the negatives below each positive's score. A task keeps the best few rows of
each anchor, and only those are shuffled.

Defined results: rows with a null id, label or vector, or a component that is null or not finite (scaled, too), take
no part; an anchor without positives gives no rows; shorter vectors count as filled up with zeros; rows that repeat
an id count as one, the least of them by label and vector; scores beyond 64 bits are held at their ends; other
columns are ignored, and an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.llm.common import read, shared_dir

SCALE = 256
POSITIVES = NEGATIVES = 5
PERCENT = 80
BLOCK_BYTES = 8 << 20
TILE = 1024
#: Bits of an integer that a double holds exactly, and fields of a wide integer beyond that.
EXACT_BITS, WIDE_FIELDS = 53, 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def components(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each row, as int64 or, where that is too narrow, Python integers; short rows end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    small = len(flat) == 0 or np.abs(flat).max() < 2**40
    out = np.zeros((len(sizes), max(sizes, default=0)), np.int64 if small else object)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64) if small else [int(x) for x in flat]
    return out


def _as_wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.zeros((len(x), width - x.shape[1]), x.dtype)])


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The exact inner products (anchors x candidates) of integer rows."""
    n, m, d = len(anchors), len(candidates), max(anchors.shape[1], candidates.shape[1])
    if not n or not m or not d:
        return np.zeros((n, m), np.int64)
    anchors, candidates = _as_wide(anchors, d), _as_wide(candidates, d)
    low_a, low_c = min(0, int(anchors.min())), min(0, int(candidates.min()))
    a, c = anchors - low_a, candidates - low_c
    bits = max(1, (d * int(a.max()) * int(c.max())).bit_length())
    fields, kind = EXACT_BITS // bits, np.float64
    if fields < 2:
        fields, kind = WIDE_FIELDS, object
        a, c = a.astype(object), c.astype(object)
    groups = -(-m // fields)
    wide = np.zeros((groups, d), kind)
    for k in range(fields):
        part = c[k::fields]
        wide[: len(part)] += part.astype(kind) * (1 << (bits * k))
    products = a.astype(kind) @ wide.T
    if kind is np.float64:
        products = products.astype(np.int64)
    out = np.zeros((n, groups * fields), products.dtype)
    for k in range(fields):
        out[:, k::fields] = (products >> (bits * k)) & ((1 << bits) - 1)
    exact = out[:, :m] + (low_c * a.sum(1))[:, None] + (low_a * c.sum(1))[None, :] + d * low_a * low_c
    return exact if exact.dtype == np.int64 else np.clip(exact, _LEAST, _MOST).astype(np.int64)


@dataclass
class Best:
    """The best ``k`` (score, id) of each slot; ids in a slot are distinct."""

    scores: list[np.ndarray]
    ids: list[np.ndarray]
    k: int

    @classmethod
    def of(cls, slots: int, k: int) -> Best:
        return cls([np.zeros(0, np.int64)] * slots, [np.zeros(0, np.int64)] * slots, k)

    def least(self) -> np.ndarray:
        """The score that a row needs at least to enter each slot."""
        return np.array([s[-1] if len(s) == self.k else _LEAST for s in self.scores], np.int64)

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            tied = np.flatnonzero(scores == edge)
            if len(tied) > self.k:
                tied = tied[np.argpartition(ids[tied], self.k)[: self.k]]
            take = np.concatenate([np.flatnonzero(scores > edge), tied])
            scores, ids = scores[take], ids[take]
        scores, ids = np.concatenate([self.scores[slot], scores]), np.concatenate([self.ids[slot], ids])
        order = np.lexsort((ids, -1 - scores))[: self.k]
        self.scores[slot], self.ids[slot] = scores[order], ids[order]


@dataclass
class Anchors:
    """A block of anchors: ids, labels and components; in the second scan the positives' ids and scores by anchor."""

    ids: np.ndarray
    labels: np.ndarray
    parts: np.ndarray
    positives: list[list[tuple[int, int]]] | None = None

    def plain(self) -> tuple:
        """What a broadcast holds: executors may not know this class."""
        return self.ids, self.labels, self.parts, self.positives

    def slots(self) -> list[tuple[int, int, int, int]]:
        """(anchor, positive id, least and greatest score of a negative) of the second scan."""
        return [(i, p, -(-s * PERCENT // 100), s) for i, of in enumerate(self.positives or ()) for p, s in of]


def _tiles(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, TILE):
        part = batch.slice(at, TILE)
        yield part.column(0).to_numpy(), part.column(1).to_numpy(), components(part.column(2))


def _positives(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Anchors(*block.value)
        best = Best.of(len(own.ids), k)
        for batch in batches:
            for ids, labels, parts in _tiles(batch):
                least = best.least()
                for at in range(0, len(own.ids), TILE):
                    rows = slice(at, at + TILE)
                    scores = packed_scores(own.parts[rows], parts)
                    fits = (own.labels[rows, None] == labels) & (own.ids[rows, None] != ids) & (scores >= least[rows, None])
                    for i in np.flatnonzero(fits.any(1)):
                        best.add(at + i, scores[i, fits[i]], ids[fits[i]])
        rows = [(own.ids[i], own.ids[i], s, x) for i in range(len(own.ids)) for s, x in zip(best.scores[i], best.ids[i], strict=True)]
        yield from _told(rows)

    return run


def _negatives(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Anchors(*block.value)
        slots = own.slots()
        best = Best.of(len(slots), k)
        at_anchor, low, high = (np.array([s[j] for s in slots], np.int64) for j in (0, 2, 3))
        for batch in batches:
            for ids, labels, parts in _tiles(batch):
                least = np.maximum(low, best.least())
                for at in range(0, len(slots), TILE):
                    part = slice(at, at + TILE)
                    anchors, of = np.unique(at_anchor[part], return_inverse=True)
                    scores = packed_scores(own.parts[anchors], parts)
                    other = own.labels[anchors, None] != labels
                    for j, i in enumerate(of):
                        fits = np.flatnonzero(other[i] & (scores[i] >= least[at + j]) & (scores[i] <= high[at + j]))
                        if len(fits):
                            best.add(at + j, scores[i, fits], ids[fits])
        yield from _told([(own.ids[i], p, s, x) for j, (i, p, _, _) in enumerate(slots) for s, x in zip(best.scores[j], best.ids[j], strict=True)])

    return run


def _told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(4)], ["anchor_id", "slot_id", "score", "id"])


_FOUND = "anchor_id long, slot_id long, score long, id long"


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each anchor and slot, with ``rank``."""
    w = Window.partitionBy("anchor_id", "slot_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, vector) of the rows that take part, one for each id."""
    wide = lambda x: F.abs(x.cast("double") * scale)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(F.forall("vector", lambda x: F.coalesce(wide(x) < float("inf"), F.lit(False))))
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if several.take(1):
        one = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")
        rows = rows.join(several, "id", "left_anti").unionByName(one)
    return rows


def blocks(anchors: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Anchors]:
    """The anchors in blocks of at most block_bytes of components, or of one anchor; one block at the driver at a time."""
    n, width = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return
    most = max(1, block_bytes // (8 * max(1, width)))
    if n <= most:
        cuts = [None]
    else:
        # Many small shares by a hash of the id, joined to blocks by their counts.
        shares = max(1, 16 * n // most)
        counts = sorted(anchors.groupBy(F.pmod(F.xxhash64("id"), F.lit(shares)).alias("s")).count().collect())
        cuts, start, held = [], 0, 0
        for s, c in counts:
            if held and held + c > most:
                cuts.append((start, s))
                start, held = s, 0
            held += c
        cuts.append((start, shares))
    for cut in cuts:
        part = anchors if cut is None else anchors.where((F.pmod(F.xxhash64("id"), F.lit(shares)) >= cut[0]) & (F.pmod(F.xxhash64("id"), F.lit(shares)) < cut[1]))
        rows = part.select("id", "label", "vector").toArrow()
        yield Anchors(rows["id"].to_numpy(), rows["label"].to_numpy(), components(rows["vector"]))


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, vector) of ``usable``.

    Anchors are the rows where is_anchor holds. Positives are an anchor's best other rows of its label; the negatives
    of a positive the best rows of other labels whose score is at most the positive's, and PERCENT of it at least.
    """
    spark = vectors.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = shared_dir(spark)
    rows = vectors.select("id", "label", "vector")
    spark.createDataFrame([], empty).write.parquet(path)
    for block in blocks(rows.where(is_anchor), block_bytes):
        sent = spark.sparkContext.broadcast(block.plain())
        found = _first(rows.mapInArrow(_positives(sent, n_positives), _FOUND), n_positives).select("anchor_id", "id", "score")
        at = {int(x): i for i, x in enumerate(block.ids)}
        block.positives = [[] for _ in at]
        scores = {}
        for a, p, s in sorted(found.collect(), key=lambda r: (r[0], -r[2], r[1])):  # a few rows for each anchor of the block
            block.positives[at[a]].append((p, s))
            scores[a, p] = s
        sent.unpersist()
        sent = spark.sparkContext.broadcast(block.plain())
        below = _first(rows.mapInArrow(_negatives(sent, n_negatives), _FOUND), n_negatives)
        known = spark.createDataFrame([(*k, s) for k, s in scores.items()], "anchor_id long, slot_id long, positive_score long")
        out = below.join(F.broadcast(known), ["anchor_id", "slot_id"])
        out.select("anchor_id", F.col("slot_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(empty).parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS rn FROM s WHERE same) WHERE rn <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rn
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {PERCENT} * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rn AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rn <= {NEGATIVES}
"""
