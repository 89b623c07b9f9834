"""Exact removal of repeated passages with suffix arrays over shards.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is removed. Each string of
that length belongs to one anchor: its first ``GRAM``-byte run of least hash, which depends on its bytes
alone. So two equal strings meet at equal anchors, at equal distance from them. The strings of one anchor
in a text follow one another; the bytes they cover are its segment. Equal segments count once, with how
often they occur. Where an anchor has different segments, those that can't share a string (no common core
with another) are put aside, and the suffix array of the rest of the shard, built by induced sorting, and
its permuted common prefixes tell which strings repeat. Removed spans go back to all occurrences.

An anchor with more than ``CAP`` different segments (a passage in a large part of all documents, each with
a text of its own before it) doesn't fit one shard. Its segments are solved again in the same way with
finer units: ``CELL`` neighbouring strings that share their core, and beyond the cap single strings, which
need counting only.

Defined results: null and empty texts have no bytes; a text shorter than ``LENGTH`` keeps all; equal rows
repeat one another; all columns but id and text are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import read, stored
from seamark.llm.jaccard_join import _runs
from seamark.llm.suffix_array import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 32
CELL = 32
CAP = 2048
SHARD = 1 << 20
#: Ids of the documents concerned are sent to every task only up to this many; beyond that by a shuffle.
BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOL = tb.table(256, 7)


class Rolling:
    """Hashes of any byte ranges, after one pass."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * tb.powers(n, _BASE), out=self.sums[1:])
        self.back = tb.powers(n + 1, _INVERSE)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tb.splitmix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def _sliding(x: np.ndarray, w: int, best, neutral) -> np.ndarray:
    """best over x[i : i + w] for every i up to len(x) - w."""
    n = len(x)
    rows = -(-n // w)
    grid = np.full(rows * w, neutral, x.dtype)
    grid[:n] = x
    grid = grid.reshape(rows, w)
    ahead = best.accumulate(grid, axis=1).ravel()
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Units of level 0: (rows, anchor positions, bytes before the anchor, strings, anchor hashes, segment hashes)."""
    n, w = len(data), length - gram + 1
    if n < length:
        return _no_units()
    roll = Rolling(data)
    at = np.arange(n - gram + 1)
    h = roll.of(at, at + gram)
    # 33 bits of the hash above the position: ties go to the first. Both follow from a string's bytes alone.
    least = _sliding(h >> np.uint64(31) << np.uint64(31) | at.astype(np.uint64), w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    inside = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    inside[offsets[long]] += 1
    inside[offsets[long + 1] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    if not len(starts):
        return _no_units()
    p = (least[starts] & np.uint64(0x7FFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (np.diff(starts) > 1)]))
    first, count, p = starts[new], np.diff(np.append(new, len(starts))), p[new]
    row = np.searchsorted(offsets, p, "right") - 1
    seg = tb.splitmix(roll.of(first, first + count + length - 1) + _shape(p - first, count))
    return row, p - offsets[row], p - first, count, h[p], seg


def cells(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, before: np.ndarray, length: int, cell: int):
    """Units of the next levels: the strings of a segment in cells by their distance from its anchor; cell 1: single strings."""
    size = np.diff(offsets)
    lo_cell, hi_cell = -before // cell, (size - length - before) // cell
    n = np.maximum(hi_cell - lo_cell + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    at = lo_cell[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = np.maximum(at * cell + before[row], 0)
    last = np.minimum(at * cell + cell - 1 + before[row], size[row] - length)
    core = at * cell + cell - 1 + before[row]  # where the core starts: in every string of the cell
    roll, base = Rolling(data), offsets[row]
    h = tb.splitmix(roll.of(base + core, base + core + length - cell + 1) + group[row] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seg = tb.splitmix(roll.of(base + first, base + last + length) + _shape(core - first, last - first + 1)) if cell > 1 else np.zeros(len(row), np.uint64)
    return row, core, core - first, last - first + 1, h, seg


def _no_units():
    none = np.zeros(0, np.int64)
    return none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _shape(before: np.ndarray, count: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + count.astype(np.uint64)


def _cover(starts: np.ndarray, length: int) -> list[int]:
    """Merged [start, end) ranges of the strings that begin at sorted ``starts``, one after the other."""
    if len(starts) == 0:
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length], 1).ravel().tolist()


def _may_repeat(groups: np.ndarray, before: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, cell: int = 16) -> np.ndarray:
    """Segments of which some ``cell`` neighbouring strings share their core with another segment of the group."""
    row, _, _, _, h, _ = cells(data, offsets, groups, before, length, cell)
    _, at, n = np.unique(h, return_inverse=True, return_counts=True)
    return np.bincount(row, n[at] > 1, len(groups)) > 0


def shard_repeats(groups: np.ndarray, before: np.ndarray, segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the sorted offsets of its strings that another segment of its group has as well.

    Only strings that stand alike to their anchors count (``before``: bytes before it): segments of a
    periodic text overlap, and would otherwise show one place as two.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
    data, at = tb.flat(pa.array(segments, pa.binary()))
    some = np.flatnonzero(_may_repeat(tb.splitmix(groups), before, data, at, length))
    if not len(some):
        return out
    groups, before = groups[some], before[some]
    data, at = tb.flat(pa.array([segments[k] for k in some], pa.binary()))
    n = np.diff(at)
    s = np.ones(len(data) + len(some) + 1, np.int64)  # 1 ends a segment, 0 the shard
    s[-1] = 0
    s[np.arange(len(data)) + np.repeat(np.arange(len(some)), n)] = data.astype(np.int64) + 2
    sa = suffix_array(s, 258)
    shared = permuted_lcp(s, sa)[sa] >= length
    whole = np.flatnonzero(shared | np.append(shared[1:], False))
    run, place = np.cumsum(~shared)[whole], sa[whole]
    own = np.searchsorted(at[1:] + np.arange(1, len(some) + 1), place, "right")
    inside = np.flatnonzero(own < len(some))
    run, place, own = run[inside], place[inside], own[inside]
    offset = place - (at[:-1] + np.arange(len(some)))[own]
    inside = np.flatnonzero(offset + length <= n[own])
    run, own, offset = run[inside], own[inside], offset[inside]
    aligned = offset - before[own]
    order = np.lexsort((aligned, groups[own], run))
    key = np.stack([run[order], groups[own[order]].astype(np.int64), aligned[order]], 1)
    new = np.ones(len(order) + 1, bool)
    if len(order):
        new[1:-1] = (key[1:] != key[:-1]).any(1)
    again = order[~(new[:-1] & new[1:])]
    again = again[np.lexsort((offset[again], own[again]))]
    cut = np.searchsorted(own[again], np.arange(len(some) + 1))
    for k in np.unique(own[again]):
        out[some[k]] = offset[again[cut[k] : cut[k + 1]]]
    return out


def _near(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs that have one of ``ids`` (key)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "key", "left_semi")


def _units(texts: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """(h, seg, key, at) of every unit of texts (key, text, h, before); at packs position, bytes before and strings."""

    def find(batches):
        for b in batches:
            data, at = tb.flat(b.column(1))
            for i, j in tb.pieces(at):
                part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                if level == 0:
                    row, p, before, count, h, seg = anchors(part, own, length, gram)
                else:
                    group, given = (b.column(c).to_numpy(zero_copy_only=False)[i:j] for c in (2, 3))
                    row, p, before, count, h, seg = cells(part, own, group.view(np.uint64), given, length, CELL if level == 1 else 1)
                packed = p << 16 | before << 8 | (count - 1)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), b.column(0).take(pa.array(row + i)), pa.array(packed)], ["h", "seg", "key", "at"])

    return texts.select("key", "text", "h", "before").mapInArrow(find, "h long, seg long, key long, at long")


def _segment_bytes(texts: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """(h, seg, d, before, text) of the needed segments: each with the bytes before its anchor."""
    wanted = need.groupBy("key").agg(F.collect_list(F.struct("at", "h", "seg", "d")).alias("spots"))

    def cut(batches):
        for b in batches:
            out = []
            for text, spots in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                view = memoryview(text.as_buffer())
                for x in spots:
                    before = x["at"] >> 8 & 255
                    start = (x["at"] >> 16) - before
                    out.append((x["h"], x["seg"], x["d"], before, bytes(view[start : start + (x["at"] & 255) + length])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["h", "seg", "d", "before", "text"])

    near = _near(texts, wanted.select("key"))
    return near.join(wanted.hint("shuffle_hash"), "key").select("text", "spots").mapInArrow(cut, "h long, seg long, d long, before long, text binary")


def _by_suffix_array(segments: DataFrame, length: int) -> DataFrame:
    """(h, seg, ranges): what repeats in each segment, relative to its anchor."""

    def solve(batches):
        held, size = [], 0

        def flush():
            t = pa.concat_tables(held)
            h, seg, before = (t.column(c).to_numpy() for c in ("h", "seg", "before"))
            _, once = np.unique(np.stack([h, seg], 1), axis=0, return_index=True)
            own = t.column("text").take(pa.array(once)).to_pylist()
            _, group = np.unique(h[once], return_inverse=True)
            found = shard_repeats(group, before[once], own, length)
            kept = [k for k, v in enumerate(found) if len(v)]
            ranges = [_cover(found[k] - before[once[k]], length) for k in kept]
            return pa.record_batch([pa.array(h[once[kept]]), pa.array(seg[once[kept]]), pa.array(ranges, pa.list_(pa.int64()))], ["h", "seg", "ranges"])

        for t in _runs(batches):
            h = t.column("h").to_numpy()
            edge = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            _, at = tb.flat(t.column("text"))
            start = 0
            for k in range(1, len(edge)):
                if size + at[edge[k]] - at[edge[start]] >= SHARD or k == len(edge) - 1:
                    held.append(t.slice(edge[start], edge[k] - edge[start]))
                    size += at[edge[k]] - at[edge[start]]
                    start = k
                    if size >= SHARD:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    rows = segments.select("h", "seg", "before", "text").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(solve, "h long, seg long, ranges array<long>")


def _solve(texts: DataFrame, length: int, gram: int, cap: int, level: int = 0) -> DataFrame:
    """(key, cover) of texts (key, text, h, before): units with what of them repeats, whole or in ranges from the anchor."""
    posts = _units(texts, level, length, gram)
    shared = posts.groupBy("h").agg(F.count("*").alias("c"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("c > 1")
    occ = stored(posts.join(shared.select("h", (F.col("lo") < F.col("hi")).alias("differ")), "h"))
    none = F.lit(None).cast("array<long>")
    cover = occ.where("NOT differ").select("key", "at", F.lit(True).alias("full"), none.alias("ranges"))
    if level < 2:  # single strings of one hash never differ
        segs = stored(occ.where("differ").groupBy("h", "seg").agg(F.count("*").alias("c"), F.min(F.struct("key", "at")).alias("one")))
        need = segs.join(segs.groupBy("h").agg(F.count("*").alias("d")), "h").select("h", "seg", "d", "one.key", "one.at")
        own = stored(_segment_bytes(texts, need, length))
        found = _by_suffix_array(own.where(F.col("d") <= cap), length)
        large = own.where(F.col("d") > cap)
        if not large.isEmpty():
            large = large.dropDuplicates(["h", "seg"]).withColumn("key", F.xxhash64("h", "seg"))
            inner = _solve(large, length, gram, cap, level + 1)
            found = found.union(_ranges(large.join(inner, "key"), length))
        state = segs.select("h", "seg", (F.col("c") > 1).alias("full")).join(found, ["h", "seg"], "left").where("full OR ranges IS NOT NULL")
        cover = cover.union(occ.where("differ").join(state, ["h", "seg"]).select("key", "at", "full", F.when(~F.col("full"), F.col("ranges"))))
    return stored(cover.distinct().groupBy("key").agg(F.collect_list(F.struct("at", "full", "ranges")).alias("cover")))


def _ranges(rows: DataFrame, length: int) -> DataFrame:
    """(h, seg, ranges) from the anchor of segments (h, seg, before, text, cover)."""

    def merge(batches):
        for b in batches:
            out = []
            for before, size, cover in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                s, e, _ = tb.spans(_mask(size, cover, length), np.array([0, size]))
                out.append((np.stack([s, e], 1) - before).ravel().tolist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["h", "seg", "ranges"])

    return rows.select("h", "seg", "before", F.octet_length("text").alias("size"), "cover").mapInArrow(merge, "h long, seg long, ranges array<long>")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(docs with a ``__key``, (key, cover)): the units of each text with what repeats in them."""
    rows = docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.col(text)))
    zero = F.lit(0).cast("long")
    texts = rows.where(F.octet_length(F.col(text)) >= length).select(F.col("__key").alias("key"), F.col(text).cast("string").alias("text"), zero.alias("h"), zero.alias("before"))
    return rows, _solve(texts, length, gram, cap)


def _mask(n: int, cover: list[dict], length: int) -> np.ndarray:
    """Which of n bytes repeat."""
    edge = np.zeros(n + 1, np.int64)
    for x in cover:
        p, before, count = x["at"] >> 16, x["at"] >> 8 & 255, (x["at"] & 255) + 1
        if x["full"]:
            edge[p - before] += 1
            edge[p - before + count + length - 1] -= 1
        else:
            r = np.array(x["ranges"]) + p
            np.add.at(edge, r[::2], 1)
            np.add.at(edge, r[1::2], -1)
    return np.cumsum(edge)[:-1] > 0


_KIND = pa.struct([("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """docs with ``repeats``: the bytes kept, and the removed spans in bytes."""
    rows, cover = repeated(docs, doc_id, text, length, gram, cap)
    cover = cover.select(F.col("key").alias("__key"), F.col("cover").alias("__cover"))

    @F.arrow_udf("struct<kept: binary, spans: array<struct<start: bigint, end: bigint>>>")
    def cut(texts: pa.Array, covers: pa.Array) -> pa.Array:
        data, at = tb.flat(texts)
        out = []
        for i, c in enumerate(covers.to_pylist()):
            part = data[at[i] : at[i + 1]]
            gone = _mask(len(part), c, length)
            s, e, _ = tb.spans(gone, np.array([0, len(part)]))
            out.append({"kept": part[~gone].tobytes(), "spans": [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)]})
        return pa.array(out, _KIND)

    ids = cover.select("__key")
    small = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if small else ids
    touched = rows.join(ids, "__key", "left_semi").join(cover.hint("shuffle_hash"), "__key")
    touched = touched.withColumn("repeats", cut(F.col(text).cast("string"), "__cover")).drop("__cover", "__key")
    same = F.struct(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("kept"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))
    return rows.join(ids, "__key", "left_anti").withColumn("repeats", same).drop("__key").unionByName(touched)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes, kept = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.col("repeats.kept")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length(kept)).cast("long").alias("n_removed"), F.size("repeats.spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))
