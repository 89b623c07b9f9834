"""N-gram Jaccard join with signature trees, and the components of its links.

A document's set holds the hashes of its distinct runs of five words. Documents of equal sets are one
representative. ``prefix`` gives each representative that can meet another one its keys: elements of its
set in the order of real document frequencies, rarest first. Representatives that share a key form a group,
and each group is joined by a signature tree: nodes hold OR-combined token bitmaps and size ranges, and a
dual traversal prunes node pairs by the largest overlap that they allow. Pairs that are left are verified on
the sets themselves.

Links only matter for components, so the groups are joined in rounds, and what is linked is contracted
before the next one. In the first round each representative is in two groups at most, of elements that
similar texts most likely agree on, and the trees of a group propose a spanning forest. The second round
takes every key of the prefix, which no link escapes, but only groups whose members are still in different
components, and pairs across components. Large groups are cut into blocks of ``BLOCK`` members, each pair of
blocks in a task of its own.

Defined results: a null text, an empty one or one without words has an empty set and stands alone;
fewer than five words are one element; rows that share a doc_id are one node, whatever their texts; null
ids stand alone; an empty table gives an empty result. Texts are used whole, however long. Only the two
columns that are named are read, so others may have any name; the result has its own three columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import prefix
from seamark.llm import textbytes as tb
from seamark.llm.common import arrow_batches, read, stored, tidy
from seamark.llm.graph import components

SHINGLE = 5
PERCENT = 80
BLOCK = 512
LEAF = 16
#: Of rows that go to Python at once; a task holds a batch twice, and the elements of a part of it.
BATCH_BYTES = 4 << 20
#: Pairs of ids are sent to every task only up to this many ids; beyond that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of all runs of ``size`` words; the whole sequence where there are fewer."""
    low = tb.LOWER[data]
    starts, ends, rows = tb.spans(_WORD[low], offsets)
    h = tb.word_hashes(low, starts, ends)
    full = tb.combine(h, size)
    at = np.flatnonzero(rows[: len(full)] == rows[size - 1 :]) if len(full) else np.zeros(0, np.int64)
    out_rows, out = [rows[at]], [full[at]]
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    for k in range(1, size):
        few = np.flatnonzero(n_words == k)
        if len(few):
            out_rows.append(few)
            out.append(tb.combine(h, k)[first[few]])
    return np.concatenate(out_rows), np.concatenate(out)


def sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each row, its distinct hashes in order)."""
    rows, h = shingles(data, offsets, size)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[new], h[new]
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))]), h


def signatures(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE) -> DataFrame:
    """Per row: id, set size and a 128-bit hash of the set."""

    def sign(batches):
        for b in batches:
            data, at = tb.flat(b.column(1))
            for i, j in tb.pieces(at, prefix.PIECE):
                bounds, h = sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(tb.splitmix(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (0, 0x5DEECE66D)]
                signs = [pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums]
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), *signs], ["doc_id", "n", "s1", "s2"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return rows.mapInArrow(tidy(sign), "doc_id long, n long, s1 long, s2 long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole groups of equal first column; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
        if held and (key[0] != held[-1].column(0)[-1].as_py() or last > 0):
            cut = 0 if key[0] != held[-1].column(0)[-1].as_py() else int((key != key[0]).argmax())
            yield pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held)
            held = []
            if last > cut:
                yield pa.Table.from_batches([b.slice(cut, last - cut)])
            b = b.slice(max(cut, last))
        elif last > 0:
            yield pa.Table.from_batches([b.slice(0, last)])
            b = b.slice(last)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


class SignatureTree:
    """A binary tree over sets: per node the OR of bitmaps, the size range, the most tokens per bit and the components."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        """n: set sizes; bits: packed bitmaps; comp: component of each set, to pass over pairs that are linked."""
        self.order = np.lexsort((bits[:, 1], bits[:, 0], n))
        size = 1
        while size * LEAF < len(n):
            size *= 2
        at = np.minimum(np.arange(size * LEAF), len(n) - 1)
        n, bits, comp = n[self.order], bits[self.order], comp[self.order]
        spare = n - np.bitwise_count(bits).sum(1)
        self.n, self.bits, self.comp, self.spare = n, bits, comp, spare
        level = (
            np.bitwise_or.reduce(bits[at].reshape(size, LEAF, -1), 1),
            n[at].reshape(size, LEAF).min(1), n[at].reshape(size, LEAF).max(1), spare[at].reshape(size, LEAF).max(1),
            comp[at].reshape(size, LEAF).min(1), comp[at].reshape(size, LEAF).max(1),
        )
        self.levels = [level]
        while len(level[0]) > 1:
            o, lo, hi, sp, c0, c1 = level
            level = (o[::2] | o[1::2], np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), np.maximum(sp[::2], sp[1::2]), np.minimum(c0[::2], c0[1::2]), np.maximum(c1[::2], c1[1::2]))
            self.levels.append(level)
        self.levels.reverse()

    @staticmethod
    def may(a, i, b, j, percent: int) -> np.ndarray:
        """Whether node pairs can hold a pair that reaches the threshold and isn't linked yet."""
        overlap = np.bitwise_count(a[0][i] & b[0][j]).sum(1) + np.minimum(a[3][i], b[3][j])
        overlap = np.minimum(overlap, np.minimum(a[2][i], b[2][j]))
        need = percent * (a[1][i] + b[1][j])
        sizes = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
        linked = (a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j])
        return sizes & ((100 + percent) * overlap >= need) & ~linked

    def join(self, other: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own index, other's index, bound of the similarity) of pairs that no bound rules out."""
        same = self is other
        i = j = np.zeros(1, np.int64)
        depth = max(len(self.levels), len(other.levels))
        for d in range(depth):
            a, b = self.levels[min(d, len(self.levels) - 1)], other.levels[min(d, len(other.levels) - 1)]
            if d:
                grow_a, grow_b = d < len(self.levels), d < len(other.levels)
                kids_i = [2 * i, 2 * i + 1] if grow_a else [i]
                pairs = [(x, y) for x in kids_i for y in ([2 * j, 2 * j + 1] if grow_b else [j])]
                i, j = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
                if same:
                    i, j = i[i <= j], j[i <= j]
            ok = self.may(a, i, b, j, percent)
            i, j = i[ok], j[ok]
        step = np.arange(LEAF)
        i = (i[:, None, None] * LEAF + step[None, :, None] + np.zeros((1, 1, LEAF), np.int64)).ravel()
        j = (j[:, None, None] * LEAF + step[None, None, :] + np.zeros((1, LEAF, 1), np.int64)).ravel()
        ok = (i < len(self.n)) & (j < len(other.n)) & ((i < j) | (not same))
        i, j = i[ok], j[ok]
        leaf = lambda t: (t.bits, t.n, t.n, t.spare, t.comp, t.comp)
        parts = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = self.may(leaf(self), x, leaf(other), y, percent)
            x, y = x[ok], y[ok]
            share = np.bitwise_count(self.bits[x] & other.bits[y]).sum(1) + np.minimum(self.spare[x], other.spare[y])
            parts.append((x, y, share / np.maximum(self.n[x] + other.n[y] - share, 1)))
        i, j, bound = (np.concatenate(p) for p in zip(*parts, strict=True))
        return self.order[i], other.order[j], bound


def _forest(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Indexes of the pairs of a spanning forest: those of the most central member first, then the likeliest.

    Groups that share most of their members so propose the same pairs.
    """
    if len(a) == 0:
        return np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    centre = nodes[np.bincount(at, weights=np.concatenate([bound, bound])).argmax()]
    bound = bound + ((a == centre) | (b == centre))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    kept = []
    for k in np.argsort(-bound, kind="stable"):
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _by_short(n: np.ndarray, short: np.ndarray, i: np.ndarray, m: np.ndarray, other: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the key can be the first common one of a pair: it is in the short prefix of the smaller set."""
    return ((n[i] > m[j]) | short[i]) & ((m[j] > n[i]) | other[j])


def _tree_pairs(members: DataFrame, bitmaps: DataFrame, spanning: bool, percent: int) -> DataFrame:
    """Distinct (a, b), a < b: pairs of each group that its signature tree doesn't rule out.

    members: (task, side, rep, comp, short); bitmaps: (rep, n, bitmap). Sides 0 and 1 are compared with each other, side 2 with itself.
    """

    def bitmaps_of(t, at):
        """Equally wide bitmaps of some rows, as words."""
        return np.stack([np.frombuffer(t[k].as_buffer(), np.uint64) for k in at])

    def join(batches):
        for t in _runs(batches):
            task, side, rep, n, comp, short = (t.column(c).to_numpy() for c in ("task", "side", "rep", "n", "comp", "short"))
            bitmap, width = t.column("bitmap"), prefix.width(n)
            edge = np.append(np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])), len(task))
            out = [np.zeros((0, 2), np.int64)]
            twos = edge[:-1][(np.diff(edge) == 2)]
            twos = twos[(side[twos] == 2) & (side[twos + 1] == 2) & (width[twos] == width[twos + 1])]
            done = set(twos.tolist())
            for w in np.unique(width[twos]):  # trees of one leaf with one pair
                at = twos[width[twos] == w]
                both = np.stack([at, at + 1], 1).ravel()
                bits = bitmaps_of(bitmap, both)
                leaf = (bits, n[both], n[both], n[both] - np.bitwise_count(bits).sum(1), comp[both], comp[both])
                k = np.arange(0, len(both), 2)
                k = k[SignatureTree.may(leaf, k, leaf, k + 1, percent) & _by_short(n[both], short[both], k, n[both], short[both], k + 1)]
                out.append(np.stack([rep[both[k]], rep[both[k + 1]]], 1))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if e - s < 2 or s in done:
                    continue
                own = []
                by = {}  # trees of the sides, by width; sets of unlike width can only link with the next width
                for k in (0, 1, 2):
                    for w in np.unique(width[s:e][side[s:e] == k]):
                        at = s + np.flatnonzero((side[s:e] == k) & (width[s:e] == w))
                        by[k, int(w)] = at, bitmaps_of(bitmap, at)

                def tree(k, w, to):
                    at, bits = by[k, w]
                    while bits.shape[1] * 64 > to:  # noqa: B023
                        half = bits.shape[1] // 2
                        bits = bits[:, :half] | bits[:, half:]
                    return SignatureTree(n[at], bits, comp[at])  # noqa: B023

                for (x, w), (at, _) in by.items():
                    for v in (w // 2, w, 2 * w):
                        y = 2 if x == 2 else 1
                        if x == 1 or (y, v) not in by or (x == 2 and v < w):
                            continue
                        first = tree(x, w, min(v, w))
                        i, j, bound = first.join(first if (x, w) == (y, v) else tree(y, v, min(v, w)), percent)
                        to = by[y, v][0]
                        ok = _by_short(n[at], short[at], i, n[to], short[to], j)
                        own.append((rep[at][i[ok]], rep[to][j[ok]], bound[ok]))
                if own:
                    a, b, bound = (np.concatenate(p) for p in zip(*own, strict=True))
                    out.append(np.stack([a, b], 1)[_forest(a, b, bound) if spanning else slice(None)])
            pairs = np.concatenate(out)
            pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = members.join(bitmaps, "rep").select("task", "side", "rep", "n", "bitmap", "comp", "short").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(tidy(join), "a long, b long").distinct()


def _with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows joined with ids on ``id``; ids is sent to every task while it is small."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; texts: (id, text).

    The texts of all partners of one document meet it in a task, ``BLOCK`` of them at most; they travel
    as texts, which are smaller than their sets.
    """
    pairs = stored(pairs)
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / BLOCK))
    salted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("c")), "a").withColumn("task", F.xxhash64("a", salt))
    roles = stored(salted.select(F.col("b").alias("id"), "task", F.lit(1).alias("side")).union(salted.select(F.col("a").alias("id"), "task", F.lit(0).alias("side")).distinct()))

    def check(batches):
        task, firsts = None, []
        for b in batches:
            data, at = tb.flat(b.column(3))
            a_out, b_out = [], []
            meta = [b.column(k).to_pylist() for k in range(3)]
            for i, j in tb.pieces(at, prefix.PIECE):
                bounds, h = sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                for k in range(i, j):
                    own = h[bounds[k - i] : bounds[k - i + 1]]
                    if meta[0][k] != task:
                        task, firsts = meta[0][k], []
                    if meta[1][k] == 0:
                        firsts.append((meta[2][k], own.copy()))
                        continue
                    for first, other in firsts:
                        spot = np.searchsorted(other, own)
                        both = int((other[np.minimum(spot, len(other) - 1)] == own).sum()) if len(own) and len(other) else 0
                        if both and 100 * both >= percent * (len(own) + len(other) - both):
                            a_out.append(first)
                            b_out.append(meta[2][k])
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    met = _with_ids(texts, roles, "inner").select("task", "side", "id", "text").repartition("task").sortWithinPartitions("task", "side")
    return met.mapInArrow(tidy(check), "a long, b long").distinct()


COLS = ("task", "side", "rep", "comp")


def _joined(groups: DataFrame, profiles: DataFrame, comp: DataFrame | None, spanning: bool, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that the trees of groups (gid, rep, short) don't rule out; comp: (node, component) so far.

    Members of a group's largest component meet the others only. spanning: a forest of each task's pairs, from
    every block with itself and with block 0; otherwise all pairs of blocks.
    """
    known = groups.withColumn("comp", F.col("rep"))
    if comp is not None:
        known = groups.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    # Groups of one component only have nothing to add, and of groups of equal members one is enough.
    own = F.xxhash64("rep", "short")
    span = known.groupBy("gid").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("c"), F.bit_xor(own).alias("x"), F.sum(F.pmod(own, F.lit((1 << 31) - 1))).alias("y")).where("c0 < c1")
    once = span.groupBy("lo", "hi", "c", "x", "y").agg(F.min("gid").alias("gid")).select("gid")
    members = stored(known.join(once, "gid"))
    sizes = members.groupBy("gid", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("gid").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("g")).select("gid", F.when(F.col("top.c") > 1, F.col("top.comp")).alias("top"), (F.col("g") - F.when(F.col("top.c") > 1, F.col("top.c")).otherwise(0)).alias("strays"), F.when(F.col("top.c") > 1, F.col("top.c")).otherwise(0).alias("mains"))
    rest = members.join(main, "gid").withColumns({"ns": F.ceil(F.col("strays") / BLOCK), "nm": F.ceil(F.col("mains") / BLOCK)})
    stray = rest.where("NOT comp <=> top").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("ns")))
    major = rest.where("comp <=> top").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nm")))
    cols, zero = [*COLS, "short"], F.lit(0).cast("long")
    if spanning:
        alone = stray.withColumns({"task": F.xxhash64("gid", "block"), "side": F.lit(2)})
        others = stray.where("block > 0").withColumns({"p": F.col("block"), "side": F.lit(1)})
        firsts = stray.where("block = 0 AND ns > 1").withColumn("p", F.explode(F.sequence(F.lit(1).cast("long"), F.col("ns") - 1))).withColumn("side", F.lit(0))
        s_s = alone.select(cols).union(others.unionByName(firsts).withColumn("task", F.xxhash64("gid", F.lit("first"), "p")).select(cols))
    else:
        # Two tasks for each pair of stray blocks would be one too many: the lower block is side 0.
        s_s = stray.withColumn("p", F.explode(F.sequence(zero, F.col("ns") - 1))).withColumns({"task": F.xxhash64("gid", F.lit("ss"), F.least("block", "p"), F.greatest("block", "p")), "side": F.when(F.col("block") == F.col("p"), 2).when(F.col("block") < F.col("p"), 0).otherwise(1)}).select(cols)
    s_m = stray.where("nm > 0").withColumn("p", F.explode(F.sequence(zero, F.col("nm") - 1))).withColumns({"task": F.xxhash64("gid", F.lit("sm"), "block", "p"), "side": F.lit(0)})
    m_s = major.withColumn("p", F.explode(F.sequence(zero, F.col("ns") - 1))).withColumns({"task": F.xxhash64("gid", F.lit("sm"), "p", "block"), "side": F.lit(1)})
    return _tree_pairs(s_s.union(s_m.select(cols)).union(m_s.select(cols)), profiles.select("rep", "n", "bitmap"), spanning, percent)


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids with signatures, representatives of equal sets, components of the ids that have links)."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _links(docs, doc_id, text, size, percent)


def _links(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    sign = ["n", "s1", "s2"]
    signed = stored(signatures(docs, doc_id, text, size))
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    reps = stored(some.groupBy(*sign).agg(F.min("doc_id").alias("rep")))
    # Ids of several rows: their sets are one node, and their equal rows one text.
    several = stored(some.groupBy("doc_id").agg(F.count("*").alias("c"), (F.min(F.struct(*sign)) < F.max(F.struct(*sign))).alias("mixed")).where("c > 1"))
    mixed = some.join(several.where("mixed").select("doc_id"), "doc_id", "left_semi").join(reps, sign).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    if several.take(1):
        repeated = several.select(F.col("doc_id").alias("id"))
        again = _with_ids(texts, repeated, "left_semi").groupBy("id", F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text")).drop("h")
        texts = _with_ids(texts, repeated, "left_anti").unionByName(again)
    copies = some.select(F.col("doc_id").alias("id")).distinct().join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")

    total = reps.agg(F.sum("n")).first()[0] or 0
    firsts = _with_ids(texts, stored(copies), "left_anti")
    found = prefix.profiles(firsts, lambda data, at: sets(data, at, size), total, percent)
    comp = stored(components(mixed)) if several.where("mixed").take(1) else None
    likely = found.select(F.explode(F.array_distinct("groups")).alias("gid"), "rep", F.lit(True).alias("short"))
    comp = _contracted(comp, _verified(_joined(likely, found, comp, True, percent), texts, size, percent))
    every = found.select("rep", F.explode(F.arrays_zip("keys", "short")).alias("key")).select(F.col("key.keys").alias("gid"), "rep", F.col("key.short").alias("short"))
    return signed, reps, _contracted(comp, _verified(_joined(every, found, comp, False, percent), texts, size, percent))


def _contracted(comp: DataFrame | None, more: DataFrame) -> DataFrame:
    """The components so far, joined by the links ``more``."""
    stars = more if comp is None else more.union(comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stored(components(stars))


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    signed, reps, comp = links(docs, doc_id, text, size, percent)
    named = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return signed.where("n > 0 AND doc_id IS NOT NULL").join(named, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: of its smallest id, and of several rows of that id the least by a hash.

    Rows without words stay, as they are linked with nothing, and so do rows without an id.
    """
    found = stored(join_components(docs, doc_id, text).where("n_shingles > 0 AND doc_id IS NOT NULL"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    several = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("c")).where("c > 1").select("id")
    free = F.col(doc_id).cast("long").isNull() | ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~free).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    rows = _with_ids(rows, stored(gone), "left_anti")
    several = stored(several)
    if several.take(1):
        one = _with_ids(rows, several, "left_semi").groupBy("id").agg(F.min_by("row", "h").alias("row"))
        rows = _with_ids(rows, several, "left_anti").select("row").unionByName(one.select("row"))
    return rows.select("row.*").unionByName(docs.where(free))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
