"""Prefix keys of sets of word runs, in the order of real document frequencies.

Two sets can reach similarity t only if they share one of the first n - ceil(t n) + 1 elements of each in
any common order. The order here is the number of texts that hold an element, then the element, so that
elements of one text come first (they meet nothing and cost nothing) and common passages last.

Texts travel in chunks of about ``CHUNK_BYTES``. A chunk sends each of its elements once, with the number of
its texts that hold it, to the task of the element's range; that task adds the numbers up and sends the sums
of elements with two texts or more back to the chunk, where the texts choose their keys. An element of every
text so costs one entry a chunk, and no task more than its range. An element is the upper 48 bits of a hash;
a false meeting only makes a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import dropped, stored, stored_at, tidy

#: Less than the half of a region of a small heap, beyond which the JVM keeps an array apart.
CHUNK_BYTES = 384 << 10
#: Bytes of text of which a task holds the elements at once; the arrays for a byte take some fifty times its room.
PIECE = 1 << 19
#: Elements that a task adds up, about.
TASK_ELEMENTS = 1_000_000
#: A bitmap has four to eight bits for each element, a power of two in all.
LEAST_BITS = 256
#: Of the hashes by which a text chooses its first groups.
SEEDS = (0, 0x5DEECE66D)

Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n elements."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(4 * n, 2))).astype(np.int64))


def bitmaps(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The bitmap of each row's elements."""
    out: list[bytes] = [b""] * len(n)
    wide = width(n)
    for w in np.unique(wide):
        own = np.flatnonzero(wide == w)
        spot = np.full(len(n), -1)
        spot[own] = np.arange(len(own))
        at = np.flatnonzero(spot[row] >= 0)
        bits = np.zeros((len(own), w), bool)
        bits[spot[row[at]], ((h[at] >> np.uint64(20)) & np.uint64(w - 1)).astype(np.int64)] = True
        for k, v in zip(own, np.packbits(bits, axis=1), strict=True):
            out[k] = v.tobytes()
    return out


def _packed(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys of 48 bits and counts, field by field, which compresses well."""
    return key.astype(np.uint32).tobytes() + (key >> np.uint64(32)).astype(np.uint16).tobytes() + np.minimum(count, 65535).astype(np.uint16).tobytes()


def _unpacked(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n = blob.size // 8
    key = np.frombuffer(blob, np.uint32, n).astype(np.uint64) | (np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))
    return key, np.frombuffer(blob, np.uint16, n, 6 * n)


def _chunked(texts: DataFrame) -> DataFrame:
    """texts (id, text) in rows of many: the ids, the ends of the texts and their bytes."""

    def pack(batches):
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            data, at = tb.flat(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tb.pieces(at, CHUNK_BYTES):
                yield pa.record_batch([pa.array([made], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids[i:j], at[i : j + 1] - at[i], data[at[i] : at[j]]))], ["chunk", "ids", "at", "data"])
                made += 1

    return texts.mapInArrow(tidy(pack), "chunk long, ids binary, at binary, data binary")


def _counted(sent: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, elements): the elements of each chunk that two texts or more hold, with their numbers of texts."""

    def count(batches):
        # The sums of a part need all its pieces; the parts of a task come one after the other.
        part, chunk, got = None, [], []
        for b in batches:
            for k in range(b.num_rows):
                if (p := b.column(1)[k].as_py()) != part:
                    if got:
                        yield _summed(part, chunk, got)
                    part, chunk, got = p, [], []
                chunk.append(b.column(0)[k].as_py())
                got.append(_unpacked(b.column(2)[k].as_buffer()))
        if got:
            yield _summed(part, chunk, got)

    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(count), "chunk long, part int, elements binary")


def _summed(part: int, chunk: list[int], got: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """What goes back to each chunk of a part: its elements of two texts or more, with their numbers of texts."""
    key = np.concatenate([k for k, _ in got])
    source = np.repeat(np.arange(len(got), dtype=np.int32), [len(k) for k, _ in got])
    order = np.argsort(key, kind="stable")
    key, source = key[order], source[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.add.reduceat(np.concatenate([c for _, c in got])[order], first, dtype=np.int64)
    times = np.diff(np.append(first, len(key)))
    keep = np.flatnonzero(np.repeat(total > 1, times))
    key, source, total = key[keep], source[keep], np.repeat(total, times)[keep]
    order = np.argsort(source, kind="stable")
    key, source, total = key[order], source[order], total[order]
    cut = np.searchsorted(source, np.arange(len(got) + 1))
    full = np.flatnonzero(np.diff(cut))
    blobs = [_packed(key[cut[k] : cut[k + 1]], total[cut[k] : cut[k + 1]]) for k in full]
    return pa.record_batch([pa.array([chunk[k] for k in full], pa.int64()), pa.array([part] * len(full), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "elements"])


def profiles(texts: DataFrame, sets: Sets, total: int, percent: int) -> DataFrame:
    """(rep, n, bitmap, groups, keys, short) of the texts that can meet another one at all, stored.

    texts: (id, text), one row for each different set; sets: of the bytes and bounds of texts, gives the
    bounds of each text's elements and the elements; total: about how many elements all texts have.
    groups: for each of SEEDS one element that similar texts share most likely. keys: the prefix, without
    elements of one text. short: whether each key is in the prefix that the smaller of a pair needs.
    """
    parts = int(max(1, -(-total // TASK_ELEMENTS)))
    chunks, path = stored_at(_chunked(texts))

    def own_sets(at: pa.Buffer, data: pa.Buffer):
        ends, every = np.frombuffer(at, np.int64), np.frombuffer(data, np.uint8)
        for i, j in tb.pieces(ends, PIECE):
            bounds, h = sets(every[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            yield i, j, bounds, h

    def send(batches):
        for b in batches:
            for r in range(b.num_rows):
                chunk, at, data = b.column(0)[r].as_py(), b.column(1)[r].as_buffer(), b.column(2)[r].as_buffer()
                every = [h >> np.uint64(16) for _, _, _, h in own_sets(at, data)]
                key, n = np.unique(np.concatenate(every), return_counts=True)
                cut = np.searchsorted(key, (np.arange(parts + 1).astype(np.float64) * (2.0**48 / parts)).astype(np.uint64))
                full = np.flatnonzero(np.diff(cut))
                yield pa.record_batch([pa.array([chunk] * len(full), pa.int64()), pa.array(full.astype(np.int32)), pa.array([_packed(key[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]]) for p in full], pa.binary())], ["chunk", "part", "elements"])

    def choose(batches):
        def chosen():
            ids, at, data = held
            key = np.concatenate([k for k, _ in known]) if known else np.zeros(0, np.uint64)
            texts_of = np.concatenate([n for _, n in known]).astype(np.int64) if known else np.zeros(0, np.int64)
            for i, j, bounds, h in own_sets(at, data):
                yield _prefixes(np.frombuffer(ids, np.int64)[i:j], bounds, h, key, texts_of, percent)

        held, known = None, []
        for b in batches:
            for r in range(b.num_rows):
                if b.column(1)[r].as_py() < 0:
                    if held:
                        yield from chosen()
                    held, known = [b.column(k)[r].as_buffer() for k in (3, 4, 5)], []
                else:
                    known.append(_unpacked(b.column(2)[r].as_buffer()))
        if held:
            yield from chosen()

    sent = chunks.select("chunk", "at", "data").mapInArrow(tidy(send), "chunk long, part int, elements binary")
    none = F.lit(None).cast("binary")
    back = _counted(sent, parts).select("chunk", "part", "elements", none.alias("ids"), none.alias("at"), none.alias("data"))
    whole = chunks.select("chunk", F.lit(-1).alias("part"), none.alias("elements"), "ids", "at", "data")
    met = whole.union(back).repartition("chunk").sortWithinPartitions("chunk", "part")
    found = stored(met.mapInArrow(tidy(choose), "rep long, n long, bitmap binary, groups array<long>, keys array<long>, short array<boolean>"))
    dropped(texts.sparkSession, path)
    return found


def _prefixes(ids: np.ndarray, bounds: np.ndarray, h: np.ndarray, known: np.ndarray, texts_of: np.ndarray, percent: int) -> pa.RecordBatch:
    """The profiles of one piece's texts; known: the elements that two texts or more hold, texts_of: how many."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    key = h >> np.uint64(16)
    spot = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
    many = np.where(known[spot] == key, texts_of[spot], 1) if len(known) else np.ones(len(key), np.int64)
    prefix = n - (percent * n + 99) // 100 + 1
    alone = np.bincount(row, many == 1, len(n)).astype(np.int64)
    live = np.flatnonzero((alone < prefix) & (n > 0))
    at = np.flatnonzero((alone < prefix)[row])
    order = at[np.lexsort((key[at], many[at], row[at]))]
    row, key, h, many = row[order], key[order], h[order], many[order]
    spot = np.full(len(n), -1)
    spot[live] = np.arange(len(live))
    row, n, alone = spot[row], n[live], alone[live]
    first = np.cumsum(n) - n
    rank = np.arange(len(row)) - first[row]
    shared = many > 1
    use = shared & (rank < prefix[live][row])
    # In the smaller set of a pair the first common key is among the first n - ceil(2 t n / (1 + t)) + 1.
    short = rank <= (n - (2 * percent * n + 99 + percent) // (100 + percent))[row]
    # Similar texts likely agree on the least hash of their shared elements; those of passages far more common than
    # the middle one are left out, as they would bring together texts that have nothing else in common.
    middle = np.log2(many[np.minimum(first + alone + (n - alone) // 2, np.maximum(first + n - 1, 0))]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    usual = np.flatnonzero(shared & (np.log2(many).astype(np.int64) <= (middle + 1)[row]))
    groups = []
    for seed in SEEDS:
        mixed = tb.splitmix(key[usual] ^ np.uint64(seed))
        least = usual[np.lexsort((mixed, row[usual]))]
        groups.append(key[least[np.concatenate([[True], row[least][1:] != row[least][:-1]])]] if len(least) else np.zeros(0, np.uint64))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[use], minlength=len(n)))]).astype(np.int32))
    pairs = pa.array((np.arange(len(n) + 1) * len(SEEDS)).astype(np.int32))
    return pa.record_batch(
        [
            pa.array(ids[live]), pa.array(n), pa.array(bitmaps(h, row, n), pa.binary()), pa.ListArray.from_arrays(pairs, pa.array(np.stack(groups, 1).ravel().view(np.int64))),
            pa.ListArray.from_arrays(ends, pa.array(key[use].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(short[use])),
        ],
        ["rep", "n", "bitmap", "groups", "keys", "short"],
    )
