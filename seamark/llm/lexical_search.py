"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are maximal runs of letters a-z, digits and non-ASCII characters, after A-Z is lower-cased. ``signatures`` turns
documents into blocks of rows of like numbers of terms. Each block holds, for every level of repetition, a Bloom
filter per document, stored by bit position: a slice is the bitmap of the documents with that bit. The AND of a term's
slices has every document with the term, and a few others, so weighted sums of slices are never below a document's score.

A search goes over the signatures twice and reads few texts: the documents of the highest bounds are scored first, which
gives each item a threshold; then every document whose bound reaches it is scored exactly. No other can be among
the best, so the result is that of scoring all of them. Items go in blocks of bounded size.

score(document) = sum over the item's terms of weight * ((10^9 tf) div (1000 tf + 8 m)), weight = floor(1000 ln((2N+2) / (2df+1))),
m = 10 + (90 n N) div L; N documents with terms, L terms in all, n terms of the document, df documents with the term.

Defined results: null and empty texts have no terms and are in no result; rows that repeat an id are ranked each, rows
without an id after others of their score; rows of one item_id are one item with the terms of all its rows; an item
without terms, or whose terms are nowhere, gives no rows; other columns are ignored; empty tables give none. Terms meet by
64-bit hashes, whose words aren't compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import read, stored
from seamark.llm.decontamination import words

TOP = 10
#: Documents of the highest bounds that are scored for an item's threshold.
PROBES = 40
#: A document's signature has a filter of its terms that occur at least so often, for each of these.
LEVELS = (1, 2, 4)
BITS_A_TERM, HASHES, WIDEST = 16, 4, 1 << 20
DOCS_A_BLOCK, BITS_A_BLOCK = 512, 1 << 25
#: Distinct terms of documents that a task gathers before it cuts them into blocks.
HELD_TERMS = 1 << 20
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
GROUP, SLAB = 256, 4096
BROADCAST_BYTES = 64 << 20

_SIGNATURES = "docs int, keys binary, n_terms binary, most binary, slices array<struct<width: int, bits: binary>>"
_SLICES = pa.list_(pa.struct([("width", pa.int32()), ("bits", pa.binary())]))


def _counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(terms of each row; row, hash and count of each distinct term of a row, by row and hash)."""
    _, _, _, rows, hashes = words(data, at)
    n = np.bincount(rows, minlength=len(at) - 1)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return n, rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def _positions(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The bits of each term in filters of ``width`` bits."""
    low, step = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return [(((low + np.uint64(j) * step & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64) for j in range(HASHES)]


def _block(doc: np.ndarray, hashes: np.ndarray, tf: np.ndarray, docs: int) -> list[dict]:
    """The slices of a block: for each level, rows of bitmaps over the documents."""
    out = []
    for level in LEVELS:
        take = tf >= level
        most = int(np.bincount(doc[take], minlength=1).max())
        width = min(WIDEST, BITS_A_TERM * most)
        bits = np.zeros((width, docs), bool)
        for at in _positions(hashes[take], width) if width else ():
            bits[at, doc[take]] = True
        out.append({"width": width, "bits": np.packbits(bits, axis=1).tobytes()})
    return out


def _blocks(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents of like numbers of terms; parts: (keys, terms, row, hash and count of distinct terms)."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    starts = np.cumsum([0] + [len(p[0]) for p in parts])
    row, hashes, tf = np.concatenate([p[2] + s for p, s in zip(parts, starts, strict=False)]), np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    distinct = np.bincount(row, minlength=len(n))
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, row, tf)
    order = np.argsort(distinct, kind="stable")
    order = order[distinct[order] > 0]
    first = np.concatenate([[0], np.cumsum(distinct)])
    while len(order):
        sizes = distinct[order[:DOCS_A_BLOCK]]
        docs = int(np.searchsorted(sizes, 1.25 * sizes[0] + 8, "right"))
        docs = min(docs, max(8, BITS_A_BLOCK // (BITS_A_TERM * int(sizes[docs - 1]))))
        own, order = order[:docs], order[docs:]
        at_term = np.repeat(first[own] - np.cumsum(distinct[own]) + distinct[own], distinct[own]) + np.arange(distinct[own].sum())
        slices = _block(np.repeat(np.arange(docs), distinct[own]), hashes[at_term], tf[at_term], docs)
        plain = [keys[own].tobytes(), n[own].tobytes(), most[own].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int32()), *(pa.array([x], pa.binary()) for x in plain), pa.array([slices], _SLICES)], ["docs", "keys", "n_terms", "most", "slices"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
        data, at = tb.flat(batch.column(2))
        for i, j in tb.pieces(at):
            parts.append((keys[i:j], *_counts(data[at[i] : at[j]], at[i : j + 1] - at[i])))
            held += len(parts[-1][2]) + j - i
            if held >= HELD_TERMS:
                yield from _blocks(parts)
                parts, held = [], 0
    if parts:
        yield from _blocks(parts)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id, text): rows of equal keys have equal ids and texts."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"), "doc_id", "text")


def signatures(rows: DataFrame) -> DataFrame:
    """Blocks of the signatures of rows of ``keyed``; rows without terms are in none."""
    return rows.select("k1", "k2", "text").mapInArrow(_signed, _SIGNATURES)


class Queries:
    """Items of a block: their terms, and groups of items with the terms of each group."""

    def __init__(self, items: dict[int | None, set[int]]):
        self.ids = list(items)
        self.hashes = np.array(sorted(set().union(*items.values())), np.uint64)
        item = np.repeat(np.arange(len(items)), [len(t) for t in items.values()])
        term = np.searchsorted(self.hashes, np.array([h for t in items.values() for h in t], np.uint64))
        self.groups = []
        for at in range(0, len(items), GROUP):
            own = (item >= at) & (item < at + GROUP)
            self.groups.append((at, min(at + GROUP, len(items)), item[own] - at, term[own]))
        self.weights = np.zeros(len(self.hashes), np.int64)

    def plain(self) -> tuple:
        return self.ids, self.hashes, self.groups, self.weights

    @classmethod
    def of(cls, plain: tuple) -> Queries:
        out = cls.__new__(cls)
        out.ids, out.hashes, out.groups, out.weights = plain
        return out

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``hashes`` of those that are terms, and the terms."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not hasattr(self, "_filter"):
            self._filter = np.zeros(1 << 20, bool)
            self._filter[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(self._filter[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]

    def slabs(self, group: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The terms of a group a slab at a time, each with a 0/1 matrix (items x terms)."""
        start, stop, item, term = self.groups[group]
        own = np.unique(term)
        for at in range(0, len(own), SLAB):
            slab = own[at : at + SLAB]
            take = (term >= slab[0]) & (term <= slab[-1])
            member = np.zeros((stop - start, len(slab)), np.float32)
            member[item[take], np.searchsorted(slab, term[take])] = 1
            yield slab, member


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Queries]:
    """The items in blocks of about BLOCK_BYTES of text and BLOCK_ITEMS rows; one block at the driver at a time."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).distinct()
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shares = max(-(-n // BLOCK_ITEMS), -(-(total or 0) // BLOCK_BYTES), 1) if n else 0
    for k in range(shares):
        part = rows if shares == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(shares)) == k)
        own: dict[int | None, set[int]] = {}
        for r in part.toLocalIterator():
            data, at = tb.flat(pa.array([r["text"]], pa.string()))
            own.setdefault(r["id"], set()).update(words(data, at)[-1].tolist())
        own = {i: t for i, t in sorted(own.items(), key=lambda x: (x[0] is None, x[0] or 0)) if t}
        if own:
            yield Queries(own)


def part_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms."""
    return 10 + (90 * n * docs) // terms


def _frequencies(sent):
    """Documents with each term of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries.of(sent.value)
        df = np.zeros(len(queries.hashes), np.int64)
        for batch in batches:
            data, at = tb.flat(batch.column(0))
            for i, j in tb.pieces(at):
                _, _, _, rows, hashes = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                own, term = queries.found(hashes)
                df += np.bincount(np.unique(rows[own] * len(df) + term) % max(1, len(df)), minlength=len(df))
        term = np.flatnonzero(df)
        if len(term):
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term], pa.int64())], ["term", "df"])

    return run


def weighed(queries: Queries, rows: DataFrame, docs: int) -> None:
    """Sets the weights of the queries' terms from all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(queries.plain())
    found = rows.select("text").mapInArrow(_frequencies(sent), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    queries.weights[:] = math.floor(1000 * math.log(2 * docs + 2))
    for term, df in found:
        queries.weights[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    sent.unpersist()


def _bounds(queries: Queries, row: dict, docs: int, terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, upper bounds of the scores (items x documents)) of a block of signatures."""
    n, most = np.frombuffer(row["n_terms"], np.int64), np.frombuffer(row["most"], np.int64)
    m = lengths(n, docs, terms)
    held = [(s["width"], np.frombuffer(s["bits"], np.uint8).reshape(s["width"], -1) if s["width"] else None) for s in row["slices"]]
    # A term of one level and not of the next occurs less often than the next level says.
    parts = [part_of(np.minimum(most, top - 1), m) for top in LEVELS[1:]] + [part_of(most, m)]
    for group, (start, stop, _, _) in enumerate(queries.groups):
        bound = np.zeros((stop - start, row["docs"]), np.int64)
        for slab, member in queries.slabs(group):
            weights = queries.weights[slab]
            # Whole numbers below 2^24 are exact in single precision.
            kind = np.float32 if (member @ weights.astype(np.float64)).max() < 1 << 24 else np.float64
            member = member.astype(kind) * weights.astype(kind)
            before = 0
            for (width, bits), part in zip(held, parts, strict=True):
                if width:
                    at = _positions(queries.hashes[slab], width)
                    has = bits[at[0]]
                    for more in at[1:]:
                        has = has & bits[more]
                    some = has.any(1)
                    sums = member[:, some] @ np.unpackbits(has[some], axis=1, count=row["docs"]).astype(kind)
                    bound += sums.astype(np.int64) * (part - before)
                before = part
        yield group, bound


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _highest(sent, docs: int, terms: int, k: int):
    """The k documents of the highest bounds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries.of(sent.value)
        best = [(np.zeros(0, np.int64), np.zeros((0, 2), np.int64)) for _ in queries.ids]
        for batch in batches:
            for row in _rows(batch):
                keys = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)
                for group, bound in _bounds(queries, row, docs, terms):
                    start = queries.groups[group][0]
                    least = np.array([s[-1] if len(s) == k else 1 for s, _ in best[start : start + len(bound)]])
                    for i in np.flatnonzero((bound >= least[:, None]).any(1)):
                        at = np.flatnonzero(bound[i] >= least[i])
                        at = at[np.argsort(-bound[i, at], kind="stable")[:k]]
                        s, own = np.concatenate([best[start + i][0], bound[i, at]]), np.concatenate([best[start + i][1], keys[at]])
                        order = np.argsort(-s, kind="stable")[:k]
                        best[start + i] = s[order], own[order]
        item = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(item):
            own = np.concatenate([x for _, x in best])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.concatenate([s for s, _ in best])), pa.array(own[:, 0]), pa.array(own[:, 1])], ["item", "bound", "k1", "k2"])

    return run


def _reaching(sent, least, docs: int, terms: int):
    """The documents whose bound reaches the least score of any item, with those items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, need = Queries.of(sent.value), least.value
        for batch in batches:
            for row in _rows(batch):
                keys = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)
                doc, item = [], []
                for group, bound in _bounds(queries, row, docs, terms):
                    start = queries.groups[group][0]
                    i, d = np.nonzero(bound >= need[start : start + len(bound), None])
                    doc.append(d)
                    item.append(i + start)
                doc, item = np.concatenate(doc), np.concatenate(item)
                order = np.argsort(doc, kind="stable")
                own, first = np.unique(doc[order], return_index=True)
                if len(own):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(item[order], pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own, 0]), pa.array(keys[own, 1]), lists], ["k1", "k2", "items"])

    return run


def _scored(sent, docs: int, terms: int, k: int):
    """The k best documents of each item, by exact scores of the items named with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries.of(sent.value)
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries.ids]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = tb.flat(batch.column(1))
            asked = batch.column(2)
            for i, j in tb.pieces(at, rows=DOCS_A_BLOCK):
                n, row, hashes, tf = _counts(data[at[i] : at[j]], at[i : j + 1] - at[i])
                own, term = queries.found(hashes)
                row, tf = row[own], tf[own]
                adds = queries.weights[term] * part_of(tf, lengths(n, docs, terms)[row])
                part = asked.slice(i, j - i)
                named = np.zeros((len(queries.ids), j - i), bool)
                named[part.flatten().to_numpy(), np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))] = True
                for group, (start, stop, _, _) in enumerate(queries.groups):
                    if not named[start:stop].any():
                        continue
                    score = np.zeros((stop - start, j - i), np.int64)
                    for slab, member in queries.slabs(group):
                        # Sums of whole numbers below 2^53 are exact in doubles.
                        take = np.flatnonzero(np.isin(term, slab))
                        added = np.zeros((len(slab), j - i))
                        added[np.searchsorted(slab, term[take]), row[take]] = adds[take]
                        score += (member.astype(np.float64) @ added).astype(np.int64)
                    for x in np.flatnonzero(named[start:stop].any(1)):
                        old = best[start + x]
                        least = -old[-1][0] if len(old) == k else 1
                        d = np.flatnonzero(named[start + x] & (score[x] >= least))
                        if len(d):
                            best[start + x] = sorted(old + [(-int(score[x, y]), ids[i + y] is None, ids[i + y] or 0) for y in d])[:k]
        rows = [(item, -s, None if none else d) for item, own in enumerate(best) for s, none, d in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item", "score", "doc_id"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _with_texts(rows: DataFrame, asked: DataFrame, n_bytes: int) -> DataFrame:
    """(doc_id, text, items) of the rows that are asked for; only a list of bounded size is sent to every task."""
    asked = F.broadcast(asked) if n_bytes <= BROADCAST_BYTES else asked
    return rows.join(asked, ["k1", "k2"]).select("doc_id", "text", "items")


def search(rows: DataFrame, index: DataFrame, items: DataFrame, k: int = TOP, probes: int = PROBES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of each item, by (score, doc_id); index: the stored signatures of rows."""
    spark = rows.sparkSession
    sizes = index.select(F.expr("docs AS d"), "n_terms").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    docs, terms = (x or 0 for x in sizes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for queries in blocks(items) if docs else ():
        weighed(queries, rows, docs)
        sent = spark.sparkContext.broadcast(queries.plain())
        high = index.mapInArrow(_highest(sent, docs, terms, max(k, probes)), "item int, bound long, k1 long, k2 long")
        w = Window.partitionBy("item").orderBy(F.col("bound").desc(), "k1", "k2")
        probed = high.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(k, probes)).groupBy("k1", "k2").agg(F.collect_list("item").alias("items"))
        exact = _with_texts(rows, probed, 0).mapInArrow(_scored(sent, docs, terms, k), "item int, score long, doc_id long")
        least = np.ones(len(queries.ids), np.int64)
        for item, score, rank in _best(exact, k).select("item", "score", "rank").collect():
            if rank == k:
                least[item] = score
        need = spark.sparkContext.broadcast(least)
        reach = index.mapInArrow(_reaching(sent, need, docs, terms), "k1 long, k2 long, items array<int>")
        reach = stored(reach.groupBy("k1", "k2").agg(F.first("items").alias("items")))
        n, m = reach.agg(F.count("*"), F.sum(F.size("items"))).first()
        best = _best(_with_texts(rows, reach, 40 * n + 4 * (m or 0)).mapInArrow(_scored(sent, docs, terms, k), "item int, score long, doc_id long"), k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), "item int, item_id long")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        docs += sum(batch.column(0).to_pylist())
        terms += sum(int(np.frombuffer(x, np.int64).sum()) for x in batch.column(1).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(read(spark, sf_dir, "documents"))
    return search(rows, stored(signatures(rows)), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ws FROM documents),
c AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0e0 * any_value(n) + 2.0e0) / (2.0e0 * count(*) + 1.0e0))) AS BIGINT) AS w FROM t, c GROUP BY term),
m AS (SELECT r, doc_id, 10 + (90 * CAST(len(ws) AS BIGINT) * n) // CAST(l AS BIGINT) AS m FROM d, c),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
