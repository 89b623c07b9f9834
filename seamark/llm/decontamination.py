"""Benchmark decontamination: a broadcast hash set of normalised item n-grams, scanned over every document.

Words are runs of a-z, 0-9 and bytes of non-ASCII characters, after A-Z is lower-cased. An item's
windows are its runs of ``size`` words; a shorter item is one window. A task hashes each window of its
documents, looks it up in the set and compares the words themselves before it counts as a hit.

The set is broadcast in blocks of items of at most ``block_bytes`` text each, one scan per block; a
benchmark of ordinary size is one block. Later blocks start from the hits found so far.

Defined results: null and empty texts have no words; items without words match nothing; repeated items
and repeated documents are each judged on their own; columns of the input named like an output column
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import read

SIZE = 10
BLOCK_BYTES = 8 << 20
_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_KIND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])
_DDL = "struct<n_words: bigint, runs: array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>, items: array<string>>"

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, and starts, ends, rows and hashes of the words."""
    low = tb.LOWER[data]
    starts, ends, rows = tb.spans(WORD[low], offsets)
    return low, starts, ends, rows, tb.word_hashes(low, starts, ends)


@dataclass
class WindowSet:
    """Windows of a block of items: sorted hashes, each with its words and the items it stands in."""

    hashes: dict[int, np.ndarray]  # by window length
    filters: dict[int, np.ndarray]
    known: dict[tuple[int, bytes], list[str]]

    @classmethod
    def build(cls, items: list[tuple[str, str]], size: int = SIZE) -> WindowSet:
        found: dict[tuple[int, bytes], list[str]] = {}
        by_len: dict[int, set[int]] = {}
        for item_id, text in items:
            data, at = tb.flat(pa.array([text], pa.string()))
            low, starts, ends, _, hashes = words(data, at)
            if len(starts) == 0:
                continue
            k = min(size, len(starts))
            for i, h in enumerate(tb.combine(hashes, k)):
                by_len.setdefault(k, set()).add(int(h))
                ids = found.setdefault((k, _joined(low, starts[i : i + k], ends[i : i + k])), [])
                if item_id not in ids[-1:]:
                    ids.append(item_id)
        sorted_hashes = {k: np.array(sorted(v), np.uint64) for k, v in by_len.items()}
        filters = {}
        for k, v in sorted_hashes.items():
            filters[k] = np.zeros(1 << 20, bool)
            filters[k][(v & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return cls(sorted_hashes, filters, found)

    def hits(self, low, starts, ends, rows, hashes):
        """(index of the first word, length, items) of each window that occurs."""
        for k, known in self.hashes.items():
            grams = tb.combine(hashes, k)
            maybe = np.flatnonzero(self.filters[k][(grams & np.uint64(0xFFFFF)).astype(np.int64)] & (rows[: len(grams)] == rows[k - 1 :]))
            if len(maybe):
                at = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
                for i in maybe[known[at] == grams[maybe]]:
                    if ids := self.known.get((k, _joined(low, starts[i : i + k], ends[i : i + k]))):
                        yield int(i), k, ids


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts, ends, strict=True))


def _scan(window_set: WindowSet):
    @F.arrow_udf(_DDL)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        data, at = tb.flat(texts)
        earlier = before.to_pylist() if before.null_count < len(before) else [None] * len(before)
        out = []
        for i, j in tb.pieces(at):
            part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
            low, starts, ends, rows, hashes = words(part, own)
            n_words = np.bincount(rows, minlength=j - i)
            first_word = np.concatenate([[0], np.cumsum(n_words)])
            edge = np.zeros(len(starts) + 1, np.int64)
            items: dict[int, set[str]] = {}
            for w, k, ids in window_set.hits(low, starts, ends, rows, hashes):
                edge[w] += 1
                edge[w + k] -= 1
                items.setdefault(int(rows[w]), set()).update(ids)
            for r, was in enumerate(earlier[i:j]):
                if was and was["items"]:
                    items.setdefault(r, set()).update(was["items"])
                    for run in was["runs"]:
                        edge[first_word[r] + run["first"]] += 1
                        edge[first_word[r] + run["last"] + 1] -= 1
            covered = np.cumsum(edge)[:-1] > 0
            for r in range(j - i):
                runs = []
                if r in items:
                    a, b = first_word[r], first_word[r + 1]
                    s, e, _ = tb.spans(covered[a:b], np.array([0, b - a]))
                    chars = np.concatenate([[0], np.cumsum((part[own[r] : own[r + 1]] & 0xC0) != 0x80)])
                    runs = [{"first": int(x), "last": int(y) - 1, "start": int(chars[starts[a + x] - own[r]]), "end": int(chars[ends[a + y - 1] - own[r]])} for x, y in zip(s, e, strict=True)]
                out.append({"n_words": int(n_words[r]), "runs": runs, "items": sorted(items.get(r, ()))})
        return pa.array(out, _KIND)

    return scan


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """The items in lists of about ``block_bytes`` of text, one list at the driver at a time."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with ``decon``: the number of words, the merged hit runs (word indexes, characters) and the items hit."""
    out = docs.withColumn("decon", F.lit(None).cast(_DDL))
    for items in blocks(benchmark, text="text", block_bytes=block_bytes):
        out = out.withColumn("decon", _scan(WindowSet.build(items, size))(F.col(text).cast("string"), F.col("decon")))
    return out


def n_hit(decon: Column) -> Column:
    return F.aggregate(decon["runs"], F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs without any hit, with the columns of docs only."""
    kept = scan(docs.withColumn("__text", F.col(text)).select(F.struct(*docs.columns).alias("__row"), "__text"), benchmark, "__text")
    return kept.where(F.size("decon.runs") == 0).select("__row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with the hit runs cut out of their text."""
    runs = F.col("decon.runs")
    before = F.transform(runs, lambda r, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["end"]).alias("a"), r["start"].alias("b")))
    last = F.coalesce(F.element_at(runs, -1)["end"], F.lit(0))
    kept = F.concat(F.array_join(F.transform(before, lambda s: F.substring(F.col(text), s["a"] + 1, s["b"] - s["a"])), ""), F.substring(F.col(text), last + 1, F.length(text)))
    return scan(docs, benchmark, text).withColumn(text, F.when(F.size(runs) > 0, kept).otherwise(F.col(text))).drop("decon")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    decon = F.col("decon")
    return found.select("doc_id", decon["n_words"].alias("n_words"), n_hit(decon).alias("n_hit"), F.size(decon["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(decon["items"], ","), 256).alias("items_sha256"), (F.size(decon["runs"]) > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), {SIZE}) AS k, array_to_string(ws[i : i + least(len(ws), {SIZE}) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {SIZE - 1}, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
spots AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM spots JOIN windows USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
