"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line that isn't blank) is hashed to a vector: ``WIDE`` lanes of its SHA-256, and ``LANES``
lanes that count its runs of three words with a sign, each run in one lane. A fingerprint is the sum of
its paragraphs' vectors, each part modulo a power of two. So it doesn't depend on their order, equal
multisets have equal fingerprints, and paragraphs can be inserted or deleted by adding or subtracting
their vectors. The signed lanes are a sketch whose inner products estimate those of the word runs.

Defined results: a null text counts as empty; an empty text has the zero fingerprint, which is alike (1)
to itself and 0 to any other; documents of equal id follow each other by their text; null ids come last.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import read

WIDE = 4
LANES = 128
SHINGLE = 3
_SPACE = np.ones(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = False
_LINE = np.ones(256, bool)
_LINE[10] = False


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of WIDE uint64 lanes and LANES lanes modulo 2 ** 32 (held in uint64) per text."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDE + LANES), np.uint64)
    if len(data) == 0:
        return out
    ls, le, lrow = tb.spans(_LINE[data], offsets)
    ws, we, _ = tb.spans(_SPACE[data], offsets)
    line = np.searchsorted(ls, ws, "right") - 1  # words never hold a line end
    full = np.unique(line)
    for k in full:
        d = np.frombuffer(hashlib.sha256(data[ls[k] : le[k]].tobytes()).digest(), np.uint64)
        out[lrow[k], :WIDE] += d
    h = tb.word_hashes(data, ws, we)
    runs = tb.combine(h, SHINGLE)
    at = np.flatnonzero(line[: len(runs)] == line[SHINGLE - 1 :]) if len(runs) else np.zeros(0, np.int64)
    rows, grams = [lrow[line[at]]], [runs[at]]
    count = np.bincount(line, minlength=len(ls))
    first = np.cumsum(count) - count
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        rows.append(lrow[short])
        grams.append(tb.combine(h, k)[first[short]])
    rows, grams = np.concatenate(rows), np.concatenate(grams)
    sign = np.where(grams >> np.uint64(63), 1.0, -1.0)
    sums = np.bincount(rows * LANES + (grams & np.uint64(LANES - 1)).astype(np.int64), sign, n * LANES)
    out[:, WIDE:] = sums.reshape(n, LANES).astype(np.int64).view(np.uint64)
    return reduced(out)


def reduced(v: np.ndarray) -> np.ndarray:
    """The lanes of v modulo their powers of two."""
    v[..., WIDE:] &= np.uint64(0xFFFFFFFF)
    return v


def insert(fingerprint: np.ndarray, paragraphs: np.ndarray) -> np.ndarray:
    """The fingerprint after paragraphs with these vectors (summed) are added."""
    return reduced(fingerprint + paragraphs)


def delete(fingerprint: np.ndarray, paragraphs: np.ndarray) -> np.ndarray:
    return reduced(fingerprint - paragraphs)


def encode(v: np.ndarray) -> str:
    return base64.b64encode(v[:WIDE].tobytes() + v[WIDE:].astype(np.uint32).tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = base64.b64decode(text)
    return np.concatenate([np.frombuffer(raw, np.uint64, WIDE), np.frombuffer(raw, np.uint32, LANES, 8 * WIDE).astype(np.uint64)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a against rows of b: estimated shared part of their word runs, 0 to 1; 1 only for equal ones."""
    x, y = (v[:, WIDE:].astype(np.uint32).view(np.int32).astype(float) for v in (a, b))
    dot, size = (x * y).sum(1), np.maximum((x * x).sum(1), (y * y).sum(1))
    out = np.clip(dot / np.where(size > 0, size, 1), 0, 1)
    same = (a == b).all(1)
    return np.where(same, 1.0, np.minimum(out, 0.999999))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``fingerprint``."""

    @F.arrow_udf("string")
    def own(texts: pa.Array) -> pa.Array:
        data, at = tb.flat(texts)
        return pa.array([encode(v) for i, j in tb.pieces(at) for v in vectors(data[at[i] : at[j]], at[i : j + 1] - at[i])], pa.string())

    return docs.withColumn("fingerprint", own(F.col(text).cast("string")))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_each: int = 1000, most_parts: int = 50_000) -> DataFrame:
    """docs (doc_id, text) with ``next_text``: that of the next row by descending id; the last row's is the first's.

    Numeric ids are cut into ranges of about ``rows_each`` rows, ``most_parts`` at most. A range is ordered by
    itself, with the first row of the range after it at its end, so that texts are shuffled once and no task
    sees more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    down = -F.col("doc_id").cast("double")
    ids = rows.select(down.alias("down"))
    parts = max(1, min(-(-ids.count() // rows_each), most_parts))
    cuts = sorted(set(ids.approxQuantile("down", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    if cuts:
        cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="down", outputCol="slot", handleInvalid="keep")  # a null id stays null
        rows = cut.transform(rows.withColumn("down", down)).select("doc_id", "text", F.coalesce(F.col("slot").cast("int"), F.lit(len(cuts) + 1)).alias("part"))
    else:
        rows = rows.withColumn("part", down.isNull().cast("int"))
    # One row for each range: the largest id's smallest text.
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("head"))
    used = sorted(r["part"] for r in heads.select("part").collect())
    before = spark.createDataFrame(list(zip(used, used[-1:] + used[:-1], strict=True)), "part int, before int")
    lead = F.broadcast(heads.join(F.broadcast(before), "part"))
    ends = rows.join(lead, "part").where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("before").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    ends = ends.select("doc_id", "text", F.col("before").alias("part"), F.lit(1).alias("end"))
    both = rows.withColumn("end", F.lit(0)).unionByName(ends).repartitionByRange(max(1, len(used)), "part")
    w = Window.partitionBy("part").orderBy("end", F.col("doc_id").desc_nulls_last(), F.col("text"))
    return both.withColumn("next_text", F.lead("text").over(w)).where("end = 0").drop("end", "part")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, the latter by deletion and insertion of paragraphs."""
    rows = with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    head, tail, new = F.substring("text", F.lit(1), n - k), F.substring("text", n - k + 1, k), F.substring("next_text", F.lit(1), k)
    rows = rows.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.sha2(F.concat(head, new), 256).alias("edited_sha256"), F.octet_length(head).alias("kept"), F.octet_length(tail).alias("gone"), F.octet_length(new).alias("came"))

    def compare(batches):
        for b in batches:
            own, at = tb.flat(b.column(1))
            nxt, to = tb.flat(b.column(2))
            kept, gone, came = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (5, 6, 7))
            for i, j in tb.pieces(at + to):
                first = vectors(own[at[i] : at[j]], at[i : j + 1] - at[i])
                second = vectors(nxt[to[i] : to[j]], to[i : j + 1] - to[i])
                olds, news = [], []
                for r in range(i, j):
                    text = own[at[r] : at[r + 1]]
                    cut = text[: kept[r]].tobytes().rfind(b"\n") + 1  # the paragraph that the edit reaches into
                    olds.append(text[cut:])
                    news.append(np.concatenate([text[cut : kept[r]], nxt[to[r] : to[r] + came[r]]]))
                del_at, ins_at = (np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int64) for v in (olds, news))
                edited = insert(delete(first, vectors(np.concatenate(olds), del_at)), vectors(np.concatenate(news), ins_at))
                yield pa.record_batch(
                    [b.column(0).slice(i, j - i), b.column(3).slice(i, j - i), b.column(4).slice(i, j - i), pa.array([encode(v) for v in first]), pa.array([encode(v) for v in edited]), pa.array(likeness(first, edited)), pa.array(likeness(first, second))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return rows.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
