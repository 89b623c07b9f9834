"""Text quality by a factorisation machine.

A text is a sparse vector: hashed words (unit length), statistics of its structure, and its length as
metadata. The machine adds to a linear score all pairwise interactions through low-rank factors, in time
linear in the vector by the identity: the sum over pairs is half the squared sum less the sum of squares.

It is fitted by Adam on the logistic loss, on at most ``at_most`` labelled rows and ``max_bytes`` of text; both
kinds count alike. Scores are calibrated on margins of labelled rows that were kept back from a fit.

Defined results: a null text counts as empty; an empty text has the score of a vector of zero words;
without labelled rows of both kinds every score is the share of good rows (0 without any); an empty table gives
an empty one; texts are read whole, however long; equal texts get equal scores, so repeated rows do; columns of
the input named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import bounded, bucket, labelled, read

DIM = 1024
#: Rows of features that a task holds at once.
ROWS = 2048
#: Parts of the labelled rows of which each is kept back once, to calibrate the scores.
FOLDS = 4
RANK = 8
#: Labelled rows that a model is fitted on, at most.
AT_MOST = 4000
_SPACE = np.ones(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = False
_LINE = np.ones(256, bool)
_LINE[10] = False


def _kinds() -> np.ndarray:
    """Byte classes: 0 lower-case or non-ASCII, 1 upper-case, 2 digit, 3 sentence mark, 4 other mark, 5 space, 6 line end."""
    k = np.full(256, 4, np.int64)
    k[97:123] = k[128:] = 0
    k[65:91], k[48:58] = 1, 2
    k[[33, 34, 39, 44, 45, 46, 58, 59, 63]] = 3
    k[[32, 9, 13, 11, 12]], k[10] = 5, 6
    return k


KIND = _kinds()
N_STATS = 14


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of DIM word weights and N_STATS statistics per text."""
    n = len(offsets) - 1
    starts, ends, rows = tb.spans(_SPACE[data], offsets)
    hashes = tb.word_hashes(tb.LOWER[data], starts, ends)
    words = np.bincount(rows * DIM + (hashes >> np.uint64(54)).astype(np.int64), minlength=n * DIM).reshape(n, DIM)
    words = np.sqrt(words.astype(np.float32))
    norm = np.linalg.norm(words, axis=1, keepdims=True)
    words /= np.where(norm > 0, norm, 1)
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(row * 7 + KIND[data], minlength=7 * n).reshape(n, 7) / size[:, None]
    n_words = np.bincount(rows, minlength=n)
    many = np.maximum(n_words, 1)
    length = ends - starts
    ls, le, lrow = tb.spans(_LINE[data], offsets)
    n_lines = np.maximum(np.bincount(lrow, minlength=n), 1)
    marked = KIND[data[ends - 1]] == 4 if len(ends) else np.zeros(0, bool)
    stats = np.stack(
        [
            *share.T, np.log1p(n_words), np.bincount(rows, length, n) / many, np.bincount(rows, length > 12, n) / many,
            _distinct(rows, hashes, n) / many, _distinct(lrow, tb.word_hashes(data, ls, le), n) / n_lines, np.log1p(n_words / n_lines), np.bincount(rows, marked, n) / many,
        ],
        1,
    )
    return np.concatenate([words, stats.astype(np.float32)], 1)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    trained: bool = True
    platt: tuple[float, float] = (1.0, 0.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        out = x.astype(np.float32)
        out[:, DIM:] = np.clip((out[:, DIM:] - self.mean) / self.spread, -4, 4) / 4
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.bias)
        scale, shift = self.platt
        return 1 / (1 + np.exp(-np.clip(scale * self.margin(self.scaled(x)).astype(float) + shift, -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray) -> Machine:
    """A machine with Platt's scale and shift, found on the margins of rows that each were kept back from a fit."""
    m, fold = train(x, y), np.arange(len(y)) % FOLDS
    kept = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if not own.any() or y[~own].min() == y[~own].max():
            return m
        part = train(x[~own], y[~own])
        kept[own] = part.margin(part.scaled(x[own]))
    z, ab = np.stack([kept, np.ones(len(y))], 1), np.array([1.0, 0.0])
    # Platt's targets, which keep the scale finite where the kinds can be told apart.
    aim = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        ab = ab - np.clip(np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - aim)), -0.5, 0.5)
    m.platt = (max(float(ab[0]), 0.1), float(ab[1]))
    return m


def train(x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, ridge: float = 2e-4, least: int = 300) -> Machine:
    """x: rows of features(); y: 1 for good. The kinds count alike; small sets get more epochs, ``least`` steps at least."""
    epochs = max(epochs, -(-least * batch // max(1, len(x))))
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())).astype(np.float32) * len(y)
    stats = x[:, DIM:].astype(np.float32)
    rng = np.random.default_rng(5)
    m = Machine(0.0, np.zeros(x.shape[1], np.float32), (0.05 * rng.standard_normal((x.shape[1], RANK))).astype(np.float32), stats.mean(0), np.maximum(stats.std(0), 1e-3))
    x = m.scaled(x)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("bias", np.zeros(1)), ("linear", m.linear), ("factors", m.factors))}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            rows = order[k : k + batch]
            b, t = x[rows], t + 1
            g = ((1 / (1 + np.exp(-np.clip(m.margin(b), -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            sums = b @ m.factors
            grads = {"bias": np.array([g.sum()]), "linear": g @ b + ridge * m.linear, "factors": b.T @ (g[:, None] * sums) - (g @ (b * b))[:, None] * m.factors + ridge * m.factors}
            for name, grad in grads.items():
                one, two = state[name]
                one += 0.1 * (grad - one)
                two += 0.01 * (grad * grad - two)
                step = rate * (1 - epoch / epochs) * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-8)
                if name == "bias":
                    m.bias -= float(step[0])
                else:
                    getattr(m, name)[...] -= step
    return m


def fit(rows: DataFrame, text: str = "text", quality: str = "quality", key: str = "doc_id", at_most: int = AT_MOST, max_bytes: int = 32 << 20) -> Machine:
    known = rows.where(F.col(quality).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(quality).cast("int").alias("y"))
    rows = bounded(known, at_most, "key", text="text", max_bytes=max_bytes).orderBy(F.xxhash64("key"), "text").select("text", "y")

    def vectors(batches):
        for b in batches:
            data, at = tb.flat(b.column(0))
            for i, j in tb.pieces(at, rows=ROWS):
                x = features(data[at[i] : at[j]], at[i : j + 1] - at[i]).astype(np.float16)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1).slice(i, j - i)], ["x", "y"])

    got = rows.mapInArrow(vectors, "x binary, y int").toArrow()
    y = got.column("y").to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return Machine(float(y.mean()) if len(y) else 0.0, np.zeros(1), np.zeros((1, 1)), np.zeros(1), np.ones(1), False)
    flat, _ = tb.flat(got.column("x"))
    return calibrated(flat.view(np.float16).reshape(len(y), DIM + N_STATS), y)


def judge(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """docs with ``score``."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, at = tb.flat(texts)
        parts = [model.score(features(data[at[i] : at[j]], at[i : j + 1] - at[i])) for i, j in tb.pieces(at, rows=ROWS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("score", score(F.col(text).cast("string")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = bucket(F.col("doc_id"), 5) == 0
    model = fit(labelled(docs.select("doc_id", "text"), labels.where(~held_out & F.col("quality").isNotNull()).select("doc_id", "quality"), AT_MOST))
    out = judge(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
