"""Toxicity by a linear-chain conditional random field.

Token labels come from document labels: words that stand in toxic documents far more often than in others
(a G-test that tightens with the sample) are toxic in the documents labelled so, everything else is
outside. A two-state chain over sentences, with word, neighbour and shape features, learns them. Its
forward-backward marginals tag the offending spans, and their sum and maximum give a document's score by
logistic regression on the document labels.

Models are fitted on at most ``at_most`` labelled rows and ``max_bytes`` of their text.

Defined results: null and empty texts have the score of a text without toxic words; without labelled rows
of both kinds every score is the share of toxic rows (0 without any); an empty table gives an empty one; texts
are tagged whole, however long; rows are independent of one another, so repeated ones get the same result;
columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import crf
from seamark.llm import textbytes as tb
from seamark.llm.common import bounded, bucket, labelled, read
from seamark.llm.decontamination import WORD

#: Leading bytes of a word that count as its stem.
STEMS = (5, 7)
RIDGE = 2e-6
#: Labelled rows that a model is fitted on, at most.
AT_MOST = 4000
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, rows and hashes of the words and of their stems; first words of the sentences."""
    low = tb.LOWER[data]
    starts, ends, rows = tb.spans(WORD[low], offsets)
    stops = np.concatenate([[0], np.cumsum(_END[data])])
    begin = np.ones(len(starts), bool)
    if len(starts) > 1:
        begin[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    stems = [tb.word_hashes(low, starts, np.minimum(ends, starts + k)) for k in STEMS]
    return starts, ends, rows, np.stack([tb.word_hashes(low, starts, ends), *stems], 1), np.flatnonzero(begin)


def features(data, starts, ends, hashes) -> np.ndarray:
    """Word, stems, both neighbours, and shape of each word."""
    near = np.concatenate([[np.uint64(0)], hashes[:, 0], [np.uint64(0)]])
    upper = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    if not len(starts):
        return np.zeros((0, 4 + len(STEMS)), np.int64)
    words = [crf.hashed(5 + k, hashes[:, k]) for k in range(1 + len(STEMS))]
    return np.stack([*words, crf.hashed(2, near[:-2]), crf.hashed(3, near[2:]), crf.hashed(4, np.minimum(ends - starts, 20), upper)], 1)


@dataclass
class ToxicModel:
    chain: crf.Crf | None
    logit: np.ndarray  # of the summary
    base: float

    def marginals(self, data, offsets):
        starts, ends, rows, hashes, begin = tokens(data, offsets)
        if self.chain is None or not len(starts):
            return starts, ends, rows, np.zeros(len(starts)), hashes[:, 0]
        p, _ = self.chain.marginals(self.chain.scores(features(data, starts, ends, hashes)), *crf.chains(begin, len(starts)))
        return starts, ends, rows, p[:, 1], hashes[:, 0]

    def score(self, rows: np.ndarray, p: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        if self.chain is None:
            return np.full(n, self.base)
        return 1 / (1 + np.exp(-np.clip(summary(rows, p, words, n) @ self.logit, -30, 30)))


def summary(rows: np.ndarray, p: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Per text: 1, log(1 + expected number of different toxic words), largest marginal, log(1 + words)."""
    some = np.flatnonzero(p >= 0.1)
    some = some[np.lexsort((-p[some], words[some], rows[some]))]
    first = np.ones(len(some), bool)
    first[1:] = (rows[some[1:]] != rows[some[:-1]]) | (words[some[1:]] != words[some[:-1]])
    some = some[first]  # a line that repeats says the same once
    top = np.zeros(n)
    np.maximum.at(top, rows[some], p[some])
    return np.stack([np.ones(n), np.log1p(np.bincount(rows[some], p[some], n)), top, np.log1p(np.bincount(rows, minlength=n))], 1)


def _toxic_words(rows: np.ndarray, hashes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Hashes of words (or stems) that mark toxic documents."""
    n_t, n_c = int(toxic.sum()), int((~toxic).sum())
    pair = np.unique(np.stack([hashes, rows.astype(np.uint64)], 1), axis=0)
    words, at = np.unique(pair[:, 0], return_inverse=True)
    t = np.bincount(at, toxic[pair[:, 1].astype(np.int64)], len(words))
    n = np.bincount(at, minlength=len(words))
    c = n - t
    share = n_t / (n_t + n_c)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(t > 0, t * np.log(t / (n * share)), 0) + np.where(c > 0, c * np.log(c / (n * (1 - share))), 0))
    return words[(t >= 3) & (t >= 0.8 * n) & (g >= 8 + 4 * np.log(max(1.0, (n_t + n_c) / 40)))]


def fit(rows: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id", at_most: int = AT_MOST, max_bytes: int = 24 << 20) -> ToxicModel:
    known = rows.where(F.col(toxic).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(toxic).cast("int").alias("y"))
    got = bounded(known, at_most, "key", text="text", max_bytes=max_bytes).select("text", "y").toArrow()
    y = got.column("y").to_numpy() > 0
    none = ToxicModel(None, np.zeros(4), float(y.mean()) if len(y) else 0.0)
    if not y.any() or y.all():
        return none
    data, at = tb.flat(got.column("text"))
    starts, ends, doc, hashes, begin = tokens(data, at)
    marked = np.zeros(len(starts), bool)
    for k in range(1 + len(STEMS)):
        marked |= np.isin(hashes[:, k], _toxic_words(doc, hashes[:, k], y))
    if not marked.any():
        return none
    states = (marked & y[doc]).astype(np.int64)
    x, (first, length) = features(data, starts, ends, hashes), crf.chains(begin, len(starts))
    # All chains with toxic words; of the others an even tenth, each of which counts as ten.
    some = np.add.reduceat(states[np.concatenate([np.arange(f, f + n) for f, n in zip(first, length, strict=True)])], np.cumsum(length) - length) > 0
    use = np.flatnonzero(some | (np.arange(len(first)) % 10 == 0))
    take = np.concatenate([np.arange(first[k], first[k] + length[k]) for k in use])
    chain = crf.fit(x[take], states[take], np.cumsum(length[use]) - length[use], length[use], 2, ridge=RIDGE, weight=np.repeat(np.where(some[use], 1.0, 10.0), length[use]))
    model = ToxicModel(chain, np.zeros(4), 0.0)
    p = np.concatenate([chain.marginals(chain.scores(x), first, length)[0][:, 1]])
    z = summary(doc, p, hashes[:, 0], len(y))
    for _ in range(60):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(z @ model.logit, -30, 30)))
        model.logit = model.logit - np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(4), z.T @ (q - y) + 0.1 * model.logit)
    return model


_KIND = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])


def tag(docs: DataFrame, model: ToxicModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with ``toxicity``: the score, and runs of words whose marginal is ``least`` or more, in code points."""

    @F.arrow_udf("struct<score: double, spans: array<struct<start: bigint, end: bigint, p: double>>>")
    def judge(texts: pa.Array) -> pa.Array:
        data, at = tb.flat(texts)
        out = []
        for i, j in tb.pieces(at):
            part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
            starts, ends, rows, p, words = model.marginals(part, own)
            score = model.score(rows, p, words, j - i)
            spans: list[list] = [[] for _ in range(j - i)]
            hit = np.flatnonzero(p >= least)
            if len(hit):
                cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(rows[hit]) > 0))
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                for a, b in zip(hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)], strict=True):
                    base = chars[own[rows[a]]]
                    spans[rows[a]].append({"start": int(chars[starts[a]] - base), "end": int(chars[ends[b]] - base), "p": float(p[a : b + 1].max())})
            out += [{"score": float(s), "spans": v} for s, v in zip(score, spans, strict=True)]
        return pa.array(out, _KIND)

    return docs.withColumn("toxicity", judge(F.col(text).cast("string")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = bucket(F.col("doc_id"), 3) == 1
    model = fit(labelled(docs.select("doc_id", "text"), labels.where(~held_out & F.col("toxic").isNotNull()).select("doc_id", "toxic"), AT_MOST))
    score = F.col("toxicity.score")
    return tag(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.size("toxicity.spans").cast("long").alias("n_spans"))
