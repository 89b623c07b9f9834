"""Secret scans by a linear-chain conditional random field.

Tokens are runs of value characters and single marks; chains are lines. Each token is tagged as the begin
of a secret, inside or outside one, from its shape, the tokens beside it and the make-up of its document;
Viterbi decodes the tags. The chain learns from what the fixed base patterns find in a sample of at most
``at_most`` documents and ``max_bytes`` of text, half of them from all documents with a find. It doesn't see
the patterns themselves, and half of what it learns from a find has the secret's name masked, so it tags
values beside names that the patterns don't know as well. Decoded runs that overlap no base span are added
to those.

Defined results: null and empty texts have no spans; without any base find in the table nothing is added;
an empty table gives an empty one; texts and lines are scanned whole, however long; rows are independent of
one another, so repeated ones get the same spans; columns of the input named like an output column are replaced.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import crf
from seamark.llm import textbytes as tb
from seamark.llm.common import read

#: Kinds in the order in which spans of one start are listed, and the base patterns.
KINDS = ("assign", "access", "hex")
NAMES = ("password", "passwd", "secret", "token", "api_?key")
#: Either case of A-Z only: the flag would also take letters that fold to them, such as U+017F.
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in NAMES)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The same for Spark's own functions, to choose documents for the sample.
ANY = rf"""({_EITHER})["']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"""

_VALUE = np.zeros(256, bool)
_VALUE[48:58] = _VALUE[65:91] = _VALUE[97:123] = True
_VALUE[[43, 47, 95, 46, 45]] = True
_VALUE[128:] = True
_MARK = ~_VALUE
_MARK[[32, 9, 10, 11, 12, 13]] = False
_LOW, _UP, _DIG, _HEXA = (np.zeros(256, np.int32) for _ in range(4))
_LOW[97:123] = _UP[65:91] = _DIG[48:58] = 1
_HEXA[48:58] = _HEXA[97:103] = _HEXA[65:71] = 1


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, rank of the kind, end, start of the value) of the base patterns, sorted; in code points."""
    out = []
    if "=" in text or ":" in text:
        # An optional empty tail could be matched by less, never by more; a short value ends the search there.
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of the tokens; first tokens of the lines."""
    s, e, _ = tb.spans(_VALUE[data], offsets)
    marks = np.flatnonzero(_MARK[data])
    starts, ends = np.concatenate([s, marks]), np.concatenate([e, marks + 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    rows = np.searchsorted(offsets, starts, "right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    begin = np.ones(len(starts), bool)
    begin[1:] = (rows[1:] != rows[:-1]) | (lines[starts[1:]] > lines[starts[:-1]])
    return starts, ends, rows, np.flatnonzero(begin)


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, masked: np.ndarray | None = None) -> np.ndarray:
    """Shape, shape with the token before, short words around, and shape with the document's share of marks.

    masked: tokens that count as any unknown word.
    """
    if not len(starts):
        return np.zeros((0, 6), np.int64)
    size = ends - starts
    count = lambda kind: (c := np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)]))[ends] - c[starts]
    part = lambda n: np.where(n == 0, 0, np.where(n == size, 4, 1 + 3 * n // (size + 1)))
    low, up, dig, hexa = count(_LOW), count(_UP), count(_DIG), count(_HEXA)
    length = np.minimum(np.where(size < 8, size, 6 + np.log2(np.maximum(size, 1)) * 2).astype(np.int64), 24)
    shape = (((length * 5 + part(low)) * 5 + part(up)) * 5 + part(dig)) * 2 + (hexa == size)
    word = np.where(size <= 12, tb.word_hashes(tb.LOWER[data], starts, ends), np.uint64(1))
    if masked is not None:
        word = np.where(masked, np.uint64(1), word)
    near = np.concatenate([np.zeros(3, np.uint64), word, np.zeros(1, np.uint64)])
    marks = np.bincount(rows, (size == 1) & ~_VALUE[data[starts]], len(offsets) - 1) / np.maximum(np.bincount(rows, minlength=len(offsets) - 1), 1)
    file = np.minimum(marks * 10, 5).astype(np.int64)
    return np.stack([crf.hashed(1, shape), crf.hashed(2, shape, near[2:-2]), crf.hashed(3, near[1:-3], near[2:-2]), crf.hashed(4, near[:-4], near[1:-3]), crf.hashed(5, near[4:], length), crf.hashed(6, shape, file[rows])], 1)


@dataclass
class SecretModel:
    chain: crf.Crf | None

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, start, end) in bytes of each decoded secret."""
        if self.chain is None:
            return
        starts, ends, rows, begin = tokens(data, offsets)
        scores = self.chain.scores(features(data, offsets, starts, ends, rows))
        first, length = crf.chains(begin, len(starts))
        # Chains without any token that could pay for leaving state 0 decode to 0 throughout.
        reach = np.concatenate([[0], np.cumsum(~self.chain.all_outside(scores))])
        some = reach[first + length] > reach[first]
        first, length = first[some], length[some]
        tags = np.zeros(len(starts), np.int8)
        take = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        tags[take] = self.chain.viterbi(scores[take], np.cumsum(length) - length, length)
        inside = tags > 0
        new = inside & ((tags == 1) | ~np.concatenate([[False], inside[:-1]]) | np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)])
        at = np.flatnonzero(new)
        stop = np.append(at, len(tags))[1:]
        for a, b in zip(at, stop, strict=True):
            last = a
            while last + 1 < b and inside[last + 1]:
                last += 1
            yield int(rows[a]), int(starts[a]), int(ends[last])


def sample(docs: DataFrame, text: str, at_most: int, max_bytes: int, key: str = "doc_id") -> DataFrame:
    """(text) of documents to learn from: of all with a find, and of all others, an even half each by a hash of ``key``."""
    some = docs.where(F.length(F.col(text)) > 0).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("hit", F.col("text").rlike(ANY))
    counts = {r["hit"]: r for r in some.groupBy("hit").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    halves = []
    for seed, (hit, r) in enumerate(sorted(counts.items())):
        most = max(1, min(at_most // 2, r["n"] * (max_bytes // 2) // r["size"]))
        share = F.pmod(F.xxhash64("key", F.lit(101 + seed)), F.lit(1 << 30))
        # In order of the hash, so that the bound on rows takes an even sample as well.
        near = some.where((share < int((1 << 30) * min(1.0, 1.1 * most / r["n"] + 20 / r["n"]))) & (F.col("hit") == hit))
        halves.append(near.orderBy(share, F.xxhash64("text")).limit(most).select("text"))
    return reduce(DataFrame.union, halves) if halves else some.select("text")


def fit(docs: DataFrame, text: str = "text", at_most: int = 3000, max_bytes: int = 12 << 20) -> SecretModel:
    texts = sample(docs, text, at_most, max_bytes).toArrow().column("text")
    data, offsets = tb.flat(texts)
    starts, ends, rows, begin = tokens(data, offsets)
    states, named = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    for k, t in enumerate(texts.to_pylist()):
        spans = base_spans(t)
        if not spans:
            continue
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])]) if not t.isascii() else np.arange(len(t) + 1)
        for begun, _, end, value in spans:
            a, b = np.searchsorted(starts, [offsets[k] + at[value], offsets[k] + at[end]])
            states[a:b] = 2
            states[a : a + 1] = 1
            named[np.searchsorted(ends, offsets[k] + at[begun], "right") : a] = True
    if not states.any():
        return SecretModel(None)
    first, length = crf.chains(begin, len(starts))
    # All chains with a secret; of the others an even tenth, each of which counts as ten. Chains with a secret count
    # half as they are and half with the name of the secret masked, so that values are told without a known name too.
    found = np.concatenate([[0], np.cumsum(states > 0)])
    some = found[first + length] > found[first]
    use = np.flatnonzero(some | (np.arange(len(first)) % 10 == 0))
    some = some[use]
    named &= _VALUE[data[starts]]
    every, weight = [], []
    for masked, chosen, w in ((None, use, np.where(some, 0.5, 10.0)), (named, use[some], np.full(some.sum(), 0.5))):
        part, size = first[chosen], length[chosen]
        take = np.repeat(part - (np.cumsum(size) - size), size) + np.arange(size.sum())
        every.append((features(data, offsets, starts, ends, rows, masked)[take], states[take], size))
        weight.append(np.repeat(w, size))
    x, y, length = (np.concatenate(v) for v in zip(*every, strict=True))
    # Longest first again.
    first, order = np.cumsum(length) - length, np.argsort(-length, kind="stable")
    take = np.repeat(first[order] - (np.cumsum(length[order]) - length[order]), length[order]) + np.arange(length.sum())
    length = length[order]
    return SecretModel(crf.fit(x[take], y[take], np.cumsum(length) - length, length, 3, weight=np.concatenate(weight)[take]))


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])


def scan(docs: DataFrame, model: SecretModel, text: str = "text", shortest: int = 8) -> DataFrame:
    """docs with ``secrets``: base spans and all spans, in code points; added ones have ``shortest`` bytes or more."""

    @F.arrow_udf("struct<base: array<struct<start: bigint, rank: int, end: bigint>>, spans: array<struct<start: bigint, rank: int, end: bigint>>>")
    def find(texts: pa.Array) -> pa.Array:
        data, at = tb.flat(texts)
        base, every = [], []
        for i, j in tb.pieces(at):
            part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
            for r in range(j - i):
                base.append([(s, k, e) for s, k, e, _ in base_spans(part[own[r] : own[r + 1]].tobytes().decode())])
                every.append(list(base[-1]))
            chars = None
            for r, s, e in model.runs(part, own):
                if e - s < shortest:
                    continue
                if chars is None:
                    chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                a, b = int(chars[s] - chars[own[r]]), int(chars[e] - chars[own[r]])
                if any(x < b and a < y for x, _, y in every[i + r]):
                    continue
                value = part[s:e]
                kind = 1 if value[:4].tobytes() == b"AKIA" else 2 if int(_HEXA[value].sum()) == e - s else 0
                every[i + r].append((a, kind, b))
        rows = lambda spans: pa.array([[{"start": s, "rank": k, "end": e} for s, k, e in sorted(v)] for v in spans], pa.list_(_SPAN))
        return pa.StructArray.from_arrays([rows(base), rows(every)], ["base", "spans"])

    return docs.withColumn("secrets", find(F.col(text).cast("string")))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    base = F.col("secrets.base")

    def count(rank):
        return F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets.spans")).alias("spans"))
