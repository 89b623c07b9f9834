"""Hard negatives, shards and ranked search against brute force, on small odd tables."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamark.llm import hard_negatives, lexical_search, sharding

VECTORS = "vec_id long, embedding array<float>, label int, score double, id string, rank string"


# Hard negatives


@pytest.mark.parametrize("low, high, d", [(-150, 150, 64), (0, 1, 3), (-5, -1, 7), (-(2**30), 2**30, 5), (-(2**45), 2**45, 4)])
def test_packed_scores(low, high, d):
    rng = np.random.default_rng(d)
    a, c = rng.integers(low, high + 1, (9, d)), rng.integers(low, high + 1, (23, d))
    want = a.astype(object) @ c.T.astype(object)
    assert (hard_negatives.packed_scores(a, c) == np.clip(want, -(2**63), 2**63 - 1)).all()


def _mined(rows, is_anchor, n=5, k=5):
    """(anchor, positive, rank, negative, scores) by definition, from {id: (label, integers)}."""
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=False))
    out = []
    for a in filter(is_anchor, rows):
        label, x = rows[a]
        scored = sorted((-dot(x, y), i, m) for i, (m, y) in rows.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:n]:
            below = [(-t, i) for t, i, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(below)]
    return sorted(out)


def test_hard_negatives_odd(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=6)], int(rng.integers(0, 3)), 0.5, "x", "y") for k in range(300)]
    rows += [(300 + k, rows[5][1], k % 3, None, None, None) for k in range(40)]  # one vector many times: ties
    rows += [(340, [1.0, 2.0], 1, None, None, None), (341, [], 1, None, None, None), (342, [0.0] * 6, 2, None, None, None)]
    rows += [rows[7], (8, rows[9][1], 2, None, None, None)]  # repeated ids, equal and not
    known = {}
    for i, v, m, *_ in rows:
        known[i] = min(known.get(i, (m, v)), (m, v))
    known = {i: (m, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, (m, v) in known.items()}
    bad = [(None, [1.0], 1), (400, None, 1), (401, [1.0], None), (402, [float("nan")], 1), (403, [float("inf")], 1), (404, [1.0, None], 1)]
    df = spark.createDataFrame(rows + [(*b, None, None, None) for b in bad], VECTORS).repartition(5)
    usable = hard_negatives.usable(df)
    for block_bytes in (1 << 20, 8 * 6 * 3):  # one block, and blocks of about three anchors
        got = hard_negatives.mine(usable, F.col("id") % 20 == 0, block_bytes=block_bytes)
        assert sorted(map(tuple, got.collect())) == _mined(known, lambda i: i % 20 == 0)
    assert hard_negatives.mine(hard_negatives.usable(df.limit(0)), F.col("id") % 20 == 0).count() == 0


def test_hard_negatives_wide(spark):
    """Components that no double holds: scores are exact up to 64 bits and end there."""
    rows = [(k, [float(2 ** (20 + k)), -1.5e9 * k], k % 2) for k in range(8)] + [(8, [1e300, 0.0], 0), (9, [1e308, 0.0], 1)]
    df = hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert df.count() == 9
    known = {i: (m, [int(np.floor(256 * x)) for x in v]) for i, v, m in rows if i < 9}
    want = [(*r[:4], *(min(s, 2**63 - 1) for s in r[4:])) for r in _mined(known, lambda i: i in (0, 1, 2))]
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("id") < 3).where("positive_score < 9e18").collect())) == [r for r in want if r[4] < 9e18]


# Ranked lexical search


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, k):
    counts = [(d, collections.Counter(_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(_terms(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "日本", "x9"]
    draw = lambda n: " ".join(vocabulary[min(len(vocabulary) - 1, int(k))] for k in rng.exponential(40, n))
    docs = [(k, draw(int(rng.integers(1, 200)))) for k in range(250)] + [(250, draw(30_000)), (251, "w1 " * 5000), (252, None), (253, ""), (254, "-- !"), (None, draw(20)), (None, None)]
    docs += [(300 + k, docs[3][1]) for k in range(40)] + [docs[5], docs[5]]  # ties, repeated rows
    items = [(k, draw(int(rng.integers(1, 40)))) for k in range(12)] + [(12, docs[3][1]), (13, "nowhere"), (14, None), (15, "W1,w1; W2"), (3, draw(5)), (3, draw(5)), (None, draw(9))]
    return docs, items, spark.createDataFrame([(d, t, 1.0, "r") for d, t in docs], "doc_id long, text string, score double, rank string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("k, probes", [(10, 40), (3, 3)])
def test_lexical_search(library, k, probes, monkeypatch):
    docs, items, df, asked = library
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 7)  # several blocks of items
    rows = lexical_search.keyed(df)
    got = lexical_search.search(rows, lexical_search.stored(lexical_search.signatures(rows)), asked, k, probes)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(_ranked(docs, items, k))


def test_lexical_search_empty(library):
    _, _, df, asked = library
    for d, i in ((df.limit(0), asked), (df, asked.limit(0))):
        rows = lexical_search.keyed(d)
        assert lexical_search.search(rows, lexical_search.signatures(rows), i).count() == 0


def test_bounds_hold(monkeypatch):
    """A bound is never below the score, whatever the filters let through; narrow filters let through nearly all."""
    monkeypatch.setattr(lexical_search, "WIDEST", 64)
    rng = np.random.default_rng(9)
    texts = [" ".join(f"t{int(k)}" for k in rng.integers(0, 200, rng.integers(1, 300))) for _ in range(60)]
    keys = pa.array(range(60), pa.int64())
    _, _, hashes, _ = lexical_search._counts(*lexical_search.tb.flat(pa.array(texts)))
    queries = lexical_search.Queries({i: {int(h) for h in rng.choice(hashes, 12)} for i in range(5)})
    queries.weights[:] = rng.integers(1, 9000, len(queries.weights))
    for block in lexical_search._signed(iter([pa.RecordBatch.from_arrays([keys, keys, pa.array(texts)], ["k1", "k2", "text"])])):
        row = block.to_pylist()[0]
        own = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)[:, 0]
        ((_, bound),) = lexical_search._bounds(queries, row, 60, 9000)
        for d, k in enumerate(own):
            n, _, h, tf = lexical_search._counts(*lexical_search.tb.flat(pa.array([texts[k]])))
            at, term = queries.found(h)
            adds = queries.weights[term] * lexical_search.part_of(tf[at], lexical_search.lengths(n, 60, 9000)[0])
            _, _, item, of = queries.groups[0]
            for i in range(5):
                assert bound[i, d] >= adds[np.isin(term, of[item == i])].sum()


# Shards


def _check_shards(rows, docs, shards=8):
    """Every row once, right sizes, counts at most one apart, slots without gaps; the shards of each text."""
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} <= {"rows"} and all(r["grown_shard"] is None for r in rows)
    counts = collections.Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(shards)) and max(counts[t] for t in range(shards)) - min(counts[t] for t in range(shards)) <= 1
    for t in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == t) == list(range(counts[t]))
    at = collections.defaultdict(collections.Counter)
    for r in rows:
        at[r["text_crc32"]][r["shard"]] += 1
    return at


def test_shards_odd(spark):
    """A text with 0.4 of all rows goes over as few shards as hold it; texts of fewer rows stay whole."""
    rng = np.random.default_rng(2)
    docs = [(k, f"single {k} " + "y" * int(rng.integers(0, 50))) for k in range(400)] + [(1000 + k, "hot") for k in range(400)]
    docs += [(2000 + k, f"group {k % 40}") for k in range(190)] + [(3000, None), (3001, ""), (None, "single 3"), (None, None), (7, "single again"), (7, "single again")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, shard int, node string").repartition(5)
    at = _check_shards(sharding.shard(df).collect(), docs)
    hot = zlib.crc32(b"hot")
    assert len(at[hot]) == -(-400 // (len(docs) // 8))
    assert all(len(c) == 1 for x, c in at.items() if x != hot)


def test_shards_small(spark):
    kind = "doc_id long, text string"
    assert sharding.shard(spark.createDataFrame([], kind)).count() == 0
    for docs in ([(1, "a")], [(k, "same") for k in range(20)], [(k, None) for k in range(3)]):
        _check_shards(sharding.shard(spark.createDataFrame(docs, kind)).collect(), docs)


def test_shards_follow_lines(spark):
    """Documents that share lines move together, though no two texts are equal: most links are kept, not an eighth of them."""
    line = lambda g: f"a line of the family number {g:05d}, long enough to count"
    docs = [(k, f"{line(k % 100)}\nown words {k}") for k in range(300)] + [(1000 + k, f"no family {k}") for k in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.shard(df).collect()
    _check_shards(rows, docs)
    shard = {r["doc_id"]: r["shard"] for r in rows}
    kept = sum(shard[k] == shard[k + 100] for k in range(200))
    assert kept > 150


def test_ranks(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "id AS node", "CAST(id % 3 = 0 AS int) AS part")
    got = collections.defaultdict(list)
    for r in sharding.ranked(df, "part", 20_000).collect():
        got[r["part"]].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in got.values()) and len(got) == 2
