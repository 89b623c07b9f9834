"""Near duplicates and repeats against brute force, on tables that reach every path."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.llm import jaccard_join, repeats
from seamark.llm.suffix_array import permuted_lcp, suffix_array


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    sets = collections.defaultdict(set)
    for d, t in rows:
        sets[d].add(frozenset(_shingles(t)))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in ids}


def _family(seed, n, copies, edits):
    rng = np.random.default_rng(seed)
    base = [f"v{k}" for k in rng.integers(0, 10_000, n)]
    out = []
    for _ in range(copies):
        w = list(base)
        for k in rng.integers(0, n, rng.integers(0, edits + 1)):
            w[k] = f"e{rng.integers(0, 1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_components(spark, monkeypatch, block):
    """Families of borderline copies; with small blocks and frequent keys both rounds and all block tasks run."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = [None, "", "  ", "a b", "A b", "a b c d e", "a b c d e f"]
    for k in range(6):
        texts += _family(k, 120, 25, 7)
    texts += _family(50, 900, 12, 40) + _family(51, 90, 4, 4) * 2
    shared = " ".join(f"s{k}" for k in range(60))
    texts += [f"{shared} " + " ".join(_family(100 + k, 70, 1, 0)) for k in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[9], (None, texts[10])], "doc_id long, text string")
    got = jaccard_join.join_components(df).collect()
    want = _components(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(_shingles(texts[r["doc_id"]])), want[r["doc_id"]])
    kept = jaccard_join.keep_one_of_each(df)
    assert {r["doc_id"] for r in kept.collect()} == {*want.values(), None}


def test_shared_ids(spark):
    """An id with two texts is one node; repeated rows and unlike columns change nothing."""
    words = [f"w{k}" for k in range(200)]
    a, b = " ".join(words[:60]), " ".join(words[100:140])
    rows = [(3, a), (5, a), (5, b), (9, b + " tail"), (9, b + " tail"), (11, b + " another end of it and more and more and more"), (4, None), (4, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n string, gid int")
    got = jaccard_join.join_components(df).collect()
    want = _components(rows)
    assert want[9] == 3 and sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = jaccard_join.keep_one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 4, 4, 11] and kept[0].asDict().keys() == {"doc_id", "text", "n", "gid"}


def test_common_passages(spark, monkeypatch):
    """Many texts that share most of their words and don't link, with a few that do; tiny chunks and tasks."""
    monkeypatch.setattr(jaccard_join.prefix, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(jaccard_join.prefix, "TASK_ELEMENTS", 500)
    rng = np.random.default_rng(7)
    shared = [f"s{k}" for k in range(100)]
    texts = []
    for k in range(60):
        w = [*shared, *(f"u{k}-{x}" for x in range(int(rng.integers(8, 30))))]
        texts.append(" ".join(w))
        if k % 6 == 0:
            texts.append(" ".join(w[2:]))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join_components(df).count() == 0 and repeats.without_repeats(df).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for t in range(300):
        n, k = int(rng.integers(1, 60)), int(rng.choice([2, 3, 5, 2000]))
        s = np.append(rng.integers(1, k, n), 0)
        if t % 3 == 0:
            s = np.append(np.tile(s[: int(rng.integers(1, 4))], 20)[:n], 0)
            s[:-1] = np.maximum(s[:-1], 1)
        sa = suffix_array(s, 2001)
        assert (sa == np.array(sorted(range(len(s)), key=lambda i: tuple(s[i:])))).all()
        lcp = permuted_lcp(s, sa)
        for r in range(1, len(s)):
            a, b = s[sa[r] :], s[sa[r - 1] :]
            assert (a[: lcp[sa[r]]] == b[: lcp[sa[r]]]).all() and a[lcp[sa[r]]] != b[lcp[sa[r]]]


def test_repeats_keep_other_columns(spark):
    """Columns named like the operator's own tables' stay; one named like its result is replaced."""
    line = "a passage of some length that stands in two documents, " * 6
    rows = [(1, "x " + line, "k1", 7, "c"), (2, "y " + line, "k2", 8, "d"), (3, "short", "k3", 9, "e")]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string, h int, cover string").withColumn("repeats", F.lit(0))).collect()
    assert {(r["doc_id"], r["key"], r["h"], r["cover"]) for r in got} == {(1, "k1", 7, "c"), (2, "k2", 8, "d"), (3, "k3", 9, "e")}
    assert {r["doc_id"]: len(r["repeats"]["spans"]) for r in got} == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("cap", [2048, 2])
def test_repeats(spark, cap):
    """With the cap at 2 the finer units are used for all but pairs."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh ü\n"), n))
    passage, other = text(400), text(260)
    texts = [None, "", text(199), text(1500), "x" * 700, "ab" * 400, ("one line of some length, again\n" * 30)]
    texts += [text(int(rng.integers(0, 300))) + passage + text(int(rng.integers(0, 300))) for _ in range(12)]
    texts += [passage[30:300] + text(50), text(120) + passage[:210] + other, other, other[:150] + "Q" + other[150:]]
    texts += [texts[3], texts[3]]
    rows = [*enumerate(texts), (8, texts[8])]
    seen = collections.Counter(b[i : i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(kept), runs, hashlib.sha256(kept).hexdigest()] += 1
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), cap=cap).collect()
    got = collections.Counter((r["doc_id"], len(r["repeats"]["kept"]), len(r["repeats"]["spans"]), hashlib.sha256(bytes(r["repeats"]["kept"])).hexdigest()) for r in out)
    assert got == want
