"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The merge-type (BPE) vocabulary of a model file is applied from an agenda: the candidate merge of highest
score, the leftmost of equals, is taken next, and skipped if a keyed hash of seed, document, place of the word
and of the merge falls below ``dropout``. A skipped candidate returns only when a neighbour changes. So equal
words are cut differently in different documents and places, and
the same run always gives the same pieces, whichever executor makes them. Without dropout the result is
that of the model's own encoder.

A space becomes the mark U+2581, one of which is put first. Characters outside the vocabulary become byte
pieces, and so does a U+2581 of the text itself, so that any text decodes to itself.

Words are cut many at a time: each step takes the best candidate of every word's agenda. Words that lose no
merge are remembered.

Defined results: a null text has null ids and decodes to null; an empty one has no ids; a very long text is cut
whole; repeated rows (of one key) are cut alike; an empty table gives an empty one; columns of the input named
like an output column are replaced.
"""

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words remembered by a task, with their merges without dropout; then it starts anew.
MEMO = 300_000
#: Longer words are cut one by one.
LONG = 64
NONE = 1 << 24
FREE = 2**31 - 1
_CHUNK = re.compile(r" *[^ \n]+|\n| +")
_M64 = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M64
    return x ^ (x >> 31)


@dataclass
class Vocabulary:
    ids: dict[str, int]  # ordinary pieces
    scores: dict[str, float]
    bytes_at: int  # id of byte 0
    pieces: list[bytes] = field(repr=False)  # what each id decodes to
    _agenda: "Agenda | None" = field(default=None, repr=False, compare=False)

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, out, first = {}, {}, [], None
        for k in range(p.get_piece_size()):
            piece = p.id_to_piece(k)
            if p.is_byte(k):
                first = k if first is None else first
                out.append(bytes([k - first]))
            elif p.is_control(k) or p.is_unknown(k):
                out.append(b"")
            else:
                ids[piece], scores[piece] = k, p.get_score(k)
                out.append(piece.replace(MARK, " ").encode())
        if first is None:
            raise ValueError("the model has no byte pieces, without which not every text can be decoded")
        if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in ids):
            raise ValueError("pieces that run across words aren't supported")
        return cls(ids, scores, first, out)

    def split(self, chunk: str, key: int, dropout: float, merges: list[int] | None = None) -> list[int]:
        """Ids of a chunk (leading spaces and what follows); key: of the keyed hash. The terms of the hash are added to merges."""
        sym: list[str | None] = [MARK if c == " " else c for c in chunk]
        literal = {i for i, c in enumerate(chunk) if c == MARK}
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        scores, cut = self.scores, int(dropout * (1 << 64))

        def propose(i: int) -> None:
            j = right[i]
            if j >= 0 and not (literal and (i in literal or j in literal)):
                both = sym[i] + sym[j]
                if both in scores:
                    heapq.heappush(agenda, (-scores[both], i, j, both))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or right[i] != j or sym[i] + sym[j] != both:
                continue  # a part of it has gone into another merge
            term = i * 0x9E3779B97F4A7C15 + self.ids[both] * 0xD6E8FEB86659FD93 & _M64
            if merges is not None:
                merges.append(term)
            if cut and _mix(key + term & _M64) < cut:
                continue
            sym[i], sym[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                propose(left[i])
            propose(i)
        out = []
        for i, s in enumerate(sym):
            if s is not None:
                known = None if i in literal else self.ids.get(s)
                out += [known] if known is not None else [self.bytes_at + b for b in s.encode()]
        return out

    def agenda(self) -> "Agenda":
        if self._agenda is None:
            self._agenda = Agenda(self)
        return self._agenda

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids))[1:].decode()


class Agenda:
    """The agendas of many short words at once: each step takes the best candidate merge of every word.

    A symbol is the id of a piece, or, of a character that isn't one, its code point above all ids.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.first = vocabulary, len(vocabulary.pieces)
        order = {s: k for k, s in enumerate(sorted(set(vocabulary.scores.values()), reverse=True))}
        pairs = {}
        for piece, k in vocabulary.ids.items():
            for cut in range(1, len(piece)):
                x, y = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if x is not None and y is not None:
                    pairs[x << 21 | y] = order[vocabulary.scores[piece]], k
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank, self.merged = np.array([pairs[k] for k in sorted(pairs)], np.int32).reshape(-1, 2).T

    def symbol(self, part: str) -> int | None:
        known = self.v.ids.get(part)
        return known if known is not None else self.first + ord(part) if len(part) == 1 else None

    def symbols(self, chunk: str) -> list[int]:
        # A mark of the text itself is no piece.
        return [self.first + ord(c) if c == MARK else self.symbol(MARK if c == " " else c) for c in chunk]

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if they don't merge) and merged symbol of pairs of symbols; -1 merges with nothing."""
        key = x.astype(np.int64) << 21 | y
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[spot] == key) & (x >= 0) & (y >= 0)
        return np.where(hit, self.rank[spot], NONE), np.where(hit, self.merged[spot], -1)

    def run(self, sym: np.ndarray, pri: np.ndarray, merged: np.ndarray, at: np.ndarray, cut: int, terms: list | None = None) -> np.ndarray:
        """The symbols that are left, -1 where one has gone into another.

        Columns are words: sym their symbols (-1 beyond the end), pri and merged the candidates of each symbol
        with the next one (rank times 64 plus place), at their keys. terms: gets (words, terms of the hash).
        """
        rows, n = sym.shape
        out, word = np.full((rows, n), -1, np.int32), np.arange(n)
        sym = np.concatenate([sym, np.full((1, n), -1, np.int32)])  # the last row stands for no neighbour
        place = np.arange(rows, dtype=np.int8)[:, None]
        right = np.where(sym[1:] >= 0, place + np.int8(1), np.int8(rows))
        right = np.concatenate([right, np.full((1, n), rows, np.int8)])
        left = np.repeat(np.concatenate([np.int8([rows]), np.arange(rows, dtype=np.int8)])[:, None], n, 1)
        bound = np.uint64(cut) if cut else None
        while n:
            best = pri.min(0)
            go = best < FREE
            if (live := int(go.sum())) < 0.8 * n:
                out[:, word[~go]] = sym[:rows, ~go]
                word, at, best = word[go], at[go], best[go]
                sym, pri, merged, right, left = (np.ascontiguousarray(m[:, go]) for m in (sym, pri, merged, right, left))
                n, c = live, np.arange(live)
            else:
                c = np.flatnonzero(go)
            if not n:
                break
            i = (best[c] & 63).astype(np.int64)
            new = merged[i, c]
            term = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + new.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            if terms is not None:
                terms.append((word[c], term))
            pri[i, c] = FREE
            if bound is not None:
                take = tb.splitmix(at[c] + term) >= bound
                i, c, new = i[take], c[take], new[take]
            j = right[i, c].astype(np.int64)
            after, before = right[j, c].astype(np.int64), left[i, c].astype(np.int64)
            sym[i, c], sym[j, c], right[i, c] = new, -1, after
            pri[j[j < rows], c[j < rows]] = FREE
            left[after, c] = i
            for x, y in ((i, after), (before, i)):
                r, k = self.candidates(sym[x, c], sym[y, c])
                some = np.flatnonzero(x < rows)
                pri[x[some], c[some]] = np.where(r[some] < NONE, r[some] * 64 + x[some], FREE)
                merged[x[some], c[some]] = k[some]
        return out


class Encoder:
    """Cuts texts into ids, many words at a time, and remembers how words are cut without dropout."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int):
        self.vocabulary, self.dropout, self.seed = vocabulary, dropout, np.uint64(_mix(seed + 1 & _M64))
        self.cut = int(dropout * (1 << 64))
        self.agenda = vocabulary.agenda()
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        # Of each word remembered: its symbols with their first candidates, its ids and its merges without dropout.
        none = np.zeros(0, np.int32)
        self.sym, self.pri, self.merged = _Lists(none), _Lists(none), _Lists(none)
        self.ids, self.terms = _Lists(none), _Lists(np.zeros(0, np.uint64))

    def _learn(self, chunks: list[str]) -> None:
        """Remember chunks; those of over ``LONG`` characters only by their number."""
        short = [self.agenda.symbols(c) if len(c) <= LONG else [] for c in chunks]
        size = np.array([len(x) for x in short], np.int64)
        sym = np.fromiter(chain.from_iterable(short), np.int32, int(size.sum()))
        ends = np.zeros(len(sym), bool)
        ends[np.cumsum(size)[size > 0] - 1] = True
        rank, merged = self.agenda.candidates(sym, np.where(ends, -1, np.append(sym[1:], -1)).astype(np.int32))
        place = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
        first = len(self.sym)
        for held, values in ((self.sym, sym), (self.pri, np.where(rank < NONE, rank * 64 + place, FREE).astype(np.int32)), (self.merged, merged.astype(np.int32))):
            held.extend(values, size)
        ids, count, terms = self._cut(np.arange(first, first + len(chunks)), np.zeros(len(chunks), np.uint64), 0, [])
        self.ids.extend(ids, count)
        word, term = (np.concatenate(x) for x in zip(*terms, strict=True)) if terms else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.terms.extend(term[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(chunks)))

    def _cut(self, words: np.ndarray, at: np.ndarray, cut: int, terms: list | None = None) -> tuple[np.ndarray, np.ndarray, list | None]:
        """(ids, how many of each word) of remembered words under the keys ``at``."""
        size = self.sym.sizes(words)
        found = []
        for least, rows in ((0, 4), (4, 6), (6, 8), (8, 12), (12, 20), (20, LONG)):
            own = np.flatnonzero((size > least) & (size <= rows))
            for k in range(0, len(own), 1 << 15):
                part = own[k : k + (1 << 15)]
                own_terms: list | None = None if terms is None else []
                sym, pri, merged = (m.columns(words[part], rows, fill) for m, fill in ((self.sym, -1), (self.pri, FREE), (self.merged, -1)))
                left = self.agenda.run(sym, pri, merged, at[part], cut, own_terms).T
                if own_terms:
                    terms += [(part[w], t) for w, t in own_terms]
                col, _ = np.nonzero(left >= 0)
                found.append((part[col], left[left >= 0]))
        word, sym = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        # Characters that are no piece become the bytes of their code point.
        odd = np.flatnonzero(sym >= self.agenda.first)
        if len(odd):
            spelt = [chr(c - self.agenda.first).encode() for c in sym[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in spelt]
            start = (np.cumsum(times) - times)[odd]
            word, sym = np.repeat(word, times), np.repeat(sym, times)
            sym[np.repeat(start, times[odd]) + np.concatenate([np.arange(len(x)) for x in spelt])] = np.frombuffer(b"".join(spelt), np.uint8).astype(np.int32) + self.vocabulary.bytes_at
        return sym, np.bincount(word, minlength=len(words)), terms

    def encode(self, text: str, key: int) -> list[int]:
        return self.encode_all([text], np.array([key], np.int64))[0].tolist()

    def encode_all(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's); keys: a number of each document."""
        if len(self.words) > MEMO:
            self._forget()
        split = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        known = self.words
        fresh = list(dict.fromkeys(c for c in chain.from_iterable(split) if c not in known))
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self._learn(fresh)
        n = np.array([len(x) for x in split], np.int64)
        word = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        own = tb.splitmix(self.seed ^ keys.view(np.uint64))
        at = tb.splitmix(np.repeat(own, n) + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        # Until a merge is dropped, the agenda is the same as without dropout.
        dropped = np.zeros(0, np.int64)
        if self.cut:
            times = self.terms.sizes(word)
            lost = np.flatnonzero(tb.splitmix(np.repeat(at, times) + self.terms.values_of(word)) < np.uint64(self.cut))
            dropped = np.unique(np.searchsorted(np.cumsum(times), lost, "right"))
        count = self.ids.sizes(word)
        long = {}
        if len(by_one := np.flatnonzero(self.sym.sizes(word) == 0)):
            whole = list(chain.from_iterable(split))
            for k in by_one.tolist():
                long[k] = self.vocabulary.split(whole[k], int(at[k]), self.dropout)
                count[k] = len(long[k])
        ids, times, _ = self._cut(word[dropped], at[dropped], self.cut)
        plain = np.ones(len(word), bool)
        plain[dropped] = False
        plain[list(long)] = False
        count[dropped] = times
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[_ranges(ends[plain] - count[plain], count[plain])] = self.ids.values_of(word[plain])
        out[_ranges(ends[dropped] - times, times)] = ids
        for k, own_ids in long.items():
            out[ends[k] - count[k] : ends[k]] = own_ids
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first .. first + size - 1 of each, in a row."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Lists:
    """Lists of numbers in a row."""

    def __init__(self, values: np.ndarray):
        self.values, self.at = values, np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.values = np.concatenate([self.values, values])

    def sizes(self, k: np.ndarray) -> np.ndarray:
        return self.at[k + 1] - self.at[k]

    def values_of(self, k: np.ndarray) -> np.ndarray:
        return self.values[_ranges(self.at[k], self.sizes(k))]

    def columns(self, k: np.ndarray, rows: int, fill: int) -> np.ndarray:
        """A column for each list, filled up with ``fill``."""
        row = np.arange(rows)[:, None]
        return np.where(row < self.sizes(k), self.values[np.minimum(self.at[k] + row, len(self.values) - 1)], fill).astype(np.int32)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id", dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """docs with ``ids``."""
    vocabulary.agenda()  # made once, here

    @F.arrow_udf("array<int>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary, dropout, seed)
        for texts, keys in batches:
            _, at = tb.flat(texts)
            number = keys.to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [pa.array([], pa.list_(pa.int32()))]
            for i, j in tb.pieces(at):
                own = texts.slice(i, j - i)
                ids, bounds = encoder.encode_all(own.to_pylist(), number[i:j])
                parts.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=own.is_null()))
            yield pa.concat_arrays(parts)

    return docs.withColumn("ids", cut(F.col(text).cast("string"), F.xxhash64(key)))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """docs with ``decoded``."""
    size = np.array([len(p) for p in vocabulary.pieces], np.int64)
    first, every = np.cumsum(size) - size, np.frombuffer(b"".join(vocabulary.pieces), np.uint8)

    @F.arrow_udf("string")
    def join(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.int32()))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        parts = [pa.array([], pa.string())]
        for i, j in tb.pieces(bounds, tb.PIECE // 4):
            own = lists.values[bounds[i] : bounds[j]].to_numpy(zero_copy_only=False)
            data = every[_ranges(first[own], size[own])]
            ends = np.concatenate([[0], np.cumsum(size[own])])[bounds[i : j + 1] - bounds[i]]
            # The mark that was put first goes.
            full = ends[1:] > ends[:-1]
            keep = np.ones(len(data), bool)
            keep[ends[:-1][full]] = False
            data, ends = data[keep], ends - np.concatenate([[0], np.cumsum(full)])
            if ((data[ends[:-1][ends[1:] > ends[:-1]]] & 0xC0) == 0x80).any():
                raise ValueError("ids that don't decode to a text")
            data.tobytes().decode()  # raises where bytes are no text
            nulls = lists.slice(i, j - i).is_valid()
            text = pa.StringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
            parts.append(pc.if_else(nulls, text, pa.scalar(None, pa.string())))
        return pa.concat_arrays(parts)

    return docs.withColumn("decoded", join(F.col(ids)))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with dropout, and decoded again from its ids."""
    vocabulary = Vocabulary.load()
    out = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
