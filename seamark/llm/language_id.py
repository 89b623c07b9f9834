"""Language identification: family first, then one-versus-one linear SVMs within the family.

A text is a normalised vector of hashed 1- to 3-byte sequences of its lower-cased letters.
Linear support vector machines, one for each pair of families, vote for the family; those of each
pair of languages of that family vote for the language. Platt scaling turns margins into a score.

Defined results: a null text, an empty one, or one without any letter gives ``und`` with score 0;
without labelled rows every text gives ``und``; with a single learned language every other text gets
that language with score 1; an empty table gives an empty one. Texts are read whole, however long; equal texts
get equal results, so repeated rows do; of classes with equal votes and margins the first by name wins. Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import textbytes as tb
from seamark.llm.common import bounded, bucket, read

DIM = 4096
#: Rows of features that a task holds at once.
ROWS = 512
#: Families of common language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, np.int64)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit row of DIM floats per text."""
    n = len(offsets) - 1
    out = np.zeros(n * DIM)
    x = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    gram, same = x, np.ones(len(x), bool)
    for k in (1, 2, 3):
        if k > 1:
            if len(x) < k:
                break
            gram = gram[:-1] * np.uint32(256) + x[k - 1 :]
            same = row[: len(gram)] == row[k - 1 :]
        keep = np.flatnonzero(same & (gram & np.uint32(255) != 32) if k == 1 else same)
        code = ((gram[keep] + np.uint32(k << 28)) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(row[keep] * DIM + code, minlength=n * DIM)
    out = np.sqrt(out.reshape(n, DIM).astype(np.float32))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class PairSvm:
    """Linear SVMs for each pair of classes; a class wins by votes, then by summed margins."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM + 1), np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: list[str]) -> PairSvm:
        out = cls(classes, list(combinations(range(len(classes)), 2)))
        fitted = [_svm(x, np.where(y == i, 1.0, np.where(y == j, -1.0, 0.0))) for i, j in out.pairs]
        if fitted:
            out.weights, out.scale = np.stack([w for w, _ in fitted]), np.stack([s for _, s in fitted])
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index and score of each row."""
        n, c = len(x), len(self.classes)
        if not self.pairs:
            return np.zeros(n, np.int64), np.ones(n)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        p = 1 / (1 + np.exp(-np.clip(margin * self.scale[:, 0] + self.scale[:, 1], -30, 30)))
        votes, wins = np.zeros((n, c)), np.ones((n, c))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += (p[:, k] >= 0.5) + 1e-3 * p[:, k]
            votes[:, j] += (p[:, k] < 0.5) + 1e-3 * (1 - p[:, k])
            wins[:, i] = np.minimum(wins[:, i], p[:, k])
            wins[:, j] = np.minimum(wins[:, j], 1 - p[:, k])
        best = votes.argmax(1)
        return best, wins[np.arange(n), best]


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Squared-hinge SVM by accelerated gradient steps, classes weighted evenly; and Platt's scale and shift.

    y: 1 and -1 for the two classes, 0 for rows of neither, which count nothing (x is not copied).
    """
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), np.where(y < 0, 0.5 / max(1, (y < 0).sum()), 0)).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    grad = np.empty_like(w)
    for t in range(steps):
        pull = weight * np.maximum(np.float32(0), 1 - y * (x @ v[:-1] + v[-1])) * y
        grad[:-1], grad[-1] = pull @ x, pull.sum()
        step = v + np.float32(0.25) * (grad * 2 - np.float32(ridge) * v)
        w, v = step, step + np.float32(t / (t + 3)) * (step - w)
    margin, ab = (x @ w[:-1] + w[-1]).astype(float), np.array([2.0, 0.0])
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -30, 30)))
        g = weight * (p - (y > 0))
        ab -= 2.0 * np.array([(g * margin).sum(), g.sum()])
    return w, ab


@dataclass
class LanguageModel:
    families: PairSvm
    within: dict[str, PairSvm]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        langs, score = np.full(len(x), "und", object), np.zeros(len(x))
        if self.families.classes:
            fam, p = self.families.predict(x)
            for i, name in enumerate(self.families.classes):
                if len(rows := np.flatnonzero(fam == i)):
                    svm = self.within[name]
                    best, q = svm.predict(x[rows])
                    langs[rows], score[rows] = np.array(svm.classes, object)[best], p[rows] * q
        return langs, score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", at_most: int = 3000, max_bytes: int = 64 << 20, families: dict[str, str] = FAMILIES) -> LanguageModel:
    """Learn from at most ``at_most`` labelled rows and ``max_bytes`` of text, chosen by a hash of ``key``; rows without text or language don't count."""
    known = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    rows = bounded(known, at_most, "key", text="text", max_bytes=max_bytes).select("text", "lang")

    def vectors(batches):
        for b in batches:
            data, at = tb.flat(b.column(0))
            for i, j in tb.pieces(at, rows=ROWS):
                x = features(data[at[i] : at[j]], at[i : j + 1] - at[i]).astype(np.float16)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1).slice(i, j - i)], ["x", "lang"])

    got = rows.mapInArrow(vectors, "x binary, lang string").toArrow()
    if not got.num_rows:
        return LanguageModel(PairSvm([]), {})
    names = got.column("lang").to_numpy(zero_copy_only=False)
    x = np.empty((got.num_rows, DIM), np.float32)
    done = 0
    for part in got.column("x").chunks:
        x[done : done + len(part)] = tb.flat(part)[0].view(np.float16).reshape(len(part), DIM)
        done += len(part)
    del got
    family = np.array([families.get(v, v) for v in names], object)
    kinds = sorted(set(family))
    model = LanguageModel(PairSvm.fit(x, np.array([kinds.index(f) for f in family]), kinds), {})
    for kind in kinds:
        langs = sorted(set(names[family == kind]))
        model.within[kind] = PairSvm.fit(x, np.array([langs.index(v) if f == kind else -1 for v, f in zip(names, family, strict=True)]), langs)
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        data, at = tb.flat(texts)
        langs, score = np.full(len(at) - 1, "und", object), np.zeros(len(at) - 1)
        for i, j in tb.pieces(at, rows=ROWS):
            part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
            known = np.flatnonzero(has_letter(part, own)) + i
            got, p = model.predict(features(part, own))
            langs[known], score[known] = got[known - i], p[known - i]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], fields=list(kind))

    out = docs.withColumn("__lid", predict(F.col(text).cast("string")))
    return out.withColumns({"lang_pred": F.col("__lid.lang_pred"), "score": F.col("__lid.score")}).drop("__lid")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs whose language can be told, with the columns of docs only."""
    kept = identify(docs.withColumn("__text", F.col(text)).select(F.struct(*docs.columns).alias("__row"), "__text"), model, "__text")
    return kept.where(F.col("lang_pred") != "und").select("__row.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
