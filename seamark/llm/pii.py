"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans, which may overlap: every token with an @, and every run of
seven or more digits with separators. Boosted trees over format and context features of a candidate
estimate how likely it is personal data; a threshold calibrated on held-out documents selects spans to
add to those of the fixed base patterns.

The trees learn from the corpus itself: a candidate counts as positive where it overlaps a valid base
span. All documents are used; what reaches the driver is a table of counts per combination of feature
values, of which there are at most ``MAX_PATTERNS`` whatever the input. The trees are then a Spark
expression. Features never include the base patterns' own verdict, so that look-alikes are found.

Defined results: null and empty texts have no spans; without candidates nothing is learned and only
base spans are returned; rows are independent of one another, so ties and repeated rows don't matter;
columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm.common import bucket, read

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. They match what `[class]+` forms of them match, leftmost and without
#: overlap; possessive runs and the look-behinds keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators.
ADDRESS = r"(?<!\S)[^\s@]++@[^\s]++"
NUMBER = r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
#: Words that announce personal data, in several languages.
CUES = r"(?i)(mail|phone|tel|fax|call|contact|card|karte|tarjeta|carte|account|konto|cuenta|compte|server|host)\W{0,3}$"

FEATURES = ("address", "digits", "separators", "dots", "plus", "left", "right", "cue", "letters")
_SIZES = (2, 21, 5, 5, 2, 2, 2, 2, 2)
MAX_PATTERNS = math.prod(_SIZES)
PRECISION = 0.95


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """The sums of the numbers before each one of an array (bound by ``let``), in blocks of its root, as arrays grow by copies."""

    def fold(numbers, at):
        none = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(numbers, none, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    k = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / k).cast("int"))
    own = lambda b: F.slice(sizes, b * k + 1, k)
    starts = fold(F.transform(blocks, lambda b: F.aggregate(own(b), F.lit(0), lambda x, y: x + y)), F.lit(0))
    return F.when(F.size(sizes) > 0, let(starts, lambda s: F.flatten(F.transform(blocks, lambda b: fold(own(b), F.get(s, b)))))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct<start, end, value>> of the matches, in code points; with ``context`` also up to 16 characters before and one after."""

    def placed(m):
        gap, value = (lambda i: F.get(m["gaps"], i)), (lambda i: F.get(m["values"], i))
        sizes = F.transform(m["values"], lambda v, i: F.length(gap(i)) + F.length(v))

        def row(v, i, before):
            start = F.get(before, i) + F.length(gap(i))
            span = [start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value")]
            if context:
                # Four matches back are 16 characters at least: a match has three, and between two of them there is one.
                back = [x for j in (4, 3, 2, 1) for x in (value(i - j), gap(i - j + 1))]
                span += [F.right(F.concat(*(F.coalesce(x, F.lit("")) for x in back)), F.lit(16)).alias("before"), F.substring(gap(i + 1), 1, 1).alias("after")]
            return F.struct(*span)

        return let(sizes, lambda n: let(running(n), lambda before: F.transform(m["values"], lambda v, i: row(v, i, before))))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), placed)


def touched(spans: Column, others: Column, chars: Column, verdict: Callable[[Column, Column], Column]) -> Column:
    """struct<s, hit> of each span: whether verdict(span, other) holds for any of ``others`` that overlaps it.

    Others are dealt to stretches of the text, about the root of its length each, and a span looks at its own stretches only.
    """
    overlap = lambda s, o: (o["start"] < s["end"]) & (s["start"] < o["end"])

    def dealt(both):
        width = F.greatest(F.ceil(F.sqrt(10 * both["chars"])).cast("int"), F.lit(4096))
        stretch = lambda b: F.filter(both["others"], lambda o: (o["start"] < (b + 1) * width) & (o["end"] > b * width))
        at = lambda c: F.floor(c / width).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), at(both["chars"])), stretch)

        def looked(by):
            own = lambda s: F.slice(by, at(s["start"]) + 1, at(s["end"]) - at(s["start"]) + 1)
            return F.transform(both["spans"], lambda s: F.struct(s.alias("s"), F.exists(own(s), lambda some: F.exists(some, lambda o: overlap(s, o) & verdict(s, o))).alias("hit")))

        none = F.transform(both["spans"], lambda s: F.struct(s.alias("s"), F.lit(False).alias("hit")))
        return F.when((F.size(both["others"]) == 0) | (F.size(both["spans"]) == 0), none).otherwise(let(stretches, looked))

    return let(F.struct(spans.alias("spans"), others.alias("others"), chars.alias("chars")), dealt)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def add(total, i):
        x = F.substring(d, i, 1).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * x).otherwise(x)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid_ip(v: Column) -> Column:
    def small(part):
        rest = F.regexp_replace(part, "^0+", "")
        return (F.length(rest) <= 3) & (F.coalesce(rest.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(v, r"\."), small)


def _base(text: Column) -> dict[str, Column]:
    has_digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    n = lambda m: F.length(_digits(m["value"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.when(has_digit, F.filter(matches(text, IP), lambda m: _valid_ip(m["value"]))).otherwise(none),
        "card": F.when(has_digit, F.filter(matches(text, CARD), lambda m: n(m).between(14, 19) & _luhn(m["value"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda m: n(m).between(10, 15))).otherwise(none),
    }


def _spots(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``__b``: base spans by kind; ``__c``: candidates with their features."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("__t", body).withColumn("__b", F.struct(*(v.alias(k) for k, v in _base(F.col("__t")).items())))
    none = F.array().cast("array<struct<start: int, end: int, value: string, before: string, after: string>>")
    t, b = F.col("__t"), F.col("__b")
    out = out.withColumn("__g", F.struct(F.when(F.contains(t, F.lit("@")), matches(t, ADDRESS, True)).otherwise(none).alias("address"), F.when(t.rlike("[0-9]"), matches(t, NUMBER, True)).otherwise(none).alias("number")))
    base = F.concat(*(b[k] for k in KINDS))

    def describe(kind):
        def row(m):
            v, before = m["value"], m["before"]
            return F.struct(
                m["start"].alias("start"), m["end"].alias("end"), F.lit(int(kind == "address")).alias("address"),
                F.least(F.length(_digits(v)), F.lit(20)).alias("digits"), F.least(F.length(F.regexp_replace(v, r"[^\x20()-]", "")), F.lit(4)).alias("separators"),
                F.least(F.length(F.regexp_replace(v, r"[^.]", "")), F.lit(4)).alias("dots"), before.endswith("+").cast("int").alias("plus"),
                before.rlike(r"[\p{L}0-9]$").cast("int").alias("left"), m["after"].rlike(r"^[\p{L}0-9]").cast("int").alias("right"),
                before.rlike(CUES).cast("int").alias("cue"), v.rlike("[A-Za-z]").cast("int").alias("letters"),
            )

        return F.transform(F.col("__g")[kind], row)

    near = touched(F.concat(describe("address"), describe("number")), base, F.length(t), lambda s, o: F.lit(True))
    return out.withColumn("__c", F.transform(near, lambda x: x["s"].withField("near", x["hit"])))


@dataclass
class Trees:
    """Depth-two boosted trees: (feature, cut, feature, cut, feature, cut, four leaves); and Platt's scale, shift and cut-off."""

    trees: list[tuple]
    start: float
    scale: float
    shift: float
    cutoff: float

    def margin(self, x: tuple) -> float:
        total = self.start
        for f, c, f0, c0, f1, c1, leaves in self.trees:
            if x[f] <= c:
                total += leaves[0] if x[f0] <= c0 else leaves[1]
            else:
                total += leaves[2] if x[f1] <= c1 else leaves[3]
        return total

    def probability(self, c: Column) -> Column:
        """The calibrated probability of a candidate, as an expression."""
        total = F.lit(self.start)
        for f, k, f0, k0, f1, k1, leaves in self.trees:
            low = F.when(c[FEATURES[f0]] <= k0, leaves[0]).otherwise(leaves[1])
            high = F.when(c[FEATURES[f1]] <= k1, leaves[2]).otherwise(leaves[3])
            total = total + F.when(c[FEATURES[f]] <= k, low).otherwise(high)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * self.scale + self.shift)))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _best_cut(rows: list[tuple[tuple, float, float]]) -> tuple[float, int, int]:
    """(gain, feature, cut) of the split of (values, gradient, curvature) rows."""
    g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (0.0, 0, 10**6)
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for x, g, h in rows:
            s = by.setdefault(x[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        g = h = 0.0
        for v in sorted(by)[:-1]:
            g, h = g + by[v][0], h + by[v][1]
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, v)
    return best


def boost(counts: list[tuple[tuple, float, float]], held: list[tuple[tuple, float, float]], rounds: int = 25, rate: float = 0.3, precision: float = PRECISION) -> Trees | None:
    """Trees from (feature values, positives, negatives) rows; ``held`` calibrates them."""
    pos, neg = sum(r[1] for r in counts), sum(r[2] for r in counts)
    if not pos or not neg:
        return None
    start = math.log(pos / neg)
    model = Trees([], start, 1.0, 0.0, 2.0)
    margin = {x: start for x, _, _ in counts}
    scale = 1e4 / (pos + neg)  # so that the ridge of the leaves means the same at any size
    for _ in range(rounds):
        rows = []
        for x, p, n in counts:
            q = _sigmoid(margin[x])
            rows.append((x, scale * (p * (1 - q) - n * q), scale * (p + n) * q * (1 - q)))
        gain, f, c = _best_cut(rows)
        if gain <= 1e-6:
            break
        sides = [[r for r in rows if r[0][f] <= c], [r for r in rows if r[0][f] > c]]
        cuts = [_best_cut(s) for s in sides]
        leaves = []
        for side, (_, f2, c2) in zip(sides, cuts, strict=True):
            for own in ([r for r in side if r[0][f2] <= c2], [r for r in side if r[0][f2] > c2]):
                leaves.append(rate * sum(r[1] for r in own) / (sum(r[2] for r in own) + 1))
        model.trees.append((f, c, cuts[0][1], cuts[0][2], cuts[1][1], cuts[1][2], tuple(leaves)))
        one = Trees(model.trees[-1:], 0.0, 1.0, 0.0, 2.0)
        for x in margin:
            margin[x] += one.margin(x)
    held = [(model.margin(x), p, n) for x, p, n in (held or counts)]
    total = sum(p + n for _, p, n in held)
    for _ in range(500):  # Platt scaling
        da = db = 0.0
        for m, p, n in held:
            q = _sigmoid(m * model.scale + model.shift)
            d = (n * q - p * (1 - q)) / total
            da, db = da + d * m, db + d
        model.scale, model.shift = max(0.05, model.scale - 0.2 * da), model.shift - 0.2 * db
    tp = fp = 0.0
    for m, p, n in sorted(held, reverse=True):
        tp, fp = tp + p, fp + n
        q = _sigmoid(m * model.scale + model.shift)
        if tp and tp / (tp + fp) >= precision and q >= 0.5:
            model.cutoff = q - 1e-9
    return model


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Trees | None:
    """Trees learned from the candidates of all documents; every fifth one, by hash, calibrates."""
    c = F.col("c")
    rows = _spots(docs.select(F.col(text), bucket(F.col(doc_id), 5).alias("__k")), text).select((F.col("__k") == 0).alias("held"), F.explode("__c").alias("c"))
    got = rows.groupBy("held", *(c[f].alias(f) for f in FEATURES)).agg(F.count_if(c["near"]).alias("pos"), F.count_if(~c["near"]).alias("neg")).collect()
    # At most 2 * MAX_PATTERNS rows of counts, in a fixed order.
    table = sorted((r["held"], tuple(r[f] for f in FEATURES), float(r["pos"]), float(r["neg"])) for r in got)
    return boost([r[1:] for r in table if not r[0]], [r[1:] for r in table if r[0]])


def find(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """docs with ``base`` and ``pii``: arrays of struct<start, rank, end, kind, p>, sorted; pii holds the added spans too."""
    kind = "array<struct<start: int, rank: int, end: int, kind: string, p: double>>"

    def named(spans, k, p):
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), m["end"].alias("end"), F.lit(k).alias("kind"), p.alias("p")))

    base = F.concat(*(named(F.col("__b")[k], k, F.lit(1.0)) for k in KINDS))
    out = _spots(docs, text).withColumn("__base", F.array_sort(base).cast(kind))
    added = F.array().cast(kind)
    if model is not None:

        def add(c):
            k = F.when(c["address"] == 1, "email").when((c["dots"] >= 3) & (c["separators"] == 0), "ip").when(c["digits"] >= 13, "card").otherwise("phone")
            rank = F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int") - 1
            return F.struct(c["start"].alias("start"), rank.alias("rank"), c["end"].alias("end"), k.alias("kind"), model.probability(c).alias("p"))

        out = out.withColumn("__new", F.filter(F.transform(F.filter("__c", lambda c: ~c["near"]), add), lambda s: s["p"] >= model.cutoff))
        # Of overlapping additions the likelier stays; of equals the one listed first.
        beaten = touched(F.col("__new"), F.col("__new"), F.length("__t"), lambda s, o: (o["p"] > s["p"]) | ((o["p"] == s["p"]) & (o < s)))
        added = F.transform(F.filter(beaten, lambda x: ~x["hit"]), lambda x: x["s"]).cast(kind)
    return out.withColumns({"base": F.col("__base"), "pii": F.array_sort(F.concat("__base", added))}).drop("__t", "__b", "__g", "__c", "__base", "__new")


def merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones joined; a joined span has the kind of its first."""
    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        overlap = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"])
        return F.when(overlap, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined)).otherwise(F.array_append(acc, own))

    return F.aggregate(spans, F.array().cast("array<struct<start: int, end: int, kind: string>>"), step)


def redact(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """docs with every span of their text replaced by its kind in brackets; other columns as they were."""
    row = F.struct(*docs.columns).alias("__row")
    found = find(docs.select(row, F.col(text).alias("__text")), model, "__text").withColumn("__m", merged(F.col("pii")))
    spans, body = F.col("__m"), F.col("__text")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(body, begin(i) + 1, s["start"] - begin(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(body, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1, F.length(body))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(body)
    return found.select(*(clean.alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
