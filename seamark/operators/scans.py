"""Recurrences over long histories, cut into slices of time that many tasks work on.

A recurrence whose steps compose is a scan. ``scanned`` turns each row into an element, a function from the state before it
to the state after it, and composes them: the elements of a slice to one, those of a key's slices, a row each, to
the state in which every slice starts, and then those of each slice again to the state at each row. Composition runs over
whole arrays, so no Python code runs row by row, and one key's history is as many tasks as it has slices.

``in_slices`` is for recurrences that don't compose but forget: each slice is first run as if it were the first one, then from
where the one before it ended, and slices whose start has changed run again until none does. The result is exact
however often that is; where a slice's end doesn't depend on its start, it is once.

Both need (*key, t) and an order within equal t; the state may use the time of the row before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seamark.sources.landing import landed

SLICE_S = 6 * 3600

Element = tuple[np.ndarray, ...]


class Scan:
    """A recurrence whose steps compose. ``names`` are those of an element's numbers, ``number`` their type.

    elements(t, before, first, fields) has one element a row: ``before`` is the time of the row before, ``first`` tells the
    first row of a key, whose element doesn't depend on the state. told(before, after, t, before_t, first, fields) has
    the columns of the result; before and after are the elements composed up to the row, so that their constant part is the state.
    """

    names: tuple[str, ...]
    number: str
    result: str

    def elements(self, t: np.ndarray, before: np.ndarray, first: np.ndarray, fields: list[np.ndarray]) -> Element:
        raise NotImplementedError

    def combine(self, a: Element, b: Element) -> Element:
        raise NotImplementedError

    def identity(self, n: int) -> Element:
        raise NotImplementedError

    def told(self, before: Element, after: Element, t: np.ndarray, before_t: np.ndarray, first: np.ndarray, fields: list[np.ndarray]) -> list:
        raise NotImplementedError

    def state(self) -> Column:
        """The state of a step, from the numbers of a constant element and ``__t``, the time of the row before."""
        raise NotImplementedError


def composed(elements: Element, new: np.ndarray, combine: Callable[[Element, Element], Element]) -> Element:
    """At each row the composition of the elements since the last row marked ``new``, in a number of passes that grows as log n."""
    n = len(new)
    if n == 1:
        return elements
    m = n // 2
    left, right, fresh = tuple(x[0 : 2 * m : 2] for x in elements), tuple(x[1 : 2 * m : 2] for x in elements), new[1 : 2 * m : 2]
    both = tuple(np.where(fresh, r, c) for r, c in zip(right, combine(left, right), strict=True))
    pairs = composed(both, new[0 : 2 * m : 2] | fresh, combine)
    out = tuple(x.copy() for x in elements)
    for o, p in zip(out, pairs, strict=True):
        o[1 : 2 * m : 2] = p
    k = (n - 1) // 2  # rows 2, 4, ... follow the pairs 0, 1, ...
    if k:
        own, fresh = tuple(x[2 : 2 * k + 1 : 2] for x in elements), new[2 : 2 * k + 1 : 2]
        for o, c, e in zip(out, combine(tuple(p[:k] for p in pairs), own), own, strict=True):
            o[2 : 2 * k + 1 : 2] = np.where(fresh, e, c)
    return out


def _changes(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """Whether each row's key differs from that of the row before it; last: the key before the first row."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        a, b = c[:-1], c[1:]
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    new[0] = last is None or [c[0].as_py() for c in columns] != last
    return new


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...] | list[str]) -> list[np.ndarray]:
    """Columns as arrays; a null is 0, or NaN among floating numbers."""
    out = []
    for name in names:
        c = batch.column(name)
        out.append((c.fill_null(float("nan") if pa.types.is_floating(c.type) else False if pa.types.is_boolean(c.type) else 0) if c.null_count else c).to_numpy(zero_copy_only=False))
    return out


class _Run:
    """A scan over the batches of a partition, sorted by (key, slice, mark first, order); what a segment has come to is kept between batches."""

    def __init__(self, scan: Scan, segment: list[str]):
        self.scan, self.segment = scan, segment
        self.key = self.state = self.t = None

    def over(self, batch: pa.RecordBatch, elements: Element, t: np.ndarray, new: np.ndarray) -> tuple[Element, Element]:
        """(elements composed before each row, after it)."""
        if not new[0]:
            start = self.scan.combine(self.state, tuple(e[:1] for e in elements))
            elements = tuple(np.concatenate([s, e[1:]]) for s, e in zip(start, elements, strict=True))
        with np.errstate(all="ignore"):  # of what isn't taken
            after = composed(elements, new, self.scan.combine)
        none = self.scan.identity(1)
        before = tuple(np.concatenate([z if new[0] else s, a[:-1]]) for z, s, a in zip(none, self.state or none, after, strict=True))
        before = tuple(np.where(new, z, b) for z, b in zip(none, before, strict=True))
        self.key, self.state, self.t = [batch.column(c)[-1].as_py() for c in self.segment], tuple(a[-1:] for a in after), t[-1]
        return before, after


def _marked(scan: Scan, key: list[str], fields: list[str], told: bool, schema: StructType):
    """The task function over rows and marks: with ``told`` a scan's result at each row, else one element for each slice."""
    arrow, segment = to_arrow_schema(schema), [*key, "__slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Run(scan, segment)
        for batch in batches:
            if not batch.num_rows:
                continue
            was_key, was = at.key, at.state
            mark, t = _numbers(batch, ["__mark", "__t"])
            new = _changes([batch.column(c) for c in segment], at.key)
            before_t = np.concatenate([[0 if at.t is None else at.t], t[:-1]])
            own = _numbers(batch, fields)
            elements = scan.elements(t, before_t, new & ~mark, own)
            given = _numbers(batch, scan.names) if told else scan.identity(len(t))
            elements = tuple(np.where(mark, g, e) for g, e in zip(given, elements, strict=True))
            before, after = at.over(batch, elements, t, new)
            if told:
                take = pa.array(~mark)
                columns = scan.told(before, after, t, before_t, new & ~mark, own)
                rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(key) :], strict=True))], schema=arrow)
                yield rows.filter(take)
            else:
                # A slice's element stands at its last row, which for the last one is known with the next batch.
                ends = np.flatnonzero(new[1:])
                if new[0] and was_key is not None:
                    yield _summary(was_key, was, arrow)
                if len(ends):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(ends)) for c in segment), *(pa.array(a[ends]) for a in after)], schema=arrow)
        if not told and at.key is not None:
            yield _summary(at.key, at.state, arrow)

    return run


def _summary(key: list, state: Element, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([k], f.type) for k, f in zip(key, arrow, strict=False)), *(pa.array(s) for s in state)], schema=arrow)


def _through(scan: Scan, key: list[str], schema: StructType):
    """The task function over slices' elements: what they compose to up to the end of each."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Run(scan, key)
        for batch in batches:
            if batch.num_rows:
                new = _changes([batch.column(c) for c in key], at.key)
                _, after = at.over(batch, tuple(_numbers(batch, scan.names)), np.zeros(len(new), np.int64), new)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "__slice")), *(pa.array(x) for x in after)], schema=arrow)

    return run


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet, with one copy of the keys."""
    right = right.select(*(F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns))
    same = [left[c].eqNullSafe(right[f"__r_{c}"]) for c in on]
    return left.join(right, same, how).drop(*(f"__r_{c}" for c in on))


def sliced(rows: DataFrame, key: list[str], t: str, fields: list[str], order: tuple[str, ...], slice_s: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``__slice`` and ``__t``; a mark for each slice that follows another one of its key, with that one's last time).

    There are no marks if no key has two slices. The rows are landed, as marks, ends and each round read them again.
    """
    rows = rows.select(*key, *fields, F.floor(F.col(t) / slice_s).alias("__slice"), F.col(t).cast("long").alias("__t"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.lit(False).alias("__mark"))
    rows = landed(rows)
    spans = rows.groupBy(*key).agg((F.max("__slice") > F.min("__slice")).alias("several")).where("several")
    if not spans.take(1):
        return rows, None
    ends = rows.groupBy(*key, "__slice").agg(F.max("__t").alias("__t"))
    w = Window.partitionBy(*key).orderBy("__slice")
    marks = landed(ends.select(*key, "__slice", F.lag("__t").over(w).alias("__t"), F.lead("__slice").over(w).alias("__next")))
    return rows, marks


def _dealt(rows: DataFrame, marks: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows and marks by (key, slice), in order, the mark first."""
    if marks is not None:
        rows = rows.unionByName(marks.where("__t IS NOT NULL").drop("__next").withColumn("__mark", F.lit(True)), allowMissingColumns=True)
    order = [c for c in rows.columns if c.startswith("__o")]
    return rows.repartition(*key, "__slice").sortWithinPartitions(*key, "__slice", F.col("__mark").desc(), *order)


def _followed(marks: DataFrame) -> DataFrame:
    return marks.where("__next IS NOT NULL")


def _with_following(rows: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """The rows of slices that another one of their key follows: nothing starts from the end of the others."""
    return _met(rows, _followed(marks).select(*key, "__slice"), [*key, "__slice"], "left_semi")


def _next(which: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """Rows (*key, __slice, ...) of slices as rows of the slices after them."""
    return _met(_followed(marks).select(*key, "__slice", "__next"), which, [*key, "__slice"]).drop("__slice").withColumnRenamed("__next", "__slice")


def _entering(marks: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """The marks of slices that follow others, with what is known of the end of those."""
    return _met(marks, _next(ends, marks, key), [*key, "__slice"])


def scanned(rows: DataFrame, key: list[str], fields: list[str], scan: Scan, t: str = "t_s", order: tuple[str, ...] = ("t_s", "seq"), slice_s: int = SLICE_S, step: Callable | None = None) -> DataFrame:
    """(*key, the scan's result) of each row; ``order`` begins with t, and null keys are keys, too.

    step: where rounding must be that of steps one after another, the step (as in ``in_slices``) that each slice is replayed
    with, from the state that the scan's ``state`` makes of the elements before the slice.
    """
    own, marks = sliced(rows, key, t, fields, order, slice_s)
    types = StructType([*(own.schema[k] for k in key), own.schema["__slice"], *StructType.fromDDL(", ".join(f"{n} {scan.number}" for n in scan.names)).fields])
    if marks is None:
        own = own.select("*", *(F.lit(None).cast(scan.number).alias(n) for n in scan.names))
    else:
        parts = _dealt(_with_following(own, marks, key), _followed(marks), key).mapInArrow(_marked(scan, key, fields, False, types), types)
        ends = parts.repartition(*key).sortWithinPartitions(*key, "__slice").mapInArrow(_through(scan, key, types), types)
        marks = _entering(marks, landed(ends), key)
    result = StructType([*(own.schema[k] for k in key), *StructType.fromDDL(scan.result).fields])
    if step is None:
        return _dealt(own, marks, key).mapInArrow(_marked(scan, key, fields, True, result), result)
    if marks is None:
        own = own.drop(*scan.names).withColumn("__state", F.lit(None).cast("struct<none: int>"))
    else:
        marks = marks.withColumn("__state", scan.state()).drop(*scan.names)
    return _dealt(own, marks, key).mapInArrow(_stepped(step, key, fields, result, True), result)


def in_slices(rows: DataFrame, key: list[str], fields: list[str], step: Callable, state: str, kind: str, t: str = "t_s", order: tuple[str, ...] = ("t_s", "seq"), slice_s: int = SLICE_S) -> DataFrame:
    """(*key, what step gives): step run over each key's rows in order, as in ``replay.replayed``, many slices at once.

    step(state, row of fields) gives the new state and a row of the type ``kind``, or None; state: the type of its state, a tuple
    or None before a key's first row.
    """
    own, marks = sliced(rows, key, t, fields, order, slice_s)
    result = StructType([*(own.schema[k] for k in key), *StructType.fromDDL(kind).fields])
    if marks is None:
        return _dealt(own.withColumn("__state", F.lit(None).cast(f"struct<{state}>")), None, key).mapInArrow(_stepped(step, key, fields, result, True), result)
    ending = StructType([*(own.schema[k] for k in key), own.schema["__slice"], *StructType.fromDDL(f"__state struct<{state}>").fields])
    before = _with_following(own, marks, key)
    # Each slice as if it were a key's first, then each that follows another, from where that one ended.
    task = _stepped(step, key, fields, ending, False)
    ends = landed(_dealt(before.withColumn("__state", F.lit(None).cast(f"struct<{state}>")), None, key).mapInArrow(task, ending))
    todo = _followed(_entering(marks, ends, key))
    while todo.take(1):
        asked = _met(before, todo.select(*key, "__slice"), [*key, "__slice"], "left_semi")
        new = landed(_dealt(asked, todo, key).mapInArrow(task, ending)).withColumnRenamed("__state", "__new")
        other = _met(new, ends, [*key, "__slice"]).where(~F.col("__new").eqNullSafe(F.col("__state")))
        other = landed(other.select(*key, "__slice", F.col("__new").alias("__state")))
        ends = landed(_met(ends, other.select(*key, "__slice"), [*key, "__slice"], "left_anti").unionByName(other))
        todo = _followed(_met(marks, _next(other, marks, key), [*key, "__slice"]))
    return _dealt(own, _entering(marks, ends, key), key).mapInArrow(_stepped(step, key, fields, result, True), result)


def _stepped(step: Callable, key: list[str], fields: list[str], schema: StructType, told: bool):
    """The task function of ``in_slices``: with ``told`` what step gives at each row, else the state at the end of each slice."""
    arrow, n = to_arrow_schema(schema), len(key) + 1

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def ended(now: tuple, state: tuple | None) -> tuple:
        kind = arrow.field("__state").type
        return (*now, None if state is None else {f.name: x for f, x in zip(kind, state, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*key, "__slice", "__mark", "__state", *fields)]
            for row in zip(*columns, strict=True):
                if row[:n] != now:
                    if now is not None and not told:
                        out.append(ended(now, state))
                    now, state = row[:n], None
                if row[n]:
                    state = None if row[n + 1] is None else tuple(row[n + 1].values())
                    continue
                state, got = step(state, row[n + 2 :])
                if told and got is not None:
                    out.append((*now[:-1], *got))
            if out:
                yield table(out)
        if now is not None and not told:
            yield table([ended(now, state)])

    return run
