"""Continuous periods and gaps of day intervals per entity.

The state of an entity is an ordered map of disjoint intervals. An insertion finds what it
overlaps by binary search, merges it, and updates the periods and the gaps between them, in
whatever order rows come. Each day keeps the record that covers it, or the mark that several do,
so a record delivered again never overlaps itself, insertions commute, and the map is
bounded by the calendar and not by the rows. Maps of parts of an entity merge by the same
insertion, so rows are folded where they are read and a hot entity is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import real_key
from weftgraph.operators.skew import hot_frame, hot_keys

#: Day number of 9999-12-31, which stands for an open end.
OPEN_END = 2932896
#: Intervals that a task holds in the maps of all its entities before it hands them on.
HELD = 200_000
#: Rows of a result batch.
EMIT = 20_000


class Coverage:
    """Days by the record that covers them: disjoint intervals in order, ``owner`` None where two or more records share the days."""

    __slots__ = ("first", "last", "owner")

    def __init__(self) -> None:
        self.first: list[int] = []
        self.last: list[int] = []
        self.owner: list[str | None] = []

    def insert(self, a: int, b: int, record: str | None) -> bool:
        """Add days ``a`` to ``b`` of ``record`` (None: of several records); whether any of them is shared now."""
        lo, hi = bisect_left(self.last, a), bisect_right(self.first, b)
        if lo == hi:  # nobody was here
            if (not lo or self.last[lo - 1] < a - 1) and (hi == len(self.first) or self.first[hi] > b + 1):
                self.first.insert(lo, a)
                self.last.insert(lo, b)
                self.owner.insert(lo, record)
                return record is None
            new = [(a, b, record)]
        else:
            new, at = [], a
            for x, y, r in zip(self.first[lo:hi], self.last[lo:hi], self.owner[lo:hi]):
                if x < a:
                    new.append((x, a - 1, r))
                elif at < x:
                    new.append((at, x - 1, record))
                new.append((max(x, a), min(y, b), r if r == record else None))
                if y > b:
                    new.append((b + 1, y, r))
                at = y + 1
            if at <= b:
                new.append((at, b, record))
        shared = any(r is None and x <= b and y >= a for x, y, r in new)
        # neighbours of one owner are one interval
        if lo and self.last[lo - 1] == new[0][0] - 1 and self.owner[lo - 1] == new[0][2]:
            lo -= 1
            new[0] = (self.first[lo], new[0][1], new[0][2])
        if hi < len(self.first) and self.first[hi] == new[-1][1] + 1 and self.owner[hi] == new[-1][2]:
            new[-1] = (new[-1][0], self.last[hi], new[-1][2])
            hi += 1
        joined = [new[0]]
        for x, y, r in new[1:]:
            if r == joined[-1][2] and x == joined[-1][1] + 1:
                joined[-1] = (joined[-1][0], y, r)
            else:
                joined.append((x, y, r))
        self.first[lo:hi], self.last[lo:hi], self.owner[lo:hi] = map(list, zip(*joined))
        return shared


class IntervalMap(Coverage):
    """The state of an entity: its coverage, the periods it forms, and the gaps between these.

    ``starts``, ``ends`` and ``shared`` are the periods: disjoint, not touching, in order, marked if
    they hold a shared day. ``gaps[i]`` lies between periods i and i + 1.
    """

    __slots__ = ("starts", "ends", "shared", "gaps")

    def __init__(self, first: Iterable[int] = (), last: Iterable[int] = (), owner: Iterable[str | None] = ()):
        super().__init__()
        self.starts, self.ends, self.shared, self.gaps = [], [], [], []
        for a, b, r in zip(first, last, owner):
            self.insert(a, b, r)

    def insert(self, a: int, b: int, record: str | None) -> bool:
        shared = super().insert(a, b, record)
        self._merge(a, b, shared)
        return shared

    def _merge(self, a: int, b: int, shared: bool) -> None:
        """Unite the periods that the days overlap or touch, and close, narrow or open the gaps around them."""
        lo = bisect_left(self.ends, a - 1)  # the first period that ends on the day before a or later
        hi = bisect_right(self.starts, b + 1)  # past the last that begins on the day after b or earlier
        if lo < hi:
            shared = shared or any(self.shared[lo:hi])
            a, b = min(a, self.starts[lo]), max(b, self.ends[hi - 1])
        around = [(self.ends[lo - 1] + 1, a - 1)] if lo else []
        if hi < len(self.starts):
            around.append((b + 1, self.starts[hi] - 1))
        self.gaps[max(lo - 1, 0) : hi] = around
        self.starts[lo:hi], self.ends[lo:hi], self.shared[lo:hi] = [a], [b], [shared]

    def results(self) -> Iterator[tuple[str, int, int, bool]]:
        """(kind, first day, last day, shared) of the periods and gaps."""
        for a, b, s in zip(self.starts, self.ends, self.shared):
            yield "period", a, b, s
        for a, b in self.gaps:
            yield "gap", a, b, False


_PARTS = "ref_table string, entity_key string, record string, a int, b int"
_RESULTS = "ref_table string, entity_key string, kind string, a int, b int, shared boolean"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*rows), kinds)], list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str | None, int, int]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("ref_table", "entity_key", "record", "a", "b")))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in any order → the intervals of the maps that they form, key by key; handed on once too many are held."""
    state: dict[tuple[str, str], Coverage] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, m in state.items():
            out.extend((*key, r, a, b) for a, b, r in zip(m.first, m.last, m.owner))
            if len(out) > EMIT:
                yield _batch(out, _PARTS)
                out = []
        if out:
            yield _batch(out, _PARTS)

    for t, e, r, a, b in _rows(batches):
        m = state.get((t, e))
        if m is None:
            m = state[t, e] = Coverage()
        held -= len(m.first)
        m.insert(a, b, r)
        held += len(m.first)
        if held > HELD:
            yield from flush()
            state, held = {}, 0
    yield from flush()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of whole entities, one entity after the other and each in any order → their periods and gaps."""
    key, state, out = None, IntervalMap(), []
    for t, e, r, a, b in _rows(batches):
        if (t, e) != key:
            out.extend((*key, *x) for x in state.results()) if key else None
            key, state = (t, e), IntervalMap()
            if len(out) > EMIT:
                yield _batch(out, _RESULTS)
                out = []
        state.insert(a, b, r)
    if key:
        out.extend((*key, *x) for x in state.results())
    if out:
        yield _batch(out, _RESULTS)


def intervals(rows: DataFrame, name: str, entity: list[str], record: str, start: str, end: str) -> DataFrame:
    """Rows as (ref_table, entity_key, record, a, b) in day numbers.

    Both end days belong to the interval, a null end is open. Rows with a null or blank entity
    key, a null record or start, or an end before the start are left out. Repeated rows stay;
    the map counts them once.
    """
    key = F.concat_ws("|", *(real_key(c) for c in entity))
    kept = rows.filter(F.col(start).isNotNull() & F.col(record).isNotNull())
    for c in entity:
        kept = kept.filter(real_key(c).isNotNull())
    return kept.select(F.lit(name).alias("ref_table"), key.alias("entity_key"), F.upper(F.btrim(F.col(record).cast("string"))).alias("record"), F.unix_date(F.col(start)).alias("a"), F.coalesce(F.unix_date(F.col(end)), F.lit(OPEN_END)).alias("b")).filter("b >= a")


def fold(rows: DataFrame) -> DataFrame:
    """Rows of ``intervals`` combined where they are, without a shuffle: the intervals of a map per entity and task."""
    return rows.select("ref_table", "entity_key", "record", "a", "b").mapInArrow(_fold, _PARTS)


def periods_and_gaps(rows: DataFrame, salts: int = 16) -> DataFrame:
    """Rows of ``intervals`` → ref_table, entity_key, kind (period or gap), first_day, last_day (DATE), shared.

    ``shared`` marks periods with a day that two or more records cover. An entity with one
    period has no gap; an empty input gives no rows. Rows are folded into maps where they are read.
    Those of hot entities meet by entity and salt first, so that at most ``salts`` maps of
    their days go to one task; which entities are taken for hot plays no part in the result. The
    salt goes by day, so equal intervals meet in the first step.
    """
    key = ["ref_table", "entity_key"]
    hot = hot_keys(rows, key)
    if hot:
        marked = hot_frame(rows, key, hot).drop("_hot")
        spread = fold(rows.join(marked, key, "left_semi")).repartition(*key, F.pmod(F.xxhash64("a"), F.lit(salts))).mapInArrow(_fold, _PARTS)
        parts = fold(rows.join(marked, key, "left_anti")).unionByName(spread)
    else:
        parts = fold(rows)
    merged = parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_finish, _RESULTS)
    return merged.select("ref_table", "entity_key", "kind", F.date_from_unix_date("a").alias("first_day"), F.date_from_unix_date("b").alias("last_day"), "shared")
