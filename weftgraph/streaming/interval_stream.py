"""Periods and gaps kept up to date over a stream.

The state of an entity is its interval map: disjoint intervals of days with the record that covers
them. Its size is bounded by the calendar, whatever was delivered and however often.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators.intervals import IntervalMap, fold

STATE = "first array<int>, last array<int>, owner array<string>"
OUTPUT = "ref_table string, entity_key string, kind string, a int, b int, shared boolean"


def _results(m: IntervalMap) -> dict[tuple[str, int], tuple[int, bool]]:
    """(kind, first day) → (last day, shared)."""
    return {(kind, a): (b, s) for kind, a, b, s in m.results()}


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    before = _results(m)
    for pdf in batches:
        owners = [r if isinstance(r, str) else None for r in pdf["record"]]
        for a, b, r in zip(pdf["a"].astype(int).tolist(), pdf["b"].astype(int).tolist(), owners):
            m.insert(a, b, r)
    state.update((m.first, m.last, m.owner))
    now = _results(m)
    out = [(*key, *k, *v) for k, v in now.items() if before.get(k) != v] + [(*key, *k, None, None) for k in before if k not in now]
    yield pd.DataFrame(out, columns=["ref_table", "entity_key", "kind", "a", "b", "shared"]).astype({"a": "int32", "b": "Int32", "shared": "boolean"})


def stream_periods(rows: DataFrame) -> DataFrame:
    """A stream of ``intervals`` rows → the periods and gaps that a batch changed (update mode).

    A later row of the same entity, kind and first day replaces an earlier one downstream; one whose
    last day is null withdraws it. Late rows are taken in whenever they come. The rows of a batch
    are folded into maps before they are shuffled, so what reaches the task of a hot entity is at
    most one map per task that read the batch.
    """
    return fold(rows).groupBy("ref_table", "entity_key").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
