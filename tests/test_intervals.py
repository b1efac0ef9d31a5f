import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.operators import skew
from weftgraph.operators.intervals import OPEN_END, IntervalMap, intervals, periods_and_gaps

D = dt.date
SCHEMA = "id string, who string, a date, b date, extra string"


def _run(spark, data, salts=4):
    df = spark.createDataFrame(data, SCHEMA)
    return sorted((r["entity_key"], r["kind"], str(r["first_day"]), str(r["last_day"]), r["shared"]) for r in periods_and_gaps(intervals(df, "t", ["who"], "id", "a", "b"), salts).collect())


def brute(records):
    """Day by day over small numbers: periods with their mark, and gaps."""
    days = {}
    for r, a, b in records:
        for d in range(a, b + 1):
            days.setdefault(d, set()).add(r)
    out, run = [], []
    for d in sorted(days):
        if run and d == run[-1] + 1:
            run.append(d)
        else:
            if run:
                out.append(run)
            run = [d]
    if run:
        out.append(run)
    return [(x[0], x[-1], any(len(days[d]) > 1 for d in x)) for x in out]


RECORDS = st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 40), st.integers(0, 8)), max_size=14)


@given(RECORDS)
@settings(max_examples=300, deadline=None)
def test_map_equals_counting_days_after_every_insertion_in_any_order(data):
    m, done = IntervalMap(), []
    for r, a, n in data:
        m.insert(a, a + n, r)
        done.append((r, a, a + n))
        want = brute(done)
        assert list(zip(m.starts, m.ends, m.shared)) == want
        assert m.gaps == [(x[1] + 1, y[0] - 1) for x, y in zip(want, want[1:])]
        assert all(x <= y for x, y in zip(m.first, m.last)) and all(x < y for x, y in zip(m.last, m.first[1:]))


@given(RECORDS, st.randoms())
@settings(max_examples=150, deadline=None)
def test_order_and_grouping_of_insertions_play_no_part(data, rng):
    rows = [(a, a + n, r) for r, a, n in data]
    whole = IntervalMap(*zip(*rows)) if rows else IntervalMap()
    rng.shuffle(rows)
    parts = [IntervalMap(*zip(*rows[i::3])) if rows[i::3] else IntervalMap() for i in range(3)]
    merged = IntervalMap()
    for part in parts:
        for x in zip(part.first, part.last, part.owner):
            merged.insert(*x)
    for k in ("first", "last", "owner", "starts", "ends", "shared", "gaps"):
        assert getattr(merged, k) == getattr(whole, k)


def test_state_is_bounded_by_the_days_and_not_by_the_rows():
    rng, m = random.Random(2), IntervalMap()
    for n in range(20_000):
        a = rng.randrange(100)
        m.insert(a, a + rng.randrange(5), str(n))
    assert len(m.first) <= 104 and len(m.starts) == 1 and m.gaps == []


def test_periods_touch_nest_repeat_and_stay_open(spark):
    data = [
        ("1", "x", D(2020, 1, 1), D(2020, 1, 10), "e"),
        ("1", " X ", D(2020, 1, 1), D(2020, 1, 10), "e"),  # delivered twice, oddly written
        ("2", "x", D(2020, 1, 11), D(2020, 1, 12), None),  # touches
        ("3", "x", D(2020, 2, 1), None, None),  # open
        ("4", "x", D(2020, 3, 1), D(2020, 3, 2), None),  # nested
        ("5", "x", D(2020, 5, 2), D(2020, 5, 1), None),  # reversed
        ("6", "x", None, D(2020, 5, 1), None),
        ("7", None, D(2020, 1, 1), D(2020, 5, 1), None),
        ("8", " ", D(2020, 1, 1), D(2020, 5, 1), None),
        (None, "x", D(2019, 1, 1), D(2019, 5, 1), None),
    ]
    assert _run(spark, data) == [
        ("X", "gap", "2020-01-13", "2020-01-31", False),
        ("X", "period", "2020-01-01", "2020-01-12", False),
        ("X", "period", "2020-02-01", "9999-12-31", True),
    ]
    assert OPEN_END == (D(9999, 12, 31) - D(1970, 1, 1)).days
    assert _run(spark, []) == []


def test_a_record_never_overlaps_itself(spark):
    data = [("1", "x", D(2020, 1, 1), D(2020, 1, 10), None), ("1", "x", D(2020, 1, 5), D(2020, 1, 20), None), ("1", "x", D(2020, 1, 3), D(2020, 1, 4), None)]
    assert _run(spark, data) == [("X", "period", "2020-01-01", "2020-01-20", False)]


@pytest.mark.parametrize("least", [1, 10**9])
def test_hot_entity_equals_counting_days(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "LOOK", 1.0)
    monkeypatch.setattr(skew, "LEAST", least)
    rng = random.Random(3)
    base = D(2020, 1, 1)
    records = [(str(i % 150), rng.randrange(0, 900), rng.randrange(0, 6)) for i in range(200)]
    data = [(r, "x", base + dt.timedelta(a), base + dt.timedelta(a + n), None) for r, a, n in records]
    want = [(str(base + dt.timedelta(a)), str(base + dt.timedelta(b)), s) for a, b, s in brute([(r, a, a + n) for r, a, n in records])]
    for salts in (1, 7):
        assert [x[2:] for x in _run(spark, data, salts) if x[1] == "period"] == want


def test_insertion_merges_and_updates_gaps():
    m = IntervalMap()
    for a, b, r in ((10, 12, "x"), (20, 22, "y"), (1, 2, "z")):
        m.insert(a, b, r)
    assert m.gaps == [(3, 9), (13, 19)]
    m.insert(13, 19, "w")
    assert (m.starts, m.ends, m.shared, m.gaps) == ([1, 10], [2, 22], [False, False], [(3, 9)])
    m.insert(5, 6, "v")
    assert m.gaps == [(3, 4), (7, 9)]
    m.insert(0, 30, "u")
    assert (m.starts, m.ends, m.shared, m.gaps) == ([0], [30], [True], [])


def test_tasks_that_hold_little_give_the_same(spark, monkeypatch):
    from weftgraph.operators import intervals as I

    rng = random.Random(5)
    batch = lambda part: I._batch(part, I._PARTS)
    rows = [("t", f"e{rng.randrange(5)}", str(rng.randrange(40)), a, a + rng.randrange(9)) for a in (rng.randrange(300) for _ in range(400))]
    final = lambda parts: sorted(tuple(r.values()) for b in I._finish(iter(parts)) for r in b.to_pylist())
    want = final([batch(sorted(rows))])
    monkeypatch.setattr(I, "HELD", 7)
    monkeypatch.setattr(I, "EMIT", 3)
    parts = [tuple(r.values()) for b in I._fold(iter([batch(rows[:150]), batch(rows[150:])])) for r in b.to_pylist()]
    assert final([batch(sorted(parts, key=lambda x: x[:2]))]) == want
    assert {(e, a, b, s) for _, e, k, a, b, s in want if k == "period"} == {(e, *x) for e in {r[1] for r in rows} for x in brute([(r[2], r[3], r[4]) for r in rows if r[1] == e])}


def test_stream_withdraws_what_vanished(spark, tmp_path):
    from weftgraph.streaming.interval_stream import stream_periods

    src, schema, batches = str(tmp_path / "in"), "ref_table string, entity_key string, record string, a int, b int", []
    (tmp_path / "in").mkdir()
    stream = stream_periods(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src))
    q = None
    for part in ([("t", "X", "1", 1, 3), ("t", "X", "2", 10, 12), ("t", "X", "4", 30, 31)], [("t", "X", "1", 2, 5), ("t", "X", "3", 12, 20)], [("t", "X", "5", 6, 10)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = q or stream.writeStream.outputMode("update").foreachBatch(lambda df, _: batches.append(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    table = {}
    for r in (r for batch in batches for r in batch):
        table.pop((r.kind, r.a), None)
        if r.b is not None:
            table[r.kind, r.a] = (r.b, r.shared)
    assert table == {("period", 1): (20, True), ("period", 30): (31, False), ("gap", 21): (29, False)}


def test_stream_gives_the_same(spark, tmp_path):
    from weftgraph.streaming.interval_stream import stream_periods

    src = str(tmp_path / "in")
    schema = "ref_table string, entity_key string, record string, a int, b int"
    for part in ([("t", "X", "1", 1, 3), ("t", "X", "2", 10, 12)], [("t", "X", "1", 2, 5), ("t", "X", "3", 12, 20)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = stream_periods(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.outputMode("update").format("memory").queryName("periods").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["kind"], r["a"], r["b"], r["shared"]) for r in spark.table("periods").collect()}
    assert {("period", 1, 5, False), ("period", 10, 20, True), ("gap", 6, 9, False)} <= got
    assert len(got) >= 3
