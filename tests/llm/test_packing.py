from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import packing as P


def item_by_item(sizes, capacity):
    """Best fit decreasing, one item after the other."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return bins


@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
@settings(max_examples=400, deadline=None)
def test_plan_is_best_fit_decreasing(case):
    capacity, sizes = case
    segments, n = P.plan(Counter(sizes), capacity)
    load, placed = Counter(), Counter()
    for size, lo, hi, first, per_bin in segments:
        for rank in range(lo, hi):
            load[first + (rank - lo) // per_bin] += size
            placed[size] += 1
    assert placed == Counter(sizes) and sorted(load) == list(range(n))
    assert sorted(capacity - v for v in load.values()) == sorted(item_by_item(sizes, capacity))


def test_segment_tree():
    t = P.SegmentTree(10)
    assert t.least_from(0) is None
    for v in (3, 7, 10):
        t.set(v, True)
    assert [t.least_from(v) for v in (0, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    t.set(7, False)
    assert t.least_from(4) == 10


KINDS = "container_kind string, capacity_tokens int"


def assigned(spark, sizes, kinds, schema="doc_id bigint, tokens bigint"):
    return P.pack(spark.createDataFrame(sizes, schema), spark.createDataFrame(kinds, KINDS)).collect()


@pytest.mark.parametrize("broadcast", [200_000, 0])
@pytest.mark.parametrize("group", [250_000, 7])
def test_pack_equals_item_by_item(spark, monkeypatch, broadcast, group):
    monkeypatch.setattr(P, "BROADCAST_SEGMENTS", broadcast)
    monkeypatch.setattr(P, "GROUP_ROWS", group)
    sizes = [(i, (i * 37) % 23 + 1 if i % 3 else 5) for i in range(90)] + [(1000, 130), (1001, 40), (1002, 0), (1003, None)]
    rows = assigned(spark, sizes, [("small", 20), ("big", 64), ("none", None), ("zero", 0), (None, 9)])
    for kind, capacity in (("small", 20), ("big", 64)):
        mine = [r for r in rows if r.container_kind == kind]
        load = Counter()
        for r in mine:
            load[r.container_no] += r.tokens
        parts = [min(t - a, capacity) for _, t in sizes if t for a in range(0, t, capacity)]
        assert sorted(capacity - v for v in load.values()) == sorted(item_by_item(parts, capacity))
        for d, t in sizes:
            if t:
                spans = sorted((r.from_token, r.to_token) for r in mine if r.doc_id == d)
                assert spans[0][0] == 0 and spans[-1][1] == t and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
                assert len(spans) == 1 or t > capacity


def test_empty_and_repeated_items(spark):
    assert assigned(spark, [], [("a", 10)]) == [] and assigned(spark, [(1, 5)], []) == []
    rows = assigned(spark, [(1, 5), (1, 5), (None, 5)], [("a", 10), ("a", 12)])
    assert sorted((r.container_no, r.tokens, r.capacity_tokens) for r in rows) == [(0, 5, 10), (0, 5, 10), (1, 5, 10)]


def test_token_counts(spark):
    path = P.tokenizer_path()
    df = spark.createDataFrame([(1, "Hello world, hello."), (2, None), (3, ""), (4, "停机检查。" * 3000), (5, "0123abcdef" * 4000), (6, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in P.count_tokens(df, "doc_id", "text", path).collect()}
    assert sorted(got) == [1, 4, 5, 6] and got[1] == len(P._encoding(path).encode_ordinary("Hello world, hello.")) and got[6] > 1
    assert P._encoding(path).decode(P._encoding(path).encode_ordinary("Grüße, 世界!")) == "Grüße, 世界!"
