import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import terms as T

SCHEMA = "v string, d string, n int, term string"


def test_term_form(spark):
    cases = [("led to", "LED_TO"), (" led – to ", "LED_TO"), ("__a__", "A"), ("!!", None), ("", None), (None, None), ("supplied\xa0by", "SUPPLIED_BY"), ("äb1", "B1"), ("led_to", "LED_TO")]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(T.term("v")).collect()] == [w for _, w in cases]


def test_repeated_rows_and_missing_documents(spark):
    df = spark.createDataFrame([("a", "d1", 1, None), ("a", "d1", 1, None), ("a", "d1", 2, None), ("A", " D1 ", 2, None), ("a", None, 3, None), ("a", " ", 3, None), (None, "d1", 1, None), ("b", None, 1, None), ("b", None, None, "x")], SCHEMA)
    got = {r.term: (r.occurrences, r.documents, r.field_documents, r.mark) for r in T.term_frequencies(T.occurrences(df, "f", "v", "d")).collect()}
    assert got == {"A": (5, 1, 1, "rare"), "B": (2, 0, 1, None)}
    assert T.term_frequencies(T.occurrences(df.limit(0), "f", "v", "d")).count() == 0


@pytest.mark.parametrize("bound", [T.BROADCAST_TERMS, 0])
def test_equals_counting_with_a_hot_term_and_small_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(T, "BROADCAST_TERMS", bound)
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"t{int(rng.expovariate(0.01))}", f"d{rng.randrange(60)}", i % 900, None) for i in range(4000)]
    occ, docs, every = Counter(), defaultdict(set), set()
    for v, d, _, _ in set(rows):
        occ[v.upper()] += 1
        docs[v.upper()].add(d)
        every.add(d)
    out = T.term_frequencies(T.occurrences(spark.createDataFrame(rows, SCHEMA), "f", "v", "d"))
    got = {r.term: (r.occurrences, r.documents, r.mark) for r in out.collect()}
    mark = lambda n: "rare" if n < 5 else "common" if n > 0.15 * len(every) else None
    assert got == {t: (occ[t], len(docs[t]), mark(len(docs[t]))) for t in occ}
    ids = sorted(r.term_id for r in out.collect())
    assert ids == list(range(len(occ)))


def test_block_sums_over_many_blocks():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    ids, n, d = rng.integers(0, 50_000, 20_000), rng.integers(1, 5, 20_000), rng.integers(0, 2, 20_000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(d)], ["id", "n", "docs"])
    parts = pa.Table.from_batches([*T._accumulate(iter([batch.slice(0, 9000)])), *T._accumulate(iter([batch.slice(9000)]))]).sort_by("block").combine_chunks()
    got = pa.Table.from_batches(list(T._sum_blocks(iter(parts.to_batches())))).to_pandas()
    assert (np.bincount(ids, n, 50_000)[got.id] == got.occurrences).all() and got.occurrences.sum() == n.sum() and (np.bincount(ids, d, 50_000)[got.id] == got.documents).all()


def test_several_fields_stay_apart(spark):
    df = spark.createDataFrame([("a", "d1", 1, None)], SCHEMA)
    both = T.occurrences(df, "f", "v", "d").unionByName(T.occurrences(df.withColumn("v", F.lit("a")), "g", "v", "d"))
    assert sorted((r.field_name, r.term, r.field_documents) for r in T.term_frequencies(both).collect()) == [("f", "A", 1), ("g", "A", 1)]
