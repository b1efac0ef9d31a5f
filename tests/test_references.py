import datetime as dt

import pytest

from weftgraph.operators import references as R

T = dt.datetime
TARGET = "k string, recorded_at timestamp_ntz"


def _spans(spark, targets, removed):
    tables = {"t": spark.createDataFrame(targets, TARGET)}
    gone = spark.createDataFrame(removed, "ref_table string, ref_key string, removed_at timestamp_ntz")
    return R.target_spans(tables, [R.Target("t", "k")], gone)


def _refs(spark, data, extra=""):
    df = spark.createDataFrame(data, "id string, fk string, recorded_at timestamp_ntz")
    return R.references(df, R.Reference("a", "id", "fk", "t"))


def test_reasons_in_order(spark):
    spans = _spans(spark, [("T1", T(2020, 1, 1)), ("T2", T(2021, 1, 1)), ("T3", T(2020, 1, 1)), ("t3 ", T(2022, 1, 1)), (None, T(2020, 1, 1))], [("t", " t1", T(2020, 6, 1)), ("t", "T3", T(2021, 1, 1)), ("t", "T9", T(2021, 1, 1))])
    refs = _refs(spark, [("a", "t1", T(2021, 1, 1)), ("b", "T2", T(2020, 1, 1)), ("c", "T3", T(2023, 1, 1)), ("d", "T8", T(2023, 1, 1)), ("e", "T9", T(2023, 1, 1)), ("f", None, T(2023, 1, 1)), ("g", " ", T(2023, 1, 1)), ("h", "all", T(2023, 1, 1)), ("d", "T8", T(2023, 1, 1)), ("i", "T2", None)])
    got = {r["row_key"]: r["reason"] for r in R.orphan_cascade(refs, spans).collect()}
    assert got == {"A": "deleted", "B": "late", "D": "missing", "E": "deleted"}


@pytest.mark.parametrize("bound", [R.BROADCAST_KEYS, 0])
def test_cascade_inherits_to_fixpoint_and_survives_cycles_and_null_keys(spark, monkeypatch, bound):
    monkeypatch.setattr(R, "BROADCAST_KEYS", bound)
    seen = spark.createDataFrame([(t, k, T(2020, 1, 1), T(2020, 1, 1), None, 1, 0) for t, k in (("b", "B1"), ("c", "C1"), ("d", "D1"))], "target_table string, target_key string, first_seen timestamp_ntz, last_seen timestamp_ntz, gone timestamp_ntz, present int, removed int")
    edges = [("b", "B1", "x", "NONE", T(2021, 1, 1)), ("c", "C1", "b", "B1", None), ("d", "D1", "c", "C1", T(2021, 1, 1)), ("b", "B1", "d", "D1", T(2021, 1, 1)), ("e", None, "c", "C1", T(2021, 1, 1))]
    refs = spark.createDataFrame(edges, "ref_table string, row_key string, target_table string, target_key string, recorded_at timestamp_ntz")
    got = sorted((r["ref_table"], r["level"]) for r in R.orphan_cascade(refs, seen).collect())
    assert got == [("b", 0), ("b", 3), ("c", 1), ("d", 2), ("e", 2)]


def test_long_chain(spark, monkeypatch):
    seen = spark.createDataFrame([("t", f"K{n}", T(2020, 1, 1), T(2020, 1, 1), None, 1, 0) for n in range(60)], "target_table string, target_key string, first_seen timestamp_ntz, last_seen timestamp_ntz, gone timestamp_ntz, present int, removed int").coalesce(1)
    refs = spark.createDataFrame([("t", f"K{n}", "t", f"K{n - 1}" if n else "NONE", T(2021, 1, 1)) for n in range(60)], "ref_table string, row_key string, target_table string, target_key string, recorded_at timestamp_ntz").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.row_key: r.level for r in R.orphan_cascade(refs, seen).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {f"K{n}": n for n in range(60)}


def test_empty_tables(spark):
    spans = _spans(spark, [], [])
    assert R.orphan_cascade(_refs(spark, []), spans).collect() == []
    assert [r["reason"] for r in R.orphan_cascade(_refs(spark, [("a", "T1", T(2020, 1, 1))]), spans).collect()] == ["missing"]


def test_counts_by_month(spark):
    spans = _spans(spark, [], [])
    refs = _refs(spark, [("a", "T1", T(2020, 1, 1)), ("b", "T1", T(2020, 1, 9)), ("c", "T1", T(2020, 2, 1))])
    got = sorted((r["ref_month"], r["kind"], r["n_rows"]) for r in R.orphan_counts(R.orphan_cascade(refs, spans)).collect())
    assert got == [("2020-01", "direct", 2), ("2020-02", "direct", 1)]


@pytest.mark.parametrize("least", [20, 10**9])
def test_hot_key_join_equals_plain_join(spark, monkeypatch, least):
    from weftgraph.operators import skew

    monkeypatch.setattr(skew, "LOOK", 1.0)
    monkeypatch.setattr(skew, "LEAST", least)
    from pyspark.sql import functions as F

    from weftgraph.operators.skew import salted_join

    big = spark.range(500).select((F.when(F.col("id") < 300, 1).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    side = spark.createDataFrame([(1, "a"), (1, "b"), (400, "c"), (None, "n")], "k long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, salted_join(big, side, ["k"], F.col("v"), how=how, salts=4).collect())) == sorted(map(str, big.join(side, "k", how).collect()))
        assert sorted(map(str, salted_join(big, side, ["k"], F.col("v"), how=how, salts=4, distinct=True).collect())) == sorted(map(str, big.distinct().join(side, "k", how).collect()))
    assert skew.hot_keys(big, ["k"]) == ([(1,)] if least == 20 else [])
