import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import skew
from weftgraph.operators.asof import FOREVER, as_known_at

EV = "id string, p string, s string, day int"
VE = "p string, s string, start int, stop int, rec int, agreement bigint"


def _run(spark, events, versions, how="inner"):
    e, v = spark.createDataFrame(events, EV), spark.createDataFrame(versions, VE)
    got = as_known_at(e, v, ["p", "s"], "day", "id", F.struct("rec", "agreement"), how=how)
    return sorted((r["id"], r["winner"]["agreement"] if r["winner"] else None) for r in got.collect())


def brute(events, versions, how="inner"):
    out = []
    for i, p, s, d in events:
        fit = [(rec, a) for vp, vs, b, e, rec, a in versions if vp == p and vs == s and p and s and d is not None and b <= d < e]
        if fit or how == "left":
            out.append((i, max(fit)[1] if fit else None))
    return sorted(out)


@pytest.mark.parametrize("look", [0.02, 1.0])
def test_equals_brute_force_with_hot_pair_ties_and_open_ends(spark, monkeypatch, look):
    monkeypatch.setattr(skew, "LOOK", look)
    monkeypatch.setattr(skew, "LEAST", 1)
    rng = random.Random(1)
    versions = []
    for n in range(300):
        p = "hot" if n % 3 == 0 else rng.choice("abc")
        b = rng.randrange(17_000, 18_500)
        versions.append((p, "x", b, FOREVER if n % 11 == 0 else b + rng.randrange(-3, 400), rng.randrange(5), n))
    events = [(str(n), "hot" if n % 2 else rng.choice("abcd"), "x", None if n % 50 == 0 else rng.randrange(16_900, 19_000)) for n in range(400)]
    events += [("null", None, "x", 17_500), ("far", "hot", "x", 2_900_000)]
    for how in ("inner", "left"):
        assert _run(spark, events, versions, how) == brute(events, versions, how)


def test_never_a_later_version(spark):
    v = [("a", "x", 10, 100, 1, 1), ("a", "x", 20, 100, 2, 2), ("a", "x", 50, 50, 9, 3)]
    assert _run(spark, [("1", "a", "x", 9), ("2", "a", "x", 10), ("3", "a", "x", 20), ("4", "a", "x", 99), ("5", "a", "x", 100)], v) == [("2", 1), ("3", 2), ("4", 2)]


def test_empty_tables(spark):
    assert _run(spark, [], []) == []
    assert _run(spark, [("1", "a", "x", 5)], []) == []
    assert _run(spark, [("1", "a", "x", 5)], [], "left") == [("1", None)]
