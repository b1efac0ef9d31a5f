import pytest
from pyspark.sql import functions as F

from weftgraph.functions.json_repair import read_json, repaired_json
from weftgraph.operators import catalog as C
from weftgraph.operators import chunking


def _chunks(spark, text, size=3, step=1):
    return [(r.seq, r.text) for r in chunking.chunk_corpus(spark.createDataFrame([("D", text)], "document_id string, text string"), size=size, step=step).orderBy("seq").collect()]


def _s(n):
    return " ".join(f"s{i}." for i in range(n))


def test_windows(spark):
    assert _chunks(spark, None) == [] and _chunks(spark, "") == [] and _chunks(spark, " \n ") == []
    assert [len(_chunks(spark, _s(n))) for n in (1, 2, 3, 4, 7)] == [1, 1, 1, 2, 5]
    assert _chunks(spark, _s(5), 3, 2) == [(0, "s0. s1. s2."), (1, "s2. s3. s4.")]
    assert _chunks(spark, _s(6), 3, 2) == [(0, "s0. s1. s2."), (1, "s2. s3. s4."), (2, "s3. s4. s5.")]
    assert _chunks(spark, "One!  Two?\nThree") == [(0, "One! Two? Three")]


CATALOG = "label string, id string, name string, n int"


@pytest.fixture(scope="module")
def cat(spark):
    rows = [("Product", "PRD001", "Oat Milk", 0), ("Product", "PRD002", "Oat", 0), ("Supplier", "SUP9", "oat milk", 1), ("Line", "L1", "AB", 2), ("Region", "R1", None, 3)]
    return spark.createDataFrame(rows, CATALOG).select("label", "id", "name", F.struct("n", "id").alias("ord"))


def test_linking(spark, cat, rows):
    texts = spark.createDataFrame([("a", "see prd001, XPRD002 and OAT MILK"), ("b", None), ("c", ""), ("d", "goats like r1")], "k string, t string")
    assert rows(C.link_ids(texts, "k", "t", cat)) == [("a", "Product", "PRD001"), ("d", "Region", "R1")]
    got = {(r.k, r.id): r.match for r in C.link_entities(texts, "k", "t", cat).collect()}
    assert got == {("a", "PRD001"): "id", ("a", "PRD002"): "name", ("a", "SUP9"): "name", ("d", "PRD002"): "name", ("d", "R1"): "id"}
    online = {(r.k, r.id) for r in C.link_online(texts, "k", "t", cat).collect()}
    assert online == {("a", "PRD001"), ("a", "SUP9"), ("d", "R1")}  # names of four or more, the last of equal names
    assert rows(C.enough_candidates(C.link_entities(texts, "k", "t", cat), "k")) == [("a", 3), ("d", 2)]


def test_ids_of_letters_only_are_linked(spark, cat, rows):
    more = cat.select("label", "id", "name").unionByName(spark.createDataFrame([("Region", "WEST", None)], "label string, id string, name string"))
    texts = spark.createDataFrame([("a", "the west and PRD001"), ("b", "western")], "k string, t string")
    assert rows(C.link_ids(texts, "k", "t", more)) == [("a", "Product", "PRD001"), ("a", "Region", "WEST")]


def test_ids_of_any_kind_are_linked(spark, rows):
    for ids in (["7"], ["7", "A1B"], ["AB", "42"], ["Ü1", "é"], ["İ9"], []):
        known = spark.createDataFrame([("L", i) for i in ids], "label string, id string")
        texts = spark.createDataFrame([("a", "7 x a1b ab 42"), ("b", "77 a1bc ü1 É abc 4"), ("c", "i̇9 İ9")], "k string, t string")
        low = {i: i.lower() for i in ids}
        want = [(k, "L", i) for k, t in rows(texts) for i in ids if low[i] in t.lower().split()]
        assert rows(C.link_ids(texts, "k", "t", known)) == sorted(want, key=str)


def test_resolution_cascade(spark, cat):
    values = spark.createDataFrame([(v,) for v in (" prd001", "OAT MILK", "oat milk 1l", "milk", "Mi", "ab", "cable", None, "oat")], "value string")
    got = {r.value: (r.id, r.how) for r in C.resolve_values(values, "value", cat).collect()}
    assert got[" prd001"] == ("PRD001", "id") and got["OAT MILK"] == ("PRD001", "name") and got["oat"] == ("PRD002", "name") and got["ab"] == ("L1", "name")
    assert got["oat milk 1l"] == ("PRD001", "partial") and got["milk"] == ("PRD001", "partial")
    assert got["cable"] == ("L1", "partial") and got["Mi"] == (None, "none") and None not in got


def test_entity_keys(spark, rows):
    df = spark.createDataFrame([("Oat-Milk  1L", 2), ("oat milk 1l!", 1), ("x", 3), ("é", 4)], "s string, o int")
    assert rows(df.select(C.entity_key("s"))) == [("",), ("oat milk 1l",), ("oat milk 1l",), ("x",)]
    assert rows(C.register_extracted(df, "s", "o")) == [("X_oat_milk_1l", "oat milk 1l!")]
    assert len(spark.range(1).select(C.synthetic_id(F.lit("a " * 60))).first()[0]) == 50


def test_id_tokens(spark, rows):
    df = spark.createDataFrame([("a", "AE001 C001 toolongx99 AE001 ab12")], "k string, t string")
    assert rows(C.id_tokens(df, "k", "t")) == [("a", "AE001"), ("a", "ab12"), ("a", "olongx99")]


@pytest.mark.parametrize(
    ("raw", "key", "want"),
    [
        ('```json\n{"a": 1}\n```', None, {"a": 1}),
        ("[1, 2]", "triples", {"triples": [1, 2]}),
        ("[1]", None, {"items": [1]}),
        ('{"rows": [1], "n": 2}', "triples", {"triples": [1]}),
        ('{"n": 2}', "triples", {"n": 2}),
        ('sure: [{"x": 1}] done', "t", {"t": [{"x": 1}]}),
        ('sure: {"x": 1} done', None, {"x": 1}),
        ("nothing", "t", {"t": []}),
        ("", None, {}),
        (None, "t", {"t": []}),
    ],
)
def test_json_repair(raw, key, want):
    assert read_json(raw, key) == want


def test_json_column(spark):
    df = spark.createDataFrame([("[1]",), (None,)], "s string")
    assert [r[0] for r in df.select(repaired_json("s", "t")).collect()] == ['{"t": [1]}', '{"t": []}']
