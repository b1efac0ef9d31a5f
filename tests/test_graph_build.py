import datetime as dt

from pyspark.sql import functions as F

from weftgraph.operators import graph_build as B
from weftgraph.operators.specs import FkSpec, JunctionSpec, LinkSpec, NodeSpec
from weftgraph.plans import introspect
from weftgraph.sources.tables import read_csv, read_jsonl

T = dt.datetime


def _nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_csv_with_mark_and_jsonl_with_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,name\r\nA1,"x, ""y"""\r\nA2,\r\n'.encode())
    got = read_csv(spark, str(tmp_path / "a.csv"), "id string, name string")
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [("A1", 'x, "y"'), ("A2", None)]
    (tmp_path / "b.jsonl").write_text('{"q": "a"}\n\n  \n{"q": "b"}\n')
    assert sorted(r.q for r in read_jsonl(spark, str(tmp_path / "b.jsonl"), "q string").collect()) == ["a", "b"]


def test_clean_values_and_props(spark):
    df = spark.createDataFrame([("a", "2024-02-03 04:05:06", "2024-02-03T00:00", ""), ("b", "nonsense", None, "x")], "k string, at string, day string, v string")
    got = [tuple(r) for r in B.clean_values(df, ("at",), ("day",)).orderBy("k").collect()]
    assert got[0][2] == dt.date(2024, 2, 3) and got[0][3] is None and got[1][1] is None
    assert df.select(B.props(df, ("k",)).alias("p")).orderBy("k").first().p == {"at": "2024-02-03 04:05:06", "day": "2024-02-03T00:00"}


def test_upsert_takes_last_non_missing(spark, rows):
    df = spark.createDataFrame([(" p1", "old", 1, T(2020, 1, 1)), ("P1", "", 2, T(2021, 1, 1)), ("p1", "new", None, T(2022, 1, 1)), (None, "z", 1, T(2020, 1, 1)), (" ", "z", 1, T(2020, 1, 1))], "pk string, name string, n int, recorded_at timestamp_ntz")
    got = B.upsert_nodes(df, NodeSpec("P", "t", "pk", "name"), "recorded_at").select("id", "name", "n")
    assert rows(got) == [("P1", "new", 2)]
    assert B.upsert_nodes(df.limit(0), NodeSpec("P", "t", "pk"), "recorded_at").count() == 0
    assert rows(B.key_violations(df, "pk")) == [("P1", 3)]


def test_fk_edges_skip_sentinels_dangling_and_repeats(spark, rows):
    df = spark.createDataFrame([("A", "L1"), ("a", " l1"), ("B", None), ("C", "ALL"), ("D", ""), ("E", "L9")], "id string, line string")
    pairs = B.fk_edges(df, FkSpec("t", "P", "id", "line", "L", "ON"))
    assert rows(B.existing(pairs, _nodes(spark, ["L1"]))) == [("A", "L1")]


def test_junction_keeps_last_values(spark, rows):
    df = spark.createDataFrame([("O", "P", 1, None, 1), ("O", "P", None, "x", 2), ("O", "P", 3, None, 3), ("O", None, 4, "y", 4), ("O", "Z", 5, "y", 4)], "o string, p string, q int, s string, ord int")
    got = B.junction_edges(df, JunctionSpec("t", "O", "o", "P", "p", "HAS", ("q", "s")), _nodes(spark, ["O"]), _nodes(spark, ["P"]), "ord")
    assert rows(got) == [("O", "P", 3, "x")]


def test_document_links(spark, rows):
    spec = LinkSpec("t", "Document", "d", "kind", "e", "rel", {"CONTRACT": "Contract"})
    df = spark.createDataFrame([("D1", " Contract", "c1", "led to", "0.5"), ("D1", "contract", "C1", "Led-To", "bad"), ("D1", "odd", "X", None, None), ("D9", "contract", "C1", "!!", "1")], "d string, kind string, e string, rel string, confidence string")
    assert rows(B.link_edges(df, spec, "Contract", _nodes(spark, ["D1"]), _nodes(spark, ["C1"]))) == [("D1", "C1", "LED_TO", 0.5)]
    assert rows(B.deferred_links(df, spec, {"Contract"})) == [("ODD", 1)]
    assert [r[0] for r in df.select(B.rel_type_of("rel")).distinct().orderBy(F.col(df.select(B.rel_type_of("rel")).columns[0])).collect()] == ["LED_TO", "LINKS"]


def test_scope_prunes_and_keeps_the_floor():
    P = introspect.Pattern
    scope = introspect.Scope([P("A", "S", "B", "structured", 5), P("B", "X", "A", "extracted", 9), P("Contract", "COMMITS", "Product", "extracted", 2), P("A", "RARE", "C", "extracted", 1), P("A", "FINE", "C", "extracted", 3), P("D", "HAS_CHUNK", "Chunk", "unknown", 4)])
    assert scope.types == ["COMMITS", "FINE", "HAS_CHUNK", "RARE", "S"] and scope.backbone == ["S"] and scope.dropped == ["RARE"]
    assert scope.choose(["FINE", "invented"]) == ["COMMITS", "FINE", "S"]
    assert scope.choose([]) == ["COMMITS", "S"] and scope.choose(None) == ["COMMITS", "FINE", "HAS_CHUNK", "S"]
    assert scope.choose(None, "none") == scope.types and scope.choose(None, forced=["Z", "A"]) == ["A", "Z"]
    assert scope.candidates()[0].endswith("[n=4]") and scope.untyped == [("Contract", "Product")]
    assert "(A)-[:S]->(B)  origin=structured n=5" in scope.text(["S"], {"A": {"k"}}, ["Seed"])


def test_evidence_gloss_prefers_frequent_then_short(spark, rows):
    cols = "src_label string, src string, rel_type string, dst_label string, dst string, origin string, evidence string"
    data = [("A", "1", "R", "B", "1", "extracted", e) for e in ("longer text", "longer text", "short", "short", None, "")]
    assert rows(introspect.evidence_glosses(spark.createDataFrame(data, cols))) == [("R", "short")]
    long = [("A", "1", "R", "B", "1", "extracted", "x " * 80)]
    assert len(introspect.evidence_glosses(spark.createDataFrame(long, cols)).first().gloss) == 101
