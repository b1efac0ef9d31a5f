import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import evaluate as E
from weftgraph.operators import graph_algo as A
from weftgraph.operators import vector as V
from weftgraph.operators.graph_build import EDGE_COLUMNS

EDGE = "src_label string, src string, rel_type string, dst_label string, dst string, origin string, confidence double, source_doc string, source_chunk_id string, evidence string, doc_corroborations bigint"


def edges(spark, pairs, **more):
    rows = [(a[0], a[2:], t, b[0], b[2:], o, c, None, k, None, None) for a, t, b, o, c, k in pairs]
    return spark.createDataFrame(rows, EDGE).select(*EDGE_COLUMNS)


def simple(spark, pairs):
    return edges(spark, [(a, "R", b, "structured", None, None) for a, b in pairs])


def nodes(spark, names):
    return spark.createDataFrame([(n[0], n[2:]) for n in names], "label string, id string")


def brute_pagerank(pairs, names, seeds, alpha=0.15, iterations=30):
    seeds = [s for s in dict.fromkeys(seeds) if s in names]
    if not seeds:
        return {}
    near = {n: [] for n in names}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    p = {n: seeds.count(n) / len(seeds) for n in names}
    home = dict(p)
    for _ in range(iterations):
        q = {n: alpha * home[n] for n in names}
        for n in names:
            for o in near[n]:
                q[o] += (1 - alpha) * p[n] / len(near[n])
            if not near[n]:
                for s in names:
                    q[s] += (1 - alpha) * p[n] * home[s]
        p = q
    return {n: v for n, v in p.items() if v > 0}


def test_pagerank_equals_dense_iteration(spark):
    rng = random.Random(5)
    names = [f"N:{i}" for i in range(14)]
    pairs = [("N:0", names[rng.randrange(1, 12)]) for _ in range(12)] + [(rng.choice(names[:12]), rng.choice(names[:12])) for _ in range(10)] + [("N:3", "N:3")]
    seeds = [(1, "N:0"), (1, "N:5"), (1, "N:5"), (2, "N:13"), (3, "N:99")]
    got = A.pagerank(simple(spark, pairs), spark.createDataFrame(seeds, "question_id int, node string"), nodes(spark, names), iterations=4).collect()
    for q in (1, 2, 3):
        mine = {r.node: r.score for r in got if r.question_id == q}
        want = brute_pagerank(pairs, names, [n for k, n in seeds if k == q], iterations=4)
        assert mine == pytest.approx(want)
        assert not mine or sum(mine.values()) == pytest.approx(1.0)
    assert {r.node: r.score for r in got if r.question_id == 2} == {"N:13": pytest.approx(1.0)}  # an isolated seed keeps all


def test_parallel_edges_weigh_double(spark):
    got = {r.node: r.score for r in A.pagerank(simple(spark, [("N:a", "N:b"), ("N:a", "N:b"), ("N:a", "N:c")]), spark.createDataFrame([(1, "N:a")], "question_id int, node string"), nodes(spark, ["N:a", "N:b", "N:c"]), iterations=1).collect()}
    assert got["N:b"] == pytest.approx(2 * got["N:c"])


def test_members_passages_neighbourhood(spark, rows):
    e = spark.createDataFrame([("Document", "D1", "DESCRIBES", "Contract", "CTR001", "document_link", None, None, None, None, None), ("Order", "PO12", "LED_TO", "Contract", "CTR001", "extracted", 0.7, "D1", "D1#c0", "e", None), ("Order", "PO12", "FROM", "Supplier", "SUP77", "structured", None, None, None, None, None)], EDGE)
    n = spark.createDataFrame([("Document", "D1"), ("Contract", "CTR001"), ("Order", "PO12"), ("Supplier", "SUP77")], "label string, id string")
    chunks = spark.createDataFrame([("D1#c0", "d1", "SUP77 sup77"), ("D1#c0", "d1", "SUP77 sup77"), ("D1#c1", "D1", None), ("D9#c0", "D9", "PO12")], "chunk_id string, doc_id string, text string")
    m = A.chunk_members(chunks, e, n)
    assert rows(m) == [("D1#c0", "Contract:CTR001"), ("D1#c0", "Document:D1"), ("D1#c0", "Order:PO12"), ("D1#c0", "Supplier:SUP77"), ("D1#c1", "Contract:CTR001"), ("D1#c1", "Document:D1"), ("D9#c0", "Order:PO12")]
    seeds = spark.createDataFrame([(1, "Order:PO12", 0)], "question_id int, node string, ord int")
    hop = A.one_hop(e, seeds, ["LED_TO"])
    assert [(r.rel_type, r.score) for r in hop.orderBy("rank").collect()] == [("LED_TO", 2.7), ("FROM", 1.0)]
    ent = A.expand_entities(seeds, hop)
    assert [r.node for r in ent.orderBy("rank").collect()] == ["Order:PO12", "Contract:CTR001", "Supplier:SUP77"]
    assert [(r.chunk_id, r.n_shared) for r in A.overlap_chunks(m, ent, hop).orderBy("rank").collect()] == [("D1#c0", 3), ("D9#c0", 1), ("D1#c1", 1)]
    assert A.induced_edges(e, ent.select("question_id", "node")).count() == 2
    ranks = spark.createDataFrame([(1, "Order:PO12", 0.5), (1, "Document:D1", 0.25), (1, "Supplier:SUP77", 0.25)], "question_id int, node string, score double")
    assert [(r.chunk_id, r.score) for r in A.rank_passages(ranks, m, 2).orderBy("rank").collect()] == [("D1#c0", 1.0), ("D9#c0", 0.5)]
    assert [r.node for r in A.rank_entities(ranks).orderBy("rank").collect()] == ["Order:PO12", "Supplier:SUP77"]


# ---------------------------------------------------------------- vectors


def _vectors(spark, n=300, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    m = np.vstack([rng.normal(size=(n // 4, dim)) * 0.3 + rng.normal(size=dim) for _ in range(4)])
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<float>")


def test_knn_equals_brute_force_and_index_recalls(spark):
    m, df = _vectors(spark)
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {}
    for q in range(0, 300, 20):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        want[q] = sorted(range(300), key=lambda i: (-s[i], i))[:5]
    queries = df.filter("id % 20 = 0")
    got: dict = {}
    for r in V.knn(queries, df, "id", "v", 5, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    found = {(r.query_id, r.id) for r in V.InvertedFile(df, "id", "v", cells=12).search(queries, 5, probes=6, exclude_self=True).collect()}
    assert sum((q, i) in found for q in want for i in want[q]) / 75 >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_registered_index_search_equals_exact_search(spark):
    from weftgraph.plans import retrieval_queries as Q

    got, want = (sorted((r.query_id, r.rank, r.id, round(r.sim, 6)) for r in f(spark, "/root/testdata/sf0.1").collect()) for f in (Q.knn_index, Q.knn_exact))
    assert got == want


def test_index_search_goes_on_beyond_the_probes(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*rng.normal(size=(200, 24)).tolist(), [0.0] * 24])], "id bigint, v array<double>")
    queries = df.filter("id % 20 = 0")
    got, want = (sorted((r.query_id, r.rank, r.id) for r in x.collect()) for x in (V.InvertedFile(df, "id", "v", cells=10).search(queries, 5, probes=2), V.knn(queries, df, "id", "v", 5)))
    assert got == want


def test_knn_odd_vectors_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, 0.0])], "id bigint, v array<float>")
    got = [(r.id, r.sim) for r in V.knn(df.filter("id = 1"), df, "id", "v", 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (6, 1.0)]
    assert V.knn(df.limit(0), df, "id", "v").count() == 0
    assert [round(x, 3) for x in df.filter("id = 3").select(V.unit("v")).first()[0]] == [0.0, 0.0]


def test_near_copies_are_cut_by_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])] + [(i, [1.0, 1e-7 * (41 - i)]) for i in range(1, 41)], "id bigint, v array<double>")  # all 1.0 once rounded, greater ids nearer before
    query = df.filter("id = 0")
    for got in (V.knn(query, df, "id", "v", 3, exclude_self=True), V.InvertedFile(df, "id", "v", cells=4).search(query, 3, probes=2, exclude_self=True)):
        assert [(r.id, r.sim) for r in got.orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_gate(spark):
    near = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.7, 2), (1, 3, 0.2, 3), (2, 1, 0.9, 1), (2, 2, 0.89, 2), (3, 1, 0.4, 1), (4, 1, 0.6, 1)], "query_id int, id int, sim double, rank int")
    assert sorted((r.query_id, r.id) for r in V.gated(near).collect()) == [(1, 1), (1, 2), (4, 1)]


def test_components_and_canonical_names(spark):
    rng = random.Random(1)
    n = spark.range(60)
    pairs = [(i, i + 1) for i in range(0, 20)] + [(30, rng.randrange(31, 40)) for _ in range(9)] + [(31, 32)]
    got = {r.id: r.component for r in V.components(n, spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in range(60)}
    members = spark.createDataFrame([("g", 1, "LONG_NAME", 2, 0), ("g", 1, "SHORT", 2, 1), ("g", 1, "OTHER", 2, 2), ("g", 2, "X", 1, 3)], "group string, component int, name string, support int, ord int")
    assert {(r.component, r.canon) for r in V.canonical_members(members).collect()} == {(1, "SHORT"), (2, "X")}


def test_similar_pairs_within_group(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0], "b"), (4, [0.0, 1.0], "a")], "id bigint, v array<double>, g string")
    assert [tuple(r) for r in V.similar_pairs(df, "id", "v", 0.9, "g").collect()] == [(1, 2)]


# ---------------------------------------------------------------- grading


def test_polarity_and_grade(spark):
    cases = [("Yes, it is listed.", "YES"), ("No, it is not.", "NO"), ("I cannot determine that. Yes?", "ABSTAIN"), ("A yes or no answer: yes", "YES"), ("Yes and no", "UNCLEAR"), ("nothing here", "UNCLEAR"), (None, "UNCLEAR"), ("nobody knows", "UNCLEAR"), ("There are no results", "ABSTAIN")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    assert [r[0] for r in df.orderBy("i").select(E.polarity("a")).collect()] == [p for _, p in cases]
    items = [(1, "SUP1 and lathe", "SUP1;EQ2", "PASS"), (2, "SUP1", "SUP1;EQ2", "FAIL"), (3, "x", None, None), (4, "x", " ", None), (5, "cannot say", "NO", "PASS"), (6, "yes", "no", "FAIL"), (7, "yes", "Yes", "PASS"), (8, None, "A", "FAIL"), (9, "sup1", "SUP1", "PASS")]
    res = spark.createDataFrame([(i, a, g) for i, a, g, _ in items], "item_id int, a string, g string")
    graded = E.grade(res, "a", "g", spark.createDataFrame([("EQ2", "Lathe")], "id string, name string"))
    assert {r.item_id: r.verdict for r in graded.collect()} == {i: v for i, _, _, v in items}
    strict = E.grade(res.filter("item_id = 5"), "a", "g", lenient=False)
    assert strict.first().verdict == "FAIL"


@pytest.mark.parametrize(("n", "index"), [(1, 0), (2, 0), (20, 18), (171, 161)])
def test_p95_rank(spark, n, index):
    r = E.latency(spark.range(n).select(F.col("id").cast("double").alias("s")), "s").first()
    assert r.p95 == index and r.median == (n - 1) / 2 and r.n == n


def test_summaries(spark):
    res = spark.createDataFrame([("a", "PASS", "DB"), ("a", "FAIL", "Doc"), (None, "ERROR", None), ("b", None, "odd")], "type string, verdict string, route string")
    acc = {r.kind: (r.graded, r.passed, r.accuracy, r.errors) for r in E.accuracy(res).collect()}
    assert acc == {"a": (2, 1, 0.5, 0), "?": (0, 0, None, 1), "b": (0, 0, None, 0), "*": (2, 1, 0.5, 1)}
    tab = {r.kind: (r.DB, r.Doc, r.other) for r in E.routing_crosstab(res).collect()}
    assert tab == {"a": (1, 1, 0), "?": (0, 0, 1), "b": (0, 0, 1)}
    runs = spark.createDataFrame([(1, None, 0, 2, 4), (3, "e", 5, 4, 4), (None, None, None, None, 0)], "attempts int, error string, n_facts int, n_pruned int, n_all_types int")
    r = E.run_summary(runs).first()
    assert (r.n, r.attempts_mean, r.attempts_max, r.retry_rate, r.error_rate, r.empty_rate, r.prune_ratio) == (3, 2.0, 3, 0.5, 0.333, 0.5, 0.75)


def test_router_ties(spark):
    one = spark.range(1)
    pick = lambda **s: one.select(E.argmax_path({k: F.lit(v) for k, v in s.items()})).first()[0]
    assert pick(DB=0, Doc=0, Hybrid=0, LLM=0) == "Hybrid" and pick(DB=3, Doc=3) == "DB" and pick(Doc=1, LLM=1) == "Doc" and pick(LLM=2) == "LLM" and pick(DB=None, LLM="1") == "LLM"


def test_vectors_of_another_length_never_hide_the_rest(spark):
    rows = [(0, [1.0, 0.5])] + [(i, [float(i), 1.0, 0.0]) for i in range(1, 10)] + [(10, None), (11, []), (12, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1)
    q = spark.createDataFrame([(5, [5.0, 1.0, 0.0]), (0, [1.0, 0.5])], "id bigint, v array<double>")
    want = {(5, 5), (5, 6), (5, 4), (0, 0), (0, 12)}
    assert {(r.query_id, r.id) for r in V.knn(q, df, "id", "v", 3).collect()} == want
    assert {(r.query_id, r.id) for r in V.InvertedFile(df, "id", "v", cells=3).search(q, 3, probes=1).collect()} == want
    assert {(r.a, r.b) for r in V.similar_pairs(df, "id", "v", 0.999).collect()} >= {(8, 9)}
    named = df.withColumn("id", F.concat(F.lit("k"), "id"))
    assert {(r.query_id, r.id) for r in V.knn(q.withColumn("id", F.concat(F.lit("k"), "id")), named, "id", "v", 3).collect()} == {(f"k{a}", f"k{b}") for a, b in want}
    assert {(r.a, r.b) for r in V.similar_pairs(named, "id", "v", 0.999).collect()} >= {("k8", "k9")}


def test_latency_by_rank_over_ranges(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), round(rng.expovariate(1), 2)) for _ in range(700)] + [("c", 1.0), ("a", None)]
    got = {r.k: (r.n, r.mean, r.median, r.p95, r.total) for r in E.latency(spark.createDataFrame(data, "k string, s double"), "s", "k").collect()}
    for k in ("a", "b", "c", None):
        v = sorted(s for g, s in data if g == k and s is not None)
        assert got[k] == (len(v), round(float(np.mean(v)), 3), round(float(np.median(v)), 3), round(v[max(0, int(0.95 * len(v)) - 1)], 2), round(sum(v), 1))
    assert E.latency(spark.createDataFrame([], "k string, s double"), "s").count() == 0
