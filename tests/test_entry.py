import ast
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_names_and_sql_match():
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values())
    names = [n for m in entry._modules() for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_core_does_not_import_the_llm_package():
    for path in (ROOT / "weftgraph").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("weftgraph.llm") for n in names), path


def test_entry_works_without_the_llm_package(tmp_path):
    code = "import sys; sys.modules['weftgraph.llm'] = None; sys.modules['weftgraph.llm.queries'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('p1_') for n in q), 'p2_found' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert re.search(r"\d+ False True", out.stdout), out.stderr


def test_no_local_checkpoints_or_process_paths():
    for path in [*(ROOT / "weftgraph").rglob("*.py"), ROOT / "__spark_entry__.py"]:
        assert "localCheckpoint" not in path.read_text()


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["orderkey", "nation", "segment", "price", "year"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "graph_fk_edges", "path_optional", "path_untyped", "triples_gated", "confidence_scores", "upsert_corroboration", "ppr_passages", "knn_exact", "cluster_components", "accuracy_by_type"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    df = entry.queries()[name](spark, DATA).select(*columns)
    value = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(value, r)) for r in df.collect()) == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())


def _dense_walk(nodes, edges, seeds, iterations):
    """{(question, node): score} of the walk over all nodes at once."""
    import numpy as np

    at = {n: i for i, n in enumerate(dict.fromkeys([*nodes, *(x for e in edges for x in e)]))}
    a, b = np.array([at[x] for x, y in edges for x in (x, y)]), np.array([at[y] for x, y in edges for y in (y, x)])
    degree = np.bincount(a, minlength=len(at))
    out = {}
    for q in sorted({q for q, _ in seeds}):
        home = np.zeros(len(at))
        home[[at[n] for n in {n for k, n in seeds if k == q} & nodes]] = 1
        p = home = home / home.sum()
        for _ in range(iterations):
            p = 0.15 * home + 0.85 * (np.bincount(b, p[a] / degree[a], len(at)) + p[degree == 0].sum() * home)
        out |= {(q, n): p[i] for n, i in at.items() if p[i] > 0}
    return out


@needs_data
def test_full_walks_equal_dense_iteration(spark):
    from weftgraph.operators import graph_algo as A
    from weftgraph.plans import retrieval_queries as Q

    n, e = Q._fused(spark, DATA)
    nodes, edges = {f"{r.label}:{r.id}" for r in n.collect()}, A.keyed_edges(e).select("s", "rel_type", "t").collect()
    want = _dense_walk(nodes, [(r.s, r.t) for r in edges], Q.SEEDS, 30)
    got = {(r.question_id, r.node): r.score for r in Q.ppr_scores(spark, DATA).collect()}
    assert got == pytest.approx(want, abs=2e-9)
    top = {q: sorted(((round(v, 10), n) for (k, n), v in want.items() if k == q and not n.startswith("Document:")), reverse=True)[:15] for q in (1, 2)}
    assert sorted((r.question_id, r["rank"], r.node) for r in Q.ppr_top_entities(spark, DATA).collect()) == [(q, i + 1, n) for q in (1, 2) for i, (_, n) in enumerate(top[q])]
    chosen = {(q, n) for q in (1, 2) for _, n in top[q]}
    assert sorted(map(tuple, Q.induced_edges(spark, DATA).collect())) == sorted((q, r.s, r.rel_type, r.t) for q in (1, 2) for r in edges if {(q, r.s), (q, r.t)} <= chosen)


@needs_data
@pytest.mark.parametrize("name", ["chunk_members", "one_hop_ranked", "entity_expand", "chunk_overlap"])
def test_fused_query_equals_sql(spark, name):
    test_query_equals_sql(spark, name)


@needs_data
def test_members_hold_what_only_texts_say(spark):
    from weftgraph.plans import retrieval_queries as Q

    edges = Q._fused(spark, DATA)[1].filter("origin = 'extracted'")
    chunk = edges.selectExpr("source_chunk_id as chunk_id", "concat(src_label, ':', src) as node")
    known = spark.read.parquet(f"{DATA}/chunks.parquet").select("chunk_id").distinct()
    wanted = chunk.join(known, "chunk_id").distinct()
    assert wanted.count() > 0 and wanted.join(Q.chunk_members(spark, DATA), ["chunk_id", "node"], "left_anti").isEmpty()


@needs_data
def test_retrievers_answer(spark):
    from weftgraph import retrieve as R
    from weftgraph.operators import evaluate
    from weftgraph.plans import graph_queries as G
    from weftgraph.sources.tables import table

    graph, catalog, chunks = G.fused_graph(spark, DATA), G.project_catalog(spark, DATA), table(spark, DATA, "chunks")
    retriever = R.PatternRetriever(graph, catalog, chunks)
    supplier = retriever.compiler.run("MATCH (po:PurchaseOrder)-[:FROM_SUPPLIER]-(s:Supplier) RETURN s.supplier_id AS id ORDER BY id LIMIT 1").first()[0]
    found = retriever.retrieve(f"Which purchase order was placed with {supplier}?")
    assert found.facts and found.meta["attempts"] == 1 and ("Supplier", supplier) in found.meta["seeds"]
    bad = retriever.retrieve("x", force_query="MATCH (s:Supplier)-[:NOPE]-(p:Product) RETURN s.supplier_id AS id")
    assert bad.context == "(no valid query)" and "NOPE" in bad.meta["error"]
    tables = R.GraphTables.of(graph, chunks, catalog)
    ranked = R.PageRankRetriever(tables, iterations=2).retrieve(f"Tell me about {supplier}")
    assert ranked.facts and f"Supplier:{supplier}" in ranked.meta["seeds"]
    words = R.KeywordRetriever(tables).retrieve(f"Which orders mention {supplier}?")
    assert f"Supplier:{supplier}" in words.meta["seeds"] and words.meta["types"]
    assert R.PageRankRetriever(tables).retrieve("nothing to see").context == "(no results)"
    vectors = R.VectorRetriever(chunks, 3)
    hits = vectors.retrieve("an expired certificate")
    assert len(hits) == 3 and hits[0]["distance"] <= hits[-1]["distance"]
    router = R.Router(R.HybridRetriever(R.PatternRetriever(graph, catalog, chunks, structured_only=True), vectors))
    assert router.retrieve(f"How many orders from {supplier}?").meta["route"] == "DB"
    items = [{"item_id": 1, "q": f"How many orders from {supplier}?", "type": "t", "answer": "PO"}, {"item_id": 2, "type": "t"}]
    graded = evaluate.grade(R.run_items(spark, items, router), "answer", "gold")
    assert "| * |" in R.markdown_report(graded, "run") and graded.filter("error is not null").count() == 1


@needs_data
def test_command_line(spark, tmp_path, capsys):
    from weftgraph.__main__ import main

    assert main(["--master", "local[4]", DATA, "build", "--out", str(tmp_path / "g")]) == 0
    assert "SUPPLIED_BY structured" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() > 0
    assert main([DATA, "extract", "--dry", "--normalize", "endpoint_override", "--out", str(tmp_path / "e")]) == 0
    assert spark.read.json(str(tmp_path / "e/funnel")).count() == 1 and not (tmp_path / "e/edges").exists()
    assert main([DATA, "query", "MATCH (p:Product)-[:SUPPLIED_BY]-(s:Supplier) RETURN count(*) AS n"]) == 0


@needs_data
def test_documents_to_edges_with_a_scripted_model(spark, tmp_path):
    from weftgraph import providers as P
    from weftgraph.operators import extraction
    from weftgraph.pipeline import Options, documents_to_operations

    def scripted(messages, schema):
        """Relates the first two records of the list."""
        import json

        ids = [x[2:].split(" ")[0] for x in messages[-1]["content"].splitlines() if x.startswith("- ")]
        return json.dumps({"triples": [{"subject_id": ids[0], "predicate": "goes with", "object_id": ids[1], "evidence": ids[0]}]})

    gated, ops = documents_to_operations(spark, DATA, Options(source="documents", normalize="endpoint_override", limit=40), P.ModelExtractor(P.Model(scripted)))
    n = extraction.funnel(gated).first()
    assert n.raw > 0 and n.resolved > 0 and ops.filter("rel_type = 'GOES_WITH'").count() > 0
    merged = extraction.upsert(spark.createDataFrame([], "src_label string, src string, rel_type string, dst_label string, dst string, origin string, confidence double, source_doc string, source_chunk_id string, evidence string, doc_corroborations bigint"), ops)
    assert merged.count() == ops.select("src", "rel_type", "dst", "src_label", "dst_label").distinct().count()


@needs_data
def test_open_mode_and_csv_build(spark, tmp_path):
    from weftgraph.__main__ import main

    assert main([DATA, "extract", "--entities", "open", "--normalize", "off", "--entity-tau", "0.9", "--out", str(tmp_path / "e")]) == 0
    edges = spark.read.parquet(str(tmp_path / "e/edges"))
    assert edges.filter("src_label = 'ExtractedEntity' or dst_label = 'ExtractedEntity'").count() > 0
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "products.csv").write_text("\ufeffproduct_id,line_id,product_name,unit_cost\nP1,L1,Oat,1.5\nP2,ALL,,x\n", encoding="utf-8")
    (folder / "production_lines.csv").write_text("\ufeffline_name,line_id\nNorth,l1\n", encoding="utf-8")
    (folder / "product_suppliers.csv").write_text("product_id,supplier_id,is_primary,valid_from,valid_to,supplier_part_no,contract_unit_cost,minimum_order_qty\nP1,S1,true,2020-01-01,,,2.5,3\n")
    assert main([str(folder), "build", "--csv", "--out", str(tmp_path / "g")]) == 0
    got = spark.read.parquet(str(tmp_path / "g/edges")).select("src", "rel_type", "dst").collect()
    assert sorted(map(tuple, got)) == [("P1", "ON_LINE", "L1"), ("P1", "SUPPLIED_BY", "S1")]


@needs_data
def test_untyped_bridges_and_chunks_as_nodes(spark):
    from weftgraph import retrieve as R
    from weftgraph.operators import graph_build
    from weftgraph.plans import graph_queries as G
    from weftgraph.sources.tables import table

    graph, chunks = graph_build.with_chunks(G.fused_graph(spark, DATA), table(spark, DATA, "chunks")), table(spark, DATA, "chunks")
    retriever = R.PatternRetriever(graph, G.project_catalog(spark, DATA), chunks, untyped=True)
    pair = retriever.compiler.run("MATCH (c:Contract)-[r]-(p:Product) WHERE r.origin = 'extracted' RETURN c.contract_id AS c, p.product_id AS p ORDER BY c, p LIMIT 1").first()
    found = retriever.retrieve(f"Which product does contract {pair.c} name?")
    assert "-[r1]-" in found.query and {"id": pair.p} in found.facts and "match them without a type" in found.meta["schema"]
    n = retriever.compiler.run("MATCH (d:Document)-[:HAS_CHUNK]-(k:Chunk) RETURN count(*) AS n").first().n
    assert n == graph_build.chunk_edges(chunks, graph.nodes["Document"]).count() > 0


@needs_data
def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate(); print('ROWS', e.queries()['p3_found'](s, {DATA!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert re.search(r"ROWS [1-9]", out.stdout), out.stderr[-2000:]
