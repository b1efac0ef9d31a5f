"""Command line: build, extract, query, chunk-search and eval over a folder of parquet tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from weftgraph.operators import evaluate, extraction, graph_build
from weftgraph.pipeline import Options, documents_to_operations
from weftgraph.plans import graph_queries as G
from weftgraph.plans.pattern import Compiler
from weftgraph.runtime import cut, session
from weftgraph.sources.tables import read_jsonl, table


def _args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("folder")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="load the tables into nodes and edges")
    b.add_argument("--out")
    b.add_argument("--csv", action="store_true", help="tables are CSV files with a header")
    b.add_argument("--chunks", action="store_true", help="with the chunks as nodes")
    e = sub.add_parser("extract", help="gate, normalise, score and merge triples")
    e.add_argument("--out")
    e.add_argument("--dry", action="store_true", help="write the funnel and the quarantine only")
    e.add_argument("--tau", type=float, default=0.5)
    e.add_argument("--normalize", default="guarded_override", choices=["off", "endpoint_override", "embed_cluster", "guarded_override", "llm_sense"])
    e.add_argument("--emb-tau", type=float, default=0.82)
    e.add_argument("--sense-tau", type=float, default=0.55)
    e.add_argument("--sense-margin", type=float, default=0.0)
    e.add_argument("--entities", default="bound", choices=["bound", "open"])
    e.add_argument("--show", type=int, default=20)
    e.add_argument("--source", default="triples", choices=["documents", "chunks", "triples"])
    e.add_argument("--entity-tau", type=float, default=0.86)
    e.add_argument("--limit", type=int, help="chunks of a trial run")
    q = sub.add_parser("query", help="run one pattern query")
    q.add_argument("text")
    a = sub.add_parser("ask", help="answer a question, or questions until exit")
    a.add_argument("question", nargs="?")
    a.add_argument("--method", default="pattern", choices=["pattern", "structured", "pagerank", "keyword", "vector", "hybrid", "router"])
    a.add_argument("--eval", help="JSON lines with q, type, answer")
    a.add_argument("--k", type=int, default=6)
    a.add_argument("--retries", type=int, default=2)
    a.add_argument("--min-support", type=int, default=2)
    a.add_argument("--prune", default="llm", choices=["llm", "none"])
    a.add_argument("--no-dedup", action="store_true")
    a.add_argument("--untyped", action="store_true", help="bridge pairs without a relationship type")
    a.add_argument("--k-passages", type=int, default=12)
    a.add_argument("--m-entities", type=int, default=15)
    a.add_argument("--alpha", type=float, default=0.15)
    a.add_argument("--iterations", type=int, default=30)
    a.add_argument("--tau", "--link-tau", type=float, default=0.5)
    a.add_argument("--margin", "--link-margin", type=float, default=0.05)
    a.add_argument("--k-low", type=int, default=5)
    a.add_argument("--k-type", type=int, default=3)
    a.add_argument("--r-max", type=int, default=30)
    a.add_argument("--ent-max", type=int, default=30)
    a.add_argument("--chunk-max", type=int, default=8)
    a.add_argument("--items", action="store_true", help="a section per item in the report")
    a.add_argument("--out")
    return p.parse_args(argv)


def _retriever(spark, folder: str, a: argparse.Namespace):
    from weftgraph import retrieve as R

    graph, catalog = G.fused_graph(spark, folder), G.project_catalog(spark, folder)
    chunks = table(spark, folder, "chunks")
    pattern = lambda only=False: R.PatternRetriever(graph, catalog, chunks, retries=a.retries, least_support=a.min_support, prune=a.prune, dedup=not a.no_dedup, structured_only=only, untyped=a.untyped)
    if a.method in ("pattern", "structured"):
        return pattern(a.method == "structured")
    if a.method in ("pagerank", "keyword"):
        tables = R.GraphTables.of(graph, chunks, catalog)
        if a.method == "pagerank":
            return R.PageRankRetriever(tables, a.k_passages, a.m_entities, a.alpha, a.iterations, a.tau, a.margin)
        return R.KeywordRetriever(tables, a.k_low, a.k_type, a.r_max, a.ent_max, a.chunk_max, a.tau, a.margin)
    passages = R.VectorRetriever(chunks, a.k)
    if a.method == "vector":
        return passages
    hybrid = R.HybridRetriever(pattern(True), passages)
    return hybrid if a.method == "hybrid" else R.Router(hybrid)


def main(argv: list[str] | None = None) -> int:
    a = _args(sys.argv[1:] if argv is None else argv)
    spark = session(a.master)
    if a.command == "build":
        graph = graph_build.supply_chain(spark, a.folder, a.csv)
        if a.chunks:
            graph = graph_build.with_chunks(graph, table(spark, a.folder, "chunks"))
        edges = cut(graph.all_edges())
        for r in graph_build.report(edges).orderBy("rel_type", "origin").collect():  # one row per relationship
            print(*r)
        print("not delivered:", *graph.skipped)
        if a.out:
            graph.all_nodes().write.mode("overwrite").partitionBy("label").parquet(f"{a.out}/nodes")
            edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{a.out}/edges")
    elif a.command == "extract":
        options = Options(a.source, a.entities, a.normalize, a.tau, a.emb_tau, a.entity_tau, a.sense_tau, a.sense_margin, a.limit)
        gated, ops = documents_to_operations(spark, a.folder, options)
        print(json.dumps(extraction.funnel(gated).first().asDict()))
        for r in extraction.promoted_by_relation(ops).orderBy(F.desc("n_edges"), "rel_type").limit(a.show).collect():
            print(*r)
        if a.out:
            extraction.funnel(gated).write.mode("overwrite").json(f"{a.out}/funnel")
            extraction.quarantine(gated).write.mode("overwrite").json(f"{a.out}/quarantine")
            if not a.dry:
                merged = extraction.upsert(graph_build.supply_chain(spark, a.folder).all_edges(), ops)
                merged.write.mode("overwrite").partitionBy("rel_type").parquet(f"{a.out}/edges")
    elif a.command == "query":
        Compiler(G.fused_graph(spark, a.folder)).run(a.text).show(50, truncate=False)
    else:
        from weftgraph import retrieve as R

        retriever = _retriever(spark, a.folder, a)
        if a.eval:
            items = [r.asDict() for r in read_jsonl(spark, a.eval, "item_id bigint, q string, type string, answer string").collect()]  # the evaluation set
            graded = cut(evaluate.grade(R.run_items(spark, items, retriever), "answer", "gold"))
            print(R.markdown_report(graded, a.method, a.items))
            if a.out:
                graded.write.mode("overwrite").json(a.out)
        else:
            for question in [a.question] if a.question else iter(lambda: input("question> "), "exit"):
                found = retriever.retrieve(question)
                print(found if isinstance(found, list) else found.context)
    return 0


if __name__ == "__main__":
    sys.exit(main())
