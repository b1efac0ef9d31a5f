"""From documents to edges in one run: chunks, links, extraction, gates, names, confidence, merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import catalog as C
from weftgraph.operators import chunking, extraction
from weftgraph.operators.normalize import merge_entities, normalise
from weftgraph.operators.skew import salted_join
from weftgraph.plans import graph_queries as G
from weftgraph.providers import HashEmbedder, TemplateExtractor, extract_triples
from weftgraph.runtime import cut
from weftgraph.sources.tables import table


@dataclass(frozen=True)
class Options:
    """``source``: documents (chunked here), chunks or triples (as delivered). ``limit`` bounds the chunks of a trial run."""

    source: str = "triples"
    entities: str = "bound"
    normalize: str = "guarded_override"
    tau: float = 0.5
    emb_tau: float = 0.82
    entity_tau: float = 0.86
    sense_tau: float = 0.55
    sense_margin: float = 0.0
    limit: int | None = None


def raw_triples(spark: SparkSession, folder: str, known: DataFrame, options: Options, extractor=TemplateExtractor()) -> DataFrame:
    """The triples as delivered, or as ``extractor`` finds them in the chunks that name two or more known entities."""
    if options.source == "triples":
        return table(spark, folder, "extracted_triples")
    if options.source == "documents":
        chunks = cut(chunking.chunk_corpus(table(spark, folder, "documents")))
    else:
        chunks = table(spark, folder, "chunks")
    chunks = chunks.select("chunk_id", "doc_id", "text").filter("chunk_id is not null and text is not null").distinct()
    links = C.link_entities(chunks, "chunk_id", "text", known)
    named = salted_join(links, known.select("label", "id", "name"), ["label", "id"], F.col("chunk_id"), how="left")
    return extract_triples(chunks, named, extractor, limit=options.limit)


def documents_to_operations(spark: SparkSession, folder: str, options: Options = Options(), extractor=TemplateExtractor(), embedder=HashEmbedder(), sense=None) -> tuple[DataFrame, DataFrame]:
    """(gated triples, edge operations) of a folder; in open mode unknown entities are kept and merged by likeness."""
    known = G.project_catalog(spark, folder)
    open_ = options.entities == "open"
    gated = extraction.gate(raw_triples(spark, folder, known, options, extractor), known, open_)
    passed = gated.filter("gate = 'pass'")
    if open_ and embedder is not None:
        passed = merge_entities(passed, embedder, options.entity_tau)
    named = normalise(passed, options.normalize, embedder, sense, options.emb_tau, options.sense_tau, options.sense_margin)
    return gated, cut(extraction.promoted_operations(extraction.score(cut(named), config=extraction.Confidence(tau=options.tau))))
