"""Predicate normalisation that needs embeddings, and the choice of a mode."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.catalog import EXTRACTED
from weftgraph.operators.extraction import SENSES, fold_senses, override_by_endpoints
from weftgraph.operators.skew import salted_join
from weftgraph.operators.vector import components, knn, similar_pairs
from weftgraph.plans.introspect import pair_key
from weftgraph.providers import embed, sense_column
from weftgraph.runtime import cut

log = logging.getLogger(__name__)


def _predicate_texts(passed: DataFrame) -> DataFrame:
    """(pair, predicate, support, text, id): distinct predicates of a label pair, described with their first cue."""
    words = F.concat_ws(" ", F.element_at(F.split("pair", r"\|"), 1), F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))), F.element_at(F.split("pair", r"\|"), 2))
    cue = F.nullif(F.col("predicate_cue"), F.lit(""))
    counted = passed.withColumn("pair", pair_key("subject_label", "object_label")).groupBy("pair", F.col("canon_predicate").alias("predicate")).agg(F.count("*").alias("support"), F.min(cue).alias("cue"))
    return counted.withColumn("text", F.concat(words, F.lit(". e.g., "), F.coalesce("cue", F.lit("")))).withColumn("id", F.xxhash64("pair", "predicate"))


def _rename(passed: DataFrame, names: DataFrame) -> DataFrame:
    """Predicates replaced by (pair, predicate, canon)."""
    rows = passed.withColumn("pair", pair_key("subject_label", "object_label"))
    joined = salted_join(rows, names.select("pair", F.col("predicate").alias("canon_predicate"), "canon"), ["pair", "canon_predicate"], F.struct("source_chunk_id", "subject", "object"), how="left")
    return joined.withColumn("canon_predicate", F.coalesce("canon", "canon_predicate")).drop("pair", "canon")


def guarded_override(passed: DataFrame, embedder, tau: float = 0.55, margin: float = 0.0) -> DataFrame:
    """Predicates of the pairs with senses to the nearest sense, if its cosine is ``tau`` or more and ``margin`` ahead of the second."""
    spark = passed.sparkSession
    texts = _predicate_texts(passed)
    protos = spark.createDataFrame([("|".join(sorted(p)), name, text, n) for n, (p, name, text) in enumerate((p, name, text) for p, senses in SENSES.items() for name, text in senses)], "pair string, name string, text string, id bigint")
    made = cut(embed(texts.join(F.broadcast(protos.select("pair").distinct()), "pair", "left_semi"), "text", embedder))  # the pairs of the sense table
    sense_vectors = cut(embed(protos, "text", embedder))
    chosen = None
    for pair in sorted("|".join(sorted(p)) for p in SENSES):  # the six pairs of the sense table
        near = knn(made.filter(F.col("pair") == pair), sense_vectors.filter(F.col("pair") == pair), "id", "embedding", 2)
        top = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("sim", "id"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("b"))
        sure = top.filter((F.col("a.sim") >= tau) & (F.col("a.sim") - F.coalesce("b", F.lit(-1.0)) >= margin)).select(F.col("query_id").alias("id"), F.col("a.id").alias("sense"))
        chosen = sure if chosen is None else chosen.unionByName(sure)
    names = made.select("id", "pair", "predicate").join(chosen, "id").join(F.broadcast(protos.select(F.col("id").alias("sense"), F.col("name").alias("canon"))), "sense")  # nine senses
    return _rename(passed, names.select("pair", "predicate", "canon"))


def embed_cluster(passed: DataFrame, embedder, tau: float = 0.82) -> DataFrame:
    """Predicates of a label pair whose descriptions are alike take the name of the best supported one, then the shortest, then the first."""
    made = cut(embed(_predicate_texts(passed), "text", embedder))
    clusters = components(made.select("id"), similar_pairs(made, "id", "embedding", tau, "pair"))
    members = made.join(clusters, "id")
    best = members.groupBy("component").agg(F.max_by("predicate", F.struct("support", -F.length("predicate"), -F.col("id"))).alias("canon"))
    return _rename(passed, members.join(best, "component").select("pair", "predicate", "canon"))


def merge_entities(passed: DataFrame, embedder, tau: float = 0.86) -> DataFrame:
    """Extracted entities whose surfaces are alike become the best supported one of their cluster."""
    ends = passed.filter(F.col("subject_label") == EXTRACTED).select(F.col("subject").alias("entity"), F.col("subject_id").alias("surface")).unionByName(passed.filter(F.col("object_label") == EXTRACTED).select(F.col("object").alias("entity"), F.col("object_id").alias("surface")))
    entities = ends.groupBy("entity").agg(F.count("*").alias("support"), F.min("surface").alias("surface")).withColumn("id", F.xxhash64("entity"))
    made = cut(embed(entities, "surface", embedder))
    members = made.join(components(made.select("id"), similar_pairs(made, "id", "embedding", tau)), "id")
    best = members.groupBy("component").agg(F.max_by("entity", F.struct("support", -F.length("entity"), -F.col("id"))).alias("canon"))
    names = cut(members.join(best, "component").select("entity", "canon"))
    rows = passed
    for side in ("subject", "object"):
        rows = salted_join(rows, names.select(F.col("entity").alias(side), "canon"), [side], F.struct("source_chunk_id", "predicate_cue"), how="left").withColumn(side, F.coalesce("canon", side)).drop("canon")
    return rows


def normalise(passed: DataFrame, mode: str = "off", embedder=None, sense_provider=None, tau: float = 0.82, sense_tau: float = 0.55, sense_margin: float = 0.0) -> DataFrame:
    """off, endpoint_override, embed_cluster, guarded_override or llm_sense; a mode whose provider is missing passes everything."""
    if mode in ("embed_cluster", "guarded_override") and embedder is None:
        log.warning("%s needs an embedder; predicates stay as they are", mode)
        return passed
    if mode == "endpoint_override":
        return override_by_endpoints(passed)
    if mode == "embed_cluster":
        return embed_cluster(passed, embedder, tau)
    if mode == "guarded_override":
        return guarded_override(passed, embedder, sense_tau, sense_margin)
    if mode == "llm_sense":
        return fold_senses(passed, sense_column(sense_provider))
    if mode != "off":
        log.warning("unknown mode %s; predicates stay as they are", mode)
    return passed
