"""Graph algorithms over the generic edges: membership, personalised PageRank, neighbourhoods.

A node is ``label:id``. Edges are undirected and parallel edges count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from weftgraph.functions.keys import real_key
from weftgraph.operators.catalog import id_tokens
from weftgraph.operators.skew import hot_frame, hot_keys, salted_join
from weftgraph.runtime import cut, shuffle_partitions

#: Parts that the edges of a hub are spread over.
SPREAD = 32
#: Iterations in one plan, after which the ranks are written.
PLAN_ROUNDS = 3
#: Scores are rounded to so many places before they are ranked, so that the order of summation doesn't matter.
PLACES = 10


def node_of(label: str, id_: str):
    return F.concat_ws(":", F.col(label), F.col(id_))


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Generic edges with ``s`` and ``t`` as nodes."""
    return edges.withColumn("s", node_of("src_label", "src")).withColumn("t", node_of("dst_label", "dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other): both directions of every edge; parallel edges stay, a self loop is met from both ends."""
    e = keyed_edges(edges)
    return e.select(F.col("s").alias("node"), F.col("t").alias("other")).unionAll(e.select(F.col("t").alias("node"), F.col("s").alias("other")))


def chunk_members(chunks: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, node): ends of the edges extracted from the chunk, its document, what the document links to, and ids in the text."""
    e = keyed_edges(edges)
    texts = chunks.select("chunk_id", real_key("doc_id").alias("doc"), "text").filter("chunk_id is not null").distinct()
    known = nodes.select(F.col("id"), node_of("label", "id").alias("node"))
    extracted = e.filter("origin = 'extracted'").select(F.col("source_chunk_id").alias("chunk_id"), F.explode(F.array("s", "t")).alias("node")).join(texts.select("chunk_id").distinct(), "chunk_id", "left_semi")
    documents = texts.select("chunk_id", "doc").join(nodes.filter("label = 'Document'").select(F.col("id").alias("doc")), "doc", "left_semi")
    own = documents.select("chunk_id", F.concat(F.lit("Document:"), "doc").alias("node"))
    links = e.filter("origin = 'document_link'").select(F.col("src").alias("doc"), F.col("t").alias("node")).distinct()
    linked = salted_join(documents, links, ["doc"], F.col("chunk_id"), how="inner").select("chunk_id", "node")
    named = salted_join(id_tokens(texts, "chunk_id", "text"), known.select(F.col("id").alias("token"), "node"), ["token"], F.col("chunk_id"), how="inner").select("chunk_id", "node")
    return extracted.unionByName(own).unionByName(linked).unionByName(named).distinct()


def pagerank(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, alpha: float = 0.15, iterations: int = 30, question: str = "question_id") -> DataFrame:
    """(``question``, node, score): personalised PageRank for every question at once.

    ``seeds``: (``question``, node); seeds that are no node are left out and repeated ones count
    once. A question without a valid seed has no rows. Teleport is uniform over the seeds, the walk
    starts there, and what reaches a node without edges goes back to the seeds; the scores of a
    question sum to one. Rows hold nodes with a score above zero only.

    Edges are partitioned by node once and stay on the executors' disks over all iterations; an iteration
    moves ranks only. Those of hubs are spread over tasks. A lost executor costs a partition
    read from the checkpoint again.
    """
    known = nodes.select(node_of("label", "id").alias("node")).distinct()
    valid = seeds.select(question, "node").distinct().join(known, "node", "left_semi")
    teleport = cut(valid.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy(question))))
    adj = cut(adjacency(edges))
    degree = adj.groupBy("node").agg(F.count("*").alias("deg"))
    alone = cut(teleport.join(degree, "node", "left_anti").select(question, "node"))  # only seeds can be nodes without edges that hold a score
    leaks = not alone.isEmpty()
    hot = hot_keys(adj, ["node"])
    key = ["node", "_salt"] if hot else ["node"]
    steps = salted_join(adj, degree, ["node"], F.col("other"), how="inner")
    if hot:
        hubs = hot_frame(adj, ["node"], hot)
        steps = steps.join(hubs, "node", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("other"), F.lit(SPREAD))).otherwise(0).cast("int")).drop("_hot")
        copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))
    placed = cut(steps).repartition(shuffle_partitions(edges.sparkSession), *key).persist(StorageLevel.DISK_ONLY)
    try:
        rank = teleport.select(question, "node", F.col("w").alias("score"))
        for n in range(1, iterations + 1):
            spread = rank.join(hubs, "node", "left").withColumn("_salt", copies).drop("_hot") if hot else rank
            moved = spread.join(placed, key).select(question, F.col("other").alias("node"), ((1 - alpha) * F.col("score") / F.col("deg")).alias("score"))
            back = teleport.select(question, "node", (alpha * F.col("w")).alias("score"))
            if leaks:
                lost = rank.join(alone, [question, "node"], "left_semi").groupBy(question).agg(F.sum("score").alias("lost"))
                back = teleport.join(lost, question, "left").select(question, "node", (alpha * F.col("w") + (1 - alpha) * F.coalesce("lost", F.lit(0.0)) * F.col("w")).alias("score"))
            rank = moved.unionByName(back).groupBy(question, "node").agg(F.sum("score").alias("score")).filter("score > 0")
            if leaks or n % PLAN_ROUNDS == 0 or n == iterations:  # with lost scores a plan reads the one before twice
                rank = cut(rank)
        return rank
    finally:
        placed.unpersist()


def _top(df: DataFrame, question: str, score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(question).orderBy(F.round(score, PLACES).desc(), F.col(tie).desc())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_passages(ranks: DataFrame, members: DataFrame, k: int = 12, question: str = "question_id") -> DataFrame:
    """(``question``, chunk_id, score, rank): chunks by the sum of their members' scores; ties by id, greatest first."""
    scored = salted_join(members, ranks, ["node"], F.col("chunk_id"), how="inner").groupBy(question, "chunk_id").agg(F.sum("score").alias("score")).filter("score > 0")
    return _top(scored, question, "score", "chunk_id", k)


def rank_entities(ranks: DataFrame, m: int = 15, question: str = "question_id") -> DataFrame:
    """(``question``, node, score, rank): the best nodes that are no documents."""
    return _top(ranks.filter("score > 0").filter(~F.startswith("node", F.lit("Document:"))), question, "score", "node", m)


def induced_edges(edges: DataFrame, chosen: DataFrame, question: str = "question_id") -> DataFrame:
    """Edges with both ends among the chosen nodes of a question."""
    e = keyed_edges(edges)
    first = salted_join(e, chosen.select(question, F.col("node").alias("s")), ["s"], F.col("t"), how="inner")
    return first.join(chosen.select(question, F.col("node").alias("t")), [question, "t"], "left_semi")


def one_hop(edges: DataFrame, seeds: DataFrame, high_types: list[str], r_max: int = 30, question: str = "question_id") -> DataFrame:
    """The edges at the seeds, best first: two points for a high-level type, one for a structured or
    link edge, else its confidence. Ties by s, rel_type, t."""
    e = keyed_edges(edges)
    mine = [salted_join(e, seeds.select(question, F.col("node").alias(end)).distinct(), [end], F.struct("s", "t", "rel_type"), how="inner") for end in ("s", "t")]
    near = mine[0].unionByName(mine[1]).distinct()
    score = F.when(F.col("rel_type").isin(*high_types), 2.0).otherwise(0.0) + F.when(F.col("origin").isin("structured", "document_link"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    order = Window.partitionBy(question).orderBy(F.round("score", PLACES).desc(), "s", "rel_type", "t")
    return near.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= r_max)


def expand_entities(seeds: DataFrame, ranked: DataFrame, ent_max: int = 30, question: str = "question_id") -> DataFrame:
    """(``question``, node, ord): seeds in order, then both ends of the ranked edges; no documents, each once."""
    ends = ranked.select(question, F.posexplode(F.array("s", "t")).alias("_p", "node"), (F.col("rank") * 2).alias("_r")).select(question, "node", (F.col("_r") + F.col("_p") + 1_000_000).alias("ord"))
    all_ = seeds.select(question, "node", F.col("ord").cast("bigint").alias("ord")).unionByName(ends.withColumn("ord", F.col("ord").cast("bigint")))
    once = all_.filter(~F.startswith("node", F.lit("Document:"))).groupBy(question, "node").agg(F.min("ord").alias("ord"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy("ord", "node"))).filter(F.col("rank") <= ent_max)


def overlap_chunks(members: DataFrame, entities: DataFrame, ranked: DataFrame, k: int = 8, question: str = "question_id") -> DataFrame:
    """(``question``, chunk_id, n_shared, rank): chunks by how many chosen entities they hold; sources of the ranked edges count too."""
    shared = salted_join(members, entities.select(question, "node"), ["node"], F.col("chunk_id"), how="inner").select(question, "chunk_id", "node")
    counted = shared.groupBy(question, "chunk_id").agg(F.count_distinct("node").alias("n_shared"))
    known = members.select("chunk_id").distinct()
    sources = ranked.filter("source_chunk_id is not null").select(question, F.col("source_chunk_id").alias("chunk_id"), F.lit(0).cast("bigint").alias("n_shared")).join(known, "chunk_id", "left_semi").distinct()
    scored = counted.unionByName(sources).groupBy(question, "chunk_id").agg(F.max("n_shared").alias("n_shared"))
    order = Window.partitionBy(question).orderBy(F.desc("n_shared"), F.desc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
