"""Queries over graph algorithms, vectors, routing, grading and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import catalog, evaluate, graph_algo, graph_build, vector
from weftgraph.plans import graph_queries as G
from weftgraph.plans import sql_base as S
from weftgraph.runtime import cut
from weftgraph.sources.tables import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- PageRank and neighbourhoods

#: Seeds of two example questions, and the iterations of the walk, those of the operator.
SEEDS = [(1, "Supplier:SUP00001"), (1, "Line:L003"), (2, "Region:R002"), (2, "Customer:C000000001"), (2, "Customer:C999999999")]
ITERATIONS = 30


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, n, i) for i, (q, n) in enumerate(SEEDS)], "question_id int, node string, ord int")


def _fused(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The graph of tables and texts: edges after the upsert of the promoted triples, and the entities that only triples name as nodes too."""
    nodes = graph_build.supply_chain(spark, folder).all_nodes().select("label", "id")
    return cut(nodes.unionByName(catalog.mentioned_entities(table(spark, folder, "extracted_triples")).select("label", "id"))), cut(G.merged_edges(spark, folder))


def _ranks(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph_algo.pagerank(edges, _seeds(spark), nodes, iterations=ITERATIONS)


_SEED_VALUES = S.values([(q, n, i) for i, (q, n) in enumerate(SEEDS)])
_FUSED = f"""{S.UPSERTED}, all_nodes as materialized (select label, id from nodes union all select case substr(id, 1, 2) when 'AE' then 'AnomalyEvent' when 'DT' then 'DowntimeEvent' else 'Equipment' end, id from mentioned),
e as materialized (select *, src_label || ':' || src as s, dst_label || ':' || dst as t from merged), seeds as (select * from (values {_SEED_VALUES}) v(question_id, node, ord))"""


def _ppr_sql() -> str:
    steps = [f"""{_FUSED}, adj as materialized (select s as node, t as other from e union all select t, s from e), deg as materialized (select node, count(*) as deg from adj group by 1),
valid as (select distinct question_id, node from seeds where node in (select label || ':' || id from all_nodes)), tele as materialized (select question_id, node, 1.0::double / count(*) over (partition by question_id) as w from valid), p0 as (select question_id, node, w as score from tele)"""]
    for i in range(ITERATIONS):
        steps.append(f"""p{i + 1} as materialized (select question_id, node, sum(score) as score from (
  select p.question_id, a.other as node, (1 - 0.15::double) * p.score / d.deg as score from p{i} p join adj a using (node) join deg d using (node)
  union all select question_id, node, 0.15::double * w + (1 - 0.15::double) * w * coalesce((select sum(score) from p{i} l where l.question_id = tele.question_id and l.node not in (select node from deg)), 0) from tele) group by all)""")
    return ", ".join(steps) + f", ranks as materialized (select * from p{ITERATIONS} where score > 0)"


_PPR = _ppr_sql()


@query(f"with {_PPR} select question_id, node, round(score, 9) as score from ranks")
def ppr_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The whole walk over the fused graph."""
    nodes, edges = _fused(spark, folder)
    return _ranks(spark, nodes, edges).withColumn("score", F.round("score", 9))


_MEMBERS = f"""texts as materialized (select distinct chunk_id, {S.real('doc_id')} as doc, text from chunks where chunk_id is not null),
dc as (select chunk_id, doc from texts where doc in (select id from all_nodes where label = 'Document')),
members as materialized (select chunk_id, unnest([s, t]) as node from e join (select distinct chunk_id from texts) on source_chunk_id = chunk_id where origin = 'extracted' union select chunk_id, 'Document:' || doc from dc union select chunk_id, t from dc join (select src, t from e where origin = 'document_link') on src = doc union select chunk_id, n.label || ':' || n.id from (select distinct chunk_id, unnest(regexp_extract_all(text, '[A-Za-z]{{2,6}}[0-9]{{2,}}')) as tok from texts) join all_nodes n on n.id = tok)"""


@query(f"with {_FUSED}, {_MEMBERS} select chunk_id, node from members")
def chunk_members(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _fused(spark, folder)
    return graph_algo.chunk_members(table(spark, folder, "chunks"), edges, nodes)


@query(f"with {_PPR}, {_MEMBERS}, sc as (select question_id, chunk_id, sum(score) as score from members join ranks using (node) group by all), rk as (select *, row_number() over (partition by question_id order by round(score, 10) desc, chunk_id desc) as rank from sc where score > 0) select question_id, chunk_id, round(score, 9) as score, cast(rank as integer) as rank from rk where rank <= 12")
def ppr_passages(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _fused(spark, folder)
    members = graph_algo.chunk_members(table(spark, folder, "chunks"), edges, nodes)
    return graph_algo.rank_passages(_ranks(spark, nodes, edges), members).withColumn("score", F.round("score", 9))


_TOP = "top_ as materialized (select * from (select *, row_number() over (partition by question_id order by round(score, 10) desc, node desc) as rank from ranks where not starts_with(node, 'Document:')) where rank <= 15)"


@query(f"with {_PPR}, {_TOP} select question_id, node, round(score, 9) as score, cast(rank as integer) as rank from top_")
def ppr_top_entities(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _fused(spark, folder)
    return graph_algo.rank_entities(_ranks(spark, nodes, edges)).withColumn("score", F.round("score", 9))


@query(f"with {_PPR}, {_TOP} select a.question_id, e.s, e.rel_type, e.t from e join top_ a on a.node = e.s join top_ b on b.node = e.t and b.question_id = a.question_id")
def induced_edges(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _fused(spark, folder)
    top = cut(graph_algo.rank_entities(_ranks(spark, nodes, edges)))
    return graph_algo.induced_edges(edges, top).select("question_id", "s", "rel_type", "t")


HIGH_TYPES = ["FOR_CUSTOMER", "SUPPLIED_BY"]
_HOP = f"""{_FUSED}, near as (select distinct question_id, s, rel_type, t, origin, confidence, source_chunk_id from e join seeds on node = s or node = t),
pointed as (select *, case when rel_type in ('FOR_CUSTOMER', 'SUPPLIED_BY') then 2.0 else 0.0 end + case when origin in ('structured', 'document_link') then 1.0 else coalesce(confidence, 0) end as score from near),
hop as materialized (select * from (select *, row_number() over (partition by question_id order by round(score, 10) desc, s, rel_type, t) as rank from pointed) where rank <= 30)"""


def _hop(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return cut(graph_algo.one_hop(edges, _seeds(spark), HIGH_TYPES))


@query(f"with {_HOP} select question_id, s, rel_type, t, cast(score as double) as score, cast(rank as integer) as rank from hop")
def one_hop_ranked(spark: SparkSession, folder: str) -> DataFrame:
    _, edges = _fused(spark, folder)
    return _hop(spark, edges).select("question_id", "s", "rel_type", "t", "score", "rank")


_ENT = f"""{_HOP}, ends as (select question_id, node, ord from seeds union all select question_id, s, rank * 2 + 1000000 from hop union all select question_id, t, rank * 2 + 1000001 from hop),
ent as materialized (select * from (select *, row_number() over (partition by question_id order by ord, node) as rank from (select question_id, node, min(ord) as ord from ends where not starts_with(node, 'Document:') group by all)) where rank <= 30)"""


@query(f"with {_ENT} select question_id, node, cast(rank as integer) as rank from ent")
def entity_expand(spark: SparkSession, folder: str) -> DataFrame:
    _, edges = _fused(spark, folder)
    return graph_algo.expand_entities(_seeds(spark), _hop(spark, edges)).select("question_id", "node", "rank")


@query(f"with {_ENT}, {_MEMBERS}, counted as (select question_id, chunk_id, count(distinct node) as n_shared from members join ent using (node) group by all union all select distinct question_id, source_chunk_id, 0 from hop where source_chunk_id in (select chunk_id from members)), sh as (select question_id, chunk_id, max(n_shared) as n_shared from counted group by all) select * from (select question_id, chunk_id, n_shared, cast(row_number() over (partition by question_id order by n_shared desc, chunk_id desc) as integer) as rank from sh) where rank <= 8")
def chunk_overlap(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _fused(spark, folder)
    ranked = _hop(spark, edges)
    members = graph_algo.chunk_members(table(spark, folder, "chunks"), edges, nodes)
    return graph_algo.overlap_chunks(members, graph_algo.expand_entities(_seeds(spark), ranked), ranked)


# ---------------------------------------------------------------- vectors

_UNIT = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings)"
_SIM = f"{_UNIT}, sims as (select q.vec_id as query_id, r.vec_id as id, round(list_dot_product(q.v, r.v), 9) as sim from u q join u r on q.vec_id % 20 = 0 and q.vec_id <> r.vec_id), near as (select *, row_number() over (partition by query_id order by sim desc, id) as rank from sims)"


def _near(spark: SparkSession, folder: str, k: int) -> DataFrame:
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")
    return vector.knn(rows.filter("id % 20 = 0"), rows, "id", "embedding", k, exclude_self=True)


@query(f"with {_SIM} select query_id, id, round(sim, 6) as sim, cast(rank as integer) as rank from near where rank <= 5")
def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder, 5).withColumn("sim", F.round("sim", 6))


@query(f"with {_SIM} select query_id, id, round(1 - sim, 6) as distance from near where rank <= 6")
def knn_distance(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder, 6).select("query_id", "id", F.round(1 - F.col("sim"), 6).alias("distance"))


@query(f"with {_SIM}, top_ as (select query_id, max(sim) filter (where rank = 1) as a, max(sim) filter (where rank = 2) as b from near group by 1) select query_id, id, round(sim, 6) as sim from near join top_ using (query_id) where rank <= 5 and a >= 0.3 and a - b >= 0.01 and sim >= 0.3")
def knn_gated(spark: SparkSession, folder: str) -> DataFrame:
    return vector.gated(_near(spark, folder, 6), 5, 0.3, 0.01).select("query_id", "id", F.round("sim", 6).alias("sim"))


@query()
def knn_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same search over the inverted-file index: half the cells first, then those that can still hold a nearer row."""
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")
    index = vector.InvertedFile(rows, "id", "embedding", cells=32)
    return index.search(rows.filter("id % 20 = 0"), 5, probes=16, exclude_self=True)


@query("select vec_id, round(list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))[1], 6) as first_value from embeddings")
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.round(F.element_at(vector.unit("embedding"), 1), 6).alias("first_value"))


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    pairs = vector.similar_pairs(rows, "id", "embedding", 0.35, "label")
    return vector.components(rows.select("id"), pairs)


@query(f"with recursive {_UNIT}, pr as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.35), reach(id, r) as (select vec_id, vec_id from embeddings union select reach.id, pr.y from reach join pr on pr.x = reach.r) select id, min(r) as component from reach group by 1")
def cluster_components(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components over cosines within a label."""
    return _clusters(spark, folder)


@query(f"with recursive {_UNIT}, pr as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.35), reach(id, r) as (select vec_id, vec_id from embeddings union select reach.id, pr.y from reach join pr on pr.x = reach.r), comp as (select id, min(r) as component from reach group by 1), m as (select id, component, 'P' || id as name, id % 7 as support from comp) select id, component, arg_max(name, row(support, -length(name), -id)) over (partition by component) as canon from m")
def cluster_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster's best supported name, then the shortest, then the first."""
    members = _clusters(spark, folder).select("id", "component", F.concat(F.lit("P"), "id").alias("name"), (F.col("id") % 7).alias("support"), F.col("id").alias("ord"), F.lit("all").alias("group"))
    return vector.canonical_members(members).select("id", "component", "canon")


@query(f"with {_UNIT}, proto as (select label as sense, v from u qualify row_number() over (partition by label order by vec_id) = 1), s as (select u.vec_id, sense, round(list_dot_product(u.v, proto.v), 9) as sim from u, proto), r as (select *, row_number() over (partition by vec_id order by sim desc, sense) as rank from s), t as (select vec_id, max(sense) filter (where rank = 1) as sense, max(sim) filter (where rank = 1) as a, max(sim) filter (where rank = 2) as b from r group by 1) select vec_id, case when a >= 0.55 and a - b >= 0 then sense end as sense, round(a, 6) as sim from t")
def sense_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector to the nearest of the sense prototypes (the first vector of every label), if it is near enough and no tie is closer."""
    rows = table(spark, folder, "embeddings")
    protos = rows.groupBy(F.col("label").cast("bigint").alias("id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))  # one row per sense
    near = vector.knn(rows.select(F.col("vec_id").alias("id"), "embedding"), protos, "id", "embedding", 2)
    top = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("sim", "id"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("b"))
    sure = (F.col("a.sim") >= 0.55) & (F.col("a.sim") - F.coalesce("b", F.lit(-1.0)) >= 0)
    return top.select(F.col("query_id").alias("vec_id"), F.when(sure, F.col("a.id")).cast("int").alias("sense"), F.round("a.sim", 6).alias("sim"))


# ---------------------------------------------------------------- routing and grading


def _sql_points(path: str) -> str:
    rules = [(r, n) for r, p, n in evaluate.ROUTE_RULES if p == path]
    return " + ".join(f"case when regexp_matches(lower(coalesce(question, '')), '{r}') then {n} else 0 end" for r, n in rules)


_ROUTES = "routed as (select *, " + ", ".join(f"{_sql_points(p)} as {p}_" for p in evaluate.TIE_ORDER) + " from eval_items), routes as (select *, case greatest(Hybrid_, DB_, Doc_, LLM_) when Hybrid_ then 'Hybrid' when DB_ then 'DB' when Doc_ then 'Doc' else 'LLM' end as route from routed)"


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    scores = evaluate.route_scores("question")
    return table(spark, folder, "eval_items").withColumn("route", evaluate.argmax_path(scores))


@query(f"with {_ROUTES} select item_id, cast(DB_ as integer) as db, cast(Doc_ as integer) as doc, cast(Hybrid_ as integer) as hybrid, cast(LLM_ as integer) as llm, route from routes")
def route_argmax(spark: SparkSession, folder: str) -> DataFrame:
    scores = evaluate.route_scores("question")
    return table(spark, folder, "eval_items").select("item_id", *[scores[p].alias(p.lower()) for p in ("DB", "Doc", "Hybrid", "LLM")], evaluate.argmax_path(scores).alias("route"))


def _quote(s: str) -> str:
    return s.replace("'", "''")


_POLAR = f"case when regexp_matches(lower(coalesce(text, '')), '{_quote(evaluate.ABSTAIN)}') then 'ABSTAIN' when regexp_matches(said, '{_quote(evaluate.AFFIRM)}') and not regexp_matches(said, '{_quote(evaluate.NEGATE)}') then 'YES' when regexp_matches(said, '{_quote(evaluate.NEGATE)}') and not regexp_matches(said, '{_quote(evaluate.AFFIRM)}') then 'NO' else 'UNCLEAR' end"
_SAID = f"said as (select *, regexp_replace(lower(coalesce(text, '')), '{_quote(evaluate.NOISE)}', ' ', 'g') as said from documents), polar as (select doc_id, {_POLAR} as polarity from said)"


@query(f"with {_SAID} select doc_id, polarity, case when polarity in ('NO', 'ABSTAIN') then 'PASS' else 'FAIL' end as lenient_no, case when polarity = 'NO' then 'PASS' else 'FAIL' end as strict_no, case when polarity = 'YES' then 'PASS' else 'FAIL' end as yes from polar")
def polarity_grade(spark: SparkSession, folder: str) -> DataFrame:
    """The polarity of every text as an answer, graded against both gold values."""
    said = table(spark, folder, "documents").select("doc_id", evaluate.polarity("text").alias("polarity"))
    p = F.col("polarity")
    return said.select("doc_id", "polarity", evaluate.grade_polarity(F.lit("NO"), p).alias("lenient_no"), evaluate.grade_polarity(F.lit("NO"), p, lenient=False).alias("strict_no"), evaluate.grade_polarity(F.lit("YES"), p).alias("yes"))


_GRADED = f"{_ROUTES}, graded as (select item_id, category, route, case when coalesce(trim(answer), '') = '' then null when len(list_filter(list_filter(list_transform(string_split(trim(answer), ';'), lambda p: trim(p)), lambda p: p <> ''), lambda p: not contains(lower(coalesce(passage, '')), lower(p)))) = 0 then 'PASS' else 'FAIL' end as verdict from routes)"


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.grade(_routed(spark, folder), "passage", "answer")


@query(f"with {_GRADED} select item_id, verdict from graded")
def gold_match(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the passage of an item holds all parts of its answer."""
    return _graded(spark, folder).select("item_id", "verdict")


@query(f"with {_GRADED}, k as (select coalesce(category, '?') as kind, verdict from graded union all select '*', verdict from graded) select kind, count(*) filter (where verdict in ('PASS', 'FAIL')) as graded, count(*) filter (where verdict = 'PASS') as passed, round(count(*) filter (where verdict = 'PASS') / nullif(count(*) filter (where verdict in ('PASS', 'FAIL')), 0), 4) as accuracy, count(*) filter (where verdict = 'ERROR') as errors from k group by 1")
def accuracy_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(_graded(spark, folder), "category")


@query(f"with {_GRADED} select route as path, count(*) filter (where verdict in ('PASS', 'FAIL')) as graded, count(*) filter (where verdict = 'PASS') as passed, round(count(*) filter (where verdict = 'PASS') / nullif(count(*) filter (where verdict in ('PASS', 'FAIL')), 0), 4) as accuracy from graded group by 1")
def accuracy_by_route(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy_by_path(_graded(spark, folder))


@query(f"with {_GRADED} select coalesce(category, '?') as kind, " + ", ".join(f"count(*) filter (where route = '{p}') as \"{p}\"" for p in evaluate.TIE_ORDER) + ", count(*) filter (where route is null or route not in ('Hybrid', 'DB', 'Doc', 'LLM')) as other from graded group by 1")
def routing_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.routing_crosstab(_graded(spark, folder), "category")


@query("with r as (select *, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n_ from events where value is not null) select event_type, count(*) as n, round(avg(value), 3) as mean, round(median(value), 3) as median, round(max(value) filter (where i = greatest(0, floor(n_ * 0.95)::bigint - 1)), 2) as p95, round(sum(value), 1) as total from r group by 1")
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Durations of the events per type: mean, median, the 95 % value by rank, and total."""
    return evaluate.latency(table(spark, folder, "events"), "value", "event_type").withColumn("n", F.col("n").cast("bigint"))


@query("with r as (select user_id, count(*) as attempts, case when count(*) filter (where event_type = 'error') > 0 then 'error' end as error, count(*) filter (where event_type = 'purchase') as n_facts, count(distinct event_type) as n_pruned, 5 as n_all_types from events group by 1) select count(*) as n, round(avg(attempts), 3) as attempts_mean, max(attempts) as attempts_max, round(count(*) filter (where attempts > 1) / count(*), 3) as retry_rate, round(count(error) / count(*), 3) as error_rate, round(count(*) filter (where n_facts = 0) / count(*), 3) as empty_rate, round(avg(n_pruned / n_all_types), 3) as prune_ratio from r")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of runs, with a user of the events as a run."""
    events = table(spark, folder, "events")
    runs = events.groupBy("user_id").agg(F.count("*").alias("attempts"), F.max(F.when(F.col("event_type") == "error", "error")).alias("error"), F.count_if(F.col("event_type") == "purchase").alias("n_facts"), F.count_distinct("event_type").alias("n_pruned"), F.lit(5).alias("n_all_types"))
    return evaluate.run_summary(runs)


__all__ = ["G", "QUERIES", "SQL"]
