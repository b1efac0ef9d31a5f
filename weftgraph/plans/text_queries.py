"""Queries over texts and triples: chunking, linking, gates, normalisation, confidence, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import catalog, chunking, extraction
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


# ---------------------------------------------------------------- chunking

_SENT = r"""docs as (select distinct document_id as doc_id, text from documents where text is not null),
raw as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '[\s\p{Z}]+', '', 'g') <> '') as parts from docs),
sents as (select doc_id, unnest(generate_series(0, len(parts) - 1)) as pos, unnest(parts) as sentence from raw)"""
_CHUNK = f"""{_SENT}, wins as (select doc_id, pos, count(*) over (partition by doc_id) as n, concat_ws(' ', sentence, lead(sentence, 1) over w, lead(sentence, 2) over w) as text from sents window w as (partition by doc_id order by pos)),
chunked as (select doc_id || '#c' || cast(pos as varchar) as chunk_id, doc_id, cast(pos as integer) as seq, text from wins where pos <= greatest(n - 3, 0))"""


@query(f"with {_SENT} select doc_id, cast(pos as integer) as pos, sentence from sents")
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("document_id", "text").filter("text is not null").distinct()
    return chunking.split_sentences(docs)


@query(f"with {_CHUNK} select * from chunked")
def chunks_windowed(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_corpus(table(spark, folder, "documents"))


@query(f"with {_SENT}, wins as (select doc_id, pos, count(*) over (partition by doc_id) as n, concat_ws(' ', sentence, lead(sentence, 1) over w, lead(sentence, 2) over w, lead(sentence, 3) over w) as text from sents window w as (partition by doc_id order by pos)), st as (select *, row_number() over (partition by doc_id order by pos) - 1 as seq from wins where (n <= 4 and pos = 0) or (n > 4 and pos <= n - 4 and (pos % 3 = 0 or pos = n - 4))) select doc_id || '#c' || cast(seq as varchar) as chunk_id, doc_id, cast(seq as integer) as seq, text from st")
def chunks_stepped(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of four sentences every third, with a tail window."""
    return chunking.chunk_corpus(table(spark, folder, "documents"), size=4, step=3)


# ---------------------------------------------------------------- catalogue and linking


@query(f"with {S.CATALOG} select label, id, name from catalog")
def entity_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return G.project_catalog(spark, folder).select("label", "id", "name")


@query(f"with {S.CATALOG} select id, name from catalog where name is not null")
def entity_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return G.project_catalog(spark, folder).filter("name is not null").select("id", "name")


_KEYED = "trim(regexp_replace(lower(product_name), '[^0-9a-z]+', ' ', 'g'))"


@query(f"select distinct product_name, {_KEYED} as entity_key, case when length({_KEYED}) >= 2 then 'X_' || substr(replace({_KEYED}, ' ', '_'), 1, 48) end as synth_id from products")
def entity_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("product_name", catalog.entity_key("product_name").alias("entity_key"), catalog.synthetic_id("product_name").alias("synth_id")).distinct()


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", "text").filter("chunk_id is not null and text is not null").distinct()


_TEXTS = "texts as (select distinct chunk_id, lower(text) as text from chunks where chunk_id is not null and text is not null)"
_WORD = r"[\p{L}\p{N}\p{M}_]+"
_IDS = f"{S.CATALOG}, {_TEXTS}, toks as (select distinct chunk_id, unnest(regexp_extract_all(text, '{_WORD}')) as tok from texts), idlinks as (select chunk_id, label, id from toks join catalog on lower(id) = tok)"
_NAMES = f"{_IDS}, namelinks as (select distinct chunk_id, label, id from texts join catalog on length(name) >= 1 and contains(text, lower(name)))"


@query(f"with {_IDS} select * from idlinks")
def link_ids(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.link_ids(_chunks(spark, folder), "chunk_id", "text", G.project_catalog(spark, folder))


@query(f"with {_NAMES} select * from namelinks")
def link_names(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.link_names(_chunks(spark, folder), "chunk_id", "text", G.project_catalog(spark, folder))


@query(f"with {_NAMES} select chunk_id, label, id, min(m) as match from (select *, 'id' as m from idlinks union all select *, 'name' from namelinks) group by all")
def link_entities(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.link_entities(_chunks(spark, folder), "chunk_id", "text", G.project_catalog(spark, folder))


@query(f"with {_IDS}, lastn as (select lower(name) as name, arg_max(row(label, id), row(n, id)) as e from catalog where length(name) >= 4 group by 1), named as (select distinct chunk_id, e[1] as label, e[2] as id from texts join lastn on contains(text, name)) select chunk_id, label, id, min(m) as match from (select *, 'id' as m from idlinks union all select *, 'name' from named) group by all")
def link_online(spark: SparkSession, folder: str) -> DataFrame:
    """Linking as at question time: names of four or more characters, of equal names the last entry."""
    return catalog.link_online(_chunks(spark, folder), "chunk_id", "text", G.project_catalog(spark, folder))


@query(f"with {_NAMES} select chunk_id, count(distinct id) as n_entities from (select * from idlinks union all select * from namelinks) group by 1 having count(distinct id) >= 2")
def link_min_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.enough_candidates(link_entities(spark, folder), "chunk_id")


@query(f"with {S.RESOLVED} select value, id, label, name, how from known")
def resolve_cascade(spark: SparkSession, folder: str) -> DataFrame:
    triples = table(spark, folder, "extracted_triples")
    values = triples.select(F.col("subject_id").alias("value")).unionByName(triples.select(F.col("object_id").alias("value")))
    return catalog.resolve_values(values, "value", G.project_catalog(spark, folder))


@query(f"with {S.RESOLVED}, surf as (select distinct v as value from (select subject_surface as v from extracted_triples union all select object_surface from extracted_triples) where v is not null), hits as (select value, coalesce(b.id, n.e[1], p.e[1]) as id, case when b.id is not null then 'id' when n.e is not null then 'name' when p.e is not null then 'partial' else 'none' end as how from surf left join byid b on b.id = {S.real('value')} left join names n on n.name_key = lower(trim(value)) and b.id is null left join (select k, arg_min(n.e, n.o) as e from (select distinct lower(trim(value)) as k from surf) join names n on length(k) >= 4 and (contains(n.name_key, k) or contains(k, n.name_key)) group by 1) p on p.k = lower(trim(value)) and b.id is null and n.e is null) select * from hits")
def canonical_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """Surfaces resolved to canonical ids, with names and parts of names."""
    triples = table(spark, folder, "extracted_triples")
    values = triples.select(F.col("subject_surface").alias("value")).unionByName(triples.select(F.col("object_surface").alias("value")))
    return catalog.resolve_values(values, "value", G.project_catalog(spark, folder)).select("value", "id", "how")


@query("select distinct document_id, unnest(regexp_extract_all(text, '[A-Za-z]{2,6}[0-9]{2,}')) as token from documents")
def id_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.id_tokens(table(spark, folder, "documents"), "document_id", "text").distinct()


@query("select distinct unnest(regexp_extract_all(text, '[A-Za-z]{2,6}[0-9]{2,}')) as token, chunk_id from chunks where chunk_id is not null and text is not null")
def chunk_token_index(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted token table: every id-like token with the chunks that hold it."""
    return catalog.id_tokens(_chunks(spark, folder), "chunk_id", "text").select("token", "chunk_id").distinct()


# ---------------------------------------------------------------- triples


@query(f"with {S.GATED} select subject_id, predicate, object_id, source_chunk_id, predicate_cue, subject, subject_label, subject_how, object, object_label, object_how, canon_predicate, gate from gated")
def triples_gated(spark: SparkSession, folder: str) -> DataFrame:
    return G.gated_triples(spark, folder).select("subject_id", "predicate", "object_id", "source_chunk_id", "predicate_cue", "subject", "subject_label", "subject_how", "object", "object_label", "object_how", "canon_predicate", "gate")


@query(f"with {S.GATED} select source_doc_id as doc, source_chunk_id as chunk, subject_id, object_id, predicate, substr(predicate_cue, 1, 200) as evidence, concat_ws(',', case when subject is null then 'subject' end, case when object is null then 'object' end) as missing from gated where gate = 'unresolved'")
def triples_quarantined(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.quarantine(G.gated_triples(spark, folder))


_XKEY = "trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g'))"


def _synth(c: str) -> str:
    key = _XKEY.format(c)
    return f"case when length({key}) >= 2 then 'X_' || substr(replace({key}, ' ', '_'), 1, 48) end"


@query(f"with {S.RESOLVED} select t.subject_id, t.object_id, t.source_chunk_id, t.predicate_cue, coalesce(s.id, {_synth('t.subject_id')}) as subject, case when s.id is null and {_synth('t.subject_id')} is not null then 'ExtractedEntity' else s.label end as subject_label, coalesce(o.id, {_synth('t.object_id')}) as object, case when o.id is null and {_synth('t.object_id')} is not null then 'ExtractedEntity' else o.label end as object_label from (select distinct * from extracted_triples) t left join known s on s.value = t.subject_id left join known o on o.value = t.object_id")
def triples_open(spark: SparkSession, folder: str) -> DataFrame:
    """Open mode: ends that nothing resolves become extracted entities under a synthetic id."""
    gated = extraction.gate(table(spark, folder, "extracted_triples"), G.project_catalog(spark, folder), open_entities=True)
    return gated.select("subject_id", "object_id", "source_chunk_id", "predicate_cue", "subject", "subject_label", "object", "object_label")


@query(f"with {S.RESOLVED}, un as (select value from known where id is null), keyed as (select {_synth('value')} as synth_id, substr(trim(value), 1, 80) as s, value from un) select synth_id, arg_min(s, row(value, s)) as display from keyed where synth_id is not null group by 1")
def register_extracted(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.register_extracted(resolve_cascade(spark, folder).filter("id is null"), "value", "value")


@query(f"with {S._SYN} select distinct predicate, {S.CANON} as canon from extracted_triples")
def canon_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_triples").select("predicate", extraction.canonical_predicate("predicate").alias("canon")).distinct()


@query(f"with {S.NORMALISED} select subject, subject_label, canon_predicate, object, object_label, source_chunk_id, predicate_cue from normalised")
def normalize_endpoint(spark: SparkSession, folder: str) -> DataFrame:
    return G.normalised_triples(spark, folder).select("subject", "subject_label", "canon_predicate", "object", "object_label", "source_chunk_id", "predicate_cue")


def _fold_sql() -> str:
    structured = extraction.structured_relations()
    menus: dict[str, list[str]] = {}
    for pair, rel, _, _ in structured:
        menus.setdefault(pair, []).append(rel)
    branches = []
    for pair, senses in extraction.SENSES.items():
        key = "|".join(sorted(pair))
        if key not in menus and len(senses) == 1:
            branches.append(f"when '{key}' then '{senses[0][0]}'")
        else:
            menus.setdefault(key, []).extend(n for n, _ in senses)
    for key, menu in menus.items():
        cues = " ".join(f"when regexp_matches(lower(coalesce(predicate_cue, '')), '{extraction.SENSE_CUES[n]}') then '{n}'" for n in menu if n in extraction.SENSE_CUES)
        branches.append(f"when '{key}' then {f'case {cues} end' if cues else 'null'}")
    wants = " ".join(f"when '{pair}/{rel}' then '{a}'" for pair, rel, a, _ in structured)
    return f"""{S.PASSED}, sensed as (select *, {S.PAIR} as pair, case {S.PAIR} {' '.join(branches)} end as sense from passed),
turned as (select *, coalesce(case pair || '/' || sense {wants} end <> subject_label, false) as swap from sensed)"""


@query(f"with {_fold_sql()} select case when swap then object else subject end as subject, case when swap then subject else object end as object, case when swap then object_label else subject_label end as subject_label, case when swap then subject_label else object_label end as object_label, coalesce(sense, canon_predicate) as canon_predicate, source_chunk_id, predicate_cue from turned")
def fk_fold_realign(spark: SparkSession, folder: str) -> DataFrame:
    """Predicates folded to the senses of their label pair, turned round where the structured relationship runs the other way."""
    folded = extraction.fold_senses(G.gated_triples(spark, folder).filter("gate = 'pass'"))
    return folded.select("subject", "object", "subject_label", "object_label", "canon_predicate", "source_chunk_id", "predicate_cue")


_INV = ", ".join(f"('{p}', '{r}', '{a}', '{b}')" for p, r, a, b in extraction.structured_relations())


@query(f"select * from (values {_INV}) v(pair, rel_type, src_label, dst_label)")
def fk_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(extraction.structured_relations(), "pair string, rel_type string, src_label string, dst_label string")


# ---------------------------------------------------------------- confidence


def _raw_scored(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered triples scored as they are, with their own match tags."""
    rows = table(spark, folder, "extracted_triples").distinct().withColumns({"s_key": G.real_key("subject_id"), "o_key": G.real_key("object_id"), "p_key": extraction.canonical_predicate("predicate")})
    return extraction.score(cut(rows), "s_key", "p_key", "o_key", "subject_match", "object_match")


_RAW = f"{S._SYN}, rawt as (select *, {S.real('subject_id')} as s_key, {S.real('object_id')} as o_key, {S.CANON} as p_key from (select distinct * from extracted_triples)), {S.scored('rawt', 's_key', 'p_key', 'o_key', 'subject_match', 'object_match')}"


@query(f"with {_RAW} select subject_id, predicate, object_id, source_chunk_id, predicate_cue, n_sources, round(s_endpoint, 6) as s_endpoint, s_grounding, round(s_corroboration, 6) as s_corroboration, round(confidence, 6) as confidence, promoted from scored")
def confidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("s_endpoint", "s_corroboration", "confidence")}
    return _raw_scored(spark, folder).withColumns(rounded).select("subject_id", "predicate", "object_id", "source_chunk_id", "predicate_cue", "n_sources", "s_endpoint", "s_grounding", "s_corroboration", "confidence", "promoted")


@query(f"with {S.OPS} select src_label, src, rel_type, dst_label, dst, confidence, source_chunk_id from ops")
def promoted_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.operations(spark, folder).select("src_label", "src", "rel_type", "dst_label", "dst", "confidence", "source_chunk_id")


@query(f"with {S.UPSERTED} select src_label, src, rel_type, dst_label, dst, origin, confidence, source_chunk_id, doc_corroborations from merged")
def upsert_corroboration(spark: SparkSession, folder: str) -> DataFrame:
    return G.merged_edges(spark, folder).select("src_label", "src", "rel_type", "dst_label", "dst", "origin", "confidence", "source_chunk_id", "doc_corroborations")


# ---------------------------------------------------------------- audit


def _gate_count(g: str) -> str:
    return f"count(*) filter (where gate = '{g}')"


@query(f"with {S.GATED} select count(*) as raw, {_gate_count('empty_or_loop')} as drop_empty_or_loop, {_gate_count('unresolved')} as drop_unresolved, {_gate_count('canonical_loop')} as drop_canonical, {_gate_count('pass')} as resolved, round({_gate_count('unresolved')} / count(*), 4) as unresolved_rate from gated")
def funnel(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.funnel(G.gated_triples(spark, folder))


_OUT = f"canon_predicate not in ({S.INVENTORY})"


@query(f"with {S.NORMALISED}, c as (select canon_predicate, count(*) as n from normalised group by 1) select count(*) as distinct_total, count(*) filter (where n = 1) as singletons, count(*) filter (where not {_OUT}) as inventory_distinct, count(*) filter (where {_OUT}) as residual_distinct, cast(coalesce(sum(n) filter (where {_OUT}), 0) as bigint) as residual_triples, round(coalesce(sum(n) filter (where {_OUT}), 0) / sum(n), 4) as residual_rate from c")
def predicate_audit(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.predicate_audit(G.normalised_triples(spark, folder))


@query(f"with {S.PASSED}, after_ as (select p.* replace (coalesce(v.canon, p.canon_predicate) as canon_predicate) from passed p left join over_ v on v.pair = {S.PAIR}) select (select count(distinct canon_predicate) from passed) as predicates_before, (select count(distinct canon_predicate) from after_) as predicates_after")
def predicate_kinds(spark: SparkSession, folder: str) -> DataFrame:
    passed = G.gated_triples(spark, folder).filter("gate = 'pass'")
    after = extraction.override_by_endpoints(passed).select(F.lit(1).alias("k"), "canon_predicate")
    both = passed.select(F.lit(0).alias("k"), "canon_predicate").unionByName(after)
    return both.agg(F.count_distinct(F.when(F.col("k") == 0, F.col("canon_predicate"))).alias("predicates_before"), F.count_distinct(F.when(F.col("k") == 1, F.col("canon_predicate"))).alias("predicates_after"))


@query(f"with {S.NORMALISED} select canon_predicate, count(*) as n from normalised where {_OUT} group by 1 order by n desc, canon_predicate limit 30")
def residual_top(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.residual_predicates(G.normalised_triples(spark, folder))


@query(f"with {S.NORMALISED}, e as (select subject_label, object_label, canon_predicate, count(*) as n from normalised where {_OUT} group by all) select * from (select *, count(*) over (partition by subject_label, object_label) as kinds from e) where kinds >= 2")
def pair_residual(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.pair_residuals(G.normalised_triples(spark, folder))


@query(f"with {S.NORMALISED} select count(*) filter (where {S.PAIR} in ({S.STRUCT_PAIRS})) as fk_redundant_edges, count(*) filter (where {S.PAIR} not in ({S.STRUCT_PAIRS})) as genuine_bridge_edges, count(distinct case when {S.PAIR} not in ({S.STRUCT_PAIRS}) then canon_predicate end) as genuine_bridge_types from normalised")
def bridge_split(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.bridge_split(G.normalised_triples(spark, folder))


@query(f"with {S.OPS} select rel_type, count(*) as n_edges from ops group by 1")
def rel_promoted_counts(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.promoted_by_relation(G.operations(spark, folder))


@query(f"with {S.GATED} select surface, count(*) as n from (select substr(trim(subject_id), 1, 60) as surface from gated where gate = 'unresolved' and subject is null union all select substr(trim(object_id), 1, 60) from gated where gate = 'unresolved' and object is null) group by 1 order by n desc, surface limit 30")
def unresolved_top(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.unresolved_top(G.gated_triples(spark, folder))


# ---------------------------------------------------------------- providers, without SQL


@query()
def extract_provider(spark: SparkSession, folder: str) -> DataFrame:
    """Raw triples of every chunk with two or more known entities, by id or name, by the default extractor."""
    from weftgraph.providers import extract_triples

    chunks = table(spark, folder, "chunks").select("chunk_id", "doc_id", "text").filter("chunk_id is not null and text is not null")
    return extract_triples(chunks, catalog.link_entities(chunks, "chunk_id", "text", G.project_catalog(spark, folder), also=("name",)))


def _normalised(spark: SparkSession, folder: str, mode: str, **options) -> DataFrame:
    from weftgraph.operators.normalize import normalise
    from weftgraph.providers import HashEmbedder

    passed = G.gated_triples(spark, folder).filter("gate = 'pass'")
    return normalise(passed, mode, HashEmbedder(), **options).select("subject", "canon_predicate", "object", "source_chunk_id")


@query()
def normalize_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """Predicates to the nearest sense of their label pair by the default embedder, with the operator's own thresholds."""
    return _normalised(spark, folder, "guarded_override")


@query()
def normalize_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Predicates of a label pair merged with those described alike, with the operator's own threshold."""
    return _normalised(spark, folder, "embed_cluster")


@query()
def entity_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Open mode: extracted entities with like surfaces merged."""
    from weftgraph.operators.normalize import merge_entities
    from weftgraph.providers import HashEmbedder

    gated = extraction.gate(table(spark, folder, "extracted_triples"), G.project_catalog(spark, folder), open_entities=True)
    return merge_entities(gated.filter("gate = 'pass'"), HashEmbedder()).select("subject", "canon_predicate", "object", "source_chunk_id")


@query()
def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The vector index table: chunk, document, place, text and vector."""
    from weftgraph.providers import embed

    return embed(table(spark, folder, "chunks").filter("chunk_id is not null and text is not null").distinct(), "text")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties behind code fences, read back as JSON."""
    from weftgraph.functions.json_repair import repaired_json

    raw = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, folder, "events").select("event_id", F.from_json(repaired_json(raw), "k bigint")["k"].alias("k"))
