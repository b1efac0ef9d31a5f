"""Common table expressions that the SQL of several queries begins with."""

from __future__ import annotations

from weftgraph.operators.extraction import ENDPOINT_PREDICATES, SENSES, SYNONYMS, inventory, structured_relations

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"


def norm(c: str) -> str:
    return f"upper(trim({c}, {BLANKS}))"


def real(c: str) -> str:
    return f"nullif({norm(c)}, '')"


def ref(c: str) -> str:
    return f"nullif({real(c)}, 'ALL')"


def values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


SUPPLIERS = f"suppliers as (select {real('supplier_id')} as supplier_id, min(recorded_at) as recorded_at from (select supplier_id, recorded_at from product_suppliers union all select supplier_id, recorded_at from purchase_orders) group by 1)"

_NODES = [("Product", 0, "products", "product_id", "product_name"), ("Supplier", 1, "suppliers", "supplier_id", None), ("Document", 4, "documents", "document_id", "title"), ("PurchaseOrder", 6, "purchase_orders", "purchase_order_id", None), ("Contract", 7, "contracts", "contract_id", None), ("Customer", 8, "customers", "customer_id", "customer_name"), ("Region", 9, "regions", "region_id", "region_name"), ("Line", 11, "production_lines", "line_id", "line_name")]


def _last(c: str) -> str:
    return f"arg_max(nullif({c}, ''), row(recorded_at, {c})) filter (where {c} <> '')"


NODES = f"{SUPPLIERS}, nodes as (" + " union all ".join(f"select '{label}' as label, {real(pk)} as id, {_last(name) if name else 'null::varchar'} as name from {t} where {real(pk)} is not null group by 2" for label, _, t, pk, name in _NODES) + ")"


def _exists(label: str, c: str) -> str:
    return f"exists (select 1 from nodes where label = '{label}' and id = {c})"


def _fk(table: str, a: str, pk: str, fk: str, b: str, rel: str) -> str:
    return f"select distinct '{a}' as src_label, {real(pk)} as src, '{rel}' as rel_type, '{b}' as dst_label, {ref(fk)} as dst, 'structured' as origin, null::double as confidence from {table} where {real(pk)} is not null and {_exists(b, ref(fk))}"


FK_EDGES = [("products", "Product", "product_id", "line_id", "Line", "ON_LINE"), ("customers", "Customer", "customer_id", "region_id", "Region", "IN_REGION"), ("purchase_orders", "PurchaseOrder", "purchase_order_id", "supplier_id", "Supplier", "FROM_SUPPLIER"), ("contracts", "Contract", "contract_id", "customer_id", "Customer", "FOR_CUSTOMER")]
_JUNCTIONS = [("product_suppliers", "Product", "product_id", "supplier_id", "Supplier", "SUPPLIED_BY"), ("purchase_orders", "PurchaseOrder", "purchase_order_id", "product_id", "Product", "ORDERS_PRODUCT")]


def _junction(table: str, a: str, fk1: str, fk2: str, b: str, rel: str) -> str:
    return f"select distinct '{a}', {real(fk1)}, '{rel}', '{b}', {real(fk2)}, 'structured', null::double from {table} where {_exists(a, real(fk1))} and {_exists(b, real(fk2))}"


SNAKE = "coalesce(nullif(upper(regexp_replace(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), '{}')"
LINKS = f"links as (select {real('document_id')} as src, {norm('entity_type')} as entity_type, case {norm('entity_type')} when 'CONTRACT' then 'Contract' when 'PURCHASE_ORDER' then 'PurchaseOrder' when 'ANOMALY' then 'AnomalyEvent' when 'SERVICE_TICKET' then 'ServiceTicket' end as dst_label, {real('entity_id')} as dst, {SNAKE.format('relationship', 'LINKS')} as rel_type, confidence from (select distinct * from document_links))"
LINK_EDGES = "select 'Document' as src_label, src, rel_type, dst_label, dst, 'document_link' as origin, max(confidence) as confidence from links where exists (select 1 from nodes where label = 'Document' and id = src) and exists (select 1 from nodes n where n.label = dst_label and n.id = dst) group by all"
STRUCTURED = " union all ".join([_fk(*f) for f in FK_EDGES] + [_junction(*j) for j in _JUNCTIONS])
GRAPH = f"{NODES}, {LINKS}, edges as ({STRUCTURED} union all {LINK_EDGES})"

# ---------------------------------------------------------------- catalogue and triples

CATALOG = f"{SUPPLIERS}, mentioned as (select distinct id from (select {real('subject_id')} as id from extracted_triples union all select {real('object_id')} from extracted_triples) where regexp_matches(id, '^(AE|DT|EQ)[0-9]+$')), catalog as (" + " union all ".join(f"select '{label}' as label, {n} as n, {real(pk)} as id, {f'min({name})' if name else 'null::varchar'} as name from {t} where {real(pk)} is not null group by 3" for label, n, t, pk, name in _NODES if label != "Document") + " union all select case substr(id, 1, 2) when 'AE' then 'AnomalyEvent' when 'DT' then 'DowntimeEvent' else 'Equipment' end, 100, id, null from mentioned)"
WSP = r"[\s\p{Z}]+"
_SYN = f"syn as (select * from (values {values([(w, canon) for canon, words in SYNONYMS.items() for w in words])}) v(word, canon))"
_SNAKED = "upper(regexp_replace(regexp_replace(coalesce(predicate, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
CANON = f"case when {_SNAKED} = '' then 'RELATED_TO' else coalesce((select canon from syn where word = {_SNAKED}), {_SNAKED}) end"

RESOLVED = f"""{CATALOG}, {_SYN},
vals as (select distinct v as value, {real('v')} as vid, lower(trim(v)) as vkey from (select subject_id as v from extracted_triples union all select object_id from extracted_triples) where v is not null),
names as (select lower(trim(name)) as name_key, arg_min(row(id, label, name), row(n, id)) as e, min(row(n, id)) as o from catalog where name is not null group by 1),
byid as (select id, arg_min(row(label, name), row(n, id)) as e from catalog group by 1),
known as (select value, coalesce(b.id, nm.e[1], pt.e[1]) as id, coalesce(b.e[1], nm.e[2], pt.e[2]) as label, coalesce(case when b.id is not null then b.e[2] end, nm.e[3], pt.e[3]) as name,
    case when b.id is not null then 'id' when nm.e is not null then 'name' when pt.e is not null then 'partial' else 'none' end as how
  from vals left join byid b on b.id = vid left join names nm on nm.name_key = vkey and b.id is null
  left join (select vkey as k, arg_min(n.e, n.o) as e from (select distinct vkey from vals) join names n on length(vkey) >= 4 and (contains(n.name_key, vkey) or contains(vkey, n.name_key)) group by 1) pt on pt.k = vkey and b.id is null and nm.e is null)"""


def _how(k: str) -> str:
    return f"case {k}.how when 'id' then case when regexp_matches(lower(coalesce(t.chunk_text, '')), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])' || regexp_escape(lower({k}.id)) || '([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)') then 'id' when contains(lower(coalesce(t.chunk_text, '')), lower({k}.name)) then 'name' else 'id' end when 'name' then 'name' when 'partial' then 'name' else 'none' end"


GATED = f"""{RESOLVED},
gated as (select t.*, s.id as subject, s.label as subject_label, {_how('s')} as subject_how, o.id as object, o.label as object_label, {_how('o')} as object_how, {CANON} as canon_predicate,
    case when {real('t.subject_id')} is null or {real('t.object_id')} is null or {real('t.subject_id')} = {real('t.object_id')} then 'empty_or_loop' when s.id is null or o.id is null then 'unresolved' when s.id = o.id then 'canonical_loop' else 'pass' end as gate
  from (select distinct * from extracted_triples) t left join known s on s.value = t.subject_id left join known o on o.value = t.object_id)"""

PAIR = "least(subject_label, object_label) || '|' || greatest(subject_label, object_label)"
_OVERRIDE = f"over_ as (select * from (values {values([('|'.join(sorted(p)), n) for p, n in ENDPOINT_PREDICATES.items()])}) v(pair, canon))"
PASSED = f"{GATED}, {_OVERRIDE}, passed as (select * from gated where gate = 'pass')"
NORMALISED = f"{PASSED}, normalised as (select p.* replace (coalesce(v.canon, p.canon_predicate) as canon_predicate) from passed p left join over_ v on v.pair = {PAIR})"
SQUEEZE = r"regexp_replace(lower(coalesce({}, '')), '[\s\p{{Z}}]+', ' ', 'g')"


def scored(source: str, subject: str = "subject", predicate: str = "canon_predicate", object_: str = "object", sh: str = "subject_how", oh: str = "object_how") -> str:
    pt = "case {} when 'id' then 1.0::double when 'name' then 0.5::double else 0.0::double end"
    cue, text = "trim(" + SQUEEZE.format("predicate_cue") + ")", SQUEEZE.format("chunk_text")
    return f"""src_ as (select {subject} as s, {predicate} as p, {object_} as o, count(distinct nullif(trim(source_chunk_id), '')) + count(*) filter (where nullif(trim(source_chunk_id), '') is null) as n_sources from {source} group by all),
scored0 as (select x.*, n_sources, ({pt.format(sh)} + {pt.format(oh)}) / 2.0::double as s_endpoint, case when {cue} <> '' and contains({text}, {cue}) then 1.0::double else 0.0::double end as s_grounding,
    case when n_sources <= 1 then 0.0::double else 1.0::double - 1.0::double / n_sources end as s_corroboration from {source} x left join src_ on {subject} is not distinct from s and {predicate} is not distinct from p and {object_} is not distinct from o),
scored as (select *, 0.4::double * s_endpoint + 0.4::double * s_grounding + 0.2::double * s_corroboration as confidence, 0.4::double * s_endpoint + 0.4::double * s_grounding + 0.2::double * s_corroboration >= 0.5 as promoted from scored0)"""


OPS = f"""{NORMALISED}, {scored('normalised')},
ops as (select subject_label as src_label, subject as src, canon_predicate as rel_type, object_label as dst_label, object as dst, round(confidence, 3) as confidence, source_doc_id as source_doc, source_chunk_id, predicate_cue as evidence, row(coalesce(source_doc_id, ''), coalesce(source_chunk_id, ''), coalesce(predicate_cue, ''), confidence) as ord from scored where promoted)"""
INVENTORY = ", ".join("'" + n + "'" for n in inventory())
STRUCT_PAIRS = ", ".join("'" + p + "'" for p in sorted({p for p, _, _, _ in structured_relations()}))
#: The structured edges without the common parts that OPS already has.
OPS_GRAPH = f"{OPS}, nodes as (" + NODES.split("nodes as (", 1)[1] + f", {LINKS}, edges as ({STRUCTURED} union all {LINK_EDGES})"
UPSERTED = f"""{OPS_GRAPH},
new_ as (select src_label, src, rel_type, dst_label, dst, arg_min(row(confidence, source_doc, source_chunk_id, evidence), ord) as e, count(*) as n from ops group by all),
merged as (select coalesce(o.src_label, n.src_label) as src_label, coalesce(o.src, n.src) as src, coalesce(o.rel_type, n.rel_type) as rel_type, coalesce(o.dst_label, n.dst_label) as dst_label, coalesce(o.dst, n.dst) as dst, coalesce(o.origin, 'extracted') as origin,
    case when o.origin is not null then o.confidence else n.e[1] end as confidence, case when o.origin is null then n.e[2] end as source_doc, case when o.origin is null then n.e[3] end as source_chunk_id, case when o.origin is null then n.e[4] end as evidence,
    nullif(cast(case when o.origin is not null then n.n else n.n - 1 end as bigint), 0) as doc_corroborations
  from edges o full join new_ n on o.src_label = n.src_label and o.src = n.src and o.rel_type = n.rel_type and o.dst_label = n.dst_label and o.dst = n.dst)"""

SENSE_LIST = SENSES
