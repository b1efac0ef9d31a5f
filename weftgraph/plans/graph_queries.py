"""Queries over the property graph: build, introspection, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import real_key
from weftgraph.operators import catalog, extraction, graph_build
from weftgraph.operators.graph_build import EdgeSet, Graph
from weftgraph.operators.specs import SUPPLY_CHAIN
from weftgraph.plans import introspect
from weftgraph.plans import sql_base as S
from weftgraph.plans.pattern import Compiler
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


# ---------------------------------------------------------------- shared parts


def project_catalog(spark: SparkSession, folder: str) -> DataFrame:
    known = catalog.build_catalog(spark, folder, extra={"suppliers": graph_build.derived_suppliers(spark, folder)})
    return cut(known.unionByName(catalog.mentioned_entities(table(spark, folder, "extracted_triples"))))


def gated_triples(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.gate(table(spark, folder, "extracted_triples"), project_catalog(spark, folder))


def normalised_triples(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.override_by_endpoints(gated_triples(spark, folder).filter("gate = 'pass'"))


def operations(spark: SparkSession, folder: str) -> DataFrame:
    return cut(extraction.promoted_operations(extraction.score(normalised_triples(spark, folder))))


def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.upsert(graph_build.supply_chain(spark, folder).all_edges(), operations(spark, folder))


def fused_graph(spark: SparkSession, folder: str) -> Graph:
    """The structured graph with the promoted edges of the documents as one edge set that holds their labels."""
    graph = graph_build.supply_chain(spark, folder)
    ops = operations(spark, folder)
    key = ["src_label", "src", "rel_type", "dst_label", "dst"]
    edges = ops.groupBy(*key).agg(F.min_by(F.struct("confidence", "source_doc", "source_chunk_id", "evidence"), "ord").alias("e")).select(*key, "e.*")
    known = catalog.mentioned_entities(table(spark, folder, "extracted_triples"))
    for label in catalog.ID_LABELS.values():
        graph.nodes[label], graph.names[label] = known.filter(F.col("label") == label).select("id"), None
    graph.edges.append(EdgeSet(None, None, "extracted", cut(edges)))
    return graph


def run_pattern(graph: Graph, text: str) -> DataFrame:
    return Compiler(graph).run(text, checked=False)


# ---------------------------------------------------------------- build


def _edge_query(source_sql: str) -> str:
    return f"with {S.GRAPH} select src_label, src, rel_type, dst_label, dst, origin from ({source_sql})"


@query(f"with {S.NODES} select label, id, name from nodes")
def node_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return graph_build.supply_chain(spark, folder).all_nodes()


@query(_edge_query("select * from edges where origin = 'structured' and rel_type in ('ON_LINE', 'IN_REGION', 'FROM_SUPPLIER', 'FOR_CUSTOMER')"))
def graph_fk_edges(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_build.supply_chain(spark, folder)
    graph.edges = [e for e in graph.edges if e.rel_type in ("ON_LINE", "IN_REGION", "FROM_SUPPLIER", "FOR_CUSTOMER")]
    return graph.all_edges().select("src_label", "src", "rel_type", "dst_label", "dst", "origin")


@query("select distinct 'Customer' as src_label, cast(c_custkey as varchar) as src, 'IN_NATION' as rel_type, 'Nation' as dst_label, cast(c_nationkey as varchar) as dst from customer where c_nationkey in (select n_nationkey from nation) union all select 'Supplier', cast(s_suppkey as varchar), 'IN_NATION', 'Nation', cast(s_nationkey as varchar) from supplier where s_nationkey in (select n_nationkey from nation) union all select 'Nation', cast(n_nationkey as varchar), 'IN_REGION', 'Region', cast(n_regionkey as varchar) from nation where n_regionkey in (select r_regionkey from region) union all select 'Order', cast(o_orderkey as varchar), 'FROM_CUSTOMER', 'Customer', cast(o_custkey as varchar) from orders where o_custkey in (select c_custkey from customer)")
def graph_fk_edges_star(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_build.star(spark, folder)
    graph.edges = [e for e in graph.edges if e.rel_type in ("IN_REGION", "IN_NATION", "FROM_CUSTOMER")]
    return graph.all_edges().select("src_label", "src", "rel_type", "dst_label", "dst")


@query(f"with {S.NODES}, j as (select {S.real('product_id')} as src, {S.real('supplier_id')} as dst, * from product_suppliers) select src, dst, {', '.join(f'arg_max({c}, row(recorded_at, {c})) filter (where {c} is not null) as {c}' for c in ('is_primary', 'supplier_part_no', 'contract_unit_cost', 'minimum_order_qty', 'valid_from', 'valid_to'))} from j where src in (select id from nodes where label = 'Product') and dst in (select id from nodes where label = 'Supplier') group by src, dst")
def graph_junction_edges(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_build.supply_chain(spark, folder)
    return next(e for e in graph.edges if e.rel_type == "SUPPLIED_BY").df


@query("select l_orderkey as src, l_partkey as dst, arg_max(l_quantity, row(l_linenumber, l_quantity)) as l_quantity, arg_max(l_extendedprice, row(l_linenumber, l_extendedprice)) as l_extendedprice from lineitem where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part) group by 1, 2")
def graph_junction_star(spark: SparkSession, folder: str) -> DataFrame:
    """Several order lines of one part collapse into one edge with the values of the last line."""
    return next(e for e in graph_build.star(spark, folder).edges if e.rel_type == "ORDERS_PART").df


@query(f"with {S.GRAPH} select src, rel_type, dst_label, dst, confidence from edges where origin = 'document_link'")
def doc_link_edges(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_build.supply_chain(spark, folder)
    graph.edges = [e for e in graph.edges if e.origin == "document_link"]
    return graph.all_edges().select("src", "rel_type", "dst_label", "dst", "confidence")


@query(f"with {S.NODES}, {S.LINKS} select entity_type, count(*) as n_links from links where dst_label is null or dst_label not in (select distinct label from nodes) group by 1")
def doc_link_deferred(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_build.supply_chain(spark, folder)
    return graph_build.deferred_links(table(spark, folder, "document_links"), SUPPLY_CHAIN.links[0], set(graph.nodes))


@query(f"with {S.GRAPH} select rel_type, origin, count(*) as n_edges from edges group by all")
def graph_report(spark: SparkSession, folder: str) -> DataFrame:
    return graph_build.report(graph_build.supply_chain(spark, folder).all_edges())


@query(f"with {S.NODES} select label, count(*) as n_nodes from nodes group by all")
def node_report(spark: SparkSession, folder: str) -> DataFrame:
    return graph_build.node_report(graph_build.supply_chain(spark, folder).all_nodes())


@query("select product_id, list_sort(list_filter([case when line_id <> '' then 'line_id=' || line_id end, case when product_name <> '' then 'product_name=' || product_name end, case when safety_stock is not null then 'safety_stock=' || safety_stock end], lambda x: x is not null)) as props from products")
def node_props_map(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of a row without its missing and empty values."""
    rows = table(spark, folder, "products").select("product_id", "line_id", "product_name", "safety_stock")
    return rows.select("product_id", F.array_sort(F.transform(F.map_entries(graph_build.props(rows, ("product_id",))), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("props"))


@query("select cast(l_orderkey as varchar) as pk, count(*) as n_rows from lineitem group by 1 having count(*) > 1")
def pk_violations(spark: SparkSession, folder: str) -> DataFrame:
    return graph_build.key_violations(table(spark, folder, "lineitem"), "l_orderkey")


@query(f"with {S.NODES} select distinct {S.real('doc_id')} as src, chunk_id as dst from chunks where {S.real('doc_id')} in (select id from nodes where label = 'Document') and chunk_id is not null")
def chunk_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph_build.chunk_edges(table(spark, folder, "chunks"), graph_build.supply_chain(spark, folder).nodes["Document"])


@query(f"with {S.OPS} select distinct c.chunk_id, c.doc_id, c.text from chunks c where c.chunk_id in (select source_chunk_id from ops)")
def chunk_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that promoted edges rest on."""
    wanted = operations(spark, folder).select(F.col("source_chunk_id").alias("chunk_id")).distinct()
    return table(spark, folder, "chunks").select("chunk_id", "doc_id", "text").join(wanted, "chunk_id", "left_semi").distinct()


# ---------------------------------------------------------------- introspection

_CATALOG_SQL = f"{S.UPSERTED}, relcat as (select src_label, rel_type, dst_label, coalesce(origin, 'unknown') as origin, count(*) as n_edges from merged group by all)"
_DEDUP_SQL = f"{_CATALOG_SQL}, kept as (select * from relcat r where origin <> 'extracted' or not exists (select 1 from relcat s where s.origin = 'structured' and least(s.src_label, s.dst_label) = least(r.src_label, r.dst_label) and greatest(s.src_label, s.dst_label) = greatest(r.src_label, r.dst_label)))"
_SUPPORT_SQL = f"{_DEDUP_SQL}, back as (select distinct rel_type from kept where origin in ('structured', 'document_link')), supp as (select rel_type, cast(sum(n_edges) as bigint) as support from kept where rel_type not in (select rel_type from back) group by 1)"


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return cut(introspect.relationship_catalog(merged_edges(spark, folder)))


@query(f"with {_CATALOG_SQL} select * from relcat")
def rel_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _catalog(spark, folder)


@query(f"with {S.UPSERTED} select distinct rel_type from merged")
def rel_types(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.relationship_types(merged_edges(spark, folder)).orderBy("rel_type")


@query(f"with {S.NODES} select distinct label from nodes")
def label_list(spark: SparkSession, folder: str) -> DataFrame:
    return graph_build.supply_chain(spark, folder).all_nodes().select("label").distinct().orderBy("label")


@query(f"with {S.UPSERTED} select distinct src_label, rel_type, dst_label from merged")
def observed_triples(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.observed_triples(merged_edges(spark, folder))


@query(f"with {S.UPSERTED}, said as (select rel_type, evidence, count(*) as n from merged where origin = 'extracted' and evidence is not null and evidence <> '' group by all), best as (select rel_type, arg_min(evidence, row(-n, length(evidence), evidence)) as e from said group by 1) select rel_type, case when length(trim(regexp_replace(e, '\\s+', ' ', 'g'))) > 100 then substr(trim(regexp_replace(e, '\\s+', ' ', 'g')), 1, 100) || '…' else trim(regexp_replace(e, '\\s+', ' ', 'g')) end as gloss from best")
def evidence_glosses(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.evidence_glosses(merged_edges(spark, folder))


@query(f"with {_DEDUP_SQL} select * from kept")
def schema_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.without_duplicates(_catalog(spark, folder)).select("src_label", "rel_type", "dst_label", "origin", "n_edges")


@query(f"with {_SUPPORT_SQL} select rel_type from back")
def schema_backbone(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.backbone(introspect.without_duplicates(_catalog(spark, folder)))


@query(f"with {_SUPPORT_SQL} select rel_type, support, support >= 2 as kept from supp")
def schema_support(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.support(introspect.without_duplicates(_catalog(spark, folder))).withColumn("kept", F.col("support") >= 2)


_BRIDGES = ", ".join("'" + "|".join(sorted(p)) + "'" for p in introspect.BRIDGE_PAIRS)


@query(f"with {_SUPPORT_SQL} select distinct rel_type from kept where least(src_label, dst_label) || '|' || greatest(src_label, dst_label) in ({_BRIDGES}) and rel_type in (select rel_type from supp where support >= 2)")
def schema_bridge_floor(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.bridge_floor(introspect.without_duplicates(_catalog(spark, folder)))


# ---------------------------------------------------------------- patterns


@query("select o_orderkey as orderkey, n_name as nation, c_mktsegment as segment, o_totalprice as price, cast(year(o_orderdate) as integer) as year from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where r_name = 'ASIA' and o_totalprice > 100000")
def path_3hop(spark: SparkSession, folder: str) -> DataFrame:
    return run_pattern(graph_build.star(spark, folder), "MATCH (r:Region {r_name: 'ASIA'})<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)<-[:FROM_CUSTOMER]-(o:Order) WHERE o.o_totalprice > 100000 RETURN o.o_orderkey AS orderkey, n.n_name AS nation, c.c_mktsegment AS segment, o.o_totalprice AS price, o.o_orderdate.year AS year")


@query("select c_custkey as custkey, o_orderkey as orderkey from customer left join (select * from orders where o_totalprice > 400000) on o_custkey = c_custkey")
def path_optional(spark: SparkSession, folder: str) -> DataFrame:
    return run_pattern(graph_build.star(spark, folder), "MATCH (c:Customer) OPTIONAL MATCH (c)-[:FROM_CUSTOMER]-(o:Order) WHERE o.o_totalprice > 400000 RETURN c.c_custkey AS custkey, o.o_orderkey AS orderkey")


@query("select n_name as nation, count(*) as n_suppliers, count(distinct r_name) as n_regions, max(s_acctbal) as best from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def path_undirected(spark: SparkSession, folder: str) -> DataFrame:
    """Arrows the wrong way round match the same edges."""
    return run_pattern(graph_build.star(spark, folder), "MATCH (s:Supplier)<-[:IN_NATION]-(n:Nation)<-[:IN_REGION]-(r:Region) RETURN n.n_name AS nation, count(*) AS n_suppliers, count(DISTINCT r.r_name) AS n_regions, max(s.s_acctbal) AS best")


@query("select cast(a.o_orderkey as bigint) as order_a, cast(b.o_orderkey as bigint) as order_b from customer join orders a on a.o_custkey = c_custkey join orders b on b.o_custkey = c_custkey and a.o_orderkey <> b.o_orderkey where c_mktsegment = 'BUILDING' and a.o_totalprice > 450000 and b.o_totalprice > 450000")
def path_edge_once(spark: SparkSession, folder: str) -> DataFrame:
    """Two hops over one relationship within a clause never use the same edge."""
    return run_pattern(graph_build.star(spark, folder), "MATCH (a:Order)-[:FROM_CUSTOMER]-(c:Customer {c_mktsegment: 'BUILDING'})-[:FROM_CUSTOMER]-(b:Order) WHERE a.o_totalprice > 450000 AND b.o_totalprice > 450000 RETURN a.o_orderkey AS order_a, b.o_orderkey AS order_b")


@query("with j as (select l_orderkey, l_partkey, arg_max(l_quantity, row(l_linenumber, l_quantity)) as q from lineitem group by 1, 2) select p_brand as brand, count(*) as n_lines, sum(q) as quantity from j join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' and q >= 40 group by 1")
def path_edge_property(spark: SparkSession, folder: str) -> DataFrame:
    return run_pattern(graph_build.star(spark, folder), "MATCH (o:Order {o_orderpriority: '1-URGENT'})-[r:ORDERS_PART]-(p:Part) WHERE r.l_quantity >= 40 RETURN p.p_brand AS brand, count(*) AS n_lines, sum(r.l_quantity) AS quantity")


_EXTRACTED_SQL = f"{S.OPS}, ex as (select src_label, src, rel_type, dst_label, dst, arg_min(row(confidence, source_chunk_id), ord) as e from ops group by all)"


@query(f"with {_EXTRACTED_SQL} select case when src_label = 'Contract' then src else dst end as contract, case when src_label = 'Contract' then dst else src end as product, rel_type as rel, e[2] as source_chunk_id from ex where ((src_label = 'Contract' and dst_label = 'Product') or (src_label = 'Product' and dst_label = 'Contract')) and e[1] >= 0.6")
def path_untyped(spark: SparkSession, folder: str) -> DataFrame:
    """A hop without a relationship type, told apart by origin and confidence."""
    return run_pattern(fused_graph(spark, folder), "MATCH (c:Contract)-[r]-(p:Product) WHERE r.origin = 'extracted' AND r.confidence >= 0.6 RETURN c.contract_id AS contract, p AS product, type(r) AS rel, r.source_chunk_id AS source_chunk_id")


@query(f"with {S.GRAPH} select s.dst as supplier, p.dst as line, count(*) as n_products from edges s join edges p on s.src = p.src and p.rel_type = 'ON_LINE' where s.rel_type = 'SUPPLIED_BY' group by all")
def structured_only(spark: SparkSession, folder: str) -> DataFrame:
    """The graph narrowed to what the tables say."""
    graph = graph_build.supply_chain(spark, folder)
    graph.edges = [e for e in graph.edges if e.origin == "structured"]
    return run_pattern(graph, "MATCH (s:Supplier)-[:SUPPLIED_BY]-(p:Product)-[:ON_LINE]-(l:Line) RETURN s AS supplier, l AS line, count(*) AS n_products")


@query(f"with {S.GRAPH} select d.id as document, c.dst as customer, e.rel_type as rel from edges e join nodes d on d.label = 'Document' and d.id = e.src join edges c on c.rel_type = 'FOR_CUSTOMER' and c.src = e.dst where e.dst_label = 'Contract'")
def path_document_link(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to customers over the contracts they are linked to; the relationship depends on the data."""
    return run_pattern(graph_build.supply_chain(spark, folder), "MATCH (d:Document)-[r]-(c:Contract)-[:FOR_CUSTOMER]-(k:Customer) RETURN d AS document, k AS customer, type(r) AS rel")


@query(f"with {S.UPSERTED} select origin, count(*) as n_edges, cast(coalesce(sum(doc_corroborations), 0) as bigint) as corroborations from merged group by 1")
def write_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and corroborations by origin after the upsert."""
    return merged_edges(spark, folder).groupBy("origin").agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("doc_corroborations"), F.lit(0)).cast("bigint").alias("corroborations"))


@query(f"with c as (select {S.real('supplier_id')} as supplier_id, supplier_part_no, try_cast(minimum_order_qty as double) as qty from product_suppliers) select supplier_id, count(*) as n, min(qty) as least_qty from c where supplier_id is not null group by 1")
def projection_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "product_suppliers").select(real_key("supplier_id").alias("supplier_id"), F.col("minimum_order_qty").try_cast("double").alias("qty")).filter("supplier_id is not null")
    return rows.groupBy("supplier_id").agg(F.count("*").alias("n"), F.min("qty").alias("least_qty"))
