"""Relational tables to a typed property graph held in DataFrames.

Nodes are one typed DataFrame per label. Edges are edge sets: one DataFrame (src, dst and
properties) per source label, relationship and target label, so a pattern reads only the
sets it names. The generic node and edge tables are unions of these.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.keys import norm_key, real_key, reference_key
from weftgraph.operators.specs import FkSpec, GraphSpec, JunctionSpec, LinkSpec, NodeSpec
from weftgraph.sources.tables import csv_table, optional_table

EDGE_COLUMNS = ["src_label", "src", "rel_type", "dst_label", "dst", "origin", "confidence", "source_doc", "source_chunk_id", "evidence", "doc_corroborations"]
_EDGE_TYPES = {"confidence": "double", "source_doc": "string", "source_chunk_id": "string", "evidence": "string", "doc_corroborations": "bigint"}


def clean_values(df: DataFrame, timestamps: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Listed columns as timestamps or dates, empty strings as null; unparsable values become null."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in timestamps:
            out[f.name] = F.try_to_timestamp(c.cast("string"))
        elif f.name in dates:
            out[f.name] = F.try_to_date(F.substring(c.cast("string"), 1, 10))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.nullif(c, F.lit(""))
    return df.withColumns(out) if out else df


def props(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A map of the columns that have a value: nulls and empty strings are no properties."""
    pairs = [x for c in df.columns if c not in without for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def key_violations(df: DataFrame, pk: str) -> DataFrame:
    """Keys that more than one row has, with the number of rows; nulls and blanks are no keys."""
    return df.select(real_key(F.col(pk).cast("string")).alias("pk")).filter("pk is not null").groupBy("pk").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def key_of(df: DataFrame, c: str, reference: bool = False) -> Column:
    """A key column ready to compare: text normalised (``ALL`` is no reference), numbers as they are."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return reference_key(c) if reference else real_key(c)
    return F.col(c)


def upsert_nodes(df: DataFrame, spec: NodeSpec, order: str | None) -> DataFrame:
    """One row per key; each property is the last non-missing value in load order.

    Keys are compared trimmed and upper-cased and come out as ``id``. Null and blank keys are
    no nodes. Without an order column any of several values may win; equal rows are equal anyway.
    Combined before the shuffle, so a key with many rows is no burden.
    """
    if spec.unique:
        return df.withColumn("id", key_of(df, spec.pk)).filter("id is not null")
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    rest = [c for c in df.columns if c not in (spec.pk, order)]
    aggs = []
    for c in rest:
        value = F.nullif(F.col(c), F.lit("")) if c in text else F.col(c)
        aggs.append(F.max_by(value, F.when(value.isNotNull(), F.struct(F.col(order), value))).alias(c) if order in df.columns else F.max(value).alias(c))
    if order in df.columns:
        aggs.append(F.max(order).alias(order))
    keyed = df.withColumn("id", key_of(df, spec.pk)).filter("id is not null")
    return keyed.groupBy("id").agg(*aggs) if aggs else keyed.select("id").distinct()


@dataclass
class EdgeSet:
    #: None where the labels depend on the data and stand in the columns src_label and dst_label
    src_label: str | None
    dst_label: str | None
    origin: str | None
    df: DataFrame
    #: None where the relationship depends on the data and stands in the column rel_type
    rel_type: str | None = None
    #: the same edges before it was checked that dst is a node; src is one. For plans that read the node of dst anyway
    unchecked: DataFrame | None = None
    #: the source nodes with all their columns and dst, where each has one edge at most
    wide: DataFrame | None = None


@dataclass
class Graph:
    nodes: dict[str, DataFrame]
    names: dict[str, str | None]
    edges: list[EdgeSet] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    pks: dict[str, str] = field(default_factory=dict)

    def all_nodes(self) -> DataFrame:
        """label, id, name of every node; name is null for labels without one."""
        parts = [df.select(F.lit(label).alias("label"), F.col("id").cast("string").alias("id"), (F.col(self.names[label]).cast("string") if self.names.get(label) in df.columns else F.lit(None).cast("string")).alias("name")) for label, df in self.nodes.items()]
        return reduce(DataFrame.unionByName, parts)

    def all_edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [edge_rows(e) for e in self.edges])


def edge_rows(e: EdgeSet) -> DataFrame:
    """An edge set in the generic columns."""
    labels = {k: F.lit(v) if v else F.col(k) for k, v in (("src_label", e.src_label), ("dst_label", e.dst_label))}
    cols = labels | {"origin": F.lit(e.origin).cast("string"), "rel_type": F.lit(e.rel_type) if e.rel_type else F.col("rel_type"), "src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")}
    for c, t in _EDGE_TYPES.items():
        cols[c] = F.col(c).cast(t) if c in e.df.columns else F.lit(None).cast(t)
    return e.df.select(*[cols[c].alias(c) for c in EDGE_COLUMNS])


def _ids(nodes: DataFrame, alias: str) -> DataFrame:
    return nodes.select(F.col("id").alias(alias))


def fk_edges(rows: DataFrame, spec: FkSpec, unique: bool = False) -> DataFrame:
    """(src, dst) of a foreign key, each pair once (rows of a ``unique`` key are so already).

    Null, blank and ``ALL`` values give no edge. The rows are those of the source nodes, so every
    src is a node; ``existing`` leaves out dangling targets.
    """
    refs = rows.select(key_of(rows, spec.src_pk).alias("src"), key_of(rows, spec.fk, True).alias("dst")).filter("src is not null and dst is not null")
    return refs if unique else refs.distinct()


def existing(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose dst is a node."""
    return edges.join(_ids(targets, "dst"), "dst", "left_semi").select(*edges.columns)


def junction_edges(rows: DataFrame, spec: JunctionSpec, sources: DataFrame, targets: DataFrame, order: str | None) -> DataFrame:
    """(src, dst, properties): one edge per pair, every property the last non-missing value in load order."""
    refs = rows.withColumn("src", key_of(rows, spec.src_fk)).withColumn("dst", key_of(rows, spec.dst_fk)).filter("src is not null and dst is not null")
    aggs = []
    for p in spec.props:
        value = F.col(p)
        aggs.append(F.max_by(value, F.when(value.isNotNull(), F.struct(F.col(order), value))).alias(p) if order in rows.columns else F.max(value).alias(p))
    pairs = refs.groupBy("src", "dst").agg(*aggs) if aggs else refs.select("src", "dst").distinct()
    return pairs.join(_ids(sources, "src"), "src", "left_semi").join(_ids(targets, "dst"), "dst", "left_semi").select("src", "dst", *spec.props)


def rel_type_of(c: Column | str) -> Column:
    """UPPER_SNAKE of a relationship value; nothing left gives LINKS."""
    c = F.col(c) if isinstance(c, str) else c
    snake = F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(snake, F.lit("")), F.lit("LINKS"))


def link_rows(rows: DataFrame, spec: LinkSpec) -> DataFrame:
    """Document links with the label of their type; label is null for types that are not known."""
    labels = F.create_map(*[F.lit(x) for kv in spec.labels.items() for x in kv])
    return rows.select(
        real_key(spec.src_fk).alias("src"),
        norm_key(spec.type_col).alias("entity_type"),
        F.try_element_at(labels, norm_key(spec.type_col)).alias("dst_label"),
        real_key(spec.dst_fk).alias("dst"),
        rel_type_of(spec.rel_col).alias("rel_type"),
        F.col("confidence").try_cast("double").alias("confidence") if "confidence" in rows.columns else F.lit(None).cast("double").alias("confidence"),
    )


def link_edges(rows: DataFrame, spec: LinkSpec, label: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, rel_type, confidence) of the links to ``label``; the highest confidence of a repeated link."""
    mine = link_rows(rows, spec).filter((F.col("dst_label") == label) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    once = mine.groupBy("src", "dst", "rel_type").agg(F.max("confidence").alias("confidence"))
    return once.join(_ids(sources, "src"), "src", "left_semi").join(_ids(targets, "dst"), "dst", "left_semi").select("src", "dst", "rel_type", "confidence")


def deferred_links(rows: DataFrame, spec: LinkSpec, loaded: set[str]) -> DataFrame:
    """How many links wait per type because the type is unknown or its label is not loaded."""
    typed = link_rows(rows.distinct(), spec)
    waiting = F.col("dst_label").isNull() | ~F.col("dst_label").isin(*sorted(loaded))
    return typed.filter(waiting).groupBy("entity_type").agg(F.count("*").alias("n_links"))


def chunk_edges(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """HAS_CHUNK edges (src document, dst chunk) of the chunks whose document exists."""
    refs = chunks.select(real_key("doc_id").alias("src"), F.col("chunk_id").alias("dst")).filter("src is not null and dst is not null").distinct()
    return refs.join(_ids(documents, "src"), "src", "left_semi").select("src", "dst")


def build(spark: SparkSession, folder: str, spec: GraphSpec, extra: dict[str, DataFrame] | None = None) -> Graph:
    """The structured and document-link part of the graph; what is not delivered is listed in ``skipped``.

    ``extra`` gives tables that are derived and not delivered, by table name.
    """
    cache: dict[str, DataFrame | None] = dict(extra or {})

    def get(name: str) -> DataFrame | None:
        if name not in cache:
            cache[name] = optional_table(spark, folder, name)
        return cache[name]

    graph = Graph({}, {})
    for n in spec.nodes:
        rows = get(n.table)
        if rows is None:
            graph.skipped.append(n.label)
            continue
        graph.nodes[n.label], graph.names[n.label], graph.pks[n.label] = upsert_nodes(rows, n, spec.order).withColumn(n.pk, F.col("id")), n.name, n.pk
    for f in spec.fks:
        if get(f.table) is None or f.src_label not in graph.nodes or f.dst_label not in graph.nodes:
            graph.skipped.append(f"{f.src_label}-{f.rel_type}-{f.dst_label}")
            continue
        unique = any(n.label == f.src_label and n.unique for n in spec.nodes)
        pairs, sources = fk_edges(get(f.table), f, unique), graph.nodes[f.src_label]
        wide = sources.withColumn("dst", key_of(sources, f.fk, True)).filter("dst is not null") if unique else None
        graph.edges.append(EdgeSet(f.src_label, f.dst_label, "structured", existing(pairs, graph.nodes[f.dst_label]), f.rel_type, pairs, wide))
    for j in spec.junctions:
        if get(j.table) is None or j.src_label not in graph.nodes or j.dst_label not in graph.nodes:
            graph.skipped.append(f"{j.src_label}-{j.rel_type}-{j.dst_label}")
            continue
        graph.edges.append(EdgeSet(j.src_label, j.dst_label, "structured", junction_edges(get(j.table), j, graph.nodes[j.src_label], graph.nodes[j.dst_label], spec.order), j.rel_type))
    for k in spec.links:
        if get(k.table) is None or k.src_label not in graph.nodes:
            continue
        for label in sorted(set(k.labels.values()) & set(graph.nodes)):
            graph.edges.append(EdgeSet(k.src_label, label, "document_link", link_edges(get(k.table), k, label, graph.nodes[k.src_label], graph.nodes[label])))
    return graph


def with_chunks(graph: Graph, chunks: DataFrame) -> Graph:
    """The graph with the chunks as nodes and a HAS_CHUNK edge, of no origin, from the document of each."""
    node = chunks.select(F.col("chunk_id").alias("id"), "chunk_id", "doc_id", "seq", "text").filter("id is not null")
    graph.nodes["Chunk"] = node.groupBy("id", "chunk_id").agg(F.min(F.struct("doc_id", "seq", "text")).alias("c")).select("id", "chunk_id", "c.*")
    graph.names["Chunk"], graph.pks["Chunk"] = None, "chunk_id"
    graph.edges.append(EdgeSet("Document", "Chunk", None, chunk_edges(chunks, graph.nodes["Document"]), "HAS_CHUNK"))
    return graph


def report(edges: DataFrame) -> DataFrame:
    """Edges per relationship and origin."""
    return edges.groupBy("rel_type", "origin").agg(F.count("*").alias("n_edges"))


def node_report(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n_nodes"))


def derived_suppliers(spark: SparkSession, folder: str) -> DataFrame | None:
    """Suppliers named by agreements and orders, where no table of suppliers is delivered."""
    parts = [t.select("supplier_id", "recorded_at") for t in (optional_table(spark, folder, n) for n in ("product_suppliers", "purchase_orders")) if t is not None]
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy(real_key("supplier_id").alias("supplier_id")).agg(F.min("recorded_at").alias("recorded_at")).withColumn("supplier_name", F.lit(None).cast("string"))


def supply_chain(spark: SparkSession, folder: str, csv: bool = False) -> Graph:
    """The graph of the delivered tables, parquet or ``csv``; suppliers are derived where they have no table."""
    from weftgraph.operators.specs import SUPPLY_CHAIN

    if not csv:
        return build(spark, folder, SUPPLY_CHAIN, {"suppliers": derived_suppliers(spark, folder)})
    names = {x.table for x in (*SUPPLY_CHAIN.nodes, *SUPPLY_CHAIN.fks, *SUPPLY_CHAIN.junctions, *SUPPLY_CHAIN.links)}
    tables = {n: csv_table(spark, folder, n) for n in sorted(names)}
    if tables["suppliers"] is None:
        known = [t for t in (tables["product_suppliers"], tables["purchase_orders"]) if t is not None and "supplier_id" in t.columns]
        tables["suppliers"] = reduce(DataFrame.unionByName, [t.select(real_key("supplier_id").alias("supplier_id")) for t in known]).distinct() if known else None
    return build(spark, folder, SUPPLY_CHAIN, tables)


def star(spark: SparkSession, folder: str) -> Graph:
    from weftgraph.operators.specs import STAR

    return build(spark, folder, STAR)
