"""Declared node, foreign-key, junction and document-link specifications."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class NodeSpec:
    label: str
    table: str
    pk: str
    name: str | None = None
    #: the key is declared unique, so rows are nodes as they are
    unique: bool = False


@dataclass(frozen=True)
class FkSpec:
    table: str
    src_label: str
    src_pk: str
    fk: str
    dst_label: str
    rel_type: str


@dataclass(frozen=True)
class JunctionSpec:
    table: str
    src_label: str
    src_fk: str
    dst_label: str
    dst_fk: str
    rel_type: str
    props: tuple[str, ...] = ()


@dataclass(frozen=True)
class LinkSpec:
    """Rows that link a document to an entity whose label depends on a type column."""

    table: str
    src_label: str
    src_fk: str
    type_col: str
    dst_fk: str
    rel_col: str
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class GraphSpec:
    nodes: tuple[NodeSpec, ...]
    fks: tuple[FkSpec, ...] = ()
    junctions: tuple[JunctionSpec, ...] = ()
    links: tuple[LinkSpec, ...] = ()
    #: column that gives the load order, on which "later wins" rests
    order: str | None = None


# The supply-chain graph. Tables that are not delivered are skipped and reported.
SUPPLY_CHAIN = GraphSpec(
    nodes=(
        NodeSpec("Product", "products", "product_id", "product_name"),
        NodeSpec("Supplier", "suppliers", "supplier_id", "supplier_name"),
        NodeSpec("AnomalyEvent", "anomaly_events", "anomaly_id"),
        NodeSpec("DowntimeEvent", "downtime_events", "downtime_id"),
        NodeSpec("Document", "documents", "document_id", "title"),
        NodeSpec("ServiceTicket", "service_tickets", "ticket_id"),
        NodeSpec("PurchaseOrder", "purchase_orders", "purchase_order_id"),
        NodeSpec("Contract", "contracts", "contract_id"),
        NodeSpec("Customer", "customers", "customer_id", "customer_name"),
        NodeSpec("Region", "regions", "region_id", "region_name"),
        NodeSpec("Equipment", "equipment", "equipment_id", "equipment_name"),
        NodeSpec("Line", "production_lines", "line_id", "line_name"),
    ),
    fks=(
        FkSpec("equipment", "Equipment", "equipment_id", "line_id", "Line", "ON_LINE"),
        FkSpec("products", "Product", "product_id", "line_id", "Line", "ON_LINE"),
        FkSpec("anomaly_events", "AnomalyEvent", "anomaly_id", "equipment_id", "Equipment", "ON_EQUIPMENT"),
        FkSpec("downtime_events", "DowntimeEvent", "downtime_id", "equipment_id", "Equipment", "ON_EQUIPMENT"),
        FkSpec("downtime_events", "DowntimeEvent", "downtime_id", "anomaly_id", "AnomalyEvent", "LINKED_ANOMALY"),
        FkSpec("downtime_events", "DowntimeEvent", "downtime_id", "affected_product_id", "Product", "AFFECTED_PRODUCT"),
        FkSpec("customers", "Customer", "customer_id", "region_id", "Region", "IN_REGION"),
        FkSpec("service_tickets", "ServiceTicket", "ticket_id", "customer_id", "Customer", "FROM_CUSTOMER"),
        FkSpec("service_tickets", "ServiceTicket", "ticket_id", "product_id", "Product", "ABOUT_PRODUCT"),
        FkSpec("purchase_orders", "PurchaseOrder", "purchase_order_id", "supplier_id", "Supplier", "FROM_SUPPLIER"),
        FkSpec("contracts", "Contract", "contract_id", "customer_id", "Customer", "FOR_CUSTOMER"),
    ),
    junctions=(
        JunctionSpec("product_suppliers", "Product", "product_id", "Supplier", "supplier_id", "SUPPLIED_BY", ("is_primary", "supplier_part_no", "contract_unit_cost", "minimum_order_qty", "valid_from", "valid_to")),
        JunctionSpec("purchase_orders", "PurchaseOrder", "purchase_order_id", "Product", "product_id", "ORDERS_PRODUCT", ("order_qty",)),
    ),
    links=(LinkSpec("document_links", "Document", "document_id", "entity_type", "entity_id", "relationship", {"ANOMALY": "AnomalyEvent", "SERVICE_TICKET": "ServiceTicket", "PURCHASE_ORDER": "PurchaseOrder", "CONTRACT": "Contract"}),),
    order="recorded_at",
)

# The star-schema graph.
STAR = GraphSpec(
    nodes=(
        NodeSpec("Region", "region", "r_regionkey", "r_name", unique=True),
        NodeSpec("Nation", "nation", "n_nationkey", "n_name", unique=True),
        NodeSpec("Customer", "customer", "c_custkey", "c_name", unique=True),
        NodeSpec("Supplier", "supplier", "s_suppkey", "s_name", unique=True),
        NodeSpec("Part", "part", "p_partkey", "p_name", unique=True),
        NodeSpec("Order", "orders", "o_orderkey", unique=True),
    ),
    fks=(
        FkSpec("nation", "Nation", "n_nationkey", "n_regionkey", "Region", "IN_REGION"),
        FkSpec("customer", "Customer", "c_custkey", "c_nationkey", "Nation", "IN_NATION"),
        FkSpec("supplier", "Supplier", "s_suppkey", "s_nationkey", "Nation", "IN_NATION"),
        FkSpec("orders", "Order", "o_orderkey", "o_custkey", "Customer", "FROM_CUSTOMER"),
    ),
    junctions=(
        JunctionSpec("lineitem", "Order", "l_orderkey", "Part", "l_partkey", "ORDERS_PART", ("l_quantity", "l_extendedprice")),
        JunctionSpec("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey", "SHIPPED_BY"),
    ),
    order="l_linenumber",
)
