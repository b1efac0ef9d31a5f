"""References to records that do not exist: direct orphans and their cascade.

A reference names a record of another table by key. It is orphaned when that record
was deleted, is missing, or became known only after the referring row. A record that
holds an orphaned reference makes the records that refer to it orphans by inheritance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import norm_key, real_key, reference_key
from weftgraph.operators.skew import salted_join
from weftgraph.runtime import cut

#: ref_table, row_key, target_table, target_key, recorded_at
REF_COLUMNS = ["ref_table", "row_key", "target_table", "target_key", "recorded_at"]

#: Orphaned keys (two short strings each, so some 10 MB) that a round hands to every executor; more are joined by shuffle.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Reference:
    """One foreign key: rows of ``ref_table`` name rows of ``target_table``."""

    ref_table: str
    row_key: str
    fk: str
    target_table: str
    #: column and (upper-case) value that a row must have for the reference to hold
    when: tuple[str, str] | None = None


@dataclass(frozen=True)
class Target:
    table: str
    key: str


def references(rows: DataFrame, ref: Reference) -> DataFrame:
    """The references of one foreign key in the columns ``REF_COLUMNS``, as delivered (``judge`` counts repeated rows once).

    Null, blank and ``ALL`` are no references. Row keys are given trimmed and upper-cased.
    """
    if ref.when:
        rows = rows.filter(norm_key(ref.when[0]) == ref.when[1])
    return (
        rows.select(F.lit(ref.ref_table).alias("ref_table"), norm_key(ref.row_key).alias("row_key"), F.lit(ref.target_table).alias("target_table"), reference_key(ref.fk).alias("target_key"), F.col("recorded_at"))
        .filter(F.col("target_key").isNotNull())
    )


def target_spans(tables: dict[str, DataFrame], targets: list[Target], removed: DataFrame) -> DataFrame:
    """Per target key: when it was first and last recorded, and last removed; keys only removed are kept.

    One aggregation over the union of all targets; combined before the shuffle.
    """
    parts = [tables[t.table].select(F.lit(t.table).alias("target_table"), real_key(t.key).alias("target_key"), F.col("recorded_at").alias("seen"), F.lit(None).cast("timestamp_ntz").alias("gone"), F.lit(1).alias("row"), F.lit(0).alias("removal")) for t in targets]
    parts.append(removed.select(F.lower(F.btrim("ref_table")).alias("target_table"), real_key("ref_key").alias("target_key"), F.lit(None).cast("timestamp_ntz").alias("seen"), F.col("removed_at").alias("gone"), F.lit(0).alias("row"), F.lit(1).alias("removal")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return (
        union.filter(F.col("target_key").isNotNull())
        .groupBy("target_table", "target_key")
        .agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.max("gone").alias("gone"), F.max("row").alias("present"), F.max("removal").alias("removed"))
    )


def judge(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each distinct reference with its ``reason``: deleted, missing, late, or null where the target is valid.

    ``deleted`` goes before ``missing`` before ``late``. A removal without a time counts as
    after every row. A referring row without recorded_at is never late.
    """
    joined = salted_join(refs, spans, ["target_table", "target_key"], F.struct("ref_table", "row_key"), distinct=True)
    deleted = (F.col("removed") == 1) & ~F.coalesce(F.col("last_seen") > F.col("gone"), F.lit(False))
    reason = F.when(deleted, "deleted").when(F.coalesce(F.col("present"), F.lit(0)) == 0, "missing").when(F.col("first_seen") > F.col("recorded_at"), "late")
    return joined.select(*REF_COLUMNS, reason.alias("reason"))


#: Rounds after which the lists found so far are written as one, so that plans stay short.
MERGE_ROUNDS = 16


def orphan_cascade(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Direct and inherited orphans over the whole foreign-key graph, to the fixpoint.

    Returns ref_table, row_key, target_table, target_key, recorded_at, reason, level.
    Level 0 rows are direct orphans (reason deleted, missing or late). A row at level n > 0
    (reason ``inherited``) refers to a valid record that is an orphan of level n - 1; it is
    listed once, at the first level that reaches it. Each round is a semi-join of the
    valid references with the records that became orphans in the round before; a record
    becomes one once, so cycles end, and only keys are written per round, never the references
    that are left. Rounds go on until none is reached, however deep the graph. Empty tables give no rows.
    """
    judged = cut(judge(refs, spans))
    found = [judged.filter(F.col("reason").isNotNull()).withColumn("level", F.lit(0))]
    valid = judged.filter(F.col("reason").isNull()).drop("reason")
    known: DataFrame | None = None  # records that are orphans
    level = total = 0
    while True:
        new = found[-1].select(F.col("ref_table").alias("target_table"), F.col("row_key").alias("target_key")).filter("target_key is not null").distinct()
        new = cut(new if known is None else _meet(new, known, total, ["target_table", "target_key"], "left_anti", F.col("target_key")))
        size = new.count()
        if not size:
            return reduce(DataFrame.unionByName, found)
        level, total = level + 1, total + size
        reached = cut(_meet(valid, new, size, ["target_table", "target_key"], "left_semi", F.struct("ref_table", "row_key")))
        found.append(reached.withColumn("reason", F.lit("inherited")).withColumn("level", F.lit(level)))
        known = new if known is None else known.unionByName(new)
        if level % MERGE_ROUNDS == 0:
            known, found = cut(known), [cut(reduce(DataFrame.unionByName, found[:-1])), found[-1]]


def _meet(rows: DataFrame, keys: DataFrame, size: int, on: list[str], how: str, spread: Column) -> DataFrame:
    """Rows whose key is among the ``size`` counted ``keys``, or is not: by broadcast up to BROADCAST_KEYS, else salted."""
    if size <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), on, how)
    return salted_join(rows, keys, on, spread, how=how)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, target, reason, kind (direct or inherited) and month of recording."""
    return orphans.groupBy("ref_table", "target_table", "reason", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind"), F.date_format("recorded_at", "yyyy-MM").alias("ref_month")).agg(F.count("*").alias("n_refs"), F.countDistinct("row_key").alias("n_rows"))


# ---------------------------------------------------------------- the project's foreign keys

#: The references whose direct orphans are asked for.
JUDGED = [
    Reference("document_links", "document_link_id", "entity_id", "contracts", ("entity_type", "CONTRACT")),
    Reference("document_links", "document_link_id", "entity_id", "purchase_orders", ("entity_type", "PURCHASE_ORDER")),
    Reference("products", "product_id", "line_id", "production_lines"),
    Reference("customers", "customer_id", "region_id", "regions"),
]
#: Further edges along which orphans are inherited.
INNER = [
    Reference("contracts", "contract_id", "customer_id", "customers"),
    Reference("purchase_orders", "purchase_order_id", "product_id", "products"),
]
TARGETS = [Target("contracts", "contract_id"), Target("purchase_orders", "purchase_order_id"), Target("production_lines", "line_id"), Target("regions", "region_id"), Target("customers", "customer_id"), Target("products", "product_id")]


def project_orphans(spark: SparkSession, folder: str) -> DataFrame:
    from weftgraph.sources.tables import table

    names = {r.ref_table for r in JUDGED + INNER} | {t.table for t in TARGETS}
    tables = {n: table(spark, folder, n) for n in names}
    refs = None
    for r in JUDGED + INNER:
        part = references(tables[r.ref_table], r)
        refs = part if refs is None else refs.unionByName(part)
    return orphan_cascade(refs, target_spans(tables, TARGETS, table(spark, folder, "removed_keys")))
