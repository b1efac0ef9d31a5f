"""Queries p2, p3 and p5: orphan references, periods and gaps, costs as known at order time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import norm_key, real_key
from weftgraph.operators import asof, intervals, references
from weftgraph.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    judged = references.project_orphans(spark, folder)
    tables = list(dict.fromkeys(r.ref_table for r in references.JUDGED))
    return judged.filter((F.col("level") == 0) & F.col("ref_table").isin(tables)).select("ref_table", "row_key", "reason", F.date_format("recorded_at", "yyyy-MM").alias("ref_month")).distinct()


def p2_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Every direct and inherited orphan of the foreign-key graph."""
    rows = references.project_orphans(spark, folder)
    return rows.select("ref_table", "row_key", "target_table", "target_key", "reason", "level", F.date_format("recorded_at", "yyyy-MM").alias("ref_month"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_counts(references.project_orphans(spark, folder))


def _periods(spark: SparkSession, folder: str) -> DataFrame:
    contracts = intervals.intervals(table(spark, folder, "contracts"), "contracts", ["customer_id"], "contract_id", "start_date", "end_date")
    agreements = intervals.intervals(table(spark, folder, "product_suppliers"), "product_suppliers", ["product_id", "supplier_id"], "agreement_id", "valid_from", "valid_to")
    return intervals.periods_and_gaps(contracts.unionByName(agreements))


def _days(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _periods(spark, folder).filter((F.col("kind") == "gap") | F.col("shared"))
    return _days(rows.withColumn("kind", F.when(F.col("kind") == "gap", "gap").otherwise("overlap")).drop("shared"))


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    """All continuous periods and the holes between them."""
    return _days(_periods(spark, folder))


def _orders_and_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pair = [real_key(c).alias(c) for c in ("product_id", "supplier_id")]
    orders = table(spark, folder, "purchase_orders").select(norm_key("purchase_order_id").alias("purchase_order_id"), *pair, F.unix_date("order_date").alias("day"))
    versions = (
        table(spark, folder, "product_suppliers")
        .filter(F.col("contract_unit_cost").isNotNull())
        .select(*pair, "agreement_id", "contract_unit_cost", "recorded_at", F.greatest(F.unix_date("valid_from"), F.unix_date(F.to_date("recorded_at"))).alias("start"), F.coalesce(F.unix_date("valid_to") + 1, F.lit(asof.FOREVER)).alias("stop"))
        .filter(F.expr("valid_from is not null and recorded_at is not null"))
    )
    return orders, versions


RANK = ("recorded_at", "agreement_id", "contract_unit_cost")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    orders, versions = _orders_and_versions(spark, folder)
    hit = asof.as_known_at(orders.filter("day is not null and product_id is not null and supplier_id is not null"), versions, ["product_id", "supplier_id"], "day", "purchase_order_id", F.struct(*RANK))
    # orders delivered twice have the same winner, so they meet here, where rows are few and short
    return hit.select("purchase_order_id", F.col("winner.agreement_id").alias("agreement_id")).distinct()


def p5_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Every order with its contract cost; null where none was in force and known."""
    orders, versions = _orders_and_versions(spark, folder)
    hit = asof.as_known_at(orders.distinct(), versions, ["product_id", "supplier_id"], "day", "purchase_order_id", F.struct(*RANK), how="left")
    return hit.select("purchase_order_id", "product_id", "supplier_id", F.date_from_unix_date("day").alias("order_date"), F.col("winner.agreement_id").alias("agreement_id"), F.col("winner.contract_unit_cost").alias("contract_unit_cost"))


# ---------------------------------------------------------------- the same in SQL

_T = "upper(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)))"


def _k(c: str) -> str:
    return _T.format(c)


def _ref_sql(ref: str, key: str, fk: str, target: str, where: str = "true") -> str:
    return f"select distinct '{ref}' as ref_table, {_k(key)} as row_key, '{target}' as target_table, nullif(nullif({_k(fk)}, ''), 'ALL') as target_key, recorded_at from {ref} where {where}"


_REFS = " union all ".join(
    [
        _ref_sql("document_links", "document_link_id", "entity_id", "contracts", f"{_k('entity_type')} = 'CONTRACT'"),
        _ref_sql("document_links", "document_link_id", "entity_id", "purchase_orders", f"{_k('entity_type')} = 'PURCHASE_ORDER'"),
        _ref_sql("products", "product_id", "line_id", "production_lines"),
        _ref_sql("customers", "customer_id", "region_id", "regions"),
    ]
)
_INNER = " union all ".join([_ref_sql("contracts", "contract_id", "customer_id", "customers"), _ref_sql("purchase_orders", "purchase_order_id", "product_id", "products")])
_SEEN = " union all ".join(f"select '{t}' as t, {_k(k)} as k, recorded_at as r from {t}" for t, k in (("contracts", "contract_id"), ("purchase_orders", "purchase_order_id"), ("production_lines", "line_id"), ("regions", "region_id"), ("customers", "customer_id"), ("products", "product_id")))
_JUDGED = f"""
refs as ({{refs}}),
seen as ({_SEEN}),
gone as (select distinct lower(trim(ref_table)) as t, {_k('ref_key')} as k, removed_at from removed_keys),
judged as (
  select ref_table, row_key, target_table, target_key, recorded_at,
    case when exists (select 1 from gone g where g.t = target_table and g.k = target_key and not exists (select 1 from seen s where s.t = target_table and s.k = target_key and s.r > g.removed_at)) then 'deleted'
         when not exists (select 1 from seen s where s.t = target_table and s.k = target_key) then 'missing'
         when (select min(s.r) from seen s where s.t = target_table and s.k = target_key) > recorded_at then 'late' end as reason
  from refs where target_key is not null)"""

_CASCADE = f"""with {_JUDGED.format(refs=_REFS + " union all " + _INNER)},
l0 as (select *, 0 as level from judged where reason is not null),
l1 as (select j.* exclude (reason), 'inherited' as reason, 1 as level from judged j where reason is null and exists (select 1 from l0 o where o.ref_table = j.target_table and o.row_key = j.target_key)),
l2 as (select j.* exclude (reason), 'inherited' as reason, 2 as level from judged j where reason is null and exists (select 1 from l1 o where o.ref_table = j.target_table and o.row_key = j.target_key)
       and not exists (select 1 from l1 o where o.ref_table = j.ref_table and o.row_key = j.row_key and o.target_table = j.target_table and o.target_key = j.target_key and o.recorded_at is not distinct from j.recorded_at)),
orphans as (select * from l0 union all by name select * from l1 union all by name select * from l2)"""

_SPANS = f"""
raw as (select 'contracts' as t, {_k('customer_id')} as e, {_k('contract_id')} as r, start_date as a, coalesce(end_date, date '9999-12-31') as b from contracts
        union all select 'product_suppliers', nullif({_k('product_id')}, '') || '|' || nullif({_k('supplier_id')}, ''), cast(agreement_id as varchar), valid_from, coalesce(valid_to, date '9999-12-31') from product_suppliers),
iv as (select distinct t, e, r, a - date '1970-01-01' as a, b - date '1970-01-01' as b from raw where e is not null and e <> '' and r is not null and a is not null and b >= a),
own as (select *, case when a <= max(b) over (partition by t, e, r order by a, b rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as new from iv),
own2 as (select *, sum(new) over (partition by t, e, r order by a, b rows unbounded preceding) as g from own),
rec as (select t, e, r, g, min(a) as a, max(b) as b from own2 group by all),
st as (select *, max(b) over (partition by t, e order by a, b, r, g rows between unbounded preceding and 1 preceding) as pb from rec),
st2 as (select *, sum(case when a <= pb + 1 then 0 else 1 end) over (partition by t, e order by a, b, r, g rows unbounded preceding) as p from st),
periods as (select t, e, p, min(a) as a, max(b) as b, bool_or(coalesce(a <= pb, false)) as shared from st2 group by all),
holes as (select t, e, b + 1 as a, lead(a) over (partition by t, e order by a) - 1 as b from periods)"""


def _day(x: str) -> str:
    return f"strftime(date '1970-01-01' + cast({x} as integer), '%Y-%m-%d')"


_FITS = f"""
o as (select distinct {_k('purchase_order_id')} as purchase_order_id, nullif({_k('product_id')}, '') as product_id, nullif({_k('supplier_id')}, '') as supplier_id, order_date from purchase_orders),
s as (select distinct agreement_id, {_k('product_id')} as product_id, {_k('supplier_id')} as supplier_id, contract_unit_cost, valid_from, valid_to, recorded_at from product_suppliers where contract_unit_cost is not null),
fit as (select o.purchase_order_id, o.product_id, o.supplier_id, o.order_date, s.agreement_id, s.contract_unit_cost,
          row_number() over (partition by o.purchase_order_id, o.product_id, o.supplier_id, o.order_date order by s.recorded_at desc, s.agreement_id desc, s.contract_unit_cost desc) as n
        from o join s using (product_id, supplier_id) where s.valid_from <= o.order_date and coalesce(s.valid_to, date '9999-12-31') >= o.order_date and cast(s.recorded_at as date) <= o.order_date)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_cascade, p2_counts, p3_found, p3_periods, p5_found, p5_costs)}
SQL = {
    "p2_found": f"with {_JUDGED.format(refs=_REFS)} select distinct ref_table, row_key, reason, strftime(recorded_at, '%Y-%m') as ref_month from judged where reason is not null",
    "p2_cascade": f"{_CASCADE} select ref_table, row_key, target_table, target_key, reason, level, strftime(recorded_at, '%Y-%m') as ref_month from orphans",
    "p2_counts": f"{_CASCADE} select ref_table, target_table, reason, case when level = 0 then 'direct' else 'inherited' end as kind, strftime(recorded_at, '%Y-%m') as ref_month, count(*) as n_refs, count(distinct row_key) as n_rows from orphans group by all",
    "p3_found": f"with {_SPANS} select t as ref_table, e as entity_key, 'overlap' as kind, {_day('a')} as first_day, {_day('b')} as last_day from periods where shared union all select t, e, 'gap', {_day('a')}, {_day('b')} from holes where b is not null",
    "p3_periods": f"with {_SPANS} select t as ref_table, e as entity_key, 'period' as kind, {_day('a')} as first_day, {_day('b')} as last_day, shared from periods union all select t, e, 'gap', {_day('a')}, {_day('b')}, false from holes where b is not null",
    "p5_found": f"with {_FITS} select purchase_order_id, agreement_id from fit where n = 1",
    "p5_costs": f"with {_FITS} select o.*, f.agreement_id, f.contract_unit_cost from o left join fit f on f.n = 1 and f.purchase_order_id = o.purchase_order_id and f.product_id = o.product_id and f.supplier_id = o.supplier_id and f.order_date = o.order_date",
}
