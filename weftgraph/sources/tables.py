"""Table access: parquet tables by name, CSV with a byte-order mark, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` in ``folder``; pruning and pushdown stay with the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """``table`` or None where it was not delivered; callers skip and report such specs."""
    return table(spark, folder, name) if exists(spark, f"{folder}/{name}.parquet") else None


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header under a declared schema; a leading U+FEFF is not part of the first name.

    Columns are matched by position to ``schema``, so the mark in the header never
    reaches a column name. Empty strings stay empty, missing values are null.
    """
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"', encoding="UTF-8")


# Types of the columns of the delivered tables that are no text.
COLUMN_TYPES = {
    "timestamp_ntz": ["recorded_at", "removed_at", "start_time", "end_time", "event_time", "opened_at", "closed_at"],
    "date": ["start_date", "end_date", "valid_from", "valid_to", "order_date", "expected_date", "document_date"],
    "double": ["unit_cost", "list_price", "annual_value", "contract_unit_cost", "confidence", "hours"],
    "int": ["safety_stock", "minimum_order_qty", "order_qty", "lead_time_days"],
    "boolean": ["is_primary"],
}


def csv_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """``name``.csv of ``folder`` by its own header, whatever the order of columns; None where it was not delivered.

    A mark U+FEFF before the header is dropped. Empty values are null; columns of ``COLUMN_TYPES`` get their
    type, a value that can't be read as such is null.
    """
    path = f"{folder}/{name}.csv"
    if not exists(spark, path):
        return None
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    types = {c: t for t, cs in COLUMN_TYPES.items() for c in cs}
    named = raw.toDF(*[c.lstrip("\ufeff").strip().strip('"') for c in raw.columns])
    value = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in named.columns}
    return named.select(*[(F.try_to_date(F.substring(v, 1, 10)) if types.get(c) == "date" else v.try_cast(types[c]) if c in types else F.nullif(F.col(f"`{c}`"), F.lit(""))).alias(c) for c, v in value.items()])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are no records."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema).alias("r")).select("r.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
