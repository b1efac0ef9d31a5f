"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the rows that is looked at to find hot keys. Which keys are found decides how a join
#: runs and never what it returns.
LOOK = 0.02
#: Rows of a key among those looked at, under which it is not called hot.
LEAST = 20


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.02, look: float | None = None, least: int | None = None) -> list[tuple]:
    """The keys that hold about ``share`` or more of the rows of ``df``: at most ``1 / share`` of them.

    Counted over a fixed pseudo-random part of the rows and only on the key columns, so it costs
    a scan and next to no shuffle. Null keys never join and are left out.
    """
    look, least = LOOK if look is None else look, LEAST if least is None else least
    seen = df.select(*keys).na.drop()
    counted = (seen.sample(look, seed=7) if look < 1 else seen).groupBy(*keys).agg(F.count("*").alias("_rows"))
    top = counted.orderBy(F.desc("_rows"), *keys).limit(int(1 / share))  # the only candidates
    total = counted.agg(F.sum("_rows").alias("_all"))
    found = top.crossJoin(F.broadcast(total)).filter((F.col("_rows") >= F.col("_all") * share) & (F.col("_rows") >= least))  # with one row
    return [tuple(r[k] for k in keys) for r in found.collect()]


def hot_frame(df: DataFrame, keys: list[str], hot: list[tuple]) -> DataFrame:
    """Hot keys as a table of ``1 / share`` rows at most, so it may be broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(hot, T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])).withColumn("_hot", F.lit(True)))


def salted_join(big: DataFrame, side: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 32, share: float = 0.02, counted: DataFrame | None = None, distinct: bool = False, look: float | None = None) -> DataFrame:
    """Join ``side`` to ``big`` on ``keys``; rows of hot keys of ``big`` are spread over ``salts`` partitions.

    Hot keys are counted in ``counted`` where it is given: a cheaper table with the same key
    columns, such as the one ``big`` was made from; ``look`` is the share of it that is looked at. Without hot keys this is a plain join.
    Only the rows of ``side`` with a hot key are repeated. ``spread`` must be a deterministic
    column of ``big`` with many values. ``how``: inner, left, left_semi or left_anti. With
    ``distinct`` repeated rows of ``big`` count once, in the same shuffle as the join.
    Null keys match nothing; otherwise duplicates on either side behave as in a plain join.
    """
    hot = hot_keys(big if counted is None else counted, keys, share, look)
    if not hot:
        return (big.repartition(*keys).distinct() if distinct else big).join(side, keys, how)
    marked = hot_frame(big, keys, hot)
    left = big.join(marked, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    if distinct:
        left = left.repartition(*keys, "_salt").distinct()
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = side.join(marked, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
