"""Attributes as known at event time: a point-in-time join over validity and knowledge.

A version of an entity's attributes holds from ``start`` (the later of its first valid day
and the day it was recorded) until before ``stop``. Versions are cut at time buckets and
reduced to one row per distinct cut interval, which leaves at most w(w+1)/2 rows per
entity and bucket of w days whatever the input holds. Successive change times inside the
bucket then give disjoint validity intervals, each with its winning version, and events
meet them in an equi-join on entity and bucket with half-open containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import hot_frame, hot_keys, salted_join

#: Day number past which nothing is asked; stands for an open end.
FOREVER = 2932897


def disjoint_validity(versions: DataFrame, entity: list[str], rank: Column, buckets: list[int], width: int = 128) -> DataFrame:
    """Versions (``entity``, start, stop in day numbers, half-open) → disjoint intervals per entity and bucket.

    Versions of one entity stay in the partition they are in: where ``versions`` is partitioned by
    ``entity``, no row moves. ``rank`` orders versions that hold at the same time; the greatest wins and comes out as
    ``winner``. Only buckets in ``buckets`` (those that hold events; bounded by the calendar)
    are produced. Null entity keys, null ends and empty intervals are left out.
    """
    held = versions.filter(F.col("start") < F.col("stop"))
    for c in entity:
        held = held.filter(F.col(c).isNotNull())
    lo, hi = F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width)
    wanted = F.filter(F.array(*map(F.lit, buckets)) if buckets else F.array().cast("array<int>"), lambda b: (b >= lo) & (b <= hi))
    cut = held.withColumn("_rank", rank).withColumn("_bucket", F.explode(wanted)).select(*entity, "_bucket", F.greatest("start", F.col("_bucket") * width).cast("int").alias("_s"), F.least("stop", (F.col("_bucket") + 1) * width).cast("int").alias("_e"), "_rank")
    best = cut.groupBy(*entity, "_bucket", "_s", "_e").agg(F.max("_rank").alias("_rank"))
    grouped = best.groupBy(*entity, "_bucket").agg(F.collect_list(F.struct("_s", "_e", "_rank")).alias("_held"))
    times = F.array_sort(F.array_distinct(F.concat(F.transform("_held", lambda h: h["_s"]), F.transform("_held", lambda h: h["_e"]))))
    segment = F.transform(
        F.sequence(F.lit(1), F.size("_times") - 1),
        lambda i: F.struct(F.element_at("_times", i).alias("seg_from"), F.element_at("_times", i + 1).alias("seg_to"), F.array_max(F.transform(F.filter("_held", lambda h: (h["_s"] <= F.element_at("_times", i)) & (h["_e"] > F.element_at("_times", i))), lambda h: h["_rank"])).alias("winner")),
    )
    return grouped.withColumn("_times", times).select(*entity, "_bucket", F.inline(F.filter(segment, lambda s: s["winner"].isNotNull())))


def _fold(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The segments of each entity and bucket as one array, of ``width`` at most."""
    return segments.groupBy(*keys).agg(F.collect_list(F.struct("seg_from", "seg_to", "winner")).alias("_segments"))


def as_known_at(events: DataFrame, versions: DataFrame, entity: list[str], day: str, event_key: str, rank: Column, how: str = "inner", width: int = 128, share: float = 0.002) -> DataFrame:
    """Each event with the ``winner`` of its entity that was valid and known on ``day`` (a day number).

    ``how`` inner leaves events without a version out, left keeps them with a null winner.
    Events with a null day or entity key have no version. Repeated events stay repeated.
    Events and intervals meet in an equi-join on entity and bucket; one row holds the disjoint
    intervals of an entity and bucket, ``width`` at most. Versions move by entity before they are
    cut into buckets. Entities with ``share`` or more of the versions or events (at
    most 2 / ``share`` of them) are spread by bucket from the start, their versions combined before they
    move and their events salted by ``event_key``.
    """
    dated = events.withColumn("_bucket", F.floor(F.col(day) / width).cast("int"))
    buckets = sorted(r[0] for r in dated.select("_bucket").distinct().na.drop().collect())  # at most the calendar / width
    hot = sorted({k for side in (versions, events) for k in hot_keys(side, entity, share)})  # at most 2 / share entities
    parts = []
    if hot:
        spread = hot_frame(versions, entity, hot).drop("_hot")
        cold_events, hot_events = dated.join(spread, entity, "left_anti"), dated.join(spread, entity, "left_semi")
        cold_versions, hot_versions = versions.join(spread, entity, "left_anti"), versions.join(spread, entity, "left_semi")
        folded = _fold(disjoint_validity(hot_versions, entity, rank, buckets, width), [*entity, "_bucket"])
        parts.append(salted_join(hot_events, folded, [*entity, "_bucket"], F.col(event_key), how="left"))
    else:
        cold_events, cold_versions = dated, versions
    # versions move by entity before they are cut into buckets; what is left of them and the events meet by entity and bucket
    segments = _fold(disjoint_validity(cold_versions.repartition(*entity), entity, rank, buckets, width), [*entity, "_bucket"])
    parts.append(cold_events.join(segments, [*entity, "_bucket"], "left"))
    joined = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    inside = F.filter("_segments", lambda s: (s["seg_from"] <= F.col(day)) & (F.col(day) < s["seg_to"]))
    known = joined.withColumn("winner", F.try_element_at(inside, F.lit(1))["winner"]).select(*events.columns, "winner")
    return known if how == "left" else known.filter(F.col("winner").isNotNull())
