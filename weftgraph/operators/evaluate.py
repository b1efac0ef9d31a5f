"""Routing, grading and summaries of question results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.runtime import cut, shuffle_partitions

# What makes an answer abstain, affirm or deny, on lower-case text. Where a word must stand alone, its
# edges are spelled out, so that SQL engines read the patterns alike.
ABSTAIN = r"cannot (?:determine|confirm|deny|provide|verify|say|tell)|could ?n[o']?t (?:find|determine|confirm)|no (?:information|data|evidence|record|results?)(?:[^\p{L}\p{N}_]|$)|results? (?:are|is|were|was) empty|unable to (?:determine|confirm|find)|not (?:documented|present|available|found) in"
NOISE = r"(?:a )?(?:definitive |clear |simple )?[\"']?yes[\"']? or [\"']?no[\"']?(?: answer)?"
AFFIRM = r"(?:^|[^\p{L}\p{N}_])yes(?:[^\p{L}\p{N}_]|$)|is indeed|is listed|is one of the|is (?:a )?contracted supplier|confirmed (?:as|to be)|(?:^|[^\p{L}\p{N}_])correct(?:[^\p{L}\p{N}_]|$)"
NEGATE = r"(?:^|[^\p{L}\p{N}_])no(?:[^\p{L}\p{N}_]|$)|not a contracted|not contracted|is not|isn'?t|does not|does n'?t|no supply contract|not among|not on the|only via|only through"

# Paths of the router, in the order that ties go.
TIE_ORDER = ["Hybrid", "DB", "Doc", "LLM"]

# Default routing rules: (pattern on the lower-case question, path, points).
ROUTE_RULES = [
    (r"(?:po|prd|dt|ae|ctr|sup|eq)[0-9]{3,}|how many|which|status|count|quantity|date", "DB", 3),
    (r"why|how was|describe|state|mention|note|log|report|cause", "Doc", 3),
    (r"(?:po|prd|dt|ae|ctr|sup|eq)[0-9]{3,}.*(?:why|cause|note|incident|complaint)|(?:why|cause).*[0-9]{3,}", "Hybrid", 3),
    (r"what is an? |define|meaning of", "LLM", 3),
    (r"(?:supplier|order|product).*(?:incident|note|root cause|review|complaint)", "Hybrid", 2),
    (r"^(?:is|are|does|do|did|was|were) ", "DB", 1),
]


def polarity(answer: Column | str) -> Column:
    """YES, NO, ABSTAIN or UNCLEAR; abstaining phrases go first, and 'yes or no' itself says nothing. Null is UNCLEAR."""
    a = F.lower(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))
    said = F.regexp_replace(a, NOISE, " ")
    yes, no = said.rlike(AFFIRM), said.rlike(NEGATE)
    return F.when(a.rlike(ABSTAIN), "ABSTAIN").when(yes & ~no, "YES").when(no & ~yes, "NO").otherwise("UNCLEAR")


def grade_polarity(gold: Column, said: Column, lenient: bool = True) -> Column:
    """PASS or FAIL: a gold NO accepts abstaining when lenient, a gold YES needs a YES."""
    no = said.isin("NO", "ABSTAIN") if lenient else said == "NO"
    return F.when(F.when(F.upper(gold) == "NO", no).otherwise(said == "YES"), "PASS").otherwise("FAIL")


def grade(results: DataFrame, answer: str, gold: str, aliases: DataFrame | None = None, key: str = "item_id", lenient: bool = True) -> DataFrame:
    """``results`` with ``verdict``: null without a gold answer, by polarity for YES and NO, else PASS if
    every part of the gold answer (parted by ``;``) or the name it is an alias of is in the answer.

    ``aliases``: (id, name). Case plays no part. Repeated results stay repeated.
    """
    trimmed = F.trim(gold)
    said = F.lower(F.coalesce(answer, F.lit("")))
    parts = F.filter(F.transform(F.split(trimmed, ";"), lambda p: F.trim(p)), lambda p: p != "")
    names = F.create_map().cast("map<string,string>")
    rows = results
    if aliases is not None:
        tokens = results.select(key, F.explode(parts).alias("id")).distinct().join(aliases.select("id", "name"), "id")
        rows = results.join(tokens.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", F.lower("name")))).alias("_names")), key, "left")
        names = F.coalesce(F.col("_names"), names)
    present = F.forall(parts, lambda p: F.contains(said, F.lower(p)) | F.coalesce(F.contains(said, F.try_element_at(names, p)), F.lit(False)))
    by_polarity = grade_polarity(trimmed, polarity(answer), lenient)
    verdict = F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(None)).when(F.upper(trimmed).isin("YES", "NO"), by_polarity).when(present, "PASS").otherwise("FAIL")
    return rows.withColumn("verdict", verdict).drop("_names")


def accuracy(results: DataFrame, kind: str = "type") -> DataFrame:
    """Per kind (null is ``?``) and in total (kind ``*``): graded, passed, accuracy to four places, errors."""
    rows = results.select(F.coalesce(kind, F.lit("?")).alias("kind"), "verdict")
    both = rows.unionByName(rows.withColumn("kind", F.lit("*")))
    graded, passed = F.count_if(F.col("verdict").isin("PASS", "FAIL")), F.count_if(F.col("verdict") == "PASS")
    return both.groupBy("kind").agg(graded.alias("graded"), passed.alias("passed"), F.when(graded > 0, F.round(passed / graded, 4)).alias("accuracy"), F.count_if(F.col("verdict") == "ERROR").alias("errors"))


def latency(results: DataFrame, seconds: str, by: str | None = None) -> DataFrame:
    """Mean, median, p95 and total of a duration; p95 is the sorted value at max(0, floor(0.95 n) - 1).

    A value is found by its rank over the distinct values and their counts. These are sorted into
    ranges over all tasks; the counts of whole ranges give where a range begins, so no group is
    summed up in one task. Null durations are left out; an empty table gives no rows.
    """
    rows = results.select((F.col(by) if by else F.lit(1)).alias("_by"), F.col(seconds).alias("_v")).filter("_v is not null")
    counts = rows.groupBy("_by", "_v").agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(shuffle_partitions(results.sparkSession), "_by", "_v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_by", "_part").agg(F.sum("_n").alias("_in"))  # one row per range and group that it holds
    earlier = Window.partitionBy("_by").orderBy("_part")
    parts = parts.select("_by", "_part", (F.sum("_in").over(earlier) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy("_by")).alias("_all"))
    inside = Window.partitionBy("_by", "_part").orderBy("_v")
    # null groups meet too, so the join is null-safe; the side is one row per range and group
    p = parts.withColumnsRenamed({"_by": "_b", "_part": "_p"})
    ranked = ranged.withColumn("_upto", F.sum("_n").over(inside)).join(p, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p"))).withColumn("_to", F.col("_upto") + F.col("_before"))
    at = F.greatest(F.lit(0), F.floor(F.col("_all") * 0.95).cast("bigint") - 1)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda i: (F.col("_to") > i) & (F.col("_to") - F.col("_n") <= i)
    value = F.col("_v")
    out = ranked.groupBy("_by").agg(F.sum("_n").alias("n"), F.round(F.sum(value * F.col("_n")) / F.sum("_n"), 3).alias("mean"), F.round((F.max(F.when(holds(low), value)) + F.max(F.when(holds(high), value))) / 2, 3).alias("median"), F.round(F.max(F.when(holds(at), value)), 2).alias("p95"), F.round(F.sum(value * F.col("_n")), 1).alias("total"))
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


def run_summary(results: DataFrame) -> DataFrame:
    """One row over results with attempts, error, n_facts, n_pruned and n_all_types: retry, error and empty rates, attempts, prune ratio."""
    tried, found = F.col("attempts").isNotNull(), F.col("n_facts").isNotNull()
    ratio = F.when(F.col("n_all_types") > 0, F.col("n_pruned") / F.col("n_all_types"))
    return results.agg(F.count("*").alias("n"), F.round(F.avg("attempts"), 3).alias("attempts_mean"), F.max("attempts").alias("attempts_max"), F.round(F.count_if(F.col("attempts") > 1) / F.count_if(tried), 3).alias("retry_rate"), F.round(F.count_if(F.col("error").isNotNull()) / F.count("*"), 3).alias("error_rate"), F.round(F.count_if(F.col("n_facts") == 0) / F.count_if(found), 3).alias("empty_rate"), F.round(F.avg(ratio), 3).alias("prune_ratio"))


def route_scores(question: Column | str) -> dict[str, Column]:
    """Points per path by the default rules, each rule that fires adding up."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    return {p: reduce(lambda x, y: x + y, [F.when(q.rlike(rule), points).otherwise(0) for rule, path, points in ROUTE_RULES if path == p]) for p in TIE_ORDER}


def argmax_path(scores: dict[str, Column]) -> Column:
    """The path with most points; ties go in the order Hybrid, DB, Doc, LLM; null counts as zero."""
    ranked = F.array(*[F.struct(F.coalesce(scores.get(p, F.lit(0)).try_cast("int"), F.lit(0)).alias("s"), F.lit(-n).alias("o"), F.lit(p).alias("p")) for n, p in enumerate(TIE_ORDER)])
    return F.array_max(ranked)["p"]


def routing_crosstab(results: DataFrame, kind: str = "type", path: str = "route") -> DataFrame:
    """Results per kind and path, one column per path of the router and one for others."""
    known = F.when(F.col(path).isin(*TIE_ORDER), F.col(path)).otherwise("other")
    return results.groupBy(F.coalesce(kind, F.lit("?")).alias("kind")).agg(*[F.count_if(known == p).alias(p) for p in [*TIE_ORDER, "other"]])


def accuracy_by_path(results: DataFrame, path: str = "route") -> DataFrame:
    return accuracy(results, path).filter("kind <> '*'").withColumnRenamed("kind", "path").drop("errors")
