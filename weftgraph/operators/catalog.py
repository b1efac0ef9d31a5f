"""The inventory of known entities, and how texts and names are linked to it.

All matching is by equi-joins: ids through tokens, names in texts through what of a text may be
a name (``within``), values and names through grams. One lies inside the other only if the first
gram of the shorter one is a gram of the longer one, so that gram is the join key. Texts go
through none of these joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.keys import col, real_key
from weftgraph.operators.skew import LOOK, salted_join
from weftgraph.operators.specs import SUPPLY_CHAIN, GraphSpec
from weftgraph.operators.within import Names
from weftgraph.runtime import cut
from weftgraph.sources.tables import optional_table

GRAM = 4
#: Catalogue entries (a few short strings each, so some 10 MB) up to which they are broadcast.
BROADCAST_ENTRIES = 100_000
#: Names (some twenty grams each) up to which their grams are broadcast.
BROADCAST_NAMES = 10_000
#: Label of entities that only texts know.
EXTRACTED = "ExtractedEntity"


def build_catalog(spark: SparkSession, folder: str, spec: GraphSpec = SUPPLY_CHAIN, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """(label, id, name, ord) of every table that is delivered; ``ord`` is the load order: label, then id.

    Of several names of an id the least in the text order is taken.
    """
    extra, parts = extra or {}, []
    for n, node in enumerate(spec.nodes):
        rows = extra.get(node.table)
        rows = optional_table(spark, folder, node.table) if rows is None else rows
        if rows is None or node.label == "Document":
            continue
        name = F.col(node.name).cast("string") if node.name and node.name in rows.columns else F.lit(None).cast("string")
        parts.append(rows.select(F.lit(node.label).alias("label"), real_key(F.col(node.pk).cast("string")).alias("id"), name.alias("name"), F.lit(n).alias("n")))
    entities = reduce(DataFrame.unionByName, parts).filter("id is not null").groupBy("label", "n", "id").agg(F.min("name").alias("name"))
    return entities.select("label", "id", "name", F.struct("n", "id").alias("ord"))


# Labels of ids whose tables are not delivered, by the letters they begin with.
ID_LABELS = {"AE": "AnomalyEvent", "DT": "DowntimeEvent", "EQ": "Equipment"}


def mentioned_entities(triples: DataFrame) -> DataFrame:
    """Catalogue rows of ids that triples name and no table holds: anomalies, downtimes and equipment."""
    ids = triples.select(real_key("subject_id").alias("id")).unionByName(triples.select(real_key("object_id").alias("id"))).filter(F.col("id").rlike("^(?:AE|DT|EQ)[0-9]+$")).distinct()
    labels = F.create_map(*[F.lit(x) for kv in ID_LABELS.items() for x in kv])
    return ids.select(F.element_at(labels, F.substring("id", 1, 2)).alias("label"), "id", F.lit(None).cast("string").alias("name"), F.struct(F.lit(100).alias("n"), "id").alias("ord"))


def entity_key(c: Column | str) -> Column:
    """Lower case, everything but letters a-z and digits to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^0-9a-z]+", " "))


def synthetic_id(c: Column | str) -> Column:
    """``X_`` and the key with underscores, cut to 48 characters; keys under two characters have none."""
    key = entity_key(c)
    return F.when(F.length(key) >= 2, F.concat(F.lit("X_"), F.substring(F.replace(key, F.lit(" "), F.lit("_")), 1, 48)))


def register_extracted(surfaces: DataFrame, surface: str, order: str) -> DataFrame:
    """(synth_id, display): unseen surfaces merged by key, shown as the first in ``order`` (80 characters)."""
    keyed = surfaces.select(synthetic_id(surface).alias("synth_id"), F.substring(F.trim(surface), 1, 80).alias("_s"), F.col(order).alias("_o")).filter("synth_id is not null")
    return keyed.groupBy("synth_id").agg(F.min_by("_s", F.struct("_o", "_s")).alias("display"))


def _tokens(c: Column | str) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0)))


def _grams(c: Column, n: int = GRAM) -> Column:
    size = F.length(c)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _met(rows: DataFrame, side: DataFrame, on: list[str], spread: Column, small: bool, counted: DataFrame) -> DataFrame:
    """An inner join with ``side``: broadcast where it was counted small, else salted by the hot keys of ``counted``, a sample of ``rows``."""
    return rows.join(F.broadcast(side), on) if small else salted_join(rows, side, on, spread, how="inner", counted=counted, look=1.0)


def link_ids(texts: DataFrame, key: str, text: str, catalog: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, label, id, ``also``): ids that stand in the text as a word, whatever their case.

    Ids must consist of word characters; then a word match is equality with a token. Words shorter or
    longer than every id are left out before the join, and, if every id holds a digit or a letter, those without one.
    """
    ids = catalog.select("label", "id", *also, F.lower("id").alias("_token"))
    token = F.col("_token")
    every = [F.coalesce(F.every(token.rlike(p)), F.lit(True)) for p in ("[0-9]", "[a-z]")]
    size, shortest, longest, numbered, lettered = ids.agg(F.count("*"), F.coalesce(F.min(F.length(token)), F.lit(0)), F.coalesce(F.max(F.length(token)), F.lit(0)), *every).first()

    def words(rows: DataFrame) -> DataFrame:
        found = rows.select(key, F.explode(_tokens(text)).alias("_token")).filter(F.length(token).between(shortest, longest))
        for p in ["[0-9]"] * numbered + ["[a-z]"] * lettered:
            found = found.filter(token.rlike(p))
        return found

    return _met(words(texts), ids, ["_token"], F.col(key), size <= BROADCAST_ENTRIES, words(texts.sample(LOOK, seed=7))).select(key, "label", "id", *also)


def link_names(texts: DataFrame, key: str, text: str, catalog: DataFrame, least: int = 1, also: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, label, id, ``also``): names of ``least`` or more characters that lie inside the text, whatever their case.

    Texts go through no join: one pass over them gives the names that stand in them, and only these are joined.
    """
    names = cut(catalog.filter(F.length("name") >= F.lit(max(1, least))).select("label", "id", *also, F.lower("name").alias("_name")))
    known = names.count()
    marks = Names(names, "_name", known)
    found = lambda rows: marks.inside(rows.select(key, F.lower(text).alias("_text")), key, "_text")
    return _met(found(texts), names, ["_name"], F.col(key), known <= BROADCAST_ENTRIES, found(texts.sample(LOOK, seed=7))).select(key, "label", "id", *also).distinct()


def link_entities(texts: DataFrame, key: str, text: str, catalog: DataFrame, least: int = 1, also: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, label, id, ``also``, match): ids (match ``id``) before names (``name``), one row per entity and text.

    ``also`` are further columns of the catalogue that are given with the entity.
    """
    both = link_ids(texts, key, text, catalog, also).withColumn("match", F.lit("id")).unionByName(link_names(texts, key, text, catalog, least, also).withColumn("match", F.lit("name")))
    return both.groupBy(key, "label", "id", *also).agg(F.min("match").alias("match"))


def link_online(texts: DataFrame, key: str, text: str, catalog: DataFrame) -> DataFrame:
    """As ``link_entities`` with names of four or more characters; of equal names the last entry holds."""
    last = catalog.filter(F.length("name") >= 4).groupBy(F.lower("name").alias("_n")).agg(F.max_by(F.struct("label", "id", "name"), "ord").alias("e")).select("e.*")
    named = link_names(texts, key, text, last, 4).withColumn("match", F.lit("name"))
    return link_ids(texts, key, text, catalog).withColumn("match", F.lit("id")).unionByName(named).groupBy(key, "label", "id").agg(F.min("match").alias("match"))


def enough_candidates(links: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Texts with ``least`` or more linked entities."""
    return links.groupBy(key).agg(F.count_distinct("id").alias("n_entities")).filter(F.col("n_entities") >= least)


def first_names(catalog: DataFrame) -> DataFrame:
    """(name_key, id, label, name, ord): of equal names the first entry holds."""
    return catalog.filter("name is not null").groupBy(F.lower(F.trim("name")).alias("name_key")).agg(F.min_by(F.struct("id", "label", "name", "ord"), "ord").alias("e")).select("name_key", "e.*")


def resolve_values(values: DataFrame, value: str, catalog: DataFrame) -> DataFrame:
    """(``value``, id, label, name, how) of distinct values by the cascade id, exact name, partial name.

    A partial match is containment either way round, for values of four or more characters; the
    first name in load order wins. ``how`` is id, name, partial or none; unresolved values have a
    null id. Ids are compared trimmed and upper-cased, names in lower case. Null values are left out.
    """
    distinct = cut(values.select(value).filter(F.col(value).isNotNull()).distinct()).withColumn("_id", real_key(value)).withColumn("_key", F.lower(F.trim(value)))
    ids = catalog.groupBy("id").agg(F.min_by(F.struct("label", "name"), "ord").alias("e")).select(F.col("id").alias("_id"), F.struct(F.col("id"), "e.label", "e.name").alias("by_id"))
    names = cut(first_names(catalog))
    exact = names.select(F.col("name_key").alias("_key"), F.struct("id", "label", "name").alias("by_name"))
    step = distinct.join(ids, "_id", "left").join(exact, "_key", "left")
    open_ = cut(step.filter("by_id is null and by_name is null").filter(F.length("_key") >= 4).select("_key").distinct())
    small = names.count() <= BROADCAST_NAMES
    look = open_.sample(LOOK, seed=7)
    # the value inside a name: the value's first gram is one of the name's
    parts = names.filter(F.length("name_key") >= GRAM).withColumn("_gram", F.explode(_grams(F.col("name_key"))))
    first = lambda rows: rows.withColumn("_gram", F.substring("_key", 1, GRAM))
    inside_name = _met(first(open_), parts, ["_gram"], F.col("_key"), small, first(look)).filter(F.contains("name_key", "_key"))
    # a name inside the value: the name's first gram, as long as the name up to GRAM, is one of the value's
    heads = names.filter("name_key <> ''").withColumn("_gram", F.substring("name_key", 1, GRAM))
    every = lambda rows: rows.withColumn("_gram", F.explode(F.concat(*[_grams(F.col("_key"), n) for n in range(1, GRAM + 1)])))
    inside_value = _met(every(open_), heads, ["_gram"], F.col("_key"), small, every(look)).filter(F.contains("_key", "name_key"))
    partial = inside_name.select("_key", "id", "label", "name", "ord").unionByName(inside_value.select("_key", "id", "label", "name", "ord")).groupBy("_key").agg(F.min_by(F.struct("id", "label", "name"), "ord").alias("by_part"))
    full = step.join(partial, "_key", "left")
    best = F.coalesce("by_id", "by_name", "by_part")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").when(F.col("by_part").isNotNull(), "partial").otherwise("none")
    return full.select(value, best["id"].alias("id"), best["label"].alias("label"), best["name"].alias("name"), how.alias("how"))


def id_tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, token): distinct id-like tokens, two to six letters and two or more digits, in their case."""
    return texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,6}[0-9]{2,}"), F.lit(0)))).alias("token"))
