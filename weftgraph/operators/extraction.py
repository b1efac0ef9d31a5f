"""Extracted triples: gates, predicate normalisation, confidence, promotion, upsert and audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import norm_key, real_key
from weftgraph.operators.catalog import resolve_values
from weftgraph.operators.skew import LOOK, salted_join
from weftgraph.operators.specs import SUPPLY_CHAIN, GraphSpec
from weftgraph.plans.introspect import BRIDGE_PAIRS, GLOSSES, pair_key
from weftgraph.runtime import cut

# Predicates that mean the same, by canonical form.
SYNONYMS = {
    "LED_TO": ["LED_TO", "RESULTED_IN", "TRIGGERED", "CAUSED"],
    "DELAYED": ["DELAYED", "HELD_UP", "POSTPONED"],
    "SUPPLIED_BY": ["SUPPLIED_BY", "PROVIDED_BY", "SOURCED_FROM"],
    "RECOMMENDS": ["RECOMMENDS", "RECOMMENDED", "ADVISES", "SUGGESTS"],
    "AFFECTED": ["AFFECTED", "IMPACTED"],
    "ATTRIBUTED_TO": ["ATTRIBUTED_TO", "ATTRIBUTED_ROOT_CAUSE_TO", "TRACED_TO", "ROOT_CAUSED_BY"],
    "RECORDED_ON": ["RECORDED_ON", "RECORD_ON", "RECORDLED_ON", "IS_RECORD_OF", "ISRECORD_OF"],
    "RELATED_TO": ["RELATED_TO", "ISRELATEDTO", "LINKED_TO"],
}
# The one predicate of a label pair (either way round) in endpoint_override.
ENDPOINT_PREDICATES = {
    ("DowntimeEvent", "PurchaseOrder"): "RAISED_REPLACEMENT_ORDER",
    ("Contract", "DowntimeEvent"): "MISSED_COMMITMENT_UNDER",
    ("AnomalyEvent", "PurchaseOrder"): "EXPEDITED_FOR_ANOMALY",
    ("PurchaseOrder", "ServiceTicket"): "REPLACEMENT_SOURCED_UNDER",
    ("Contract", "Product"): "COMMITS_SKU",
    ("AnomalyEvent", "ServiceTicket"): "TRACED_TO_ANOMALY",
}
# Senses of a label pair with a text that says what they mean.
SENSES = {
    ("DowntimeEvent", "PurchaseOrder"): [
        ("TRIGGERED_REPLACEMENT_ORDER", "after the stoppage somebody bought spare or substitute material on this order, so that production could start again"),
        ("LATE_DELIVERY_CAUSED_DOWNTIME", "goods of this order came too late, too few or faulty, and for want of them the line stood still"),
    ],
    ("Contract", "DowntimeEvent"): [("DELAYED_CONTRACT_DELIVERY", "because of the stoppage the quantity promised by this contract was delivered late or not in full")],
    ("AnomalyEvent", "PurchaseOrder"): [
        ("ORDERED_TO_REMEDY_ANOMALY", "once the deviation had been noticed, this order was issued or rushed to buy what puts it right"),
        ("DELIVERY_CAUSED_ANOMALY", "what arrived on this order was bad or mistaken, and that brought the deviation about"),
    ],
    ("PurchaseOrder", "ServiceTicket"): [("REPLACEMENT_SOURCED_UNDER_ORDER", "the unit that was sent to settle the complaint had been bought on this order")],
    ("Contract", "Product"): [
        ("COMMITS_PRODUCT_VOLUME", "a yearly quantity of this product is agreed, promised or reserved by the contract"),
        ("EXCLUDES_PRODUCT", "the contract names this product as one that its agreed quantity leaves out"),
    ],
    ("AnomalyEvent", "ServiceTicket"): [("ROOT_CAUSED_TO_ANOMALY", "engineers followed the complaint back to this deviation as its origin")],
}


def structured_relations(spec: GraphSpec = SUPPLY_CHAIN) -> list[tuple[str, str, str, str]]:
    """(pair, relationship, source label, target label) of the declared relationships; self pairs have none, the first direction holds."""
    out: dict[tuple[str, str], tuple[str, str]] = {}
    for a, b, rel in [(f.src_label, f.dst_label, f.rel_type) for f in spec.fks] + [(j.src_label, j.dst_label, j.rel_type) for j in spec.junctions]:
        if a != b:
            out.setdefault(("|".join(sorted((a, b))), rel), (a, b))
    return [(pair, rel, a, b) for (pair, rel), (a, b) in out.items()]


def inventory() -> list[str]:
    """Names that normalisation may end in: senses and structured relationships."""
    return sorted({n for s in SENSES.values() for n, _ in s} | {r for _, r, _, _ in structured_relations()})


def canonical_predicate(c: Column | str) -> Column:
    """UPPER_SNAKE with synonyms merged; nothing left gives RELATED_TO. Unknown predicates pass."""
    c = F.col(c) if isinstance(c, str) else c
    snake = F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    merged = F.create_map(*[F.lit(x) for canon, words in SYNONYMS.items() for w in words for x in (w, canon)])
    return F.when(snake == "", "RELATED_TO").otherwise(F.coalesce(F.try_element_at(merged, snake), snake))


# ---------------------------------------------------------------- gates

#: Distinct values (with id, label and name, so some 20 MB) up to which their resolutions are broadcast.
BROADCAST_VALUES = 150_000


def gate(triples: DataFrame, catalog: DataFrame, open_entities: bool = False) -> DataFrame:
    """Triples with their resolved ends and ``gate``: pass, empty_or_loop, unresolved or canonical_loop.

    Adds subject, subject_label, subject_how (id, name, partial, extracted, none), the same for the
    object, and ``canon_predicate``. ``how`` is id where a known id was given and is found as a word
    in the chunk or nothing of it is found, name where only its name is found. With
    ``open_entities`` an unresolved end becomes an extracted entity under a synthetic id. Repeated
    rows count once. Values are resolved once each. Chunk texts don't go through the joins: rows carry
    two 64-bit hashes of theirs, and each distinct text is joined back once.
    """
    from weftgraph.operators.catalog import EXTRACTED, _tokens, synthetic_id

    text = F.lower(F.coalesce("chunk_text", F.lit("")))
    ids = {side: F.lower(real_key(f"{side}_id")) for side in ("subject", "object")}

    def stands(tokens: Column, id_: Column) -> Column:
        """Whether the id is a word of the text; an id is mostly a token, others are looked for by their edges."""
        edged = F.regexp_like(text, F.concat(F.lit(r"(?U)(?<![\p{L}\p{N}\p{M}_])\Q"), id_, F.lit(r"\E(?![\p{L}\p{N}\p{M}_])")))
        return F.coalesce(F.when(id_.rlike(r"^[\p{L}\p{N}\p{M}_]+$"), F.array_contains(tokens, id_)).otherwise(edged), F.lit(False))

    words = F.element_at(F.transform(F.array(_tokens(text)), lambda t: F.struct(stands(t, ids["subject"]).alias("subject"), stands(t, ids["object"]).alias("object"))), 1)
    hashes = {"_t1": F.when(F.col("chunk_text").isNotNull(), F.xxhash64("chunk_text")), "_t2": F.when(F.col("chunk_text").isNotNull(), F.xxhash64(F.lit("second"), "chunk_text"))}
    loop = ids["subject"].isNull() | ids["object"].isNull() | (ids["subject"] == ids["object"])
    rows = triples.withColumns(hashes | {"_word": words, "_loop": loop}).drop("chunk_text").distinct()
    values = triples.select(F.col("subject_id").alias("value")).unionByName(triples.select(F.col("object_id").alias("value")))
    known = cut(resolve_values(values, "value", catalog))
    small = known.count() <= BROADCAST_VALUES
    for side in ("subject", "object"):
        mine = known.select(F.col("value").alias(f"{side}_id"), F.col("id").alias(side), F.col("label").alias(f"{side}_label"), F.lower("name").alias(f"_{side}_name"), F.col("how").alias(f"_{side}_how"))
        rows = rows.join(F.broadcast(mine), f"{side}_id", "left") if small else salted_join(rows, mine, [f"{side}_id"], F.struct("source_chunk_id", "predicate_cue"), how="left", counted=triples.select(f"{side}_id"))
    texts = triples.select("chunk_text").filter("chunk_text is not null").withColumns(hashes).dropDuplicates(["_t1", "_t2"])
    looked = triples.sample(LOOK, seed=7).select(*[c.alias(k) for k, c in hashes.items()])
    rows = salted_join(rows, texts, ["_t1", "_t2"], F.struct("subject_id", "object_id", "predicate_cue"), how="left", counted=looked, look=1.0)
    for side in ("subject", "object"):
        named = F.contains(text, F.col(f"_{side}_name"))
        how = F.when(F.col(f"_{side}_how") == "id", F.when(F.col(f"_word.{side}"), "id").when(named, "name").otherwise("id")).when(F.col(f"_{side}_how").isin("name", "partial"), "name").otherwise("none")
        rows = rows.withColumn(f"{side}_how", how)
        if open_entities:
            synth = synthetic_id(f"{side}_id")
            new = F.col(side).isNull() & synth.isNotNull()
            rows = rows.withColumn(f"{side}_how", F.when(new, "extracted").otherwise(F.col(f"{side}_how"))).withColumn(f"{side}_label", F.when(new, EXTRACTED).otherwise(F.col(f"{side}_label"))).withColumn(side, F.when(new, synth).otherwise(F.col(side)))
    verdict = F.when(F.col("_loop"), "empty_or_loop").when(F.col("subject").isNull() | F.col("object").isNull(), "unresolved").when(F.col("subject") == F.col("object"), "canonical_loop").otherwise("pass")
    out = rows.withColumn("gate", verdict).withColumn("canon_predicate", canonical_predicate("predicate"))
    # what follows reads the gated triples several times, and they stand for the dearest step
    return cut(out.drop("_loop", "_word", "_t1", "_t2", "_subject_name", "_subject_how", "_object_name", "_object_how"))


def quarantine(gated: DataFrame) -> DataFrame:
    """The triples that could not be resolved, with what was missing; surfaces cut at 200."""
    missing = F.concat_ws(",", F.when(F.col("subject").isNull(), "subject"), F.when(F.col("object").isNull(), "object"))
    return gated.filter("gate = 'unresolved'").select(F.col("source_doc_id").alias("doc"), F.col("source_chunk_id").alias("chunk"), "subject_id", "object_id", "predicate", F.substring("predicate_cue", 1, 200).alias("evidence"), missing.alias("missing"))


def unresolved_top(gated: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent unresolved surfaces (60 characters); ties by surface."""
    ends = gated.filter("gate = 'unresolved'")
    missing = ends.filter("subject is null").select(F.substring(F.trim("subject_id"), 1, 60).alias("surface")).unionByName(ends.filter("object is null").select(F.substring(F.trim("object_id"), 1, 60).alias("surface")))
    return missing.groupBy("surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface").limit(top)


# ---------------------------------------------------------------- normalisation


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumn("_pair", pair_key("subject_label", "object_label"))


def override_by_endpoints(passed: DataFrame) -> DataFrame:
    """The predicate of a listed label pair is its one canonical name; others stay."""
    table = F.create_map(*[F.lit(x) for pair, name in ENDPOINT_PREDICATES.items() for x in ("|".join(sorted(pair)), name)])
    return _pair(passed).withColumn("canon_predicate", F.coalesce(F.try_element_at(table, F.col("_pair")), F.col("canon_predicate"))).drop("_pair")


# Words that tell the senses of a pair apart for the default classifier.
SENSE_CUES = {
    "TRIGGERED_REPLACEMENT_ORDER": "replac|substitut|expedit|emergency|ordered",
    "LATE_DELIVERY_CAUSED_DOWNTIME": "late|missed|short|starv|delay",
    "DELAYED_CONTRACT_DELIVERY": "delay|breach|miss",
    "ORDERED_TO_REMEDY_ANOMALY": "replac|remed|expedit|correct",
    "DELIVERY_CAUSED_ANOMALY": "defect|wrong|late|short",
    "REPLACEMENT_SOURCED_UNDER_ORDER": "replac|substitut|sourc",
    "COMMITS_PRODUCT_VOLUME": "commit|renew|volume|includ",
    "EXCLUDES_PRODUCT": "exclud|carv|not cover",
    "ROOT_CAUSED_TO_ANOMALY": "trace|root cause|tied",
    "SUPPLIED_BY": "suppl|ship|envi|liefer|livr",
    "ORDERS_PRODUCT": "order|pedido|bestell|commande",
    "FROM_SUPPLIER": "suppl|vendor|ship",
}


def classify_sense(pair_senses: list[str], evidence: Column) -> Column:
    """The default classifier: the first sense of the menu whose cue words the evidence has, else OTHER."""
    out = None
    for name in pair_senses:
        cue = SENSE_CUES.get(name)
        if cue:
            hit = F.coalesce(F.lower(evidence).rlike(cue), F.lit(False))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit("OTHER") if out is None else out.otherwise("OTHER")


def fold_senses(passed: DataFrame, classifier=classify_sense, spec: GraphSpec = SUPPLY_CHAIN) -> DataFrame:
    """Predicates to the senses of their label pair: structured relationships first, then hand-made senses.

    A pair with one hand-made sense and no structured relationship is forced. Others are classified
    by evidence, each distinct (pair, evidence) once; OTHER or a name off the menu keeps the
    predicate. Where the outcome is a structured relationship and the triple runs against its
    direction, subject and object change places. Pairs without a menu keep everything.
    """
    structured = structured_relations(spec)
    menus: dict[str, list[str]] = {}
    for pair, rel, _, _ in structured:
        menus.setdefault(pair, []).append(rel)
    forced: dict[str, str] = {}
    for pair, senses in SENSES.items():
        key = "|".join(sorted(pair))
        if key not in menus and len(senses) == 1:
            forced[key] = senses[0][0]
        menus.setdefault(key, []).extend(n for n, _ in senses)
    rows = _pair(passed).withColumn("_ev", F.trim(F.coalesce("predicate_cue", F.lit(""))))
    asked = rows.filter(F.col("_pair").isin(*[m for m in menus if m not in forced])).select("_pair", "_ev").distinct()
    answer = None
    for pair, menu in menus.items():
        if pair not in forced:
            said = classifier(menu, F.col("_ev"))
            hit = F.when(F.upper(said).isin(*menu), F.upper(said))
            answer = F.when(F.col("_pair") == pair, hit) if answer is None else answer.when(F.col("_pair") == pair, hit)
    answered = asked.withColumn("_sense", answer).filter("_sense is not null")
    rows = salted_join(rows, answered, ["_pair", "_ev"], F.struct("source_chunk_id", "subject", "object"), how="left")
    fixed = F.create_map(*[F.lit(x) for kv in forced.items() for x in kv])
    rows = rows.withColumn("_sense", F.coalesce(F.try_element_at(fixed, F.col("_pair")), F.col("_sense")))
    sources = F.create_map(*[F.lit(x) for pair, rel, a, _ in structured for x in (f"{pair}/{rel}", a)])
    want = F.try_element_at(sources, F.concat_ws("/", "_pair", "_sense"))
    rows = rows.withColumn("_swap", F.coalesce(want != F.col("subject_label"), F.lit(False)))
    swapped = {}
    for a, b in (("subject", "object"), ("subject_label", "object_label"), ("subject_how", "object_how"), ("subject_surface", "object_surface"), ("subject_match", "object_match")):
        if a in rows.columns and b in rows.columns:
            swapped[a] = F.when(F.col("_swap"), F.col(b)).otherwise(F.col(a))
            swapped[b] = F.when(F.col("_swap"), F.col(a)).otherwise(F.col(b))
    return rows.withColumns(swapped).withColumn("canon_predicate", F.coalesce("_sense", "canon_predicate")).drop("_pair", "_ev", "_sense", "_swap")


# ---------------------------------------------------------------- confidence


@dataclass(frozen=True)
class Confidence:
    endpoint: float = 0.4
    grounding: float = 0.4
    corroboration: float = 0.2
    tau: float = 0.5
    id_match: float = 1.0
    name_match: float = 0.5
    no_match: float = 0.0

    def weights(self) -> tuple[float, float, float]:
        """Weights that sum to one; without a positive sum only the end points count."""
        total = self.endpoint + self.grounding + self.corroboration
        return (1.0, 0.0, 0.0) if total <= 0 else (self.endpoint / total, self.grounding / total, self.corroboration / total)


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\p{Z}]+", " ")


def score(triples: DataFrame, subject: str = "subject", predicate: str = "canon_predicate", object_: str = "object", subject_how: str = "subject_how", object_how: str = "object_how", config: Confidence = Confidence()) -> DataFrame:
    """Adds s_endpoint, s_grounding, n_sources, s_corroboration, confidence and promoted.

    n_sources counts the distinct chunks that give the same triple; rows without a chunk count each.
    """
    points = lambda c: F.when(F.col(c) == "id", config.id_match).when(F.col(c) == "name", config.name_match).otherwise(config.no_match)
    cue = F.trim(_squeeze(F.col("predicate_cue")))
    grounded = F.when((cue != "") & F.contains(_squeeze(F.col("chunk_text")), cue), 1.0).otherwise(0.0)
    chunk = F.nullif(F.trim("source_chunk_id"), F.lit(""))
    key = [subject, predicate, object_]
    sources = triples.groupBy(*key).agg((F.count_distinct(chunk) + F.count(F.when(chunk.isNull(), 1))).alias("n_sources"))
    rows = salted_join(triples, sources, key, F.struct("source_chunk_id", "predicate_cue"), how="left")
    w1, w2, w3 = config.weights()
    rows = rows.withColumns({"s_endpoint": (points(subject_how) + points(object_how)) / 2.0, "s_grounding": grounded, "s_corroboration": F.when(F.col("n_sources") <= 1, 0.0).otherwise(1.0 - 1.0 / F.col("n_sources"))})
    confidence = w1 * F.col("s_endpoint") + w2 * F.col("s_grounding") + w3 * F.col("s_corroboration")
    return rows.withColumn("confidence", confidence).withColumn("promoted", F.col("confidence") >= config.tau)


def promoted_operations(scored: DataFrame) -> DataFrame:
    """Promoted triples as edge operations with confidence rounded to three places; ``ord`` is their order."""
    return scored.filter("promoted").select(
        F.col("subject_label").alias("src_label"),
        F.col("subject").alias("src"),
        F.col("canon_predicate").alias("rel_type"),
        F.col("object_label").alias("dst_label"),
        F.col("object").alias("dst"),
        F.round("confidence", 3).alias("confidence"),
        F.col("source_doc_id").alias("source_doc"),
        "source_chunk_id",
        F.col("predicate_cue").alias("evidence"),
        F.struct(F.coalesce("source_doc_id", F.lit("")).alias("d"), F.coalesce("source_chunk_id", F.lit("")).alias("c"), F.coalesce("predicate_cue", F.lit("")).alias("e"), F.col("confidence").alias("f")).alias("ord"),
    )


def upsert(existing: DataFrame, operations: DataFrame) -> DataFrame:
    """Existing edges and operations merged, in the generic edge columns.

    The first operation on a new edge creates it with its properties, every later one raises
    ``doc_corroborations``; on an existing edge every operation does, and the edge keeps its origin
    and properties.
    """
    key = ["src_label", "src", "rel_type", "dst_label", "dst"]
    props = ["confidence", "source_doc", "source_chunk_id", "evidence"]
    new = operations.groupBy(*key).agg(F.min_by(F.struct(*props), "ord").alias("_new"), F.count("*").alias("_n"))
    old = existing.withColumn("_old", F.lit(True))
    both = old.join(new, key, "full")
    raised = F.when(F.col("_old"), F.col("_n")).otherwise(F.col("_n") - 1)
    counted = F.when(F.col("_n").isNull(), F.col("doc_corroborations")).otherwise(F.nullif(F.coalesce("doc_corroborations", F.lit(0)) + raised, F.lit(0)))
    return both.select(*key, F.coalesce("origin", F.lit("extracted")).alias("origin"), *[F.when(F.col("_old"), F.col(p)).otherwise(F.col("_new")[p]).alias(p) for p in props], counted.cast("bigint").alias("doc_corroborations"))


# ---------------------------------------------------------------- audit


def funnel(gated: DataFrame) -> DataFrame:
    """One row: triples in, drops by gate, resolved, and the share that was unresolved."""
    hit = lambda g: F.count_if(F.col("gate") == g)
    raw = F.count("*")
    return gated.agg(raw.alias("raw"), hit("empty_or_loop").alias("drop_empty_or_loop"), hit("unresolved").alias("drop_unresolved"), hit("canonical_loop").alias("drop_canonical"), hit("pass").alias("resolved"), F.when(raw > 0, F.round(hit("unresolved") / raw, 4)).otherwise(0.0).alias("unresolved_rate"))


def predicate_audit(normalised: DataFrame) -> DataFrame:
    """One row: distinct and single predicates, inside and outside the inventory, and the residual rate."""
    counts = normalised.groupBy("canon_predicate").agg(F.count("*").alias("n"))
    outside = ~F.col("canon_predicate").isin(*inventory())
    return counts.agg(F.count("*").alias("distinct_total"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(~outside).alias("inventory_distinct"), F.count_if(outside).alias("residual_distinct"), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("residual_triples"), F.round(F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)) / F.sum("n"), 4).alias("residual_rate"))


def residual_predicates(normalised: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent predicates outside the inventory; ties by name."""
    return normalised.filter(~F.col("canon_predicate").isin(*inventory())).groupBy("canon_predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "canon_predicate").limit(top)


def pair_residuals(normalised: DataFrame) -> DataFrame:
    """Directed label pairs with two or more residual predicates, with each predicate's count."""
    each = normalised.filter(~F.col("canon_predicate").isin(*inventory())).groupBy("subject_label", "object_label", "canon_predicate").agg(F.count("*").alias("n"))
    kinds = each.groupBy("subject_label", "object_label").agg(F.count("*").alias("kinds")).filter("kinds >= 2")
    return each.join(kinds, ["subject_label", "object_label"])


def bridge_split(normalised: DataFrame) -> DataFrame:
    """One row: edges whose label pair has a structured relationship, the others (bridges), and the bridges' predicates."""
    pairs = sorted({p for p, _, _, _ in structured_relations()})
    known = pair_key("subject_label", "object_label").isin(*pairs)
    return normalised.agg(F.count_if(known).alias("fk_redundant_edges"), F.count_if(~known).alias("genuine_bridge_edges"), F.count_distinct(F.when(~known, F.col("canon_predicate"))).alias("genuine_bridge_types"))


def promoted_by_relation(operations: DataFrame) -> DataFrame:
    return operations.groupBy("rel_type").agg(F.count("*").alias("n_edges"))


__all__ = ["BRIDGE_PAIRS", "GLOSSES", "Confidence", "bridge_split", "canonical_predicate", "classify_sense", "fold_senses", "funnel", "gate", "inventory", "norm_key", "override_by_endpoints", "pair_residuals", "predicate_audit", "promoted_by_relation", "promoted_operations", "quarantine", "residual_predicates", "score", "structured_relations", "unresolved_top", "upsert"]
