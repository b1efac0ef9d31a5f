import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import extraction as X
from weftgraph.operators.normalize import normalise
from weftgraph.plans import text_queries as T
from weftgraph.providers import HashEmbedder, ItemFailed, Model, SchemaRefused, TemplateExtractor, cached_embeddings, extract_triples, in_parts

COLS = "subject_id string, predicate string, object_id string, subject_match string, object_match string, subject_surface string, object_surface string, predicate_cue string, source_chunk_id string, source_doc_id string, chunk_text string"


@pytest.fixture(scope="module")
def cat(spark):
    rows = [("Product", "P1", "Oat Milk", 0), ("Supplier", "S1", "Acme", 1), ("PurchaseOrder", "O1", None, 2), ("DowntimeEvent", "DT1", None, 3), ("Contract", "C1", None, 4)]
    return spark.createDataFrame(rows, "label string, id string, name string, n int").select("label", "id", "name", F.struct("n", "id").alias("ord"))


def triples(spark, *data):
    full = [(s, p, o, None, None, s, o, cue, chunk, "D", text) for s, p, o, cue, chunk, text in data]
    return spark.createDataFrame(full, COLS)


def test_canonical_predicate(spark):
    df = spark.createDataFrame([("led to",), ("Held-up",), ("!!",), (None,), ("fresh word",), ("caused",)], "p string")
    assert [r[0] for r in df.select(X.canonical_predicate("p")).collect()] == ["LED_TO", "DELAYED", "RELATED_TO", "RELATED_TO", "FRESH_WORD", "LED_TO"]


def test_gates_and_funnel(spark, cat):
    t = triples(
        spark,
        ("P1", "supplied by", "S1", "c", "k1", "p1 is supplied by S1"),
        ("P1", "supplied by", "S1", "c", "k1", "p1 is supplied by S1"),  # delivered twice
        ("p1 ", "x", "Oat Milk", "c", "k1", "t"),  # both ends resolve to one entity
        ("P1", "x", "P1", "c", "k1", "t"),
        ("", "x", "S1", "c", "k1", "t"),
        (None, "x", "S1", "c", "k1", None),
        ("ghost", "x", "S1", "c" * 300, "k2", "t"),
        ("Oat Milk", "x", "Acme Ltd", "c", "k3", "Oat milk by acme"),
        ("P1", "x", "S1", "c", "k4", "nothing of it"),
        ("P1", "x", "S1", "c", "k5", "Oat Milk from XS1"),
    )
    gated = X.gate(t, cat)
    by = {(r.subject_id, r.object_id, r.source_chunk_id): r for r in gated.collect()}
    assert by["P1", "S1", "k1"].gate == "pass" and by["P1", "S1", "k1"].subject_how == "id"
    assert by["p1 ", "Oat Milk", "k1"].gate == "canonical_loop" and by["P1", "P1", "k1"].gate == "empty_or_loop"
    assert by["Oat Milk", "Acme Ltd", "k3"].subject == "P1" and by["Oat Milk", "Acme Ltd", "k3"].object_how == "name"
    assert by["P1", "S1", "k4"].subject_how == "id" and by["P1", "S1", "k5"].subject_how == "name" and by["P1", "S1", "k5"].object_how == "id"
    f = X.funnel(gated).first()
    assert (f.raw, f.drop_empty_or_loop, f.drop_unresolved, f.drop_canonical, f.resolved) == (9, 3, 1, 1, 4) and f.raw == f.drop_empty_or_loop + f.drop_unresolved + f.drop_canonical + f.resolved
    q = X.quarantine(gated).first()
    assert q.missing == "subject" and len(q.evidence) == 200
    assert [tuple(r) for r in X.unresolved_top(gated).collect()] == [("ghost", 1)]
    assert X.funnel(X.gate(t.limit(0), cat)).first().unresolved_rate == 0.0


def test_open_mode_registers_synthetic_entities(spark, cat):
    g = X.gate(triples(spark, ("Some Thing", "x", "S1", "c", "k", "t"), ("!", "x", "S1", "c", "k", "t")), cat, open_entities=True)
    by = {r.subject_id: r for r in g.collect()}
    assert (by["Some Thing"].subject, by["Some Thing"].subject_label, by["Some Thing"].subject_how) == ("X_some_thing", "ExtractedEntity", "extracted")
    assert by["!"].gate == "unresolved"


SCORED = "subject string, canon_predicate string, object string, subject_how string, object_how string, predicate_cue string, source_chunk_id string, chunk_text string"


@pytest.mark.parametrize(
    ("how", "cue", "sources", "confidence", "promoted"),
    [("id", "Made  BY", 1, 0.8, True), ("id", "not there", 1, 0.4, False), ("id", "not there", 2, 0.5, True), ("name", "made by", 1, 0.6, True), ("extracted", "made by", 1, 0.4, False), ("extracted", "made by", 2, 0.5, True), ("id", "", 1, 0.4, False)],
)
def test_confidence_boundaries(spark, how, cue, sources, confidence, promoted):
    data = [("s", "p", "o", how, how, cue, f"c{n}", "it was made\nby us") for n in range(sources)]
    r = X.score(spark.createDataFrame(data, SCORED)).first()
    assert (r.confidence, r.promoted, r.n_sources) == (pytest.approx(confidence), promoted, sources)


def test_sources_without_chunk_count_each_and_weights(spark):
    data = [("s", "p", "o", "id", "id", "x", c, "x") for c in (None, "", "a", "a")]
    assert {r.n_sources for r in X.score(spark.createDataFrame(data, SCORED)).collect()} == {3}
    assert X.Confidence(0, 0, 0).weights() == (1.0, 0.0, 0.0) and X.Confidence(1, 1, 2).weights() == (0.25, 0.25, 0.5)


EDGE = "src_label string, src string, rel_type string, dst_label string, dst string, origin string, confidence double, source_doc string, source_chunk_id string, evidence string, doc_corroborations bigint"


def test_upsert_counts_later_operations(spark):
    ops = spark.createDataFrame([("A", "1", r, "B", "2", 0.5 + i / 10, "d", f"c{i}", "e", i) for r in ("NEW", "OLD") for i in range(3)], "src_label string, src string, rel_type string, dst_label string, dst string, confidence double, source_doc string, source_chunk_id string, evidence string, ord int")
    old = spark.createDataFrame([("A", "1", "OLD", "B", "2", "structured", None, None, None, None, None), ("A", "9", "OLD", "B", "2", "structured", None, None, None, None, None)], EDGE)
    got = {(r.src, r.rel_type): r for r in X.upsert(old, ops).collect()}
    assert (got["1", "NEW"].origin, got["1", "NEW"].confidence, got["1", "NEW"].source_chunk_id, got["1", "NEW"].doc_corroborations) == ("extracted", 0.5, "c0", 2)
    assert (got["1", "OLD"].origin, got["1", "OLD"].confidence, got["1", "OLD"].doc_corroborations) == ("structured", None, 3)
    assert got["9", "OLD"].doc_corroborations is None
    once = X.upsert(old.limit(0), ops.filter("rel_type = 'NEW' and ord = 0")).first()
    assert once.doc_corroborations is None


@pytest.fixture(scope="module")
def passed(spark, cat):
    t = triples(
        spark,
        ("O1", "odd", "DT1", "a late delivery", "k", "x"),
        ("O1", "odder", "DT1", "nothing", "k", "x"),
        ("S1", "gives", "P1", "ships it", "k", "x"),
        ("C1", "hits", "DT1", "whatever", "k", "x"),
    )
    return X.gate(t, cat).filter("gate = 'pass'")


def test_endpoint_override(passed, rows):
    got = {(r.subject, r.object): r.canon_predicate for r in X.override_by_endpoints(passed).collect()}
    assert got == {("O1", "DT1"): "RAISED_REPLACEMENT_ORDER", ("S1", "P1"): "GIVES", ("C1", "DT1"): "MISSED_COMMITMENT_UNDER"}


def test_fold_classifies_forces_and_realigns(passed):
    got = {(r.subject, r.object, r.predicate_cue): r.canon_predicate for r in X.fold_senses(passed).collect()}
    assert got == {("O1", "DT1", "a late delivery"): "LATE_DELIVERY_CAUSED_DOWNTIME", ("O1", "DT1", "nothing"): "ODDER", ("P1", "S1", "ships it"): "SUPPLIED_BY", ("C1", "DT1", "whatever"): "DELAYED_CONTRACT_DELIVERY"}


def test_modes_and_missing_providers(passed):
    off = sorted(r.canon_predicate for r in passed.collect())
    for mode in ("off", "embed_cluster", "guarded_override", "unknown"):
        assert sorted(r.canon_predicate for r in normalise(passed, mode).collect()) == off
    low = {r.canon_predicate for r in normalise(passed, "guarded_override", HashEmbedder(), sense_tau=-1.0).collect()}
    assert "DELAYED_CONTRACT_DELIVERY" in low and "GIVES" in low
    high = sorted(r.canon_predicate for r in normalise(passed, "guarded_override", HashEmbedder(), sense_tau=1.1).collect())
    assert high == off
    merged = {r.canon_predicate for r in normalise(passed, "embed_cluster", HashEmbedder(), tau=-1.0).filter("subject = 'O1'").collect()}
    assert merged == {"ODD"}  # equal support, so the shorter name


def test_audit(spark):
    df = spark.createDataFrame([("A", "B", "ODD"), ("A", "B", "ODD"), ("A", "B", "RARE"), ("Product", "Supplier", "SUPPLIED_BY")], "subject_label string, object_label string, canon_predicate string")
    a = X.predicate_audit(df).first()
    assert (a.distinct_total, a.singletons, a.inventory_distinct, a.residual_distinct, a.residual_triples, a.residual_rate) == (3, 2, 1, 2, 3, 0.75)
    assert [tuple(r) for r in X.residual_predicates(df).collect()] == [("ODD", 2), ("RARE", 1)]
    assert {r.kinds for r in X.pair_residuals(df).collect()} == {2}
    b = X.bridge_split(df).first()
    assert (b.fk_redundant_edges, b.genuine_bridge_edges, b.genuine_bridge_types) == (1, 3, 2)


def test_extractor_finds_names(spark):
    chunks = spark.createDataFrame([("c1", "d", "Oat Milk was supplied by S1."), ("c2", "d", "Oat needs Oat Milk")], "chunk_id string, doc_id string, text string")
    links = spark.createDataFrame([("c1", "P1", "oat milk"), ("c1", "S1", None), ("c1", "P2", "Oat"), ("c2", "P1", "oat milk"), ("c2", "P2", "Oat")], "chunk_id string, id string, name string")
    got = [(r.subject_id, r.predicate, r.object_id, r.source_chunk_id) for r in extract_triples(chunks, links).orderBy("source_chunk_id").collect()]
    assert got == [("P1", "WAS_SUPPLIED_BY", "S1", "c1"), ("P2", "NEEDS", "P1", "c2")]


def test_extractor_provider(spark):
    chunks = spark.createDataFrame([("c1", "d", "P1 was supplied by S1. O1 waits."), ("c2", "d", "P1 alone"), ("c3", "d", "S1 P1")], "chunk_id string, doc_id string, text string")
    links = spark.createDataFrame([("c1", "P1"), ("c1", "S1"), ("c1", "O1"), ("c2", "P1"), ("c3", "P1"), ("c3", "S1")], "chunk_id string, id string")
    got = [(r.subject_id, r.predicate, r.object_id, r.source_chunk_id) for r in extract_triples(chunks, links).orderBy("source_chunk_id").collect()]
    assert got == [("P1", "WAS_SUPPLIED_BY", "S1", "c1"), ("S1", "RELATED_TO", "P1", "c3")]
    assert extract_triples(chunks, links, limit=1).count() == 1

    class Broken(TemplateExtractor):
        def extract(self, text, candidates):
            raise RuntimeError("down")

    assert extract_triples(chunks, links, Broken()).count() == 0


def test_embedding_cache_and_batch_halving(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "t string")
    assert cached_embeddings(df, "t", path).count() == 2
    assert cached_embeddings(spark.createDataFrame([("a b",), ("new",)], "t string"), "t", path).count() == 2
    assert spark.read.parquet(path).count() == 3
    seen = []

    def call(batch):
        seen.append(len(batch))
        if len(batch) > 1:
            raise RuntimeError("too large")
        return [batch[0] * 2]

    assert in_parts([1, 2, 3], call) == [2, 4, 6] and seen == [3, 1, 2, 1, 1] and in_parts([], call) == []
    with pytest.raises(ItemFailed, match="item 2: ZeroDivisionError") as failed:
        in_parts([1, 2, 0, 4], lambda b: [1 / x for x in b])
    assert failed.value.place == 2


def test_model_is_asked_in_words_once_a_schema_is_refused():
    asked, late = [], [True]

    def send(messages, schema):
        asked.append((len(messages), schema is not None))
        if late:
            late.pop()
            raise TimeoutError("late")
        if schema:
            raise SchemaRefused
        return '```json\n{"x": [1]}\n```'

    m = Model(send, system_role=False)
    with pytest.raises(TimeoutError):
        m.fill("s", "u", {"type": "object"}, "x")
    assert m.takes_schema  # a timeout says nothing about schemas
    assert m.fill("s", "u", {"type": "object"}, "x") == {"x": [1]} and m.fill("s", "u", {}, "x") == {"x": [1]}
    assert asked == [(1, True), (1, True), (1, False), (1, False)]


def test_model_providers_read_what_a_script_answers():
    import json

    from weftgraph import providers as P

    answers = {"List the relations": {"triples": [{"subject_id": "S1", "predicate": "ships", "object_id": "P1", "evidence": "S1 ships P1"}, "x"]}, "Choose the meaning": {"choice": "A"}, "Name every": {"types": ["A", 3]}, "Pick the names": {"names": ["S1"], "topics": ["delay"]}, "Rate from": {"DB": 3, "Doc": "7", "Hybrid": None}}

    def send(messages, schema):
        ask = messages[0]["content"]
        return next((json.dumps(v) for k, v in answers.items() if ask.startswith(k)), "said")

    m = P.Model(send)
    assert P.ModelExtractor(m).extract("S1 ships P1", ["P1", "S1"], [("P1", "Oat")]) == [{"subject_id": "S1", "predicate": "ships", "object_id": "P1", "evidence": "S1 ships P1"}]
    assert P.ModelSense(m)(["A", "B"], "e") == "A" and P.ModelSense(m)(["B"], "e") == "OTHER"
    assert P.ModelPruner(m).pick("q", [("a", "A", "b")], []) == ["A"]
    assert P.ModelKeywords(m).keywords("q") == (["S1"], ["delay"]) and P.ModelKeywords(P.Model(lambda *_: 1 / 0)).keywords("q") == ([], [])
    assert P.ModelPoints(m).points("q") == {"DB": 3, "Doc": 7, "Hybrid": 0, "LLM": 0}
    assert P.ModelWriter(m).write("q", [("Supplier", "S1")], [], {}) == "said"
    assert {k: P.ModelAnswerer(m).answer("q", "c", k) for k in P.ANSWER_FROM} == dict.fromkeys(P.ANSWER_FROM, "said")
    assert P.RowAnswerer().answer("q", "", "none") != P.RowAnswerer().answer("q", "(no passages)", "documents") == "No results were found."


def test_words_are_found_as_by_their_patterns():
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choices(["a", "A", "b", "_", "1", " ", ".", "(", "aB1", "\u212a", "k"][: draw.choice([9, 11])], k=draw.randrange(20)))
        what = "".join(draw.choices("aAbk_1 (", k=draw.randrange(1, 5)))
        for pattern in (rf"\b{re.escape(what)}\b", rf"(?<!\w){re.escape(what)}(?!\w)"):
            assert TemplateExtractor._spans(text, text.lower(), what, pattern) == [m.span() for m in re.finditer(pattern, text, re.I)]


def _shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    nothing = gateway.jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_extract_provider_moves_texts_once(spark, tmp_path):
    draw = random.Random(3)
    noise = lambda: " ".join("".join(draw.choices("ghijklmnopqrstuv", k=16)) for _ in range(600))
    made = [(f"c{i}", "d", f"{noise()}. Oat Milk was supplied by PRD002. {noise()}") for i in range(8)] + [(f"x{i}", "d", noise()) for i in range(400)]
    spark.createDataFrame(made + made[:4], "chunk_id string, doc_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("PRD001", "oat milk"), ("PRD002", "Bran")], "product_id string, product_name string").write.parquet(f"{tmp_path}/products.parquet")
    spark.createDataFrame([], "subject_id string, object_id string").write.parquet(f"{tmp_path}/extracted_triples.parquet")
    before = _shuffled(spark)
    got = T.extract_provider(spark, str(tmp_path))
    written = sum(b for s, b in _shuffled(spark).items() if s not in before)
    assert sorted((r.subject_id, r.predicate, r.object_id, r.source_chunk_id) for r in got.collect()) == [("PRD001", "WAS_SUPPLIED_BY", "PRD002", f"c{i}") for i in range(8)]
    assert written < 1.2 * sum(len(t) for *_, t in made)
