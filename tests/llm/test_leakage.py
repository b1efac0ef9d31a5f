import random

import numpy as np

from weftgraph.llm import leakage as L

ITEM = "item_id bigint, question string, category string, answer string, expect string, passage string, lang string"


def _leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, ITEM)
    return sorted((r.doc_id, r.item_id, r.shared_run) for r in L.find_leaks(d, i).collect())


PASSAGE = "A rented chiller overfed the Hempraka ring when gauge Botraren fell, though Garula wanted 658 more lids."


def item(n, passage, lang="en", question="Who wanted lids?", answer="Garula;658"):
    return (n, question, "c", answer, "answer", passage, lang)


def test_bare_text():
    assert L.bare("Ａb­-C 1​!\n_é") == "abc1é" and L.bare(None) == ""
    ascii_ = "".join(map(chr, range(128)))
    assert L.bare(ascii_) == L.bare(ascii_ + "é")[:-1]


def test_dressed_copies_are_found(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PASSAGE)
    wrapped = PASSAGE.replace(" ", "\n\t").replace("chiller", "chil-\nler")
    part = "Noise before. " + PASSAGE[10:70].upper() + " and noise."
    docs = [(1, PASSAGE, "x"), (2, wide, None), (3, wrapped, None), (4, part, None), (5, "Garula wanted 658 more lids.", None), (6, None, None), (7, "", None), (8, "z" * 5000 + PASSAGE, None), (1, PASSAGE, "x")]
    got = _leaks(spark, docs, [item(10, PASSAGE), item(10, PASSAGE), item(11, None), item(12, "short"), item(13, "Another text that nobody has ever seen in any of these documents at all.")])
    whole = len(L.bare(PASSAGE))
    assert [(d, i) for d, i, _ in got] == [(1, 10), (2, 10), (3, 10), (4, 10), (8, 10)]
    assert {d: n for d, _, n in got if d != 4} == dict.fromkeys((1, 2, 3, 8), whole)


def test_run_of_exactly_the_length(spark):
    bare = L.bare(PASSAGE)
    docs = [(1, "qq " + bare[5:45] + " qq", None), (2, "qq " + bare[5:44] + "#q", None), (3, "闸门432打开前转台丢失了第874批", None), (4, "闸门432打开前转台丢失了第", None)]
    zh = "珞璎岚空转时，窑口拖慢了882筐砚洛麒。闸门432打开前，转台丢失了第874批砚泓沁。"
    got = _leaks(spark, docs, [item(1, PASSAGE), item(2, zh, "zh")])
    assert got == [(1, 1, 40), (3, 2, 18)]


def test_empty_tables(spark):
    assert _leaks(spark, [], [item(1, PASSAGE)]) == [] and _leaks(spark, [(1, PASSAGE, None)], []) == []


def test_language_sets_the_run_and_repeated_items_are_settled(spark):
    rows = [item(1, "p", "zh"), item(2, "p", "ja "), item(3, "p", "zh-CN"), item(4, "p", "en"), item(5, "p", None), item(6, "p", "en"), item(6, "p", "zh"), item(6, "p", "de"), item(None, "p"), item(7, None)]
    assert {r.item_id: r.run for r in L._wanted(spark.createDataFrame(rows, ITEM)).collect()} == {1: 16, 2: 16, 3: 16, 4: 40, 5: 40, 6: 16}


def test_number_of_indexes_plays_no_part(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{n}x{n * 7}" for n in range(200)]
    items = [item(n, " ".join(rng.choice(words) for _ in range(40)), "zh" if n % 5 == 0 else "en") for n in range(40)]
    docs = [(n, " ".join(rng.choice(words) for _ in range(60)) + (items[n % 40][5][20 : 20 + rng.randrange(10, 90)] if n % 3 else ""), None) for n in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, ITEM)
    run = lambda: sorted((r.doc_id, r.item_id, round(r.bm25, 4), r.shared_run, r.question_share, r.answers_found) for r in L.find_leaks(d, i).collect())
    want = run()
    assert len(want) > 20
    monkeypatch.setattr(L, "INDEX_BYTES", 200 * L.BYTES_PER_CHARACTER * 8)
    assert run() == want
    monkeypatch.setattr(L, "FILTER_BYTES", 1024)  # a filter that lets nearly everything pass
    assert run() == want


def test_size_of_an_index_is_what_is_reckoned():
    import pickle

    rng = random.Random(1)
    items = [L.Item(n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)), 40, "", []) for n in range(700)]
    size = len(pickle.dumps(L.Index(items))) - (1 << 22)
    assert size < sum(len(i.text) for i in items) * L.BYTES_PER_CHARACTER


def _corpus(seed):
    rng = random.Random(seed)
    words = [f"w{n}x{n * 7}" for n in range(30)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [L.Item(i, L.bare(text(30)), 16 if i % 3 == 0 else 40, "", []) for i in range(150)]
    docs = []
    for _ in range(60):
        d = text(150)
        for _ in range(rng.randrange(3)):
            p = rng.choice(items).text
            a = rng.randrange(len(p) - 50)
            at = rng.randrange(len(d))
            d = d[:at] + p[a : a + rng.randrange(10, 60)] + d[at:]
        docs.append(d)
    return L.Index(items), docs


def test_wand_equals_scoring_everything_and_misses_no_run():
    """Few words, so that many items share grams and blocks are skipped."""
    for seed in range(3):
        index, docs = _corpus(seed)
        for d in docs:
            whole = L.bare(d)
            at, terms = index.lookup(L.grams(whole))
            query = sorted(set(terms[: 400].tolist()))
            scores: dict = {}
            for t in query:
                for doc, w in zip(*index.list_of(t)):
                    scores[doc] = scores.get(doc, 0.0) + w
            want = {doc for doc, s in scores.items() if s >= index.least[doc] + 1e-6}
            got = {doc for doc, _ in index.search(query)}
            assert want <= got <= {doc for doc, s in scores.items() if s >= index.least[doc] - 1e-6}
            brute = {n for n, i in enumerate(index.items) if any(whole[p : p + i.run] in i.text for p in range(len(whole) - i.run + 1))}
            assert {x[0] for x in index.leaks(whole)} == brute
            for n, _, run, _, _ in index.leaks(whole):  # and the run is the longest
                assert [any(whole[p : p + size] in index.items[n].text for p in range(len(whole) - size + 1)) for size in (run, run + 1)] == [True, False]
            bits = np.zeros(1 << 16, np.uint8)
            spot = index.terms % np.uint64(1 << 19)
            np.bitwise_or.at(bits, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
            assert L.shares_run(whole, bits, 16 - L.N + 1) or not brute


def test_question_and_answers_are_reported(spark):
    d = spark.createDataFrame([(1, PASSAGE + " Who wanted lids?", None)], "doc_id bigint, text string, item_id string")
    r = L.find_leaks(d, spark.createDataFrame([item(1, PASSAGE)], ITEM)).first()
    assert r.question_share == 1.0 and r.answers_found == 2 and r.bm25 > 0
