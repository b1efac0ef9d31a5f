import random

import pytest

from weftgraph.llm.split import limited_items, split_oversized

SCHEMA = "item_id string, text string, max_chars int, overlap_chars int, piece string"


def pieces(spark, text, limit, overlap):
    row = split_oversized(spark.createDataFrame([("a", text, limit, overlap, "clash")], SCHEMA)).first()
    return None if row.pieces is None else [(p.piece_no, p.start_char, p.end_char, p.piece) for p in row.pieces]


def check(text, got, limit, overlap):
    assert got[0][1] == 0 and got[-1][2] == len(text)
    for n, (no, a, b, s) in enumerate(got):
        assert no == n and s == text[a:b] and 0 < len(s) <= limit
        if n:
            assert a == got[n - 1][2] - overlap and b > got[n - 1][2]


def test_defined_results(spark):
    assert pieces(spark, None, 10, 0) is None and pieces(spark, "", 10, 0) == []
    assert pieces(spark, "short", 10, 3) == [(0, 0, 5, "short")]
    assert pieces(spark, "x" * 10, 10, 3) == [(0, 0, 10, "x" * 10)]
    for limit in (None, 0, -1):
        assert pieces(spark, "anything", limit, None) == [(0, 0, 8, "anything")]
    assert split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
    assert split_oversized(spark.createDataFrame([("a", "b c", 2, 0, None)] * 2, SCHEMA)).count() == 2


def test_boundaries_by_strength(spark):
    text = "Alpha beta gamma. Delta epsilon zeta eta\n\nTheta iota, kappa lambda"
    got = pieces(spark, text, 45, 0)
    assert [p[3] for p in got] == ["Alpha beta gamma. Delta epsilon zeta eta\n\n", "Theta iota, kappa lambda"]
    assert [p[3] for p in pieces(spark, "One two three. Four five six seven", 20, 0)][0] == "One two three. "
    assert [p[3] for p in pieces(spark, "aaa bbb, ccc ddd eee", 12, 0)][0] == "aaa bbb, "
    assert [p[3] for p in pieces(spark, "早上停机检查。下午恢复生产线路运行", 10, 0)][0] == "早上停机检查。"
    assert [p[3] for p in pieces(spark, "wordone wordtwo", 10, 0)] == ["wordone ", "wordtwo"]


def test_characters_only_as_a_last_resort(spark):
    assert [p[3] for p in pieces(spark, "a" * 25, 10, 0)] == ["a" * 10, "a" * 10, "a" * 5]
    marked = "é" * 12  # a letter and its accent stay together
    for p in pieces(spark, marked, 5, 0):
        assert not p[3].startswith("́")
    assert all(len(p[3]) <= 4 for p in pieces(spark, "😀" * 11, 4, 1))


@pytest.mark.parametrize(("limit", "overlap"), [(7, 0), (20, 5), (50, 10), (64, 31), (9, 100), (10, 9), (100, 70)])
def test_random_texts_keep_the_rules(spark, limit, overlap):
    rng = random.Random(limit)
    alphabet = ["word", "longerword", ". ", "! ", "\n", "\n\n", ", ", " ", "。", "字", "😀", "é", "ไทย", "1,5", '." ', "a" * 30]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    rows = split_oversized(spark.createDataFrame([(t, t, limit, overlap, None) for t in texts], SCHEMA)).collect()
    lap = min(overlap, limit - 1)
    for r in rows:
        got = [(p.piece_no, p.start_char, p.end_char, p.piece) for p in r.pieces]
        check(r.text, got, limit, lap)
        for p, q in zip(got, got[1:]):  # no cut inside a word if the new text had a blank to cut at
            new = p[3][lap if p[0] else 0 :]
            floor = lap if p[0] == 0 else 1
            if not new[-1].isspace() and new[-1] not in "。，、；：":
                assert not any(new[i].isspace() and not r.text[p[2] - len(new) + i + 1].isspace() for i in range(max(floor - 1, 0), len(new) - 1)), (new, r.text)


def test_very_long_text(spark):
    text = "Ein Satz mit Wörtern. " * 30_000
    got = pieces(spark, text, 1500, 100)
    check(text, got, 1500, 100)


def test_items_find_their_limit(spark):
    docs = spark.createDataFrame([("D1", "x" * 30, " Src "), ("D2", "x" * 30, None), ("D3", None, "src"), ("D4", "x" * 30, "other"), ("D5", "x" * 9, "src")], "document_id string, text string, source string")
    chunks = spark.createDataFrame([("D1#c0", "d1", "y" * 30), ("D1#c0", "d1", "y" * 30), ("D2#c0", "D2", "y" * 30), ("D1#c1", "D1", "y"), (None, "D1", None)], "chunk_id string, doc_id string, text string")
    limits = spark.createDataFrame([("document", "SRC", 10, 2), ("Document ", "src", 20, 3), ("chunk", "src", 15, 1), ("chunk", "x", None, 1)], "item_type string, source_name string, max_chars int, overlap_chars int")
    got = sorted((r.item_type, r.item_id, r.max_chars, r.overlap_chars) for r in limited_items(docs, chunks, limits).collect())
    assert got == [("chunk", "D1#c0", 15, 1), ("document", "D1", 10, 2)]
    assert limited_items(docs.limit(0), chunks.limit(0), limits.limit(0)).count() == 0
