import pytest

from weftgraph.operators.graph_build import EdgeSet, Graph
from weftgraph.plans.pattern import Compiler, PatternError, check, clean, parse, repair_tokens, validate

PATTERNS = {("A", "KNOWS", "A"), ("A", "OWNS", "B")}
PROPS = {"A": {"name", "age"}, "B": {"title"}}


@pytest.fixture(scope="module")
def graph(spark):
    a = spark.createDataFrame([("1", "ann", 30), ("2", "bob", 20), ("3", "cy", None)], "id string, name string, age int")
    b = spark.createDataFrame([("x", "one"), ("y", "two")], "id string, title string")
    knows = spark.createDataFrame([("1", "2", 0.9), ("2", "3", 0.2), ("3", "3", 0.5)], "src string, dst string, confidence double")
    owns = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "x")], "src string, dst string")
    return Graph({"A": a, "B": b}, {"A": "name", "B": "title"}, [EdgeSet("A", "A", "extracted", knows, "KNOWS"), EdgeSet("A", "B", "structured", owns, "OWNS")])


def run(graph, text):
    return sorted((tuple(r) for r in Compiler(graph).run(text).collect()), key=str)


def test_undirected_and_self_loop_once(graph):
    assert run(graph, "MATCH (a:A)-[:KNOWS]->(b:A) RETURN a.name AS x, b.name AS y") == [("ann", "bob"), ("bob", "ann"), ("bob", "cy"), ("cy", "bob"), ("cy", "cy")]


def test_edge_used_once_within_a_clause_not_across(graph):
    assert run(graph, "MATCH (a:A)-[:OWNS]-(b:B)-[:OWNS]-(c:A) RETURN a.name AS x, c.name AS y") == [("ann", "bob"), ("bob", "ann")]
    assert len(run(graph, "MATCH (a:A)-[:OWNS]-(b:B) MATCH (b)-[:OWNS]-(c:A) RETURN a.name AS x, c.name AS y")) == 5


def test_optional_keeps_rows(graph):
    assert run(graph, "MATCH (a:A) OPTIONAL MATCH (a)-[:OWNS]-(b:B) WHERE b.title = 'two' RETURN a.name AS x, b.title AS y") == [("ann", "two"), ("bob", None), ("cy", None)]


def test_where_order_skip_limit_distinct(graph):
    rows = Compiler(graph).run("MATCH (a:A) WHERE a.age IS NOT NULL AND NOT a.name = 'zed' RETURN a.name AS n ORDER BY a.age DESC SKIP 1 LIMIT 1").collect()
    assert [r.n for r in rows] == ["bob"]
    assert [r.n for r in Compiler(graph).run("MATCH (a:A) RETURN a.age AS n ORDER BY n").collect()] == [20, 30, None]
    assert run(graph, "MATCH (a:A)-[:OWNS]-(b:B) RETURN DISTINCT b.title AS t") == [("one",), ("two",)]
    assert run(graph, "MATCH (a:A) WHERE a.name IN ['ann', 'cy'] OR a.name STARTS WITH 'b' RETURN count(*) AS n") == [(3,)]
    assert run(graph, "MATCH (a:A) WHERE a.name =~ '.*n' AND a.name CONTAINS 'n' AND a.name ENDS WITH 'n' RETURN toUpper(a.name) AS n") == [("ANN",)]


def test_untyped_hop_and_edge_properties(graph):
    assert run(graph, "MATCH (a:A {name: 'bob'})-[r]-(z) RETURN type(r) AS t, label(z) AS l") == [("KNOWS", "A"), ("KNOWS", "A"), ("OWNS", "B")]
    assert run(graph, "MATCH (a:A)-[r]-(b:A) WHERE r.origin = 'extracted' AND r.confidence >= 0.5 RETURN a.name AS x, b.name AS y") == [("ann", "bob"), ("bob", "ann"), ("cy", "cy")]


def test_aggregates(graph):
    assert run(graph, "MATCH (a:A)-[:OWNS]-(b:B) RETURN a.name AS n, count(DISTINCT b.title) AS k, collect(b.title) AS c") == [("ann", 2, ["one", "two"]), ("bob", 1, ["one"])]


def test_safety_and_cleaning():
    for bad in ("MATCH (a) DELETE a", "MATCH (a) RETURN 'SET'", "MATCH (a) RETURN a; MATCH (b) RETURN b", "load  csv from 'x'"):
        with pytest.raises(PatternError):
            validate(bad)
    assert validate("MATCH (a:A) RETURN a;").endswith("LIMIT 50") and validate("MATCH (a) RETURN a LIMIT 999999").endswith("999999")
    assert clean("```cypher\nMATCH (a)-[:R]->(b)<-[:S]-(c)-->(d) RETURN a\n```") == "MATCH (a)-[:R]-(b)-[:S]-(c)--(d) RETURN a"


def test_repair_only_when_one_name_is_near():
    assert repair_tokens("(a)-[r:SUPPLIEDBY]-(b)", {"SUPPLIED_BY", "IN_REGION"}, "[") == ("(a)-[r:SUPPLIED_BY]-(b)", [("SUPPLIEDBY", "SUPPLIED_BY")])
    assert repair_tokens("[:ON_LIN]", {"ON_LINE", "ON_LINK"}, "[") == ("[:ON_LIN]", [])
    assert repair_tokens("(:Prodct)", {"Product"}, "(")[0] == "(:Product)"


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("MATCH (a:A)-[:NOPE]-(b:B) RETURN a.name AS n", "NOPE"),
        ("MATCH (a:C) RETURN a.name AS n", "C"),
        ("MATCH (b:B)-[:KNOWS]-(a:A) RETURN a.name AS n", "does not exist"),
        ("MATCH (a:A {nam: 'x'}) RETURN a.name AS n", "nam"),
        ("MATCH (a:A) RETURN a.title AS n", "title"),
        ("MATCH (a:A {name: 'x', name: 'y'}) RETURN a.name AS n", "repeats"),
        ("MATCH (a:A RETURN a", "syntax"),
        ("MATCH (a:A)-[:KNOWS*1..3]-(b:A) RETURN a.name AS n", "syntax"),
    ],
)
def test_check_names_the_problem(text, part):
    assert part in check(text, PATTERNS, PROPS)


def test_check_passes_either_direction_unless_directed():
    text = "MATCH (b:B)-[:OWNS]->(a:A) RETURN a.name AS n"
    assert check(text, PATTERNS, PROPS) is None and "does not exist" in check(text, PATTERNS, PROPS, directed=True)


def test_parser_reads_quotes_numbers_and_backticks():
    q = parse("MATCH (`a`:A {name: 'it\\'s', age: 1.5}) WHERE a.age > -2 RETURN a.name AS n")
    assert q.matches[0].paths[0][0].props == (("name", "it's"), ("age", 1.5))
