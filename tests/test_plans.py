"""Plans and paths through the engine that results alone don't show."""

import random

import pytest
from quadloom.plans import fixpoint
from quadloom.plans.compiler import Compiler, to_native
from quadloom.plans.parser import parse_query, scoped_text
from quadloom.plans.registry import PREFIXES, QUERIES
from quadloom.sources import turtle
from quadloom.sources.mapping import mapped, shop

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_is_one_scan_with_its_filters(spark):
    found = plan(QUERIES["sparql_star_filter"](spark, SMALL))
    assert found.count("FileScan") == 1 and "GreaterThan(p_size,40)" in found and "Join" not in found


def test_joins_use_the_tables_own_keys(spark):
    found = plan(QUERIES["sparql_customers_per_region"](spark, SMALL))
    assert found.count("FileScan") == 3 and "BroadcastHashJoin [_h_na" in found and "keys=[_h_region" in found


@pytest.mark.parametrize(
    "text",
    [
        'SELECT ?x ?n WHERE { ?x :n_name ?n ; :region ?r . ?r :r_name ?q FILTER(?q > "B" && ?n != "X") }',
        "SELECT ?x ?r WHERE { ?x :region ?r ; :region ?s FILTER(?s = ?r) }",
        "SELECT ?x WHERE { ?x :region <urn:region:1> ; a :Nation }",
        "SELECT ?x WHERE { ?x :region <urn:region:01> }",
        "SELECT ?x ?p WHERE { ?x a :Nation ; ?p ?o }",
        "SELECT ?r (COUNT(?x) AS ?n) (MIN(?m) AS ?low) WHERE { ?x :region ?r ; :n_name ?m } GROUP BY ?r ORDER BY ?r",
        "SELECT ?x ?m WHERE { { ?x :n_name ?m } UNION { ?x :r_name ?m } OPTIONAL { ?x :region ?r } FILTER(BOUND(?r) || STRLEN(?m) < 5) }",
        "SELECT ?x WHERE { ?x :region/:r_name ?m MINUS { ?x :n_name ?m } FILTER NOT EXISTS { ?y :region ?x } }",
    ],
)
def test_mapped_scans_answer_as_quads_do(spark, text):
    quads, q = shop(spark, SMALL, ["nation", "region"]), parse_query(text, PREFIXES)
    one, two = Compiler(quads).select(q), Compiler(quads, maps=mapped(spark, SMALL, ["nation", "region"])).select(q)
    rows = lambda s: sorted(map(str, to_native(s, {v: "string" for v in s.vars}).select(*sorted(s.vars)).collect()))
    assert rows(one) == rows(two)


def test_closure_on_the_driver_and_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)], "s string, o string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("none",)], "s string")
    results = []
    for few in (300, 0):
        monkeypatch.setattr(fixpoint, "FEW", few)
        results.append([sorted(map(tuple, x.collect())) for x in (fixpoint.closure(edges), fixpoint.closure(edges, seeds), fixpoint.closure(edges, seeds.selectExpr("s as o"), backwards=True))])
    assert results[0] == results[1] and results[0][0]


def test_lines_read_back(spark):
    odd = ['plain', 'q"uo\\te', "new\nline\ttab\r", "\x01\x7f", "é\U0001f600", "", "\\n", "\\\\", "ends with \\"]
    text = "".join(f"<urn:s{i}> <urn:p> \"{t}\" .\n" for i, t in enumerate(["a", "b"])) + '<urn:s> <urn:p> "x"@EN . _:b <urn:p> _:c . <urn:s> <urn:q> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .'
    rows = turtle.quads(spark, text, "g").unionAll(spark.createDataFrame([("g", 0, f"urn:o{i}", "urn:p", 2, t, "http://www.w3.org/2001/XMLSchema#string", "", False) for i, t in enumerate(odd)], turtle.QUADS))
    back = turtle.read_lines(turtle.lines(rows), "g")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert turtle.read_lines(spark.createDataFrame([("# comment",), ("",), ("nonsense .",)], "value string"), "g").isEmpty()


def test_scoped_text():
    g = "urn:g"
    assert scoped_text("SELECT * { ?s ?p ?o }", g) == "SELECT * { GRAPH <urn:g> { ?s ?p ?o } }"
    assert scoped_text('SELECT * WHERE { ?s ?p "}" # }\n } LIMIT 1', g) == 'SELECT * WHERE { GRAPH <urn:g> { ?s ?p "}" # }\n } } LIMIT 1'
    assert scoped_text("DESCRIBE <urn:x>", g) is None


FACTS = '@prefix : <urn:> . :a :p 1 ; :q 1 ; :n "a" . :b :p 2 ; :q 3 ; :n "b" . :c :p 5 . :d :q 5 ; :n "d" . :a :k :b . :b :k :c . :c :k :d .'


@pytest.mark.parametrize(
    "text, rows, crosses",
    [
        ("SELECT ?x WHERE { ?x :p ?v FILTER EXISTS { ?x :k ?y OPTIONAL { ?y :p ?w FILTER(?w > ?v) } FILTER(BOUND(?w)) } }", ["a", "b"], False),
        ("SELECT ?x WHERE { ?x :p ?v FILTER NOT EXISTS { ?x :k ?y FILTER EXISTS { ?y :p ?w FILTER(?w > ?v) } } }", ["c"], False),
        ("SELECT ?x WHERE { ?x :p ?v FILTER EXISTS { { ?x :q ?w FILTER(?w = ?v) } UNION { ?x :k ?z FILTER(?v = 5) } } }", ["a", "c"], False),
        ("SELECT ?x WHERE { ?x :p ?v FILTER EXISTS { ?x :k ?y { ?y :p ?w FILTER(?w = ?v + 1) } } }", ["a"], False),
        ("SELECT ?x WHERE { ?x :p ?v FILTER EXISTS { ?x :k ?y MINUS { ?y :p ?w FILTER(?w > ?v + 1) } } }", ["a", "c"], False),
        ("SELECT ?x WHERE { ?x :k ?y OPTIONAL { ?x :q ?v } FILTER EXISTS { ?y :k ?z { ?z :q ?u FILTER(!BOUND(?v) || ?u > ?v) } } }", ["b"], False),
        ("SELECT ?x ?v ?y WHERE { { ?x :n ?m OPTIONAL { ?x :p ?v } } { ?y :n ?m OPTIONAL { ?y :q ?v } } }", ["a 1 a", "d 5 d"], False),
        ("SELECT ?x ?v ?z WHERE { ?x :n ?m OPTIONAL { ?x :p ?v } OPTIONAL { ?z :q ?v } }", ["a 1 a", "b 2 -", "d 1 a", "d 3 b", "d 5 d"], True),
        ('SELECT ?x WHERE { ?x :n ?m OPTIONAL { ?x :p ?v } MINUS { ?z :n "d" OPTIONAL { ?z :p ?v } } }', ["a", "b", "d"], False),
        ("SELECT ?x WHERE { ?x :n ?m OPTIONAL { ?x :p ?v } MINUS { ?z :k ?o OPTIONAL { ?z :p ?v } } }", ["d"], False),
        ('SELECT ?x WHERE { ?x :n ?m OPTIONAL { ?x :p ?v } FILTER(?m = "d" || EXISTS { ?x :k ?y FILTER EXISTS { ?y :p ?w FILTER(?w > ?v + 2) } }) }', ["b", "d"], False),
    ],
)
def test_exists_at_any_depth_and_joins_on_what_may_be_unbound(spark, text, rows, crosses):
    """Rows by hand; no plan compares row with row unless a row that binds nothing in common asks for it."""
    found = Compiler(turtle.quads(spark, FACTS, "")).select(parse_query(text, {"": "urn:"}))
    assert sorted(" ".join(x.lex.removeprefix("urn:") if x else "-" for x in r) for r in found.df.collect()) == rows
    assert ("NestedLoop" in plan(found.df) or "Cartesian" in plan(found.df)) == crosses


def test_closing_paths_stay_in_their_graph(spark):
    data = turtle.quads(spark, "<urn:a> <urn:k> <urn:b> .", "urn:1").unionByName(turtle.quads(spark, "<urn:b> <urn:k> <urn:c> . <urn:c> <urn:k> <urn:b> .", "urn:2"))
    rows = lambda t: sorted(" ".join(x.lex.removeprefix("urn:") for x in r) for r in Compiler(data).select(parse_query(t, {"": "urn:"})).df.collect())
    assert rows("SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x :k+ ?y } }") == ["1 a b", "2 b b", "2 b c", "2 c b", "2 c c"]
    assert rows("SELECT ?g ?y WHERE { GRAPH ?g { :b :k* ?y } }") == ["1 b", "2 b", "2 c"]
    assert rows("SELECT ?g ?x WHERE { GRAPH ?g { ?x :k? :b } }") == ["1 a", "1 b", "2 b", "2 c"]
    assert rows("SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x :k ?z . ?z :k+ ?y } }") == ["2 b b", "2 b c", "2 c b", "2 c c"]


def test_exists_in_exists_is_one_join(spark, monkeypatch):
    """No pairs of rows and what the outer group binds are made: the inner group joins the outer one, and the furthest value decides."""
    from quadloom.plans import compiler

    def none(df):
        raise AssertionError("rows are marked")

    monkeypatch.setattr(compiler, "checkpointed", none)
    rows = lambda s: sorted(" ".join(x.lex.removeprefix("urn:") for x in r) for r in s.df.collect())
    text = "SELECT ?x WHERE { ?x :p ?v FILTER EXISTS { ?x :k ?y FILTER EXISTS { ?y :p ?w FILTER(?w > ?v) } FILTER(!BOUND(?w)) } }"
    assert rows(Compiler(turtle.quads(spark, FACTS, "")).select(parse_query(text, {"": "urn:"}))) == ["a", "b"]
    data, maps = shop(spark, SMALL, ["customer", "orders"]), mapped(spark, SMALL, ["customer", "orders"])
    for op in ("?t > ?b * 50", "?b * 50 >= ?t", "?t < ?b * 10", "?b * 10 <= ?t"):
        q = parse_query(f"SELECT ?c WHERE {{ ?c :nation ?n ; :c_acctbal ?b FILTER NOT EXISTS {{ ?d :nation ?n ; :c_mktsegment ?m FILTER EXISTS {{ ?o :placedBy ?d ; :o_totalprice ?t FILTER({op}) }} }} }}", PREFIXES)
        found = Compiler(data, maps=maps).select(q)
        assert "max(_h_t" in plan(found.df) or "min(_h_t" in plan(found.df)
        assert rows(found) == rows(Compiler(data).select(q))
