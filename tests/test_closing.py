"""Closing paths: nodes as packed strings, ends that filters leave, paths of no step."""

from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators import shacl
from quadloom.plans import compiler, fixpoint
from quadloom.plans.compiler import Compiler, to_native
from quadloom.plans.parser import parse_query
from quadloom.sources import turtle
from quadloom.sources.mapping import BASE

PREFIX = f"PREFIX : <{BASE}> "


def asked(spark, data, text, names):
    found = Compiler(data).select(parse_query(PREFIX + text))
    return sorted(tuple(r) for r in to_native(found, {n: "string" for n in names}).collect())


def test_terms_are_read_back(spark):
    texts = ["", "a", "1:2:x", "é😀:", "12", "\n\0"]
    rows = [(g, k, lex, dt, lang) for g in ("", "urn:3:g😀") for k in (0, 1, 2) for lex in texts for dt, lang in ([("", "")] if k < 2 else [("", ""), (T.XSD_STRING, ""), (T.LANG_STRING, "en")])]
    df = spark.createDataFrame(rows, "g string, kind tinyint, lex string, dt string, lang string").select("g", F.struct("kind", "lex", "dt", "lang").alias("t"))
    df = df.select("g", "t", T.packed(F.col("t")).alias("a"), T.packed(F.col("t"), F.col("g")).alias("b"))
    good = (T.unpacked(F.col("a")) == F.col("t")) & (T.unpacked(F.col("b"), True) == F.col("t")) & (T.graph_of(F.col("b")) == F.col("g"))
    assert df.filter(~F.coalesce(good, F.lit(False))).isEmpty() and df.select("b").distinct().count() == len(rows)


def test_ends_that_filters_leave(spark, monkeypatch):
    """A filter on what a path is joined with reaches the closure, and no node but its ends is read for paths of no step."""
    data = turtle.quads(spark, f"@prefix : <{BASE}> . " + " ".join(f":a{k} :next :a{k + 1} ." for k in range(6)) + " :a6 :name 'a'@en , 7 .", "g")
    seen, closure = [], compiler.closure
    monkeypatch.setattr(compiler, "closure", lambda edges, seeds=None, *rest, **named: seen.append(seeds.count()) or closure(edges, seeds, *rest, **named))
    wanted = [("g", BASE + "a1", BASE + f"a{k}") for k in range(2, 7)]
    assert asked(spark, data, 'SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x :next ?z . ?z :next* ?y FILTER(STRENDS(STR(?x), "1") && BOUND(?y)) } }', "gxy") == wanted
    assert seen == [1]
    # what a filter draws anew isn't put before the path
    asked(spark, data, "SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x :next ?z . ?z :next* ?y FILTER(STRLEN(STR(?x)) > 0 * RAND()) } }", "gxy")
    assert seen == [1, 6]


def test_paths_of_no_step(spark):
    data = turtle.quads(spark, f"@prefix : <{BASE}> . :a :next :b . :b :next :a ; :name 'b'@en , 7 . :next :of :c .", "g")
    assert asked(spark, data, "SELECT ?y WHERE { GRAPH ?g { :a :next ?x . ?x :next* ?y } }", "y") == [(BASE + "a",), (BASE + "b",)]
    assert asked(spark, data, "SELECT ?n ?y WHERE { GRAPH ?g { :b :name ?n . ?n :next* ?y } }", "ny") == [("7", "7"), ("b", "b")]
    # a predicate is a node only where it is a subject or object too; a graph's name isn't
    assert asked(spark, data, "SELECT ?p ?y WHERE { GRAPH ?g { :a ?p :b . ?p :of* ?y } }", "py") == [(BASE + "next", BASE + "c"), (BASE + "next", BASE + "next")]
    assert asked(spark, data, "SELECT ?p ?y WHERE { GRAPH ?g { :b ?p 7 . ?p :of* ?y } }", "py") == []
    assert asked(spark, data, "SELECT ?y WHERE { GRAPH ?g { :a :next ?x . ?g :next* ?y } }", "y") == []


def test_chains_are_closed_in_few_rounds(spark, monkeypatch):
    """400 edges from seeds: chains, whose steps double, chains into a cycle, and a graph with forks, which takes an edge a round."""
    written, write = [], fixpoint.checkpointed
    monkeypatch.setattr(fixpoint, "checkpointed", lambda df: written.append(df) or write(df))
    chains = [(f"{c}.{i}", f"{c}.{i + 1}") for c in range(10) for i in range(40)]
    for edges, most in ((chains, 16), (chains + [(f"{c}.40", f"{c}.{30 + c}") for c in range(10)], 18), (chains + [("0.0", "1.39"), ("1.40", "1.0")], 200)):
        after = {}
        for s, o in edges:
            after.setdefault(s, set()).add(o)
        wanted = set()
        for s in ("0.0", "1.7", "9.20", "none"):
            todo = list(after.get(s, ()))
            while todo:
                if (s, o := todo.pop()) not in wanted:
                    wanted.add((s, o))
                    todo += after.get(o, ())
        written.clear()
        seeds = spark.createDataFrame([("0.0",), ("1.7",), ("9.20",), ("none",)], "s string")
        found = [tuple(r) for r in fixpoint.closure(spark.createDataFrame(edges, "s string, o string"), seeds).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted and len(written) <= most


def test_closing_paths_share_their_steps_and_start_at_literals(spark):
    data = turtle.quads(spark, f'@prefix : <{BASE}> . :a a :C ; :name "x" ; :next :b . :b :name "x" ; :next :c . :c :next :a . :d a :D ; :next :e .', "")
    shape = "@prefix sh: <%s> . @prefix : <%s> . :S sh:targetClass :C ; sh:property [ sh:path %s ; sh:maxCount 1 ] . :R sh:targetClass :D ; sh:property [ sh:path %s ; sh:maxCount 1 ] ."

    def found(one, other):
        return sorted(r.focus_node[-1] for r in shacl.validate(data, shape % (shacl.SH, BASE, one, other)).collect())

    assert found("( :name [ sh:zeroOrMorePath [ sh:inversePath :name ] ] )", ":name") == ["a"]  # "x" itself, :a and :b
    assert found("[ sh:zeroOrMorePath :next ]", "[ sh:oneOrMorePath :next ]") == ["a"] and found("[ sh:oneOrMorePath :next ]", "[ sh:zeroOrMorePath :next ]") == ["a", "d"]
