"""Joins in which most rows share one key, and work dealt to tasks: the results are the same on every way."""

import pytest
from quadloom.operators import deep_scan, extract, rdfs
from quadloom.plans import skew
from quadloom.sources import turtle

VOCABULARY = "@prefix : <urn:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :p rdfs:domain :A ; rdfs:range :B ; rdfs:subPropertyOf :q . :A rdfs:subClassOf :C . "


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conclusions_are_not_met_by_a_shuffle_of_one_key(spark, monkeypatch):
    data = turtle.quads(spark, VOCABULARY + " ".join(f":s{k} :p :o{k} ; :r {k} ." for k in range(9)) + " :s1 a :A ; :q :o1 .", "")
    rows = lambda: sorted(map(tuple, rdfs.infer(data).collect()))
    found = plan(rdfs.infer(data))
    assert "SortMergeJoin [key" not in found and "BroadcastHashJoin [key" in found
    whole = rows()
    monkeypatch.setattr(rdfs, "FEW_CONCLUSIONS", 0)
    for many in (3, 10_000):
        monkeypatch.setattr(skew, "MANY", many)
        assert rows() == whole and len(whole) == 9 * 4 - 2


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_skewed_join(spark, monkeypatch, how):
    many = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    few = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "z"), (None, "n")], "k string, w string")
    rows = lambda: sorted(map(str, skew.skewed_join(many, few, ["k"], how).collect()))
    plain = rows()
    monkeypatch.setattr(skew, "MANY", 3)
    assert rows() == plain and len(plain) == 10


def test_calls_of_one_module_by_many_files(spark, monkeypatch):
    files = spark.createDataFrame([(f"p/f{k}.py", "from . import util\nfrom p.util import aid\ndef f():\n    util.aid(); aid()\n") for k in range(9)] + [("p/util.py", "def aid(): pass")], "path string, text string")
    rows = lambda: sorted(map(tuple, deep_scan.python_calls(files).collect()))
    plain = rows()
    monkeypatch.setattr(skew, "MANY", 3)
    assert rows() == plain == [(f"p/f{k}.py", "f", "p/util.py", "aid") for k in range(9)]


def test_files_are_parsed_once_and_by_many_tasks(spark):
    files = spark.createDataFrame([(f"f{k}.py", "def f(): pass") for k in range(9)], "path string, text string").coalesce(1)
    found = deep_scan.scan(files, most_files=None, most_symbols=None)
    assert found.size is None and found.symbol_count == 9  # counted when asked for, not by scan()
    assert "hashpartitioning(path" in plan(extract.python_symbols(files)) and "hashpartitioning(path" in plan(turtle.parsed(files, "g"))
