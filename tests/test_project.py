"""Settings, shapes of a folder, and the check of a project."""

import json

import pytest

from quadloom.operators import project
from quadloom.operators.store import QuadStore
from quadloom.sources import turtle

SHAPE = "@prefix sh: <http://www.w3.org/ns/shacl#> . _:s a sh:NodeShape ; sh:targetClass <urn:C> ; sh:property [ sh:path <urn:{}> ; sh:minCount 1 ] ."


def test_slugs():
    assert [project.slugify(x) for x in ("My Project!", "--A  b--", "é", "a1_b2")] == ["my-project", "a-b", "", "a1-b2"]


def test_doctor(spark, tmp_path):
    path = tmp_path / "settings.json"
    assert [x[:2] for x in project.doctor(spark, str(path))] == [("settings", "fail")]
    path.write_text("{")
    assert [x[:2] for x in project.doctor(spark, str(path))] == [("settings", "fail")]
    path.write_text(json.dumps({"project": "p", "graph": "urn:g", "store": str(tmp_path / "store"), "graphs": {"context": "urn:g/context", "sessions": "urn:g/sessions"}, "shapes": str(tmp_path / "shapes")}))
    assert [x[:2] for x in project.doctor(spark, str(path))] == [("settings", "ok"), ("store", "fail")]
    store = QuadStore(spark)
    store.insert_turtle("<urn:a> a <urn:C> ; <urn:p> 1 . <urn:b> a <urn:C> ; <urn:p> 2 ; <urn:q> 3 .", "urn:g")
    store.save(str(tmp_path / "store"))
    assert project.doctor(spark, str(path))[1:] == [("store", "ok", "5 triples in urn:g"), ("graphs", "ok", "context, sessions"), ("shapes", "warn", "no shapes found")]
    (tmp_path / "shapes").mkdir()
    (tmp_path / "shapes" / "a.ttl").write_text(SHAPE.format("p"))
    assert project.doctor(spark, str(path))[-1] == ("shapes", "ok", "1 files, all conforms")
    (tmp_path / "shapes" / "b.ttl").write_text(SHAPE.format("q"))  # its blank node has the name of the other's
    (tmp_path / "shapes" / "notes.txt").write_text("no shape")
    assert project.doctor(spark, str(path))[-1] == ("shapes", "fail", "1 violations")
    with pytest.raises(ValueError):
        project.Settings.load(spark, str(tmp_path / "nowhere.json"))


def test_without_shapes_all_conforms(spark):
    report = project.checked(turtle.quads(spark, "<urn:a> <urn:p> 1 .", ""), [])
    assert report.conforms and report.note == "no shapes found"
