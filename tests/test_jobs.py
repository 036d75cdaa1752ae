"""The jobs on copies of small tables: growing input, repeated runs, odd rows, the command line."""

import json

import pytest

from jobs import checked_graph, common, page_graph
from quadloom.functions import terms as T
from quadloom.sources.mapping import BASE

PAGES = "page_id long, url string, html string"
WEB = page_graph.DEFAULTS["vocabulary"]
FIRST = [
    (1, "http://a.org/x?q=1#top", '<html><title lang="en">One</title><a href="/y">y</a><a href="/y">y</a><a href="//b.org/z#f">z</a><a href="#here">h</a><a href="mailto:m">m</a>'),
    (2, "https://b.org", None),
    (3, None, '<a href="/never">'),
    (4, "ftp://c.org/x", '<a href="/never">'),
    (1, "http://a.org/x?q=1#top", '<html><title lang="en">One</title><a href="/y">y</a>'),
]
SECOND = [(1, "http://a.org/x?q=1", '<title>One</title><a href="/new">n</a><a href="/y">y</a>'), (5, "https://b.org/deep", "<title></title><p>no links</p>")]


def expected(rows):
    """Triples by the module's words, one page at a time."""
    import re

    out = set()
    for _, url, html in rows:
        found = re.match(r"(https?:)//([^/?#]+)", url or "")
        if not found:
            continue
        s, g = url.split("#")[0], f"urn:host:{found[2]}"
        out.add((g, s, T.RDF + "type", WEB + "Page"))
        title = re.search(r"<title[^>]*>([^<]*)", html or "")
        if title and title[1]:
            out.add((g, s, WEB + "title", title[1]))
        for href in re.findall('href="([^"]*)"', html or ""):
            href = href.split("#")[0]
            if re.match("https?://", href):
                out.add((g, s, WEB + "linksTo", href))
            elif href.startswith("//"):
                out.add((g, s, WEB + "linksTo", found[1] + href))
            elif href.startswith("/"):
                out.add((g, s, WEB + "linksTo", f"{found[1]}//{found[2]}{href}"))
    return out


def quads(spark, config):
    rows = spark.read.parquet(f"{config['output']}/quads").select("g", "s", "p", "o").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_pages_come_in_parts(spark, tmp_path):
    config = {"source": f"{tmp_path}/pages", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/ckpt", "buckets": 4}
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.createDataFrame(FIRST, PAGES).write.parquet(config["source"])
    assert page_graph.run(spark, config) == 1
    assert quads(spark, config) == expected(FIRST)
    assert page_graph.run(spark, config) == 0 and quads(spark, config) == expected(FIRST)
    spark.createDataFrame(SECOND, PAGES).write.mode("append").parquet(config["source"])
    assert page_graph.run(spark, config) == 1
    assert quads(spark, config) == expected(FIRST + SECOND)
    told = {r.batch: (r.pages, r.quads, r.hosts) for r in spark.read.parquet(f"{config['output']}/batches").collect()}
    assert told == {0: (5, len(expected(FIRST)), 2), 1: (2, len(expected(FIRST + SECOND)) - len(expected(FIRST)), 2)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_a_batch_that_is_tried_again_leaves_the_same(spark, tmp_path):
    """Of the second batch, only the mark that it ended is lost, as if the driver had died just before."""
    config = {"source": f"{tmp_path}/pages", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/ckpt"}
    for part in (FIRST, SECOND):
        spark.createDataFrame(part, PAGES).write.mode("append").parquet(config["source"])
        page_graph.run(spark, config)
    for name in ("1", ".1.crc"):
        (tmp_path / "ckpt" / "commits" / name).unlink()
    assert page_graph.run(spark, config) == 1
    assert quads(spark, config) == expected(FIRST + SECOND)


def test_pages_of_an_empty_table(spark, tmp_path):
    config = {"source": f"{tmp_path}/pages", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/ckpt"}
    spark.createDataFrame([], PAGES).write.parquet(config["source"])
    page_graph.run(spark, config)
    spark.createDataFrame(FIRST, PAGES).write.mode("append").parquet(config["source"])
    page_graph.run(spark, config)
    assert quads(spark, config) == expected(FIRST)


def tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def test_checked_graphs(spark, tmp_path):
    docs = [(1, "good", "en", "web", 4), (2, "poor", "en", "web", 4), (3, "bad words", "en", "web", 9), (4, "unlabelled", None, "book", 10), (5, "lost", "de", None, 4)]
    tables(spark, tmp_path / "in", docs, [(1, 1, 0), (2, 0, 0), (3, 0, 1)])
    config = {"input": f"{tmp_path}/in", "output": f"{tmp_path}/out", "graphs": {"docs": ["documents", "labels"]}}
    counts = checked_graph.run(spark, config)
    read = lambda: sorted(map(tuple, spark.read.parquet(config["output"]).select(*checked_graph.COLUMNS).collect()), key=repr)
    rows = read()
    of = lambda state: {(r[2].rpartition(":")[2], r[3].replace(BASE, ""), r[5].replace(BASE, "")) for r in rows if r[1] == state}
    assert {s for s, _, _ in of("accepted")} == {"1", "4"} and {s for s, _, _ in of("rejected")} == {"2", "3", "5"}
    assert of("violation") == {("2", "quality", "poor"), ("3", "quality", "poor"), ("3", "toxic", "toxic"), ("5", "source", "no source")}
    assert {x for x in of("inferred") if x[0] in ("1", "4")} == {("1", T.RDF + "type", "Text"), ("1", T.RDF + "type", "Thing"), ("1", T.RDF + "type", "Judged"), ("1", "origin", "web"), ("4", T.RDF + "type", "Text"), ("4", T.RDF + "type", "Thing"), ("4", "origin", "book")}
    assert counts["urn:graph:docs"]["violation"] == 4 and counts["urn:graph:docs"]["graph"] == 1
    checked_graph.run(spark, config)
    assert read() == rows
    # Another graph leaves this one alone; a graph whose tables are empty now keeps its one row.
    other = config | {"input": f"{tmp_path}/other", "graphs": {"more": ["documents", "labels"]}}
    tables(spark, tmp_path / "other", docs[:1], [])
    checked_graph.run(spark, other)
    assert [r for r in read() if r[0] == "urn:graph:docs"] == rows
    tables(spark, tmp_path / "other", [], [])
    checked_graph.run(spark, other)
    assert {r[1] for r in read() if r[0] == "urn:graph:more"} == {"graph", "inferred"}
    assert [r for r in read() if r[0] == "urn:graph:docs"] == rows


def test_command_line(tmp_path, monkeypatch):
    seen = {}

    class Session:
        def stop(self):
            seen["stopped"] = True

    class Builder:
        appName = config = lambda self, *a: self
        getOrCreate = lambda self: Session()

    monkeypatch.setattr(common, "SparkSession", type("S", (), {"builder": Builder()}))
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"source": "a", "output": "b", "checkpoint": "c"}))
    common.main(lambda spark, config: seen.update(config), "page_graph", page_graph.DEFAULTS, [str(path), "--set", "buckets=8", "--set", "output=d"])
    assert seen["buckets"] == 8 and seen["output"] == "d" and seen["source"] == "a" and seen["stopped"]
    path.write_text(json.dumps({"sauce": "a"}))
    with pytest.raises(SystemExit):
        common.main(lambda spark, config: None, "page_graph", page_graph.DEFAULTS, [str(path)])


def test_settings_are_put_back(spark):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), common.settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        assert spark.conf.get(key) == "dynamic"
        raise KeyError
    assert spark.conf.get(key) == before
