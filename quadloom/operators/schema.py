"""What a graph looks like: classes, predicates, hierarchies, histograms, and drawings of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.sources import turtle

TYPE = T.RDF + "type"


def classes(quads: DataFrame) -> DataFrame:
    return quads.filter((F.col("p") == TYPE) & (F.col("o_kind") == T.IRI)).select(F.col("o").alias("class")).distinct()


def predicates(quads: DataFrame) -> DataFrame:
    return quads.select(F.col("p").alias("predicate")).distinct()


def overview(quads: DataFrame) -> dict:
    found = {"classes": sorted(r[0] for r in classes(quads).collect()), "predicates": sorted(r[0] for r in predicates(quads).collect())}
    return found | {"prefixes": turtle.namespaces(found["classes"] + found["predicates"]), "tripleCount": quads.count()}


def instances(quads: DataFrame, cls: str) -> DataFrame:
    return quads.filter((F.col("p") == TYPE) & (F.col("o") == cls)).select("s_kind", "s").distinct()


def predicate_histogram(quads: DataFrame, cls: str) -> DataFrame:
    """predicate, n over the triples of a class's instances."""
    return quads.join(instances(quads, cls), ["s_kind", "s"], "left_semi").groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n"))


def class_details(quads: DataFrame, cls: str, samples: int = 5) -> dict:
    rows = quads.join(instances(quads, cls), ["s_kind", "s"], "left_semi")
    histogram = predicate_histogram(quads, cls).orderBy(F.desc("n"), "predicate").collect()
    return {"instanceCount": instances(quads, cls).count(), "predicates": [(r.predicate, r.n) for r in histogram], "sampleTriples": [r.value for r in turtle.lines(rows).orderBy("value").limit(samples).collect()]}


def class_histogram(quads: DataFrame) -> DataFrame:
    return quads.filter((F.col("p") == TYPE) & (F.col("o_kind") == T.IRI)).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


def relations(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subclass pairs, properties with a domain or a range)."""
    sub = quads.filter((F.col("p") == T.RDFS + "subClassOf") & (F.col("o_kind") == T.IRI)).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    kinds = [T.RDF + "Property", T.OWL + "ObjectProperty", T.OWL + "DatatypeProperty"]
    properties = quads.filter((F.col("p") == TYPE) & F.col("o").isin(*kinds)).select(F.col("s").alias("property")).distinct()
    side = lambda p, name: quads.filter(F.col("p") == T.RDFS + p).select(F.col("s").alias("property"), F.col("o").alias(name)).distinct()
    return sub, properties.join(side("domain", "domain"), "property", "left").join(side("range", "range"), "property", "left").filter("domain is not null or range is not null")


def status(quads: DataFrame) -> DataFrame:
    """graph, asserted, inferred, total."""
    return quads.groupBy(F.col("g").alias("graph")).agg(F.count_if(~F.col("inferred")).alias("asserted"), F.count_if("inferred").alias("inferred"), F.count("*").alias("total"))


def neighbourhood(quads: DataFrame, node: str) -> DataFrame:
    """Nodes one edge away in either direction, and the node."""
    out = quads.filter((F.col("s") == node) & (F.col("o_kind") < T.LITERAL)).select(F.col("o").alias("id"))
    return out.unionAll(quads.filter((F.col("o") == node) & (F.col("o_kind") < T.LITERAL)).select(F.col("s").alias("id"))).unionAll(quads.sparkSession.range(1).select(F.lit(node).alias("id"))).distinct()


def graph_data(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, kind, class; edges: source, target, label). Literals are nodes of their own."""
    literal = F.col("o_kind") == T.LITERAL
    target = F.when(literal, F.concat_ws("|", "s", "p", "o")).otherwise(F.col("o"))
    edges = quads.filter(F.col("p") != TYPE).select(F.col("s").alias("source"), target.alias("target"), T.shorten(F.col("p")).alias("label"))
    kinds = [T.RDFS + "Class", T.OWL + "Class"]
    typed = quads.filter(F.col("p") == TYPE).groupBy("s").agg(F.min("o").alias("class"))
    plain = quads.select(F.col("s").alias("id")).unionAll(quads.filter((F.col("p") != TYPE) & ~literal).select(F.col("o").alias("id"))).distinct()
    what = F.when(F.col("class").isin(*kinds), "Class").when(F.col("class").isin(T.RDF + "Property", T.OWL + "ObjectProperty", T.OWL + "DatatypeProperty"), "Property").otherwise("Instance")
    nodes = plain.join(typed.withColumnRenamed("s", "id"), "id", "left").select("id", T.shorten(F.col("id")).alias("label"), what.alias("kind"), "class")
    values = quads.filter(literal).select(target.alias("id"), F.when(F.length("o") > 40, F.concat(F.substring("o", 1, 40), F.lit("..."))).otherwise(F.col("o")).alias("label"), F.lit("Literal").alias("kind"), F.lit(None).cast("string").alias("class")).distinct()
    return nodes.unionByName(values), edges


def visible(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, chosen: list[str] | None = None, focus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass all filters, and the edges of which both ends do."""
    if kinds:
        nodes = nodes.filter(F.col("kind").isin(*kinds))
    if chosen:
        nodes = nodes.filter(F.col("class").isin(*chosen))
    if focus:
        near = edges.filter(F.col("source") == focus).select(F.col("target").alias("id")).unionAll(edges.filter(F.col("target") == focus).select(F.col("source").alias("id"))).unionAll(edges.sparkSession.range(1).select(F.lit(focus).alias("id")))
        nodes = nodes.join(near.distinct(), "id", "left_semi")
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def search_nodes(nodes: DataFrame, text: str, most: int = 20) -> DataFrame:
    """Nodes whose label or id contains the text, of two characters at least; a top-k report."""
    if len(text) < 2:
        return nodes.limit(0)
    key = text.lower()
    return nodes.filter(F.lower("label").contains(key) | F.lower("id").contains(key)).orderBy("id").limit(most)


def schema_graph(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind class, property or bnode, edges: source, target, label) of classes and properties."""
    sub, properties = relations(quads)
    edges = sub.select(F.col("child").alias("source"), F.col("parent").alias("target"), F.lit("subClassOf").alias("label"))
    for side in ("domain", "range"):
        edges = edges.unionByName(properties.filter(f"{side} is not null").select(F.col("property").alias("source"), F.col(side).alias("target"), F.lit(side).alias("label")))
    named = classes(quads).withColumnRenamed("class", "id").unionAll(sub.select("child")).unionAll(sub.select("parent"))
    named = named.unionAll(properties.filter("domain is not null").select("domain")).unionAll(properties.filter("range is not null").select("range")).distinct()
    blank = quads.filter(F.col("o_kind") == T.BNODE).select(F.col("o").alias("id")).unionAll(quads.filter(F.col("s_kind") == T.BNODE).select(F.col("s").alias("id"))).distinct().withColumn("blank", F.lit(True))
    kinds = named.join(blank, "id", "left").select("id", F.when(F.col("blank"), "bnode").otherwise("class").alias("kind"))
    return kinds.unionByName(properties.select(F.col("property").alias("id")).distinct().join(named, "id", "left_anti").withColumn("kind", F.lit("property"))), edges.distinct()


#: How a node of a kind is drawn: in Mermaid, in DOT.
SHAPES = {"class": ('["{}"]', "box"), "property": ('(["{}"])', "ellipse"), "bnode": ('{{"{}"}}', "diamond")}


def drawing(nodes: DataFrame, edges: DataFrame, form: str = "mermaid", most: int | None = None, prefixes: dict[str, str] | None = None) -> str:
    """Mermaid or DOT text of a drawing-sized part of a graph, cut at 150 or 500 nodes with a note."""
    most = most or {"mermaid": 150, "dot": 500}[form]
    comment = {"mermaid": "%%", "dot": "//"}[form]
    rows = nodes.withColumn("label", T.shorten(F.col("id"), prefixes)).orderBy("id").limit(most + 1).collect()
    out = ["graph TD"] if form == "mermaid" else ["digraph G {", "  rankdir=TB;"]
    end = [] if form == "mermaid" else ["}"]
    if not rows:
        return "\n".join([out[0], f"  {comment} Empty graph", *end])
    if len(rows) > most:
        out.append(f"  {comment} WARNING: Truncated to {most} of {nodes.count()} nodes")
    index = {r.id: re.sub(r"[^a-zA-Z0-9_]", "_", r.id) for r in rows[:most]}
    quoted = lambda x: x.replace('"', "#quot;") if form == "mermaid" else x.replace('"', '\\"')
    for r in rows[:most]:
        box, shape = SHAPES.get(r.kind, SHAPES["class"])
        label = quoted("[]" if r.kind == "bnode" else r.label)
        out.append(f"  {index[r.id]}{box.format(label)}" if form == "mermaid" else f'  {index[r.id]} [label="{label}" shape={shape}];')
    shown = edges.filter(F.col("source").isin(*index) & F.col("target").isin(*index)).distinct().orderBy("source", "target", "label").collect()
    for e in shown:
        a, b, label = index[e.source], index[e.target], quoted(e.label)
        out.append(f'  {a} -->|"{label}"| {b}' if form == "mermaid" else f'  {a} -> {b} [label="{label}"];')
    return "\n".join(out + end)
