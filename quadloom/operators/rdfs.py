"""RDFS materialisation: closures of the schema, then one pass of rules over asserted triples.

What a predicate or a class lets conclude is a table of its own (the schema with its closures), and
a triple meets it by its predicate or, in case of rdf:type, by its class: one join for all rules.
Most triples may share one predicate, so none moves by it: that table is broadcast if it is small, and
else in what it holds of frequent keys, the rest being shuffled. In mode 'single' rules see asserted triples only, in 'fixpoint' they run until nothing is
new.

change() keeps what a graph infers up to date without inferring it anew: it deletes what removed
triples and removed conclusions once supported, derives again what the triples left about the same
terms still support, and adds what new triples and new conclusions bring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.plans.fixpoint import checkpointed, closure
from quadloom.plans.skew import skewed_join

SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, TYPE = (T.RDFS + "subClassOf", T.RDFS + "subPropertyOf", T.RDFS + "domain", T.RDFS + "range", T.RDF + "type")
TRIPLE = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]
#: The order in which rules claim what they derive.
RULES = ["rdfs11", "rdfs5", "rdfs9", "rdfs7", "rdfs2", "rdfs3"]

#: Conclusions, counted first, up to which all of them are broadcast.
FEW_CONCLUSIONS = 50_000
#: Predicates up to which a filter names those that matter, so that the columns of others are never read.
FEW_PREDICATES = 500


def meta(lex: Column) -> Column:
    """IRIs of the vocabularies themselves, of which nothing is inferred."""
    return lex.startswith(T.RDF) | lex.startswith(T.RDFS) | lex.startswith(T.OWL)


def infer(triples: DataFrame, mode: str = "single") -> DataFrame:
    """New triples, each with the rule that owns it (the first in RULES that derives it)."""
    asserted = triples.select(*TRIPLE)
    if mode == "single":
        return _once(asserted)
    known, found = checkpointed(asserted.distinct()), None
    while True:
        new = checkpointed(_once(known))
        if new.isEmpty():
            return found if found is not None else new
        found = new if found is None else checkpointed(found.unionByName(new))
        known = checkpointed(known.unionByName(new.select(*TRIPLE)))


def _conclusions(above_class: DataFrame, above_property: DataFrame, schema) -> DataFrame:
    """key ('p' and a predicate, or 'c' and a class), what of the triple gets the target, target, rank of the rule."""
    up = above_class.unionAll(above_class.select("_c", F.col("_c").alias("_super"))).distinct()

    def classes(p: str, what: str, own: int, above: int) -> DataFrame:
        """property -> the class that is stated and every class above it."""
        direct = schema(p).select(F.col("s").alias("_q"), F.col("o").alias("_own")).distinct()
        mine = direct.join(up, direct["_own"] == up["_c"], "left").select("_q", "_own", F.coalesce("_super", "_own").alias("_class"))
        mine = mine.unionAll(direct.select("_q", "_own", F.col("_own").alias("_class"))).distinct()
        return mine.select(F.concat(F.lit("p"), "_q").alias("key"), F.lit(what).alias("what"), F.col("_class").alias("target"), F.when(F.col("_own") == F.col("_class"), own).otherwise(above).alias("rank"))

    types = above_class.select(F.concat(F.lit("c"), "_c").alias("key"), F.lit("type of s").alias("what"), F.col("_super").alias("target"), F.lit(2).alias("rank"))
    properties = above_property.select(F.concat(F.lit("p"), "_q").alias("key"), F.lit("p").alias("what"), F.col("_super").alias("target"), F.lit(3).alias("rank"))
    return types.unionAll(properties).unionAll(classes(DOMAIN, "type of s", 4, 5)).unionAll(classes(RANGE, "type of o", 6, 7))


#: Rules by rank; classes above a domain or range count as rdfs9.
_BY_RANK = ["rdfs11", "rdfs5", "rdfs9", "rdfs7", "rdfs2", "rdfs9", "rdfs3", "rdfs9"]


def _schema(asserted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conclusions, pairs): what keys let conclude, and the closed pairs of the hierarchies as triples with their rank."""
    schema = lambda p: asserted.filter((F.col("p") == p) & (F.col("o_kind") < T.LITERAL))
    above_class = closure(schema(SUB_CLASS).select("s", "o")).select(F.col("s").alias("_c"), F.col("o").alias("_super"))
    above_property = closure(schema(SUB_PROPERTY).select("s", "o")).select(F.col("s").alias("_q"), F.col("o").alias("_super"))
    iri = F.lit(T.IRI).cast("tinyint")

    def pairs(rows: DataFrame, p: str, rank: int) -> DataFrame:
        a, b = rows.columns
        return rows.select(iri.alias("s_kind"), F.col(a).alias("s"), F.lit(p).alias("p"), iri.alias("o_kind"), F.col(b).alias("o"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"), F.lit(rank).alias("rank"))

    return _conclusions(above_class, above_property, schema), pairs(above_class, SUB_CLASS, 0).unionByName(pairs(above_property, SUB_PROPERTY, 1))


def _derived(asserted: DataFrame, conclusions: DataFrame) -> DataFrame:
    """What triples and conclusions give: triples with the rank of the rule, as often as they are derived."""
    iri = F.lit(T.IRI).cast("tinyint")
    of_class = (F.col("p") == TYPE) & (F.col("o_kind") < T.LITERAL)
    key = F.when(of_class, F.concat(F.lit("c"), "o")).when(~F.col("p").isin(SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, TYPE), F.concat(F.lit("p"), "p"))
    names = _named(conclusions.filter(F.col("key").startswith("p")).select(F.substr("key", F.lit(2)).alias("p")))
    keyed = (asserted.filter(F.col("p").isin(TYPE, *names)) if names is not None else asserted).withColumn("key", key)
    few = conclusions.limit(FEW_CONCLUSIONS + 1).count() <= FEW_CONCLUSIONS
    met = keyed.join(F.broadcast(conclusions), "key") if few else skewed_join(keyed, conclusions, ["key"])
    of_object = F.col("what") == "type of o"
    met = met.filter(F.when(of_object, (F.col("o_kind") < T.LITERAL) & ~meta(F.col("o"))).otherwise(~meta(F.col("s"))))
    typed = F.col("what") != "p"
    other = lambda a, b: F.when(typed, a).otherwise(b)
    return met.select(
        F.when(of_object, F.col("o_kind")).otherwise(F.col("s_kind")).alias("s_kind"), F.when(of_object, F.col("o")).otherwise(F.col("s")).alias("s"), other(F.lit(TYPE), F.col("target")).alias("p"),
        other(iri, F.col("o_kind")).alias("o_kind"), other(F.col("target"), F.col("o")).alias("o"), other(F.lit(""), F.col("o_dt")).alias("o_dt"), other(F.lit(""), F.col("o_lang")).alias("o_lang"), "rank",
    )


def _named(predicates: DataFrame) -> list[str] | None:
    """The predicates (column p), or None if there are more than FEW_PREDICATES."""
    found = [r.p for r in predicates.distinct().limit(FEW_PREDICATES + 1).collect()]
    return found if len(found) <= FEW_PREDICATES else None


def _once(asserted: DataFrame) -> DataFrame:
    conclusions, pairs = _schema(asserted)
    conclusions = checkpointed(conclusions)
    first = _derived(asserted, conclusions).unionByName(pairs).groupBy(*TRIPLE).agg(F.min("rank").alias("rank"))
    rule = F.element_at(F.array(*[F.lit(x) for x in _BY_RANK]), F.col("rank") + 1)
    names = _named(conclusions.filter("what = 'p'").select(F.col("target").alias("p")))
    held = asserted.filter(F.col("p").isin(TYPE, SUB_CLASS, SUB_PROPERTY, *names)) if names is not None else asserted
    return first.join(held, TRIPLE, "left_anti").select(*TRIPLE, rule.alias("rule"))


def change(store, graph: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> dict:
    """Add and remove asserted triples of a graph, and what follows from them (mode 'single'); returns counts.

    What is removed but still follows stays as inferred; what was inferred and is added is asserted.
    Triples of added that are held, and of removed that aren't, change nothing; one in both is added.
    Work is in proportion to the change, to the schema and to what is said of the terms that lose something.
    """
    g = store.graph_iri(graph)
    mine = store.quads.filter(F.col("g") == g)
    none = mine.select(*TRIPLE).limit(0)
    before = mine.filter(~F.col("inferred")).select(*TRIPLE)
    plus = (added.select(*TRIPLE).distinct() if added is not None else none).join(before, TRIPLE, "left_anti")
    minus = (removed.select(*TRIPLE).distinct() if removed is not None else none).join(before, TRIPLE, "left_semi")
    minus = minus.join(added.select(*TRIPLE), TRIPLE, "left_anti") if added is not None else minus
    plus, minus = checkpointed(plus), checkpointed(minus)
    after = before.join(minus, TRIPLE, "left_anti").unionByName(plus)

    vocabulary = F.col("p").isin(SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE)
    old, old_pairs = (checkpointed(x) for x in _schema(before.filter(vocabulary)))
    if plus.unionByName(minus).filter(vocabulary).isEmpty():
        new, new_pairs, gone, come = old, old_pairs, old.limit(0), old.limit(0)
    else:
        new, new_pairs = (checkpointed(x) for x in _schema(after.filter(vocabulary)))
        gone, come = old.join(new, old.columns, "left_anti"), new.join(old, old.columns, "left_anti")
    lost = _derived(minus, old).unionByName(_derived(before, gone)).unionByName(old_pairs.join(new_pairs, TRIPLE, "left_anti")).select(*TRIPLE).unionByName(minus).distinct()
    lost = checkpointed(lost)
    # A type or a property of x follows from triples with x as subject, or as object by a range.
    terms = lost.select("s").distinct()
    about = after.join(terms, "s", "left_semi").unionByName(after.filter(F.col("o_kind") < T.LITERAL).join(terms.withColumnRenamed("s", "o"), "o", "left_semi").select(*TRIPLE)).distinct()
    still = lost.join(_derived(about, new).unionByName(new_pairs).select(*TRIPLE), TRIPLE, "left_semi")
    won = _derived(plus, new).unionByName(_derived(after, come)).unionByName(new_pairs).select(*TRIPLE).unionByName(still)
    won = checkpointed(won.distinct().join(after, TRIPLE, "left_anti"))

    goes = lost.join(won, TRIPLE, "left_anti").join(after, TRIPLE, "left_anti").unionByName(minus).distinct()
    store.remove(goes.select(F.lit(g).alias("g"), *TRIPLE))
    store.insert(plus.withColumn("inferred", F.lit(False)).unionByName(won.withColumn("inferred", F.lit(True))).withColumn("g", F.lit(g)))
    return {"added": plus.count(), "removed": minus.count(), "inferredCount": store.quads.filter((F.col("g") == g) & F.col("inferred")).count()}


def materialize(store, graph: str, mode: str = "single") -> dict:
    """Inferred triples of a graph join it, marked as such; earlier ones are dropped first."""
    g = store.graph_iri(graph)
    clear(store, graph)
    asserted = store.quads.filter(F.col("g") == g)
    found = checkpointed(infer(asserted, mode))
    store.insert(found.select(F.lit(g).alias("g"), *TRIPLE, F.lit(True).alias("inferred")))
    rules = {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}
    return {"assertedCount": asserted.count(), "inferredCount": sum(rules.values()), "rules": rules}


def clear(store, graph: str) -> None:
    """Only what is asserted is left of the graph."""
    g = store.graph_iri(graph)
    store.remove(store.quads.filter((F.col("g") == g) & F.col("inferred")))
