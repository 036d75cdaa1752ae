"""A quad store over DataFrames: load, query, update, compare, export, snapshots and a catalog.

Quads live in a DataFrame partitioned by graph (Parquet when saved). A graph is a set: every write
keeps (g, s, p, o) distinct; reads never deduplicate. A write works on the graphs it touches and no
others: the store is a union of pieces, each with the graphs it holds, put together again when
there are PIECES of them. Saving where the store was saved or opened writes the graphs that changed
since, each as a partition that Spark puts in place when all of its files are written.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.plans.compiler import QUADS, Compiler, Graphs, Solutions
from quadloom.plans.fixpoint import checkpointed
from quadloom.plans.parser import SparqlError, has_graph_scope, parse_query, parse_update
from quadloom.sources import turtle

KEY = ["g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]
TRIPLE = KEY[1:]
PIECES = 16
#: A write that touches more graphs than this works on the whole store.
MOST_NAMED = 1000
#: A write of up to so many rows meets the rows held by a broadcast, so that these don't move.
FEW_ROWS = 10_000


def slug(graph: str) -> str:
    return re.sub("_+", "_", re.sub("[^A-Za-z0-9-]", "_", graph))


def slugs(graph: Column) -> Column:
    """slug() of a column."""
    return F.regexp_replace(F.regexp_replace(graph, "[^A-Za-z0-9-]", "_"), "_+", "_")


@dataclass
class QuadStore:
    spark: SparkSession
    quads: DataFrame | None = None
    catalog: dict[str, str] = field(default_factory=dict)  # name -> graph IRI
    prefixes: dict[str, str] = field(default_factory=dict)
    loaded: set = field(default_factory=set)  # (graph, file) already read
    history: str | None = None  # where a graph's version goes before it is replaced or dropped
    pieces: int = 1
    home: str | None = None  # where the store was saved or opened
    changed: set[str] | None = field(default_factory=set)  # graphs since then; None if all may have

    def __post_init__(self):
        if self.quads is None:
            self.quads = self.spark.createDataFrame([], QUADS)

    @classmethod
    def opened(cls, spark: SparkSession, path: str, **fields) -> QuadStore:
        """The store that was saved under a path."""
        return cls(spark, spark.read.schema(QUADS).parquet(path), home=path, **fields)

    # --- reading
    def _compiler(self, graph: str | None) -> Compiler:
        return Compiler(self.quads, Graphs(one=graph) if graph is not None else Graphs())

    def graph_iri(self, name: str) -> str:
        return self.catalog.get(name, name)

    def query(self, text: str, graph: str | None = None, raw: bool = False) -> Solutions:
        """SELECT. A query that names no graph itself is scoped to `graph`, unless raw."""
        q = parse_query(text, self.prefixes)
        return self._compiler(self._scope(q, graph, raw)).select(q)

    def ask(self, text: str, graph: str | None = None, raw: bool = False) -> bool:
        q = parse_query(text, self.prefixes)
        return self._compiler(self._scope(q, graph, raw)).ask(q)

    def construct(self, text: str, graph: str | None = None, raw: bool = False) -> DataFrame:
        q = parse_query(text, self.prefixes)
        c = self._compiler(self._scope(q, graph, raw))
        return c.describe(q) if q.form == "DESCRIBE" else c.construct(q)

    def _scope(self, q, graph: str | None, raw: bool) -> str | None:
        return None if raw or graph is None or has_graph_scope(q) else self.graph_iri(graph)

    def graph(self, graph: str) -> DataFrame:
        return self.quads.filter(F.col("g") == self.graph_iri(graph))

    def count(self, graph: str) -> int:
        return self.graph(graph).count()

    def export(self, graph: str) -> str:
        """A graph's triples as text; for graphs that fit the driver. See export_to."""
        return "\n".join(r.value for r in turtle.lines(self.graph(graph)).orderBy("value").collect())

    def export_to(self, graph: str, path: str) -> None:
        turtle.lines(self.graph(graph)).write.mode("overwrite").text(path)

    # --- writing
    def _touched(self, rows: DataFrame) -> list[str] | None:
        """The graphs of rows; None if there are more than MOST_NAMED of them, so that a filter can't name them."""
        found = [r.g for r in rows.select("g").distinct().limit(MOST_NAMED + 1).collect()]
        return found if len(found) <= MOST_NAMED else None

    def _of(self, graphs: list[str] | None) -> DataFrame:
        return self.quads if graphs is None else self.quads.filter(F.col("g").isin(*graphs))

    def _replace(self, graphs: list[str] | None, rows: DataFrame) -> None:
        """These graphs (None: all) anew, from rows that are distinct and materialised; the others stay as they lie."""
        if graphs is None:
            self.quads, self.pieces, self.changed = rows, 1, None
            return
        if graphs:
            self._add(self.quads.filter(~F.col("g").isin(*graphs)), graphs, rows)

    def _add(self, kept: DataFrame, graphs: list[str] | None, rows: DataFrame) -> None:
        self.quads, self.pieces = kept.unionByName(rows), self.pieces + 1
        self.changed = None if self.changed is None or graphs is None else self.changed | set(graphs)
        if self.pieces > PIECES:
            self.quads, self.pieces = checkpointed(self.quads), 1

    def insert(self, quads: DataFrame) -> None:
        """Adds what isn't held; what was only inferred and is asserted now counts as asserted."""
        new = checkpointed(quads.groupBy(*KEY).agg(F.min("inferred").alias("inferred")))
        graphs = self._touched(new)
        held = self._held(graphs, new).select(*KEY, F.col("inferred").alias("was"))
        new = checkpointed(new.join(held, KEY, "left").filter("was is null or was and not inferred"))
        told = new.filter("was").select(*KEY)
        if told.isEmpty():
            self._add(self.quads, graphs, new.drop("was"))
        else:
            self._replace(graphs, checkpointed(self._of(graphs).join(told, KEY, "left_anti").unionByName(new.drop("was"))))

    def _held(self, graphs: list[str] | None, new: DataFrame) -> DataFrame:
        """Rows held that new may be among: of few rows, those of their predicates that are among them."""
        held = self._of(graphs)
        if new.limit(FEW_ROWS + 1).count() > FEW_ROWS:
            return held
        predicates = [r.p for r in new.select("p").distinct().limit(MOST_NAMED + 1).collect()]
        held = held.filter(F.col("p").isin(*predicates)) if len(predicates) <= MOST_NAMED else held
        return held.join(F.broadcast(new.select(*KEY)), KEY, "left_semi")

    def _keep_version(self, graph: str) -> None:
        if self.history:
            self.snapshot(self.history, graph)

    def insert_turtle(self, text: str, graph: str) -> None:
        if text.strip():
            self.insert(turtle.quads(self.spark, text, self.graph_iri(graph)))

    def remove(self, quads: DataFrame) -> None:
        gone = checkpointed(quads.select(*KEY).distinct())
        graphs = self._touched(gone)
        self._replace(graphs, checkpointed(self._of(graphs).join(gone, KEY, "left_anti")))

    def _drop(self, graphs: list[str]) -> None:
        """Without the rows of these graphs: a filter, no rows move."""
        self.quads, self.pieces = self.quads.filter(~F.col("g").isin(*graphs)), self.pieces + 1
        self.changed = None if self.changed is None else self.changed | set(graphs)
        if self.pieces > PIECES:
            self.quads, self.pieces = checkpointed(self.quads), 1

    def drop_graph(self, graph: str, confirm: bool = True) -> None:
        """confirm: for callers that pass a user's word on; without it nothing is dropped."""
        if not confirm:
            raise ValueError("dropping a graph has to be confirmed")
        self._keep_version(graph)
        self._drop([self.graph_iri(graph)])

    def replace_graph(self, graph: str, text: str) -> None:
        new = turtle.quads(self.spark, text, self.graph_iri(graph))
        self._keep_version(graph)
        self._replace([self.graph_iri(graph)], checkpointed(new.groupBy(*KEY).agg(F.min("inferred").alias("inferred"))))

    def delete(self, graph: str, turtle_text: str | None = None, where: str | None = None) -> None:
        """Exact triples, or those a pattern matches; the graph's version before is kept. One of the two is needed."""
        if turtle_text is None and where is None:
            raise ValueError("either triples or a pattern is needed")
        g = self.graph_iri(graph)
        self._keep_version(graph)
        if turtle_text is not None:
            self.remove(turtle.quads(self.spark, turtle_text, g))
        if where is not None:
            self.update(f"WITH <{g}> DELETE {{ ?s ?p ?o }} WHERE {{ ?s ?p ?o . {where} }}")

    def push(self, text: str, graph: str, replace: bool = False, limit: int | None = None, shapes: str | None = None, infer: bool = True) -> dict:
        """Validate, check size (off unless a limit is given) and shapes, insert or replace, then infer; returns counts."""
        checked = turtle.validate(text)
        if not checked["valid"]:
            raise ValueError(checked["error"])
        if limit is not None and checked["tripleCount"] > limit:
            raise ValueError(f"{checked['tripleCount']} triples are over the limit of {limit}")
        if shapes:
            from quadloom.operators import shacl

            found = shacl.validate(turtle.quads(self.spark, text, ""), shapes).collect()
            if found:
                raise ValueError("; ".join(r.message for r in found))
        (self.replace_graph if replace else lambda g, t: self.insert_turtle(t, g))(graph, text)
        inferred = 0
        if infer:
            from quadloom.operators import rdfs

            inferred = rdfs.materialize(self, graph)["inferredCount"]
        return {"tripleCount": checked["tripleCount"], "inferredCount": inferred}

    # --- updates
    def update(self, text: str, graph: str | None = None) -> None:
        """SPARQL Update; each operation sees what those before it did."""
        for op in parse_update(text, self.prefixes):
            self._apply(op, self.graph_iri(graph) if graph else None)

    def _ground(self, quads: list[tuple], graph: str) -> DataFrame:
        found = Solutions(self.spark.range(1).select(), [], set())
        for x in (x for q in quads for x in q[1:] if x and x[0] in ("var", "pvar") and not x[1].startswith("_:")):
            raise SparqlError(f"?{x[1]} in ground data")
        return Compiler(self.quads).instantiate(found, quads, graph)

    def _apply(self, op: tuple, graph: str | None) -> None:
        kind = op[0]
        if kind == "insert_data":
            self.insert(self._ground(op[1], graph or ""))
        elif kind == "delete_data":
            self.remove(self._ground(op[1], graph or ""))
        elif kind == "modify":
            _, own, removed, added, pattern, using = op
            own = own if own is not None else graph
            graphs = Graphs(default=tuple(using[0]), named=tuple(using[1])) if any(using) else Graphs(one=own) if own is not None and not has_graph_scope(pattern) else Graphs()
            c = Compiler(self.quads, graphs)
            found = c.pattern(pattern, graphs)
            found = Solutions(checkpointed(found.df), found.vars, found.bound)
            fix = lambda rows: [(g, s, ("var", p[1]) if p[0] == "pvar" else p, o) for g, s, p, o in rows]
            come = checkpointed(c.instantiate(found, fix(added), own or "")) if added else None
            if removed:
                self.remove(c.instantiate(found, fix(removed), own or ""))
            if come is not None:
                self.insert(come)
        elif kind == "create":
            # A graph is its quads, so an empty one leaves no trace; only a graph that is there can be told from others.
            _, silent, (_, iri) = op
            if not silent and not self.quads.filter(F.col("g") == iri).isEmpty():
                raise SparqlError(f"graph {iri} exists")
        elif kind in ("drop", "clear"):
            _, silent, (what, iri) = op
            if what == "GRAPH" and not silent and self.quads.filter(F.col("g") == iri).isEmpty():
                raise SparqlError(f"no graph {iri}")
            if what in ("GRAPH", "DEFAULT"):
                self._drop([iri if what == "GRAPH" else ""])
            else:
                self._replace(None, checkpointed(self.quads.filter(F.col("g") == "") if what == "NAMED" else self.quads.limit(0)))
        elif kind == "load":
            _, silent, source, into = op
            try:
                self.insert(turtle.read(self.spark, source, into or graph or ""))
            except (AnalysisException, PythonException, turtle.TurtleError):  # what isn't there or can't be read
                if not silent:
                    raise
        elif kind == "transfer":
            _, word, _, source, target = op
            a, b = source[1] or "", target[1] or ""
            if a == b:
                return
            moved = checkpointed(self.quads.filter(F.col("g") == a).withColumn("g", F.lit(b)))
            if word == "ADD":
                self.insert(moved)
            else:
                self._replace([b], moved)
            if word == "MOVE":
                self._drop([a])

    # --- comparing
    def diff_frames(self, graph: str, text: str) -> DataFrame:
        """Triples of the graph and of a document, each with side: 'added', 'removed' or 'unchanged'. One shuffle."""
        return diff(self.graph(graph), turtle.quads(self.spark, text, ""))

    def diff(self, graph: str, text: str, limit: int = 50) -> dict:
        found = checkpointed(self.diff_frames(graph, text))
        counts = {r.side: r["count"] for r in found.groupBy("side").count().collect()}
        listed = {side: [r.value for r in turtle.lines(found.filter(F.col("side") == side)).orderBy("value").limit(limit).collect()] for side in ("added", "removed")}
        added, removed = counts.get("added", 0), counts.get("removed", 0)
        return listed | {"unchanged": counts.get("unchanged", 0), "addedCount": added, "removedCount": removed, "truncated": added > limit or removed > limit}

    # --- catalog
    def graph_create(self, name: str, base: str) -> str:
        if name in self.catalog:
            raise ValueError(f"graph {name} exists")
        self.catalog[name] = f"{base.rstrip('/')}/{name}"
        return self.catalog[name]

    def graph_drop(self, name: str, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("dropping a graph has to be confirmed")
        self.drop_graph(name)
        self.catalog.pop(name, None)

    def graph_list(self, prefix: str = "") -> DataFrame:
        """name ('?' if unregistered), graph, triples (null if registered but absent)."""
        known = self.spark.createDataFrame(list(self.catalog.items()), "name string, g string")
        counted = self.quads.filter(F.col("g").startswith(prefix) & (F.col("g") != "")).groupBy("g").agg(F.count("*").alias("triples"))
        return known.join(counted, "g", "full").select(F.coalesce("name", F.lit("?")).alias("name"), F.col("g").alias("graph"), "triples")

    def load_new(self, files: list[tuple[str, str]], infer: bool = False) -> int:
        """Reads (graph, path) pairs not read before in one write; missing files are passed over. Returns how many were read."""
        path = lambda x: self._path(x)
        fresh = [x for x in dict.fromkeys(files) if x not in self.loaded and self._fs(x[1])[0].exists(path(x[1]))]
        every = None
        for graph, name in fresh:
            rows = turtle.read(self.spark, name, self.graph_iri(graph))
            every = rows if every is None else every.unionByName(rows)
        if every is not None:
            self.insert(every)
            self.loaded.update(fresh)
        if infer:
            from quadloom.operators import rdfs

            for graph in dict.fromkeys(g for g, _ in fresh):
                rdfs.materialize(self, graph)
        return len(fresh)

    # --- saving
    def save(self, path: str) -> None:
        """Parquet by graph; graphs that are empty leave nothing behind.

        Where the store was saved or opened before, only graphs that changed since are written. Spark
        writes them aside and puts each in place when all are done, so a failure leaves the others as
        they were, and saving again mends it.
        """
        if self.home != path or self.changed is None:
            rows = checkpointed(self.quads) if self.home == path else self.quads  # not to be read while it is written
            rows.write.mode("overwrite").partitionBy("g").parquet(path)
        elif self.changed:
            rows = checkpointed(self.quads.filter(F.col("g").isin(*self.changed)))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g").parquet(path)
            left = set(self.changed) - {r.g for r in rows.select("g").distinct().collect()}
            fs, _ = self._fs(path)
            for status in fs.globStatus(self._path(f"{path}/g=*")) or []:
                name = unquote(status.getPath().getName().removeprefix("g="))
                if ("" if name == "__HIVE_DEFAULT_PARTITION__" else name) in left:
                    fs.delete(status.getPath(), True)
        self.home, self.changed = path, set()

    def snapshot(self, root: str, graph: str, kind: str = "regular", keep: int = 5) -> str | None:
        """A version of one graph; None if it is empty. Old versions beyond `keep` go."""
        rows = self.graph(graph)
        if rows.isEmpty():
            return None
        stamp = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H-%M-%S-%fZ")
        rows.write.parquet(f"{root}/{slug(self.graph_iri(graph))}/kind={kind}/snap={stamp}")
        self.prune(root, graph, keep)
        return stamp

    def snapshots(self, root: str, graph: str) -> list[dict]:
        """Newest first."""
        fs, base = self._fs(f"{root}/{slug(self.graph_iri(graph))}")
        found = []
        for status in fs.globStatus(self._path(f"{base}/kind=*/snap=*")) or []:
            path = status.getPath().toString()
            found.append({"timestamp": path.rpartition("snap=")[2], "path": path, "isPreRollback": "kind=pre-rollback" in path, "sizeBytes": fs.getContentSummary(status.getPath()).getLength()})
        return sorted(found, key=lambda r: r["timestamp"], reverse=True)

    def prune(self, root: str, graph: str, keep: int = 5, keep_pre: int = 2) -> list[str]:
        fs, _ = self._fs(root)
        gone = []
        for pre, most in ((False, keep), (True, keep_pre)):
            for r in [x for x in self.snapshots(root, graph) if x["isPreRollback"] == pre][most:]:
                fs.delete(self._path(r["path"]), True)
                gone.append(r["timestamp"])
        return gone

    def restore(self, root: str, graph: str, stamp: str) -> None:
        found = next((r for r in self.snapshots(root, graph) if r["timestamp"] == stamp), None)
        if not found:
            raise ValueError(f"no snapshot {stamp}")
        self.snapshot(root, graph, "pre-rollback")
        rows = checkpointed(self.spark.read.schema(QUADS).parquet(found["path"]))
        self._replace([self.graph_iri(graph)], rows)

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self, text: str):
        path = self._path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), text


def diff(stored: DataFrame, local: DataFrame) -> DataFrame:
    """One grouping of both sides: a triple with its side. Repeated triples count once."""
    both = stored.select(*TRIPLE, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(local.select(*TRIPLE, F.lit(0).alias("a"), F.lit(1).alias("b")))
    merged = both.groupBy(*TRIPLE).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return merged.select(*TRIPLE, F.when((F.col("a") == 1) & (F.col("b") == 1), "unchanged").when(F.col("b") == 1, "added").otherwise("removed").alias("side"))


def results_json(found: Solutions) -> str:
    """Bindings in the SPARQL results form; unbound variables are left out, languages are kept."""
    kinds = {T.IRI: "uri", T.BNODE: "bnode", T.LITERAL: "literal"}
    rows = []
    for r in found.df.collect():
        row = {}
        for v in found.vars:
            t = r[v]
            if t is not None:
                row[v] = {"type": kinds[t.kind], "value": t.lex} | ({"xml:lang": t.lang} if t.lang else {"datatype": t.dt} if t.dt and t.dt != T.XSD_STRING else {})
        rows.append(row)
    return json.dumps({"head": {"vars": found.vars}, "results": {"bindings": rows}})


def results_csv(found: Solutions, path: str) -> None:
    found.df.select(*[F.coalesce(F.col(f"`{v}`.lex"), F.lit("")).alias(v) for v in found.vars]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
