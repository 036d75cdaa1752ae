"""Queries of the project-knowledge application over a store, and its parameterised predicates.

The vocabulary's IRI and prefix are parameters: a user with data under another vocabulary passes it.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators.store import QuadStore
from quadloom.plans.compiler import Solutions
from quadloom.plans.parser import parse_query

VOCABULARY = "http://example.org/project#"

#: SPARQL of the fixed queries; {limit} is filled in by run().
QUERIES = {
    "recent_sessions": "SELECT ?s ?title ?date ?next WHERE { ?s a v:Session ; v:title ?title ; v:date ?date OPTIONAL { ?s v:nextTodo ?next } } ORDER BY DESC(?date) ?s LIMIT {limit}",
    "open_issues": 'SELECT ?s ?title ?date WHERE { ?s a v:Issue ; v:title ?title ; v:date ?date ; v:status "open" } ORDER BY DESC(?date) ?s LIMIT {limit}',
    "recent_decisions": "SELECT ?s ?title ?date ?reason WHERE { ?s a v:Decision ; v:title ?title ; v:date ?date OPTIONAL { ?s v:reason ?reason } } ORDER BY DESC(?date) ?s LIMIT {limit}",
    "open_todos": 'SELECT ?s ?title ?status ?priority ?created WHERE { ?s a v:Todo ; v:title ?title ; v:status ?status FILTER(?status = "open" || ?status = "in-progress") OPTIONAL { ?s v:priority ?priority } OPTIONAL { ?s v:createdIn ?created } } ORDER BY DESC(?priority) ?s LIMIT {limit}',
    "recent_insights": "SELECT ?s ?title ?confidence ?domain WHERE { ?s a v:Insight ; v:title ?title OPTIONAL { ?s v:confidence ?confidence } OPTIONAL { ?s v:domain ?domain } } ORDER BY ?s LIMIT {limit}",
    "domain_activity": "SELECT ?title (COUNT(?a) AS ?n) WHERE { ?s a v:Session ; v:hasActivity ?a OPTIONAL { ?s v:domain ?d . ?d v:title ?title } } GROUP BY ?title ORDER BY DESC(?n) ?title LIMIT {limit}",
    "latest_session": "SELECT ?s ?title ?date WHERE { ?s a v:Session ; v:title ?title ; v:date ?date } ORDER BY DESC(?date) ?s LIMIT 1",
    "predicates": "SELECT ?s ?title WHERE { ?s a v:Predicate ; v:title ?title } ORDER BY ?title LIMIT {limit}",
    "last_session_date": "SELECT ?date WHERE { ?s a v:Session ; v:date ?date } ORDER BY DESC(?date) LIMIT 1",
}

#: Predicates that every store answers: name -> (template, required parameters).
PREDICATES = {
    "Module.hasOpenIssue": ('SELECT ?issue ?title WHERE { ?issue a v:Issue ; v:relatedTo ?module ; v:title ?title ; v:status "open" }', ["module"]),
    "Module.hasDependents": ("SELECT ?dependent ?title WHERE { ?dependent a v:Module ; v:dependsOn ?module OPTIONAL { ?dependent v:title ?title } }", ["module"]),
    "Decision.exists": ("ASK { ?d a v:Decision ; v:title ?title FILTER(CONTAINS(LCASE(?title), LCASE(?keyword))) }", ["keyword"]),
    "Knowledge.exists": ("SELECT ?k ?title ?body WHERE { ?k a v:Knowledge ; v:title ?title OPTIONAL { ?k v:body ?body } FILTER(CONTAINS(LCASE(?title), LCASE(?keyword))) } ORDER BY ?k LIMIT 10", ["keyword"]),
    "Issue.isResolved": ('ASK { ?issue a v:Issue ; v:status ?status FILTER(?status = "resolved" || ?status = "closed") }', ["issue"]),
    "Module.hasSymbols": ("SELECT ?symbol ?kind WHERE { ?symbol v:definedIn ?module ; a ?kind FILTER(?kind IN (v:Class, v:Interface, v:Function, v:Method)) }", ["module"]),
}


class Project:
    """A store with the application's vocabulary."""

    def __init__(self, store: QuadStore, graph: str, vocabulary: str = VOCABULARY):
        self.store, self.graph, self.vocabulary = store, graph, vocabulary
        store.prefixes.setdefault("v", vocabulary)

    def run(self, name: str, limit: int = 10) -> Solutions:
        return self.store.query(QUERIES[name].replace("{limit}", str(int(limit))), self.graph)

    def search(self, keywords: list[str], kinds: tuple[str, ...] = ("Issue", "Decision", "Knowledge", "Pattern"), limit: int = 10) -> Solutions:
        """Items whose title or body holds any of the keywords."""
        if not keywords:
            raise ValueError("keywords are needed")
        tests = " || ".join(f'CONTAINS(LCASE(?title), {k}) || CONTAINS(LCASE(COALESCE(?body, "")), {k})' for k in (json.dumps(x.lower(), ensure_ascii=False) for x in keywords))
        fields = ("body", "status", "date", "solution", "cause", "reason")
        optional = " ".join(f"OPTIONAL {{ ?s v:{x} ?{x} }}" for x in fields)
        names = " ".join(f"?{x}" for x in ("s", "kind", "title", *fields))
        return self.store.query(f"SELECT {names} WHERE {{ ?s a ?kind ; v:title ?title {optional} FILTER(?kind IN ({', '.join(f'v:{x}' for x in kinds)})) FILTER({tests}) }} ORDER BY DESC(?date) ?s LIMIT {int(limit)}", self.graph)

    def has_session(self, day: str) -> bool:
        """Whether a session of this day is there, by its typed date."""
        return self.store.ask(f'ASK {{ ?s a v:Session ; v:date "{datetime.date.fromisoformat(day).isoformat()}"^^xsd:date }}', self.graph)

    def titled(self, text: str, limit: int = 10) -> Solutions:
        """Items by their title alone."""
        return self.store.query(f"SELECT ?s ?title WHERE {{ ?s v:title ?title FILTER(CONTAINS(LCASE(?title), {json.dumps(text.lower(), ensure_ascii=False)})) }} ORDER BY ?s LIMIT {int(limit)}", self.graph)

    def counts(self) -> Solutions:
        """Items by kind."""
        return self.store.query("SELECT ?kind (COUNT(?s) AS ?n) WHERE { ?s a ?kind } GROUP BY ?kind", self.graph)

    def impact(self, module: str) -> dict:
        """Direct dependents and dependencies of a module, related items, and how grave a change is."""
        m = module_iri(module)
        one = lambda q: [r[0].lex for r in self.store.query(q, self.graph).df.collect()]
        dependents = one(f"SELECT DISTINCT ?x WHERE {{ ?x v:dependsOn <{m}> }} ORDER BY ?x")
        dependencies = one(f"SELECT DISTINCT ?x WHERE {{ <{m}> v:dependsOn ?x }} ORDER BY ?x")
        related = [[r[k].lex if r[k] is not None else None for k in range(5)] for r in self.related(m.removeprefix("urn:module:")).df.collect()]  # ten at most
        return {"dependents": dependents, "dependencies": dependencies, "related": related, "impact": severity(len(dependents))}

    def related(self, path: str, limit: int = 10) -> Solutions:
        """Items with a title whose body names a path: s, kind, title, status, date."""
        return self.store.query(f"SELECT ?s ?kind ?title ?status ?date WHERE {{ ?s a ?kind ; v:title ?title ; v:body ?b OPTIONAL {{ ?s v:status ?status }} OPTIONAL {{ ?s v:date ?date }} FILTER(CONTAINS(?b, {json.dumps(path, ensure_ascii=False)})) }} ORDER BY ?s LIMIT {int(limit)}", self.graph)

    def transitive_dependents(self, module: str) -> Solutions:
        return self.store.query(f"SELECT ?x WHERE {{ ?x v:dependsOn+ <{module_iri(module)}> }}", self.graph)

    def details(self, node: str) -> Solutions:
        return self.store.query(f"SELECT ?p ?o WHERE {{ <{node}> ?p ?o }}", self.graph)

    # --- predicates
    def predicate(self, name: str) -> tuple[str, list[str]] | None:
        """Template and parameters, of those built in or of one the store describes."""
        if name in PREDICATES:
            return PREDICATES[name]
        found = self.store.query("SELECT ?s ?t ?q ?r WHERE { ?s a v:Predicate ; v:title ?t ; v:sparqlTemplate ?q OPTIONAL { ?s v:requiredParam ?r } }", self.graph).df
        found = found.filter((F.col("t.lex") == name) | (F.col("s.lex") == f"urn:predicate:{name}"))
        rows = found.groupBy("s", "q").agg(F.array_sort(F.collect_set("r.lex")).alias("r")).orderBy("s").limit(1).collect()
        return (rows[0].q.lex, list(rows[0].r)) if rows else None

    def ask(self, name: str, record: bool = True, **parameters: str) -> dict:
        """Answer, reason, missing parameters and rows. Parameters are bound as terms, never spliced into text."""
        found = self.predicate(name)
        if not found:
            return {"answer": None, "reason": f"no predicate {name}", "missing": [], "rows": []}
        template, required = found
        missing = [p for p in required if p not in parameters]
        if missing:
            return {"answer": None, "reason": "parameters are missing", "missing": missing, "rows": []}
        q, bound = self._template(template, parameters)
        q.pattern = _bound(q.pattern, bound)
        c = self.store._compiler(self.store._scope(q, self.graph, False))
        if q.form == "ASK":
            out = {"answer": c.ask(q), "rows": []}
        else:
            s = c.select(q)
            rows = [{v: r[v].lex for v in s.vars if r[v] is not None} for r in s.df.collect()]
            out = {"answer": bool(rows), "rows": rows}
        if record:
            out["evaluation"] = self._record(name, parameters, out["answer"])
        return out | {"reason": "", "missing": []}

    def _template(self, template: str, parameters: dict[str, str]) -> tuple:
        """The parsed template, and the terms of its places: <iri{{x}}> is an IRI, "{{x}}" a text, {{x}} either, by its look."""
        bound: dict[str, tuple] = {}

        def place(m: re.Match) -> str:
            before, name, after, text, bare = m.groups()
            name = name or text or bare
            if name == "graphUri":
                return f"<{self.store.graph_iri(self.graph)}>"
            if name not in parameters:
                return f"?{name}"
            value, var = parameters[name], f"p{len(bound)}_{name}"
            if name == "module":
                value = module_iri(value).removeprefix("urn:module:") if before else module_iri(value)
            is_iri = before is not None or bare is not None and re.match(r"[A-Za-z][\w+.-]*:\S+$", value) is not None
            value = f"{before or ''}{value}{after or ''}"
            if is_iri and re.search(r'[<>"{}|^`\s]', value):
                raise ValueError(f"{value} is no IRI")
            bound[var] = (T.IRI, value, "", "") if is_iri else (T.LITERAL, value, T.XSD_STRING, "")
            return f"?{var}"

        text = re.sub(r'<([^<>{}\s]*)\{\{(\w+)\}\}([^<>{}\s]*)>|"\{\{(\w+)\}\}"|\{\{(\w+)\}\}', place, template)
        q = parse_query(text, self.store.prefixes)
        own = {p: (T.IRI if re.match(r"[A-Za-z][\w+.-]*:\S+$", v) else T.LITERAL, module_iri(v) if p == "module" else v) for p, v in parameters.items()}
        named = {p: (kind if p != "module" else T.IRI, v, "" if kind == T.IRI or p == "module" else T.XSD_STRING, "") for p, (kind, v) in own.items()}
        return q, named | bound

    def _record(self, name: str, parameters: dict, answer: bool) -> str:
        today = datetime.date.today().isoformat()
        uri = f"urn:evaluation:{today}-{uuid.uuid4().hex}"
        quoted = json.dumps(json.dumps(parameters, ensure_ascii=False), ensure_ascii=False)
        self.store.update(f'INSERT DATA {{ <{uri}> a v:Evaluation ; v:predicate {json.dumps(name)} ; v:input {quoted} ; v:result "{str(answer).lower()}" ; v:date "{today}"^^xsd:date }}', self.graph)
        return uri


def _bound(node, values: dict[str, tuple]):
    """The tree with variables replaced by terms."""
    if isinstance(node, tuple):
        if len(node) == 2 and node[0] == "var" and node[1] in values:
            return ("term", values[node[1]])
        return tuple(_bound(x, values) for x in node)
    if isinstance(node, list):
        return [_bound(x, values) for x in node]
    return node


def module_iri(path: str) -> str:
    """urn:module: and the path without its extension; such an IRI stays what it is."""
    return "urn:module:" + re.sub(r"\.[tj]sx?$", "", path.removeprefix("urn:module:"))


def severity(dependents: int) -> str:
    return "low" if dependents == 0 else "medium" if dependents <= 3 else "high"


def dependents_with_severity(edges: DataFrame) -> DataFrame:
    """edges (s depends on o) -> node, dependents, impact; all nodes at once."""
    nodes = edges.select(F.col("s").alias("node")).unionAll(edges.select(F.col("o").alias("node"))).distinct()
    counted = edges.distinct().groupBy(F.col("o").alias("node")).agg(F.count("*").alias("dependents"))
    n = F.coalesce("dependents", F.lit(0)).cast("long")
    return nodes.join(counted, "node", "left").select("node", n.alias("dependents"), F.when(n == 0, "low").when(n <= 3, "medium").otherwise("high").alias("impact"))
