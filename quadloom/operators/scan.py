"""A code base as tables and triples: folder tree, package facts, entry points, symbols, modules, commit days.

files has path (relative to the root) and text. All of it is DataFrame work, one row a file or fact,
but for calls, which need Python's own parser.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators.extract import encoded, symbol_iri
from quadloom.plans.skew import spread
from quadloom.sources.mapping import quad

#: Bounds of a scan (fixed values).
TREE_DEPTH, ENTRY_LINES, README_LINES, SNAPSHOT_BYTES, MOST_FILES, MOST_SYMBOLS, LANGUAGE_SAMPLES, SAMPLE_FILES, SAMPLE_LINES = 3, 150, 100, 15360, 500, 300, 5, 2, 30
CALLS = "path string, caller string, callee string"


def tree(files: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """path, name, depth (from 1), kind (directory or file) of what lies up to so deep; files tells all there are."""
    parts = F.split("path", "/")
    rows = files.select(parts.alias("parts"), F.posexplode(F.slice(parts, 1, depth)).alias("at", "name"))
    kind = F.when(F.col("at") + 1 < F.size("parts"), "directory").otherwise("file")
    return rows.select(F.array_join(F.slice("parts", 1, F.col("at") + 1), "/").alias("path"), "name", (F.col("at") + 1).alias("depth"), kind.alias("kind")).distinct()


def truncated(text: Column, lines: int) -> Column:
    """The first lines of a text, and a mark if there are more."""
    parts = F.split(text, "\n")
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n... (truncated)"))).otherwise(text)


def package_facts(text: Column) -> Column:
    """Name, version, description and the maps of a package.json; null if it isn't JSON."""
    return F.from_json(text, "name string, version string, description string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, engines map<string,string>")


def compiler_facts(text: Column) -> Column:
    """Target, module, strictness and paths of a tsconfig.json or jsconfig.json."""
    return F.from_json(text, "compilerOptions struct<target string, module string, strict boolean, paths map<string,array<string>>>")["compilerOptions"]


def entry_points(text: str) -> list[str]:
    """Files that a package.json names as entries, each after the source it is built from (dist/x.js: src/x.ts)."""
    try:
        package = json.loads(text)
    except ValueError:
        return []
    found: list[str] = []

    def take(x) -> None:
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, dict):
            for y in x.values():
                take(y)

    if isinstance(package, dict):
        if isinstance(package.get("main"), str):
            take(package["main"])
        take(package.get("bin"))
        if isinstance(package.get("exports"), dict):
            take(package["exports"])
    out = []
    for entry in found:
        path = entry.removeprefix("./")
        source = "src/" + path.removeprefix("dist/") if path.startswith("dist/") else path
        out += [source.removesuffix(".js") + ".ts" if source.endswith(".js") else source, path]
    return list(dict.fromkeys(out))


def entries(files: DataFrame) -> DataFrame:
    """path and text (cut to ENTRY_LINES) of the entry points of the root's package.json that are there."""
    found = files.filter("path = 'package.json'").select("text").limit(1).collect()
    names = entry_points(found[0].text or "") if found else []
    return files.filter(F.col("path").isin(*names)).select("path", truncated(F.col("text"), ENTRY_LINES).alias("text")) if names else files.select("path", "text").limit(0)


def capped(files: DataFrame, symbols: DataFrame, most_files: int = MOST_FILES, most_symbols: int = MOST_SYMBOLS) -> tuple[DataFrame, DataFrame, list[str]]:
    """The first files and symbols by path, as many as a scan may report, and warnings of what it left out.

    A report with limits of its own: both are parameters.
    """
    warnings = []
    kept = files.orderBy("path").limit(most_files)
    if files.count() > most_files:
        warnings.append(f"only {most_files} files were scanned")
    own = symbols.join(kept.select("path"), "path", "left_semi")
    if own.count() > most_symbols:
        warnings.append(f"only {most_symbols} symbols were kept")
    return kept, own.orderBy("path", "kind", "parent", "name").limit(most_symbols), warnings


def samples(files: DataFrame, languages: dict[str, str], groups: int = LANGUAGE_SAMPLES, most: int = SAMPLE_FILES, lines: int = SAMPLE_LINES) -> DataFrame:
    """extension, language, path, text: the first lines of up to `most` files of each of the largest groups of known but unsupported languages.

    A report with limits of its own. Files named like entries come first, then by path; equal groups by extension.
    """
    table = files.sparkSession.createDataFrame(list(languages.items()), "extension string, language string")
    own = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).join(F.broadcast(table), "extension")
    largest = own.groupBy("extension").count().orderBy(F.desc("count"), "extension").limit(groups).select("extension")
    entry = F.when(F.col("path").rlike(r"/(main|index|app|mod|lib)\.[^/]+$"), 0).otherwise(1)
    best = own.join(largest, "extension", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("extension").orderBy(entry, "path"))).filter(F.col("n") <= most)
    return best.select("extension", "language", "path", F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n").alias("text"))


def snapshot(facts: dict, most: int = SNAPSHOT_BYTES) -> dict:
    """A scan's report cut to a size in steps: entry points, readme, tree, imports, graph."""
    out = dict(facts)
    size = lambda: len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode())
    cut = lambda text, lines: "\n".join(text.split("\n")[:lines]) + "\n... (truncated)"
    steps = [
        lambda: out.update(entryPoints=[e | {"content": cut(e["content"], 50)} for e in out.get("entryPoints", [])]),
        lambda: out.get("readme") and out.update(readme=cut(out["readme"], 30)),
        lambda: out.update(directoryTree=[x for x in out.get("directoryTree", []) if x["depth"] <= 2]),
        lambda: out.update(detectedImports=[]),
        lambda: out.update(dependencyGraph=None),
    ]
    for step in steps:
        if size() <= most:
            break
        step()
        out["truncated"] = True
    return out


def snapshots(reports: DataFrame, sizes: list[int]) -> DataFrame:
    """Reports in rows (key, facts: JSON), each cut to each of these sizes: key, bytes, report (JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, most, json.dumps(snapshot(json.loads(facts), most), ensure_ascii=False)) for key, facts in zip(batch["key"], batch["facts"]) for most in sizes]
            yield pd.DataFrame(rows, columns=["key", "bytes", "report"])

    return spread(reports.select("key", "facts"), "key").mapInPandas(run, f"key {dict(reports.dtypes)['key']}, bytes int, report string")


# --- triples


def module_iri(path: Column) -> Column:
    """The IRI of a path or, as it is but for the extension, of what is a module's IRI already."""
    return F.concat(F.lit("urn:module:"), F.regexp_replace(F.regexp_replace(path, "^urn:module:", ""), r"\.[tj]sx?$", ""))


def _literal(g: str, s: Column, p: str, o: Column) -> list[Column]:
    return quad(g, s, p, T.LITERAL, o, T.XSD_STRING)


def symbol_quads(symbols: DataFrame, g: str, base: str) -> DataFrame:
    """Quads of classes, interfaces, functions and methods.

    symbols: path, kind, name, parent (of a method: its class), bases and implements (arrays; an entry
    path/kind/name is a symbol's IRI, another a name), parameters ("name: type"), returns.
    """
    named = F.when(F.col("kind") == "Method", F.concat("parent", F.lit("."), "name")).otherwise(F.col("name"))
    rows = symbols.withColumn("_s", symbol_iri(F.col("path"), F.col("kind"), named)).withColumn("_m", module_iri(F.col("path")))
    owner = symbol_iri(F.col("path"), F.lit("class"), F.col("parent"))
    s, parts = F.col("_s"), []
    parts.append(rows.select(*quad(g, s, T.RDF + "type", T.IRI, F.concat(F.lit(base), "kind"))))
    parts.append(rows.select(*_literal(g, s, base + "title", F.col("name"))))
    parts.append(rows.select(*quad(g, s, base + "definedIn", T.IRI, F.col("_m"))))
    parts.append(rows.filter("kind = 'Method'").select(*quad(g, owner, base + "hasMethod", T.IRI, s)))
    parts.append(rows.filter("returns is not null and returns not in ('', 'void')").select(*_literal(g, s, base + "returns", F.col("returns"))))
    parts.append(rows.filter("kind = 'Method'").select("_s", F.explode("parameters").alias("x")).select(*_literal(g, s, base + "paramType", F.col("x"))))
    for column, predicate in (("bases", "extends"), ("implements", "implements")):
        each = rows.select("_s", F.explode(column).alias("x"))
        at = F.regexp_extract("x", r"^(.+)/([^/]+)/([^/]+)$", 1), F.regexp_extract("x", r"^(.+)/([^/]+)/([^/]+)$", 2), F.regexp_extract("x", r"^(.+)/([^/]+)/([^/]+)$", 3)
        parts.append(each.filter(at[0] != "").select(*quad(g, s, base + predicate, T.IRI, symbol_iri(*at))))
        parts.append(each.filter(at[0] == "").select(*_literal(g, s, base + predicate, F.col("x"))))
    return _union(parts)


def call_quads(calls: DataFrame, g: str, base: str) -> DataFrame:
    """Quads of method calls: caller and callee."""
    rows = calls.select("caller", "callee").distinct()
    s = F.concat(F.lit("urn:call:"), encoded(F.col("caller")), F.lit("--"), encoded(F.col("callee")))
    parts = [rows.select(*quad(g, s, T.RDF + "type", T.IRI, F.lit(base + "MethodCall")))]
    for p, o in (("callerSymbol", F.col("caller")), ("calleeSymbol", F.col("callee")), ("title", F.concat("caller", F.lit(" -> "), "callee"))):
        parts.append(rows.select(*_literal(g, s, base + p, o)))
    return _union(parts)


def module_quads(modules: DataFrame, edges: DataFrame, g: str, base: str) -> DataFrame:
    """Quads of modules (path) and of the imports among them (source, target)."""
    parts = [modules.select(*quad(g, module_iri(F.col("path")), T.RDF + "type", T.IRI, F.lit(base + "Module")))]
    parts.append(edges.select(*quad(g, F.concat(F.lit("urn:module:"), "source"), base + "dependsOn", T.IRI, F.concat(F.lit("urn:module:"), "target"))))
    return _union(parts)


def session_quads(days: DataFrame, g: str, base: str) -> DataFrame:
    """Quads of the days of extract.commit_days: one session a day."""
    s = F.concat(F.lit("urn:session:"), "day", F.lit("-auto"))
    parts = [days.select(*quad(g, s, T.RDF + "type", T.IRI, F.lit(base + "Session"))), days.select(*_literal(g, s, base + "title", F.col("title"))), days.select(*_literal(g, s, base + "body", F.array_join("messages", "\n")))]
    parts.append(days.select(*quad(g, s, base + "date", T.LITERAL, F.col("day"), T.XSD_DATE)))
    return _union(parts)


def new_days(days: DataFrame, quads: DataFrame, base: str) -> DataFrame:
    """The days of which the store holds no session."""
    held = quads.filter(F.col("p") == base + "date").select(F.col("o").alias("day")).distinct()
    return days.join(held, "day", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def python_calls(files: DataFrame) -> DataFrame:
    """Calls in Python files from a function or method (Class.name) to one of the same file; others aren't resolved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    body = ast.parse(text or "").body
                except (SyntaxError, ValueError):
                    continue
                functions = [(n.name, None, n) for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                functions += [(f"{c.name}.{n.name}", c.name, n) for c in body if isinstance(c, ast.ClassDef) for n in c.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                known = {name for name, _, _ in functions}
                for name, owner, node in functions:
                    for call in ast.walk(node):
                        if not isinstance(call, ast.Call):
                            continue
                        f = call.func
                        callee = f.id if isinstance(f, ast.Name) else f"{owner}.{f.attr}" if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("self", "cls") else None
                        if callee in known:
                            rows.append((path, name, callee))
            yield pd.DataFrame(rows, columns=["path", "caller", "callee"])

    return spread(files.select("path", "text"), "path").mapInPandas(run, CALLS).distinct()
