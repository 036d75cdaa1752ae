"""A whole code base in one scan: files dispatched by language, symbols, calls across files, caps, hints.

files has path (relative to the root) and text. A Language says which files are its own and how
their symbols are found; every language sees its own files only, and the scan is the union of what
they give. Calls are resolved by joins, in which all files may name one module: what a file defines, what it imports and what it calls are
three thin tables, and a call meets a definition through its own file, through an import, through a
module's alias or through a base class.
"""

from __future__ import annotations

import ast
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators import extract
from quadloom.operators.scan import MOST_FILES, MOST_SYMBOLS
from quadloom.plans.skew import skewed_join, spread

SYMBOL_COLUMNS = [c.split()[0] for c in extract.SYMBOLS.split(", ")]
#: What a language's imports join, and what follows for a scan by modules (fixed values).
RECOMMENDATIONS = {
    "file-based": 'Module-level dependency graph (depth="module") is applicable.',
    "package-based": 'This language uses package-based imports — module-level scan is not applicable. Use depth="symbol" for class/method/call-level analysis.',
    "framework-based": 'This language uses framework-level imports — module-level scan is not applicable. Use depth="symbol" for class/method/call-level analysis.',
}


@dataclass(frozen=True)
class Language:
    """An extractor: symbols(files) gives rows of extract.SYMBOLS, calls(files), if there is one, rows of CALLS."""

    name: str
    extensions: tuple[str, ...]
    model: str
    symbols: Callable[[DataFrame], DataFrame]
    calls: Callable[[DataFrame], DataFrame] | None = None


def _declared(language: str) -> Callable[[DataFrame], DataFrame]:
    def symbols(files: DataFrame) -> DataFrame:
        empty = F.array().cast("array<string>")
        return extract.declared_symbols(files, language).select("path", "kind", "name", F.lit(None).cast("string").alias("parent"), empty.alias("bases"), empty.alias("parameters"), F.lit(None).cast("string").alias("returns"))

    return symbols


@dataclass
class DeepScan:
    symbols: DataFrame  # language and extract.SYMBOLS
    calls: DataFrame | None  # path, caller, callee_path, callee
    unsupported: DataFrame  # extension, language, files, count: largest first
    hints: list[dict]
    file_count: int
    size: int | None  # of symbols, where limits had it counted
    capped: bool = False
    warnings: list[str] = field(default_factory=list)

    @functools.cached_property
    def symbol_count(self) -> int:
        """Counted when it is asked for, since that parses all files."""
        return self.size if self.size is not None else self.symbols.count()


def discovered(files: DataFrame, languages: list[Language]) -> DataFrame:
    """files of these languages, with the language; the first that claims an ending has it."""
    of = F.lit(None).cast("string")
    for language in reversed(languages):
        for ending in language.extensions:
            of = F.when(F.col("path").endswith(ending), language.name).otherwise(of)
    return files.withColumn("language", of).filter(F.col("language").isNotNull() & ~F.col("path").contains("node_modules") & ~F.col("path").contains("/dist/"))


def scan(files: DataFrame, languages: list[Language] | None = None, most_files: int | None = MOST_FILES, most_symbols: int | None = MOST_SYMBOLS, calls: bool = False, unsupported: dict[str, str] | None = None) -> DeepScan:
    """Symbols, and calls if asked for, of all files of the languages.

    Over most_files files nothing is scanned: the result is empty, capped, and tells the true total.
    Of each language at most most_symbols symbols are kept, by path and name. None: no limit.
    """
    languages = LANGUAGES if languages is None else languages
    if not languages:
        raise ValueError("no extractor is available for these languages")
    hints = [{"language": x.name, "dependencyModel": x.model, "moduleScanApplicable": x.model == "file-based", "recommendation": RECOMMENDATIONS[x.model]} for x in languages]
    own = discovered(files, languages)
    other = extract.unsupported(files.filter(~F.col("path").contains("node_modules") & ~F.col("path").contains("/dist/")), unsupported or UNSUPPORTED)
    none = files.sparkSession.createDataFrame([], f"language string, {extract.SYMBOLS}")
    total = own.count()
    if most_files is not None and total > most_files:
        return DeepScan(none, None, other.limit(0), hints, total, 0, True, [f"File count {total} exceeds maxFiles {most_files}. Scan skipped."])
    found = none
    for x in languages:
        rows = x.symbols(own.filter(F.col("language") == x.name).select("path", "text"))
        found = found.unionByName(rows.select(F.lit(x.name).alias("language"), *SYMBOL_COLUMNS))
    warnings = []
    if most_symbols is not None:
        counts = {r.language: r["count"] for r in found.groupBy("language").count().collect()}  # one row a language
        warnings = [f"{name}: {n} symbols exceed maxSymbols {most_symbols}." for name, n in sorted(counts.items()) if n > most_symbols]
        if warnings:
            place = F.row_number().over(Window.partitionBy("language").orderBy("path", "kind", "parent", "name"))
            found = found.withColumn("_n", place).filter(F.col("_n") <= most_symbols).drop("_n")
        size = sum(min(n, most_symbols) for n in counts.values())
    else:
        size = None
    met = None
    for x in languages:
        if calls and x.calls is not None:
            rows = x.calls(own.filter(F.col("language") == x.name).select("path", "text"))
            met = rows if met is None else met.unionByName(rows)
    return DeepScan(found, met, other, hints, total, size, bool(warnings), warnings)


def symbol_totals(symbols: DataFrame) -> DataFrame:
    """Symbols by file: a class counts for itself and for each of its methods."""
    return symbols.groupBy("path").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "Method").alias("methods"))


# --- what is left out


def ancestors(path: Column) -> Column:
    """A path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def tracked(paths: DataFrame, manifest: DataFrame | None, excluded: list[str] = extract.EXCLUDED) -> DataFrame:
    """Rows whose path (a file or a folder) is tracked, or lies above a tracked file, and in no excluded folder.

    manifest: the paths of the tracked files; None outside of version control, where only folders by name are left out.
    """
    kept = paths.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded])))
    if manifest is None:
        return kept
    return kept.join(manifest.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct(), "path", "left_semi")


# --- the log of commits

#: Endings of source files (fixed values).
SOURCE_ENDINGS = (".ts", ".js", ".tsx", ".jsx", ".py", ".go", ".rs", ".java", ".swift")


def days_since(log: DataFrame, since: str | None, today: Column | None = None) -> DataFrame:
    """Days after `since`, or of the last 7 days, with their messages: lines 'date|message' (column value), others are passed over."""
    parts = log.select(F.split("value", r"\|", 2).alias("p")).select(F.trim(F.get("p", 0)).alias("day"), F.trim(F.get("p", 1)).alias("message")).filter("day <> '' and message <> ''")
    start = F.lit(since) if since is not None else F.date_format(F.date_sub(today if today is not None else F.current_date(), 7), "yyyy-MM-dd")
    return extract.commit_days(parts.filter(F.col("day") > start if since is not None else F.col("day") >= start).select(F.concat_ws("|", "day", "message").alias("value")))


def changes_by_day(commits: DataFrame) -> DataFrame:
    """day, changed: whether a commit (day, files) of the day touched a source file."""
    pattern = "(" + "|".join(x.replace(".", "[.]") for x in SOURCE_ENDINGS) + ")$"
    return commits.groupBy("day").agg(F.bool_or(F.exists("files", lambda x: x.rlike(pattern))).alias("changed"))


def source_changed(commits: DataFrame | None, since: str | None) -> bool:
    """Whether a commit after `since` touched a source file; True where that isn't known."""
    if since is None or commits is None:
        return True
    return not changes_by_day(commits.filter(F.col("day") > since)).filter("changed").isEmpty()


# --- calls across files

_FACTS = "path string, what string, scope string, name string, target string, level int"


def _python_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What files say, a row each: def (name), base (of class scope: name), import (name as which target is known), call (in scope: target.name)."""
    for batch in batches:
        rows: list[tuple] = []
        for path, text in zip(batch["path"], batch["text"]):
            try:
                body = ast.parse(text or "").body
            except (SyntaxError, ValueError):
                continue
            functions = []
            for node in body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    functions.append((node.name, node))
                elif isinstance(node, ast.ClassDef):
                    functions += [(f"{node.name}.{x.name}", x) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
                    rows += [(path, "base", node.name, b.attr if isinstance(b, ast.Attribute) else b.id, b.value.id if isinstance(b, ast.Attribute) else None, 0) for b in node.bases if isinstance(b, ast.Name) or isinstance(b, ast.Attribute) and isinstance(b.value, ast.Name)]
                elif isinstance(node, ast.Import):
                    rows += [(path, "import", None, x.asname or x.name, x.name, 0) for x in node.names if x.asname or "." not in x.name]
                elif isinstance(node, ast.ImportFrom):
                    rows += [(path, "from", x.name, x.asname or x.name, node.module or "", node.level) for x in node.names]
            for scope, node in functions:
                rows.append((path, "def", None, scope, None, 0))
                for call in (x.func for x in ast.walk(node) if isinstance(x, ast.Call)):
                    if isinstance(call, ast.Name):
                        rows.append((path, "call", scope, call.id, None, 0))
                    elif isinstance(call, ast.Attribute) and isinstance(call.value, ast.Name):
                        rows.append((path, "call", scope, call.attr, call.value.id, 0))
        yield pd.DataFrame(rows, columns=["path", "what", "scope", "name", "target", "level"])


def _module(path: Column) -> Column:
    """a/b/c.py -> a.b.c; a package is its folder."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def python_calls(files: DataFrame) -> DataFrame:
    """path, caller, callee_path, callee: calls of functions and methods that the files define, in whichever file.

    Followed are names of the own file, imported names (from m import f as g), aliases of modules (m.f), classes
    (C.f, own or imported) and self.f or cls.f, of the own class, else of its bases one level up. What a file
    shadows or computes isn't told apart.
    """
    from quadloom.plans.fixpoint import checkpointed

    facts = checkpointed(spread(files.select("path", "text"), "path").mapInPandas(_python_facts, _FACTS).distinct())
    of = lambda what: facts.filter(F.col("what") == what)
    modules = files.select(F.col("path").alias("callee_path"), _module(F.col("path")).alias("module")).distinct()
    defs = of("def").select(F.col("path").alias("callee_path"), F.col("name").alias("callee"))
    # Relative imports count levels up from the file's package.
    parts = F.split(F.col("path"), "/")
    package = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    base = F.when(F.col("level") == 0, F.col("target")).otherwise(F.array_join(F.filter(F.array(package, F.col("target")), lambda x: x != ""), "."))
    froms = of("from").select("path", F.col("name").alias("alias"), base.alias("module"), F.col("scope").alias("thing"))
    # What an alias stands for: (module, thing), or a module alone.
    things = skewed_join(froms, modules, ["module"]).select("path", "alias", "callee_path", "thing")
    aliases = of("import").select("path", F.col("name").alias("alias"), F.col("target").alias("module")).unionByName(froms.select("path", "alias", F.array_join(F.filter(F.array("module", "thing"), lambda x: x != ""), ".").alias("module")))
    aliases = skewed_join(aliases, modules, ["module"]).select("path", "alias", "callee_path")

    calls = of("call").select("path", F.col("scope").alias("caller"), "name", "target")
    own_class = F.regexp_extract("caller", r"^([^.]+)\.", 1)
    through_self = calls.filter(F.col("target").isin("self", "cls") & (own_class != "")).withColumn("cls", own_class)
    plain, dotted = calls.filter("target is null"), calls.filter("target is not null and target not in ('self', 'cls')")
    mine = lambda rows, callee: rows.select("path", "caller", F.col("path").alias("callee_path"), callee.alias("callee"))
    theirs = lambda rows, callee: rows.select("path", "caller", "callee_path", callee.alias("callee"))
    method = lambda cls: F.concat(F.col(cls), F.lit("."), F.col("name"))
    inherited = of("base").select("path", F.col("scope").alias("cls"), F.col("name").alias("base"), F.col("target").alias("of"))
    up = through_self.join(inherited, ["path", "cls"])
    held = mine(through_self, method("cls")).join(defs, ["callee_path", "callee"], "left_semi").select("path", "caller", F.regexp_extract("callee", r"\.(.*)$", 1).alias("name"))
    up = up.join(held, ["path", "caller", "name"], "left_anti")
    candidates = [
        mine(plain, F.col("name")),
        theirs(plain.join(things.withColumnRenamed("alias", "name"), ["path", "name"]), F.col("thing")),
        mine(dotted, method("target")),
        theirs(dotted.join(things.withColumnRenamed("alias", "target"), ["path", "target"]), F.concat("thing", F.lit("."), "name")),
        theirs(dotted.join(aliases.withColumnRenamed("alias", "target"), ["path", "target"]), F.col("name")),
        mine(through_self, method("cls")),
        mine(up.filter("of is null"), method("base")),
        theirs(up.filter("of is null").join(things.withColumnRenamed("alias", "base"), ["path", "base"]), F.concat("thing", F.lit("."), "name")),
        theirs(up.filter("of is not null").join(aliases.withColumnRenamed("alias", "of"), ["path", "of"]), method("base")),
    ]
    out = candidates[0]
    for rows in candidates[1:]:
        out = out.unionByName(rows)
    return skewed_join(checkpointed(out.distinct()), defs, ["callee_path", "callee"], "left_semi").select("path", "caller", "callee_path", "callee")


LANGUAGES = [
    Language("typescript", (".ts", ".tsx", ".js", ".jsx"), "file-based", _declared("typescript")),
    Language("python", (".py",), "file-based", extract.python_symbols, python_calls),
    Language("go", (".go",), "package-based", _declared("go")),
    Language("rust", (".rs",), "file-based", _declared("rust")),
    Language("java", (".java",), "package-based", _declared("java")),
    Language("swift", (".swift",), "framework-based", _declared("swift")),
]

#: Languages known by their files' endings, without an extractor (fixed values).
UNSUPPORTED = {
    ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c-header", ".hpp": "cpp-header",
    ".php": "php", ".lua": "lua", ".dart": "dart", ".scala": "scala", ".ex": "elixir", ".exs": "elixir", ".zig": "zig", ".jl": "julia", ".r": "r",
    ".clj": "clojure", ".erl": "erlang", ".hs": "haskell", ".ml": "ocaml", ".nim": "nim", ".cr": "crystal", ".pl": "perl", ".pm": "perl",
}
