"""Facts from source files: imports, symbols, keyword lists; and records to quads."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.plans.skew import spread

EXCLUDED = ["node_modules", "dist", ".git", "build", "coverage", ".next", "__pycache__", "target", "vendor"]
_IMPORT = r"""(?:import|export)\s[^'"\n]*?from\s*['"]([^'"]+)['"]|import\s*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)"""
_EXTENSION = r"\.[tj]sx?$"
SYMBOLS = "path string, kind string, name string, parent string, bases array<string>, parameters array<string>, returns string"


def source_files(spark: SparkSession, root: str, glob: str = "*.{ts,tsx,js,jsx}") -> DataFrame:
    """path (relative to root) and text; excluded folders are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(root).select("path", F.col("content").cast("string").alias("text"))
    files = files.withColumn("path", F.regexp_replace("path", f"^.*?{root.strip('/')}/", ""))
    return files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])))


def _specifiers(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(_IMPORT), F.lit(k)) for k in (1, 2, 3)]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x != ""))


def resolved(folder: Column, target: Column) -> Column:
    """A relative import as a path: '.' and '..' folded away."""
    parts = F.split(F.concat_ws("/", folder, target), "/")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.array_join(folded, "/")


def local_imports(files: DataFrame) -> DataFrame:
    """Distinct edges (source, target) between modules (paths without extension); an exact file wins over its index."""
    modules = files.select(F.regexp_replace("path", _EXTENSION, "").alias("target")).distinct()
    wanted = files.select(F.regexp_replace("path", _EXTENSION, "").alias("source"), F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.explode(_specifiers(F.col("text"))).alias("spec")).filter(F.col("spec").startswith("."))
    wanted = wanted.select("source", F.regexp_replace(resolved(F.col("folder"), F.col("spec")), _EXTENSION, "").alias("to"))
    tries = wanted.select("source", "to", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("to").alias("target")), F.struct(F.lit(1).alias("rank"), F.concat("to", F.lit("/index")).alias("target")))).alias("t")).select("source", "to", "t.*")
    found = tries.join(modules, "target").groupBy("source", "to").agg(F.min(F.struct("rank", "target")).alias("best"))
    return found.select("source", F.col("best.target").alias("target")).filter("source <> target").distinct()


def external_imports(files: DataFrame) -> DataFrame:
    """Distinct package names; a scope belongs to the name."""
    spec = files.select(F.explode(_specifiers(F.col("text"))).alias("spec")).filter(~F.col("spec").startswith(".") & ~F.col("spec").startswith("/"))
    name = F.when(F.col("spec").startswith("@"), F.regexp_extract("spec", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract("spec", r"^([^/]+)", 1))
    return spec.select(name.alias("package")).filter("package <> ''").distinct()


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Double-quoted hrefs of pages: page_id, href, one row each."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))


def commit_days(log: DataFrame) -> DataFrame:
    """Lines date|message -> day, messages, title, body: one record a day; lines without a separator are passed over."""
    parts = log.select(F.split("value", r"\|", 2).alias("p")).select(F.get("p", 0).alias("day"), F.get("p", 1).alias("message")).filter("message is not null")
    days = parts.groupBy("day").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    return days.select("day", "messages", F.when(F.size("messages") == 1, F.col("messages")[0]).otherwise(F.concat(F.size("messages").cast("string"), F.lit(" commits"))).alias("title"), F.array_join("messages", "; ").alias("body"))


def unsupported(files: DataFrame, languages: dict[str, str], most: int = 5) -> DataFrame:
    """Files of known but unsupported languages by extension: extension, language, files, count."""
    table = files.sparkSession.createDataFrame(list(languages.items()), "extension string, language string")
    return files.withColumn("extension", F.regexp_extract("path", r"(\.[^./]+)$", 1)).join(F.broadcast(table), "extension").groupBy("extension", "language").agg(F.slice(F.array_sort(F.collect_list("path")), 1, most).alias("files"), F.count("*").alias("count"))


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files, by the language's own parser; broken files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for node in tree.body:
                    if isinstance(node, ast.ClassDef):
                        bases = [ast.unparse(b) for b in node.bases]
                        abstract = any(b.rsplit(".", 1)[-1] in ("ABC", "Protocol") for b in bases)
                        rows.append((path, "Interface" if abstract else "Class", node.name, None, bases, [], None))
                        rows += [_function(path, m, "Method", node.name) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and m.name != "__init__"]
                    elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append(_function(path, node, "Function", None))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "parent", "bases", "parameters", "returns"])

    return spread(files.select("path", "text"), "path").mapInPandas(run, SYMBOLS)


def _function(path: str, node, kind: str, parent: str | None) -> tuple:
    parameters = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if a.arg not in ("self", "cls")]
    return (path, kind, node.name, parent, [], parameters, ast.unparse(node.returns) if node.returns else None)


#: For languages without a parser here: (kind, pattern of a declaration line with the name as group 1).
DECLARATIONS = {
    "go": [("Class", r"(?m)^type\s+(\w+)\s+struct\b"), ("Interface", r"(?m)^type\s+(\w+)\s+interface\b"), ("Function", r"(?m)^func\s+(\w+)\s*[(\[]"), ("Method", r"(?m)^func\s+\([^)]*\)\s*(\w+)\s*\(")],
    "rust": [("Class", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), ("Interface", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("Function", r"(?m)^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)")],
    "java": [("Class", r"(?m)^\s*(?:(?:public|protected|private|abstract|final|static)\s+)*class\s+(\w+)"), ("Interface", r"(?m)^\s*(?:(?:public|protected|private)\s+)*interface\s+(\w+)")],
    "swift": [("Class", r"(?m)^\s*(?:(?:public|open|final|internal|private)\s+)*(?:class|struct)\s+(\w+)"), ("Interface", r"(?m)^\s*(?:(?:public|internal)\s+)*protocol\s+(\w+)"), ("Function", r"(?m)^(?:(?:public|internal)\s+)*func\s+(\w+)")],
    "typescript": [("Class", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("Interface", r"(?m)^\s*(?:export\s+)?interface\s+(\w+)"), ("Function", r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)")],
}


def declared_symbols(files: DataFrame, language: str) -> DataFrame:
    """path, kind, name by declaration patterns: a heuristic, all in Spark functions."""
    out = None
    for kind, pattern in DECLARATIONS[language]:
        part = files.select("path", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("name"))
        out = part if out is None else out.unionAll(part)
    return out


def encoded(text: Column) -> Column:
    """Percent-encoding that leaves !'()*~ alone and gives a space as %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for raw, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def symbol_iri(path: Column, kind: Column, name: Column) -> Column:
    return F.concat(F.lit("urn:symbol:"), encoded(path), F.lit("/"), F.lower(kind), F.lit("/"), encoded(name))


#: Words that are no keywords (fixed values).
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might must can could "
    "this that these those it its i you he she we they me him her us them my your his our their what which who whom when "
    "where why how not no nor but and or if then else for from with without about above after before between into through during "
    "to of in on at by as so than too very just also now here there all each every both few more most other some such only "
    "same let please want need like make get use try look see know think help show tell give take come go run file code check "
    "은 는 이 가 을 를 에 에서 으로 로 와 과 의 도 만 부터 까지 에게 한테 보다 라고 이라고 하고 해서 해줘 해주세요 "
    "좀 그 저 것 거 수 때 중 후 전 안 못 잘 더 다 뭐 어떻게 왜 어디 언제 누가 뭘 걸 건 데 게 줘"
).split()
_LATIN, _HANGUL = "([a-zA-Z0-9_./]+)", "([\uac00-\ud7af\u3130-\u318f]+)"


def keywords(text: Column, most: int = 5) -> Column:
    """Up to `most` distinct keywords of a prompt: identifiers of four letters or more in lower case, Hangul words of
    three or more, and paths and error classes as they stand. Where the two scripts meet a word is split."""
    split = F.regexp_replace(F.regexp_replace(text, _LATIN + _HANGUL, "$1 $2"), _HANGUL + _LATIN, "$1 $2")
    words = F.filter(F.split(split, r"[\s,.:;!?()\[\]{}'\"]+"), lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS))
    found = F.transform(
        words,
        lambda w: F.array(
            F.when(w.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$") & (F.length(w) >= 4), F.lower(w)),
            F.when(w.rlike("[\uac00-\ud7af]") & (F.length(w) >= 3), w),
            F.when(w.contains("/") | w.endswith("Error"), w),
        ),
    )
    return F.slice(F.array_distinct(F.array_compact(F.flatten(found))), 1, most)


#: What tells that an output is about an error (fixed values).
ERROR_SIGNS = [
    r"(?i)\bError\b", r"\bERR!", r"(?i)\bFailed\b", r"(?i)\bfatal\b", r"\bENOENT\b", r"\bENOTDIR\b", r"\bEACCES\b", r"\bSyntaxError\b", r"\bTypeError\b", r"\bReferenceError\b",
    r"\bModuleNotFoundError\b", r"\bexited with code [1-9]", r"\bcommand not found\b", r"\bCannot find module\b", r"\bTS\d{4}:",
]


def tells_of_error(text: Column) -> Column:
    """Whether an output is to be searched for error keywords at all."""
    found = F.lit(False)
    for sign in ERROR_SIGNS:
        found = found | text.rlike(sign)
    return found


def error_keywords(text: Column, most: int = 5) -> Column:
    """Up to `most` distinct keywords of an output that tells of an error, else none: error classes, compiler codes,
    modules that weren't found, up to three paths, up to two package names."""
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    classes, codes = every(r"\b([A-Z][a-zA-Z]*Error)\b", 1), every(r"(TS\d{4})", 1)
    modules, paths = every(r"Cannot find module ['\"]([^'\"]+)['\"]", 1), F.slice(every(r"((?:src|lib)/[\w/.-]+\.\w+)", 1), 1, 3)
    packages = F.filter(F.slice(every(r"(?i)(?:ERR!|error)\s+([a-z@][a-z0-9@/.-]+)", 1), 1, 2), lambda x: F.length(x) >= 3)
    found = F.slice(F.array_distinct(F.concat(classes, codes, modules, paths, packages)), 1, most)
    return F.when(tells_of_error(text), found).otherwise(F.array().cast("array<string>"))
