"""Turtle and N-Triples: a parser to quads, a writer in Spark, and a validator.

Documents are parsed whole, one at a time, inside mapInPandas, so a load spreads over files; blank
node labels are made unique by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.plans.compiler import QUADS, object_, subject
from quadloom.plans.parser import Parser, SparqlError
from quadloom.plans.skew import spread

BASE_IRI = "http://example.org/"
FIELDS = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]
TRIPLES = "s_kind tinyint, s string, p string, o_kind tinyint, o string, o_dt string, o_lang string"


class TurtleError(ValueError):
    """The text isn't Turtle."""


class _Turtle(Parser):
    """Turtle is SPARQL's triple syntax with @prefix and @base."""

    def document(self) -> tuple[list[tuple], dict[str, str]]:
        triples: list[tuple] = []
        declared: dict[str, str] = {}
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "lang" and text in ("@prefix", "@base") or self.is_word("PREFIX", "BASE"):
                self.at += 1
                name = self.next()[1] if text.lower().endswith("prefix") else None
                iri = self.iri()
                if name is None:
                    self.base = iri
                else:
                    declared[name[:-1]] = iri
                    self.prefixes = self.prefixes | {name[:-1]: iri}
                if kind == "lang":
                    self.need(".")
                continue
            if kind == "var":
                raise SparqlError("a variable is not Turtle")
            self.same_subject(triples)
            self.need(".")
        return triples, declared


def parse(text: str, scope: str = "", base: str = BASE_IRI) -> tuple[list[tuple], dict[str, str]]:
    """(distinct triples as tuples of FIELDS, declared prefixes)."""
    try:
        parser = _Turtle(text)
        parser.base = base
        triples, prefixes = parser.document()
    except (SparqlError, IndexError) as e:
        raise TurtleError(f"Failed to parse Turtle: {e}") from None
    tag = hashlib.sha1(scope.encode()).hexdigest()[:16] if scope else ""

    def flat(x: tuple) -> tuple:
        if x[0] == "iri":
            return (T.IRI, x[1], "", "")
        if x[0] == "var":
            if not x[1].startswith("_:"):
                raise TurtleError(f"Failed to parse Turtle: ?{x[1]}")
            return (T.BNODE, x[1][2:] + tag, "", "")
        if x[0] != "term":
            raise TurtleError(f"Failed to parse Turtle: a path is not Turtle: {x[0]}")
        return x[1]

    out = dict.fromkeys((*flat(s)[:2], flat(p)[1], *flat(o)) for s, p, o in triples)
    if any(t[0] == T.LITERAL for t in out):
        raise TurtleError("Failed to parse Turtle: a literal as subject")
    return list(out), prefixes


def quads(spark: SparkSession, text: str, g: str, scope: str = "") -> DataFrame:
    """A document held by the caller, as quads of graph g."""
    triples = parse(text, scope)[0] if text.strip() else []
    return spark.createDataFrame([(g, *t, False) for t in triples], QUADS)


def read(spark: SparkSession, path: str, g: str) -> DataFrame:
    """Files under a path, as quads of graph g; each file is parsed by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                triples, _ = parse(content.decode("utf-8"), name)
                yield pd.DataFrame([(g, *t, False) for t in triples], columns=["g", *FIELDS, "inferred"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, QUADS).distinct()


def parsed(texts: DataFrame, g: str) -> DataFrame:
    """Documents in rows (path, text) as quads of graph g; blank nodes are those of the row's path, null texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(g, *t, False) for path, text in zip(batch["path"], batch["text"]) if text for t in parse(text, path)[0]]
            yield pd.DataFrame(rows, columns=["g", *FIELDS, "inferred"])

    return spread(texts.select("path", "text"), "path").mapInPandas(run, QUADS)


def validate(text: str) -> dict:
    try:
        triples, prefixes = parse(text)
    except TurtleError as e:
        return {"valid": False, "error": str(e)}
    return {"valid": True, "tripleCount": len(triples), "prefixes": prefixes}


def validate_file(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return {"valid": False, "error": f"Could not read file {path}"}
    return validate(text)


def validate_files(spark: SparkSession, path: str) -> DataFrame:
    """path, valid, triple_count, error of each file under a path."""
    return validated(spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text")))


def validated(texts: DataFrame) -> DataFrame:
    """path, valid, triple_count and error of documents in rows (path, text); a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [validate(x or "") for x in batch["text"]]
            yield pd.DataFrame({"path": batch["path"], "valid": [r["valid"] for r in found], "triple_count": [r.get("tripleCount", 0) for r in found], "error": [r.get("error") for r in found]})

    return spread(texts.select("path", "text"), "path").mapInPandas(run, "path string, valid boolean, triple_count long, error string")


def lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line a row: Turtle that any parser reads, made by Spark functions."""
    s, o = T.term_text(subject()), T.term_text(object_())
    return triples.select(F.concat_ws(" ", s, F.concat(F.lit("<"), F.col("p"), F.lit(">")), o, F.lit(".")).alias("value"))


_HEAD, _TAIL = r"^\s*(<[^>]*>|_:\S+)\s*<([^>]*)>\s*", r'"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\s*\.\s*$'
_NODE = r"^(?:<([^>]*)>|_:(\S+?))\s*\.\s*(?:#.*)?$"


def read_lines(rows: DataFrame, g: str) -> DataFrame:
    """N-Triples lines (column value) as quads of graph g, by Spark functions, so that files are split at any line.

    Blank and comment lines are passed over, and so is what isn't a triple. Blank nodes keep their labels.
    """
    head = F.regexp_extract("value", _HEAD, 0)
    cut = rows.filter(F.regexp_like("value", F.lit(_HEAD))).select("value", head.alias("head"), F.substr("value", F.length(head) + 1).alias("rest"))
    text = F.col("rest").startswith('"') & F.regexp_like("rest", F.lit(_TAIL))
    cut = cut.filter(text | F.regexp_like("rest", F.lit(_NODE)))
    lex = F.substr("rest", F.lit(2), F.length("rest") - F.length(F.regexp_extract("rest", _TAIL, 0)) - 1)
    # The escapes are those of JSON strings, but for code points of eight digits.
    escaped = F.regexp_replace(lex, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    plain = F.when(F.contains(lex, F.lit("\\")), F.from_json(F.concat(F.lit('{"v":"'), escaped, F.lit('"}')), "v string", {"allowUnquotedControlChars": "true"})["v"]).otherwise(lex)
    part = lambda c, pattern, k: F.regexp_extract(c, pattern, k)
    s, blank = part("head", _HEAD, 1), part("rest", _NODE, 2)
    dt, lang = part("rest", _TAIL, 2), part("rest", _TAIL, 1)
    return cut.select(
        F.lit(g).alias("g"), F.when(s.startswith("_:"), T.BNODE).otherwise(T.IRI).cast("tinyint").alias("s_kind"), F.when(s.startswith("_:"), F.substr(s, F.lit(3))).otherwise(F.substr(s, F.lit(2), F.length(s) - 2)).alias("s"), part("head", _HEAD, 2).alias("p"),
        F.when(text, T.LITERAL).when(blank != "", T.BNODE).otherwise(T.IRI).cast("tinyint").alias("o_kind"), F.when(text, plain).when(blank != "", blank).otherwise(part("rest", _NODE, 1)).alias("o"),
        F.when(~text, "").when(lang != "", T.LANG_STRING).when(dt != "", dt).otherwise(T.XSD_STRING).alias("o_dt"), F.when(text, F.lower(lang)).otherwise("").alias("o_lang"), F.lit(False).alias("inferred"),
    )


def namespaces(iris: list[str]) -> dict[str, str]:
    """Prefixes for the namespaces of IRIs: well-known ones, else named after the last part; the first wins."""
    known = {v: k for k, v in T.WELL_KNOWN.items()}
    out: dict[str, str] = {}
    for iri in iris:
        space = iri[: iri.rfind("#") + 1] or iri[: iri.rfind("/") + 1]
        if not space:
            continue
        name = known.get(space) or re.sub(r"[^a-z0-9]", "", re.split(r"[/#]", space.rstrip("/#"))[-1].lower())[:8]
        if name and name not in out:
            out[name] = space
    return out
