"""RDF terms as Spark columns.

A term is struct<kind, lex, dt, lang>; a null struct is an unbound variable, and members are never
null, so structs can be compared and joined as they are. kind: 0 IRI, 1 blank node, 2 literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IRI, BNODE, LITERAL = 0, 1, 2
TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string>"

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD_STRING, XSD_INTEGER, XSD_DECIMAL, XSD_DOUBLE, XSD_BOOLEAN = (XSD + x for x in ("string", "integer", "decimal", "double", "boolean"))
XSD_DATE, XSD_DATETIME, LANG_STRING = XSD + "date", XSD + "dateTime", RDF + "langString"
INTEGERS = tuple(XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
NUMERIC = (*INTEGERS, XSD_DECIMAL, XSD_DOUBLE, XSD + "float")

#: Prefixes known without a declaration (fixed values).
WELL_KNOWN = {
    "rdf": RDF,
    "rdfs": RDFS,
    "owl": OWL,
    "xsd": XSD,
    "schema": "http://schema.org/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "sh": "http://www.w3.org/ns/shacl#",
}


def term(kind: int | Column, lex: Column, dt: Column | str = "", lang: Column | str = "") -> Column:
    """A term column; null where lex is null."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(as_col(kind).cast("tinyint").alias("kind"), lex.cast("string").alias("lex"), as_col(dt).alias("dt"), as_col(lang).alias("lang"))
    return F.when(lex.isNotNull(), made)


def struct(kind: int, lex: Column, dt: str = "", lang: str = "") -> Column:
    """A term of a column that is never null."""
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), F.lit(dt).alias("dt"), F.lit(lang).alias("lang"))


def iri(lex: Column | str) -> Column:
    return term(IRI, lex if isinstance(lex, Column) else F.lit(lex))


def literal(lex: Column | str, dt: str | Column = XSD_STRING) -> Column:
    return term(LITERAL, lex if isinstance(lex, Column) else F.lit(lex), dt)


def constant(value: tuple[int, str, str, str]) -> Column:
    kind, lex, dt, lang = value
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.lit(lex).alias("lex"), F.lit(dt).alias("dt"), F.lit(lang).alias("lang"))


def packed(t: Column, graph: Column | None = None) -> Column:
    """A term that is never null, or a node of a graph, as one string: a third of the bytes of its struct. unpacked() and graph_of() read it back."""
    size = lambda x: F.concat(F.char_length(x).cast("string"), F.lit(":"))
    typed = F.concat(size(t["dt"]), size(t["lang"]), t["dt"], t["lang"], t["lex"])
    out = F.concat(t["kind"].cast("string"), F.when(t["kind"] == LITERAL, typed).otherwise(t["lex"]))
    return out if graph is None else F.concat(size(graph), graph, out)


def _counted(text: Column) -> tuple[Column, Column]:
    """The number that a text begins with, and where what follows its colon begins."""
    digits = F.substring_index(text, ":", 1)
    return digits.try_cast("int"), F.char_length(digits) + F.lit(2)


def graph_of(packed_node: Column) -> Column:
    """The graph's IRI."""
    n, at = _counted(packed_node)
    return F.substr(packed_node, at, n)


def unpacked(text: Column, in_graph: bool = False) -> Column:
    if in_graph:
        n, at = _counted(text)
        text = F.substr(text, at + n)
    kind, rest = F.substr(text, F.lit(1), F.lit(1)).cast("tinyint"), F.substr(text, F.lit(2))
    dt, at = _counted(rest)
    more = F.substr(rest, at)
    lang, at = _counted(more)
    literal_ = kind == LITERAL
    return F.struct(
        kind.alias("kind"),
        F.when(literal_, F.substr(more, at + dt + lang)).otherwise(rest).alias("lex"),
        F.when(literal_, F.substr(more, at, dt)).otherwise(F.lit("")).alias("dt"),
        F.when(literal_, F.substr(more, at + dt, lang)).otherwise(F.lit("")).alias("lang"),
    )


def escaped(lex: Column) -> Column:
    """Literal text as it stands between double quotes in N-Triples."""
    out = F.replace(F.replace(lex, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    for code in (*range(0x01, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return out


def term_text(t: Column) -> Column:
    """<iri>, _:label, "text", "text"@lang or "text"^^<datatype>; xsd:string is left out."""
    quoted = F.concat(F.lit('"'), escaped(t["lex"]), F.lit('"'))
    return (
        F.when(t["kind"] == IRI, F.concat(F.lit("<"), t["lex"], F.lit(">")))
        .when(t["kind"] == BNODE, F.concat(F.lit("_:"), t["lex"]))
        .when(t["lang"] != "", F.concat(quoted, F.lit("@"), t["lang"]))
        .when(t["dt"].isin("", XSD_STRING), quoted)
        .otherwise(F.concat(quoted, F.lit("^^<"), t["dt"], F.lit(">")))
    )


def is_numeric(t: Column) -> Column:
    return (t["kind"] == LITERAL) & t["dt"].isin(*NUMERIC)


def number(t: Column) -> Column:
    """Value of a numeric literal, null for anything else."""
    return F.when(is_numeric(t), F.expr("1d") * t["lex"].try_cast("double"))


def exact(t: Column) -> Column:
    """Value of an integer, or of a decimal of up to six places, without rounding; null for anything else."""
    whole = (t["kind"] == LITERAL) & t["dt"].isin(*INTEGERS, XSD_DECIMAL) & F.regexp_like(t["lex"], F.lit(r"^\s*[+-]?\d{1,31}(\.\d{0,6}0*)?\s*$"))
    return F.when(whole, t["lex"].try_cast("decimal(38,6)"))


def moment(t: Column) -> Column:
    return F.when((t["kind"] == LITERAL) & t["dt"].isin(XSD_DATE, XSD_DATETIME), t["lex"].try_cast("timestamp"))


def order_key(t: Column) -> list[Column]:
    """Sort columns of the term order: unbound, blank nodes, IRIs, literals (numbers and times by value)."""
    rank = F.when(t["kind"] == BNODE, 1).when(t["kind"] == IRI, 2).when(t["kind"] == LITERAL, 3)
    return [F.coalesce(rank, F.lit(0)), number(t), exact(t), moment(t), t["lex"], t["dt"], t["lang"]]


def native(t: Column, kind: str) -> Column:
    """The term's lexical form as a Spark type; null if it isn't one."""
    if kind == "string":
        return t["lex"]
    if kind in ("bigint", "long", "int"):
        return t["lex"].try_cast("decimal(38,6)").cast(kind)
    return t["lex"].try_cast(kind)


def local_name(lex: Column) -> Column:
    return F.regexp_extract(lex, r"([^#/]*)$", 1)


def shorten(lex: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Prefixed name, else what follows # or the last /, else unchanged."""
    out = F.when(F.instr(lex, "#") > 0, F.regexp_extract(lex, r"#(.*)$", 1)).when(F.instr(lex, "/") > 0, F.regexp_extract(lex, r"([^/]*)$", 1)).otherwise(lex)
    out = F.when(out == "", lex).otherwise(out)
    for name, space in reversed([*(prefixes or {}).items(), *WELL_KNOWN.items()]):
        out = F.when(lex.startswith(space), F.concat(F.lit(name + ":"), F.substr(lex, F.lit(len(space) + 1)))).otherwise(out)
    return out
