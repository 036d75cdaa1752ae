"""Ordinary tables as quads.

Each mapped column becomes one select with its predicate as a literal, and a graph is the union of
those selects. A filter on a predicate reaches every branch, Catalyst folds it to false in all but
the matching ones and drops them, so a triple pattern over a mapped table plans as a scan of one
column with its filters on strings pushed to Parquet; no quads are ever written for it.

Patterns about one subject need not even be joined: Mapped.scan() answers all those that a table
serves in one scan, and keeps the table's own columns beside the terms made of them, so that the
compiler compares, joins and groups by those and filters on numbers reach Parquet too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T

BASE = "http://example.org/shop#"
DATATYPES = {"string": T.XSD_STRING, "bigint": T.XSD_INTEGER, "int": T.XSD_INTEGER, "double": T.XSD_DOUBLE, "date": T.XSD_DATE, "timestamp": T.XSD_DATETIME, "boolean": T.XSD_BOOLEAN}


@dataclass
class TableMap:
    """How the rows of a table become individuals."""

    name: str  # of the table
    kind: str  # class of its rows
    key: str  # column, or SQL expression, that names a row
    literals: list[str] = field(default_factory=list)
    links: dict[str, tuple[str, str]] = field(default_factory=dict)  # predicate -> (kind of the target, column)
    type_column: str | None = None  # rows are also instances of PartType/<value>


MAPS = [
    TableMap("region", "region", "r_regionkey", ["r_name"]),
    TableMap("nation", "nation", "n_nationkey", ["n_name"], {"region": ("region", "n_regionkey")}),
    TableMap("customer", "customer", "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], {"nation": ("nation", "c_nationkey")}),
    TableMap("supplier", "supplier", "s_suppkey", ["s_name", "s_acctbal"], {"nation": ("nation", "s_nationkey")}),
    TableMap("part", "part", "p_partkey", ["p_name", "p_brand", "p_size", "p_retailprice", "p_type"], {}, "p_type"),
    TableMap("orders", "order", "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], {"placedBy": ("customer", "o_custkey")}),
    TableMap("lineitem", "line", "xxhash64(*)", ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"], {"ofOrder": ("order", "l_orderkey"), "ofPart": ("part", "l_partkey"), "bySupplier": ("supplier", "l_suppkey")}),
    TableMap("events", "event", "event_id", ["ts", "event_type", "value"], {"byUser": ("user", "user_id")}),
    TableMap("documents", "doc", "doc_id", ["text", "lang", "source", "n_chars"]),
    TableMap("labels", "doc", "doc_id", ["quality", "toxic"]),
    TableMap("pages", "page", "page_id", ["url"]),
]


def uri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"urn:{kind}:"), key.cast("string"))


def lexical(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column].startswith("timestamp"):
        return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.col(column).cast("string")


def quad(g: str, s: Column, p: str, o_kind: int, o: Column, dt: str = "", lang: str = "") -> list[Column]:
    return [F.lit(g).alias("g"), F.lit(T.IRI).cast("tinyint").alias("s_kind"), s.alias("s"), F.lit(p).alias("p"), F.lit(o_kind).cast("tinyint").alias("o_kind"), o.alias("o"), F.lit(dt).alias("o_dt"), F.lit(lang).alias("o_lang"), F.lit(False).alias("inferred")]


def table_quads(df: DataFrame, m: TableMap, g: str = "", base: str = BASE, typed: bool = True) -> DataFrame:
    """Quads of one table; null cells give none."""
    key = F.xxhash64(*df.columns) if m.key == "xxhash64(*)" else F.col(m.key)
    df = df.withColumn("_s", uri(m.kind, key))
    parts = [df.select(*quad(g, F.col("_s"), T.RDF + "type", T.IRI, F.lit(base + m.kind.capitalize())))] if typed else []
    if m.type_column:
        parts.append(df.filter(F.col(m.type_column).isNotNull()).select(*quad(g, F.col("_s"), T.RDF + "type", T.IRI, F.concat(F.lit(base + "PartType/"), F.url_encode(F.col(m.type_column))))))
    kinds = dict(df.dtypes)
    for c in m.literals:
        dt = DATATYPES["timestamp" if kinds[c].startswith("timestamp") else kinds[c]]
        parts.append(df.filter(F.col(c).isNotNull()).select(*quad(g, F.col("_s"), base + c, T.LITERAL, lexical(df, c), dt)))
    for name, (target, c) in m.links.items():
        parts.append(df.filter(F.col(c).isNotNull()).select(*quad(g, F.col("_s"), base + name, T.IRI, uri(target, F.col(c)))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def shop(spark: SparkSession, sf_dir: str, tables: list[str] | None = None, g: str = "") -> DataFrame:
    """All mapped tables, or those named, as one graph."""
    out = None
    for m in MAPS:
        if tables is None or m.name in tables:
            part = table_quads(spark.read.parquet(f"{sf_dir}/{m.name}.parquet"), m, g, typed=m.name != "labels")
            out = part if out is None else out.unionAll(part)
    return out


@dataclass(frozen=True)
class Hidden:
    """A table column behind a variable: kind is key (of: the IRI's prefix), long, double, string or time (of: the datatype)."""

    column: str
    kind: str
    of: str


def term_of(h: Hidden, col: Column) -> Column:
    """The term that a hidden column stands for."""
    if h.kind == "key":
        return T.struct(T.IRI, F.concat(F.lit(h.of), col.cast("string")))
    lex = F.date_format(col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss") if h.of == T.XSD_DATETIME else col.cast("string")
    return T.struct(T.LITERAL, lex, h.of)


@dataclass
class Mapped:
    """A table of a mapped graph, for the compiler to scan as it is. Its key has to be unique."""

    df: DataFrame
    m: TableMap
    g: str = ""
    typed: bool = True
    base: str = BASE

    def serves(self, p: tuple, o: tuple) -> bool:
        """Whether a pattern's predicate is one of this table's columns, or its class."""
        if p[0] != "iri":
            return False
        if p[1] == T.RDF + "type":
            return self.typed and o == ("term", (T.IRI, self.base + self.m.kind.capitalize(), "", ""))
        return p[1].startswith(self.base) and (p[1][len(self.base) :] in self.m.literals or p[1][len(self.base) :] in self.m.links)

    def _made(self, name: str) -> tuple[Column, Hidden]:
        """The column of a predicate and what it stands for."""
        if name in self.m.links:
            target, column = self.m.links[name]
            return F.col(column), Hidden("", "key", f"urn:{target}:")
        kind = dict(self.df.dtypes)[name]
        kind = "timestamp" if kind.startswith("timestamp") else kind
        return F.col(name), Hidden("", {"bigint": "long", "int": "long", "date": "time", "timestamp": "time"}.get(kind, kind), DATATYPES[kind])

    def scan(self, s: str, triples: list[tuple]) -> tuple[DataFrame, list[str], dict[str, Hidden]]:
        """All these patterns about ?s in one scan: rows, variables, and the columns behind them."""
        rows, made = self.df, {s: (F.xxhash64(*self.df.columns) if self.m.key == "xxhash64(*)" else F.col(self.m.key), Hidden("", "key", f"urn:{self.m.kind}:"))}
        for _, p, o in triples:
            if p[1] == T.RDF + "type":
                continue
            col, h = self._made(p[1][len(self.base) :])
            if o[0] == "var":
                rows, made[o[1]] = rows.filter(col.isNotNull()), (col, h)
            else:
                rows = rows.filter(self._equals(col, h, o[1]))
        rows = rows.select(*[x.alias(f"_h_{v}") for v, (x, _) in made.items()])
        hidden = {v: Hidden(f"_h_{v}", h.kind, h.of) for v, (_, h) in made.items()}
        return rows.select(*[term_of(h, F.col(f"`{h.column}`")).alias(v) for v, h in hidden.items()], *[F.col(f"`{h.column}`") for h in hidden.values()]), list(made), hidden

    def _equals(self, col: Column, h: Hidden, term: tuple) -> Column:
        kind, lex, dt, _ = term
        if h.kind == "key":
            if kind != T.IRI or not lex.startswith(h.of):
                return F.lit(False)
            lex = lex[len(h.of) :]
        elif kind != T.LITERAL or dt != h.of:
            return F.lit(False)
        if dict(self.df.select(col.alias("c")).dtypes)["c"] in ("bigint", "int"):
            return col == int(lex) if lex.lstrip("-").isdigit() and str(int(lex)) == lex and len(lex) < 19 else F.lit(False)
        return col == lex if h.kind in ("string", "key") else term_of(h, col)["lex"] == lex


def mapped(spark: SparkSession, sf_dir: str, tables: list[str] | None = None, g: str = "") -> list[Mapped]:
    """The tables of shop(), for the compiler."""
    return [Mapped(spark.read.parquet(f"{sf_dir}/{m.name}.parquet"), m, g, m.name != "labels") for m in MAPS if tables is None or m.name in tables]


def records(df: DataFrame, subject: str, kind: str, g: str, fields: dict[str, tuple[str, str]], base: str = BASE) -> DataFrame:
    """Extraction records -> quads: fields maps a column to (predicate, 'iri' or a datatype); arrays give a quad an item."""
    parts = [df.select(*quad(g, F.col(subject), T.RDF + "type", T.IRI, F.lit(base + kind)))]
    for c, (predicate, what) in fields.items():
        rows = df.select(F.col(subject), F.explode(c).alias(c)) if dict(df.dtypes)[c].startswith("array") else df
        rows = rows.filter(F.col(c).isNotNull())
        parts.append(rows.select(*quad(g, F.col(subject), base + predicate, T.IRI if what == "iri" else T.LITERAL, F.col(c).cast("string"), "" if what == "iri" else what)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
