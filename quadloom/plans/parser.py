"""SPARQL 1.1 text -> syntax tree (plain tuples), for queries and updates."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from quadloom.functions.terms import BNODE, IRI, LANG_STRING, LITERAL, RDF, WELL_KNOWN, XSD, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER, XSD_STRING


class SparqlError(ValueError):
    """The text isn't SPARQL that this engine runs."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<var>[?$]\w+)
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<bnode>_:[\w.-]*\w)
  |(?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  |(?P<pname>(?:[A-Za-z_][\w.-]*)?:(?:(?:[\w%:]|\\.)(?:(?:[\w.:%-]|\\.)*(?:[\w:%-]|\\.))?)?)
  |(?P<word>[A-Za-z_][\w]*)
  |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?])""",
    re.X | re.S,
)
_ESC = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def unquote(text: str) -> str:
    body = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]

    def one(m: re.Match) -> str:
        if m[1] in _ESC:
            return _ESC[m[1]]
        if m[2]:
            return chr(int(m[2], 16))
        raise SparqlError(f"bad escape {m[0]}")

    return re.sub(r"\\(?:([^uU])|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))", lambda m: chr(int(m[3], 16)) if m[3] else one(m), body, flags=re.S)


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    pattern: tuple
    project: list = field(default_factory=list)  # (name, expression or None); empty: *
    distinct: bool = False
    template: list = field(default_factory=list)
    group: list = field(default_factory=list)  # (name, expression)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    default_graphs: list = field(default_factory=list)
    named_graphs: list = field(default_factory=list)
    describe: list = field(default_factory=list)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"cannot read {text[at:at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base = 0, ""
        self.prefixes = WELL_KNOWN | (prefixes or {})
        self.fresh = itertools.count()

    # --- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, text = self.peek(ahead)
        return kind == "word" and text.upper() in words

    def take_word(self, *words: str) -> str | None:
        return self.next()[1].upper() if self.is_word(*words) else None

    def take(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise SparqlError(f"expected {op!r}, found {self.peek()[1]!r}")

    def need_word(self, *words: str) -> str:
        found = self.take_word(*words)
        if not found:
            raise SparqlError(f"expected {' or '.join(words)}, found {self.peek()[1]!r}")
        return found

    # --- terms
    def prologue(self) -> None:
        while True:
            if self.take_word("PREFIX"):
                name, iri = self.next()[1], self.next()[1]
                self.prefixes = self.prefixes | {name[:-1]: iri[1:-1]}
            elif self.take_word("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                return

    def iri(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            inner = text[1:-1]
            return inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else self.base + inner
        if kind == "pname":
            name, _, rest = text.partition(":")
            if name not in self.prefixes:
                raise SparqlError(f"unknown prefix {name}:")
            return self.prefixes[name] + rest.replace("\\", "")
        raise SparqlError(f"expected an IRI, found {text!r}")

    def term(self) -> tuple:
        """('var', name) or ('term', (kind, lex, datatype, language))."""
        kind, text = self.peek()
        if kind == "var":
            self.at += 1
            return ("var", text[1:])
        if kind in ("iri", "pname"):
            return ("term", (IRI, self.iri(), "", ""))
        if kind == "bnode":
            self.at += 1
            return ("var", "_:" + text[2:])
        if kind == "str":
            self.at += 1
            lex = unquote(text)
            if self.peek()[0] == "lang":
                return ("term", (LITERAL, lex, LANG_STRING, self.next()[1][1:].lower()))
            if self.take("^^"):
                return ("term", (LITERAL, lex, self.iri(), ""))
            return ("term", (LITERAL, lex, XSD_STRING, ""))
        sign = ""
        if kind == "op" and text in "+-" and self.peek(1)[0] == "num":
            self.at += 1
            sign, (kind, text) = text, self.peek()
        if kind == "num":
            self.at += 1
            dt = XSD_DOUBLE if "e" in text.lower() else XSD_DECIMAL if "." in text else XSD_INTEGER
            return ("term", (LITERAL, sign.replace("+", "") + text, dt, ""))
        if self.is_word("TRUE", "FALSE"):
            return ("term", (LITERAL, self.next()[1].lower(), XSD_BOOLEAN, ""))
        raise SparqlError(f"expected a term, found {text!r}")

    def new_var(self) -> tuple:
        return ("var", f"_:b{next(self.fresh)}")

    # --- queries
    def query(self) -> Query:
        self.prologue()
        form = self.need_word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        out = self.select() if form == "SELECT" else Query(form, ("group", []))
        if form == "CONSTRUCT":
            short = self.is_word("WHERE", "FROM")
            if not short:
                self.need("{")
                out.template = self.triples_until()
            self.dataset(out)
            self.take_word("WHERE")
            if short:
                self.need("{")
                out.template = self.triples_until()
                out.pattern = ("group", [("bgp", out.template)])
            else:
                out.pattern = self.group()
            self.modifiers(out)
        elif form == "ASK":
            self.dataset(out)
            self.take_word("WHERE")
            out.pattern = self.group()
            self.modifiers(out)
        elif form == "DESCRIBE":
            if not self.take("*"):
                while self.peek()[0] in ("var", "iri", "pname"):
                    out.describe.append(self.term())
            self.dataset(out)
            if self.take_word("WHERE") or self.peek() == ("op", "{"):
                out.pattern = self.group()
            self.modifiers(out)
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def dataset(self, out: Query) -> None:
        while self.take_word("FROM"):
            (out.named_graphs if self.take_word("NAMED") else out.default_graphs).append(self.iri())

    def select(self) -> Query:
        """After the word SELECT."""
        out = Query("SELECT", ("group", []))
        out.distinct = self.take_word("DISTINCT", "REDUCED") == "DISTINCT"
        if not self.take("*"):
            while True:
                if self.peek()[0] == "var":
                    out.project.append((self.next()[1][1:], None))
                elif self.take("("):
                    e = self.expression()
                    self.need_word("AS")
                    out.project.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    break
            if not out.project:
                raise SparqlError("SELECT of nothing")
        self.dataset(out)
        self.take_word("WHERE")
        out.pattern = self.group()
        self.modifiers(out)
        return out

    def modifiers(self, out: Query) -> None:
        if self.take_word("GROUP"):
            self.need_word("BY")
            while True:
                if self.peek()[0] == "var":
                    name = self.next()[1][1:]
                    out.group.append((name, ("var", name)))
                elif self.take("("):
                    e = self.expression()
                    name = self.next()[1][1:] if self.take_word("AS") else f"_g{next(self.fresh)}"
                    out.group.append((name, e))
                    self.need(")")
                elif self.peek()[0] == "word" and self.peek(1) == ("op", "(") and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET"):
                    out.group.append((f"_g{next(self.fresh)}", self.primary()))
                else:
                    break
        if self.take_word("HAVING"):
            while self.peek() == ("op", "(") or self.peek()[0] == "word" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES"):
                out.having.append(self.primary())
        if self.take_word("ORDER"):
            self.need_word("BY")
            while True:
                way = self.take_word("ASC", "DESC")
                if not way and not (self.peek()[0] == "var" or self.peek() == ("op", "(") or self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and not self.is_word("LIMIT", "OFFSET", "VALUES")):
                    break
                out.order.append((self.primary(), way == "DESC"))
        while word := self.take_word("LIMIT", "OFFSET"):
            setattr(out, word.lower(), int(self.next()[1]))
        if self.take_word("VALUES"):
            out.pattern = ("group", [out.pattern, self.values()])

    # --- patterns
    def group(self) -> tuple:
        self.need("{")
        if self.is_word("SELECT"):
            self.at += 1
            inner = self.select()
            self.need("}")
            return ("group", [("sub", inner)])
        items: list[tuple] = []
        while not self.take("}"):
            if self.peek()[0] == "end":
                raise SparqlError("unbalanced braces")
            if self.take_word("OPTIONAL"):
                items.append(("optional", self.group()))
            elif self.take_word("MINUS"):
                items.append(("minus", self.group()))
            elif self.take_word("FILTER"):
                items.append(("filter", self.primary()))
            elif self.take_word("BIND"):
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                items.append(("bind", self.next()[1][1:], e))
                self.need(")")
            elif self.take_word("GRAPH"):
                g = self.term()
                items.append(("graph", g, self.group()))
            elif self.take_word("VALUES"):
                items.append(self.values())
            elif self.is_word("SERVICE"):
                raise SparqlError("SERVICE is not supported: there is no federation here")
            elif self.peek() == ("op", "{"):
                out = self.group()
                while self.take_word("UNION"):
                    out = ("union", out, self.group())
                items.append(out)
            elif self.take("."):
                continue
            else:
                triples: list[tuple] = []
                self.same_subject(triples)
                if items and items[-1][0] == "bgp":
                    items[-1][1].extend(triples)
                else:
                    items.append(("bgp", triples))
        return ("group", items)

    def values(self) -> tuple:
        if self.peek()[0] == "var":
            names, single = [self.next()[1][1:]], True
        else:
            self.need("(")
            names, single = [], False
            while not self.take(")"):
                names.append(self.next()[1][1:])
        self.need("{")
        rows = []
        while not self.take("}"):
            if not single:
                self.need("(")
            row = [None if self.take_word("UNDEF") else self.term()[1] for _ in names]
            if not single:
                self.need(")")
            rows.append(row)
        return ("values", names, rows)

    def triples_until(self) -> list[tuple]:
        out: list[tuple] = []
        while not self.take("}"):
            if not self.take("."):
                self.same_subject(out)
        return out

    def same_subject(self, out: list[tuple]) -> None:
        if self.peek() in (("op", "["), ("op", "(")):
            s = self.node(out)
            if self.peek() in (("op", "."), ("op", "}")) or self.peek()[0] == "end":
                return
        else:
            s = self.term()
        self.properties(s, out)

    def node(self, out: list[tuple]) -> tuple:
        if self.take("["):
            s = self.new_var()
            if not self.take("]"):
                self.properties(s, out)
                self.need("]")
            return s
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            rest = ("term", (IRI, RDF + "nil", "", ""))
            for item in reversed(items):
                cell = self.new_var()
                out.append((cell, ("iri", RDF + "first"), item))
                out.append((cell, ("iri", RDF + "rest"), rest))
                rest = cell
            return rest
        return self.term()

    def properties(self, s: tuple, out: list[tuple]) -> None:
        while True:
            p = ("pvar", self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                out.append((s, p, self.node(out)))
                if not self.take(","):
                    break
            while self.take(";"):
                pass
            if self.peek() in (("op", "."), ("op", "}"), ("op", "]")) or self.peek()[0] == "end" or self.is_word("FILTER", "OPTIONAL", "MINUS", "GRAPH", "BIND", "VALUES", "UNION") or self.peek() == ("op", "{"):
                return
            if self.tokens[self.at - 1] != ("op", ";"):
                return

    # --- paths
    def path(self) -> tuple:
        out = self.path_sequence()
        while self.take("|"):
            out = ("alt", out, self.path_sequence())
        return out

    def path_sequence(self) -> tuple:
        out = self.path_step()
        while self.take("/"):
            out = ("seq", out, self.path_step())
        return out

    def path_step(self) -> tuple:
        if self.take("^"):
            return ("inv", self.path_step())
        if self.take("!"):
            items = []
            if self.take("("):
                while not self.take(")"):
                    items.append((self.take("^"), self.path_name()))
                    self.take("|")
            else:
                items.append((self.take("^"), self.path_name()))
            out = ("neg", items)
        elif self.take("("):
            out = self.path()
            self.need(")")
        else:
            out = ("iri", self.path_name())
        for op, name in (("*", "star"), ("+", "plus"), ("?", "maybe")):
            if self.take(op):
                return (name, out)
        return out

    def path_name(self) -> str:
        if self.peek() == ("word", "a"):
            self.at += 1
            return RDF + "type"
        return self.iri()

    # --- expressions
    def expression(self) -> tuple:
        out = self.and_()
        while self.take("||"):
            out = ("or", out, self.and_())
        return out

    def and_(self) -> tuple:
        out = self.relation()
        while self.take("&&"):
            out = ("and", out, self.relation())
        return out

    def relation(self) -> tuple:
        out = self.sum_()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return ("cmp", op, out, self.sum_())
        negated = self.is_word("NOT") and self.is_word("IN", ahead=1)
        if negated:
            self.at += 1
        if self.take_word("IN"):
            found = ("in", out, self.arguments())
            return ("not", found) if negated else found
        return out

    def sum_(self) -> tuple:
        out = self.product()
        while True:
            if self.take("+"):
                out = ("math", "+", out, self.product())
            elif self.take("-"):
                out = ("math", "-", out, self.product())
            else:
                return out

    def product(self) -> tuple:
        out = self.unary()
        while True:
            if self.take("*"):
                out = ("math", "*", out, self.unary())
            elif self.take("/"):
                out = ("math", "/", out, self.unary())
            else:
                return out

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("math", "-", ("term", (LITERAL, "0", XSD_INTEGER, "")), self.unary())
        self.take("+")
        return self.primary()

    def arguments(self) -> list[tuple]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self) -> tuple:
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        negated = self.is_word("NOT") and self.is_word("EXISTS", ahead=1)
        if negated:
            self.at += 1
        if self.take_word("EXISTS"):
            return ("exists", self.group(), negated)
        kind, text = self.peek()
        if kind == "word" and text.upper() in AGGREGATES and self.peek(1) == ("op", "("):
            return self.aggregate(self.next()[1].upper())
        if kind == "word" and self.peek(1) == ("op", "("):
            self.at += 1
            return ("call", text.upper(), self.arguments())
        if kind in ("iri", "pname"):
            name = self.iri()
            if self.peek() == ("op", "("):
                return ("cast", name, self.arguments())
            return ("term", (IRI, name, "", ""))
        return self.term()

    def aggregate(self, name: str) -> tuple:
        self.need("(")
        distinct = self.take_word("DISTINCT") is not None
        what = None if self.take("*") else self.expression()
        joint = " "
        if self.take(";"):
            self.need_word("SEPARATOR")
            self.need("=")
            joint = unquote(self.next()[1])
        self.need(")")
        return ("agg", name, distinct, what, joint)

    # --- updates
    def updates(self) -> list[tuple]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.update())
            self.take(";")

    def quads(self) -> list[tuple]:
        """{ triples, GRAPH g { triples } } -> (graph or None, s, p, o)."""
        self.need("{")
        out: list[tuple] = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take_word("GRAPH"):
                g = self.term()
                self.need("{")
                out += [(g, *t) for t in self.triples_until()]
            else:
                triples: list[tuple] = []
                self.same_subject(triples)
                out += [(None, *t) for t in triples]
        return out

    def graph_ref(self) -> tuple:
        if word := self.take_word("DEFAULT", "NAMED", "ALL"):
            return (word, None)
        self.take_word("GRAPH")
        return ("GRAPH", self.iri())

    def update(self) -> tuple:
        if self.take_word("INSERT"):
            if self.take_word("DATA"):
                return ("insert_data", self.quads())
            return self.modify(None, [], self.quads())
        if self.take_word("WITH"):
            graph = self.iri()
            removed = self.quads() if self.take_word("DELETE") else []
            return self.modify(graph, removed, self.quads() if self.take_word("INSERT") else [])
        if self.take_word("DELETE"):
            if self.take_word("DATA"):
                return ("delete_data", self.quads())
            if self.take_word("WHERE"):
                start = self.at
                removed = self.quads()
                self.at = start
                return ("modify", None, removed, [], self.group(), ([], []))
            removed = self.quads()
            return self.modify(None, removed, self.quads() if self.take_word("INSERT") else [])
        word = self.need_word("DROP", "CLEAR", "CREATE", "LOAD", "COPY", "MOVE", "ADD")
        silent = self.take_word("SILENT") is not None
        if word in ("DROP", "CLEAR", "CREATE"):
            return (word.lower(), silent, self.graph_ref())
        if word == "LOAD":
            source = self.iri()
            return ("load", silent, source, self.graph_ref()[1] if self.take_word("INTO") else None)
        source = self.graph_ref()
        self.need_word("TO")
        return ("transfer", word, silent, source, self.graph_ref())

    def modify(self, graph: str | None, removed: list, added: list) -> tuple:
        using, named = [], []
        while self.take_word("USING"):
            (named if self.take_word("NAMED") else using).append(self.iri())
        self.need_word("WHERE")
        return ("modify", graph, removed, added, self.group(), (using, named))


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[tuple]:
    return Parser(text, prefixes).updates()


def has_graph_scope(node) -> bool:
    """Whether a parsed query names graphs itself, by GRAPH or FROM, at any depth."""
    if isinstance(node, Query):
        return bool(node.default_graphs or node.named_graphs) or has_graph_scope(node.pattern)
    if isinstance(node, (tuple, list)):
        return (len(node) > 0 and isinstance(node, tuple) and node[0] == "graph") or any(has_graph_scope(x) for x in node)
    return False


_PARTS = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|<[^<>"{}|^`\s]*>|#[^\n]*|[{}]', re.S)


def scoped_text(text: str, graph: str) -> str | None:
    """A query's text with its outermost body put into GRAPH; null if it has none. Braces in strings, IRIs and comments don't count."""
    braces = [m for m in _PARTS.finditer(text) if m[0] in "{}"]
    depth = 0
    for m in braces:
        depth += 1 if m[0] == "{" else -1
        if depth == 0 and m[0] == "}":
            begin = braces[0].end()
            return f"{text[:begin]} GRAPH <{graph}> {{{text[begin : m.start()]}}} {text[m.start() :]}"
    return None
