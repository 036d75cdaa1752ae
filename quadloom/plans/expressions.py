"""SPARQL expressions -> Spark columns.

An expression compiles to a Value of one of four shapes: a term struct, a number (with its
datatype), a string, or a boolean; conversions between them happen where an operator asks. A null
is an error or an unbound variable, which gives SPARQL's three-valued logic: FILTER drops nulls, and
|| and && recover from them as SQL's do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.plans.parser import SparqlError


EXACT = "decimal(38,6)"


@dataclass
class Value:
    shape: str  # term, num, str, bool
    col: Column
    dt: Column | None = None  # of a number
    dec: Column | None = None  # of a number: its exact value, null where it has none
    native: Column | None = None  # the table column that a term was made of, or a column of whole numbers
    kind: str = ""  # of native: long, double, string or time
    const: tuple | None = None  # of a term: as it stands in the query

    def term(self) -> Column:
        if self.shape == "term":
            return self.col
        if self.shape == "bool":
            return T.literal(self.col.cast("string"), T.XSD_BOOLEAN)
        if self.shape == "str":
            return T.literal(self.col)
        whole = F.when((self.dt == T.XSD_INTEGER) | ((self.dt == T.XSD_DECIMAL) & (self.col == F.floor(self.col))), self.col.try_cast("decimal(38,0)").cast("string")).otherwise(self.col.cast("string"))
        if self.dec is not None:
            digits = F.regexp_replace(F.regexp_replace(self.dec.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
            whole = F.when(self.dec.isNotNull() & self.dt.isin(T.XSD_INTEGER, T.XSD_DECIMAL), digits).otherwise(whole)
        return T.term(T.LITERAL, F.when(self.col.isNotNull(), whole), self.dt)

    def num(self) -> Column:
        if self.kind in ("long", "double"):
            return self.native.cast("double")
        return self.col if self.shape == "num" else T.number(self.col) if self.shape == "term" else F.lit(None).cast("double")

    def exact(self) -> Column:
        """Value of an integer, or of a decimal of up to six places; null for others."""
        if self.shape == "num":
            return self.dec if self.dec is not None else F.lit(None).cast(EXACT)
        if self.kind:
            return self.native.cast(EXACT) if self.kind == "long" else F.lit(None).cast(EXACT)
        return T.exact(self.col) if self.shape == "term" else F.lit(None).cast(EXACT)

    def num_dt(self) -> Column:
        if self.shape == "num":
            return self.dt
        if self.shape == "term":
            return F.when(self.col["dt"].isin(*T.INTEGERS), T.XSD_INTEGER).otherwise(self.col["dt"])
        return F.lit(T.XSD_DOUBLE)

    def moment(self) -> Column:
        return self.native.cast("timestamp") if self.kind == "time" else T.moment(self.term())

    def text(self) -> Column:
        """STR() of the value."""
        return self.native if self.kind == "string" else self.col if self.shape == "str" else self.term()["lex"]

    def string(self) -> Column:
        """Text of a string literal; an error for anything else."""
        if self.kind == "string":
            return self.native
        if self.shape == "term":
            return F.when((self.col["kind"] == T.LITERAL) & self.col["dt"].isin(T.XSD_STRING, T.LANG_STRING), self.col["lex"])
        return self.col if self.shape == "str" else F.lit(None).cast("string")

    def plain(self) -> tuple[str, Column] | None:
        """Class of the value (num, str, time) and a Spark column of it, where both are known from the plan."""
        if self.kind:
            return {"long": "num", "double": "num", "string": "str", "time": "time"}[self.kind], self.native.cast("timestamp") if self.kind == "time" else self.native
        if self.const is None or self.const[0] != T.LITERAL:
            return None
        _, lex, dt, _ = self.const
        if dt == T.XSD_STRING:
            return "str", F.lit(lex)
        if dt in T.INTEGERS and lex.lstrip("+-").isdigit() and len(lex) < 18:
            return "num", F.lit(int(lex))
        if dt in T.NUMERIC:
            return "num", F.lit(lex).try_cast("double")
        return ("time", F.lit(lex).try_cast("timestamp")) if dt in (T.XSD_DATE, T.XSD_DATETIME) else None

    def truth(self) -> Column:
        """Effective boolean value."""
        if self.shape == "bool":
            return self.col
        if self.shape == "num":
            return (self.col != 0) & ~F.isnan(self.col)
        if self.shape == "str":
            return self.col != ""
        t = self.col
        return (
            F.when((t["kind"] == T.LITERAL) & (t["dt"] == T.XSD_BOOLEAN), t["lex"].isin("true", "1"))
            .when(T.is_numeric(t), F.coalesce((T.number(t) != 0) & ~F.isnan(T.number(t)), F.lit(False)))
            .when((t["kind"] == T.LITERAL) & t["dt"].isin(T.XSD_STRING, T.LANG_STRING), t["lex"] != "")
        )


def boolean(col: Column) -> Value:
    return Value("bool", col)


def string(col: Column) -> Value:
    return Value("str", col)


def integer(col: Column) -> Value:
    return Value("num", col.cast("double"), F.lit(T.XSD_INTEGER), col.cast(EXACT), col, "long")


class Expressions:
    """columns: by variable, the term column; aggregates: by aggregate expression (as text), a Value;
    native: by variable, the table column behind it and that column's kind; flags: by EXISTS (as text), whether it holds."""

    def __init__(self, columns: dict[str, Column], aggregates: dict[str, Value] | None = None, native: dict[str, tuple[Column, str]] | None = None, flags: dict[str, Column] | None = None):
        self.columns, self.aggregates, self.native, self.flags = columns, aggregates or {}, native or {}, flags or {}

    def __call__(self, e: tuple) -> Value:
        kind = e[0]
        if kind == "agg":
            if repr(e) not in self.aggregates:
                raise SparqlError("an aggregate is not allowed here")
            return self.aggregates[repr(e)]
        if kind == "var":
            native, of = self.native.get(e[1], (None, ""))
            return Value("term", self.columns.get(e[1], F.lit(None).cast(T.TERM)), native=native, kind=of)
        if kind == "term":
            return Value("term", T.constant(e[1]), const=e[1])
        if kind == "exists" and repr(e) in self.flags:
            return boolean(self.flags[repr(e)])
        if kind == "or":
            return boolean(self(e[1]).truth() | self(e[2]).truth())
        if kind == "and":
            return boolean(self(e[1]).truth() & self(e[2]).truth())
        if kind == "not":
            return boolean(~self(e[1]).truth())
        if kind == "cmp":
            return boolean(compare(e[1], self(e[2]), self(e[3])))
        if kind == "in":
            left = self(e[1])
            found = F.lit(False)
            for item in e[2]:
                found = found | compare("=", left, self(item))
            return boolean(found)
        if kind == "math":
            return arithmetic(e[1], self(e[2]), self(e[3]))
        if kind == "cast":
            return cast(e[1], self(e[2][0]))
        if kind == "call":
            return self.call(e[1], e[2])
        raise SparqlError(f"{kind} is not supported in an expression")

    def call(self, name: str, args: list) -> Value:
        if name == "BOUND":
            return boolean(self(args[0]).col.isNotNull())
        if name == "COALESCE":
            return Value("term", F.coalesce(*[self(a).term() for a in args]))
        if name == "IF":
            test = self(args[0]).truth()
            return Value("term", F.when(test, self(args[1]).term()).when(~test, self(args[2]).term()))
        v = [self(a) for a in args]
        if name in _FUNCTIONS:
            return _FUNCTIONS[name](*v)
        raise SparqlError(f"unknown function {name}")


def compare(op: str, a: Value, b: Value) -> Column:
    """Numbers and times by value, other literals of one datatype by text, else only as equal terms."""
    p, q = a.plain(), b.plain()
    if p and q and p[0] == q[0] and (a.kind or b.kind):  # the table's own columns, so that filters reach the scan
        return _ops(op, p[1], q[1])
    if a.shape == b.shape == "num":
        return F.coalesce(_ops(op, a.exact(), b.exact()), _ops(op, a.col, b.col))
    if a.shape == b.shape and a.shape in ("str", "bool"):
        return _ops(op, a.col, b.col)
    s, t = a.term(), b.term()
    numeric = T.is_numeric(s) & T.is_numeric(t)
    by_value = F.coalesce(_ops(op, a.exact(), b.exact()), _ops(op, a.num(), b.num()))
    m, n = a.moment(), b.moment()
    timed = m.isNotNull() & n.isNotNull()
    same_type = (s["kind"] == T.LITERAL) & (t["kind"] == T.LITERAL) & (s["dt"] == t["dt"]) & (s["lang"] == t["lang"])
    if op in ("=", "!="):
        return F.when(numeric, by_value).when(timed, _ops(op, m, n)).otherwise(_ops(op, s, t))
    return F.when(numeric, by_value).when(timed, _ops(op, m, n)).when(same_type, _ops(op, s["lex"], t["lex"]))


def _ops(op: str, x: Column, y: Column) -> Column:
    return {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = a.num(), b.num()
    both = lambda dt: (a.num_dt() == dt) & (b.num_dt() == dt)
    either_double = a.num_dt().isin(T.XSD_DOUBLE, T.XSD + "float") | b.num_dt().isin(T.XSD_DOUBLE, T.XSD + "float")
    dt = F.when(both(T.XSD_INTEGER), T.XSD_DECIMAL if op == "/" else T.XSD_INTEGER).when(either_double, T.XSD_DOUBLE).otherwise(T.XSD_DECIMAL)
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]()
    d, e = a.exact(), b.exact()
    if op == "*":  # six places hold the product if one side is whole
        dec = F.when((d == F.floor(d)) | (e == F.floor(e)), F.try_multiply(d, e).cast(EXACT))
    else:
        dec = {"+": F.try_add, "-": F.try_subtract}[op](d, e).cast(EXACT) if op != "/" else F.lit(None).cast(EXACT)
    return Value("num", out, dt, dec)


def cast(target: str, v: Value) -> Value:
    if target == T.XSD_STRING:
        return string(v.text())
    if target == T.XSD_BOOLEAN:
        return boolean(F.when(v.text().isin("true", "1"), True).when(v.text().isin("false", "0"), False).otherwise(v.num() != 0))
    if target in T.INTEGERS:
        exact = v.text().try_cast(EXACT)
        return Value("num", F.expr("1d") * _toward_zero(v.text().try_cast("double")), F.lit(T.XSD_INTEGER), _toward_zero(exact).cast(EXACT))
    if target in T.NUMERIC:
        number = v.text().try_cast("double")
        return Value("num", number, F.lit(target), T.exact(T.literal(v.text(), T.XSD_DECIMAL)) if target == T.XSD_DECIMAL else None)
    if target == T.XSD_DATETIME:
        return Value("term", T.literal(F.date_format(v.text().try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), T.XSD_DATETIME))
    if target == T.XSD_DATE:
        return Value("term", T.literal(v.text().try_cast("date").cast("string"), T.XSD_DATE))
    raise SparqlError(f"unknown cast {target}")


def _toward_zero(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def _like(source: Value, text: Column) -> Value:
    """A string with the language of its source."""
    if source.shape != "term":
        return string(text)
    return Value("term", T.term(T.LITERAL, text, source.col["dt"], source.col["lang"]))


def _number_like(v: Value, f: Callable[[Column], Column]) -> Value:
    return Value("num", f(v.num()).cast("double"), v.num_dt(), f(v.exact()).cast(EXACT))


def _concat(*v: Value) -> Value:
    return string(F.concat(*[x.string() for x in v]) if v else F.lit(""))


def _around(before: bool):
    def cut(a: Value, b: Value) -> Value:
        x, y = a.string(), b.string()
        at = F.position(y, x)
        found = F.substr(x, F.lit(1), at - 1) if before else F.substr(x, at + F.length(y))
        return _like(a, F.when(at > 0, found).otherwise(""))

    return cut


def _regex(text: Value, pattern: Value, flags: Value | None = None) -> Value:
    return boolean(F.regexp_like(text.string(), _flagged(pattern, flags)))


def _flagged(pattern: Value, flags: Value | None) -> Column:
    return F.when(flags.string() == "", pattern.string()).otherwise(F.concat(F.lit("(?"), flags.string(), F.lit(")"), pattern.string())) if flags else pattern.string()


def _replace(text: Value, pattern: Value, by: Value, flags: Value | None = None) -> Value:
    return _like(text, F.regexp_replace(text.string(), _flagged(pattern, flags), by.string()))


def _lang_matches(tag: Value, wanted: Value) -> Value:
    t, w = F.lower(tag.text()), F.lower(wanted.text())
    return boolean(F.when(w == "*", t != "").otherwise((t == w) | t.startswith(F.concat(w, F.lit("-")))))


#: Fields of a dateTime as it is written, in its own zone; a date has the first three.
_STAMP = r"^\s*(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?\s*$"
_FIELDS = {"year": 1, "month": 2, "day": 3, "hour": 4, "minute": 5}


def _field(v: Value, group: int) -> Column:
    t = v.term()
    found = F.regexp_extract(t["lex"], _STAMP, group)
    return F.when(T.moment(t).isNotNull() & (found != ""), found)


def _time(field: str):
    return lambda v: integer(getattr(F, field)(v.native) if v.kind == "time" else _field(v, _FIELDS[field]).try_cast("int"))


def _seconds(v: Value) -> Value:
    found = _field(v, 6)
    return Value("num", found.try_cast("double"), F.lit(T.XSD_DECIMAL), found.try_cast(EXACT))


def _timezone(v: Value) -> Value:
    """Of a time with a zone: its offset as a duration, PT0S for none."""
    zone = _field(v, 7)
    hours, minutes = F.substr(zone, F.lit(2), F.lit(2)).try_cast("int"), F.substr(zone, F.lit(5), F.lit(2)).try_cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    offset = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), part(hours, "H"), part(minutes, "M"))
    return Value("term", T.literal(F.when((zone == "Z") | (hours + minutes == 0), "PT0S").when(zone.isNotNull(), offset), T.XSD + "dayTimeDuration"))


def _sha(bits: int):
    return lambda v: string(F.sha2(v.string(), bits))


def _substr(v: Value, start: Value, length: Value | None = None) -> Value:
    begin = start.num().cast("int")
    return _like(v, F.substr(v.string(), begin, length.num().cast("int")) if length else F.substr(v.string(), begin))


_FUNCTIONS = {
    "STR": lambda v: string(v.text()),
    "LANG": lambda v: string(F.when(v.term()["kind"] == T.LITERAL, v.term()["lang"])),
    "DATATYPE": lambda v: Value("term", T.iri(F.when(v.term()["kind"] == T.LITERAL, v.term()["dt"]))),
    "IRI": lambda v: Value("term", T.iri(v.text())),
    "URI": lambda v: Value("term", T.iri(v.text())),
    "BNODE": lambda *v: Value("term", T.term(T.BNODE, v[0].text() if v else F.uuid())),
    "STRDT": lambda v, dt: Value("term", T.term(T.LITERAL, v.string(), dt.text())),
    "STRLANG": lambda v, tag: Value("term", T.term(T.LITERAL, v.string(), T.LANG_STRING, F.lower(tag.string()))),
    "STRLEN": lambda v: integer(F.char_length(v.string())),
    "SUBSTR": _substr,
    "UCASE": lambda v: _like(v, F.upper(v.string())),
    "LCASE": lambda v: _like(v, F.lower(v.string())),
    "STRSTARTS": lambda a, b: boolean(F.startswith(a.string(), b.string())),
    "STRENDS": lambda a, b: boolean(F.endswith(a.string(), b.string())),
    "CONTAINS": lambda a, b: boolean(F.contains(a.string(), b.string())),
    "STRBEFORE": _around(True),
    "STRAFTER": _around(False),
    "ENCODE_FOR_URI": lambda v: string(F.replace(F.replace(F.url_encode(v.string()), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))),
    "CONCAT": _concat,
    "LANGMATCHES": _lang_matches,
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": lambda v: _number_like(v, F.abs),
    "ROUND": lambda v: _number_like(v, lambda x: F.floor(x + F.lit(0.5).cast(EXACT))),
    "CEIL": lambda v: _number_like(v, F.ceil),
    "FLOOR": lambda v: _number_like(v, F.floor),
    "RAND": lambda: Value("num", F.rand(), F.lit(T.XSD_DOUBLE)),
    "NOW": lambda: Value("term", T.literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), T.XSD_DATETIME)),
    "YEAR": _time("year"),
    "MONTH": _time("month"),
    "DAY": _time("day"),
    "HOURS": _time("hour"),
    "MINUTES": _time("minute"),
    "SECONDS": _seconds,
    "TZ": lambda v: string(F.when(T.moment(v.term()).isNotNull(), F.coalesce(_field(v, 7), F.lit("")))),
    "TIMEZONE": _timezone,
    "UUID": lambda: Value("term", T.iri(F.concat(F.lit("urn:uuid:"), F.uuid()))),
    "STRUUID": lambda: string(F.uuid()),
    "MD5": lambda v: string(F.md5(v.string())),
    "SHA1": lambda v: string(F.sha1(v.string())),
    "SHA256": _sha(256),
    "SHA384": _sha(384),
    "SHA512": _sha(512),
    "SAMETERM": lambda a, b: boolean(a.term() == b.term()),
    "ISIRI": lambda v: boolean(v.term()["kind"] == T.IRI),
    "ISURI": lambda v: boolean(v.term()["kind"] == T.IRI),
    "ISBLANK": lambda v: boolean(v.term()["kind"] == T.BNODE),
    "ISLITERAL": lambda v: boolean(v.term()["kind"] == T.LITERAL),
    "ISNUMERIC": lambda v: boolean(F.coalesce(T.number(v.term()).isNotNull(), F.lit(False))),
}
