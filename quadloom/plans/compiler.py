"""SPARQL syntax trees -> DataFrames that Catalyst plans.

A solution sequence is a Solutions: a DataFrame with one term column a variable, and the set of
variables bound in every row. Shared variables bound on both sides join by plain equality, so Spark
picks broadcast, sort-merge or shuffled hash joins. Where a shared variable may be unbound, both
sides are split by which of these variables they bind, and each pair of parts joins by equality of
what both bind; no join compares row with row.

An EXISTS whose group needs variables of the row anywhere inside is decorrelated: the distinct
values that the rows bind to them are joined into the group wherever it begins, each with its own
mark, and the rows meet the marks that are left. An EXISTS in a filter of such a group becomes part of it
where both are plain patterns, and of what a row is only less or more than, the furthest value decides. Variables that come from a mapped table keep its column beside
the term (hidden), and joins, groups and comparisons use that where both sides have one.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Sequence, Set
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.plans.expressions import EXACT, Expressions, Value, integer, string
from quadloom.plans.fixpoint import checkpointed, closure
from quadloom.plans.parser import Query, SparqlError
from quadloom.sources.mapping import Hidden, Mapped, term_of

QUADS = "g string, s_kind tinyint, s string, p string, o_kind tinyint, o string, o_dt string, o_lang string, inferred boolean"
_fresh = itertools.count()


def subject(df: DataFrame | None = None) -> Column:
    return F.struct(F.col("s_kind").alias("kind"), F.col("s").alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"))


def object_() -> Column:
    return F.struct(F.col("o_kind").alias("kind"), F.col("o").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))


def named(col: str) -> Column:
    return F.struct(F.lit(T.IRI).cast("tinyint").alias("kind"), F.col(col).alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"))


@dataclass
class Solutions:
    df: DataFrame
    vars: list[str]
    bound: set[str]
    hidden: dict[str, Hidden] = field(default_factory=dict)

    def columns(self) -> dict[str, Column]:
        return {v: F.col(f"`{v}`") for v in self.vars}

    def expressions(self, values: dict[str, Value] | None = None, flags: dict[str, Column] | None = None) -> Expressions:
        return Expressions(self.columns(), values, {v: (F.col(f"`{h.column}`"), h.kind) for v, h in self.hidden.items() if h.kind != "key"}, flags)

    def visible(self) -> Solutions:
        return Solutions(self.df.select(*self.columns().values()), self.vars, self.bound) if self.hidden else self


#: Functions whose every call is another value.
ONCE = {"BNODE", "RAND", "UUID", "STRUUID"}


def _varies(e) -> bool:
    return isinstance(e, (tuple, list)) and (len(e) > 1 and e[0] == "call" and e[1] in ONCE or any(map(_varies, e)))


def _conjuncts(e: tuple) -> list[tuple]:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def variables(e) -> set[str]:
    """Names of the variables in an expression or pattern."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] in ("var", "pvar"):
        return {e[1]}
    return set().union(*map(variables, e)) if isinstance(e, (tuple, list)) else set()


def inside(e, kind: str) -> list[tuple]:
    """Nodes of a kind in a tree, outermost first; not those below one another."""
    if isinstance(e, tuple) and e and e[0] == kind:
        return [e]
    return [x for part in e for x in inside(part, kind)] if isinstance(e, (tuple, list)) else []


def renamed(e, names: dict[str, str]):
    """The tree with other names for some variables."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] in ("var", "pvar"):
        return (e[0], names.get(e[1], e[1]))
    return type(e)(renamed(x, names) for x in e) if isinstance(e, (tuple, list)) else e


@dataclass(frozen=True)
class Graphs:
    """What a pattern is matched against: default graphs, or one graph, or a variable over named graphs."""

    default: tuple[str, ...] = ("",)
    one: str | None = None
    var: str | None = None
    named: tuple[str, ...] | None = None


class Compiler:
    def __init__(self, quads: DataFrame, graphs: Graphs = Graphs(), maps: list[Mapped] | None = None):
        """maps: the tables of which quads is made, if it is made of mapped tables and nothing else."""
        self.quads, self.spark, self.graphs, self.maps = quads, quads.sparkSession, graphs, maps or []
        self.seed: Solutions | None = None  # inside an EXISTS: its mark and what the rows bind

    # --- queries
    def select(self, q: Query, graphs: Graphs | None = None) -> Solutions:
        graphs = graphs or self._dataset(q)
        out = self.pattern(q.pattern, graphs)
        ordering = [(e, d) for e, d in q.order]
        aggregates = self._aggregates_of(q)
        if q.group or aggregates:
            out, values = self._grouped(out, q, aggregates)
        else:
            values = {}
        for e in q.having:
            out = replace(out, df=out.df.filter(out.expressions(values)(e).truth()))
        names = [n for n, _ in q.project] or [v for v in out.vars if not v.startswith("_")]
        for name, e in q.project:
            if e is not None:
                hidden = {v: h for v, h in out.hidden.items() if v != name}
                out = Solutions(out.df.withColumn(name, out.expressions(values)(e).term()), [*[v for v in out.vars if v != name], name], out.bound, hidden)
            elif name not in out.vars:
                out = Solutions(out.df.withColumn(name, F.lit(None).cast(T.TERM)), [*out.vars, name], out.bound, out.hidden)
        df, keys = out.df, self._order(out, ordering, values)
        sort = lambda key, descending: key.desc_nulls_last() if descending else key.asc_nulls_first()
        if q.distinct:
            # A row's place is that of the first of its equals.
            df = df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*[(F.max if d else F.min)(key).alias(f"_o{k}") for k, (key, d) in enumerate(keys)]) if keys else df.select(*[F.col(f"`{n}`") for n in names]).distinct()
            keys = [(F.col(f"_o{k}"), d) for k, (_, d) in enumerate(keys)]
        if keys:
            df = df.orderBy(*[sort(key, d) for key, d in keys])
        df = df.select(*[F.col(f"`{n}`") for n in names])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, names, out.bound & set(names) if not q.group else set())

    def ask(self, q: Query) -> bool:
        return not self.pattern(q.pattern, self._dataset(q)).df.isEmpty()

    def construct(self, q: Query) -> DataFrame:
        """Distinct triples of the template over all solutions; incomplete ones are left out."""
        found = self.select(replace(q, project=[], template=[]))
        return self.instantiate(found, [(None, *t) for t in q.template], "").select("s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang").distinct()

    def describe(self, q: Query) -> DataFrame:
        """All triples whose subject is one of the resources."""
        graphs = self._dataset(q)
        wanted = None
        for kind, value in q.describe:
            if kind == "term":
                part = self.spark.range(1).select(F.lit(value[1]).alias("s"))
            else:
                found = self.select(replace(q, project=[(value, None)]), graphs)
                part = found.df.select(F.col(f"`{value}`.lex").alias("s"))
            wanted = part if wanted is None else wanted.unionAll(part)
        rows = self._scan(graphs).select("s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang").distinct()
        return rows.join(wanted.distinct(), "s", "left_semi") if wanted is not None else rows.limit(0)

    def _dataset(self, q: Query) -> Graphs:
        if q.default_graphs or q.named_graphs:
            return Graphs(default=tuple(q.default_graphs), named=tuple(q.named_graphs))
        return self.graphs

    def _order(self, out: Solutions, ordering: list, values: dict) -> list[tuple[Column, bool]]:
        """Sort keys, and whether they fall."""
        keys = []
        for e, descending in ordering:
            v = out.expressions(values)(e)
            keys += [(key, descending) for key in ([v.native] if v.kind else T.order_key(v.term()))]
        return keys

    # --- aggregation
    def _aggregates_of(self, q: Query) -> list[tuple]:
        found: dict[str, tuple] = {}

        def look(e) -> None:
            if isinstance(e, tuple) and e and e[0] == "agg":
                found[repr(e)] = e
            elif isinstance(e, (tuple, list)):
                for x in e:
                    look(x)

        look([e for _, e in q.project])
        look(q.having)
        look([e for e, _ in q.order])
        return list(found.values())

    def _grouped(self, out: Solutions, q: Query, aggregates: list[tuple]) -> tuple[Solutions, dict[str, Value]]:
        ex = out.expressions()
        hidden = {name: out.hidden[e[1]] for name, e in q.group if e[0] == "var" and e[1] in out.hidden}
        keys = [F.col(f"`{hidden[name].column}`").alias(f"_h_{name}") if name in hidden else ex(e).term().alias(name) for name, e in q.group]
        hidden = {name: Hidden(f"_h_{name}", h.kind, h.of) for name, h in hidden.items()}
        made, values = [], {}
        for k, e in enumerate(aggregates):
            col, value = self._aggregate(e, ex, f"_a{k}")
            made += col
            values[repr(e)] = value
        df = out.df.groupBy(*keys).agg(*made) if made else out.df.select(*keys).distinct()
        df = df.select("*", *[term_of(h, F.col(f"`{h.column}`")).alias(name) for name, h in hidden.items()])
        names = [n for n, _ in q.group]
        return Solutions(df, names, {n for n, e in q.group if e[0] == "var" and e[1] in out.bound}, hidden), values

    def _aggregate(self, e: tuple, ex: Expressions, name: str) -> tuple[list[Column], Value]:
        _, kind, distinct, what, joint = e
        if kind == "COUNT":
            if what is None:
                whole = F.struct(*ex.columns.values())
                counted = F.count_distinct(whole) if distinct else F.count(F.lit(1))
            else:
                v = ex(what)
                t = v.native if v.kind else v.term()
                counted = F.count_distinct(t) if distinct else F.count(t)
            return [counted.alias(name)], integer(F.col(name))
        v = ex(what)
        if kind in ("SUM", "AVG"):
            x = v.num()
            exact = v.native if v.kind == "long" else v.exact()
            total, whole = (F.sum_distinct(x), F.sum_distinct(exact)) if distinct else (F.sum(x), F.try_sum(exact))
            # The widest datatype among the values: double over decimal over integer.
            width = F.max(F.when(v.num_dt() == T.XSD_INTEGER, 0).when(v.num_dt() == T.XSD_DECIMAL, 1).otherwise(2)) if not v.kind else F.max(F.when(x.isNotNull(), 0 if v.kind == "long" else 2))
            n, w = F.col(name + "n"), F.greatest(F.col(name + "w"), F.lit(1 if kind == "AVG" else 0))
            dt = F.when(F.coalesce(w, F.lit(0)) == 0, T.XSD_INTEGER).when(w == 1, T.XSD_DECIMAL).otherwise(T.XSD_DOUBLE)
            made = [total.alias(name), whole.cast(EXACT).alias(name + "d"), width.alias(name + "w"), (F.count_distinct(x) if distinct else F.count(x)).alias(name + "n"), (F.count_distinct(exact) if distinct else F.count(exact)).alias(name + "e")]
            # Exact where all numbers are; the sum of none is 0.
            dec = F.when(F.col(name + "e") == n, F.coalesce(F.col(name + "d"), F.lit(0).cast(EXACT)))
            col = F.coalesce(dec.cast("double"), F.col(name), F.lit(0.0))
            return made, Value("num", col, dt, dec) if kind == "SUM" else Value("num", F.coalesce(col / F.when(n > 0, n), F.lit(0.0)), dt)
        if kind in ("MIN", "MAX") and v.kind:
            least = (F.min if kind == "MIN" else F.max)(v.native)
            of = {"long": T.XSD_INTEGER, "double": T.XSD_DOUBLE, "string": T.XSD_STRING, "time": T.XSD_DATETIME}[v.kind]
            lex = F.date_format(F.col(name).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss") if v.kind == "time" else F.col(name).cast("string")
            return [least.alias(name), F.first(v.col["dt"]).alias(name + "t")], Value("term", T.literal(F.when(F.col(name + "t") == T.XSD_DATE, F.date_format(F.col(name).cast("timestamp"), "yyyy-MM-dd")).otherwise(lex), F.coalesce(F.col(name + "t"), F.lit(of))))
        t = v.term()
        if kind in ("MIN", "MAX"):
            keyed = F.when(t.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(T.order_key(t))], t.alias("t")))
            return [(F.min(keyed) if kind == "MIN" else F.max(keyed)).alias(name)], Value("term", F.col(name)["t"])
        if kind == "SAMPLE":
            return [F.any_value(t, F.lit(True)).alias(name)], Value("term", F.col(name))
        texts = (F.collect_set if distinct else F.collect_list)(v.text())
        return [F.array_join(F.array_sort(texts), joint).alias(name)], string(F.col(name))

    # --- patterns
    def pattern(self, node: tuple, graphs: Graphs) -> Solutions:
        kind = node[0]
        if kind == "group":
            return self._group(node[1], graphs)
        if kind == "bgp":
            return self._bgp(node[1], graphs)
        if kind == "union":
            a, b = self.pattern(node[1], graphs).visible(), self.pattern(node[2], graphs).visible()
            return Solutions(a.df.unionByName(b.df, allowMissingColumns=True), [*a.vars, *[v for v in b.vars if v not in a.vars]], a.bound & b.bound)
        if kind == "graph":
            return self._graph(node[1], node[2], graphs)
        if kind == "values":
            return self._values(node[1], node[2])
        if kind == "sub":  # what it doesn't project is its own
            return self._seeded_by(None).select(node[1], graphs)
        raise SparqlError(f"unknown pattern {kind}")

    def _group(self, items: list[tuple], graphs: Graphs) -> Solutions:
        out, filters, begun = None, [], self.seed is None
        tests = [e for i in items if i[0] == "filter" for e in _conjuncts(i[1]) if not inside(e, "exists") and not _varies(e)]

        def start() -> Solutions:
            """What there is so far, or one empty row; met with the seed if it wasn't yet."""
            nonlocal begun
            if begun:
                return out or self._unit()
            begun = True
            return self.seed if out is None else self.join(out, self.seed)

        for item in items:
            kind = item[0]
            if kind == "filter":
                filters.append(item[1])
            elif kind == "optional":
                left = start()
                out = self._narrowed(left, item[1], True)._optional(left, item[1], graphs)
            elif kind == "minus":
                left = start()
                out = self._minus(left, self._narrowed(left, item[1]).pattern(item[1], graphs), set(left.vars) & variables(inside(item[1], "bgp") + inside(item[1], "values") + inside(item[1], "sub") + inside(item[1], "bind")))
            elif kind == "bind":
                out = start()
                if item[1] in out.vars:
                    raise SparqlError(f"?{item[1]} is already in scope")
                out = Solutions(out.df.withColumn(item[1], out.expressions()(item[2]).term()), [*out.vars, item[1]], out.bound, out.hidden)
            else:
                inner = self
                if self.seed is not None and kind not in ("bgp", "values", "sub"):
                    out = start()
                    inner = self._narrowed(out, item)
                right = inner._bgp(item[1], graphs, tests) if kind == "bgp" else inner.pattern(item, graphs)
                out = right if out is None else self.join(out, right)
        out = start()
        for e in filters:
            out = self._filter(out, e, graphs)
        return out

    def _unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), [], set())

    def _filter(self, out: Solutions, e: tuple, graphs: Graphs) -> Solutions:
        if e[0] == "and":
            return self._filter(self._filter(out, e[1], graphs), e[2], graphs)
        if e[0] == "exists" or e[0] == "not" and e[1][0] == "exists":
            inner = e if e[0] == "exists" else e[1]
            return replace(out, df=self._existing(out, inner[1], graphs, "left_anti" if inner[2] != (e[0] == "not") else "left_semi"))
        if inside(e, "exists"):
            return self._flagged(out, e, graphs)
        return replace(out, df=out.df.filter(out.expressions()(e).truth()))

    def _seeded_by(self, seed: Solutions | None) -> Compiler:
        if seed is self.seed:
            return self
        other = copy.copy(self)
        other.seed = seed
        return other

    def _narrowed(self, left: Solutions, node: tuple, own_filters_apart: bool = False) -> Compiler:
        """For a group inside a seeded one: no seed if nothing in it asks for what the rows bind, else one with what left binds.

        Only what the group binds itself is added to the seed, so none of its filters sees more than before.
        """
        if self.seed is None:
            return self
        parts = [i for i in node[1] if i[0] != "filter" or inside(i, "exists")] if own_filters_apart else node
        if not variables(inside(parts, "filter") + inside(parts, "bind")) & set(self.seed.vars):
            return self._seeded_by(None)

        def binds(x: tuple) -> set[str]:
            if x[0] == "group":
                return set().union(*[variables(i[1]) for i in x[1] if i[0] == "bgp"])
            return binds(x[1]) & binds(x[2]) if x[0] == "union" else binds(x[2]) if x[0] == "graph" else variables(x[1]) if x[0] == "bgp" else set()

        names = [*self.seed.vars, *sorted((left.bound & binds(node)) - set(self.seed.vars))]
        return self._seeded_by(Solutions(left.df.select(*[F.col(f"`{v}`") for v in names]).distinct(), names, left.bound & set(names)))

    def _existing(self, out: Solutions, group: tuple, graphs: Graphs, how: str) -> DataFrame:
        """Rows of out for which the group of an EXISTS has a solution, or has none."""
        group = self._flat(group, set(out.vars))
        alone = self._seeded_by(None)
        simple = alone._correlated(out, group, graphs)
        if simple is not None:
            return alone._semi(out, simple[0], how, None, simple[1])
        used, mark = [v for v in out.vars if v in variables(group)], f"_mark{next(_fresh)}"
        rows = checkpointed(out.df.select(*[F.col(f"`{v}`") for v in used]).distinct().withColumn(mark, F.monotonically_increasing_id()))
        seed = Solutions(rows, [mark, *used], {mark} | (out.bound & set(used)))
        found = self._seeded_by(seed)._group(group[1], graphs).df.select(mark).distinct()
        # Back to what the rows bind, unbound being equal to unbound.
        hit, names = self._renamed(Solutions(rows.join(found, mark, "left_semi"), used, set()), used)
        same = F.lit(True)
        for v in used:
            same = same & F.col(f"`{v}`").eqNullSafe(F.col(f"`{names[v]}`"))
        return out.df.join(hit, same, how)

    def _flat(self, group: tuple, outer: set[str]) -> tuple:
        """The group of an EXISTS with those of the EXISTS in its filters as parts of it, since only whether there is a solution counts.

        Done where all of them are triple patterns and filters and share a variable; what the inner group alone binds gets a new name.
        """
        if any(i[0] not in ("bgp", "filter") for i in group[1]) or inside(group, "sub"):
            return group
        bound = set().union(*[variables(i[1]) for i in group[1] if i[0] == "bgp"])
        items, todo = [i for i in group[1] if i[0] == "bgp"], [i[1] for i in group[1] if i[0] == "filter"]
        while todo:
            e = todo.pop(0)
            if e[0] == "and":
                todo = [*e[1:], *todo]
                continue
            exists = e if e[0] == "exists" else e[1] if e[0] == "not" and e[1][0] == "exists" else None
            if exists is not None and exists[2] == (e[0] == "not"):
                inner = self._flat(exists[1], outer | bound)
                own = set().union(*[variables(i[1]) for i in inner[1] if i[0] == "bgp"])
                if all(i[0] in ("bgp", "filter") for i in inner[1]) and own & bound:
                    fresh = {v: f"{v}_{next(_fresh)}" for v in own - bound - outer}
                    items += renamed(inner[1], fresh)
                    continue
            items.append(("filter", e))
        return (group[0], items, *group[2:])

    def _furthest(self, a: Solutions, b: Solutions, shared: list[str], conditions: list[tuple]) -> Solutions:
        """b, or the one row for each of its values of the shared variables that decides a lone condition: less or more than the row."""
        if len(conditions) != 1 or conditions[0][0] != "cmp" or conditions[0][1] not in ("<", "<=", ">", ">="):
            return b
        _, op, x, y = conditions[0]
        if y[0] == "var" and y[1] in b.hidden and y[1] not in a.vars:
            x, y, op = y, x, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
        if x[0] != "var" or x[1] in a.vars or x[1] not in b.hidden or b.hidden[x[1]].kind == "key" or variables(y) & (set(b.vars) - set(a.vars)):
            return b
        names, h = [*shared, x[1]], b.hidden[x[1]]
        hidden = {v: b.hidden[v] for v in names if v in b.hidden}
        df = b.df.groupBy(*[F.col(f"`{hidden[v].column if v in hidden else v}`") for v in shared]).agg((F.max if op in (">", ">=") else F.min)(F.col(f"`{h.column}`")).alias(h.column))
        made = [term_of(hidden[v], F.col(f"`{hidden[v].column}`")).alias(v) if v in hidden else F.col(f"`{v}`") for v in names]
        return Solutions(df.select(*made, *[F.col(f"`{k.column}`") for k in hidden.values()]), names, b.bound & set(names), hidden)

    def _correlated(self, out: Solutions, group: tuple, graphs: Graphs) -> tuple[Solutions, list[tuple]] | None:
        """The group of an EXISTS, and those of its filters that need variables of the row; None if more of it needs them."""
        plain = [i for i in group[1] if i[0] != "filter"]
        if variables([inside(i, "filter") + inside(i, "bind") for i in plain]) & set(out.vars):
            return None
        right, conditions = self._group(plain, graphs), []
        outer = set(out.vars) - set(right.vars)
        todo = [i[1] for i in group[1] if i[0] == "filter"]
        while todo:
            e = todo.pop()
            if e[0] == "and":
                todo += e[1:]
            elif inside(e, "exists") and variables(e) & set(out.vars):
                return None
            elif not variables(e) & outer:
                right = self._filter(right, e, graphs)
            else:
                conditions.append(e)
        return right, conditions

    def _flagged(self, out: Solutions, e: tuple, graphs: Graphs) -> Solutions:
        """A filter that combines EXISTS with other tests: each row is marked with whether they hold."""
        row, flags = f"_row{next(_fresh)}", {}
        base = replace(out, df=checkpointed(out.df.withColumn(row, F.monotonically_increasing_id())))
        df = base.df
        for k, found in enumerate({repr(x): x for x in inside(e, "exists")}.values()):
            hit = self._existing(base, found[1], graphs, "left_semi").select(row, F.lit(True).alias(f"{row}_{k}"))
            df = df.join(hit, row, "left")
            flags[repr(found)] = F.coalesce(F.col(f"{row}_{k}"), F.lit(False)) != F.lit(found[2])
        return replace(out, df=df.filter(out.expressions(flags=flags)(e).truth()).select(*[F.col(f"`{c}`") for c in out.df.columns]))

    def _renamed(self, out: Solutions, shared: list[str]) -> tuple[DataFrame, dict[str, str]]:
        tag = next(_fresh)
        names = {v: f"_r{tag}_{v}" for v in shared}
        hidden = {h.column: f"_r{tag}{h.column}" if v in shared else h.column for v, h in out.hidden.items()}
        return out.df.select(*[F.col(f"`{v}`").alias(names.get(v, v)) for v in out.vars], *[F.col(f"`{c}`").alias(x) for c, x in hidden.items()]), names

    def _condition(self, a: Solutions, b: Solutions, shared: list[str], names: dict[str, str]) -> Column:
        """Equality of shared variables, all bound on both sides; of the columns behind them where both have those."""
        cond = F.lit(True)
        for v in shared:
            same = F.col(f"`{v}`") == F.col(f"`{names[v]}`")
            g, h = a.hidden.get(v), b.hidden.get(v)
            if g and h and (g.kind, g.of) == (h.kind, h.of) and g.kind in ("key", "string", "long"):
                same = F.col(f"`{g.column}`") == F.col(f"`{names[v].removesuffix(v)[:-1]}{h.column}`")
            cond = cond & same
        return cond

    def _perhaps(self, a: Solutions, b: Solutions) -> list[str]:
        """Shared variables that may be unbound on a side."""
        return [v for v in a.vars if v in b.vars and not (v in a.bound and v in b.bound)]

    def _parts(self, s: Solutions, perhaps: list[str]) -> list[Solutions]:
        """s by which of these variables its rows bind; those that a part doesn't bind are no variables of it."""
        parts = [replace(s.visible(), bound=set(s.bound))]
        for v in perhaps:
            if v in s.bound:
                continue
            parts = [
                part
                for x in parts
                for part in (
                    Solutions(x.df.filter(F.col(f"`{v}`").isNotNull()), x.vars, x.bound | {v}),
                    Solutions(x.df.filter(F.col(f"`{v}`").isNull()).drop(v), [w for w in x.vars if w != v], x.bound),
                )
            ]
        return parts

    def _with(self, df: DataFrame, has: list[str], every: list[str]) -> DataFrame:
        return df.select(*[F.col(f"`{v}`") if v in has else F.lit(None).cast(T.TERM).alias(v) for v in every])

    def join(self, a: Solutions, b: Solutions) -> Solutions:
        shared = [v for v in a.vars if v in b.vars]
        every = [*a.vars, *[v for v in b.vars if v not in a.vars]]
        if perhaps := self._perhaps(a, b):
            out = None
            for x in self._parts(a, perhaps):
                for y in self._parts(b, perhaps):
                    met = self.join(x, y)
                    df = self._with(met.df, met.vars, every)
                    out = df if out is None else out.unionByName(df)
            return Solutions(out, every, a.bound | b.bound)
        hidden = {v: h for v, h in b.hidden.items() if v not in a.vars} | a.hidden
        kept = [F.col(f"`{h.column}`") for h in hidden.values()]
        if not shared:
            return Solutions(a.df.crossJoin(b.df), every, a.bound | b.bound, hidden)
        right, names = self._renamed(b, shared)
        df = a.df.join(right, self._condition(a, b, shared, names))
        return Solutions(df.select(*[F.col(f"`{v}`") for v in every], *kept), every, a.bound | b.bound, hidden)

    def _optional(self, a: Solutions, group: tuple, graphs: Graphs) -> Solutions:
        """Left join; FILTERs of the optional group are its condition, so they see both sides."""
        items = group[1]
        plain = [i for i in items if i[0] != "filter" or i[1][0] == "exists"]
        conditions = [i[1] for i in items if i[0] == "filter" and i[1][0] != "exists"]
        b = self._group(plain, graphs)
        every = [*a.vars, *[v for v in b.vars if v not in a.vars]]
        own = []
        for e in conditions:  # what only the group's own variables decide is decided before the join
            if variables(e) <= set(b.vars) and not inside(e, "exists"):
                b = self._filter(b, e, graphs)
            else:
                own.append(e)
        if perhaps := self._perhaps(a, b):
            out = None
            for x in self._parts(a, perhaps):
                for y in self._parts(b, perhaps):
                    met, alone = self._left(x, y, own, "inner"), self._left(x, y, own, "left_anti")
                    df = self._with(met.df, met.vars, every)
                    out = df if out is None else out.unionByName(df)
                    x = replace(x, df=alone.df)
                out = out.unionByName(self._with(x.df, x.vars, every))
            return Solutions(out, every, set(a.bound))
        return self._left(a, b, own, "left")

    def _left(self, a: Solutions, b: Solutions, own: list[tuple], how: str) -> Solutions:
        """a and b joined by equality of what they share, under conditions that may use variables of both."""
        shared = [v for v in a.vars if v in b.vars]
        every = [*a.vars, *[v for v in b.vars if v not in a.vars]]
        right, names = self._renamed(b, shared)
        cond = self._condition(a, b, shared, names)
        columns = {v: F.col(f"`{v}`") for v in every}
        for e in own:
            # A variable that neither side has is unbound.
            missing = {v: F.lit(None).cast(T.TERM) for v in variables(e) if v not in columns}
            cond = cond & Expressions(columns | missing)(e).truth()
        df = a.df.join(right, cond, how)
        if how == "left_anti":
            return replace(a, df=df)
        hidden = {v: h for v, h in a.hidden.items() if v in a.bound}
        return Solutions(df.select(*columns.values(), *[F.col(f"`{h.column}`") for h in hidden.values()]), every, set(a.bound) | (b.bound if how == "inner" else set()), hidden)

    def _semi(self, a: Solutions, b: Solutions, how: str, common: set[str] | None = None, conditions: list[tuple] = ()) -> DataFrame:
        """Rows of a with a partner in b, or without; conditions may use variables of both.

        common: a partner has to bind one of these too.
        """
        if perhaps := self._perhaps(a, b):
            out = None
            place = lambda df: df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(T.TERM).alias(c) for c in a.df.columns])
            for x in self._parts(Solutions(a.df, a.vars, a.bound), perhaps):
                for y in self._parts(b, perhaps):
                    if common is not None and not common & set(x.vars) & set(y.vars):
                        continue
                    if how == "left_semi":
                        hit = place(self._semi(x, y, "left_semi", None, conditions))
                        out = hit if out is None else out.unionByName(hit)
                    x = replace(x, df=self._semi(x, y, "left_anti", None, conditions))
                if how == "left_anti":
                    out = place(x.df) if out is None else out.unionByName(place(x.df))
            return out if out is not None else a.df.limit(0)
        shared = [v for v in a.vars if v in b.vars]
        b = self._furthest(a, b, shared, list(conditions))
        used = [v for v in b.vars if v not in a.vars and (v in variables(list(conditions)) or v in a.df.columns)]
        right, names = self._renamed(b, [*shared, *used])
        cond = self._condition(a, b, shared, names)
        for e in conditions:
            known = a.columns() | {v: F.col(f"`{names[v]}`") for v in used}
            missing = {v: F.lit(None).cast(T.TERM) for v in variables(e) if v not in known}
            cond = cond & Expressions(known | missing)(e).truth()
        if not names:
            return a.df.join(right.limit(1), cond, how)
        by_column = not used and common is None and all(v in a.hidden and v in b.hidden for v in shared)
        return a.df.join(right if by_column else right.distinct(), cond, how)

    def _minus(self, a: Solutions, b: Solutions, common: set[str]) -> Solutions:
        """common: the variables of a that the group of the MINUS can bind itself."""
        if self.seed is None:
            common = set(a.vars) & set(b.vars)
        return replace(a, df=self._semi(a, b, "left_anti", common)) if common else a

    def _graph(self, g: tuple, inner: tuple, graphs: Graphs) -> Solutions:
        if g[0] == "term":
            if graphs.named is not None and g[1][1] not in graphs.named:
                return self.pattern(inner, replace(graphs, one="\0nowhere", var=None))
            return self.pattern(inner, replace(graphs, one=g[1][1], var=None))
        return self.pattern(inner, replace(graphs, one=None, var=g[1]))

    def _values(self, names: list[str], rows: list[list]) -> Solutions:
        schema = ", ".join(f"`{n}` {T.TERM}" for n in names)
        df = self.spark.createDataFrame([tuple(r) for r in rows], schema)
        return Solutions(df, names, {n for k, n in enumerate(names) if all(r[k] is not None for r in rows)})

    # --- triples
    def _scan(self, graphs: Graphs) -> DataFrame:
        if graphs.one is not None:
            return self.quads.filter(F.col("g") == graphs.one)
        if graphs.var is not None:
            return self.quads.filter(F.col("g").isin(*graphs.named) if graphs.named is not None else F.col("g") != "")
        return self.quads.filter(F.col("g").isin(*graphs.default)) if graphs.default else self.quads.limit(0)

    def _bgp(self, triples: list[tuple], graphs: Graphs, tests: Sequence[tuple] = ()) -> Solutions:
        """Triple patterns, joined in an order that stays connected and starts with the most selective.

        tests: filters that the group puts on its rows later; a closing path starts only from ends that can pass them.
        """
        if not triples:
            return self._unit()
        triples, middles = self._unfolded(triples)
        parts, triples = self._stars(triples, graphs)

        def names(t: tuple) -> set[str]:
            return {x[1] for x in (t[0], t[2]) if x[0] == "var"} | ({t[1][1]} if t[1][0] == "pvar" else set())

        def cost(t: tuple) -> tuple:
            closing = t[1][0] in ("plus", "star", "maybe", "neg", "alt", "seq", "inv")
            return (closing, 2 * (t[0][0] == "var") + (t[2][0] == "var") + 2 * (t[1][0] == "pvar"))

        ends = lambda t: {x[1] for x in (t[0], t[2]) if x[0] == "var"} if t[1][0] in ("iri", "pvar", "neg") else set()
        left = [(set(x.vars), (False, 2), lambda _, x=x: x, set(x.vars)) for x in parts] + [(names(t), cost(t), lambda known, t=t: self._triple(t, graphs, self._passing(known, tests) if t[1][0] in ("plus", "star") else known, placed), ends(t)) for t in triples]
        out, seen = None, set(graphs.var and [graphs.var] or [])
        # Variables bound to subjects and objects of these graphs: nodes, whatever a path says of them.
        placed: set[str] = set()
        while left:
            best = min([x for x in left if x[0] & seen] or left, key=lambda x: x[1])
            left.remove(best)
            seen |= best[0]
            right = best[2](out)
            placed |= best[3]
            out = right if out is None else self.join(out, right)
        if not middles:
            return out
        keep, hidden = [v for v in out.vars if v not in middles], {v: h for v, h in out.hidden.items() if v not in middles}
        return Solutions(out.df.select(*[F.col(f"`{v}`") for v in keep], *[F.col(f"`{h.column}`") for h in hidden.values()]), keep, out.bound - middles, hidden)

    def _passing(self, known: Solutions | None, tests: Sequence[tuple]) -> Solutions | None:
        """The rows that pass what of these tests is about bound variables alone."""
        for e in tests if known is not None else ():
            if variables(e) and variables(e) <= known.bound:
                known = replace(known, df=known.df.filter(known.expressions()(e).truth()))
        return known

    def _unfolded(self, triples: list[tuple]) -> tuple[list[tuple], set[str]]:
        """Sequences and inverses as patterns of their own, and the variables in between."""
        out, middles, todo = [], set(), list(reversed(triples))
        while todo:
            s, p, o = todo.pop()
            if p[0] == "inv":
                todo.append((o, p[1], s))
            elif p[0] == "seq":
                middle = ("var", f"_:p{next(_fresh)}")
                middles.add(middle[1])
                todo += [(middle, p[2], o), (s, p[1], middle)]
            else:
                out.append((s, p, o))
        return out, middles

    def _stars(self, triples: list[tuple], graphs: Graphs) -> tuple[list[Solutions], list[tuple]]:
        """One scan for all the patterns about a subject that one mapped table serves; and the patterns left."""
        maps = [m for m in self.maps if m.g == graphs.one or graphs.one is None and m.g in graphs.default] if graphs.var is None else []
        folded: dict[tuple, list[tuple]] = {}
        for s in dict.fromkeys(t[0][1] for t in triples if t[0][0] == "var"):
            about = [t for t in triples if t[0] == ("var", s)]
            objects = [t[2][1] for t in about if t[2][0] == "var"]
            plain = [t for t in about if t[1][0] == "iri" and (t[2][0] == "term" or objects.count(t[2][1]) == 1 and t[2][1] != s)]
            serving = [(t, [k for k, m in enumerate(maps) if m.serves(t[1], t[2])]) for t in plain]
            kinds = [{maps[k].m.kind for k in some} for _, some in serving if some]
            kinds = set.intersection(*kinds) if kinds else set()
            if len(kinds) != 1:
                continue
            for t, some in serving:
                mine = [k for k in some if maps[k].m.kind in kinds]
                if len(mine) == 1:
                    folded.setdefault((s, mine[0]), []).append(t)
        done = [t for some in folded.values() for t in some]
        parts = []
        for (s, k), some in folded.items():
            df, names, hidden = maps[k].scan(s, some)
            parts.append(Solutions(df, names, set(names), hidden))
        return parts, [t for t in triples if t not in done]

    def _triple(self, t: tuple, graphs: Graphs, known: Solutions | None = None, placed: Set[str] = frozenset()) -> Solutions:
        """known: what the pattern is going to be joined with; placed: its variables that are nodes of these graphs."""
        s, p, o = t
        if p[0] == "inv":
            return self._triple((o, p[1], s), graphs)
        if p[0] == "seq":
            middle = ("var", f"_:p{next(_fresh)}")
            out = self.join(self._triple((s, p[1], middle), graphs), self._triple((middle, p[2], o), graphs))
            keep = [v for v in out.vars if v != middle[1]]
            return Solutions(out.df.select(*[F.col(f"`{v}`") for v in keep]), keep, out.bound - {middle[1]})
        if p[0] == "alt":
            a, b = self._triple((s, p[1], o), graphs), self._triple((s, p[2], o), graphs)
            return Solutions(a.df.unionByName(b.df), a.vars, a.bound)
        if p[0] in ("plus", "star", "maybe"):
            return self._closing(s, p, o, graphs, known, placed)
        rows = self._scan(graphs)
        if p[0] == "iri":
            rows = rows.filter(F.col("p") == p[1])
        elif p[0] == "neg":
            out = []
            forward = [name for inverse, name in p[1] if not inverse]
            back = [name for inverse, name in p[1] if inverse]
            if forward or not back:
                out.append(self._matched(s, None, o, rows.filter(~F.col("p").isin(*forward)), graphs))
            if back:
                out.append(self._matched(o, None, s, rows.filter(~F.col("p").isin(*back)), graphs))
            if len(out) == 1:
                return out[0]
            return Solutions(out[0].df.unionByName(out[1].df), out[0].vars, out[0].bound)
        return self._matched(s, p[1] if p[0] == "pvar" else None, o, rows, graphs)

    def _matched(self, s: tuple, p_var: str | None, o: tuple, rows: DataFrame, graphs: Graphs) -> Solutions:
        if s[0] == "term":
            rows = rows.filter((F.col("s") == s[1][1]) & (F.col("s_kind") == s[1][0]))
        if o[0] == "term":
            kind, lex, dt, lang = o[1]
            rows = rows.filter((F.col("o") == lex) & (F.col("o_kind") == kind) & (F.col("o_dt") == dt) & (F.col("o_lang") == lang))
        columns: dict[str, Column] = {}
        parts = [(s[1], subject())] if s[0] == "var" else []
        if p_var:
            parts.append((p_var, named("p")))
        if o[0] == "var":
            parts.append((o[1], object_()))
        if graphs.var is not None and graphs.one is None:
            parts.append((graphs.var, named("g")))
        for name, col in parts:
            if name in columns:
                rows = rows.filter(columns[name] == col)
            else:
                columns[name] = col
        return Solutions(rows.select(*[c.alias(n) for n, c in columns.items()]), list(columns), set(columns))

    def _closing(self, s: tuple, p: tuple, o: tuple, graphs: Graphs, known: Solutions | None = None, placed: Set[str] = frozenset()) -> Solutions:
        """p+, p* and p?: distinct pairs, from a constant end or one that is bound already where there is one.

        Under a graph variable a node is (graph, term), so that paths stay within their graph. Nodes are packed
        strings until the pairs are found.
        """
        a, b, g = ("var", f"_:s{next(_fresh)}"), ("var", f"_:o{next(_fresh)}"), graphs.var if graphs.one is None else None
        step = self._triple((a, p[1], b), graphs)
        node = lambda x, of=None: T.packed(x, None if g is None else (F.col(f"`{g}`") if of is None else of)["lex"])
        term = lambda x: T.unpacked(x, g is not None)
        edges = step.df.select(node(F.col(f"`{a[1]}`")).alias("s"), node(F.col(f"`{b[1]}`")).alias("o"))

        def one(constant: tuple, name: str) -> DataFrame:
            """A constant as a node: of every graph."""
            if g is None:
                return self.spark.range(1).select(node(T.constant(constant)).alias(name))
            return self._scan(graphs).select(named("g").alias("of")).distinct().select(node(T.constant(constant), F.col("of")).alias(name))

        def ends(name: str, as_: str) -> DataFrame | None:
            """What is known of this end; under a graph variable, with its graph."""
            if known is None or name not in known.bound or g is not None and g not in known.bound:
                return None
            return known.df.select(node(F.col(f"`{name}`")).alias(as_)).distinct()

        seeds, name = None, None
        if p[0] == "maybe":
            pairs = edges
        elif s[0] == "term":
            pairs = closure(edges, one(s[1], "s"))
        elif o[0] == "term":
            pairs = closure(edges, one(o[1], "o"), backwards=True)
        elif (seeds := ends(s[1], "s")) is not None:
            seeds, name = checkpointed(seeds), s[1]
            pairs = closure(edges, seeds)
        elif (seeds := ends(o[1], "o")) is not None:
            seeds, name = checkpointed(seeds), o[1]
            pairs = closure(edges, seeds, backwards=True)
        else:
            pairs = closure(edges)
        if p[0] == "star" and seeds is not None and name in placed:
            nodes = seeds.toDF("n")
            pairs = pairs.filter("s != o").unionAll(nodes.select(F.col("n").alias("s"), F.col("n").alias("o")))
        elif p[0] in ("star", "maybe"):
            rows = self._scan(graphs)
            nodes = rows.select(node(subject(), named("g")).alias("n")).unionAll(rows.select(node(object_(), named("g")).alias("n")))
            for end in (s, o):
                if end[0] == "term":
                    nodes = nodes.filter(term(F.col("n")) == T.constant(end[1])).unionAll(one(end[1], "n"))
            pairs = pairs.unionAll(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
        columns = {}
        for end, name in ((s, "s"), (o, "o")):
            if end[0] == "term":
                pairs = pairs.filter(term(F.col(name)) == T.constant(end[1]))
            elif end[1] in columns:
                pairs = pairs.filter(F.col("s") == F.col("o"))
            else:
                columns[end[1]] = term(F.col(name))
        if g is not None:
            of = T.constant((T.IRI, "", "", "")).withField("lex", T.graph_of(F.col("s")))
            if g in columns:  # the graph is an end of the path too
                pairs = pairs.filter(columns[g] == of)
            columns[g] = of
        return Solutions(pairs.select(*[c.alias(n) for n, c in columns.items()]), list(columns), set(columns))

    # --- templates
    def instantiate(self, found: Solutions, template: list[tuple], graph: str) -> DataFrame:
        """Quads of a template over solutions; those with an unbound or misplaced term are left out."""
        out = None
        marked = found.df.withColumn("_row", F.monotonically_increasing_id()) if any(x[0] == "var" and x[1].startswith("_:") for t in template for x in (t[1], t[3])) else found.df
        for g, s, p, o in template:

            def value(x: tuple) -> Column:
                if x[0] == "term":
                    return T.constant(x[1])
                if x[0] == "iri":
                    return T.constant((T.IRI, x[1], "", ""))
                if x[1].startswith("_:"):
                    return T.term(T.BNODE, F.concat(F.lit(x[1][2:] + "x"), F.col("_row").cast("string"))) if "_row" in marked.columns else T.constant((T.BNODE, x[1][2:], "", ""))
                return F.col(f"`{x[1]}`") if x[1] in found.vars else F.lit(None).cast(T.TERM)

            gt = F.lit(graph) if g is None else value(g)["lex"]
            row = marked.select(gt.alias("g"), value(s).alias("S"), value(p).alias("P"), value(o).alias("O")).filter("g is not null and S is not null and P is not null and O is not null and S.kind < 2 and P.kind = 0")
            row = row.select("g", F.col("S.kind").alias("s_kind"), F.col("S.lex").alias("s"), F.col("P.lex").alias("p"), F.col("O.kind").alias("o_kind"), F.col("O.lex").alias("o"), F.col("O.dt").alias("o_dt"), F.col("O.lang").alias("o_lang"), F.lit(False).alias("inferred"))
            out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], QUADS)


def to_native(found: Solutions | DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Term columns -> native ones: {'n': 'bigint', 'name': 'string'}; only those named are kept."""
    df = found.df if isinstance(found, Solutions) else found
    return df.select(*[T.native(F.col(f"`{name}`"), kind).alias(name) for name, kind in kinds.items()])
