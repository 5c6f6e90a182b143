"""The dialect's SELECT compiled to DataFrames.

Every expression becomes one native Column, so Catalyst sees joins, filters and
aggregates and plans them; nothing is evaluated here.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.patterns import glob, like
from ..functions.scalar import FUNCTIONS
from ..functions.values import Value
from .parser import Core, Parser, Select, Source, SqlError

AGGREGATES = {"count", "sum", "total", "avg", "min", "max", "group_concat", "string_agg", "median", "product", "stddev", "variance"}
WINDOWED = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}


@dataclass
class Field:
    source: str | None
    name: str
    value: Value
    shown: bool = True


def is_aggregate(node: object) -> bool:
    return isinstance(node, tuple) and node[:1] == ("call",) and node[1] in AGGREGATES and node[6] is None and not (node[1] in ("min", "max") and len(node[2]) > 1)


def walk(node: object):
    """A node and what it holds; subqueries are not entered."""
    if isinstance(node, tuple):
        yield node
        for x in node:
            yield from walk(x)
    elif isinstance(node, list):
        for x in node:
            yield from walk(x)


class Engine:
    """Runs queries over tables found by name. sql() returns a DataFrame."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame]):
        self.spark, self.tables, self.fresh = spark, tables, 0

    def sql(self, text: str, params: dict | list | None = None) -> DataFrame:
        p = Parser(text)
        tree = p.select()
        p.accept(";")
        if p.tok.kind != "end":
            raise SqlError(f'near "{p.tok.text}": syntax error')
        return self.select(tree, {}, params)

    def unique(self) -> str:
        self.fresh += 1
        return f"__{self.fresh}"

    # compound selects
    def select(self, s: Select, ctes: dict, params=None) -> DataFrame:
        ctes = dict(ctes)
        for name, columns, inner in s.ctes:
            df = self.select(inner, ctes, params)
            ctes[name.lower()] = df.toDF(*columns) if columns else df
        if not s.ops:
            return self.core(s.cores[0], s, ctes, params)
        out = self.core(s.cores[0], None, ctes, params)
        for op, core in zip(s.ops, s.cores[1:], strict=True):  # all of equal rank, from left to right
            more = self.core(core, None, ctes, params)
            if len(more.columns) != len(out.columns):
                raise SqlError(f"SELECTs to the left and right of {op.upper()} do not have the same number of result columns")
            out, more = self.aligned(out, more)
            out = {"union": lambda a, b: a.union(b).distinct(), "union all": lambda a, b: a.union(b), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b), "intersect all": lambda a, b: a.intersectAll(b), "except all": lambda a, b: a.exceptAll(b)}[op](out, more)
        fields = [Field(None, c, Value(F.col(f"`{c}`"), V.kind_of(out.schema[c].dataType), True)) for c in out.columns]
        keys = [self.sort_key(x, way, nulls, Compiler(self, fields, ctes, params), [f.value for f in fields]) for x, way, nulls in s.order]
        return self.limited(out.orderBy(*keys) if keys else out, s)

    def aligned(self, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        left, right = [], []
        for x, y in zip(a.schema, b.schema, strict=True):
            u, w = (Value(F.col(f"`{f.name}`"), V.kind_of(f.dataType)) for f in (x, y))
            (p, q), _ = V.common([u, w]) if u.kind != w.kind else ((u.c, w.c), "")
            left.append(p.alias(x.name))
            right.append(q.alias(x.name))
        return a.select(*left), b.select(*right)

    def limited(self, df: DataFrame, s: Select) -> DataFrame:
        if s.offset is not None:
            df = df.offset(max(0, self.constant(s.offset)))
        return df.limit(max(0, self.constant(s.limit))) if s.limit is not None else df

    def constant(self, node: tuple) -> int:
        if node[0] == "un" and node[1] == "-":
            return -self.constant(node[2])
        if node[0] != "lit":
            raise SqlError("LIMIT takes a constant")
        return int(node[1])

    # FROM
    def source(self, src: Source, ctes: dict, params) -> tuple[DataFrame, list[Field]]:
        if src.kind == "select":
            df = self.select(src.what, ctes, params)
        else:
            df = ctes.get(src.what.lower())
            df = self.tables(src.what) if df is None else df
        tag, fields, columns = self.unique(), [], []
        for i, f in enumerate(df.schema):
            c, inner = F.col(f"`{f.name}`"), f"{tag}_{i}"
            kind = V.kind_of(f.dataType)
            c = c.cast("long") if kind == "int" else c.cast("double") if kind == "real" else c.cast("timestamp_ntz") if kind == "time" else c
            columns.append(c.alias(inner))
            fields.append(Field((src.alias or "").lower(), f.name, Value(F.col(inner), kind, True), f.name != "_rowid"))
        return df.select(*columns), fields

    def joined(self, core: Core, ctes: dict, params) -> tuple[DataFrame, list[Field]]:
        df, fields = self.source(core.sources[0], ctes, params)
        for src in core.sources[1:]:
            more, theirs = self.source(src, ctes, params)
            shared = src.using or []
            if src.natural:
                mine = {f.name.lower() for f in fields if f.shown}
                shared = [f.name for f in theirs if f.name.lower() in mine]
            pairs = []
            for name in shared:
                a = next((f for f in fields if f.shown and f.name.lower() == name.lower()), None)
                b = next((f for f in theirs if f.name.lower() == name.lower()), None)
                if a is None or b is None:
                    raise SqlError(f"cannot join using column {name} - column not present in both tables")
                pairs.append((a, b))
            both = fields + theirs
            on = None
            if pairs:
                on = functools.reduce(lambda x, y: x & y, (V.compare("=", a.value, b.value) for a, b in pairs))
            elif src.on is not None:
                on = V.truth(Compiler(self, both, ctes, params).value(src.on))
            how = {"inner": "inner", "left": "left", "right": "right", "full": "full"}[src.join]
            if on is None:
                df = df.crossJoin(more) if how == "inner" else df.join(more, F.lit(True), how)
            else:
                df = df.join(more, on, how)
            for a, b in pairs:
                (x, y), kind = V.common([a.value, b.value])
                merged = F.coalesce(x, y) if how in ("full", "right") else x
                a.shown, b.shown = False, False
                at = fields.index(a)
                fields.insert(at, Field(None, a.name, Value(merged, kind, True)))
            fields = fields + theirs
        return df, fields

    # one SELECT
    def core(self, core: Core, s: Select | None, ctes: dict, params) -> DataFrame:
        if core.values is not None:
            return self.rows(core.values, params)
        if core.sources:
            df, fields = self.joined(core, ctes, params)
        else:
            df, fields = self.spark.range(1).select(F.lit(1).alias("__one")), []
        comp = Compiler(self, fields, ctes, params)
        if core.where is not None:
            if any(is_aggregate(n) for n in walk(core.where)):
                raise SqlError("misuse of aggregate function in WHERE")
            df = comp.filtered(df, core.where)
        outputs: list[tuple[tuple, str]] = []
        for x, alias, shown in core.outputs:
            if x[0] == "star":
                outputs += [(("field", f), f.name) for f in fields if (f.shown if x[1] is None else f.source == x[1].lower() and not f.name.startswith("_rowid"))]
            else:
                name = alias or (comp.field(x).name if x[0] == "col" else shown)
                outputs.append((x, name))
        aliases = {name.lower(): x for x, name in outputs}
        order = s.order if s else []
        group = [outputs[g[1] - 1][0] if g[0] == "lit" and isinstance(g[1], int) and 0 < g[1] <= len(outputs) else comp.aliased(g, aliases) for g in core.group]
        sorts = [(outputs[self.ordinal(x, len(outputs))][0] if x[0] == "lit" and isinstance(x[1], int) else comp.aliased(x, aliases), way, nulls) for x, way, nulls in order]
        having = comp.aliased(core.having, aliases) if core.having is not None else None
        nodes = [x for x, _ in outputs] + [x for x, _, _ in sorts] + ([having] if having else [])
        if group or any(is_aggregate(n) for x in nodes for n in walk(x)):
            df, comp = self.grouped(df, comp, group, nodes)
            if having is not None:
                df = df.filter(V.truth(comp.value(having)))
        elif having is not None:
            raise SqlError("HAVING clause on a non-aggregate query")
        values = [comp.value(x) for x, _ in outputs]
        for sub in comp.pending:
            df = df.crossJoin(F.broadcast(sub))
        comp.pending.clear()
        names = self.names([n for _, n in outputs])
        columns = [(F.lit(None).cast("string") if v.kind == "null" else v.c).alias(n) for v, n in zip(values, names, strict=True)]
        if core.distinct:
            df = df.select(*columns).distinct()
            shown = {repr(x): n for (x, _), n in zip(outputs, names, strict=True)}
            keys = []
            for x, way, nulls in sorts:
                if repr(x) not in shown:
                    raise SqlError("ORDER BY of a DISTINCT query takes its output columns")
                keys.append(direct(F.col(f"`{shown[repr(x)]}`"), way, nulls))
            df = df.orderBy(*keys) if keys else df
        else:
            hidden = [(self.unique(), comp.value(x), way, nulls) for x, way, nulls in sorts]
            df = df.select(*columns, *(v.c.alias(k) for k, v, _, _ in hidden))
            if hidden:
                df = df.orderBy(*(direct(F.col(k), way, nulls) for k, _, way, nulls in hidden))
            if s:
                df = self.limited(df, s)
            return df.select(*(f"`{n}`" for n in names)) if hidden else df
        return self.limited(df, s) if s else df

    def ordinal(self, x: tuple, n: int) -> int:
        if not 1 <= x[1] <= n:
            raise SqlError(f"ORDER BY term out of range - should be between 1 and {n}")
        return x[1] - 1

    def names(self, names: list[str]) -> list[str]:
        out: list[str] = []
        for n in names:
            k, unique = 1, n
            while unique.lower() in {x.lower() for x in out}:
                unique, k = f"{n}:{k}", k + 1
            out.append(unique)
        return out

    def rows(self, rows: list[list[tuple]], params, forms: list | None = None) -> DataFrame:
        """VALUES; forms, one for each column, turn a value into a column of one type."""
        comp = Compiler(self, [], {}, params)
        if any(len(r) != len(rows[0]) for r in rows):
            raise SqlError("all VALUES must have the same number of terms")
        columns = []
        for j, column in enumerate(zip(*rows, strict=True)):
            vs = [comp.value(x) for x in column]
            columns.append([forms[j](v) for v in vs] if forms and j < len(forms) else V.common(vs)[0])
        n = len(columns)
        each = F.array(*(F.struct(*(columns[j][i].alias(f"column{j + 1}") for j in range(n))) for i in range(len(rows))))
        return self.spark.range(1).select(F.explode(each).alias("r")).select("r.*")

    def sort_key(self, x: tuple, way: str, nulls: str | None, comp: Compiler, outputs: list[Value]) -> Column:
        v = outputs[self.ordinal(x, len(outputs))] if x[0] == "lit" and isinstance(x[1], int) else comp.value(x)
        return direct(v.c, way, nulls)

    def grouped(self, df: DataFrame, comp: Compiler, group: list[tuple], nodes: list[tuple]) -> tuple[DataFrame, Compiler]:
        """Aggregate; the compiler returned reads keys and aggregates by their nodes."""
        known: dict[str, Value] = {}
        keys, aggs = [], []
        for g in group:
            v, name = comp.value(g), self.unique()
            keys.append(v.c.alias(name))
            known[repr(comp.canon(g))] = Value(F.col(name), v.kind, True)
        bare = False
        for node in nodes:
            for n in walk(node):
                if is_aggregate(n) and repr(comp.canon(n)) not in known:
                    name, v = self.unique(), comp.aggregate(n)
                    aggs.append(v.c.alias(name))
                    known[repr(comp.canon(n))] = Value(F.col(name), v.kind)
        out = Compiler(self, comp.fields, comp.ctes, comp.params, known)

        def loose(node: object) -> None:
            nonlocal bare
            if not isinstance(node, tuple) or repr(comp.canon(node)) in known:
                if isinstance(node, list):
                    for x in node:
                        loose(x)
                return
            if node[0] in ("col", "field"):  # value of the group's first row
                name, v = self.unique(), comp.value(node)
                bare = True
                aggs.append(F.min_by(v.c, F.col("__row")).alias(name))
                known[repr(comp.canon(node))] = Value(F.col(name), v.kind, True)
                return
            for x in node:
                loose(x)

        for node in nodes:
            loose(node)
        if bare:
            df = df.withColumn("__row", F.monotonically_increasing_id())
        aggs = aggs or [F.count(F.lit(1)).alias(self.unique())]
        return (df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)), out


def direct(c: Column, way: str, nulls: str | None) -> Column:
    if way == "asc":
        return c.asc_nulls_last() if nulls == "last" else c.asc_nulls_first()
    return c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()


class Compiler:
    def __init__(self, engine: Engine, fields: list[Field], ctes: dict, params=None, known: dict[str, Value] | None = None):
        self.engine, self.fields, self.ctes, self.params, self.known = engine, fields, ctes, params, known or {}
        self.pending: list[DataFrame] = []

    def field(self, node: tuple) -> Field:
        _, source, name = node
        found = [f for f in self.fields if f.name.lower() == name.lower() and (source is None and (f.shown or f.name == "_rowid") or source is not None and f.source == source.lower())]
        if not found and name.lower() in ("rowid", "oid", "_rowid_"):
            found = [f for f in self.fields if f.name == "_rowid" and (source is None or f.source == source.lower())]
        if not found:
            raise SqlError(f"no such column: {source + '.' if source else ''}{name}")
        if len(found) > 1:
            raise SqlError(f"ambiguous column name: {name}")
        return found[0]

    def aliased(self, node: tuple, aliases: dict[str, tuple]) -> tuple:
        """An output's alias stands for its expression, where no column has that name."""
        if node[0] == "col" and node[1] is None and node[2].lower() in aliases:
            if not any(f.name.lower() == node[2].lower() for f in self.fields) or aliases[node[2].lower()][0] != "col":
                return aliases[node[2].lower()]
            return node
        return tuple(self.aliased(x, aliases) if isinstance(x, tuple) and x and isinstance(x[0], str) and x[0] in ("col", "bin", "un", "call") else tuple(self.aliased(y, aliases) if isinstance(y, tuple) and y and isinstance(y[0], str) else y for y in x) if isinstance(x, tuple) else x for x in node)

    def canon(self, node: object) -> object:
        """The node with columns replaced by the fields they name, to compare expressions."""
        if isinstance(node, tuple) and node[:1] == ("col",):
            try:
                return ("field", id(self.field(node)))
            except SqlError:
                return node
        if isinstance(node, tuple) and node[:1] == ("field",):
            return ("field", id(node[1]))
        return tuple(map(self.canon, node)) if isinstance(node, tuple) else node

    def filtered(self, df: DataFrame, node: tuple) -> DataFrame:
        """WHERE; parts joined by AND that test a subquery become semi or anti joins."""
        if node[:2] == ("bin", "and"):
            return self.filtered(self.filtered(df, node[2]), node[3])
        if node[0] == "insel":
            _, x, inner, negate = node
            sub = self.engine.select(inner, self.ctes, self.params)
            key = self.engine.unique()
            v = self.value(x)
            there = Value(F.col(key), V.kind_of(sub.schema[0].dataType), True)
            sub = sub.toDF(key)
            hit = V.compare("=", v, there)
            if negate:  # a null on either side leaves the row's membership open, unless there is nothing to be in
                n, nulls = self.engine.unique(), self.engine.unique()
                seen = sub.agg(F.count(F.lit(1)).alias(n), F.count_if(F.col(key).isNull()).alias(nulls))
                out = df.join(sub, hit, "left_anti").crossJoin(F.broadcast(seen))
                return out.filter((F.col(n) == 0) | ((F.col(nulls) == 0) & v.c.isNotNull())).drop(n, nulls)
            return df.join(sub, hit, "left_semi")
        if node[0] == "exists":
            some = self.engine.select(node[1], self.ctes, self.params).limit(1).agg((F.count(F.lit(1)) > 0).alias(name := self.engine.unique()))
            return df.crossJoin(F.broadcast(some)).filter(~F.col(name) if node[2] else F.col(name))
        c = V.truth(self.value(node))
        for sub in self.pending:
            df = df.crossJoin(F.broadcast(sub))
        self.pending.clear()
        return df.filter(c)

    def value(self, node: tuple) -> Value:
        if self.known and (v := self.known.get(repr(self.canon(node)))) is not None:
            return v
        return getattr(self, f"_{node[0]}")(*node[1:])

    def _lit(self, x) -> Value:
        return V.lit(x)

    def _field(self, f: Field) -> Value:
        return f.value

    def _col(self, source, name) -> Value:
        return self.field(("col", source, name)).value

    def _param(self, name) -> Value:
        p = self.params or {}
        if isinstance(p, dict):
            key = name if name in p else name[1:]
            if key not in p:
                return V.lit(None)
            return V.lit(p[key])
        i = int(name[1:] or 1) - 1 if name[0] == "?" else 0
        return V.lit(p[i] if i < len(p) else None)

    def _un(self, op, x) -> Value:
        v = self.value(x)
        if op == "not":
            return V.flag(~V.truth(v))
        if op == "+":
            return v
        if op == "~":
            return Value(F.bitwise_not(V.integer(v)), "int")
        n = V.number(v)
        return Value(-n.c, n.kind)

    def _bin(self, op, a, b) -> Value:
        x, y = self.value(a), self.value(b)
        if op == "and":
            return V.flag(V.truth(x) & V.truth(y))
        if op == "or":
            return V.flag(V.truth(x) | V.truth(y))
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return V.flag(V.compare(op, x, y))
        if op in ("+", "-", "*", "/", "%"):
            return V.arithmetic(op, x, y)
        if op in ("&", "|", "<<", ">>"):
            return V.bitwise(op, x, y)
        if op == "||":
            return V.concat(x, y)
        path = F.concat(F.lit("$."), V.text(y)) if not str(y.literal or "").startswith("$") else V.text(y)
        return Value(F.call_function("get_json_object", V.text(x), path), "text")

    def _is(self, x, y, negate) -> Value:
        same = V.compare("is", self.value(x), self.value(y))
        return V.flag(~same if negate else same)

    def _isnull(self, x, negate) -> Value:
        c = self.value(x).c
        return V.flag(c.isNotNull() if negate else c.isNull())

    def _between(self, x, low, high, negate) -> Value:
        v = self.value(x)
        inside = V.compare(">=", v, self.value(low)) & V.compare("<=", v, self.value(high))
        return V.flag(~inside if negate else inside)

    def _in(self, x, items, negate) -> Value:
        v = self.value(x)
        if not items:
            return V.lit(int(negate))
        hits = functools.reduce(lambda a, b: a | b, (V.compare("=", v, self.value(i)) for i in items))
        return V.flag(~hits if negate else hits)

    def _insel(self, x, inner, negate) -> Value:
        raise SqlError("IN (SELECT ...) stands alone or beside AND in WHERE")

    def _exists(self, inner, negate) -> Value:
        raise SqlError("EXISTS stands alone or beside AND in WHERE")

    def _sub(self, inner) -> Value:
        """A scalar subquery: one row of one value, joined to every row."""
        sub, name = self.engine.select(inner, self.ctes, self.params), self.engine.unique()
        kind = V.kind_of(sub.schema[0].dataType)
        self.pending.append(sub.toDF(name).limit(1).agg(F.first(name).alias(name)))
        return Value(F.col(name), kind)

    def _like(self, op, x, pattern, escape, negate) -> Value:
        t, p = V.text(self.value(x)), self.value(pattern)
        if p.kind == "null":
            return V.flag(F.lit(None).cast("boolean"))
        if op == "like":
            c = like(t, p.literal if isinstance(p.literal, str) else V.text(p), escape[1] if escape else None)
        elif op == "glob":
            c = glob(t, p.literal if isinstance(p.literal, str) else V.text(p))
        elif op == "regexp":
            c = t.rlike(str(p.literal)) if p.literal is not None else F.regexp_like(t, V.text(p))
        else:
            raise SqlError("unable to use function MATCH in the requested context")
        return V.flag(~c if negate else c)

    def _case(self, base, whens, other) -> Value:
        results, kind = V.common([self.value(r) for _, r in whens] + [self.value(other) if other else V.lit(None)])
        b = self.value(base) if base else None
        out = None
        for (w, _), r in zip(whens, results, strict=False):
            test = V.compare("=", b, self.value(w)) if b else V.truth(self.value(w))
            out = F.when(test, r) if out is None else out.when(test, r)
        return Value(out.otherwise(results[-1]), kind)

    def _cast(self, x, declared) -> Value:
        return V.cast(self.value(x), declared)

    def _star(self, source) -> Value:
        raise SqlError("* is not an expression")

    def _call(self, name, args, distinct, star, where, over) -> Value:
        if over is not None:
            return self.window(name, args, star, over)
        if is_aggregate(("call", name, args, distinct, star, where, over)):
            raise SqlError(f"misuse of aggregate: {name}()")
        if name not in FUNCTIONS:
            raise SqlError(f"no such function: {name}")
        try:
            return FUNCTIONS[name](*map(self.value, args))
        except TypeError as e:
            if "positional argument" in str(e) or "arguments" in str(e):
                raise SqlError(f"wrong number of arguments to function {name}()") from None
            raise

    def aggregate(self, node: tuple) -> Value:
        _, name, args, distinct, star, where, _ = node
        if any(is_aggregate(n) for a in args for n in walk(a)):
            raise SqlError(f"misuse of aggregate: {name}()")
        keep = V.truth(self.value(where)) if where is not None else None
        held = lambda c: c if keep is None else F.when(keep, c)
        if name == "count" and (star or not args):
            return Value(F.count(held(F.lit(1))), "int")
        if not 1 <= len(args) <= 1 + (name in ("group_concat", "string_agg")):
            raise SqlError(f"wrong number of arguments to function {name}()")
        v = self.value(args[0])
        if v.kind == "null":
            v = Value(F.lit(None).cast("long"), "int")
        if name == "count":
            return Value(F.count_distinct(held(v.c)) if distinct else F.count(held(v.c)), "int")
        if name in ("min", "max"):
            return Value((F.min if name == "min" else F.max)(held(v.c)), v.kind)
        if name in ("group_concat", "string_agg"):
            mark = self.value(args[1]).literal if len(args) > 1 else ","
            t = held(V.text(v))
            return Value((F.listagg_distinct if distinct else F.listagg)(t, F.lit("" if mark is None else str(mark))), "text")
        n = V.number(v)
        x = held(F.when(v.c.isNotNull(), n.c))
        if name == "sum":
            return Value(F.sum_distinct(x) if distinct else F.sum(x), n.kind)
        x = x.cast("double")
        if name == "total":
            return Value(F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0.0)), "real")
        if name == "avg":
            return Value(F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x), "real")
        return Value({"median": F.median, "product": F.product, "stddev": F.stddev, "variance": F.variance}[name](x), "real")

    def window(self, name, args, star, over) -> Value:
        part, order, frame = over
        w = Window.partitionBy(*(self.value(p).c for p in part))
        if order:
            w = w.orderBy(*(direct(self.value(x).c, way, nulls) for x, way, nulls in order))
        if frame:
            low = Window.unboundedPreceding if frame[1] is None else frame[1]
            high = Window.unboundedFollowing if frame[2] is None else frame[2]
            w = w.rowsBetween(low, high) if frame[0] == "rows" else w.rangeBetween(low, high)
        if name in WINDOWED:
            vs = [self.value(a) for a in args]
            plain = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
            if name in plain:
                return Value(plain[name]().over(w), "real" if name in ("percent_rank", "cume_dist") else "int")
            if name == "ntile":
                return Value(F.ntile(int(vs[0].literal)).over(w), "int")
            if name in ("lag", "lead"):
                f = F.lag if name == "lag" else F.lead
                return Value(f(vs[0].c, int(vs[1].literal) if len(vs) > 1 else 1, vs[2].literal if len(vs) > 2 else None).over(w), vs[0].kind)
            c = {"first_value": lambda: F.first(vs[0].c), "last_value": lambda: F.last(vs[0].c), "nth_value": lambda: F.nth_value(vs[0].c, int(vs[1].literal))}[name]()
            return Value(c.over(w), vs[0].kind)
        v = self.aggregate(("call", name, args, False, star, None, None))
        return Value(v.c.over(w), v.kind)
