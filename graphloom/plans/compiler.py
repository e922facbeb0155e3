"""Lowering of parsed queries and updates to DataFrames.

A solution is a row; a variable is a struct column named after it (see functions.terms). The plan declares scans, joins
and filters only; Catalyst orders, pushes and prunes. Two variables join on value and kind alone where one of them stands
for a resource (subject, predicate or graph), and on all four parts else. Only a variable that may be unbound (after
OPTIONAL or UNION) joins by the null-aware condition; all others keep plain equi-joins.

SELECT has bag semantics, CONSTRUCT and graphs set semantics. Errors in expressions are null, and null filters drop rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import terms
from graphloom.functions.terms import LANG_STRING, STRING, TERM, XSD
from graphloom.plans.sparql import Call, Exists, Group, Node, Pattern, Query, UnsupportedSparql, Update, Var, parse_query, parse_update
from graphloom.sources.quads import COLUMNS, QuadSource, as_source, dataset, difference, set_of, union
from graphloom.sources.shared import ROWS_A_TASK, tasks_of



def null_term() -> Column:
    return F.lit(None).cast(TERM)



#: Shared variables that may be unbound up to which a join is split into joins with a key (three for each such variable).
MOST_LOOSE = 2


@dataclass
class Solutions:
    """df's columns are the variables; `maybe` of them may be null, `resources` are never literals.

    rows: those of the largest table that it was read from, where that is known.
    """

    df: DataFrame
    maybe: frozenset[str] = frozenset()
    resources: frozenset[str] = frozenset()
    rows: int | None = None

    @property
    def vars(self) -> list[str]:
        return self.df.columns


def constant(n: Node) -> Column:
    return F.struct(F.lit(n.kind).alias("kind"), F.lit(n.value).alias("value"), F.lit(n.dt).alias("dt"), F.lit(n.lang).alias("lang"))


class Compiler:
    def __init__(self, source: DataFrame | QuadSource, spark: SparkSession | None = None, bindings: DataFrame | None = None, now: str | None = None):
        """bindings: a DataFrame of variables (term structs) that are bound from outside; a query joins it once."""
        self.source = as_source(source)
        self.spark = spark or getattr(self.source, "spark", None) or self.source.scan([]).sparkSession
        self.bindings = bindings
        self.rows: int | None = getattr(self.source, "known_rows", None)
        self.now = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")

    # patterns

    def unit(self) -> Solutions:
        if self.bindings is not None:
            return Solutions(self.bindings)
        return Solutions(self.spark.range(1).select())

    def pattern(self, t: Pattern) -> Solutions:
        if isinstance(t.p, Node):
            df = self.source.scan([t.p.value]).where(F.col("p") == t.p.value)
        else:
            df = self.source.scan(None)
        if t.g is None:
            df = df.where(F.col("g").isNull()) if self.default_only else df
        elif isinstance(t.g, Node):
            df = df.where(F.col("g") == t.g.value)
        else:
            df = df.where(F.col("g").isNotNull())
        cols: dict[str, Column] = {}
        same: list[Column] = []
        places = (
            (t.s, terms.term(F.col("s_kind"), F.col("s")), [F.col("s"), F.col("s_kind")]),
            (t.p, terms.iri(F.col("p")), [F.col("p"), None]),
            (t.o, terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")), [F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")]),
            (t.g, terms.iri(F.col("g")), [F.col("g"), None]),
        )
        resources = set()
        for place, (x, column, flat) in zip("spog", places):
            if isinstance(x, Node):
                if place in "so":
                    wanted = (x.value, x.kind, x.dt, x.lang)
                    same += [c == w for c, w in zip(flat, wanted)]
            elif x is not None:
                if x.name in cols:
                    same.append(terms.term_equal(cols[x.name], column))
                else:
                    cols[x.name] = column
                if place != "o":
                    resources.add(x.name)
        for c in same:
            df = df.where(c)
        rows = self.rows
        if rows is None and hasattr(self.source, "rows_of") and isinstance(t.p, Node):
            table = self.source.owner(t.p.value, t.o.value if isinstance(t.o, Node) and t.o.kind == "iri" else None)
            rows = self.source.rows_of(table) if table else None
        return Solutions(df.select(*[c.alias(n) for n, c in cols.items()]), frozenset(), frozenset(resources), rows)

    def stars(self, patterns: list[Pattern]) -> list:
        """Patterns, those of one subject and one table gathered in lists, if the source has such."""
        if not hasattr(self.source, "star") or self.source.graph is not None:
            return list(patterns)
        out: list = []
        for t in patterns:
            typed = isinstance(t.o, Node) and t.o.kind == "iri"
            table = None
            if isinstance(t.p, Node) and isinstance(t.s, Var) and t.g is None:
                table = self.source.owner(t.p.value, t.o.value if typed else None)
            at = next((x for x in out if isinstance(x, tuple) and x[0] == table and x[1] == t.s.name), None) if table else None
            if at:
                at[2].append(t)
            else:
                out.append((table, t.s.name, [t]) if table else t)
        return [x if isinstance(x, Pattern) else x[2][0] if len(x[2]) == 1 else x for x in out]

    def star(self, table: str, subject: str, patterns: list[Pattern]) -> Solutions:
        predicates = list(dict.fromkeys(t.p.value for t in patterns))
        df = self.source.star(table, predicates)
        cols: dict[str, Column] = {subject: terms.iri(F.col("s"))}
        refers = {t.o.name for t in patterns if isinstance(t.o, Var) and self.source.refers(table, t.p.value)}
        for t in patterns:
            c = F.col(f"o{predicates.index(t.p.value)}")
            if isinstance(t.o, Node):
                df = df.where(terms.term_equal(c, constant(t.o)))
            elif t.o.name in cols:
                df = df.where(terms.term_equal(c, cols[t.o.name]))
            else:
                cols[t.o.name] = c
        return Solutions(df.select(*[c.alias(n) for n, c in cols.items()]), frozenset(), frozenset({subject} | refers), self.source.rows_of(table) if hasattr(self.source, "rows_of") else None)

    default_only = False  # the default graph of a query is the union of all graphs

    def _on(self, a: Solutions, b: Solutions, shared: Sequence[str], left: str, right: str) -> Column | None:
        tests = []
        for v in shared:
            x, y = F.col(f"{left}.{v}"), F.col(f"{right}.{v}")
            if v in a.resources or v in b.resources:
                equal = (x["value"] == y["value"]) & (x["kind"] == y["kind"])
            else:
                equal = terms.term_equal(x, y)
            if v in a.maybe or v in b.maybe:
                equal = x.isNull() | y.isNull() | equal
            tests.append(equal)
        return reduce(lambda x, y: x & y, tests) if tests else None

    @staticmethod
    def _dealt(a: Solutions, b: Solutions, shared: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides of a join in partitions by their rows, and columns of its key, where both are of many; a small side is left to a
        broadcast. A key is one text, as Spark drops parts that it finds constant and then deals rows out again."""
        if not shared or any(v in a.maybe or v in b.maybe for v in shared) or a.rows is None or b.rows is None or min(a.rows, b.rows) <= ROWS_A_TASK:
            return a.df, b.df, []
        tasks, keys = tasks_of(max(a.rows, b.rows)), {}
        for i, v in enumerate(shared):
            parts = ("kind", "value") if v in a.resources or v in b.resources else ("kind", "dt", "lang", "value")
            keys[f"_key{i}"] = F.concat(*[x for part in parts for x in (F.lit("\0"), F.col(f"`{v}`")[part])])
        return *[x.df.withColumns(keys).repartition(tasks, *keys) for x in (a, b)], list(keys)

    def _apart(self, a: Solutions, b: Solutions, v: str, how: str, extra) -> Solutions:
        """A join on a variable that may be unbound, as joins of bound rows, which have a key, and of unbound ones, which fit all."""

        def some(x: Solutions, bound: bool, keep: bool = False) -> Solutions:
            df = x.df.where(F.col(v).isNotNull() if bound else F.col(v).isNull())
            return Solutions(df if bound or keep else df.drop(v), x.maybe - {v} if bound else x.maybe, x.resources)

        without = Solutions(b.df.drop(v), b.maybe - {v}, b.resources)
        if how in ("left_semi", "left_anti"):
            one, none = some(a, True), some(a, False, keep=True)
            kept = self.join(one, some(b, True), "left_anti", extra)
            if how == "left_anti":
                parts = [self.join(kept, some(b, False), how, extra), self.join(none, without, how, extra)]
            else:
                parts = [self.join(one, some(b, True), how, extra), self.join(kept, some(b, False), how, extra), self.join(none, without, how, extra)]
            return Solutions(reduce(DataFrame.unionByName, [x.df.select(*a.vars) for x in parts]), a.maybe, a.resources)
        new = [x for x in b.vars if x not in a.vars]
        parts = [self.join(some(a, True), some(b, True), "inner", extra), self.join(some(a, True), some(b, False), "inner", extra), self.join(some(a, False), b, "inner", extra)]
        rows = [x.df.select(*a.vars, *new) for x in parts]
        if how == "left":
            kinds = {f.name: f.dataType for f in b.df.schema.fields}
            rows.append(self.join(a, b, "left_anti", extra).df.select(*a.vars, *[F.lit(None).cast(kinds[x]).alias(x) for x in new]))
            maybe = a.maybe | set(new)
        else:
            maybe = {x for x in a.maybe | b.maybe if not (x in a.vars and x in b.vars and (x not in a.maybe or x not in b.maybe))}
        return Solutions(reduce(DataFrame.unionByName, rows), frozenset(maybe), a.resources | b.resources)

    def join(self, a: Solutions, b: Solutions, how: str = "inner", extra=None) -> Solutions:
        shared = [v for v in a.vars if v in b.vars]
        loose = [v for v in shared if v in a.maybe or v in b.maybe]
        if loose and len(loose) <= MOST_LOOSE and how in ("inner", "left", "left_semi", "left_anti"):
            return self._apart(a, b, loose[0], how, extra)
        x, y, keys = self._dealt(a, b, shared) if how in ("inner", "left") else (a.df, b.df, [])
        x, y = x.alias("l_"), y.alias("r_")
        on = reduce(lambda p, q: p & q, [F.col(f"l_.{k}") == F.col(f"r_.{k}") for k in keys]) if keys else self._on(a, b, shared, "l_", "r_")
        if extra is not None:
            names = {v: F.col(f"l_.{v}") for v in a.vars} | {v: F.col(f"r_.{v}") for v in b.vars if v not in a.vars}
            test = extra(names)
            on = test if on is None else on & test
        if how in ("left_semi", "left_anti"):
            df = x.join(y, on, how) if on is not None else self._on_any(x, y, how)
            return Solutions(df.select(*[F.col(f"l_.{v}").alias(v) for v in a.vars]), a.maybe, a.resources)
        df = x.join(y, on, how) if on is not None else (x.crossJoin(y) if how == "inner" else x.join(y, F.lit(True), how))
        out = []
        for v in a.vars:
            c = F.col(f"l_.{v}")
            out.append((F.coalesce(c, F.col(f"r_.{v}")) if v in shared and v in a.maybe else c).alias(v))
        out += [F.col(f"r_.{v}").alias(v) for v in b.vars if v not in shared]
        new = {v for v in b.vars if v not in shared}
        if how == "left":
            maybe = a.maybe | new
        else:
            maybe = {v for v in a.maybe | b.maybe if not (v in shared and (v not in a.maybe or v not in b.maybe))}
        return Solutions(df.select(*out), frozenset(maybe), a.resources | b.resources, None if a.rows is None or b.rows is None else max(a.rows, b.rows))

    @staticmethod
    def _on_any(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
        """Semi and anti join without shared variables: whether y has any row."""
        return x.join(y.limit(1).select(F.lit(1).alias("_any")), F.lit(True), how)

    def group(self, g: Group, start: Solutions | None = None) -> Solutions:
        now = start
        filters: list = []
        patterns: list[Pattern] = []

        def add(s: Solutions) -> None:
            nonlocal now
            now = s if now is None else self.join(now, s)

        def flush() -> None:
            nonlocal patterns
            left = self.stars(patterns)
            patterns = []
            while left:  # next the pattern that shares a variable with what there is
                have = set(now.vars) if now is not None else set()
                k = next((i for i, t in enumerate(left) if have & (self._vars(t) if isinstance(t, Pattern) else set().union(*map(self._vars, t[2])))), 0)
                t = left.pop(k)
                add(self.pattern(t) if isinstance(t, Pattern) else self.star(*t))

        for part in g.parts:
            if isinstance(part, Pattern):
                patterns.append(part)
                continue
            flush()
            if isinstance(part, Group):
                add(self.group(part))
            elif isinstance(part, Query):
                add(self.select(part))
            elif part[0] == "filter":
                filters.append(part[1])
            elif part[0] == "optional":
                inner = part[1]
                tests = [p[1] for p in inner.parts if isinstance(p, tuple) and p[0] == "filter" and not self._has_exists(p[1])]
                rest = Group(tuple(p for p in inner.parts if not (isinstance(p, tuple) and p[0] == "filter" and not self._has_exists(p[1]))))
                extra = (lambda names, tests=tests: reduce(lambda x, y: x & y, [self.truth(t, names) for t in tests])) if tests else None
                now = self.join(now if now is not None else self.unit(), self.group(rest), "left", extra)
            elif part[0] == "minus":
                other = self.group(part[1])
                if now is not None and set(now.vars) & set(other.vars):
                    now = self.join(now, other, "left_anti")
            elif part[0] == "union":
                add(self.union([self.group(x) for x in part[1]]))
            elif part[0] == "bind":
                now = now if now is not None else self.unit()
                if part[2].name in now.vars:
                    raise UnsupportedSparql(f"BIND to ?{part[2].name}, which is bound")
                now = self.extend(now, part[1], part[2].name)
            elif part[0] == "values":
                add(self.values(part[1], part[2]))
        flush()
        now = now if now is not None else self.unit()
        for f in filters:
            now = self.filter(now, f)
        return now

    @staticmethod
    def _vars(t: Pattern) -> set[str]:
        return {x.name for x in (t.s, t.p, t.o, t.g) if isinstance(x, Var)}

    def _has_exists(self, e) -> bool:
        return isinstance(e, Exists) or isinstance(e, Call) and any(self._has_exists(x) for x in e.args if isinstance(x, (Call, Exists)))

    def values(self, names, rows) -> Solutions:
        data = [tuple(None if x is None else (x.kind, x.value, x.dt, x.lang) for x in row) for row in rows]
        df = self.spark.createDataFrame(data, T.StructType([T.StructField(n, TERM) for n in names]))
        maybe = {n for i, n in enumerate(names) if any(row[i] is None for row in rows)}
        resources = {n for i, n in enumerate(names) if all(row[i] is not None and row[i].kind != "lit" for row in rows)}
        return Solutions(df, frozenset(maybe), frozenset(resources))

    def union(self, parts: list[Solutions]) -> Solutions:
        names = list(dict.fromkeys(v for p in parts for v in p.vars))
        df = reduce(DataFrame.unionByName, [p.df.select(*[F.col(v) if v in p.vars else null_term().alias(v) for v in names]) for p in parts])
        maybe = {v for v in names if any(v not in p.vars or v in p.maybe for p in parts)}
        return Solutions(df, frozenset(maybe), frozenset(v for v in names if all(v in p.resources or v not in p.vars for p in parts)))

    def extend(self, s: Solutions, e, name: str) -> Solutions:
        return Solutions(s.df.withColumn(name, self.as_term(e, self._names(s))), s.maybe | {name}, s.resources, s.rows)

    @staticmethod
    def _inward(e):
        """A negation of a conjunction, disjunction, negation or EXISTS, moved to its parts."""
        inner = e.args[0] if isinstance(e, Call) and e.name == "!" else None
        if isinstance(inner, Exists):
            return Exists(inner.group, not inner.negated)
        if isinstance(inner, Call) and inner.name == "!":
            return inner.args[0]
        if isinstance(inner, Call) and inner.name in ("&&", "||"):
            return Call("||" if inner.name == "&&" else "&&", tuple(Call("!", (x,)) for x in inner.args))
        return e

    def filter(self, s: Solutions, e) -> Solutions:
        """Rows where e is true. EXISTS inside a disjunction splits it: rows where the one side is true, then of the others those
        where the other side is."""
        if not self._has_exists(e):
            return Solutions(s.df.where(self.truth(e, self._names(s))), s.maybe, s.resources, s.rows)
        e = self._inward(e)
        if isinstance(e, Exists):
            return self.exists(s, e)
        if e.name == "&&":
            return self.filter(self.filter(s, e.args[0]), e.args[1])
        if e.name == "||":
            return self._beside(s, self.filter(s, e.args[0]), self.filter(self.reject(s, e.args[0]), e.args[1]))
        if e.name == "!" and self._inward(e) is not e:
            return self.filter(s, self._inward(e))
        raise UnsupportedSparql("EXISTS inside a function")

    def reject(self, s: Solutions, e) -> Solutions:
        """The other rows: e is false there or an error."""
        if not self._has_exists(e):
            return Solutions(s.df.where(~F.coalesce(self.truth(e, self._names(s)), F.lit(False))), s.maybe, s.resources)
        e = self._inward(e)
        if isinstance(e, Exists):
            return self.exists(s, Exists(e.group, not e.negated))
        if e.name == "&&":
            return self._beside(s, self.reject(s, e.args[0]), self.reject(self.filter(s, e.args[0]), e.args[1]))
        if e.name == "||":
            return self.reject(self.reject(s, e.args[0]), e.args[1])
        if e.name == "!" and self._inward(e) is not e:
            return self.reject(s, self._inward(e))
        raise UnsupportedSparql("EXISTS inside a function")

    @staticmethod
    def _beside(s: Solutions, a: Solutions, b: Solutions) -> Solutions:
        return Solutions(a.df.select(*s.vars).unionByName(b.df.select(*s.vars)), s.maybe, s.resources)

    def exists(self, s: Solutions, e: Exists) -> Solutions:
        tests = [p[1] for p in e.group.parts if isinstance(p, tuple) and p[0] == "filter" and not self._has_exists(p[1])]
        rest = Group(tuple(p for p in e.group.parts if not (isinstance(p, tuple) and p[0] == "filter" and not self._has_exists(p[1]))))
        extra = (lambda names: reduce(lambda x, y: x & y, [self.truth(t, names) for t in tests])) if tests else None
        return self.join(s, self.group(rest), "left_anti" if e.negated else "left_semi", extra)

    @staticmethod
    def _names(s: Solutions) -> dict[str, Column]:
        return {v: F.col(f"`{v}`") for v in s.vars}

    # expressions: as_term gives a term struct, truth a boolean, text a string

    def as_term(self, e, names: Mapping[str, Column]) -> Column:
        if isinstance(e, Var):
            return names.get(e.name, null_term())
        if isinstance(e, Node):
            return constant(e)
        if e.name == "COALESCE":
            return F.coalesce(*[self.as_term(x, names) for x in e.args])
        if e.name == "IF":
            return F.when(self.truth(e.args[0], names), self.as_term(e.args[1], names)).otherwise(self.as_term(e.args[2], names))
        if e.name in ("IRI", "URI"):
            c = self.text(e.args[0], names)
            return F.when(c.isNotNull(), terms.iri(c))
        if e.name == "STRDT":
            c = self.text(e.args[0], names)
            return F.when(c.isNotNull(), terms.term("lit", c, self.as_term(e.args[1], names)["value"], ""))
        if e.name == "STRLANG":
            c = self.text(e.args[0], names)
            return F.when(c.isNotNull(), terms.term("lit", c, LANG_STRING, self.text(e.args[1], names)))
        if e.name == "DATATYPE":
            t = self.as_term(e.args[0], names)
            return F.when(t["kind"] == "lit", terms.iri(t["dt"]))
        if e.name == "CAST":
            return self.cast(self.as_term(e.args[0], names), e.args[1])
        if e.name == "NOW":
            return terms.literal(self.now, XSD + "dateTime")
        kind, c = self.scalar(e, names)
        lexical = F.when(c, F.lit("true")).otherwise(F.lit("false")) if kind == "boolean" else c.cast("string")
        return F.when(c.isNotNull(), terms.literal(lexical, XSD + kind))

    def cast(self, t: Column, dt: str) -> Column:
        kind = dt.removeprefix(XSD)
        v = t["value"]
        to = {"integer": "decimal(38,0)", "int": "int", "long": "long", "double": "double", "float": "float", "decimal": "decimal(38,9)", "boolean": "boolean"}
        if kind == "string":
            c = v
        elif kind == "date":
            c = F.date_format(v.try_cast("timestamp"), "yyyy-MM-dd")
        elif kind == "dateTime":
            c = F.date_format(v.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
        elif kind in to:
            c = v.try_cast(to[kind]).cast("string")
        else:
            raise UnsupportedSparql(f"cast to xsd:{kind}")
        return F.when(c.isNotNull(), terms.literal(c, dt))

    def text(self, e, names) -> Column:
        if isinstance(e, Node):
            return F.lit(e.value)
        if isinstance(e, Var) or e.name in ("COALESCE", "IF", "IRI", "URI", "CAST", "NOW", "STRDT", "STRLANG", "DATATYPE"):
            t = self.as_term(e, names)
            return F.when(t["kind"] != "bnode", t["value"])
        kind, c = self.scalar(e, names)
        return c.cast("string")

    def numeric(self, e, names) -> Column:
        if isinstance(e, Call) and e.name not in ("COALESCE", "IF", "CAST"):
            kind, c = self.scalar(e, names)
            return c.try_cast("double") if kind == "string" else c.cast("double")
        if isinstance(e, Node):
            return F.lit(e.value).try_cast("double")
        return terms.number(self.as_term(e, names))

    def truth(self, e, names) -> Column:
        if isinstance(e, Call):
            if e.name == "&&":
                return self.truth(e.args[0], names) & self.truth(e.args[1], names)
            if e.name == "||":
                return self.truth(e.args[0], names) | self.truth(e.args[1], names)
            if e.name == "!":
                return ~self.truth(e.args[0], names)
            if e.name not in ("COALESCE", "IF", "CAST", "STRDT", "STRLANG", "IRI", "URI", "DATATYPE", "NOW"):
                kind, c = self.scalar(e, names)
                if kind == "boolean":
                    return c
                return (F.length(c) > 0) if kind == "string" else (c != 0)
        t = self.as_term(e, names)
        return F.when(t["dt"] == XSD + "boolean", t["value"].isin("true", "1")).when(terms.is_numeric(t), terms.number(t) != 0).when(t["kind"] == "lit", F.length(t["value"]) > 0)

    def compare(self, op: str, a, b, names) -> Column:
        if op in ("=", "!="):
            if isinstance(b, Node) and not isinstance(a, Node) and b.dt not in terms.NUMERIC and isinstance(a, Var):
                t = self.as_term(a, names)
                equal = (t["value"] == b.value) & (t["kind"] == b.kind) & (t["dt"] == b.dt) & (t["lang"] == b.lang)
            elif self._is_number(a) or self._is_number(b):
                equal = self.numeric(a, names) == self.numeric(b, names)
            elif self._is_text(a) or self._is_text(b):
                equal = self.text(a, names) == self.text(b, names)
            else:
                equal = terms.value_equal(self.as_term(a, names), self.as_term(b, names))
            return equal if op == "=" else ~equal
        use = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if self._is_number(a) or self._is_number(b):
            return use(self.numeric(a, names), self.numeric(b, names))
        if isinstance(a, Node) or isinstance(b, Node) or self._is_text(a) or self._is_text(b):
            return use(self.text(a, names), self.text(b, names))
        s, t = self.as_term(a, names), self.as_term(b, names)
        return F.when(terms.is_numeric(s) & terms.is_numeric(t), use(terms.number(s), terms.number(t))).otherwise(use(s["value"], t["value"]))

    NUMBERS = {"+", "-", "*", "/", "STRLEN", "ABS", "CEIL", "FLOOR", "ROUND", "YEAR", "MONTH", "DAY"}
    TEXTS = {"STR", "LANG", "CONCAT", "UCASE", "LCASE", "SUBSTR", "REPLACE", "STRBEFORE", "STRAFTER", "ENCODE_FOR_URI", "SHA256", "MD5"}

    def _is_number(self, e) -> bool:
        return isinstance(e, Node) and e.dt in terms.NUMERIC or isinstance(e, Call) and e.name in self.NUMBERS

    def _is_text(self, e) -> bool:
        return isinstance(e, Call) and e.name in self.TEXTS

    def scalar(self, e: Call, names) -> tuple[str, Column]:
        """(xsd type, column) of an operator or function."""
        name, args = e.name, e.args
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return "boolean", self.compare(name, *args, names)
        if name in ("&&", "||", "!"):
            return "boolean", self.truth(e, names)
        if name == "IN":
            first, *rest = args
            if isinstance(first, Var) and all(isinstance(x, Node) and x.kind == "iri" for x in rest):
                t = self.as_term(first, names)
                return "boolean", (t["kind"] == "iri") & t["value"].isin(*[x.value for x in rest])
            return "boolean", reduce(lambda x, y: x | y, [self.compare("=", first, x, names) for x in rest])
        if name in ("+", "-", "*", "/"):
            a, b = (self.numeric(x, names) for x in args)
            return "double", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[name]()
        if name == "BOUND":
            return "boolean", self.as_term(args[0], names).isNotNull()
        if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            return "boolean", self.as_term(args[0], names)["kind"] == {"ISBLANK": "bnode", "ISLITERAL": "lit"}.get(name, "iri")
        if name == "ISNUMERIC":
            return "boolean", terms.number(self.as_term(args[0], names)).isNotNull()
        if name == "SAMETERM":
            return "boolean", terms.term_equal(*(self.as_term(x, names) for x in args))
        if name == "LANGMATCHES":
            a, b = (F.lower(self.text(x, names)) for x in args)
            return "boolean", F.when(b == "*", F.length(a) > 0).otherwise((a == b) | a.startswith(F.concat(b, F.lit("-"))))
        if name == "LANG":
            t = self.as_term(args[0], names)
            return "string", F.when(t["kind"] == "lit", t["lang"])
        if name == "STR":
            return "string", self.text(args[0], names)
        texts = [self.text(x, names) for x in args]
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            return "double", {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": F.round}[name](self.numeric(args[0], names)).cast("double")
        if name in ("YEAR", "MONTH", "DAY"):
            when = texts[0].try_cast("timestamp")
            return "integer", {"YEAR": F.year, "MONTH": F.month, "DAY": F.day}[name](when)
        simple = {
            "CONCAT": ("string", lambda: F.concat(*texts)), "STRLEN": ("integer", lambda: F.length(texts[0])), "UCASE": ("string", lambda: F.upper(texts[0])), "LCASE": ("string", lambda: F.lower(texts[0])),
            "CONTAINS": ("boolean", lambda: texts[0].contains(texts[1])), "STRSTARTS": ("boolean", lambda: texts[0].startswith(texts[1])), "STRENDS": ("boolean", lambda: texts[0].endswith(texts[1])),
            "STRBEFORE": ("string", lambda: F.when(texts[0].contains(texts[1]), F.substring_index(texts[0], self._constant(args[1]), 1)).otherwise("")),
            "STRAFTER": ("string", lambda: F.when(texts[0].contains(texts[1]), F.substr(texts[0], F.instr(texts[0], self._constant(args[1])) + len(self._constant(args[1])))).otherwise("")),
            "ENCODE_FOR_URI": ("string", lambda: terms.percent_encode(texts[0], "uri")), "SHA256": ("string", lambda: F.sha2(texts[0], 256)), "MD5": ("string", lambda: F.md5(texts[0])),
        }
        if name in simple:
            kind, make = simple[name]
            return kind, make()
        if name == "SUBSTR":
            at = [self.numeric(x, names).cast("int") for x in args[1:]]
            return "string", F.substr(texts[0], *at)
        if name == "REGEX":
            flags = f"(?{self._constant(args[2])})" if len(args) > 2 else ""
            return "boolean", texts[0].rlike(flags + self._constant(args[1]))
        if name == "REPLACE":
            return "string", F.regexp_replace(texts[0], self._constant(args[1]), self._constant(args[2]))
        raise UnsupportedSparql(name)

    @staticmethod
    def _constant(e) -> str:
        if not isinstance(e, Node):
            raise UnsupportedSparql("a pattern that isn't a constant")
        return e.value

    # forms

    def select(self, q: Query, start: Solutions | None = None) -> Solutions:
        s = self.group(q.where, start)
        if q.group_by or any(self._aggregates(e) for e, _ in q.select):
            s = self.aggregate(s, q)
        elif q.select:
            names = self._names(s)
            cols = [(names.get(e.name, null_term()) if isinstance(e, Var) else self.as_term(e, names)).alias(n) for e, n in q.select]
            keep = [n for _, n in q.select]
            if q.order_by and not q.distinct:
                s = self.ordered(s, q, q.select)
                q = Query(**{**q.__dict__, "order_by": ()})
            s = Solutions(s.df.select(*cols), frozenset(n for e, n in q.select if not isinstance(e, Var) or e.name in s.maybe or e.name not in names), s.resources & frozenset(keep))
        else:
            s = Solutions(s.df.select(*[v for v in s.vars if not v.startswith("_")]), s.maybe, s.resources)
        if q.distinct:
            s = Solutions(s.df.distinct(), s.maybe, s.resources)
        if q.order_by:
            s = self.ordered(s, q, ())
        df = s.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, s.maybe, s.resources)

    def ordered(self, s: Solutions, q: Query, select) -> Solutions:
        """Rows by the keys (numbers by value before texts), then by all columns: a total order."""
        names = self._names(s)
        named = {n: e for e, n in select}
        keys = []
        for e, up in q.order_by:
            t = self.as_term(named.get(e.name, e) if isinstance(e, Var) and e.name not in names else e, names)
            for c in (terms.number(t), t["value"]):
                keys.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        rest = [F.col(f"`{v}`")["value"].asc_nulls_first() for v in s.vars]
        return Solutions(s.df.orderBy(*keys, *rest), s.maybe, s.resources)

    def _aggregates(self, e) -> bool:
        return isinstance(e, Call) and (e.name.startswith("AGG:") or any(self._aggregates(x) for x in e.args if isinstance(x, Call)))

    def aggregate(self, s: Solutions, q: Query) -> Solutions:
        names = self._names(s)
        df = s.df
        for e, n in q.group_by:
            if not isinstance(e, Var):
                df = df.withColumn(n, self.as_term(e, names))
        keys = [n for _, n in q.group_by]
        short = [n for n in keys if n in s.resources and n not in s.maybe and n not in {x for e, x in q.group_by if not isinstance(e, Var)}]
        made: dict[Call, str] = {}

        def place(e):
            if isinstance(e, Call) and e.name.startswith("AGG:"):
                return Var(made.setdefault(e, f"_agg{len(made)}"))
            if isinstance(e, Call):
                return Call(e.name, tuple(place(x) if isinstance(x, Call) else x for x in e.args))
            return e

        chosen = [(place(e), n) for e, n in q.select]
        alias = {n: e for e, n in q.select if not isinstance(e, Var)}

        def unalias(e):
            if isinstance(e, Var):
                return alias.get(e.name, e)
            return Call(e.name, tuple(unalias(x) if isinstance(x, (Call, Var)) and not e.name.startswith("AGG:") else x for x in e.args)) if isinstance(e, Call) else e

        having = [place(unalias(e)) for e in q.having]
        cols = [self._aggregate(e, names).alias(n) for e, n in made.items()]
        # a resource is its value and kind: groups hold these, not the whole term
        parts = [F.col(f"`{n}`")[x].alias(f"_{x}_{n}") if x else F.col(f"`{n}`") for n in keys for x in (("value", "kind") if n in short else ("",))]
        grouped = df.groupBy(*parts).agg(*cols) if cols else df.select(*parts).distinct()
        whole = [terms.term(F.col(f"`_kind_{n}`"), F.col(f"`_value_{n}`")).alias(n) if n in short else F.col(f"`{n}`") for n in keys]
        grouped = grouped.select(*whole, *made.values())
        g = Solutions(grouped, s.maybe & frozenset(keys), s.resources & frozenset(keys))
        for e in having:
            g = self.filter(g, e)
        names = self._names(g)
        return Solutions(g.df.select(*[self.as_term(e, names).alias(n) for e, n in chosen]), g.maybe, g.resources)

    def _aggregate(self, e: Call, names) -> Column:
        arg, distinct, sep = e.args
        kind = e.name[4:]
        if kind == "COUNT":
            if arg is None:
                c = F.count("*") if not distinct else F.count_distinct(*names.values())
            else:
                t = self.as_term(arg, names)
                c = F.count_distinct(t) if distinct else F.count(t)
            return terms.literal(c.cast("string"), XSD + "integer")
        t = self.as_term(arg, names)
        if kind in ("MIN", "MAX"):
            by = F.struct(terms.number(t).alias("n"), t["value"].alias("v"), t.alias("t"))
            return F.when(F.count(t) > 0, (F.min(F.when(t.isNotNull(), by)) if kind == "MIN" else F.max(F.when(t.isNotNull(), by)))["t"])
        if kind in ("SUM", "AVG"):
            n = terms.number(t)
            c = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg}[kind, distinct](n)
            return terms.literal(F.coalesce(c, F.lit(0.0)).cast("string"), XSD + "double")
        if kind == "SAMPLE":
            return F.min(t)
        values = F.collect_set(t["value"]) if distinct else F.collect_list(t["value"])
        return terms.literal(F.array_join(F.array_sort(values), sep), STRING)

    def construct(self, template: Sequence[Pattern], s: Solutions) -> DataFrame:
        """A set of quads; a row with an unbound variable of a triple, or a literal where none may be, gives none of it."""
        names = self._names(s)
        blanks = sorted({x.name for t in template for x in (t.s, t.p, t.o, t.g) if isinstance(x, Var) and x.name.startswith(("_blank", "_label_")) and x.name not in names})
        if blanks:
            row = F.sha2(F.to_json(F.struct(*[names[v].alias(v) for v in sorted(names)])) if names else F.lit(""), 256)
            names |= {b: terms.bnode(F.concat(F.lit("b"), F.substring(row, 1, 24), F.lit(b))) for b in blanks}
        parts = []
        for t in template:
            x = [constant(v) if isinstance(v, Node) else names.get(v.name, null_term()) for v in (t.s, t.p, t.o)]
            g = F.lit(None).cast("string") if t.g is None else (F.lit(t.g.value) if isinstance(t.g, Node) else names.get(t.g.name, null_term())["value"])
            row = s.df.select(
                g.alias("g"), x[0]["value"].alias("s"), x[0]["kind"].alias("s_kind"), x[1]["value"].alias("p"), x[1]["kind"].alias("p_kind"),
                x[2]["value"].alias("o"), x[2]["kind"].alias("o_kind"), x[2]["dt"].alias("o_dt"), x[2]["lang"].alias("o_lang"),
            )
            fine = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("s_kind") != "lit") & (F.col("p_kind") == "iri")
            if isinstance(t.g, Var):
                fine &= F.col("g").isNotNull()
            parts.append(row.where(fine).drop("p_kind"))
        return union(*parts, tasks=tasks_of(s.rows * len(template)) if s.rows and s.rows * len(template) > ROWS_A_TASK else None)


# Entry points


def select(source, text: str, prefixes=None, bindings: DataFrame | None = None, spark=None) -> DataFrame:
    """Solutions of a SELECT: one term struct a variable."""
    q = parse_query(text, prefixes)
    c = Compiler(source, spark, bindings)
    return c.select(q, Solutions(bindings, rows=c.rows) if bindings is not None else None).df


def values(df: DataFrame, **kinds: str) -> DataFrame:
    """The texts of all variables; kinds casts some, e.g. total="double"."""
    return df.select(*[(F.col(f"`{v}`")["value"].cast(kinds[v]) if v in kinds else F.col(f"`{v}`")["value"]).alias(v) for v in df.columns])


def ask(source, text: str, prefixes=None, bindings: DataFrame | None = None) -> bool:
    q = parse_query(text, prefixes)
    c = Compiler(source, None, bindings)
    return bool(c.group(q.where, Solutions(bindings) if bindings is not None else None).df.limit(1).count())


def ask_each(source, text: str, bindings: DataFrame, prefixes=None) -> DataFrame:
    """bindings with a column `holds`: the ASK for every row at once, by one join."""
    q = parse_query(text, prefixes)
    c = Compiler(source, None, bindings)
    met = c.group(q.where, Solutions(bindings.distinct())).df.select(*bindings.columns).distinct().withColumn("holds", F.lit(True))
    on = reduce(lambda x, y: x & y, [F.col(f"b.{v}").eqNullSafe(F.col(f"m.{v}")) for v in bindings.columns])
    out = bindings.alias("b").join(met.alias("m"), on, "left")
    return out.select("b.*", F.coalesce("m.holds", F.lit(False)).alias("holds"))


def construct(source, text: str, prefixes=None, bindings: DataFrame | None = None, spark=None) -> DataFrame:
    q = parse_query(text, prefixes)
    c = Compiler(source, spark, bindings)
    s = c.group(q.where, Solutions(bindings) if bindings is not None else None)
    return c.construct(q.template, s)


def apply_update(quads: DataFrame, update: Update, spark: SparkSession | None = None, bindings: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """New state: (old - deletes) + inserts, both evaluated on the old state."""
    if update.kind == "clear":
        g = update.graphs[0]
        return quads.where(F.col("g").isNotNull() if g is None else ~F.col("g").eqNullSafe(F.lit(g)))
    if update.kind == "move":
        a, b = update.graphs
        rest = quads.where(~F.col("g").eqNullSafe(F.lit(b)))
        return set_of(rest.withColumn("g", F.when(F.col("g").eqNullSafe(F.lit(a)), F.lit(b).cast("string")).otherwise(F.col("g"))))
    c = Compiler(quads, spark or quads.sparkSession, bindings, now)
    s = c.group(update.where, Solutions(bindings) if bindings is not None else None)
    out = quads
    if update.delete:
        gone = c.construct(update.delete, s)
        out = difference(out, gone) if any(t.g is not None for t in update.delete) else difference(out, gone.withColumn("g", F.lit(None).cast("string")))
    if update.insert:
        out = union(out, c.construct(update.insert, s))
    return out


def update(quads: DataFrame | QuadSource, text: str, prefixes=None, bindings: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """The quads after all updates of a text, each on the state that the one before left."""
    state = dataset(quads)
    for u in parse_update(text, prefixes):
        state = apply_update(state, u, bindings=bindings, now=now)
    return state


def bindings_of(df: DataFrame, **columns: str) -> DataFrame:
    """A bindings table from columns of IRIs: bindings_of(df, uri="id")."""
    return df.select(*[terms.iri(F.col(c)).alias(v) for v, c in columns.items()])


__all__ = ["COLUMNS", "Compiler", "Solutions", "apply_update", "ask", "ask_each", "bindings_of", "construct", "select", "update", "values"]
