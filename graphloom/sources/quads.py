"""Quads as flat columns, and sources of triple patterns.

    quads: g, s, s_kind, p, o, o_kind, o_dt, o_lang      all strings; g is null in the default graph

Columns are flat so that Parquet statistics and pushed filters work on p, s and o. A source answers scan(predicates,
graphs): the quads with one of these predicates (None: any). A query names its predicates at plan time, so only their
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.terms import LANG_STRING, RDF_TYPE, STRING, TERM, XSD

COLUMNS = ("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
TRIPLE = COLUMNS[1:]


class QuadSource(Protocol):
    def scan(self, predicates: Sequence[str] | None = None) -> DataFrame: ...


class FrameSource:
    """Quads in a DataFrame."""

    def __init__(self, quads: DataFrame, rows: int | None = None):
        """rows: how many there are, if that is known; joins of many rows are then dealt out by it."""
        self.quads, self.known_rows = quads.select(*COLUMNS), rows

    def scan(self, predicates: Sequence[str] | None = None) -> DataFrame:
        return self.quads if predicates is None else self.quads.where(F.col("p").isin(*predicates))


def as_source(quads: DataFrame | QuadSource) -> QuadSource:
    return FrameSource(quads) if isinstance(quads, DataFrame) else quads


def dataset(quads: DataFrame | QuadSource) -> DataFrame:
    return as_source(quads).scan(None)


def quads_of(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Quads of (s, p, o[, g]) texts in N-Triples terms, for tests and small inputs."""
    from graphloom.sources.rdf import parse_node

    out = []
    for s, p, o, *g in rows:
        sk, sv, _, _ = parse_node(s)
        ok, ov, dt, lang = parse_node(o)
        out.append((parse_node(g[0])[1] if g and g[0] else None, sv, sk, parse_node(p)[1], ov, ok, dt, lang))
    return spark.createDataFrame(out, SCHEMA)


def set_of(quads: DataFrame, tasks: int | None = None) -> DataFrame:
    """A graph is a set: repeated quads go. With a number of tasks, rows are dealt out to so many before any are held."""
    rows = quads.select(*COLUMNS)
    return (rows.repartition(tasks, "s", "p", "o") if tasks else rows).dropDuplicates()


def union(*parts: DataFrame, tasks: int | None = None) -> DataFrame:
    return set_of(reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts]), tasks)


def same_quad(a: DataFrame, b: DataFrame, columns: Sequence[str] = COLUMNS) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) if c == "g" else a[c] == b[c] for c in columns])


def difference(a: DataFrame, b: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Quads of a that aren't in b, by term equality."""
    a, b = a.alias("a"), b.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "g" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in columns])
    return set_of(a.join(b, on, "left_anti"))


def relaxed(quads: DataFrame) -> DataFrame:
    """The default graph as the union of all graphs."""
    return quads.withColumn("g", F.lit(None).cast("string")).dropDuplicates()


# Direct mapping of tables

#: Key columns of each table; a key of several columns is joined by "-".
KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"),
}
#: Columns that refer to a row of another table.
REFERENCES: dict[str, str] = {
    "n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier",
}
#: Columns whose text is in the language that another column names.
LANGUAGES: dict[tuple[str, str], str] = {("documents", "text"): "lang"}
DATATYPES = {"string": STRING, "int": XSD + "int", "bigint": XSD + "long", "double": XSD + "double", "float": XSD + "float", "timestamp": XSD + "dateTime", "timestamp_ntz": XSD + "dateTime", "date": XSD + "date", "boolean": XSD + "boolean"}


def lexical(column: Column, kind: str) -> Column:
    """The lexical form of a table's value."""
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return column.cast("string")


class TableSource:
    """Tables as triples, by a direct mapping made at plan time.

    A row is urn:<table>:<key>, its columns urn:<table>#<column>, its class urn:<table>; a reference is the IRI of the
    row it names; nulls give nothing. graph: a function from a table's name to a Column that names the graph.
    """

    def __init__(self, spark: SparkSession, path: str, tables: Sequence[str] | None = None, graph=None):
        self.spark, self.path, self.graph = spark, path.rstrip("/"), graph
        self.tables = tuple(tables or KEYS)
        self._frames: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._frames[name]

    def rows_of(self, name: str) -> int:
        """Rows of a table, from its files' footers."""
        if name not in self._rows:
            self._rows[name] = self.table(name).count()
        return self._rows[name]

    def subject(self, table: str, *columns: str) -> Column:
        columns = columns or KEYS[table]
        return F.concat(F.lit(f"urn:{table}:"), F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))

    def owner(self, predicate: str, o=None) -> str | None:
        """The table that alone has triples of this predicate (of rdf:type: with this object)."""
        if predicate == RDF_TYPE:
            name = o.removeprefix("urn:") if o else None
        else:
            name = predicate.removeprefix("urn:").partition("#")[0] if predicate.startswith("urn:") else None
        return name if name in self.tables else None

    def star(self, table: str, predicates: Sequence[str]) -> DataFrame:
        """One row a subject that has all predicates: s, and a term struct for each, named by its place.

        Columns of a table have one value a row, so patterns with one subject need one scan and no join.
        """
        df, cols = self.table(table), []
        for i, p in enumerate(predicates):
            if p == RDF_TYPE:
                o, o_kind, dt, lang = F.lit(f"urn:{table}"), "iri", F.lit(""), F.lit("")
            else:
                name = p.partition("#")[2]
                if name not in df.columns:
                    return df.limit(0).select(F.lit("").alias("s"), *[F.lit(None).cast(TERM).alias(f"o{k}") for k in range(len(predicates))])
                df = df.where(F.col(name).isNotNull())
                o, o_kind, dt, lang = self._object(table, name)
            cols.append(F.struct(F.lit(o_kind).alias("kind"), o.alias("value"), dt.alias("dt"), lang.alias("lang")).alias(f"o{i}"))
        return df.select(self.subject(table).alias("s"), *cols)

    def refers(self, table: str, predicate: str) -> bool:
        """Whether all objects of a table's predicate are IRIs."""
        name = predicate.partition("#")[2]
        target = REFERENCES.get(name)
        return predicate == RDF_TYPE or bool(target) and (table, name) != (target, KEYS[target][0])

    def _object(self, table: str, name: str) -> tuple[Column, str, Column, Column]:
        kind = dict(self.table(table).dtypes)[name]
        if self.refers(table, f"urn:{table}#{name}"):
            target = REFERENCES[name]
            o, o_kind, dt, lang = self.subject(target, name), "iri", F.lit(""), F.lit("")
        else:
            o, o_kind, dt, lang = lexical(F.col(name), kind), "lit", F.lit(DATATYPES.get(kind, STRING)), F.lit("")
            if (table, name) in LANGUAGES:
                lang = F.coalesce(F.col(LANGUAGES[table, name]), F.lit(""))
                dt = F.when(lang != "", F.lit(LANG_STRING)).otherwise(dt)
        return o, o_kind, dt, lang

    def _column(self, table: str, name: str) -> DataFrame:
        return self._select(self.table(table).where(F.col(name).isNotNull()), table, f"urn:{table}#{name}", *self._object(table, name))

    def _select(self, df, table, p, o, o_kind, dt, lang) -> DataFrame:
        g = self.graph(table) if self.graph else F.lit(None).cast("string")
        return df.select(
            g.alias("g"), self.subject(table).alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"),
            o.alias("o"), F.lit(o_kind).alias("o_kind"), dt.alias("o_dt"), lang.alias("o_lang"),
        )

    def _types(self, table: str) -> DataFrame:
        return self._select(self.table(table), table, RDF_TYPE, F.lit(f"urn:{table}"), "iri", F.lit(""), F.lit(""))

    def scan(self, predicates: Sequence[str] | None = None) -> DataFrame:
        parts = []
        for t in self.tables:
            if predicates is None or RDF_TYPE in predicates:
                parts.append(self._types(t))
            names = [c for c, kind in self.table(t).dtypes if not kind.startswith("array")] if predicates is None or any(p.startswith(f"urn:{t}#") for p in predicates) else []
            parts += [self._column(t, c) for c in names if predicates is None or f"urn:{t}#{c}" in predicates]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return reduce(DataFrame.unionAll, parts)


class UnionSource:
    """Several sources as one; their quads must not repeat, or callers take set_of()."""

    def __init__(self, *sources: QuadSource):
        self.sources = sources

    def scan(self, predicates: Sequence[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.scan(predicates) for s in self.sources])


def prefix_map(tables: Sequence[str] = tuple(KEYS)) -> Mapping[str, str]:
    """Prefixes t: for the columns of each table t."""
    return {t: f"urn:{t}#" for t in tables}
