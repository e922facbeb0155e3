"""Search indexes as tables: documents by id, built from configurations, swapped by alias, refreshed and collected."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators import documents as docs
from graphloom.operators.profile import DocProfile
from graphloom.plans import compiler
from graphloom.sources.shared import cut
from graphloom.sources.quads import union

COLUMNS = "id string, graph string, type string, timestampms long, json string"


@dataclass(frozen=True)
class Partition:
    """One part of an index: SELECTs of IRIs, CONSTRUCTs of their models, facet queries."""

    name: str
    selects: tuple[str, ...]
    constructs: tuple[str, ...]
    facets: tuple[str, ...] = ()


class IndexError_(ValueError):
    """An index configuration or state that can't be used."""


def uris(source, partition: Partition, prefixes=None, only: DataFrame | None = None) -> DataFrame:
    """s: the distinct IRIs of all SELECTs; with `only` (column s), those among them."""
    parts = []
    for text in partition.selects:
        rows = compiler.select(source, text, prefixes)
        if len(rows.columns) != 1:
            raise IndexError_("a SELECT of an index gives one column")
        parts.append(rows.select(F.col(f"`{rows.columns[0]}`")["value"].alias("s")))
    found = reduce(DataFrame.unionAll, parts).distinct()
    return found.join(only.select("s"), "s", "left_semi") if only is not None else found


def build(source, partitions: Sequence[Partition], profile: DocProfile, prefixes=None, now_ms: int = 0, only: DataFrame | None = None) -> DataFrame:
    """Rows of an index for all IRIs of all partitions: model, document and facets, without a loop over IRIs."""
    if not any(p.selects and p.constructs for p in partitions):
        raise IndexError_("an index needs a partition with SELECT and CONSTRUCT")
    out = []
    for p in partitions:
        roots = uris(source, p, prefixes, only)
        model = union(*[compiler.construct(source, c, prefixes) for c in p.constructs])
        rows = docs.to_rows(model, profile, roots)
        types = rows.where("level = 0").select("doc", "type").distinct()
        table = docs.to_json(rows, prefixes or terms.PREFIXES).join(types, "doc")
        text = F.col("json")
        if p.facets:
            f = docs.facet_json(docs.facets(model, p.facets, prefixes, "first_sorted", roots)).select(F.col("root").alias("doc"), "facets")
            table = table.join(f, "doc", "left")
            text = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"facets":'), F.coalesce("facets", F.lit("{}")), F.lit("}"))
        out.append(table.select(F.col("doc").alias("id"), F.lit(None).cast("string").alias("graph"), "type", F.lit(now_ms).cast("long").alias("timestampms"), text.alias("json")))
    return reduce(DataFrame.unionByName, out)


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new rows by id; of repeated ids the latest."""
    order = Window.partitionBy("id").orderBy(F.desc("timestampms"), F.desc("json"))
    return index.unionByName(new).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def collect_garbage(index: DataFrame, before_ms: int, graph: str | None = None) -> DataFrame:
    """The index without documents older than a time, in one graph or all."""
    old = F.col("timestampms") < before_ms
    return index.where(~(old & (F.col("graph").eqNullSafe(F.lit(graph)) if graph is not None else F.lit(True))))


def delete_graph(index: DataFrame, graph: str) -> DataFrame:
    return index.where(~F.col("graph").eqNullSafe(F.lit(graph)))


def by_type(index: DataFrame, type_: str) -> DataFrame:
    return index.where(F.get_json_object("json", "$.data.type") == type_)


def search(index: DataFrame, equal: Mapping[str, str], limit: int | None = None) -> DataFrame:
    """Documents whose JSON paths have these texts, by id; the limit is the caller's page."""
    for path, text in equal.items():
        index = index.where(F.get_json_object("json", path) == text)
    return index.orderBy("id").limit(limit) if limit is not None else index


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (column id) with found and json."""
    return ids.join(index.select("id", "json"), "id", "left").select("id", F.col("json").isNotNull().alias("found"), "json")


def reindex(rows: DataFrame, make: Callable[[DataFrame], DataFrame], attempts: int = 5) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(index rows, failures, summary) of rows (graph, uri, type, index); make adds json and error.

    Failures run again, up to so many times; those of the last attempt are returned with their errors, none is lost.
    """
    if not {"graph", "uri", "type", "index"} <= set(rows.columns):
        raise IndexError_("a re-index needs graph, uri, type and index")
    began, todo, done, failed = time.time(), rows, None, None
    for _ in range(attempts):
        got = cut(make(todo))
        good = got.where("error is null").select(F.col("uri").alias("id"), "graph", "type", "json")
        done = good if done is None else done.unionByName(good)
        failed = got.where("error is not null").select(*rows.columns, "error")
        todo = failed.drop("error")
        if not failed.limit(1).count():
            break
    n, lost = done.count(), failed.count()
    return done, failed, {"total": rows.count(), "indexed": n, "failed": lost, "seconds": time.time() - began}


def type_plan(source, type_iri: str, type_id: str, index: str) -> DataFrame:
    """(graph, uri, type, index) of all instances of a class in named graphs."""
    rows = compiler.select(source, f"SELECT DISTINCT ?graph ?uri WHERE {{ GRAPH ?graph {{ ?uri a <{type_iri}> }} }}")
    return rows.select(F.col("graph.value").alias("graph"), F.col("uri.value").alias("uri"), F.lit(type_id).alias("type"), F.lit(index).alias("index"))


class IndexStore:
    """Indexes as Parquet folders, aliases as pointers: <folder>/<index>, <folder>/_alias/<name>."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, name: str, rows: DataFrame, mode: str = "error") -> None:
        rows.select("id", "graph", "type", "timestampms", "json").write.mode(mode).parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        """An index, or the one that an alias names."""
        return self.spark.read.schema(COLUMNS).parquet(f"{self.folder}/{self.alias(name) or name}")

    def delete(self, name: str) -> None:
        """Without an error if there is no such index."""
        p, fs = self._path(name)
        fs.delete(p, True)

    def _pointers(self, name: str) -> list[int]:
        p, fs = self._path(f"_alias/{name}")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []

    def alias(self, name: str) -> str | None:
        """The index that the alias's newest pointer names."""
        have = self._pointers(name)
        return self.spark.read.text(f"{self.folder}/_alias/{name}/{have[-1]}").first()["value"] if have else None

    def names(self) -> list[str]:
        p, fs = self._path("")
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if not x.getPath().getName().startswith("_")) if fs.exists(p) else []

    def rebuild(self, alias: str, rows: DataFrame, now_ms: int | None = None) -> str:
        """Fill a new index <alias>-<milliseconds>, point the alias at it, then delete the one before."""
        new, old = f"{alias}-{now_ms if now_ms is not None else int(time.time() * 1000)}", self.alias(alias)
        self.write(new, rows)
        have = self._pointers(alias)
        staged = f"_alias/.{alias}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(new,)], "value string").coalesce(1).write.text(f"{self.folder}/{staged}")
        (a, fs), (b, _), (home, _) = self._path(staged), self._path(f"_alias/{alias}/{(have or [0])[-1] + 1}"), self._path(f"_alias/{alias}")
        fs.mkdirs(home)
        if fs.exists(b) or not fs.rename(a, b):
            raise IndexError_(f"another rebuild of {alias} came first")
        for n in have:
            fs.delete(self._path(f"_alias/{alias}/{n}")[0], True)
        if old and old != new:
            self.delete(old)
        return new

    def metadata(self) -> DataFrame:
        """(name, aliases, count, bytes) of all indexes."""
        p, fs = self._path("_alias")
        aliases = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        pointed: dict[str, list[str]] = {}
        for a in aliases:
            if not a.startswith("."):
                pointed.setdefault(self.alias(a), []).append(a)
        rows = []
        for n in self.names():
            path, _ = self._path(n)
            rows.append((n, sorted(pointed.get(n, [])), self.read(n).count(), fs.getContentSummary(path).getLength()))
        return self.spark.createDataFrame(rows, "name string, aliases array<string>, count long, bytes long")
