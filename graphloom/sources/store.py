"""Stores of named graphs: an in-memory one, a Parquet one with snapshots, and the contract that both keep.

A store's state is an immutable DataFrame; an update makes the next one. A Parquet store is a log of versions. Each names a
snapshot and the changes since, so adding or removing quads writes those alone; a version appears by one rename under a name
of its own, so readers see one state or the other, and a failed write changes nothing.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE
from graphloom.plans import compiler
from graphloom.sources.quads import COLUMNS, SCHEMA, difference, relaxed, set_of, union


class StoreError(RuntimeError):
    """A store that isn't ready, a query that took too long, a write where none is allowed, or another writer's version in the way."""


def _refuse(state: DataFrame) -> None:
    raise StoreError("a write inside a read")


class QuadStore:
    """A store over a DataFrame."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None):
        self.spark = spark
        self._state = set_of(quads) if quads is not None else spark.createDataFrame([], SCHEMA)

    @property
    def quads(self) -> DataFrame:
        return self._state

    def _replace(self, state: DataFrame) -> None:
        self._state = state

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """A delta at once: all deletes before all inserts."""
        state = self.quads if removed is None else difference(self.quads, removed)
        self._replace(state if added is None else union(state, added))

    def scan(self, predicates: Sequence[str] | None = None) -> DataFrame:
        return self.quads if predicates is None else self.quads.where(F.col("p").isin(*predicates))

    # queries

    def select(self, text: str, prefixes=None, bindings: DataFrame | None = None) -> DataFrame:
        return compiler.select(self, text, prefixes, bindings, self.spark)

    def ask(self, text: str, prefixes=None, bindings: DataFrame | None = None) -> bool:
        return compiler.ask(self, text, prefixes, bindings)

    def construct(self, text: str, prefixes=None, bindings: DataFrame | None = None) -> DataFrame:
        return compiler.construct(self, text, prefixes, bindings, self.spark)

    def update(self, text: str, prefixes=None, bindings: DataFrame | None = None, now: str | None = None) -> None:
        self._replace(compiler.update(self.quads, text, prefixes, bindings, now))

    @contextmanager
    def transaction(self, write: bool = False) -> Iterator[QuadStore]:
        """One state for all reads inside; what is written inside appears at its end as one change, or not at all if it fails.

        A read inside a transaction joins it; a write inside a read is an error.
        """
        outer = getattr(self, "_open", None)
        if outer is not None:
            if write and not outer.writes:
                raise StoreError("a write inside a read")
            yield outer
            return
        inner = QuadStore(self.spark)
        inner._state, inner.writes, began = self.quads, write, self.quads
        if not write:
            inner._replace = _refuse  # type: ignore[method-assign]
        self._open = inner._open = inner
        try:
            yield inner
            if write and inner._state is not began:
                self._replace(inner._state)
        finally:
            self._open = None

    # graphs

    def graph(self, name: str | None) -> DataFrame:
        return self.quads.where(F.col("g").eqNullSafe(F.lit(name)))

    def union_graph(self) -> DataFrame:
        return relaxed(self.quads)

    def add_data(self, quads: DataFrame, graph: str | None = None) -> None:
        rows = quads if graph is None else quads.withColumn("g", F.lit(graph))
        self.change(added=rows)

    def remove_data(self, quads: DataFrame) -> None:
        self.change(removed=quads)

    def delete_graph(self, name: str | None) -> None:
        self.change(removed=self.graph(name))

    def replace_graph(self, name: str, quads: DataFrame) -> None:
        """Clear, then add."""
        self.change(added=quads.withColumn("g", F.lit(name)), removed=self.graph(name))

    def move_graph(self, a: str, b: str) -> None:
        self.update(f"MOVE GRAPH <{a}> TO GRAPH <{b}>")

    def copy_graph(self, a: str, b: str) -> None:
        self.change(added=self.graph(a).withColumn("g", F.lit(b)))

    def graphs(self) -> DataFrame:
        return self.quads.where(F.col("g").isNotNull()).select("g").distinct()

    def graph_exists(self, name: str, typed: bool = True) -> bool:
        """Whether the graph has a typed subject, or any triple if not typed."""
        rows = self.graph(name)
        return bool((rows.where(F.col("p") == RDF_TYPE) if typed else rows).limit(1).count())

    def check_existing(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """ids with `exists`: whether each IRI has an rdf:type, by one join."""
        typed = self.scan([RDF_TYPE]).select(F.col("s").alias("_s")).distinct()
        return ids.join(typed, F.col(column) == F.col("_s"), "left").select(*ids.columns, F.col("_s").isNotNull().alias("exists"))

    def persist_with_backup(self, name: str, make: Callable[[], DataFrame]) -> None:
        """Replace a graph by what make() gives; if that fails, the graph stays as it was."""
        before = self.quads
        try:
            self.replace_graph(name, make())
        except Exception:
            self._replace(before)
            raise


class ParquetStore(QuadStore):
    """A store in a folder: <folder>/parts/<id> holds quads laid out by predicate, <folder>/versions/v-<number> names parts.

    A version is a list of ("base" | "remove" | "add", part), applied in order. After MAX_PARTS of them the next change writes a
    base again. A write that fails marks the store as not ready; reopen() takes it up again.
    """

    MAX_PARTS = 16

    def __init__(self, spark: SparkSession, folder: str, preload: DataFrame | None = None):
        super().__init__(spark)
        self.folder, self.ready = folder.rstrip("/"), True
        if not self.versions():
            self._replace(preload if preload is not None else spark.createDataFrame([], SCHEMA))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions, oldest first."""
        p, fs = self._fs(f"{self.folder}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v-"))

    def parts(self, version: int | None = None) -> list[tuple[str, str]]:
        version = version if version is not None else self.versions()[-1]
        return [tuple(x) for x in json.loads(self.spark.read.text(f"{self.folder}/versions/v-{version:012d}").first()["value"])]

    def at(self, version: int | None = None) -> DataFrame:
        """The state of a version, the newest one by default."""
        if not self.ready:
            raise StoreError("the store isn't ready after a failed write")
        state = None
        for kind, part in self.parts(version):
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/parts/{part}")
            state = rows if kind == "base" else difference(state, rows) if kind == "remove" else union(state, rows)
        return state

    @property
    def quads(self) -> DataFrame:
        return self.at()

    def _write(self, kind: str, rows: DataFrame) -> tuple[str, str]:
        part = uuid.uuid4().hex
        rows.select(*COLUMNS).sortWithinPartitions("p", "s").write.parquet(f"{self.folder}/parts/{part}")
        return kind, part

    def _commit(self, version: int, parts: list[tuple[str, str]]) -> None:
        staged, fs = self._fs(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        self.spark.createDataFrame([(json.dumps(parts),)], "value string").coalesce(1).write.text(staged.toString())
        target, _ = self._fs(f"{self.folder}/versions/v-{version:012d}")
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, True)
            raise StoreError(f"version {version} is there already")

    def _guarded(self, write: Callable[[], list[tuple[str, str]]]) -> None:
        if not self.ready:
            raise StoreError("the store isn't ready after a failed write")
        next_ = (self.versions() or [0])[-1] + 1
        try:
            self._commit(next_, write())
        except StoreError:
            raise
        except Exception:
            self.ready = False
            raise

    def _replace(self, state: DataFrame) -> None:
        self._guarded(lambda: [self._write("base", state)])

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        old = self.parts()
        if len(old) >= self.MAX_PARTS:
            return super().change(added, removed)
        deltas = [("remove", removed), ("add", added)]
        self._guarded(lambda: [*old, *(self._write(kind, set_of(rows)) for kind, rows in deltas if rows is not None)])

    def reopen(self) -> None:
        """Ready again, with the newest version that is whole."""
        self.ready = True

    def compact(self, files: int = 1) -> None:
        """Rewrite the state in fewer files."""
        self._replace(self.quads.coalesce(files))

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest versions, and parts that none of those names. No writer may be at work."""
        versions = self.versions()
        used = {part for v in versions[-keep:] for _, part in self.parts(v)}
        for v in versions[:-keep]:
            p, fs = self._fs(f"{self.folder}/versions/v-{v:012d}")
            fs.delete(p, True)
        p, fs = self._fs(f"{self.folder}/parts")
        for x in fs.listStatus(p):
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)

    def rows(self, df: DataFrame, seconds: float = 1800) -> list:
        """What a query collects; its jobs are cancelled, and StoreError raised, after so many seconds."""
        context, group, late = self.spark.sparkContext, f"store-{uuid.uuid4().hex}", threading.Event()

        def stop():
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        context.setJobGroup(group, "store query", interruptOnCancel=True)
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            if late.is_set():
                raise StoreError(f"a query took more than {seconds} s") from e
            raise
        finally:
            timer.cancel()
            context.setJobGroup("", "")


def delete_and_insert(store: QuadStore, added: DataFrame, removed: DataFrame) -> None:
    """A delta at once: all deletes before all inserts."""
    store.change(added, removed)
