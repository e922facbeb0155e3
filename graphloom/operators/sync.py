"""Deltas, graph synchronisation by stamp, graph composition, and paging shims."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import RDF_TYPE, XSD
from graphloom.operators.ranks import comparable, ranked
from graphloom.operators.rules import convert
from graphloom.plans import compiler
from graphloom.sources.quads import as_source, difference, set_of, union
from graphloom.sources.shared import shared_dir

# Deltas


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(action, quad...): what to add and remove, by term identity."""
    plus, minus = difference(new, old).withColumn("action", F.lit("add")), difference(old, new).withColumn("action", F.lit("remove"))
    return plus.unionByName(minus)


def merge_deltas(*deltas: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, deltas).distinct()


def apply_delta(quads: DataFrame, d: DataFrame) -> DataFrame:
    """All removals before all additions."""
    return union(difference(quads, d.where("action = 'remove'")), d.where("action = 'add'"))


def delta_text(d: DataFrame, batch: int = 1000) -> DataFrame:
    """(seq, text): DELETE DATA batches, then INSERT DATA batches, each of at most so many triples, in order of the triples."""
    o = terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    blank = F.raise_error(F.lit("a blank node has no place in an update text")).cast("string")
    ot = F.when(F.col("o_kind") == "bnode", blank).when(F.col("o_kind") == "lit", terms.sparql_literal(o)).otherwise(terms.ntriples(o))
    line = F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), ot, F.lit(" ."))
    line = F.when(F.col("g").isNotNull(), F.concat(F.lit("GRAPH <"), F.col("g"), F.lit("> { "), line, F.lit(" }"))).otherwise(line)
    rows = d.select(F.when(F.col("action") == "remove", 0).otherwise(1).alias("step"), line.alias("line"))
    rows = ranked(rows, "step", "line")
    first = rows.groupBy("step").agg(F.min("n").alias("first"))
    dealt = rows.join(F.broadcast(first), "step").withColumn("seq", F.floor((F.col("n") - F.col("first")) / batch))
    word = F.when(F.col("step") == 0, "DELETE DATA { ").otherwise("INSERT DATA { ")
    texts = dealt.groupBy("step", "seq").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("t"))
    return texts.select("step", "seq", F.concat(word, "t", F.lit(" }")).alias("text")).orderBy("step", "seq")


def stamp_resources(quads: DataFrame, subjects: DataFrame, now: str, created: str = terms.DCT + "created", modified: str = terms.DCT + "modified") -> DataFrame:
    """modified = now for each subject (column s), created too where it has none."""
    one = subjects.select("s").distinct()
    kept = quads.join(one.withColumn("_hit", F.lit(True)), "s", "left").where(~(F.col("_hit").isNotNull() & (F.col("p") == modified))).drop("_hit")
    fact = lambda df, p: df.select(F.lit(None).cast("string").alias("g"), "s", F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), F.lit(now).alias("o"), F.lit("lit").alias("o_kind"), F.lit(XSD + "dateTime").alias("o_dt"), F.lit("").alias("o_lang"))
    fresh = one.join(quads.where(F.col("p") == created).select("s"), "s", "left_anti")
    return union(kept, fact(one, modified), fact(fresh, created))


def upsert(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Every triple of new's subjects replaced by new's."""
    return union(quads.join(new.select("s").distinct(), "s", "left_anti"), new)


# Synchronisation


def stamps(source, query: str, prefixes=None) -> DataFrame:
    """(graph, stamp) of a query that projects exactly these; of repeated graphs the least stamp."""
    rows = compiler.select(source, query, prefixes)
    if sorted(rows.columns) != ["graph", "stamp"]:
        raise ValueError(f"the query gives {rows.columns}, not graph and stamp")
    flat = rows.select(F.col("graph.value").alias("graph"), F.col("stamp.value").alias("stamp"))
    return flat.groupBy("graph").agg(F.min("stamp").alias("stamp"))


def sync_actions(source: DataFrame, target: DataFrame, force: bool = False) -> DataFrame:
    """(graph, source_stamp, target_stamp, action): update, delete or none. Rows are (graph, stamp).

    Update where the source has no stamp, the target lacks the graph, or stamps differ; delete what the source lacks.
    """
    s, t = source.select("graph", F.col("stamp").alias("source_stamp"), F.lit(True).alias("in_source")), target.select("graph", F.col("stamp").alias("target_stamp"), F.lit(True).alias("in_target"))
    both = s.join(t, "graph", "full")
    same = F.col("source_stamp").isNotNull() & F.col("source_stamp").eqNullSafe(F.col("target_stamp")) & F.col("in_target").isNotNull()
    action = F.when(F.col("in_source").isNull(), "delete").when(same & F.lit(not force), "none").otherwise("update")
    return both.select("graph", "source_stamp", "target_stamp", action.alias("action"))


def synchronise(
    source: DataFrame, target: DataFrame, query: str, rules: Sequence[str], stamp_predicate: str, new_stamp: str, prefixes=None, only: Sequence[str] | None = None, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(new source, new target): graphs to update are rebuilt by constructs over the source and stamped; a second run does nothing.

    A graph that is empty in the source counts as deleted; a missing stamp is made and written to the source. The stamp
    of a graph hangs on the subject that has it, or on the graph's IRI.
    """
    actions = sync_actions(stamps(source, query, prefixes), stamps(target, query, prefixes), force)
    if only is not None:
        actions = actions.where(F.col("graph").isin(*only))
    todo = actions.where("action = 'update'").join(source.select(F.col("g").alias("graph")).distinct(), "graph", "left_semi")
    gone = actions.where("action != 'none'").select(F.col("graph").alias("g"))
    bare = todo.where("source_stamp is null")
    made = bare.select(
        F.col("graph").alias("g"), F.col("graph").alias("s"), F.lit("iri").alias("s_kind"), F.lit(stamp_predicate).alias("p"),
        F.lit(new_stamp).alias("o"), F.lit("lit").alias("o_kind"), F.lit(XSD + "dateTime").alias("o_dt"), F.lit("").alias("o_lang"),
    )
    new_source = union(source, made)
    picked = new_source.join(todo.select(F.col("graph").alias("g")), "g", "left_semi")
    built = convert(picked, rules, prefixes)
    stamped = picked.where(F.col("p") == stamp_predicate)
    return new_source, union(target.join(gone, "g", "left_anti"), built, stamped)


# Composition


def route(statements: DataFrame, rules: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """Statements with g: every graph whose rule fits the subject, an IRI or ~regex; else the default graph.

    rules are (pattern, graph); they are of configuration size and become one array expression.
    """
    fits = [F.when(F.col("s").rlike(f"^(?:{p[1:]})$") if p.startswith("~") else F.col("s") == p, F.lit(g)) for p, g in rules]
    graphs = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    return set_of(statements.withColumn("g", F.explode(F.when(F.size(graphs) > 0, F.array_distinct(graphs)).otherwise(F.array(F.lit(default))))))


def next_version(values, pattern: str):
    """1 + the greatest number that the pattern's first group takes from a column; 0 without any."""
    return F.coalesce(F.max(F.regexp_extract(values, pattern, 1).try_cast("int")) + 1, F.lit(0))


@dataclass(frozen=True)
class Template:
    """A subject to make for each row: graph and subject are texts with ${column} places; attributes are (predicate, text, mode, datatype).

    mode: add, unique (an error if there is a value already) or replace. exists names a column; rows where it is "false" go.
    """

    graph: str
    subject: str
    attributes: tuple[tuple[str, str, str, str], ...] = ()
    type: str | None = None
    exists: str | None = None


def _place(text: str):
    parts = re.split(r"\$\{(\w+)\}", text)
    return F.concat(*[F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x != "" or len(parts) == 1])


def compose(quads: DataFrame, rows: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Quads with what templates make of rows: subjects first, then attributes, in their graphs."""
    made, replaced = [], []
    for t in templates:
        kept = rows.where(F.col(t.exists).isNull() | (F.lower(F.col(t.exists).cast("string")) != "false")) if t.exists else rows
        g, s = _place(t.graph).alias("g"), _place(t.subject).alias("s")
        fact = lambda p, o, kind, dt, g=g, s=s, kept=kept: kept.select(g, s, F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).alias("o_dt"), F.lit("").alias("o_lang")).where("o is not null")
        if t.type:
            made.append(fact(RDF_TYPE, F.lit(t.type), "iri", ""))
        modes: dict[str, set[str]] = {}
        for p, text, mode, dt in t.attributes:
            modes.setdefault(p, set()).add(mode)
            if {"unique", "replace"} <= modes[p]:
                raise ValueError(f"{p} is unique and replaced")
            new = fact(p, _place(text), "iri" if dt == "iri" else "lit", "" if dt == "iri" else (dt if dt.startswith(XSD) else terms.STRING))
            if mode == "unique":
                old = quads.select(F.col("g").alias("_g"), F.col("s").alias("_s"), F.col("p").alias("_p"), F.lit(True).alias("_old")).distinct()
                clash = new.join(old, F.col("g").eqNullSafe(F.col("_g")) & (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")), "left")
                new = clash.where(F.when(F.col("_old").isNotNull(), F.raise_error(F.concat(F.lit("has a value already: "), F.col("s"))).cast("boolean")).otherwise(True)).drop("_g", "_s", "_p", "_old")
            if mode == "replace":
                replaced.append(new.select("g", "s", "p").distinct())
            made.append(new)
    for r in replaced:
        r = r.select(F.col("g").alias("_g"), F.col("s").alias("_s"), F.col("p").alias("_p"))
        quads = quads.join(r, F.col("g").eqNullSafe(F.col("_g")) & (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")), "left_anti")
    return union(quads, *made)


# Paging: the query runs once; its rows are written in a total order with their page, and a page reads its own files


def has_limit(query: str) -> bool:
    """Whether the text after the last brace has a limit of its own: then nothing is paged."""
    return "limit" in query.rsplit("}", 1)[-1].lower()


def pages(df: DataFrame, batch: int = 10_000) -> tuple[DataFrame, int]:
    """(df with page and n, number of pages) in a total order of all columns, stored by page."""
    rows = ranked(df, *comparable(df)).withColumn("page", F.floor(F.col("n") / batch).cast("long"))
    path = f"{shared_dir(df.sparkSession)}/graphloom/pages-{uuid.uuid4().hex}"
    rows.repartition("page").sortWithinPartitions("page", "n").write.partitionBy("page").parquet(path)
    stored = df.sparkSession.read.schema(rows.schema).parquet(path)
    last = rows.agg(F.max("page")).first()[0]
    return stored, 0 if last is None else last + 1


def paginated_select(source, query: str, batch: int = 10_000, prefixes=None, consumer: Callable[[DataFrame], object] | None = None) -> DataFrame:
    """All rows of a query. A consumer gets them page by page, each of `batch` rows but the last."""
    rows = compiler.select(source, query, prefixes)
    if consumer is not None:
        if has_limit(query):
            consumer(rows)
        else:
            stored, n = pages(rows, batch)
            for k in range(n):
                consumer(stored.where(F.col("page") == k).orderBy("n").drop("page", "n"))
    return rows


def paginated_construct(source, query: str, batch: int = 10_000, prefixes=None, consumer: Callable[[DataFrame], object] | None = None, until: str = "short") -> tuple[DataFrame, int]:
    """(the constructed set of quads, pages that were asked for).

    until: "short" ends with the first page of fewer than `batch` quads, "empty" with the first without any; so a full last page
    makes one more request, and "empty" always does. A query with a limit of its own is one page.
    """
    rows = set_of(compiler.construct(source, query, prefixes))
    if until not in ("short", "empty"):
        raise ValueError(f"no rule to stop by, {until}")
    if has_limit(query):
        if consumer is not None:
            consumer(rows)
        return rows, 1
    stored, n = pages(rows, batch)
    if consumer is not None:
        for k in range(n):
            consumer(stored.where(F.col("page") == k).orderBy("n").drop("page", "n"))
    total = stored.count()
    return stored.drop("page", "n"), total // batch + 1 if until == "short" else n + 1


def page(df: DataFrame, keys: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """A page under a total order: keys, then all other columns."""
    return df.orderBy(*keys, *[c for c in df.columns if c not in keys]).offset(offset).limit(limit)


def graphs_of(source, names: Sequence[str] | DataFrame) -> DataFrame:
    """Quads of many graphs by one filter, or one semi-join for a table of names (column g)."""
    rows = as_source(source).scan(None)
    return rows.join(names.select("g"), "g", "left_semi") if isinstance(names, DataFrame) else rows.where(F.col("g").isin(*names))


def checked_count(df: DataFrame, expected: int) -> DataFrame:
    """df, if it has so many rows."""
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return df


def single_column(df: DataFrame) -> DataFrame:
    if len(df.columns) != 1:
        raise ValueError(f"{len(df.columns)} columns, not one")
    return df


def parameters(texts: Mapping[str, str], values: Mapping[str, object]) -> dict[str, str]:
    """Templates with their places filled; for names and folders of the plan, never for query values."""
    return {k: terms.render_template(t, values) for k, t in texts.items()}
