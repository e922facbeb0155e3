"""RDF text: N-Triples and N-Quads distributed; Turtle, TriG, N3, RDF/XML and JSON-LD as whole documents, one a task; writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import LANG_STRING, PREFIXES, RDF, STRING
from graphloom.plans.sparql import Node, Parser, Pattern, UnsupportedSparql, Var, unquote
from graphloom.sources.quads import COLUMNS, SCHEMA, set_of
from graphloom.sources.syntaxes import DocumentError, parse_jsonld, parse_rdfxml, to_jsonld, to_rdfxml, to_trig

#: Syntaxes by file extension. Any other is RDF/XML; a path without one, such as a folder that write() made, is N-Quads.
SYNTAXES = {"nt": "nquads", "nq": "nquads", "txt": "nquads", "ttl": "turtle", "n3": "turtle", "trig": "turtle", "jsonld": "jsonld"}

IRI, BLANK = r"<[^<>\s]*>", r"_:[^\s<>\"]+"
LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?'
LINE = rf"^\s*({IRI}|{BLANK})\s+({IRI})\s+({IRI}|{BLANK}|{LITERAL})\s*({IRI}|{BLANK})?\s*\.\s*(?:#.*)?$"


class RdfParseError(ValueError):
    """Text that isn't in its syntax."""


def parse_node(text: str) -> tuple[str, str, str, str]:
    """(kind, value, datatype, language) of a term's N-Triples text."""
    if text.startswith("<"):
        return ("iri", text[1:-1], "", "")
    if text.startswith("_:"):
        return ("bnode", text[2:], "", "")
    m = re.fullmatch(r'("(?:[^"\\]|\\.)*")(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?', text, re.S)
    if not m:
        raise RdfParseError(text)
    return ("lit", unquote(m[1]), LANG_STRING if m[2] else m[3] or STRING, m[2] or "")


def from_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Quads of N-Triples or N-Quads lines, in JVM code. A line that is neither raises, or goes if not strict."""
    c = F.col(column)
    rows = lines.where(~c.rlike(r"^\s*(#.*)?$"))
    good = c.rlike(LINE)
    if strict:
        rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not N-Quads: "), c)).cast("boolean")))
    else:
        rows = rows.where(good)
    # One match a line: only the object may hold blanks, so it comes last. Generators keep later filters, such as those that joins
    # infer, from being evaluated on copies of these expressions.
    parts = F.split(F.regexp_replace(c, LINE[:-1] + r"\R?\z", "$1 $2 $4 $3"), " ", 4)
    t = rows.select(F.explode(F.array(parts)).alias("_t")).select(*[F.col("_t")[i].alias(f"_{x}") for i, x in enumerate("spgo")])
    t = t.select("_p", "_g", terms.parse_term(F.col("_s")).alias("_s"), terms.parse_term(F.col("_o")).alias("_o"))
    strip = lambda x: F.substr(x, F.lit(2), F.length(x) - 2)
    g, p, s, o = F.col("_g"), F.col("_p"), F.col("_s"), F.col("_o")
    quad = F.struct(
        F.when(g != "", strip(g)).alias("g"), s["value"].alias("s"), s["kind"].alias("s_kind"), strip(p).alias("p"),
        o["value"].alias("o"), o["kind"].alias("o_kind"), o["dt"].alias("o_dt"), o["lang"].alias("o_lang"),
    )
    return t.select(F.inline(F.array(quad)))


class TurtleReader(Parser):
    """Turtle and TriG, with the tokens of the query parser; blank nodes get labels b1, b2, ..."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        super().__init__(re.sub(r'(?<!")@(prefix|base)\b', lambda m: m[1].upper(), text), prefixes)
        self.prefixes = dict(prefixes or {})

    def read(self) -> list[tuple]:
        parts: list = []
        while not self.done():
            if self.peek("PREFIX", "BASE"):
                self.prologue()
                self.take(".")
                continue
            if self.take("{"):
                self.block(parts, None)
            elif self.peek("GRAPH") or self.kind in ("iri", "curie") and self.toks[self.at + 1][1] == "{":
                self.take("GRAPH")
                g = self.iri()
                self.need("{")
                self.block(parts, g)
            else:
                self.triples(parts, None)
                self.need(".")
        return [self.row(t) for t in parts]

    def block(self, parts, g) -> None:
        while not self.take("}"):
            self.triples(parts, g)
            self.take(".")

    def triples(self, parts, graph) -> None:
        s = self.collection(parts, graph) if self.peek("(") else None
        if s is None:
            return super().triples(parts, graph)
        self.predicates(s, parts, graph)

    def predicates(self, s, parts, graph) -> None:
        while True:
            path = self.path()
            while True:
                o = self.collection(parts, graph) if self.peek("(") else self.property_list(parts, graph) if self.peek("[") else self.node()
                parts.append(Pattern(s, path[0][1], o, graph))
                if not self.take(","):
                    break
            while self.take(";"):
                if self.peek(".", "}", "]", ";"):
                    continue
                break
            else:
                return
            if self.peek(".", "}", "]"):
                return

    def collection(self, parts, graph):
        self.need("(")
        items = []
        while not self.take(")"):
            items.append(self.collection(parts, graph) if self.peek("(") else self.property_list(parts, graph) if self.peek("[") else self.node())
        nodes = [self.blank() for _ in items]
        for i, (n, x) in enumerate(zip(nodes, items)):
            parts.append(Pattern(n, Node("iri", RDF + "first"), x, graph))
            parts.append(Pattern(n, Node("iri", RDF + "rest"), nodes[i + 1] if i + 1 < len(nodes) else Node("iri", RDF + "nil"), graph))
        return nodes[0] if nodes else Node("iri", RDF + "nil")

    @staticmethod
    def row(t: Pattern) -> tuple:
        def flat(x):
            if isinstance(x, Var):
                if not x.name.startswith("_"):
                    raise RdfParseError(f"a variable, {x.name}")
                return ("bnode", "b" + x.name.removeprefix("_blank") if x.name.startswith("_blank") else x.name.removeprefix("_label_"), "", "")
            return (x.kind, x.value, x.dt, x.lang)

        s, p, o = flat(t.s), flat(t.p), flat(t.o)
        if s[0] == "lit" or p[0] != "iri":
            raise RdfParseError("a literal as subject, or a predicate that is no IRI")
        return (t.g.value if t.g is not None else None, s[1], s[0], p[1], o[1], o[0], o[2], o[3])


def parse_turtle(text: str, prefixes: dict[str, str] | None = None) -> list[tuple]:
    """Rows of quads of a Turtle or TriG text."""
    try:
        return TurtleReader(text, prefixes).read()
    except UnsupportedSparql as e:
        raise RdfParseError(str(e)) from e


def from_turtle(spark: SparkSession, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    return set_of(spark.createDataFrame(parse_turtle(text, prefixes), SCHEMA))


def syntax_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return SYNTAXES.get(name.rsplit(".", 1)[-1].lower(), "rdfxml") if "." in name else "nquads"


def parse(text: str, syntax: str) -> list[tuple]:
    """Rows of quads of one document; RdfParseError where it isn't in the syntax."""
    try:
        return {"turtle": parse_turtle, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld}[syntax](text)
    except DocumentError as e:
        raise RdfParseError(str(e)) from e


def read(spark: SparkSession, path: str, syntax: str | None = None, strict: bool = True) -> DataFrame:
    """Quads of a file or glob. N-Quads read in parallel; documents of other syntaxes whole, each in one task. Blank nodes of
    different documents stay apart: their labels get the document's number before them."""
    syntax = syntax or syntax_of(path)
    if syntax == "nquads":
        return from_lines(spark.read.text(path), strict=strict)

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = hashlib.md5(text.encode()).hexdigest()[:12] + "-"
                rows = [(g, own + s if k == "bnode" else s, k, p, own + o if ok == "bnode" else o, ok, dt, lang) for g, s, k, p, o, ok, dt, lang in parse(text, syntax)]
                columns = list(zip(*rows)) or [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=list(COLUMNS))

    return set_of(spark.read.text(path, wholetext=True).mapInArrow(run, SCHEMA))


def document(quads: DataFrame, syntax: str, prefixes: dict[str, str] | None = None) -> str:
    """One document of a graph of configuration size, written by the driver: turtle (TriG where graphs are named), rdfxml, jsonld
    or nquads."""
    if syntax == "nquads":
        return "".join(r["value"] + "\n" for r in to_lines(set_of(quads)).orderBy("value").collect())
    return _text([tuple(r) for r in set_of(quads).select(*COLUMNS).collect()], syntax, prefixes)


def _text(rows: list[tuple], syntax: str, prefixes: dict[str, str] | None) -> str:
    return to_jsonld(rows) if syntax == "jsonld" else {"turtle": to_trig, "rdfxml": to_rdfxml}[syntax](rows, prefixes)


def to_lines(quads: DataFrame) -> DataFrame:
    """One N-Quads line a quad, in a column value."""
    s, o = terms.term(F.col("s_kind"), F.col("s")), terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise(F.lit(""))
    return quads.select(F.concat(terms.ntriples(s), F.lit(" <"), F.col("p"), F.lit("> "), terms.ntriples(o), g, F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, mode: str = "error", syntax: str = "nquads", documents: int = 1, prefixes: dict[str, str] | None = None) -> None:
    """N-Quads lines, or so many documents of another syntax: each holds whole subjects, and is one task's memory. Subjects that
    share a blank node must be in one document, so graphs with blank nodes are one."""
    if syntax == "nquads":
        to_lines(quads).write.mode(mode).text(path)
        return

    def run(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([_text(rows, syntax, prefixes)])], names=["value"])

    rows = set_of(quads).select(*COLUMNS)
    if documents > 1:
        if rows.where((F.col("s_kind") == "bnode") | (F.col("o_kind") == "bnode")).limit(1).count():
            raise ValueError("a graph with blank nodes is one document")
        rows = rows.repartition(documents, "s")
    else:
        rows = rows.repartition(1)
    rows.mapInArrow(run, "value string").write.mode(mode).text(path)


__all__ = ["PREFIXES", "RdfParseError", "document", "from_lines", "from_turtle", "parse", "parse_node", "parse_turtle", "read", "to_lines", "write"]
