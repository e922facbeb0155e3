"""Clients of SPARQL endpoints and of search servers over HTTP, with the standard library alone.

Bindings tables and documents are sent by executors, a batch a request; failures of documents come back as rows. Every
request is repeated `tries` times, with a growing wait, on errors of the server or the network; other answers raise at once.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import LANG_STRING, STRING
from graphloom.sources.quads import SCHEMA, set_of

TERM = "struct<kind:string,value:string,dt:string,lang:string>"


class RemoteError(RuntimeError):
    """A server's refusal, or no answer after all tries."""


@dataclass(frozen=True)
class Http:
    user: str | None = None
    password: str | None = None
    tries: int = 3
    wait: float = 0.5
    timeout: float = 60.0
    headers: Mapping[str, str] = field(default_factory=dict)

    def send(self, method: str, url: str, body: bytes | None = None, headers: Mapping[str, str] | None = None, fine: Sequence[int] = ()) -> tuple[int, bytes]:
        """(status, body) of the answer; statuses in fine are answers, too."""
        said = dict(self.headers) | dict(headers or {})
        if self.user is not None:
            said["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password or ''}".encode()).decode()
        for attempt in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, said, method=method), timeout=self.timeout) as r:
                    return r.status, r.read()
            except urllib.error.HTTPError as e:
                text = e.read()
                if e.code in fine:
                    return e.code, text
                if e.code < 500 or attempt == self.tries:
                    raise RemoteError(f"{method} {url}: {e.code} {text[:500].decode(errors='replace')}") from e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if attempt == self.tries:
                    raise RemoteError(f"{method} {url}: {e}") from e
            time.sleep(self.wait * attempt)
        raise AssertionError


# SPARQL


def term_of(x: Mapping[str, str] | None) -> dict[str, str] | None:
    """A term of the JSON result format as a struct."""
    if x is None:
        return None
    if x["type"] in ("uri", "bnode"):
        return {"kind": "iri" if x["type"] == "uri" else "bnode", "value": x["value"], "dt": "", "lang": ""}
    lang = x.get("xml:lang", "")
    return {"kind": "lit", "value": x["value"], "dt": LANG_STRING if lang else x.get("datatype", STRING), "lang": lang}


def text_of(t: Mapping[str, str] | None) -> str:
    """A term as it stands in a VALUES block; a blank node has no such text."""
    if t is None:
        return "UNDEF"
    if t["kind"] == "bnode":
        raise RemoteError("a blank node can't be bound")
    if t["kind"] == "iri":
        if any(c in '<>"{}|^`\\' or c <= " " for c in t["value"]):
            raise RemoteError(f"not an IRI: {t['value']}")
        return f"<{t['value']}>"
    text = '"' + t["value"].translate({92: "\\\\", 34: '\\"', 10: "\\n", 13: "\\r"}) + '"'
    return f"{text}@{t['lang']}" if t["lang"] else text if t["dt"] in ("", STRING) else f"{text}^^<{t['dt']}>"


def bound(query: str, names: Sequence[str], rows: Sequence[Sequence]) -> str:
    """A query with a VALUES block at the end."""
    lines = " ".join("(" + " ".join(text_of(x) for x in row) + ")" for row in rows)
    return f"{query}\nVALUES ({' '.join('?' + n for n in names)}) {{ {lines} }}"


@dataclass(frozen=True)
class SparqlEndpoint:
    """A SPARQL 1.1 endpoint: url for queries; update and graphs (graph store protocol) where it can be written to."""

    url: str
    update_url: str | None = None
    graphs_url: str | None = None
    http: Http = Http()

    def _query(self, text: str, accept: str) -> bytes:
        body = urllib.parse.urlencode({"query": text}).encode()
        return self.http.send("POST", self.url, body, {"Content-Type": "application/x-www-form-urlencoded", "Accept": accept})[1]

    def ask(self, text: str) -> bool:
        answer = self._query(text, "application/sparql-results+json").decode()
        try:
            return bool(json.loads(answer)["boolean"])
        except (ValueError, KeyError, TypeError):  # some servers answer with the word alone
            if answer.strip().lower() in ("true", "false"):
                return answer.strip().lower() == "true"
            raise RemoteError(f"no answer to ASK: {answer[:200]}") from None

    def rows(self, text: str) -> tuple[list[str], list[list]]:
        """Variables and rows of terms of one request, on the caller's side."""
        data = json.loads(self._query(text, "application/sparql-results+json"))
        names = data["head"]["vars"]
        return names, [[term_of(b.get(n)) for n in names] for b in data["results"]["bindings"]]

    def select(self, spark: SparkSession, text: str, names: Sequence[str], bindings: DataFrame | None = None, batch: int = 500) -> DataFrame:
        """Solutions of a query, its variables as columns of terms. Rows of bindings go out in batches, one request each, by executors."""
        schema = ", ".join(f"`{n}` {TERM}" for n in names)
        if bindings is None:
            found, rows = self.rows(text)
            return spark.createDataFrame([tuple(r[found.index(n)] if n in found else None for n in names) for r in rows], schema)
        endpoint, keys = self, bindings.columns

        def run(batches):
            import pyarrow as pa

            kind = pa.struct([(f, pa.string()) for f in ("kind", "value", "dt", "lang")])
            for b in batches:
                for a in range(0, b.num_rows, batch):
                    given = list(zip(*(c.to_pylist() for c in b.slice(a, batch).columns)))
                    found, rows = endpoint.rows(bound(text, keys, given))
                    columns = [[r[found.index(n)] if n in found else None for r in rows] for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], names=list(names))

        return bindings.mapInArrow(run, schema)

    def construct(self, spark: SparkSession, text: str) -> DataFrame:
        """Quads of a CONSTRUCT, read as N-Triples."""
        from graphloom.sources.rdf import from_lines

        lines = self._query(text, "application/n-triples").decode().splitlines()
        return set_of(from_lines(spark.createDataFrame([(x,) for x in lines], "value string")))

    def source(self, spark: SparkSession, page: int = 10_000, graphs: bool = True) -> EndpointSource:
        return EndpointSource(self, spark, page, graphs)

    def update(self, text: str) -> None:
        if self.update_url is None:
            raise RemoteError("this endpoint is read-only")
        self.http.send("POST", self.update_url, text.encode(), {"Content-Type": "application/sparql-update"})

    def _graph(self, method: str, graph: str | None, quads: DataFrame | None = None, fine: Sequence[int] = ()) -> None:
        if self.graphs_url is None:
            raise RemoteError("this endpoint has no graph store")
        body, headers = None, {}
        if quads is not None:
            from graphloom.sources.rdf import document

            body, headers = document(quads.withColumn("g", F.lit(None).cast("string")), "nquads").encode(), {"Content-Type": "application/n-triples"}
        where = "default" if graph is None else urllib.parse.urlencode({"graph": graph})
        self.http.send(method, f"{self.graphs_url}?{where}", body, headers, fine)

    def add_data(self, quads: DataFrame, graph: str | None = None) -> None:
        """Append a graph of configuration size."""
        self._graph("POST", graph, quads)

    def replace_graph(self, graph: str | None, quads: DataFrame) -> None:
        self._graph("PUT", graph, quads)

    def delete_graph(self, graph: str | None) -> None:
        """Without an error if there is no such graph."""
        self._graph("DELETE", graph, fine=(404,))

    def apply_texts(self, texts: DataFrame) -> None:
        """Update texts (seq, text) in order, one request each; sync.delta_text() makes such."""
        for r in texts.toLocalIterator():
            self.update(r["text"])


class EndpointSource:
    """An endpoint's quads as a source of the query compiler: only the predicates that a query names are fetched, in ordered pages."""

    def __init__(self, endpoint: SparqlEndpoint, spark: SparkSession, page: int, graphs: bool):
        self.endpoint, self.spark, self.page, self.graphs = endpoint, spark, page, graphs

    def scan(self, predicates: Sequence[str] | None = None) -> DataFrame:
        triple = "?s ?p ?o"
        pattern = f"{{ {triple} }} UNION {{ GRAPH ?g {{ {triple} }} }}" if self.graphs else triple
        only = "" if predicates is None else " VALUES ?p { " + " ".join(text_of({"kind": "iri", "value": p}) for p in predicates) + " }"
        count = f"SELECT (COUNT(*) AS ?n) WHERE {{ {pattern}{only} }}"
        total = int(self.endpoint.rows(count)[1][0][0]["value"])
        endpoint, page = self.endpoint, self.page
        query = f"SELECT ?g ?s ?p ?o WHERE {{ {pattern}{only} }} ORDER BY ?g ?s ?p ?o"

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for k in b.column(0).to_pylist():
                    names, rows = endpoint.rows(f"{query} LIMIT {page} OFFSET {k * page}")
                    g, s, p, o = ([r[names.index(n)] if n in names else None for r in rows] for n in "gspo")
                    get = lambda xs, f: pa.array([None if x is None else x[f] for x in xs], pa.string())
                    yield pa.RecordBatch.from_arrays([get(g, "value"), get(s, "value"), get(s, "kind"), get(p, "value"), get(o, "value"), get(o, "kind"), get(o, "dt"), get(o, "lang")], names=SCHEMA.names)

        pages = -(-total // page)
        return set_of(self.spark.range(0, pages, 1, max(1, pages)).mapInArrow(run, SCHEMA))


# Search servers


@dataclass(frozen=True)
class SearchServer:
    """An index server's HTTP interface; version 6 has a mapping type in its paths, 7 has none."""

    url: str
    version: int = 7
    type: str = "doc"
    http: Http = Http()

    def _send(self, method: str, path: str, body: object = None, fine: Sequence[int] = ()) -> tuple[int, object]:
        data = None if body is None else json.dumps(body).encode() if not isinstance(body, str) else body.encode()
        status, text = self.http.send(method, f"{self.url.rstrip('/')}/{path}", data, {"Content-Type": "application/json"}, fine)
        return status, json.loads(text) if text.strip() else None

    def _doc(self, index: str, id_: str) -> str:
        return f"{index}/{'_doc' if self.version >= 7 else self.type}/{urllib.parse.quote(id_, safe='')}"

    def create_index(self, index: str, settings: object = None) -> None:
        self._send("PUT", index, settings)

    def delete_index(self, index: str) -> None:
        """Without an error if there is no such index."""
        self._send("DELETE", index, fine=(404,))

    def put(self, index: str, id_: str, document: object) -> None:
        self._send("PUT", self._doc(index, id_), document)

    def get(self, index: str, id_: str) -> object | None:
        status, data = self._send("GET", self._doc(index, id_), fine=(404,))
        return data["_source"] if status == 200 and data.get("found", True) else None

    def multi_get(self, index: str, ids: Sequence[str]) -> dict[str, object]:
        """Found documents by id."""
        path = f"{index}/_mget" if self.version >= 7 else f"{index}/{self.type}/_mget"
        data = self._send("POST", path, {"ids": list(ids)})[1]
        return {d["_id"]: d["_source"] for d in data["docs"] if d.get("found")}

    def search(self, index: str, query: object) -> list[object]:
        return [h["_source"] for h in self._send("POST", f"{index}/_search", query)[1]["hits"]["hits"]]

    def delete_by_query(self, index: str, query: object) -> int:
        return self._send("POST", f"{index}/_delete_by_query", query)[1].get("deleted", 0)

    def write(self, rows: DataFrame, index: str) -> DataFrame:
        """(id, error) of rows (id, json): executors put each document; null errors are those that the server took."""
        server = self

        def run(batches):
            import pyarrow as pa

            for b in batches:
                out = []
                for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        server.put(index, id_, text)
                        out.append(None)
                    except RemoteError as e:
                        out.append(str(e))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "error"])

        return rows.select(F.col("id").cast("string").alias("id"), "json").mapInArrow(run, "id string, error string")
