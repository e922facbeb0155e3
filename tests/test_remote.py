"""Clients against small servers of this process: what they send, how they read answers, and how they bear failures."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.plans import compiler
from graphloom.sources import rdf
from graphloom.sources.remote import Http, RemoteError, SearchServer, SparqlEndpoint, bound, text_of


class Server:
    """answer(method, path, body, headers) -> (status, text); calls are kept."""

    def __init__(self, answer):
        calls = self.calls = []

        class Handler(BaseHTTPRequestHandler):
            def do(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
                calls.append((self.command, self.path, body, dict(self.headers)))
                status, text = answer(self.command, self.path, body, dict(self.headers))
                data = (text if isinstance(text, str) else json.dumps(text)).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = do_DELETE = do

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


HTTP = Http(user="u", password="p", wait=0.01)


def uri(x):
    return {"type": "uri", "value": x}


def test_sparql_endpoint(spark):
    facts = [("u:g", f"u:{i}", "u:p" if i % 2 else "u:q", str(i)) for i in range(7)]

    def answer(method, path, body, headers):
        if path.startswith("/update") or path.startswith("/graphs"):
            return (404, "no graph") if method == "DELETE" else (204, "")
        query = urllib.parse.parse_qs(body)["query"][0]
        if "ASK" in query:
            return 200, {"boolean": True} if "yes" in query else "false"
        if "CONSTRUCT" in query:
            return 200, '<u:1> <u:p> "x"@en .\n<u:1> <u:p> <u:2> .\n'
        if "VALUES (?x" in query:
            names = [x.split(">")[0] for x in query.split("VALUES")[1].split("<")[1:]]
            return 200, {"head": {"vars": ["y", "x"]}, "results": {"bindings": [{"x": uri(n), "y": {"type": "literal", "value": n[-1], "datatype": "u:dt"}} for n in names]}}
        kept = [f for f in facts if "VALUES ?p" not in query or f"<{f[2]}>" in query]
        if "COUNT" in query:
            return 200, {"head": {"vars": ["n"]}, "results": {"bindings": [{"n": {"type": "literal", "value": str(len(kept))}}]}}
        if "LIMIT" in query:
            limit, offset = int(query.split("LIMIT")[1].split()[0]), int(query.split("OFFSET")[1])
            rows = [{"g": uri(g), "s": uri(s), "p": uri(p), "o": {"type": "literal", "value": o}} for g, s, p, o in kept[offset : offset + limit]]
            return 200, {"head": {"vars": ["g", "s", "p", "o"]}, "results": {"bindings": rows}}
        return 200, {"head": {"vars": ["a"]}, "results": {"bindings": [{"a": {"type": "literal", "value": "é", "xml:lang": "fr"}}, {}]}}

    server = Server(answer)
    e = SparqlEndpoint(server.url + "/query", server.url + "/update", server.url + "/graphs", HTTP)
    assert e.ask("ASK { yes }") and not e.ask("ASK { no }")
    assert [r["a"] and (r["a"]["value"], r["a"]["lang"]) for r in e.select(spark, "SELECT ?a {}", ["a"]).collect()] == [("é", "fr"), None]
    ids = spark.range(5).select(terms.iri(F.concat(F.lit("u:"), F.col("id").cast("string"))).alias("x")).coalesce(1)
    got = e.select(spark, "SELECT ?x ?y WHERE { ?x <u:p> ?y }", ["x", "y"], ids, batch=2).collect()
    assert sorted((r["x"]["value"], r["y"]["value"], r["y"]["dt"]) for r in got) == [(f"u:{i}", str(i), "u:dt") for i in range(5)]
    assert sum("VALUES" in urllib.parse.unquote_plus(c[2]) for c in server.calls) == 3 and all(c[3].get("Authorization") == "Basic dTpw" for c in server.calls)
    assert e.construct(spark, "CONSTRUCT {}").count() == 2
    src = e.source(spark, page=2)
    assert src.scan().count() == 7 and {r["o"] for r in src.scan(["u:p"]).collect()} == {"1", "3", "5"}
    assert compiler.select(src, "SELECT ?s WHERE { ?s <u:q> ?o }").count() == 4
    e.update("DROP ALL")
    e.delete_graph("u:none")
    e.replace_graph("u:g/1", rdf.from_turtle(spark, '<u:1> <u:p> "x" .'))
    e.add_data(rdf.from_turtle(spark, '<u:1> <u:p> "y" .'))
    sent = [(c[0], c[1], c[2]) for c in server.calls if not c[1].startswith("/query")]
    assert sent == [("POST", "/update", "DROP ALL"), ("DELETE", "/graphs?graph=u%3Anone", ""), ("PUT", "/graphs?graph=u%3Ag%2F1", '<u:1> <u:p> "x" .\n'), ("POST", "/graphs?default", '<u:1> <u:p> "y" .\n')]
    for bad in (lambda: SparqlEndpoint(server.url).update("x"), lambda: SparqlEndpoint(server.url).delete_graph("u:g"), lambda: text_of({"kind": "bnode", "value": "b"}), lambda: text_of({"kind": "iri", "value": "a> b"})):
        with pytest.raises(RemoteError):
            bad()
    assert bound("Q", ["a", "b"], [[None, {"kind": "lit", "value": 'q"\n', "dt": "", "lang": "en"}]]) == 'Q\nVALUES (?a ?b) { (UNDEF "q\\"\\n"@en) }'


@pytest.mark.parametrize("version", [6, 7])
def test_search_server(spark, version):
    store, refused = {}, {"n": 0}

    def answer(method, path, body, headers):
        kind = "_doc" if version >= 7 else "doc"
        parts = [urllib.parse.unquote(x) for x in path.strip("/").split("/")]
        if method == "DELETE":
            return 404, {"error": "no index"}
        if len(parts) == 1:
            return 200, {}
        if parts[-1] == "_mget":
            return 200, {"docs": [{"_id": i, "found": i in store, "_source": store.get(i)} for i in json.loads(body)["ids"]]}
        if parts[-1] == "_search":
            return 200, {"hits": {"hits": [{"_source": x} for x in store.values()]}}
        if parts[-1] == "_delete_by_query":
            return 200, {"deleted": 2}
        assert parts[1] == kind
        if method == "GET":
            return (200, {"found": True, "_source": store[parts[2]]}) if parts[2] in store else (404, {"found": False})
        if parts[2] == "flaky" and refused["n"] < 2:
            refused["n"] += 1
            return 503, "later"
        if parts[2] == "bad":
            return 400, "can't be parsed"
        store[parts[2]] = json.loads(body)
        return 201, {}

    s = SearchServer(Server(answer).url, version, http=HTTP)
    s.create_index("i", {"mappings": {}})
    s.delete_index("i")
    rows = spark.createDataFrame([("u:a/1", '{"x": 1}'), ("flaky", '{"x": 2}'), ("bad", "{}")], "id string, json string")
    got = {r["id"]: r["error"] for r in s.write(rows, "i").collect()}
    assert got["u:a/1"] is None and got["flaky"] is None and "400" in got["bad"] and refused["n"] == 2
    assert s.get("i", "u:a/1") == {"x": 1} and s.get("i", "none") is None and s.multi_get("i", ["flaky", "none"]) == {"flaky": {"x": 2}}
    assert len(s.search("i", {"query": {"match_all": {}}})) == 2 and s.delete_by_query("i", {"query": {}}) == 2
    with pytest.raises(RemoteError, match="GET|PUT|urlopen|refused"):
        SearchServer("http://127.0.0.1:9", version, http=Http(tries=2, wait=0.01, timeout=1)).get("i", "x")
