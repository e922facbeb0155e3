import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import STRING
from graphloom.operators import editing, sync
from graphloom.operators.profile import load
from graphloom.operators.ranks import ranked
from graphloom.plans import results
from graphloom.sources import rdf
from graphloom.sources.quads import difference
from graphloom.sources.store import QuadStore

TTL = """@prefix ex: <http://ex/> . ex:h a ex:P ; ex:name "Homer" ; ex:child ex:b , ex:l . ex:b a ex:P ; ex:name "Bart" , "El Barto" . ex:l a ex:P ."""
PROFILE = """{prefixes: {ex: "http://ex/"}, types: {P: {rules: {rdfType: "ex:P"}, attributes: {
  name: {uri: "ex:name", rules: {range: {datatype: "xsd:string"}}}, child: {uri: "ex:child", rules: {range: {classId: "P"}}}, parent: {uri: "ex:child", inverse: true, rules: {range: {classId: "P"}}}}}}}"""


@pytest.fixture(scope="module")
def g(spark):
    return rdf.from_turtle(spark, TTL).cache()


def names(row, key="name"):
    return sorted(x["value"] for x in (row["attributes"].get(key) or []))


def test_detached_resources(spark, g):
    p = load(PROFILE)
    all_ = editing.detach(g, p, "P")
    got = {r["s"]: r for r in all_.collect()}
    assert names(got["http://ex/b"]) == ["Bart", "El Barto"] and names(got["http://ex/h"], "child") == ["http://ex/b", "http://ex/l"] and names(got["http://ex/l"], "parent") == ["http://ex/h"]
    assert got["http://ex/l"]["attributes"]["name"] == []
    some = editing.detach(g, p, "P", keep=lambda n: n == "name").withColumns({"new": F.array(F.lit("X"), F.lit(None)), "one": F.lit("Bart")})
    row = lambda df: {r["s"]: r for r in df.collect()}
    assert set(row(some)["http://ex/h"]["attributes"]) == {"name"}
    assert names(row(editing.set_values(some, p, "P", "name", "new"))["http://ex/b"]) == ["X"]
    assert names(row(editing.add_value(some, p, "P", "name", "one"))["http://ex/b"]) == ["Bart", "Bart", "El Barto"]
    assert names(row(editing.remove_value(some, p, "P", "name", "one"))["http://ex/b"]) == ["El Barto"]
    assert row(editing.clear_values(some, "name"))["http://ex/b"]["attributes"] == {}
    for bad in (lambda: editing.add_value(some.withColumn("k", F.lit(1)), p, "P", "name", "k"), lambda: editing.add_value(some, p, "P", "child", "one"), lambda: editing.set_values(some, p, "P", "no", "new")):
        with pytest.raises(editing.ConversionError):
            bad()


def test_pairs_changes_and_saves(spark, g):
    p = load(PROFILE)
    old = editing.detach(g, p, "P")
    ids = spark.createDataFrame([("http://ex/b", "Bart"), ("http://ex/new", "Neu")], "s string, n string")
    new = editing.empty(ids, "P").join(ids, "s").withColumn("c", terms.iri(F.lit("http://ex/l")))
    new = editing.add_value(editing.add_value(new, p, "P", "name", "n"), p, "P", "parent", "c").drop("n", "c")
    pairs = editing.pair(new, old)
    assert {r["s"]: len(r["old"]) for r in pairs.collect()} == {"http://ex/b": 3, "http://ex/new": 0}
    delta = editing.changes(pairs, p, "P")
    seen = {(r["action"], r["s"].removeprefix("http://ex/"), r["p"].rsplit("/", 1)[-1].rsplit("#")[-1], r["o"].removeprefix("http://ex/")) for r in delta.collect()}
    assert seen == {("remove", "b", "name", "El Barto"), ("remove", "h", "child", "b"), ("add", "l", "child", "b"), ("add", "new", "name", "Neu"), ("add", "l", "child", "new"), ("add", "new", "type", "P")}
    store, told = QuadStore(spark, g), []
    assert editing.save(store, delta, [lambda s, d: told.append(d.count()), lambda s, d: "done"]) == [None, "done"]
    assert told == [6] and store.quads.count() == g.count() + 2
    assert difference(sync.apply_delta(g, delta), store.quads).count() == 0


def test_views_over_many_graphs(spark, g):
    two = g.withColumn("g", F.lit("u:main")).unionByName(g.withColumns({"g": F.lit("u:other"), "o": F.concat("o", F.lit("!"))}))
    assert editing.GraphView(two, "u:main").scan(["http://ex/name"]).count() == 3
    routes = spark.createDataFrame([("http://ex/b", "u:other")], "s string, g string")
    got = {r["o"] for r in editing.GraphView(two, "u:main", routes).scan(["http://ex/name"]).collect()}
    assert got == {"Homer", "Bart!", "El Barto!"}


def test_request_parameters():
    v = editing.Validator
    allowed = {"q": None, "size": v(patterns=[r"\d+", r".{1,2}"]), "type": v(values=["a", "b"]), "fixed": v(value="x")}
    assert editing.request_parameters(allowed, {"q": "1", "size": "5"}, {"size": 10, "type": ["a", "b"]}) == {"q": "1", "size": 10, "type": ["a", "b"], "fixed": ""}
    for bad in ({"no": 1}, {"size": "abc"}, {"size": "123"}, {"type": ["a", "c"]}, {"fixed": "y"}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            editing.request_parameters(allowed, bad)


def test_small_results(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, amount int")
    assert sorted(results.column_values(rows, "k")) == ["a", "b"] and results.map_by(rows, "k")["b"]["amount"] == 2
    assert results.scalar(rows, "amount") is None and results.scalar(rows.where("k = 'b'"), "amount") == 2 and results.amount(rows.limit(0)) == 0 and results.amount(rows.where("k = 'a'")) == 1
    with pytest.raises(results.ResultError, match="twice"):
        results.map_by(rows.unionAll(rows), "k")
    with pytest.raises(results.ResultError):
        results.scalar(rows)
    with pytest.raises(results.ResultError, match="more than"):
        results.column_values(rows, "k", most=1)


def test_ranks_and_pages(spark):
    df = spark.range(25, numPartitions=4).select((F.col("id") * 7 % 25).alias("x"), F.lit("c").alias("y"))
    assert [(r["x"], r["n"]) for r in ranked(df, "x").orderBy("n").collect()] == [(i, i) for i in range(25)]
    g = rdf.from_lines(spark.range(25).select(F.format_string('<u:%03d> <u:p> "%d" .', "id", "id").alias("value")))
    got, query = [], "CONSTRUCT { ?s <u:p> ?o } WHERE { ?s <u:p> ?o }"
    rows, asked = sync.paginated_construct(g, query, 10, consumer=lambda d: got.append([r["s"] for r in d.collect()]))
    assert [len(x) for x in got] == [10, 10, 5] and sum(got, []) == [f"u:{i:03d}" for i in range(25)] and rows.count() == 25 and asked == 3
    assert sync.paginated_construct(g, query, 5)[1] == sync.paginated_construct(g, query, 5, until="empty")[1] == 6 and sync.paginated_construct(g, query, 10, until="empty")[1] == 4
    got = []
    sync.paginated_select(g, "SELECT ?s WHERE { ?s <u:p> ?o }", 10, consumer=lambda d: got.append(d.count()))
    sync.paginated_select(g, "SELECT ?s WHERE { ?s <u:p> ?o } LIMIT 7", 3, consumer=lambda d: got.append(d.count()))
    assert got == [10, 10, 5, 7] and sync.has_limit("SELECT * {} Limit 3") and not sync.has_limit("SELECT ?limit { ?limit ?p ?o }")
    d = sync.delta(g, g.withColumn("o", F.lit("new")))
    texts = sync.delta_text(d, 10).collect()
    assert [r["text"].count(" .") for r in texts] == [10, 10, 5, 10, 10, 5] and [r["text"][:6] for r in texts] == ["DELETE"] * 3 + ["INSERT"] * 3
    assert STRING


def test_typed_json_and_cached_files(spark, tmp_path):
    p = load(PROFILE)
    doc = {"data": {"uri": "http://ex/h", "type": "P", "attributes": {"name": {"xsd:string": ["Homer", "H"]}, "child": {"references": ["http://ex/b"]}}}, "included": [{"uri": "http://ex/b", "type": "P", "attributes": {"name": {}, "parent": {"references": ["http://ex/h"]}}}]}
    again = {"data": {"uri": "http://ex/b", "type": "P", "attributes": {"child": {}}}, "included": []}
    import json

    docs = spark.createDataFrame([(json.dumps(doc),), (json.dumps(again),)], "json string")
    got = {r["s"]: {k: sorted(x["value"] for x in v) for k, v in r["attributes"].items()} for r in editing.from_typed_json(docs, p).collect()}
    assert got == {"http://ex/h": {"name": ["H", "Homer"], "child": ["http://ex/b"]}, "http://ex/b": {"name": [], "parent": ["http://ex/h"], "child": []}}
    bad = spark.createDataFrame([(json.dumps({"data": {"uri": "u:1", "type": "No"}}),)], "json string")
    with pytest.raises(Exception, match="no type No"):
        editing.from_typed_json(bad, p).collect()
    made = []
    path = str(tmp_path / "cached")
    for _ in range(2):
        rows = editing.cached_json(spark, path, lambda: made.append(1) or spark.range(3))
        assert rows.count() == 3
    assert made == [1]
