import hashlib
import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.jsondiff import diff
from graphloom.functions.terms import DCT, RDF_TYPE, RDFS, STRING, XSD
from graphloom.operators import access, canon, documents, index, ontology, operations, rules, shapes, sync, validate
from graphloom.operators.profile import ProfileError, collapse, doc_profile, dump, load, merge_doc_profiles
from graphloom.plans.sparql import Node
from graphloom.sources import rdf
from graphloom.sources.quads import difference, quads_of

PREFIX = {"ex": "http://ex/"}
TTL = """@prefix ex: <http://ex/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:h a ex:Person ; ex:name "Homer" ; ex:spouse ex:m ; ex:child ex:b , ex:l ; ex:born "1956-05-12"^^xsd:date ; ex:label "H"@en , "Ho"@fr .
ex:m a ex:Person ; ex:name "Marge" ; ex:spouse ex:h . ex:b a ex:Person , ex:Child ; ex:name "Bart" ; ex:talks true . ex:l a ex:Person , ex:Child ; ex:name "Lisa" , "Elizabeth" ."""
PROFILE = """{uri: "urn:family", prefixes: {ex: "http://ex/"}, types: {
  Person: {rules: {rdfType: "ex:Person"}, attributes: {
    name: {uri: "ex:name", rules: {range: {datatype: "xsd:string"}, minCardinality: 1, maxCardinality: 1}}, spouse: {uri: "ex:spouse", rules: {range: {classId: "Person"}, maxCardinality: 1}},
    child: {uri: "ex:child", rules: {range: {classId: "Child"}}}, parent: {uri: "ex:child", inverse: true, rules: {range: {classId: "Person"}}},
    born: {uri: "ex:born", rules: {range: {datatype: "xsd:date"}, maxCardinality: 1}}, label: {uri: "ex:label", rules: {range: {datatype: "rdf:langString"}, maxCardinality: 1, maxLangCardinality: 1}}, }},
  Child: {rules: {rdfType: "ex:Child", subClassOf: "Person"}, attributes: {talks: {uri: "ex:talks", rules: {range: {datatype: "xsd:boolean"}}}}}, }}"""


@pytest.fixture(scope="module")
def g(spark):
    return rdf.from_turtle(spark, TTL).cache()


@pytest.fixture(scope="module")
def p():
    return load(PROFILE)


def ids(df, column="s"):
    return sorted(r[column].rsplit("/", 1)[-1] for r in df.select(column).collect())


def test_profile(p):
    assert p.rdf_types("Child") == ["http://ex/Child", "http://ex/Person"]
    assert p.leaf_type(["http://ex/Child", "http://ex/Person"]) == "Child" and p.leaf_type([]) is None
    again = load(dump(p))
    assert again.types == p.types
    flat = collapse(load('{uri: "a", imports: ["b"], types: {T: {attributes: {x: {uri: "u:x", rules: {minCardinality: 1, range: {datatype: "xsd:int"}}}}}}}', lambda n: '{uri: "b", types: {T: {attributes: {x: {uri: "u:x", rules: {minCardinality: 2, maxCardinality: 3, range: {datatype: "xsd:long"}}}}}}}'))
    x = flat.types["T"].attributes["x"]
    assert (x.min, x.max, x.range[0].name) == (2, 3, "and")
    with pytest.raises(ProfileError):
        load('{types: {T: {rules: {nonsense: 1}}}}')
    tie = load('{types: {A: {rules: {rdfType: "u:a"}}, B: {rules: {rdfType: "u:b"}}}}')
    with pytest.raises(ProfileError, match="several types"):
        tie.leaf_type(["u:a", "u:b"])
    d = doc_profile(p)
    assert merge_doc_profiles(d, d).types.keys() == d.types.keys() and d.levels() == {"Child": 0, "Person": 1}


def test_access(g, p):
    assert ids(access.find_all(g, p, "Person")) == ["b", "h", "l", "m"] and ids(access.find_all(g, p, "Child")) == ["b", "l"]
    assert ids(access.find_matching(g, p, "Person", {"name": Node("lit", "Bart", STRING)})) == ["b"]
    rows = access.values(g, p, "Person", ["child", "parent", "spouse"])
    assert sorted((r["s"][-1], r["attribute"], r["value"]["value"][-1]) for r in rows.collect()) == [("b", "parent", "h"), ("h", "child", "b"), ("h", "child", "l"), ("h", "spouse", "m"), ("l", "parent", "h"), ("m", "spouse", "h")]
    typed = access.typed_values(rows, g, p)
    assert {(r["value"]["value"][-1], r["type"]) for r in typed.collect()} == {("h", "Person"), ("b", "Child"), ("l", "Child"), ("m", "Person")}
    assert ids(access.filter_values(rows, "child", "http://ex/b")) == ["b", "h", "h", "l", "m"]
    assert access.only_literals(rows).count() == 0 and access.ignore_attributes(rows, ["child"]).count() == 4
    with pytest.raises(Exception, match="illegal attribute"):
        access.illegal_attributes(rows, ["spouse"]).collect()
    assert access.snippet_variables("$in ex:p ?x . ?x <u:?no> ?out FILTER(?x != '$no' && ?out = $to) # ?none") == (["in", "to"], ["x", "out"])
    named = access.snippet_values(g, p, "$in ex:child ?out . ?out ex:name $name", access.find_all(g, p, "Person"), PREFIX, {"name": Node("lit", "Lisa", STRING)}).collect()
    assert [(r["in"], r["out"], sorted(r["types"]), r["type"]) for r in named] == [("http://ex/h", "http://ex/l", ["http://ex/Child", "http://ex/Person"], "Child")]
    for bad in ("$in ex:child ?x", "$in ex:child ?out . ?out ex:name $name"):
        with pytest.raises(ProfileError):
            access.snippet_values(g, p, bad, access.find_all(g, p, "Person"), PREFIX)
    out = access.snippet_values(g, p, "$in ex:child ?out", access.find_all(g, p, "Person"), PREFIX)
    assert {(r["in"][-1], r["out"][-1], len(r["types"])) for r in out.collect()} == {("h", "b", 2), ("h", "l", 2)}
    paths = access.load_paths(g, p, "Person", access.find_matching(g, p, "Person", {"name": Node("lit", "Marge", STRING)}), ["name"], ["spouse.child.talks"])
    assert paths.where("p like '%talks'").count() == 1


def test_validation(g, p):
    bad = {(r["s"][-1], r["attribute"], r["rule"], r["n"]) for r in validate.check_cardinalities(g, p, "Person").collect()}
    assert bad == {("l", "name", "maxCardinality", 2), ("h", "label", "maxCardinality", 2)}
    checks = validate.check_values(g, p, "Person")
    assert checks.where("not conforms").count() == 0 and checks.where("attribute = 'child'").count() == 2
    assert validate.report(validate.check_cardinalities(g, p, "Person")).where(F.col("p") == RDF_TYPE).count() == 2


def test_shapes(g, spark, p):
    rows = {(r["type"][-5:], r["property"].rsplit("/", 1)[-1]): r for r in shapes.infer(g).collect()}
    name = rows["erson", "name"]
    assert (name["min_count"], name["max_count"], name["node_kind"], name["datatypes"]) == (1, None, "Literal", [STRING])
    assert rows["erson", "label"]["unique_lang"] and rows["erson", "label"]["languages"] == ["en", "fr"]
    assert rows["erson", "spouse"]["class"] == "http://ex/Person" and rows["Child", "name"]["instances"] == 2
    d = shapes.shacl_to_doc_profile(shapes.to_shacl(shapes.infer(g)))
    assert d.types["Person"].attributes["spouse"].kind == "object" and d.types["Person"].attributes["spouse"].single
    back = shapes.shacl_to_doc_profile(shapes.profile_to_shacl(spark, p))
    assert back.types["Person"].attributes["name"].single


def test_documents(g, p, spark):
    d = doc_profile(load(PROFILE.replace("maxCardinality: 1}}, spouse", "}}, spouse")))
    roots = access.find_matching(g, p, "Person", {"name": Node("lit", "Homer", STRING)})
    rows = documents.to_rows(g, d, roots)
    doc = json.loads(documents.to_json(rows, {"ex": "http://ex/", "xsd": XSD, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}).first()["json"])
    a = doc["data"]["attributes"]
    assert a["spouse"] == {"references": "http://ex/m"} and a["child"] == {"references": ["http://ex/b", "http://ex/l"]} and a["born"] == {"xsd:date": "1956-05-12"}
    assert a["label"] == {"rdf:langString": {"en": "H", "fr": "Ho"}} and [x["uri"][-1] for x in doc["included"]] == ["b", "l", "m"]
    assert doc["included"][0]["attributes"]["talks"] == {"xsd:boolean": [True]}
    back = documents.from_json(documents.to_json(rows), d)
    assert difference(back, g).count() == 0 and difference(documents.clean(g, d), back).count() == 0
    with pytest.raises(Exception, match="several values of the single attribute name"):
        documents.to_rows(g, doc_profile(p), roots).collect()
    bad = spark.createDataFrame([('{"data": {"uri": "u:x", "type": "Person", "attributes": {"nope": {"xsd:string": "x"}}}}',)], "json string")
    with pytest.raises(Exception, match="no attribute nope"):
        documents.from_json(bad, d).collect()


def test_facets(g):
    assert documents.facet_type("count_IntegerList") == ("integer", True) and documents.facet_type("x") == ("string", False) and documents.facet_type("isBoolean") == ("boolean", False)
    q = 'SELECT ?root ?k ?nameList WHERE { ?root ex:name ?nameList BIND("names" AS ?k) }'
    got = documents.facet_json(documents.facets(g, [q], PREFIX)).where("root like '%/l'").first()["facets"]
    assert json.loads(got) == {"names": ["Elizabeth", "Lisa"]}
    with pytest.raises(Exception, match="several values"):
        documents.facets(g, [q.replace("nameList", "name")], PREFIX).collect()


def test_diff():
    a, b = {"x": [1, 2.0], "o": [{"id": 1, "v": "a"}, {"id": 2}], "s": ["a", "b"], "n": None, "t": 1}, {"x": [1, 2.00000001], "o": [{"id": 1, "v": "b"}, {"id": 3}], "s": ["b", "c"], "n": None, "t": "1", "new": True}
    kinds = {(p, k) for p, k, _, _ in diff(a, b)}
    assert kinds == {(".o[1].v", "different_string_values"), (".o[2]", "element_only_in_from"), (".o[3]", "element_only_in_to"), (".s", "element_only_in_from"), (".s", "element_only_in_to"), (".t", "different_node_types"), (".new", "field_only_in_to")}
    assert diff(a, a) == [] and diff(["a", "b"], ["b", "a"]) == [] and diff({"k": ["a", "b"]}, {"k": ["b", "a"]}, ordered=["k"])


def test_canonical_forms(spark):
    one = rdf.from_turtle(spark, "@prefix e: <http://e/> . e:s e:p [ e:q [ e:r 1 ] ; e:q [ e:r 2 ] ] . [] e:root e:s .")
    two = rdf.from_lines(spark.createDataFrame([(x,) for x in ['_:z <http://e/root> <http://e/s> .', '_:k <http://e/q> _:m .', '_:k <http://e/q> _:n .', '<http://e/s> <http://e/p> _:k .', '_:n <http://e/r> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .', '_:m <http://e/r> "2"^^<http://www.w3.org/2001/XMLSchema#integer> .']], "value string"))
    assert canon.isomorphic(one, two)
    assert not canon.isomorphic(one, two.where("o <> '2'"))
    assert [r["text"] for r in canon.sorted_turtle(one).collect()] == [r["text"] for r in canon.sorted_turtle(two).collect()]
    back = canon.deskolemize(canon.skolemize(one))
    assert difference(back, one).count() == 0
    assert canon.xor_hash(one.limit(0)).first()["hash"] == "0" * 64
    ring = rdf.from_turtle(spark, "@prefix e: <http://e/> . _:a e:p _:b . _:b e:p _:a .")
    with pytest.raises(canon.DigestError):
        canon.blank_digests(ring)


def test_rules(spark, g):
    added, removed = rules.rule_changes(g, {"1": 'INSERT { ?x ex:kin ?y } WHERE { ?x ex:spouse ?y }', "2": "DELETE { ?x ex:spouse ?y } WHERE { ?x ex:kin ?y }"}, prefixes=PREFIX)
    assert added.count() == removed.count() == 2
    debug = rules.debug_rule(g, "SELECT * WHERE { ?x ex:child ?y . ?y ex:name ?n . ?y ex:none ?z }", PREFIX)
    assert [n for _, n in debug] == [2, 3, 0]


def plain_expansion(t):
    """All entailments of a set of triples, blank nodes as "_:x"; then what cleanup leaves. Written by hand, rule by rule."""
    a, sub, sup = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf"
    kinds = ("owl:AnnotationProperty", "owl:DatatypeProperty", "owl:ObjectProperty")
    blank = lambda *xs: any(x.startswith("_:") for x in xs)
    t = set(t)
    while True:
        new = {(p, a, "rdf:Property") for _, p, _ in t}
        for s, p, o in t:
            if p == "rdfs:domain" and not blank(o):
                new.add((o, a, "owl:Class"))
            if p == a and o in ("owl:Class", "rdfs:Class") and not blank(s):
                new |= {(s, a, "owl:Class")} if o == "rdfs:Class" else {(s, a, "rdfs:Class"), (s, sub, "owl:Thing")}
            if p == a and o == "owl:Class":
                new |= {("owl:Thing", a, "owl:Class"), ("rdf:Property", a, "owl:Class")}
            if p == sub and not blank(s, o):
                new |= {(x, a, c) for x in (s, o) for c in ("owl:Class", "rdfs:Class")}
            if p == sup and not blank(s, o):
                new |= {(s, a, "rdf:Property"), (o, a, "rdf:Property")}
                new |= {(s, a, k) for k in kinds if (o, a, k) in t}
            if p == sup and not blank(s, o):
                new |= {(s, q, z) for x, q, z in t if x == o and q in ("rdfs:domain", "rdfs:range")}
            if p in ("owl:equivalentClass", "owl:equivalentProperty") and not blank(s, o):
                new.add((o, p, s))
            if p == "owl:inverseOf":
                new.add((o, p, s))
            if p == a and o in kinds and not blank(s):
                new.add((s, "rdfs:domain", "owl:Thing"))
                if o != kinds[0]:
                    new.add((s, "rdfs:range", "rdfs:Literal" if o == kinds[1] else "owl:Thing"))
            for x, q, z in t:
                if x == o and q == p and not blank(s, o, z):
                    if p == sub or s != z and p in (sup, "owl:equivalentClass", "owl:equivalentProperty"):
                        new.add((s, p, z))
                    if p == "owl:inverseOf" and s != z:
                        new.add((s, "owl:equivalentProperty", z))
        if new <= t:
            break
        t |= new
    full = set(t)
    t = {x for x in t if x[1] not in ("rdfs:comment", "rdfs:label", "skos:altLabel", "skos:editorialNote", "http://data.legilux.public.lu/resource/ontology/jolux#alignmentComment")}
    of = lambda s, p: {o for x, q, o in t if (x, q) == (s, p)}
    for s in {x for x, _, _ in t if not blank(x)}:
        for k, top in ((kinds[1], "rdfs:Literal"), (kinds[2], "owl:Thing")):
            for side, value in (("rdfs:domain", "owl:Thing"), ("rdfs:range", top)):
                if k in of(s, a) and len(of(s, side)) > 1:
                    t.discard((s, side, value))
        if of(s, a) & set(kinds):
            t.discard((s, a, "rdf:Property"))
        t.discard((s, a, "rdfs:Class"))
        if of(s, a) & set(kinds):
            for side in ("rdfs:domain", "rdfs:range"):
                named = {x for x in of(s, side) if not blank(x)}
                t -= {(s, side, y) for x in named for y in named if x != y and (x, sub, y) in t}
    return full, {x for x in t if x[1] not in ("owl:inverseOf", sup)}


def test_ontology_rules_against_a_plain_version(spark):
    from graphloom.functions.terms import OWL, RDF, SKOS

    spaces = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "u": "http://u/"}
    text = """u:A rdfs:subClassOf u:B . u:B rdfs:subClassOf u:C . u:C owl:equivalentClass u:D . u:D owl:equivalentClass u:E . _:k rdfs:subClassOf u:A .
u:X a rdfs:Class ; rdfs:label "X" ; rdfs:comment "c" ; skos:altLabel "x" ; skos:prefLabel "x" . u:Y a owl:Class . _:c a owl:Class .
u:p a owl:ObjectProperty ; rdfs:domain u:A , u:C , _:d ; rdfs:range u:B , u:C . u:q rdfs:subPropertyOf u:p . u:r rdfs:subPropertyOf u:q . u:q2 rdfs:subPropertyOf u:q , u:r .
u:d a owl:DatatypeProperty ; rdfs:range u:string . u:e rdfs:subPropertyOf u:d . u:f a owl:DatatypeProperty . u:n a owl:AnnotationProperty ; rdfs:domain u:B , u:C . u:m rdfs:subPropertyOf u:n .
_:b a owl:ObjectProperty . u:i owl:inverseOf u:j . u:j owl:inverseOf u:l . u:s owl:equivalentProperty u:t . u:t owl:equivalentProperty u:v ."""
    onto = rdf.from_turtle(spark, "".join(f"@prefix {k}: <{v}> ." for k, v in spaces.items()) + text)

    def short(x):
        return next((f"{k}:{x[len(v):]}" for k, v in spaces.items() if x.startswith(v)), x)

    def triples(df):
        rows = df.collect()
        names = {x: x if x.startswith("_:") else f"_:{x}" for r in rows for x, kind in ((r["s"], r["s_kind"]), (r["o"], r["o_kind"])) if kind == "bnode"}
        return {(names.get(r["s"]) or short(r["s"]), short(r["p"]), (names.get(r["o"]) if r["o_kind"] == "bnode" else None) or short(r["o"])) for r in rows}

    full, clean = plain_expansion(triples(onto))
    assert len(rules.EXPANSION) == 27 and len(rules.CLEANUP) == 13
    assert triples(rules.expand_ontology(onto, cleanup=False)) == full
    assert triples(rules.expand_ontology(onto)) == clean


def test_minting_fails_loudly(spark):
    t = rdf.from_turtle(spark, "<t:1> a <u:T> ; <u:of> <t:2> . <t:2> a <u:T> ; <u:of> <t:1> .")
    gen = rules.Generator("SELECT ?x WHERE { ?x a <u:T> }", "SELECT ?uri ?k WHERE { ?uri <u:of> ?k }", "u:new/#{[k]}")
    with pytest.raises(rules.MintingError, match="can't be replaced"):
        rules.mint(t, [gen], "t:")
    with pytest.raises(rules.MintingError, match="exactly once"):
        rules.mint(t, [gen, gen], "t:")
    with pytest.raises(rules.MintingError, match="exactly once"):
        rules.mint(t, [rules.Generator("SELECT ?x WHERE { ?x a <u:None> }", gen.variables, gen.template)], "t:")


OPS = """{id: "person", operations: {talk: {template: "ASK { ?contextUri ex:talks true }"}, mute: {template: "ASK { ?contextUri ex:talks true }", negate: true}, off: {template: false}, all: {requires: ["kids*/talk"]}, some: {optional: ["talk", "off"]}},
 groups: {kids: {selectorQuery: "SELECT ?k WHERE { ?contextUri ex:child ?k }", multiselect: true, operations: {talk: {template: "ASK { ?contextUri ex:talks true }"}, up: {requires: ["../mute"]}}}}}"""


def test_operations(g, p):
    uris = access.find_all(g, p, "Person")
    got = {(r["uri"][-1], r["group"], (r["member"] or "-")[-1], r["operation"]): r["enabled"] for r in operations.evaluate(g, operations.load(OPS, prefixes=PREFIX), uris, prefixes=PREFIX).collect()}
    assert got["b", "", "b", "talk"] and got["h", "", "h", "mute"] and not got["b", "", "b", "off"] and got["b", "", "b", "some"] and not got["h", "", "h", "some"]
    assert got["h", "kids", "b", "talk"] and not got["h", "kids", "l", "talk"] and not got["h", "", "h", "all"] and got["m", "", "m", "all"] and got["h", "kids", "l", "up"]
    few = operations.evaluate(g, operations.load(OPS, prefixes=PREFIX), uris, permissions=["talk"], prefixes=PREFIX)
    assert {r["operation"] for r in few.where("enabled").collect()} == {"talk"}
    for text in ('{id: "x", operations: {a: {}}}', '{id: "x", operations: {a: {requires: ["b"]}}}', '{id: "x", operations: {a: {template: "ASK {"}}}'):
        with pytest.raises(operations.OperationError):
            operations.load(text)
    loop = operations.load('{id: "x", operations: {a: {requires: ["b"]}, b: {requires: ["a"]}}}')
    with pytest.raises(operations.OperationError, match="requires itself"):
        operations.evaluate(g, loop, uris)
    assert operations.permissions_of({"Admin": ["a", "b"], "user": ["c"]}, ["ADMIN"], default=["d"]) == ["a", "b", "d"]
    assert operations.visible_columns(["a", "b"], {"b": ["boss"]}, ["user"]) == ["a"]


SYNC = "SELECT ?graph ?stamp WHERE { GRAPH ?graph { ?x a ex:Draft OPTIONAL { ?x ex:stamp ?stamp } } }"
DRAFTS = """@prefix ex: <http://ex/> . ex:g1 { ex:d1 a ex:Draft ; ex:stamp "1" ; ex:secret 1 . } ex:g2 { ex:d2 a ex:Draft ; ex:secret 2 . }"""


def test_synchronisation_is_idempotent(spark):
    source = rdf.from_turtle(spark, DRAFTS)
    target = rdf.from_turtle(spark, '@prefix ex: <http://ex/> . ex:g1 { ex:d1 a ex:Draft ; ex:stamp "0" . } ex:g9 { ex:d9 a ex:Draft ; ex:stamp "1" . }')
    rule = ["CONSTRUCT { GRAPH ?g { ?x a ex:Draft } } WHERE { GRAPH ?g { ?x a ex:Draft } }"]
    query = "SELECT ?graph ?stamp WHERE { GRAPH ?graph { ?x a ex:Draft OPTIONAL { GRAPH ?graph { ?y ex:stamp ?stamp } } } }"
    a, b = sync.synchronise(source, target, query, rule, "http://ex/stamp", "now", PREFIX)
    assert ids(b.select("g").distinct(), "g") == ["g1", "g2"] and b.where("p like '%secret'").count() == 0
    actions = sync.sync_actions(sync.stamps(a, query, PREFIX), sync.stamps(b, query, PREFIX))
    assert {r["action"] for r in actions.collect()} == {"none"}
    with pytest.raises(ValueError, match="not graph and stamp"):
        sync.stamps(source, "SELECT ?graph WHERE { GRAPH ?graph { ?s ?p ?o } }")


def test_deltas(spark, g):
    new = g.where("o <> 'Bart'")
    d = sync.delta(g, new)
    assert d.count() == 1 and difference(sync.apply_delta(g, d), new).count() == 0
    assert sync.delta_text(d).first()["text"] == "DELETE DATA { <http://ex/b> <http://ex/name> '''Bart'''^^<http://www.w3.org/2001/XMLSchema#string> . }"
    stamped = sync.stamp_resources(g, g.select("s").limit(1), "2024-01-01T00:00:00")
    assert stamped.where(F.col("p").isin(DCT + "created", DCT + "modified")).count() == 2


def test_index(spark, g, p, tmp_path):
    d = doc_profile(load(PROFILE.replace("maxCardinality: 1}}, spouse", "}}, spouse")))
    part = index.Partition("people", ("SELECT ?x WHERE { ?x a ex:Child }",), ("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }",), ('SELECT ?root ?k ?nList WHERE { ?root ex:name ?nList BIND("n" AS ?k) }',))
    rows = index.build(g, [part], d, PREFIX, now_ms=5)
    store = index.IndexStore(spark, str(tmp_path))
    first = store.rebuild("people", rows, 1)
    second = store.rebuild("people", rows, 2)
    assert store.alias("people") == second and store.names() == [second] and first != second
    assert index.by_type(store.read("people"), "Child").count() == 2 and json.loads(store.read("people").orderBy("id").first()["json"])["facets"] == {"n": ["Bart"]}
    assert {(r["name"], r["count"]) for r in store.metadata().collect()} == {(second, 2)}
    assert index.collect_garbage(rows, 6).count() == 0 and index.fetch(rows, spark.createDataFrame([("http://ex/b",), ("u:no",)], "id string")).where("found").count() == 1
    plan = spark.createDataFrame([("u:g", "u:1", "T", "i"), ("u:g", "u:2", "T", "i")], "graph string, uri string, type string, index string")
    done, failed, summary = index.reindex(plan, lambda df: df.withColumn("json", F.lit("{}")).withColumn("error", F.when(F.col("uri") == "u:2", "bad")), attempts=2)
    assert done.count() == 1 and summary["failed"] == 1 and [(r["uri"], r["error"]) for r in failed.collect()] == [("u:2", "bad")]


def test_contexts_and_listed_integers(spark):
    one = {"a": "u:a", "b": "u:b", "b0": "u:b0"}
    assert documents.merge_prefixes(one, {"x": "u:a", "b": "u:new", "c": "u:c"}) == {**one, "b1": "u:new", "c": "u:c"}
    g = rdf.from_turtle(spark, "<u:1> a <u:N> ; <u:one> 5 ; <u:many> 6 , 7 .")
    p = doc_profile(load('{types: {N: {rules: {rdfType: "u:N"}, attributes: {one: {uri: "u:one", rules: {range: {datatype: "xsd:integer"}, maxCardinality: 1}}, many: {uri: "u:many", rules: {range: {datatype: "xsd:integer"}}}}}}}'))
    docs = documents.to_json(documents.to_rows(g, p, spark.createDataFrame([("u:1",)], "s string")), context={"u": "u:"})
    got = json.loads(docs.first()["json"])
    assert got["context"] == {"prefix": {"u": "u:"}} and got["data"]["attributes"] == {"one": {"xsd:integer": 5}, "many": {XSD + "integer": ["6", "7"]}}
    assert difference(documents.from_json(docs, p), g).count() == difference(g, documents.from_json(docs, p)).count() == 0


def test_documents_of_any_depth(spark):
    chain = rdf.from_turtle(spark, "".join(f"<u:{i}> a <u:N> ; <u:next> <u:{i + 1}> . " for i in range(14)) + "<u:14> a <u:N> ; <u:next> <u:0> .")
    p = doc_profile(load('{types: {N: {rules: {rdfType: "u:N"}, attributes: {next: {uri: "u:next", rules: {range: {classId: "N"}, maxCardinality: 1}}}}}}'))
    roots = spark.createDataFrame([("u:3",)], "s string")
    rows = documents.to_rows(chain, p, roots).collect()
    assert {r["uri"]: r["level"] for r in rows} == {f"u:{(3 + k) % 15}": k for k in range(15)}
    with pytest.raises(documents.ConversionError, match="levels deep"):
        documents.to_rows(chain, p, roots, max_depth=8)


def test_routing_and_composition(spark, g):
    out = sync.route(g, [("http://ex/h", "u:h"), ("~http://ex/[hm]", "u:both")], "u:rest")
    assert {r["g"]: r["count"] for r in out.groupBy("g").count().collect()}.keys() == {"u:h", "u:both", "u:rest"}
    rows = spark.createDataFrame([("1", "true"), ("2", "false")], "id string, ok string")
    t = sync.Template("u:g", "u:x/${id}", (("u:n", "no ${id}", "add", STRING),), "u:T", "ok")
    assert {r["s"] for r in sync.compose(g.limit(0), rows, [t]).collect()} == {"u:x/1"}
    assert rows.agg(sync.next_version(F.lit("v7"), r"v(\d+)").alias("n")).first()["n"] == 8


def test_ontology_round_trip(spark, p):
    back, unused = ontology.from_owl(ontology.to_owl(spark, p))
    assert back.rdf_types("Child") == p.rdf_types("Child") and back.attributes("Person")["name"].max == 1 and not unused
    roles = {r["s"]: r["role"] for r in ontology.classify_subjects(ontology.to_owl(spark, p)).collect()}
    assert roles["http://ex/Person"] == "class" and roles["http://ex/name"] == "property" and "restriction" in roles.values()
    sheet = ontology.to_sheet(spark, p).where("attribute = 'name' and type = 'Person'").first()
    assert sheet["cardinality"] == "1..1" and sheet["range"] == STRING
    union = rdf.from_turtle(spark, "@prefix r: <%s> . @prefix o: <http://www.w3.org/2002/07/owl#> . <u:A> a o:Class ; r:subClassOf [ a o:Restriction ; o:onProperty <u:p> ; o:maxQualifiedCardinality 2 ; o:onClass <u:B> ] . <u:B> a o:Class . <u:p> a o:ObjectProperty ; r:domain <u:A> ; r:range [ a o:Class ; o:unionOf (<u:A> <u:B>) ] ." % RDFS)
    q, _ = ontology.from_owl(union)
    assert q.attributes("A")["p"].max == 2 and {r.name for r in q.attributes("A")["p"].range} == {"and"}


def test_streaming(spark, sf_dir, tmp_path):
    from graphloom import streaming

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    assert streaming.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_rules_of_an_ontology_and_their_profile(spark):
    from graphloom.operators import owl_rules

    text = """@prefix o: <http://www.w3.org/2002/07/owl#> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix x: <http://www.w3.org/2001/XMLSchema#> .
<u:ont> a o:Ontology . <u:A> a o:Class ; r:seeAlso <u:doc> . <u:B> a o:Class ; r:subClassOf <u:A> , [ a o:Restriction ; o:onProperty <u:name> ; o:minCardinality "2"^^x:nonNegativeInteger ] ,
 [ a o:Restriction ; o:onProperty <u:to> ; o:someValuesFrom <u:A> ] , [ a o:Restriction ; o:onProperty <u:to> ; o:hasValue <u:thing> ] , [ a o:Restriction ; o:onProperty <u:to> ; o:maxQualifiedCardinality "3"^^x:int ; o:onClass <u:A> ] .
<u:name> a o:DatatypeProperty ; r:domain <u:A> ; r:range x:string . <u:to> a o:ObjectProperty ; r:domain <u:B> ; r:range <u:A> , <u:B> . <u:many> a o:ObjectProperty ; r:domain <u:A> , <u:C> . <u:C> a o:Class .
<u:lower> <u:says> "l" . <u:Upper> <u:says> "u" ."""
    rows = owl_rules.rules_of(rdf.from_turtle(spark, text))
    got = {(r["kind"], r["subject"], r["on"], r["value"], r["number"]) for r in rows.collect()}
    for rule in [
        ("ontology", "u:ont", None, None, None), ("class", "u:A", None, None, None), ("property", "u:name", None, None, None), ("property?", "u:lower", None, None, None), ("class?", "u:Upper", None, None, None),
        ("subClassOf", "u:B", None, "u:A", None), ("minCardinality", "u:B", "u:name", None, 2), ("someValuesFrom", "u:B", "u:to", "u:A", None), ("hasValue", "u:B", "u:to", "u:thing", None), ("maxQualifiedCardinality", "u:B", "u:to", "u:A", 3),
        ("range", "u:name", None, XSD + "string", None), ("domain", "u:to", None, "u:B", None), ("extra", "u:A", RDFS + "seeAlso", "u:doc", None), ("extra", "u:lower", "u:says", "l", None),
    ]:
        assert rule in got, rule
    assert not any(k == "subClassOf" and v.startswith("b") for k, _, _, v, _ in got)
    p, unused = owl_rules.profile_of(rows)
    assert p.uri == "u:ont" and "u:A" in p.supers("u:B") and p.conforms_to("u:B", "u:A")
    name, to = p.attributes("u:B")["u:name"], p.attributes("u:B")["u:to"]
    assert (name.min, name.max, [r.value for r in name.range]) == (2, None, [XSD + "string"]) and p.attributes("u:A")["u:name"].min is None
    assert [(r.name, r.value) for r in to.range] == [("classId", "u:B")] and "u:many" not in p.attributes("u:A")
    kinds = {r[0] for r in unused}
    assert {"someValuesFrom", "hasValue", "maxQualifiedCardinality", "extra", "domain"} <= kinds
    with pytest.raises(ProfileError, match="0 ontologies"):
        owl_rules.profile_of(rows.where("kind <> 'ontology'"))


def test_digest_of_sorted_texts_keeps_them_from_the_driver(spark, monkeypatch):
    texts = spark.range(0, 20000, 1, 7).select(F.format_string("%05d", F.col("id") * 7919 % 20000).alias("t"))
    wants = {gap: hashlib.sha256(gap.join(f"{i:05d}" for i in range(20000)).encode()).hexdigest() for gap in ("", "\n\n")}
    monkeypatch.setattr(type(texts), "toLocalIterator", lambda *a, **b: pytest.fail("texts sent to the driver"))
    for gap, want in wants.items():
        assert [tuple(r) for r in canon.joined_sha256(texts, "t", [], between=gap).collect()] == [(want,)]
    assert canon.joined_sha256(texts.limit(0), "t", []).first()["digest"] == hashlib.sha256(b"").hexdigest()


def test_ontology_rules_deal_their_rows_out_by_their_number(spark, monkeypatch):
    from graphloom.operators import owl_rules
    from graphloom.sources import shared

    monkeypatch.setattr(shared, "ROWS_A_TASK", 10)
    quads = rdf.from_lines(spark.range(60).select(F.format_string("<u:C%d> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <u:D%d> .", "id", F.col("id") % 7).alias("value")))
    rows = owl_rules.rules_of(quads, expand=False)
    assert rows.rdd.getNumPartitions() == 6 and rows.where("kind = 'subClassOf'").count() == 60


def _exchanges(df):
    """Partitions of each exchange of a plan by keys, and whether the query named their number itself."""
    import re

    found = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (\w+)", df._jdf.queryExecution().executedPlan().toString())
    return [(int(n), why) for n, why in found]


def test_minting_deals_out_its_steps_by_their_rows(spark, monkeypatch):
    """No task's rows grow with the graph: partitions are of a number by the rows, and a class or value of many quads isn't a key."""
    from graphloom.sources import shared

    monkeypatch.setattr(shared, "ROWS_A_TASK", 50)
    q = quads_of(spark, [x for i in range(100) for x in ((f"<t:{i}>", "<urn:p>", "<u:C>"), (f"<t:{i}>", "<urn:key>", f'"{i}"'), (f"<t:{i}>", "<urn:to>", f"<t:{(i + 1) % 100}>"))])
    made, kept, cut = [], rules.replace_iris, rules.cut
    monkeypatch.setattr(rules, "replace_iris", lambda *a, **b: made.append(kept(*a, **b)) or made[-1])
    steps = []
    monkeypatch.setattr(rules, "cut", lambda df, *a: steps.append(df) or cut(df, *a))
    gen = rules.Generator("SELECT ?x WHERE { ?x <urn:p> <u:C> }", "SELECT ?uri ?k WHERE { ?uri <urn:key> ?k }", "new:#{[k]}")
    out = {(r["s"], r["p"], r["o"]) for r in rules.mint(q, [gen], "t:").collect()}
    assert out == {x for i in range(100) for x in ((f"new:{i}", "urn:p", "u:C"), (f"new:{i}", "urn:key", str(i)), (f"new:{i}", "urn:to", f"new:{(i + 1) % 100}"))}
    assert len(_exchanges(made[0])) == 5 and set(_exchanges(made[0])) == {(6, "REPARTITION_BY_NUM")}
    assert all(why == "REPARTITION_BY_NUM" for df in steps[1:] for _, why in _exchanges(df))
    # the objects of one predicate are one class, yet no partition has them all
    monkeypatch.setattr(rules, "set_of", lambda df, tasks=None: df)
    rows = kept(q.where("p = 'urn:p'"), spark.createDataFrame([(f"t:{i}", f"new:{i}") for i in range(100)], "old string, new string"), tasks=10)
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id().alias("k")).count().collect()) < 40


def test_joins_of_many_rows_are_dealt_out_by_their_rows(spark, sf_dir, monkeypatch):
    from graphloom import queries
    from graphloom.plans import compiler
    from graphloom.sources import shared

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = {tuple(r) for r in queries.theta_pairs_same_order(spark, sf_dir).collect()}
    for module in (shared, compiler):
        monkeypatch.setattr(module, "ROWS_A_TASK", 100)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = queries.theta_pairs_same_order(spark, sf_dir)
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        dealt = [n for n, why in _exchanges(df) if why == "REPARTITION_BY_NUM"]
        assert dealt == [-(-rows // 100)] * 2 and len(_exchanges(df)) == 3  # both sides once, and the groups
        assert {tuple(r) for r in df.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_resource_of_many_documents_has_several_tasks(spark, monkeypatch):
    from graphloom.operators import documents

    monkeypatch.setattr(documents, "ROWS_A_TASK", 50)
    docs = spark.range(400).selectExpr("concat('d', id) doc", "'hot' s", "1 level").unionAll(spark.sql("select 'r', 'r', 0"))
    facts = spark.sql("select 'hot' s, 'x' value union all select 'hot', 'y' union all select 'r', 'z'")
    out = documents._meet(docs, facts, 16)
    assert {(r["doc"], r["s"], r["level"], r["value"]) for r in out.collect()} == {(f"d{i}", "hot", 1, v) for i in range(400) for v in "xy"} | {("r", "r", 0, "z")} and out.count() == 801
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id().alias("k")).count().collect()) < 500
