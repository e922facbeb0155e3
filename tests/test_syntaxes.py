"""RDF/XML, JSON-LD, TriG: readers on documents of every construct, and what writers write reads back."""

import json

import pytest

from graphloom.functions.terms import LANG_STRING, RDF, RDF_TYPE, STRING, XSD
from graphloom.operators import canon
from graphloom.sources import rdf
from graphloom.sources.quads import SCHEMA
from graphloom.sources.syntaxes import DocumentError, parse_jsonld, parse_rdfxml, to_jsonld, to_rdfxml, to_trig

XML = """<?xml version="1.0"?><!DOCTYPE rdf:RDF [<!ENTITY e "http://e/">]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/doc" xml:lang="en">
  <e:Person rdf:about="&e;h" e:nick="H"><e:name xml:lang="">Homer</e:name><e:label>H &amp; co</e:label>
    <e:age rdf:datatype="http://www.w3.org/2001/XMLSchema#int">39</e:age><e:spouse rdf:resource="#m"/><e:home rdf:nodeID="home"/>
    <e:job rdf:parseType="Resource"><e:title xml:lang="fr">inspecteur</e:title></e:job><e:child><e:Person rdf:ID="b"><e:name xml:lang="">Bart</e:name></e:Person></e:child>
    <e:note rdf:parseType="Literal">a <b>c</b></e:note><e:list rdf:parseType="Collection"><rdf:Description rdf:about="x"/><rdf:Description rdf:about="y"/></e:list>
    <e:car e:colour="pink"/><e:empty/></e:Person>
  <rdf:Bag rdf:nodeID="home"><rdf:li>one</rdf:li><rdf:li rdf:resource="http://e/two"/></rdf:Bag>
  <rdf:Description rdf:ID="m"><e:says rdf:ID="st">hi</e:says></rdf:Description>
</rdf:RDF>"""


def facts(rows):
    return {(s, p, o, dt.removeprefix(XSD).removeprefix(RDF), lang) for _, s, _, p, o, _, dt, lang in rows}


def test_rdfxml():
    rows = parse_rdfxml(XML)
    got = facts(rows)
    e, h, m = "http://e/", "http://e/h", "http://b/doc#m"
    for fact in [
        (h, RDF_TYPE, e + "Person", "", ""), (h, e + "nick", "H", "langString", "en"), (h, e + "name", "Homer", "string", ""), (h, e + "label", "H & co", "langString", "en"), (h, e + "age", "39", "int", ""),
        (h, e + "spouse", m, "", ""), (h, e + "home", "n-home", "", ""), ("n-home", RDF_TYPE, RDF + "Bag", "", ""), ("n-home", RDF + "_1", "one", "langString", "en"), ("n-home", RDF + "_2", e + "two", "", ""),
        (h, e + "child", "http://b/doc#b", "", ""), ("http://b/doc#b", e + "name", "Bart", "string", ""), (h, e + "empty", "", "langString", "en"), (m, e + "says", "hi", "langString", "en"),
        ("http://b/doc#st", RDF + "subject", m, "", ""), ("http://b/doc#st", RDF + "object", "hi", "langString", "en"),
    ]:
        assert fact in got, fact
    assert any(o.startswith("a <b") and dt == "XMLLiteral" for _, _, o, dt, _ in got)
    job = next(o for s, p, o, *_ in got if p == e + "job")
    assert (job, e + "title", "inspecteur", "langString", "fr") in got
    first = next(o for s, p, o, *_ in got if p == e + "list")
    assert (first, RDF + "first", "http://b/x", "", "") in got and any(o == RDF + "nil" for *_, o, _, _ in [(s, p, o, d, x) for s, p, o, d, x in got])
    car = next(o for s, p, o, *_ in got if p == e + "car")
    assert (car, e + "colour", "pink", "langString", "en") in got and len(rows) == 29  # counted by hand
    for bad in ("<a>", "<a/>", '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><r:Description><x xmlns="http://e/"><r:Description/><r:Description/></x></r:Description></r:RDF>'):
        with pytest.raises(DocumentError):
            parse_rdfxml(bad)


JSON = {
    "@context": {"@base": "http://b/", "@vocab": "http://v/", "e": "http://e/", "xsd": XSD, "knows": {"@id": "e:knows", "@type": "@id"}, "born": {"@id": "e:born", "@type": "xsd:date"}, "label": {"@id": "e:label", "@container": "@language"}, "steps": {"@id": "e:steps", "@container": "@list"}, "parent": {"@reverse": "e:child"}, "kind": "@type", "hidden": None},
    "@graph": [
        {"@id": "h", "kind": ["e:Person", "Man"], "e:name": "Homer", "knows": ["m", "_:b"], "born": "1956-05-12", "label": {"en": "H", "fr": ["Ho", "Hom"]}, "steps": [1, 2.5, True], "hidden": 1, "plain": {"@value": "x", "@language": "de"}, "typed": {"@value": "7", "@type": "xsd:int"}, "e:none": None, "e:set": {"@set": ["p", "q"]}},
        {"@id": "_:b", "parent": {"@id": "h"}, "big": 1e30},
        {"@id": "http://g/1", "@graph": [{"@id": "s", "p": {"@id": "o"}}]},
    ],
}


def test_jsonld():
    rows = parse_jsonld(json.dumps(JSON))
    got = facts(rows)
    h, e, v = "http://b/h", "http://e/", "http://v/"
    for fact in [
        (h, RDF_TYPE, e + "Person", "", ""), (h, RDF_TYPE, v + "Man", "", ""), (h, e + "name", "Homer", "string", ""), (h, e + "knows", "http://b/m", "", ""), (h, e + "knows", "b", "", ""), (h, e + "born", "1956-05-12", "date", ""),
        (h, e + "label", "H", "langString", "en"), (h, e + "label", "Hom", "langString", "fr"), (h, v + "plain", "x", "langString", "de"), (h, v + "typed", "7", "int", ""), (h, e + "set", "p", "string", ""), (h, e + "child", "b", "", ""),
        ("b", v + "big", "1.0E30", "double", ""), ("http://b/s", v + "p", "http://b/o", "", ""),
    ]:
        assert fact in got, fact
    assert {(o, dt) for _, p, o, dt, _ in got if p == RDF + "first"} == {("1", "integer"), ("2.5E0", "double"), ("true", "boolean")}
    assert [r[0] for r in rows if r[1] == "http://b/s"] == ["http://g/1"] and not any(p.endswith(("hidden", "none")) for _, p, *_ in got)
    for bad in ("{", '{"@context": "http://elsewhere/", "a": 1}'):
        with pytest.raises(DocumentError):
            parse_jsonld(bad)


ROWS = [
    (None, "http://e/s", "iri", RDF_TYPE, "http://e/T", "iri", "", ""), (None, "http://e/s", "iri", "http://e/p", 'a "q" \\ <x> & \n\t y', "lit", STRING, ""), (None, "http://e/s", "iri", "http://e/p", "été", "lit", LANG_STRING, "fr"),
    (None, "http://e/s", "iri", "http://f/q", "1", "lit", XSD + "int", ""), (None, "b1", "bnode", "http://e/p", "http://e/s", "iri", "", ""), (None, "http://e/s", "iri", "http://e/p", "b1", "bnode", "", ""),
]


@pytest.mark.parametrize("syntax", ["rdfxml", "jsonld", "turtle", "nquads"])
def test_documents_read_back(spark, tmp_path, syntax):
    one = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / f"graph.{ {'rdfxml': 'owl', 'jsonld': 'jsonld', 'turtle': 'trig', 'nquads': 'nq'}[syntax] }")
    rdf.write(one, path, syntax=syntax, prefixes={"e": "http://e/"})
    assert canon.isomorphic(one, rdf.read(spark, path))
    text = rdf.document(one, syntax, {"e": "http://e/"})
    again = spark.createDataFrame(rdf.parse(text, syntax), SCHEMA) if syntax != "nquads" else rdf.from_lines(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"))
    assert canon.isomorphic(one, again)
    with pytest.raises(ValueError):
        rdf.write(one, str(tmp_path / "two"), syntax="turtle", documents=2)


def test_named_graphs_and_many_documents(spark, tmp_path):
    rows = [("http://g/1", f"http://e/{i}", "iri", "http://e/p", str(i), "lit", STRING, "") for i in range(40)] + [(None, "http://e/x", "iri", "http://e/p", "y", "lit", STRING, "")]
    quads = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in rdf.parse(to_trig(rows), "turtle")} == {tuple(r) for r in parse_jsonld(to_jsonld(rows))} == set(rows)
    with pytest.raises(DocumentError):
        to_rdfxml(rows)
    for syntax in ("turtle", "jsonld"):
        rdf.write(quads, str(tmp_path / syntax), syntax=syntax, documents=4)
        assert {tuple(r) for r in rdf.read(spark, str(tmp_path / syntax), syntax).collect()} == set(rows)
    assert rdf.syntax_of("a/b.rdf") == rdf.syntax_of("x.unknown") == "rdfxml" and rdf.syntax_of("a.b/c") == "nquads"
