"""Shape inference from data in one pass, and conversions between shapes and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import LANG_STRING, RDF, RDF_TYPE, SH, XSD
from graphloom.operators.profile import DocAttribute, DocProfile, DocType, Profile, ProfileError, Rule
from graphloom.sources.quads import SCHEMA, as_source


def infer(source, ignore_types: Sequence[str] = (), class_names: Mapping[frozenset[str], str] | None = None) -> DataFrame:
    """One row per (type, property): what holds for all instances.

    instances, with_property, min_count (1 if no instance lacks it), max_count (1 if none has two distinct values),
    node_kind (null if all three occur), datatypes, languages, unique_lang, class (if the values have exactly one).
    Two aggregations: per (type, property, subject), then per (type, property).
    """
    source = as_source(source)
    types = source.scan([RDF_TYPE]).where((F.col("o_kind") == "iri") & ~F.col("o").isin(*(ignore_types or [""]))).select("s", F.col("o").alias("type")).distinct()
    instances = types.groupBy("type").agg(F.count("*").alias("instances"))
    facts = source.scan(None).where(F.col("p") != RDF_TYPE).dropDuplicates(["s", "p", "o", "o_kind", "o_dt", "o_lang"])
    is_ = {k: F.max(F.col("o_kind") == k).alias(k) for k in ("iri", "bnode", "lit")}
    tagged = F.when(F.col("o_lang") != "", F.col("o_lang"))
    per_subject = (
        facts.join(types, "s")
        .groupBy("type", "p", "s")
        .agg(
            F.count("*").alias("k"), *is_.values(), F.collect_set(F.when(F.col("o_kind") == "lit", F.col("o_dt"))).alias("dts"), F.collect_set(tagged).alias("langs"),
            (F.count(tagged) > F.count_distinct(tagged)).alias("repeated"),
        )
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    shape = per_subject.groupBy("type", "p").agg(
        F.count("*").alias("with_property"), F.max("k").alias("most"), *[F.max(k).alias(k) for k in is_], union("dts").alias("datatypes"), union("langs").alias("languages"), F.max("repeated").alias("repeated"),
    )
    classes = (
        facts.where(F.col("o_kind") == "iri").join(types.alias("st"), "s").select(F.col("type").alias("type"), "p", F.col("o").alias("v"))
        .distinct()
        .join(types.select(F.col("s").alias("v"), F.col("type").alias("class")), "v")
        .groupBy("type", "p", "v").agg(F.array_sort(F.collect_set("class")).alias("cs"))
        .groupBy("type", "p").agg(F.collect_set("cs").alias("sets"))
    )
    single = F.when((F.size("sets") == 1) & (F.size(F.get("sets", F.lit(0))) == 1), F.get(F.get("sets", F.lit(0)), F.lit(0)))
    for names, name in (class_names or {}).items():
        wanted = F.array(*[F.lit(x) for x in sorted(names)])
        single = F.coalesce(single, F.when((F.size("sets") == 1) & (F.get("sets", F.lit(0)) == wanted), F.lit(name)))
    i, b, t = F.col("iri"), F.col("bnode"), F.col("lit")
    kind = (
        F.when(i & b & t, F.lit(None)).when(i & b, "BlankNodeOrIRI").when(i & t, "IRIOrLiteral").when(b & t, "BlankNodeOrLiteral").when(i, "IRI").when(b, "BlankNode").otherwise("Literal")
    )
    return (
        shape.join(instances, "type").join(classes, ["type", "p"], "left")
        .select(
            "type", F.col("p").alias("property"), "instances", "with_property", (F.col("with_property") == F.col("instances")).cast("int").alias("min_count"),
            F.when(F.col("most") == 1, 1).alias("max_count"), kind.alias("node_kind"), "datatypes", "languages",
            (F.array_contains("datatypes", LANG_STRING) & ~F.col("repeated")).alias("unique_lang"), single.alias("class"),
        )
    )


def type_graphs(source) -> DataFrame:
    """(type, g): graphs with an instance of the type that has another property."""
    rows = as_source(source).scan(None).where(F.col("g").isNotNull())
    other = rows.where(F.col("p") != RDF_TYPE).select("g", "s")
    return rows.where(F.col("p") == RDF_TYPE).join(other, ["g", "s"], "left_semi").select(F.col("o").alias("type"), "g").distinct()


def ordered_shapes(shapes: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """Shapes by type and property: prioritised namespaces first, then IRIs case-insensitively."""

    def key(c):
        rank = F.lit(len(priority))
        for i, p in reversed(list(enumerate(priority))):
            rank = F.when(F.col(c).startswith(p), i).otherwise(rank)
        return [*([rank] if priority else []), F.lower(c), F.col(c)]

    return shapes.orderBy(*key("type"), *key("property"))


def shape_name(type_iri: str, taken: dict[str, str], prefixes: Mapping[str, str]) -> str:
    """A local name for a type's shape; one that another type has gets its prefix before it."""
    cut = max(type_iri.rfind("#"), type_iri.rfind("/"), type_iri.rfind(":")) + 1
    name = type_iri[cut:]
    if taken.get(name, type_iri) != type_iri:
        prefix = next((k for k, v in prefixes.items() if v == type_iri[:cut]), "ns")
        name = prefix + name[:1].upper() + name[1:]
    taken[name] = type_iri
    return name


class _Graph:
    """An accumulator of statements that becomes quads."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.n = 0

    def add(self, s: str, p: str, o: str, kind: str = "iri", dt: str = "") -> None:
        row = (None, s.removeprefix("_:"), "bnode" if s.startswith("_:") else "iri", p, o.removeprefix("_:") if kind != "lit" else o, "bnode" if kind != "lit" and o.startswith("_:") else kind, dt, "")
        if row not in self.rows:
            self.rows.append(row)

    def text(self, s: str, p: str, o, dt: str = XSD + "string") -> None:
        self.add(s, p, str(o), "lit", dt)

    def blank(self) -> str:
        self.n += 1
        return f"_:n{self.n}"

    def list(self, items: Sequence[str]) -> str:
        nodes = [self.blank() for _ in items]
        for i, (n, x) in enumerate(zip(nodes, items)):
            self.add(n, RDF + "first", x)
            self.add(n, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else RDF + "nil")
        return nodes[0] if nodes else RDF + "nil"

    def quads(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)


def to_shacl(shapes: DataFrame, base: str = "urn:shapes#", prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """Shape quads of infer()'s rows; a schema's worth of rows reaches the driver."""
    g, taken = _Graph(), {}
    for r in ordered_shapes(shapes).collect():
        node = base + shape_name(r["type"], taken, prefixes or {})
        g.add(node, RDF_TYPE, SH + "NodeShape")
        g.add(node, SH + "targetClass", r["type"])
        prop = g.blank()
        g.add(node, SH + "property", prop)
        g.add(prop, SH + "path", r["property"])
        if r["min_count"]:
            g.text(prop, SH + "minCount", 1, XSD + "integer")
        if r["max_count"]:
            g.text(prop, SH + "maxCount", 1, XSD + "integer")
        if r["node_kind"]:
            g.add(prop, SH + "nodeKind", SH + r["node_kind"])
        if r["node_kind"] == "Literal":
            if len(r["datatypes"]) == 1:
                g.add(prop, SH + "datatype", r["datatypes"][0])
            else:
                options = []
                for d in r["datatypes"]:
                    options.append(g.blank())
                    g.add(options[-1], SH + "datatype", d)
                g.add(prop, SH + "or", g.list(options))
        if r["unique_lang"]:
            g.text(prop, SH + "uniqueLang", "true", XSD + "boolean")
        if r["languages"]:
            nodes = [g.blank() for _ in r["languages"]]
            for i, (n, x) in enumerate(zip(nodes, r["languages"])):
                g.text(n, RDF + "first", x)
                g.add(n, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else RDF + "nil")
            g.add(prop, SH + "languageIn", nodes[0])
        if r["class"] and r["node_kind"] == "IRI":
            g.add(prop, SH + "class", r["class"])
    return g.quads(shapes.sparkSession)


def shacl_to_doc_profile(shacl: DataFrame) -> DocProfile:
    """A conversion profile of node shapes (a schema's worth of quads reaches the driver)."""
    facts: dict[str, dict[str, list[str]]] = {}
    for r in shacl.collect():
        facts.setdefault(r["s"], {}).setdefault(r["p"], []).append(r["o"])
    types = {}
    for s, f in facts.items():
        if SH + "NodeShape" not in f.get(RDF_TYPE, []):
            continue
        name = s[max(s.rfind("#"), s.rfind("/"), s.rfind(":")) + 1 :]
        attributes = {}
        for prop in f.get(SH + "property", []):
            x = facts[prop]
            paths = [p for p in x.get(SH + "path", [])]
            inverse = [y for p in paths for y in facts.get(p, {}).get(SH + "inversePath", [])]
            if len(paths) != 1 or len(inverse) > 1:
                raise ProfileError(f"{s} needs one path or one inverse path")
            uri = inverse[0] if inverse else paths[0]
            kind = "object" if SH + "class" in x else "datatype"
            id_ = uri[max(uri.rfind("#"), uri.rfind("/"), uri.rfind(":")) + 1 :]
            attributes[id_] = DocAttribute(id_, uri, bool(inverse), x.get(SH + "maxCount") == ["1"], kind)
        types[name] = DocType(name, frozenset(f.get(SH + "targetClass", [])), (), attributes)
    return DocProfile(types)


def profile_to_shacl(spark: SparkSession, p: Profile, base: str = "urn:shapes#") -> DataFrame:
    """Shape quads of a profile: counts, datatypes, classes, and and, or, not of ranges."""
    g = _Graph()

    def constrain(node: str, r: Rule) -> None:
        if r.name == "datatype":
            g.add(node, SH + "datatype", r.value)
        elif r.name == "classId":
            for c in p.rdf_types(r.value):
                g.add(node, SH + "class", c)
        elif r.name in ("and", "or"):
            options = []
            for x in r.rules:
                options.append(g.blank())
                constrain(options[-1], x)
            g.add(node, SH + r.name, g.list(options))
        elif r.name == "not":
            inner = g.blank()
            for x in r.rules:
                constrain(inner, x)
            g.add(node, SH + "not", inner)

    for t in p.type_ids():
        node = base + t
        g.add(node, RDF_TYPE, SH + "NodeShape")
        for c in p.rdf_types(t):
            g.add(node, SH + "targetClass", c)
        for a in p.attributes(t).values():
            prop = g.blank()
            g.add(node, SH + "property", prop)
            if a.inverse:
                path = g.blank()
                g.add(path, SH + "inversePath", a.uri)
                g.add(prop, SH + "path", path)
            else:
                g.add(prop, SH + "path", a.uri)
            for name, n in (("minCount", a.min), ("maxCount", a.max)):
                if n is not None:
                    g.text(prop, SH + name, n, XSD + "integer")
            for r in a.range:
                constrain(prop, r)
    return g.quads(spark)
