"""Ontologies as a table of rules, and a profile from such a table.

rules_of() expands an ontology and reads every subject as what it is: the ontology, a class, a property, or a candidate for
either by the case of its first letter. A rule is a row (kind, subject, on, value, number). Lists, restrictions and anonymous
classes give no row of their own; a restriction gives one under the class that it restricts.

Stated departures from the format's first reader: literal counts of qualified restrictions are read, a count on an inherited
attribute reaches the type, super-classes beside their sub-class leave an AND range, and typed properties are no candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import OWL, RDF, RDF_TYPE, RDFS, XSD
from graphloom.operators.profile import Attribute, Profile, ProfileError, Rule, TypeDef
from graphloom.operators.rules import expand_ontology
from graphloom.sources.shared import cut, tasks_for

CLASS_TYPES = (OWL + "Class", RDFS + "Class")
PROPERTY_TYPES = (RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty")
#: Restrictions in the order in which one is looked for, and the profile rules that counts become.
VALUES = ("hasValue", "someValuesFrom", "allValuesFrom")
COUNTS = {"cardinality": ("minCardinality", "maxCardinality"), "minCardinality": ("minCardinality",), "maxCardinality": ("maxCardinality",)}
QUALIFIED = {"qualifiedCardinality": "cardinality", "minQualifiedCardinality": "minCardinality", "maxQualifiedCardinality": "maxCardinality"}


def _type(*names: str) -> Column:
    return F.arrays_overlap(F.coalesce("types", F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))


def roles(quads: DataFrame) -> DataFrame:
    """(s, role) of every subject: ontology, list, restriction, range, class, property, property?, class? or unknown."""
    facts = quads.groupBy("s", "s_kind").agg(
        F.collect_set(F.when(F.col("p") == RDF_TYPE, F.col("o"))).alias("types"), F.max(F.col("p") == RDF + "rest").alias("listed"), F.max(F.col("p") == OWL + "onProperty").alias("restricts")
    )
    used = quads.where((F.col("p") == RDFS + "range") & (F.col("o_kind") == "bnode")).groupBy(F.col("o").alias("s")).agg(F.count("*").alias("uses"))
    initial = F.substring(F.regexp_extract("s", r"([^#/:]*)$", 1), 1, 1)
    iri = F.col("s_kind") == "iri"
    role = (
        F.when(_type(OWL + "Ontology"), "ontology").when(F.col("listed"), "list").when(_type(OWL + "Restriction"), "restriction")
        .when(_type(*CLASS_TYPES) & ~iri & (F.col("uses") == 1), "range").when(_type(*CLASS_TYPES) & iri, "class").when(_type(*PROPERTY_TYPES), "property")
        .when(iri & (initial != F.upper(initial)), "property?").when(iri & (initial != F.lower(initial)), "class?").otherwise("unknown")
    )
    return facts.join(used, "s", "left").select("s", role.alias("role"))


def rules_of(quads: DataFrame, expand: bool = True) -> DataFrame:
    """(kind, subject, on, value, number) of an ontology."""
    x = cut(expand_ontology(quads) if expand else quads)
    tasks = tasks_for(x)
    x = x.repartition(tasks, "s")
    of = cut(roles(x))
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    row = lambda kind, s="s", on=text, value=text, number=none: [kind.alias("kind"), F.col(s).alias("subject"), on.alias("on"), value.alias("value"), number.alias("number")]
    out = [of.where(F.col("role").isin("ontology", "class", "property", "class?", "property?")).select(*row(F.col("role")))]

    facts = cut(x.join(of.hint("merge"), "s"))
    classes, properties = facts.where(F.col("role").isin("class", "class?")), facts.where(F.col("role").isin("property", "property?"))
    iri = F.col("o_kind") == "iri"
    restricted = classes.where((F.col("p") == RDFS + "subClassOf")).repartition(tasks, "o").join(of.where("role = 'restriction'").select(F.col("s").alias("r")).hint("merge"), F.col("o") == F.col("r"), "left_semi").select(F.col("s").alias("c"), F.col("o").alias("r"))
    for p, kind in ((RDFS + "subClassOf", "subClassOf"), (OWL + "equivalentClass", "equivalentClass")):
        plain = classes.where((F.col("p") == p) & iri).repartition(tasks, "o").join(of.where("role = 'restriction'").select(F.col("s").alias("_r")), F.col("o") == F.col("_r"), "left_anti")
        out.append(plain.select(*row(F.lit(kind), value=F.col("o"))))
    for p, kind in ((RDFS + "domain", "domain"), (RDFS + "range", "range")):
        out.append(properties.where((F.col("p") == p) & iri).select(*row(F.lit(kind), value=F.col("o"))))
    for rows, known in ((classes, (RDF_TYPE, RDFS + "subClassOf", OWL + "equivalentClass", OWL + "disjointWith")), (properties, (RDF_TYPE, OWL + "inverseOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"))):
        out.append(rows.where(~F.col("p").isin(*known)).select(*row(F.lit("extra"), on=F.col("p"), value=F.col("o"))))

    # restrictions: one onProperty, then the first kind of limit that they have
    limits = [*VALUES, *COUNTS, *QUALIFIED]
    one = lambda p, what: F.when(F.sum(F.when(F.col("p") == OWL + p, 1)) == 1, F.max(F.when((F.col("p") == OWL + p) & what, F.col("o"))))
    named, literal = iri, F.col("o_kind") == "lit"
    wide = x.groupBy("s").agg(
        one("onProperty", named).alias("on"), *[F.max(F.col("p") == OWL + n).alias(f"has_{n}") for n in limits], *[one(n, named).alias(n) for n in VALUES],
        *[one(n, literal).alias(n) for n in (*COUNTS, *QUALIFIED)], F.coalesce(one("onClass", named), one("onDataRange", named), one("onDatatype", named)).alias("qualifies"),
    )
    kind = reduce(lambda c, n: c.when(F.col(f"has_{n}"), F.lit(n)), limits[1:], F.when(F.col(f"has_{limits[0]}"), F.lit(limits[0])))
    limited = cut(restricted.repartition(tasks, "r").join(wide.hint("merge"), restricted["r"] == wide["s"]).where("on is not null").withColumn("kind", kind))
    for n in VALUES:
        out.append(limited.where((F.col("kind") == n) & F.col(n).isNotNull()).select(*row(F.lit(n), "c", F.col("on"), F.col(n))))
    for n in COUNTS:
        out.append(limited.where((F.col("kind") == n) & F.col(n).isNotNull()).select(*row(F.lit(n), "c", F.col("on"), number=F.col(n).try_cast("int"))))
    for n in QUALIFIED:
        out.append(limited.where((F.col("kind") == n) & F.col(n).isNotNull() & F.col("qualifies").isNotNull()).select(*row(F.lit(n), "c", F.col("on"), F.col("qualifies"), F.col(n).try_cast("int"))))
    return reduce(DataFrame.unionByName, out).repartition(tasks, "kind", "subject", "on", "value").distinct()


def profile_of(rules: DataFrame) -> tuple[Profile, list[tuple]]:
    """(profile, rules that it doesn't use) of rules_of(). Ids of types and attributes are IRIs; rules are of ontology size."""
    rows = sorted((tuple(r) for r in rules.select("kind", "subject", "on", "value", "number").collect()), key=lambda r: tuple(str(x) for x in r))
    by: dict[str, list[tuple]] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    if len(by.get("ontology", [])) != 1:
        raise ProfileError(f"{len(by.get('ontology', []))} ontologies")
    candidates = {r[1] for r in by.get("class?", [])}
    used = {"ontology", "class", "property", "subClassOf"}
    supers: dict[str, list[str]] = {c: [] for c in (r[1] for r in by.get("class", []))}
    for _, c, _, up, _ in by.get("subClassOf", []):
        supers.setdefault(c, [])
        supers.setdefault(up, [])
        supers[c].append(up)

    def above(c: str) -> set[str]:
        seen, todo = set(), [c]
        while todo:
            for up in supers.get(todo.pop(), []):
                if up not in seen:
                    seen.add(up)
                    todo.append(up)
        return seen - {c}

    def plain(iri: str) -> Rule:
        if iri.startswith(XSD) or iri in (RDFS + "Literal", RDF + "langString", RDF + "PlainLiteral"):
            return Rule("datatype", iri)
        if iri not in supers and iri in candidates:
            supers[iri] = []
        return Rule("classId", iri)

    def together(iris: list[str]) -> Rule:
        kept = [plain(x) for x in iris if not any(x in above(y) for y in iris)]
        return kept[0] if len(kept) == 1 else Rule("and", tuple(kept))

    def grouped(kind: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for _, s, _, v, _ in by.get(kind, []):
            out.setdefault(s, []).append(v)
        return out

    ranges, domains, unused = grouped("range"), grouped("domain"), []
    home: dict[str, str] = {}
    for _, p, *_ in by.get("property", []):
        domain = together(domains[p]) if p in domains else None
        if domain is not None and domain.name == "classId":
            home[p] = domain.value
        else:
            unused += [r for r in rows if r[0] in ("domain", "range") and r[1] == p]
    held: dict[str, dict[str, list[Rule]]] = {}
    for p, c in home.items():
        supers.setdefault(c, [])
        held.setdefault(c, {})[p] = [Rule("range", (together(ranges[p]),))] if p in ranges else []
    for kind, made in COUNTS.items():
        for r in by.get(kind, []):
            _, c, p, _, n = r
            if p not in home or n is None or not (home[p] == c or home[p] in above(c)):
                unused.append(r)
                continue
            own = held.setdefault(c, {}).setdefault(p, [x for x in held[home[p]][p] if x.name == "range"])
            own += [Rule(x, n) for x in made]
    types = {}
    for c in sorted(supers):
        found = {}
        for p, given in held.get(c, {}).items():
            low, high = (pick((r.value for r in given if r.name == name), default=None) for name, pick in (("minCardinality", max), ("maxCardinality", min)))
            kept = [r for r in given if r.name == "range"] + [Rule(k, v) for k, v in (("minCardinality", low), ("maxCardinality", high)) if v is not None]
            found[p] = Attribute(p, p, tuple(kept))
        types[c] = TypeDef(c, (Rule("rdfType", c), *(Rule("subClassOf", u) for u in dict.fromkeys(supers[c]) if u != c)), found)
    unused += [r for k, rs in by.items() if k not in used | {"range", "domain", *COUNTS} for r in rs]
    return Profile(by["ontology"][0][1], types), sorted(unused, key=str)
