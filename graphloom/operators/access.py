"""Typed access: instances of profile types, their attribute values, filters, and paths, for all resources at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import RDF_TYPE, SKOS
from graphloom.operators.profile import Attribute, Profile, ProfileError, Rule
from graphloom.plans import compiler
from graphloom.plans.compiler import constant
from graphloom.plans.sparql import Node, tokens
from graphloom.sources.quads import QuadSource, as_source, set_of

O_TERM = ("o_kind", "o", "o_dt", "o_lang")


def o_term() -> Column:
    return terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))


def types_of(source: QuadSource, tasks: int | None = None) -> DataFrame:
    """(s, type) of all resources; with a number of tasks, dealt out to them by s before any are held."""
    rows = source.scan([RDF_TYPE]).where(F.col("o_kind") == "iri").select("s", F.col("o").alias("type"))
    return (rows.repartition(tasks, "s") if tasks else rows).distinct()


def type_sets(source, tasks: int | None = None) -> DataFrame:
    """(s, types): the sorted set of classes of each resource."""
    return types_of(as_source(source), tasks).groupBy("s").agg(F.array_sort(F.collect_set("type")).alias("types"))


def find_all(source, profile: Profile, type_id: str) -> DataFrame:
    """s of all instances: they have every class of the type, inherited ones too, and meet its scheme and identity rules.

    One aggregation, whatever the number of classes.
    """
    source = as_source(source)
    wanted = profile.rdf_types(type_id)
    rows = source.scan([RDF_TYPE]).where(F.col("o").isin(*wanted))
    found = rows.select("s").distinct() if len(wanted) == 1 else rows.groupBy("s").agg(F.count_distinct("o").alias("n")).where(F.col("n") == len(wanted)).select("s")
    for r in profile.type_rules(type_id):
        if r.name == "inScheme":
            inside = source.scan([SKOS + "inScheme"]).where((F.col("o") == r.value) & (F.col("o_kind") == "iri")).select("s")
            found = found.join(inside, "s", "left_semi")
        elif r.name == "resourceReference":
            found = found.where(F.col("s") == r.value)
        elif r.name == "or":
            tests = [x.value for x in r.rules if x.name == "rdfType"]
            found = found.join(source.scan([RDF_TYPE]).where(F.col("o").isin(*tests)).select("s"), "s", "left_semi")
    return found


def check_instances(source, profile: Profile, type_id: str, ids: DataFrame, column: str = "s") -> DataFrame:
    """ids with `found`: whether each is an instance."""
    have = find_all(source, profile, type_id).select(F.col("s").alias("_s"))
    return ids.join(have, ids[column] == F.col("_s"), "left").select(*ids.columns, F.col("_s").isNotNull().alias("found"))


def find_matching(source, profile: Profile, type_id: str, matchers: Mapping[str, Node]) -> DataFrame:
    """Instances that have each of these values, by term equality: one semi-join a matcher."""
    source, found = as_source(source), find_all(source, profile, type_id)
    attributes = profile.attributes(type_id)
    for name, x in matchers.items():
        rows = source.scan([attributes[name].uri])
        match = (F.col("o") == x.value) & (F.col("o_kind") == x.kind) & (F.col("o_dt") == x.dt) & (F.col("o_lang") == x.lang)
        found = found.join(rows.where(match).select("s"), "s", "left_semi")
    return found


def raw_values(source, attribute: Attribute) -> DataFrame:
    """(s, value) of an attribute; an inverse one has subject and object swapped."""
    rows = as_source(source).scan([attribute.uri])
    if attribute.inverse:
        return rows.where(F.col("o_kind") != "lit").select(F.col("o").alias("s"), terms.term(F.col("s_kind"), F.col("s")).alias("value")).distinct()
    return rows.select("s", o_term().alias("value")).distinct()


def rule_test(source, profile: Profile, rules: Sequence[Rule], value: Column, row: DataFrame, seen: frozenset[str] = frozenset()) -> tuple[DataFrame, Column]:
    """(rows with the flags that the rules need, whether a value meets all rules).

    Membership in a class, scheme or collection is a left join against its members, once each; the rest is an expression.
    An `or` is a true disjunction.
    """
    tests = []
    for r in rules:
        row, test = _test(source, profile, r, value, row, seen)
        tests.append(test)
    return row, reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _flag(row: DataFrame, members: DataFrame, value: Column) -> tuple[DataFrame, Column]:
    name = f"_flag{len(row.columns)}"
    members = members.select(F.col(members.columns[0]).alias(name)).distinct()
    on = (value["value"] == F.col(name)) & (value["kind"] != "lit")
    return row.join(members, on, "left"), F.col(name).isNotNull()


def _test(source, profile: Profile, r: Rule, value: Column, row: DataFrame, seen: frozenset[str]) -> tuple[DataFrame, Column]:
    if r.name in ("range", "and"):
        return rule_test(source, profile, r.rules, value, row, seen)
    if r.name == "or":
        tests = []
        for x in r.rules:
            row, t = _test(source, profile, x, value, row, seen)
            tests.append(t)
        return row, reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    if r.name == "not":
        row, t = rule_test(source, profile, r.rules, value, row, seen)
        return row, ~t
    if r.name == "datatype":
        if r.value == terms.RDFS + "Literal":
            return row, value["kind"] == "lit"
        if r.value == terms.RDFS + "Resource":
            return row, value["kind"] != "lit"
        return row, (value["kind"] == "lit") & (value["dt"] == r.value)
    if r.name == "literalValue":
        return row, (value["kind"] == "lit") & (value["value"] == str(r.value))
    if r.name == "resourceReference":
        return row, (value["kind"] == "iri") & (value["value"] == r.value)
    if r.name == "languageIn":
        return row, value["lang"].isin(*r.value)
    if r.name == "classId":
        if r.value in seen:  # a cycle conforms
            return row, F.lit(True)
        return _flag(row, find_all(source, profile, r.value), value)
    if r.name == "rdfType":
        return _flag(row, source.scan([RDF_TYPE]).where(F.col("o") == r.value).select("s"), value)
    if r.name == "inScheme":
        return _flag(row, source.scan([SKOS + "inScheme"]).where(F.col("o") == r.value).select("s"), value)
    if r.name == "memberOf":
        return _flag(row, source.scan([SKOS + "member"]).where(F.col("s") == r.value).select("o"), value)
    if r.name == "propertyPath":
        return _flag(row, source.scan([r.value]).select("s"), value)
    return row, F.lit(True)  # embeddedClassId, subClassOf, cardinalities and the like conform for a single value


def values(source, profile: Profile, type_id: str, names: Sequence[str] | None = None, instances: DataFrame | None = None) -> DataFrame:
    """(s, attribute, value) of instances of a type, only values that meet every rule of their attribute's range."""
    source = as_source(source)
    instances = instances if instances is not None else find_all(source, profile, type_id)
    parts = []
    for name, a in profile.attributes(type_id).items():
        if names is not None and name not in names:
            continue
        rows = raw_values(source, a).join(instances.select("s"), "s", "left_semi")
        rows, fine = rule_test(source, profile, a.range, F.col("value"), rows)
        parts.append(rows.where(fine).select("s", F.lit(name).alias("attribute"), "value"))
    return reduce(DataFrame.unionByName, parts)


def typed_values(found: DataFrame, source, profile: Profile) -> DataFrame:
    """values() with `type`: the type of a resource value, by its exact most specific match, else null."""
    sets = type_sets(source)
    known = profile.type_ids()
    tests = [F.array_except(F.array(*[F.lit(c) for c in profile.rdf_types(t)]), "types") for t in known]
    kept = F.array_compact(F.array(*[F.when((F.size(x) == 0) & F.lit(bool(profile.rdf_types(t))), F.lit(t)) for x, t in zip(tests, known)]))
    order = F.create_map(*[x for t in known for x in (F.lit(t), F.array(*[F.lit(u) for u in profile.supers(t)[1:]]).cast("array<string>"))])
    leaves = F.filter("fit", lambda t: ~F.exists("fit", lambda u: F.array_contains(order[u], t)))
    typed = sets.select(F.col("s").alias("_s"), kept.alias("fit")).select("_s", leaves.alias("leaves"))
    tie = F.raise_error(F.concat(F.lit("several types fit "), F.col("_s"))).cast("string")
    typed = typed.select("_s", F.when(F.size("leaves") > 1, tie).otherwise(F.get("leaves", F.lit(0))).alias("type"))
    return found.join(typed, (F.col("value.value") == F.col("_s")) & (F.col("value.kind") != "lit"), "left").drop("_s")


def as_map(found: DataFrame) -> DataFrame:
    """(s, attributes): a map from attribute to the array of its values."""
    lists = found.groupBy("s", "attribute").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return lists.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "values")))).alias("attributes"))


# Filters. Rows are (s, attribute, value) with an optional depth; a filter holds where start <= depth < end.


def _active(df: DataFrame, start: int, end: int | None) -> Column:
    depth = F.col("depth") if "depth" in df.columns else F.lit(0)
    return (depth >= start) & ((depth < end) if end is not None else F.lit(True))


def filter_values(df: DataFrame, attribute: str, text: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Values of an attribute whose lexical form or IRI is the text; other attributes stay."""
    return df.where(~_active(df, start, end) | (F.col("attribute") != attribute) | (F.col("value.value") == text))


def filter_by_child(df: DataFrame, attribute: str, children: DataFrame, child: str, text: str, start: int = 0, end: int | None = None) -> DataFrame:
    """References of an attribute whose child attribute (of the rows `children`) holds the text."""
    have = children.where((F.col("attribute") == child) & (F.col("value.value") == text)).select(F.col("s").alias("_s")).distinct()
    out = df.join(have, F.col("value.value") == F.col("_s"), "left")
    return out.where(~_active(df, start, end) | (F.col("attribute") != attribute) | F.col("_s").isNotNull()).drop("_s")


def include_attributes(df: DataFrame, names: Sequence[str], start: int = 0, end: int | None = None) -> DataFrame:
    """References of other attributes become stubs: column stub is true."""
    return df.withColumn("stub", _active(df, start, end) & (F.col("value.kind") != "lit") & ~F.col("attribute").isin(*names))


def only_literals(df: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    return df.where(~_active(df, start, end) | (F.col("value.kind") == "lit"))


def ignore_attributes(df: DataFrame, names: Sequence[str], start: int = 0, end: int | None = None) -> DataFrame:
    return df.where(~_active(df, start, end) | ~F.col("attribute").isin(*names))


def illegal_attributes(df: DataFrame, names: Sequence[str], start: int = 0, end: int | None = None) -> DataFrame:
    """Raises where one of the attributes has a value."""
    bad = _active(df, start, end) & F.col("attribute").isin(*names)
    return df.where(F.when(bad, F.raise_error(F.concat(F.lit("illegal attribute "), F.col("attribute"))).cast("boolean")).otherwise(True))


def include_types(df: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """No attributes at these depths: only the types of resources stay."""
    return df.where(~_active(df, start, end))


def latest_date(df: DataFrame, date: DataFrame, attribute: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """Of each (s, attribute) the value with the latest date (date: s, date; none sorts lowest; ties by least IRI).

    With an attribute only its values are thinned, else those of every attribute at the depths.
    """
    dated = df.join(date.groupBy(F.col("s").alias("_s")).agg(F.max("date").alias("_date")), F.col("value.value") == F.col("_s"), "left")
    order = Window.partitionBy("s", "attribute").orderBy(F.col("_date").desc_nulls_last(), F.col("value.value"))
    hit = _active(df, start, end) & ((F.col("attribute") == attribute) if attribute else F.lit(True))
    return dated.withColumn("_n", F.row_number().over(order)).where(~hit | (F.col("_n") == 1)).drop("_s", "_date", "_n")


def from_params(params: Mapping[str, str | Sequence[str]]) -> list:
    """Filters of request parameters: filter.<attribute>=value (all must hold) and include=a,b."""
    out = []
    for k, v in params.items():
        if k.startswith("filter."):
            out += [lambda df, a=k[7:], x=x: filter_values(df, a, x) for x in ([v] if isinstance(v, str) else v)]
        elif k == "include":
            names = v.split(",") if isinstance(v, str) else list(v)
            out.append(lambda df, n=names: include_attributes(df, n))
        else:
            raise ValueError(f"unknown parameter {k}")
    return out


# Snippets and paths


def snippet_variables(snippet: str) -> tuple[list[str], list[str]]:
    """(inputs $x, outputs ?x) of a SPARQL fragment, in order; what stands in texts, IRIs and comments is none."""
    names = [t for kind, t in tokens(snippet) if kind == "var"]
    return tuple(list(dict.fromkeys(n[1:] for n in names if n[0] == sign)) for sign in "$?")


def snippet_values(source, profile: Profile, snippet: str, resources: DataFrame, prefixes=None, parameters: Mapping[str, Node] | None = None) -> DataFrame:
    """(in, out, types, type): a SPARQL fragment for all resources (column s, bound to $in) at once; parameters bind other inputs.

    One row for each input and output, an output's classes in one array; type is the type of the profile whose classes are
    exactly those, null where none or more than one is. Inputs without a value, and a fragment without ?out, are an error.
    """
    inputs, outputs = snippet_variables(snippet)
    parameters = parameters or {}
    if missing := [n for n in inputs if n != "in" and n not in parameters]:
        raise ProfileError(f"no value for {missing}")
    if "out" not in outputs:
        raise ProfileError("a snippet gives ?out")
    text = " ".join("?" + t[1:] if kind == "var" else t for kind, t in tokens(snippet))
    bound = resources.select(terms.iri(F.col("s")).alias("in"), *[constant(v).alias(n) for n, v in parameters.items() if n in inputs])
    rows = compiler.select(source, "SELECT ?in ?out WHERE { " + text + " }", prefixes, bound).distinct()
    sets = type_sets(source).withColumnRenamed("s", "_s")
    out = rows.join(sets, F.col("out.value") == F.col("_s"), "left")
    types = F.coalesce("types", F.array().cast("array<string>"))
    exact = F.array_compact(F.array(*[F.when((F.size(types) == len(profile.rdf_types(t))) & (F.size(F.array_except(types, F.array(*[F.lit(c) for c in profile.rdf_types(t)]).cast("array<string>"))) == 0), F.lit(t)) for t in profile.type_ids() if profile.rdf_types(t)]))
    return out.select(F.col("in.value").alias("in"), F.col("out.value").alias("out"), types.alias("types"), F.when(F.size(exact) == 1, F.get(exact, F.lit(0))).alias("type"))


def load_paths(source, profile: Profile, type_id: str, roots: DataFrame, attributes: Sequence[str] = (), paths: Sequence[str] = ()) -> DataFrame:
    """The quads of roots' attributes, and of resources reached along dotted paths; each step must lead to a class of the profile."""
    source, parts = as_source(source), []

    def triples(a: Attribute, at: DataFrame) -> DataFrame:
        rows = source.scan([a.uri])
        return rows.join(at.select(F.col("s").alias("_at")).distinct(), F.col("o" if a.inverse else "s") == F.col("_at"), "left_semi")

    def typing(at: DataFrame) -> DataFrame:
        return source.scan([RDF_TYPE]).join(at.select(F.col("s").alias("_at")).distinct(), F.col("s") == F.col("_at"), "left_semi")

    parts += [typing(roots), *[triples(profile.attributes(type_id)[a], roots) for a in attributes]]
    for path in paths:
        at, here = roots.select("s"), type_id
        steps = path.split(".")
        for i, step in enumerate(steps):
            a = profile.attributes(here).get(step)
            if a is None:
                raise ValueError(f"{here} has no attribute {step}")
            rows = triples(a, at)
            parts.append(rows)
            targets = [x.value for x in a.range if x.name == "classId"]
            at = rows.select((F.col("s") if a.inverse else F.col("o")).alias("s"))
            if i + 1 < len(steps):
                if len(targets) != 1:
                    raise ValueError(f"{here}.{step} leads to no single class")
                here = targets[0]
            if targets:
                parts.append(typing(at))
    return set_of(reduce(DataFrame.unionByName, parts))


def graph_of(source, ignore_suffix: str = "/temp") -> DataFrame:
    """(s, g, n_graphs): the graph in which a resource has a property beside its type; the least name of several."""
    rows = as_source(source).scan(None).where(F.col("g").isNotNull() & (F.col("p") != RDF_TYPE) & ~F.col("g").endswith(ignore_suffix))
    return rows.groupBy("s").agg(F.min("g").alias("g"), F.count_distinct("g").alias("n_graphs"))
