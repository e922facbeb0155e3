"""Editing typed resources as tables: detached resources, coercion of values, pairs of old and new, saves with callbacks, and
views over many graphs.

A detached resource is a row (s, type, attributes): attributes is a map from an attribute's id to the array of its terms.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import RDF_TYPE, RDFS, STRING
from graphloom.operators import access
from graphloom.operators.profile import Attribute, Profile
from graphloom.sources.quads import as_source

TERM = "struct<kind:string,value:string,dt:string,lang:string>"
VALUES = f"map<string,array<{TERM}>>"


class ConversionError(ValueError):
    """A value that an attribute can't take."""


def coerce(attribute: Attribute, value: Column, kind: str) -> Column:
    """A column of terms as it is; a column of strings as literals, if the attribute's range is xsd:string or rdfs:Literal.

    kind: the column's type. Anything else raises when the plan is made, not when it runs.
    """
    if kind.startswith("struct<") and {"kind", "value", "dt", "lang"} <= {f.split(":")[0] for f in kind[7:-1].split(",")}:
        return value.cast(TERM)
    if kind == "string" and [r.value for r in attribute.range if r.name == "datatype"][:1] in ([STRING], [RDFS + "Literal"]):
        return F.when(value.isNotNull(), terms.literal(value, dt=STRING).cast(TERM))
    raise ConversionError(f"attribute {attribute.id} takes no {kind}")


def empty(ids: DataFrame, type_id: str) -> DataFrame:
    """Detached resources without values (ids has s)."""
    return ids.select("s", F.lit(type_id).alias("type"), F.create_map().cast(VALUES).alias("attributes"))


def detach(source, profile: Profile, type_id: str, ids: DataFrame | None = None, keep: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """Detached copies of a type's instances, with the attributes whose id keep() takes; every one is a key, values or not."""
    source = as_source(source)
    ids = (ids if ids is not None else access.find_all(source, profile, type_id)).select("s").distinct()
    names = [n for n in profile.attributes(type_id) if keep(n)]
    none = F.create_map(*[x for n in names for x in (F.lit(n), F.array().cast(f"array<{TERM}>"))]).cast(VALUES) if names else F.create_map().cast(VALUES)
    if not names:
        return empty(ids, type_id)
    found = access.as_map(access.values(source, profile, type_id, names, ids))
    rows = ids.join(found, "s", "left")
    have = F.coalesce(F.col("attributes").cast(VALUES), F.create_map().cast(VALUES))
    full = F.map_zip_with(none, have, lambda _, a, b: F.coalesce(b, a))
    return rows.select("s", F.lit(type_id).alias("type"), full.alias("attributes"))


def _of(resources: DataFrame, profile: Profile, type_id: str, name: str, value: Column, kind: str) -> tuple[Column, Column]:
    attributes = profile.attributes(type_id)
    if name not in attributes:
        raise ConversionError(f"{type_id} has no attribute {name}")
    now = F.coalesce(F.try_element_at("attributes", F.lit(name)), F.array().cast(f"array<{TERM}>"))
    return now, coerce(attributes[name], value, kind)


def _put(resources: DataFrame, name: str, values: Column) -> DataFrame:
    rest = F.map_filter("attributes", lambda k, _: k != name)
    return resources.withColumn("attributes", F.map_concat(rest, F.create_map(F.lit(name), values)))


def set_values(resources: DataFrame, profile: Profile, type_id: str, name: str, column: str) -> DataFrame:
    """The attribute's values become those of an array column of resources."""
    kind = resources.schema[column].dataType.elementType.simpleString()
    attributes = profile.attributes(type_id)
    if name not in attributes:
        raise ConversionError(f"{type_id} has no attribute {name}")
    return _put(resources, name, F.array_compact(F.transform(column, lambda x: coerce(attributes[name], x, kind))))


def add_value(resources: DataFrame, profile: Profile, type_id: str, name: str, column: str) -> DataFrame:
    """A column's value more, repeated or not; null adds none."""
    now, value = _of(resources, profile, type_id, name, F.col(column), resources.schema[column].dataType.simpleString())
    return _put(resources, name, F.when(value.isNull(), now).otherwise(F.concat(now, F.array(value))))


def remove_value(resources: DataFrame, profile: Profile, type_id: str, name: str, column: str) -> DataFrame:
    """Every value that equals the column's goes."""
    now, value = _of(resources, profile, type_id, name, F.col(column), resources.schema[column].dataType.simpleString())
    return _put(resources, name, F.filter(now, lambda x: ~x.eqNullSafe(value)))


def clear_values(resources: DataFrame, name: str) -> DataFrame:
    return resources.withColumn("attributes", F.map_filter("attributes", lambda k, _: k != name))


def pair(new: DataFrame, old: DataFrame) -> DataFrame:
    """(s, type, new, old): each new resource with what is stored; an empty one where nothing is."""
    before = old.select("s", F.col("attributes").alias("old"))
    rows = new.select("s", "type", F.col("attributes").alias("new")).join(before, "s", "left")
    return rows.withColumn("old", F.coalesce("old", F.create_map().cast(VALUES)))


def changes(pairs: DataFrame, profile: Profile, type_id: str, graph: str | None = None) -> DataFrame:
    """(action, quad...) of pairs: what the new resources have and the old lack, and the other way round.

    Only attributes that the new one names count. Types are added where the old one is empty.
    """
    parts = []
    lit = F.lit
    for name, a in profile.attributes(type_id).items():
        new, old = (F.array_distinct(F.coalesce(F.try_element_at(c, lit(name)), F.array().cast(f"array<{TERM}>"))) for c in ("new", "old"))
        given = pairs.where(F.array_contains(F.map_keys("new"), name))
        for action, values in (("add", F.array_except(new, old)), ("remove", F.array_except(old, new))):
            rows = given.select("s", F.explode(values).alias("x"))
            s, sk, o, ok = F.col("s"), lit("iri"), F.col("x.value"), F.col("x.kind")
            s, sk, o, ok = (o, ok, s, sk) if a.inverse else (s, sk, o, ok)
            dt, lang = (lit(""), lit("")) if a.inverse else (F.col("x.dt"), F.col("x.lang"))
            parts.append(rows.select(lit(action).alias("action"), lit(graph).cast("string").alias("g"), s.alias("s"), sk.alias("s_kind"), lit(a.uri).alias("p"), o.alias("o"), ok.alias("o_kind"), dt.alias("o_dt"), lang.alias("o_lang")))
    fresh = pairs.where(F.size("old") == 0)
    for t in profile.rdf_types(type_id):
        parts.append(fresh.select(lit("add").alias("action"), lit(graph).cast("string").alias("g"), "s", lit("iri").alias("s_kind"), lit(RDF_TYPE).alias("p"), lit(t).alias("o"), lit("iri").alias("o_kind"), lit("").alias("o_dt"), lit("").alias("o_lang")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save(store, delta: DataFrame, after: Sequence[Callable[[object, DataFrame], object]] = ()) -> list:
    """Apply a delta (action, quad...) to a store, then run the callbacks in order with the store and the delta."""
    quad = [c for c in delta.columns if c != "action"]
    store.change(delta.where("action = 'add'").select(*quad), delta.where("action = 'remove'").select(*quad))
    return [f(store, delta) for f in after]


class GraphView:
    """A source of one graph, or of a resource's own graph where a routing table (s, g) says that it lives in another.

    One join with the routing table for all resources: a quad counts if it is in the graph of its subject.
    """

    def __init__(self, source, graph: str | None, routes: DataFrame | None = None):
        self.source, self.graph, self.routes = as_source(source), graph, routes

    def scan(self, predicates: Sequence[str] | None = None) -> DataFrame:
        rows = self.source.scan(predicates)
        if self.routes is None:
            return rows.where(F.col("g").eqNullSafe(F.lit(self.graph)))
        routes = self.routes.select(F.col("s").alias("_s"), F.col("g").alias("_g")).distinct()
        routed = rows.join(routes, F.col("s") == F.col("_s"), "left")
        return routed.where(F.col("g").eqNullSafe(F.coalesce("_g", F.lit(self.graph)))).drop("_s", "_g")


# Parameters of requests


class Validator:
    """What a parameter's value must be: one of values, equal to value, and matched as a whole by all patterns."""

    def __init__(self, values: Sequence[str] | None = None, value: str | None = None, patterns: Sequence[str] = ()):
        import re

        self.values, self.value, self.patterns = values, value, [re.compile(p) for p in patterns]

    def accepts(self, given: object) -> bool:
        """Null is fine; of a list every item must be."""
        if given is None:
            return True
        if isinstance(given, list | tuple):
            return all(self.accepts(x) for x in given)
        x = str(given)
        return (self.values is None or x in self.values) and (self.value is None or x == self.value) and all(p.fullmatch(x) for p in self.patterns)


def request_parameters(allowed: Mapping[str, Validator | None], *given: Mapping[str, object]) -> dict[str, object]:
    """Parameters of all maps, later ones first; a name that isn't allowed or a value that its validator refuses is an error.

    Validators are looked up by the parameter's own name, so every one is held to its rule. Names without a value are "".
    """
    merged: dict[str, object] = {}
    for m in given:
        merged |= m
    if bad := sorted(set(merged) - set(allowed)):
        raise ValueError(f"parameters that aren't allowed: {bad}")
    for name, value in merged.items():
        if (v := allowed[name]) is not None and not v.accepts(value):
            raise ValueError(f"parameter {name} can't be {value!r}")
    return {name: "" if merged.get(name) is None else merged[name] for name in allowed}


# Typed JSON


def from_typed_json(documents: DataFrame, profile: Profile, column: str = "json") -> DataFrame:
    """Detached resources (s, type, attributes) of JSON documents, one for each IRI however often it is in them.

    An attribute that a document names is a key, with an empty array where its object is empty; others aren't there. Values of
    inverse attributes are those that point to the resource. Resources whose type the profile lacks are an error.
    """
    from graphloom.operators.documents import from_json
    from graphloom.operators.profile import doc_profile
    from graphloom.sources.shared import cut

    known = set(profile.type_ids())

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                data = json.loads(text)
                for x in [data["data"], *data.get("included", [])]:
                    types = x["type"] if isinstance(x["type"], list) else [x["type"]]
                    if bad := [t for t in types if t not in known]:
                        raise ConversionError(f"no type {bad[0]}")
                    out += [(x["uri"], t, list(x.get("attributes", {}))) for t in types]
            s, t, names = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(t, pa.string()), pa.array(names, pa.list_(pa.string()))], names=["s", "type", "names"])

    texts = documents.select(F.col(column).alias("json"))
    named = texts.mapInArrow(run, "s string, type string, names array<string>").groupBy("s", "type").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    named, quads, out = cut(named), cut(from_json(texts, doc_profile(profile))), None
    for t in sorted(known):
        of = named.where(F.col("type") == t)
        rows = detach(quads, profile, t, of).join(of.select("s", "names"), "s")
        rows = rows.select("s", "type", F.map_filter("attributes", lambda k, _: F.array_contains("names", k)).alias("attributes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def cached_json(spark, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Rows of JSON files: make() is computed and written once, whole; later calls, of other sessions too, read the files."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").json(path)
    return spark.read.json(path)
