"""Graphs to documents and back, facets, and document differences.

Inside, a document is rows (doc, uri, level, type, attribute, datatype, lang, value, single): nesting is by reference, so
a document is a root and its included resources. JSON text is made at the edge only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.jsondiff import ConversionError, diff, json_reader
from graphloom.functions.terms import LANG_STRING, RDF_TYPE, XSD
from graphloom.operators.access import type_sets
from graphloom.operators.profile import DocProfile
from graphloom.sources.shared import ROWS_A_TASK, cut, tasks_of
from graphloom.plans import compiler
from graphloom.plans.sparql import parse_query
from graphloom.sources.quads import COLUMNS, SCHEMA, as_source, difference, set_of

ROW = "doc string, uri string, level int, type string, attribute string, datatype string, lang string, value string, single boolean"


def match_types(source, profile: DocProfile, mode: str = "profile", tasks: int | None = None) -> DataFrame:
    """(s, type): all: the classes equal a type's; profile: the most specific type whose classes are all there, a tie raises;
    root: the one type with a class in common that has no subtype there."""
    sets = type_sets(source, tasks)
    level = profile.levels()
    known = [t for t in sorted(profile.types, key=lambda t: (level[t], t)) if profile.types[t].rdf_types]
    if not known:
        return sets.limit(0).select("s", F.lit("").alias("type"))
    wanted = {t: F.array(*[F.lit(c) for c in sorted(profile.types[t].rdf_types)]) for t in known}
    fit = {t: (F.col("types") == wanted[t]) if mode == "all" else F.size(F.array_except(wanted[t], "types")) == 0 for t in known}
    kept = sets.withColumn("fit", F.array_compact(F.array(*[F.when(fit[t], F.struct(F.lit(len(profile.types[t].rdf_types)).alias("n"), F.lit(-level[t]).alias("l"), F.lit(t).alias("t"))) for t in known])))
    best = F.array_max("fit")
    ties = F.size(F.filter("fit", lambda x: (x["n"] == best["n"]) & (x["l"] == best["l"])))
    bad = F.raise_error(F.concat(F.lit("several types fit "), F.col("s"))).cast("string")
    return kept.where(F.size("fit") > 0).select("s", F.when(ties > 1, bad).otherwise(best["t"]).alias("type"))


def attribute_rows(source, profile: DocProfile, tasks: int | None = None) -> DataFrame:
    """(type, attribute, single, kind, s, value) of all attributes, inverse ones swapped: one scan a predicate. With a number of tasks,
    rows are dealt out to them by s and type before any are held."""
    source, parts = as_source(source), []
    by_uri: dict[tuple[str, bool], list] = {}
    for t in profile.types.values():
        for a in t.attributes.values():
            by_uri.setdefault((a.uri, a.inverse), []).append((t.id, a))
    for (uri, inverse), uses in by_uri.items():
        rows = source.scan([uri])
        if inverse:
            rows = rows.where(F.col("o_kind") != "lit").select(F.col("o").alias("s"), terms.term(F.col("s_kind"), F.col("s")).alias("value"))
        else:
            rows = rows.select("s", terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")).alias("value"))
        use = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(a.id).alias("attribute"), F.lit(a.single).alias("single"), F.lit(a.kind).alias("kind")) for t, a in uses]))
        parts.append((rows if tasks else rows.distinct()).withColumn("use", use).select("use.*", "s", "value"))
    out = reduce(DataFrame.unionByName, parts)
    return out.repartition(tasks, "s", "type").distinct() if tasks else out


def to_rows(source, profile: DocProfile, roots: DataFrame, mode: str = "profile", max_depth: int = 1000) -> DataFrame:
    """Document rows of all roots (column s) at once: one join a level of reference until no resource is new to its document.

    Each level reads the types and facts of the resources that it meets, no others. Deeper nesting than max_depth, a missing root, a blank node as value, and several values of a single attribute (but of different languages) raise.
    """
    source = as_source(source)
    read = tasks_of(source.scan([RDF_TYPE, *{a.uri for t in profile.types.values() for a in t.attributes.values()}]).count())
    all_types, all_facts = match_types(source, profile, mode, read), attribute_rows(source, profile, read)

    def fetch(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Types and facts of the wanted resources (each once) alone. No semi-join: that would be pushed below what deals rows out."""
        t = cut(all_types.join(wanted.repartition(read, "s").hint("merge"), "s"))
        return t, cut(all_facts.join(t.repartition(read, "s", "type").hint("merge"), ["s", "type"]))

    seen = frontier = cut(roots.select(F.col("s").alias("doc"), "s", F.lit(0).alias("level")).distinct())
    types, facts = fetch(seen.select("s").distinct())
    missing = roots.select("s").join(types, "s", "left_anti").limit(3).collect()
    if missing:
        raise ConversionError(f"no instance of a type: {[r['s'] for r in missing]}")
    depth = 0
    while True:
        depth += 1
        links = facts.where((F.col("value.kind") == "iri") & (F.col("kind") != "datatype")).select("s", F.col("value.value").alias("to"))
        tasks = tasks_of(max(facts.count(), seen.count()))
        refs = _meet(frontier, links, tasks).select("doc", F.col("to").alias("s")).repartition(tasks, "doc", "s").distinct()
        known = seen.select("doc", "s", F.lit(True).alias("_known")).repartition(tasks, "doc", "s").hint("merge")
        step = cut(refs.join(known, ["doc", "s"], "left").where("_known is null").drop("_known"))
        if not step.limit(1).count():
            break
        t, f = fetch(step.select("s").distinct().join(types, "s", "left_anti"))
        types, facts = types.unionByName(t), facts.unionByName(f)
        frontier = cut(step.join(types.select("s").distinct(), "s", "left_semi").withColumn("level", F.lit(depth)).select("doc", "s", "level"))
        if not frontier.limit(1).count():
            break
        if depth >= max_depth:
            raise ConversionError(f"documents are nested more than {max_depth} levels deep")
        seen = cut(seen.unionByName(frontier))
    value = F.col("value")
    blank = F.raise_error(F.concat(F.lit("a blank node is the value of "), F.col("attribute"))).cast("string")
    told = tasks_of(facts.count())
    typed = types.select(F.col("s").alias("_t")).withColumn("typed", F.lit(True)).repartition(told, "_t").hint("merge")
    # what is no reference has a key of its own: a value of many resources doesn't come to one task
    key = F.when((value["kind"] == "iri") & (F.col("kind") != "datatype"), value["value"]).otherwise(F.concat(F.lit("\0"), F.xxhash64("s", "attribute", "value").cast("string")))
    rows = facts.drop("type").withColumn("_t", key).repartition(told, "_t").join(typed, "_t", "left").repartition(told, "s")
    reference = (value["kind"] == "iri") & (F.col("kind") != "datatype") & F.col("typed").isNotNull()
    datatype = F.when(value["kind"] == "bnode", blank).when(reference, F.lit("reference")).when(value["kind"] == "iri", F.lit(terms.RDFS + "Resource")).otherwise(value["dt"])
    rows = rows.select("s", "attribute", datatype.alias("datatype"), value["lang"].alias("lang"), value["value"].alias("value"), "single")
    from pyspark.sql import Window

    per = Window.partitionBy("s", "attribute")
    many = F.col("single") & (F.count("value").over(per) > 1) & (F.size(F.collect_set(F.when(F.col("lang") != "", F.col("lang"))).over(per)) < F.count("value").over(per))
    error = F.raise_error(F.concat(F.lit("several values of the single attribute "), F.col("attribute"), F.lit(" of "), F.col("s"))).cast("string")
    rows = rows.withColumn("value", F.when(many, error).otherwise(F.col("value")))
    rows = _meet(seen, types.repartition(told, "s").join(rows.hint("merge"), "s", "left"), max(told, tasks_of(seen.count())))
    return rows.select("doc", F.col("s").alias("uri"), "level", "type", "attribute", "datatype", "lang", "value", "single")


def _meet(docs: DataFrame, facts: DataFrame, tasks: int) -> DataFrame:
    """docs (doc, s, level) with the facts of their resources, dealt out by resource; one of very many documents has several tasks."""
    hot = docs.where("doc != s").groupBy("s").agg(F.ceil(F.count("*") / ROWS_A_TASK).cast("int").alias("_n")).where("_n > 1")
    n = F.coalesce("_n", F.lit(1))
    docs = docs.join(F.broadcast(hot), "s", "left").withColumn("_part", F.pmod(F.xxhash64("doc"), n).cast("int")).drop("_n")
    facts = facts.join(F.broadcast(hot), "s", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    return docs.repartition(tasks, "s", "_part").join(facts.repartition(tasks, "s", "_part").hint("merge"), ["s", "_part"]).drop("_part")


def uncovered(source, profile: DocProfile) -> DataFrame:
    """Triples that no attribute of their subject's type covers, beside its types: the conversion report."""
    source = as_source(source)
    quads, types = source.scan(None), cut(match_types(source, profile)).select(F.col("s").alias("_s"), "type")
    pairs = [(t.id, a.uri, a.inverse) for t in profile.types.values() for a in t.attributes.values()]
    spec = quads.sparkSession.createDataFrame(pairs, "type string, p string, inverse boolean")
    at = lambda c, inverse: quads.join(types, F.col(c) == F.col("_s")).select(*COLUMNS, "type").join(F.broadcast(spec.where(F.col("inverse") == inverse)), ["type", "p"], "left_semi").select(*COLUMNS)
    typing = quads.where(F.col("p") == RDF_TYPE).join(types, F.col("s") == F.col("_s"), "left_semi").select(*COLUMNS)
    covered = at("s", False).unionByName(at("o", True)).unionByName(typing)
    return difference(quads, covered)


def clean(source, profile: DocProfile) -> DataFrame:
    """The quads that a round trip through documents keeps."""
    quads = as_source(source).scan(None)
    return difference(quads, uncovered(source, profile))


NUMBERS = {XSD + x: "long" for x in ("int", "integer", "long")} | {XSD + x: "double" for x in ("float", "double")}


def json_key(dt: str, prefixes: Mapping[str, str]) -> str:
    for k, v in prefixes.items():
        if dt.startswith(v):
            return f"{k}:{dt[len(v) :]}"
    return dt


def _quoted(c: Column) -> Column:
    """A JSON string of a column."""
    return F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def merge_prefixes(first: Mapping[str, str], second: Mapping[str, str]) -> dict[str, str]:
    """first, and of second the namespaces that first lacks; a key that first has gets the least number that makes it new."""
    out, known = dict(first), set(first.values())
    for key, iri in second.items():
        if iri in known:
            continue
        n = 0
        while key in first and f"{key}{n}" in first:
            n += 1
        name = f"{key}{n}" if key in first else key
        if name in out and out[name] != iri:
            raise ValueError(f"two namespaces are {name}")
        out[name] = iri
    return out


def to_json(rows: DataFrame, prefixes: Mapping[str, str] = terms.PREFIXES, normalise_dates: bool = False, context: Mapping[str, str] | None = None) -> DataFrame:
    """(doc, json): {"data": ..., "included": [...]} of document rows; with a context (merge_prefixes()) that stands first.

    Attributes are objects from datatype to a value (single) or an array; references under "references"; texts with a
    language under rdf:langString, by language. Integers, floats and booleans are JSON values, but for xsd:integer in arrays:
    those are texts under the datatype's full IRI, as the format has it. An invalid date raises.
    normalise_dates gives dateTimes in UTC instead of their lexical form.
    """
    dt, v = F.col("datatype"), F.col("value")
    listed = (dt == XSD + "integer") & ~F.col("single")
    key = F.when(dt == "reference", "references").when(listed, dt)
    for p, iri in prefixes.items():
        key = key.when(dt.startswith(iri), F.concat(F.lit(p + ":"), F.substr(dt, F.lit(len(iri) + 1))))
    key = key.otherwise(dt)
    date = F.when(F.try_to_date(v, "yyyy-MM-dd").isNotNull() & v.rlike(r"^\d{4}-\d\d-\d\d$"), v).otherwise(F.raise_error(F.concat(F.lit("not a date: "), v)).cast("string"))
    stamp = F.coalesce(v.try_cast("timestamp"), F.raise_error(F.concat(F.lit("not a dateTime: "), v)).cast("timestamp"))
    moment = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if normalise_dates else F.when(stamp.isNotNull(), v)
    text = (
        F.when(listed, _quoted(v)).when(dt.isin(*[k for k, x in NUMBERS.items() if x == "long"]), v.try_cast("decimal(38,0)").cast("string"))
        .when(dt.isin(*[k for k, x in NUMBERS.items() if x == "double"]), v.try_cast("double").cast("string"))
        .when(dt == XSD + "boolean", F.when(v.isin("true", "1"), "true").otherwise("false"))
        .when(dt == XSD + "date", _quoted(date)).when(dt == XSD + "dateTime", _quoted(moment)).otherwise(_quoted(v))
    )
    named = rows.withColumn("_key", key).withColumn("_text", text).where(F.col("attribute").isNotNull())
    array = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    object_ = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(c), ","), F.lit("}"))
    place = ["doc", "uri", "level", "type"]
    one = named.groupBy(*place, "attribute", "single", "_key", "lang").agg(F.array_sort(F.collect_list("_text")).alias("xs"))
    one = one.withColumn("t", F.when(F.col("single"), F.get("xs", F.lit(0))).otherwise(array("xs")))
    by_key = one.groupBy(*place, "attribute", "_key").agg(
        F.max("lang").alias("lang"), F.max("t").alias("t"), object_(F.collect_list(F.concat(_quoted(F.col("lang")), F.lit(":"), F.col("t")))).alias("by_lang")
    )
    item = F.concat(_quoted(F.col("_key")), F.lit(":"), F.when(F.col("lang") != "", F.col("by_lang")).otherwise(F.col("t")))
    attributes = by_key.groupBy(*place, "attribute").agg(object_(F.collect_list(item)).alias("a"))
    attributes = attributes.groupBy(*place).agg(object_(F.collect_list(F.concat(_quoted(F.col("attribute")), F.lit(":"), F.col("a")))).alias("a"))
    resources = rows.select(*place).distinct().join(attributes, place, "left")
    text = F.concat(F.lit('{"uri":'), _quoted(F.col("uri")), F.lit(',"type":'), _quoted(F.col("type")), F.lit(',"attributes":'), F.coalesce("a", F.lit("{}")), F.lit("}"))
    parts = resources.select("doc", "level", "uri", text.alias("text")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("level", "uri", "text"))).alias("r"))
    included = F.transform(F.filter("r", lambda x: x["level"] > 0), lambda x: x["text"])
    start = "" if not context else f'"context":{{"prefix":{json.dumps(dict(context), ensure_ascii=False)}}},'
    return parts.select("doc", F.concat(F.lit("{" + start + '"data":'), F.get("r", F.lit(0))["text"], F.lit(',"included":'), array(included), F.lit("}")).alias("json"))


def from_json(documents: DataFrame, profile: DocProfile, prefixes: Mapping[str, str] = terms.PREFIXES, column: str = "json") -> DataFrame:
    """Quads of documents: nulls and blank texts go, rdfs:Resource gives IRIs, an unknown attribute raises, types are added."""
    types = {t.id: (sorted(t.rdf_types), {a.id: (a.uri, a.inverse) for a in t.attributes.values()}) for t in profile.types.values()}
    rows = json_reader(types, dict(prefixes))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([x for t in pdf["json"] for x in rows(t)], columns=list(COLUMNS))

    return set_of(documents.select(F.col(column).alias("json")).mapInPandas(run, SCHEMA))


# Facets

SUFFIX = re.compile(r"^(.*?)(?:[_-]?(Boolean|Integer|Decimal|String))?(?:[_-]?(List))?$", re.I)


def facet_type(name: str) -> tuple[str, bool]:
    """(kind, whether a list) of a facet's variable name: kind is boolean, integer, decimal or string."""
    m = SUFFIX.match(name)
    return (m[2] or "string").lower(), bool(m[3])


FACET = {"boolean": terms.as_boolean, "integer": terms.as_integer, "decimal": terms.as_decimal, "string": terms.as_string}


def facets(source, queries: Sequence[str], prefixes=None, duplicates: str = "fail", roots: DataFrame | None = None, separator: str = " - ") -> DataFrame:
    """(root, path, kind, is_list, value): rows of facet queries for all roots (bound to ?root) at once.

    All variables but the last two are levels of a path, the one before the last the key, the last the value, whose name
    tells its type. duplicates of a key that is no list: fail, first_sorted, first or concat. Values are texts.
    """
    parts = []
    bound = roots.select(terms.iri(F.col("s")).alias("root")) if roots is not None else None
    for i, text in enumerate(queries):
        q = parse_query(text, prefixes)
        names = [n for _, n in q.select if n != "root"]
        kind, many = facet_type(names[-1])
        rows = compiler.select(source, text, prefixes, bound)
        value = FACET[kind](F.col(f"`{names[-1]}`")).cast("string")
        path = F.concat_ws(".", *[F.col(f"`{n}`")["value"] for n in names[:-1]])
        root = F.col("root.value") if "root" in rows.columns else F.lit("")
        rows = rows.select(root.alias("root"), path.alias("path"), value.alias("value")).where("value is not null")
        if many:
            out = rows.groupBy("root", "path").agg(F.array_sort(F.collect_set("value")).alias("vs")).select("root", "path", F.explode("vs").alias("value"))
        else:
            values = F.array_sort(F.collect_list("value"))
            bad = F.raise_error(F.concat(F.lit("several values of "), F.col("path"))).cast("string")
            pick = {
                "fail": lambda: F.when(F.size("vs") > 1, bad).otherwise(F.get("vs", F.lit(0))), "first_sorted": lambda: F.get("vs", F.lit(0)),
                "first": lambda: F.get("vs", F.lit(0)), "concat": lambda: F.array_join("vs", separator),
            }[duplicates]
            out = rows.groupBy("root", "path").agg(values.alias("vs")).select("root", "path", pick().alias("value"))
        parts.append(out.select("root", "path", F.lit(kind).alias("kind"), F.lit(many).alias("is_list"), "value"))
    return reduce(DataFrame.unionByName, parts)


def facet_json(rows: DataFrame) -> DataFrame:
    """(root, facets): the rows as a JSON object from path to value."""
    text = F.when(F.col("kind") == "string", _quoted(F.col("value"))).otherwise(F.col("value"))
    one = rows.groupBy("root", "path", "is_list").agg(F.array_sort(F.collect_list(text)).alias("xs"))
    one = one.select("root", F.concat(_quoted(F.col("path")), F.lit(":"), F.when(F.col("is_list"), F.concat(F.lit("["), F.array_join("xs", ","), F.lit("]"))).otherwise(F.get("xs", F.lit(0)))).alias("t"))
    return one.groupBy("root").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("t")), ","), F.lit("}")).alias("facets"))


# Differences

DIFFERENCE = "array<struct<path:string,kind:string,old:string,new:string>>"


def json_diff(pairs: DataFrame, a: str = "a", b: str = "b", **options) -> DataFrame:
    """pairs with `differences`, an array of (path, kind, old, new), of two JSON text columns; bad JSON raises."""

    @F.pandas_udf(DIFFERENCE)
    def run(x, y):
        import pandas as pd

        load = lambda t: None if t is None else json.loads(t)
        keys = ("path", "kind", "old", "new")
        return pd.Series([[dict(zip(keys, d)) for d in diff(load(p), load(q), **options)] for p, q in zip(x, y)], dtype=object)

    return pairs.withColumn("differences", run(F.col(a), F.col(b)))


__all__ = ["ConversionError", "attribute_rows", "clean", "diff", "facet_json", "facet_type", "facets", "from_json", "json_diff", "match_types", "to_json", "to_rows", "uncovered"]
