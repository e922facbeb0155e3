"""Rule execution: update chains, constructs, semi-naive fixpoints, ontology rules, and minting of IRIs."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import OWL, RDF, RDF_TYPE, RDFS, SKOS, DCT
from graphloom.plans import compiler
from graphloom.plans.sparql import parse_query
from graphloom.sources.quads import COLUMNS, FrameSource, dataset, difference, set_of, union
from graphloom.sources.shared import cut, tasks_of


def run_updates(quads: DataFrame, rules: Mapping[str, str], parameters: Mapping[str, object] | None = None, prefixes=None, every: int = 4) -> DataFrame:
    """All updates in order of their names, each on the state before; the state is cut every few rules."""
    for i, name in enumerate(sorted(rules)):
        quads = compiler.update(quads, terms.render_template(rules[name], parameters or {}), prefixes)
        if (i + 1) % every == 0:
            quads = cut(quads)
    return quads


def rule_changes(quads: DataFrame, rules: Mapping[str, str], **kw) -> tuple[DataFrame, DataFrame]:
    """(added, removed) of a chain of updates."""
    old = set_of(quads)
    new = run_updates(old, rules, **kw)
    return difference(new, old), difference(old, new)


def convert(quads: DataFrame, constructs: Sequence[str], prefixes=None) -> DataFrame:
    """The union of constructs over the input; their order doesn't matter."""
    return union(*[compiler.construct(quads, c, prefixes) for c in constructs])


def add_constructs(quads: DataFrame, constructs: Sequence[str], prefixes=None) -> DataFrame:
    """Each construct's result joins the graph before the next runs."""
    for c in constructs:  # cut each time: a plan that names the one before it several times grows as a power
        quads = cut(union(quads, compiler.construct(quads, c, prefixes)))
    return quads


def remove_construct(quads: DataFrame, construct: str, prefixes=None) -> DataFrame:
    return difference(quads, compiler.construct(quads, construct, prefixes))


def debug_rule(quads: DataFrame, query: str, prefixes=None) -> list[tuple[int, int]]:
    """(number of elements of WHERE, rows) for each prefix of a query's pattern: where solutions are lost."""
    from graphloom.plans.sparql import Group

    q = parse_query(query, prefixes)
    out = []
    for k in range(1, len(q.where.parts) + 1):
        c = compiler.Compiler(quads, quads.sparkSession)
        out.append((k, c.group(Group(q.where.parts[:k])).df.count()))
    return out


# Fixpoints


def closure(edges: DataFrame, a: str = "a", b: str = "b", reflexive: bool = False) -> DataFrame:
    """Transitive closure of (a, b), cycles allowed: the frontier alone joins the edges in each round."""
    base = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    known = frontier = base
    while True:
        step = frontier.alias("f").join(base.alias("e"), F.col("f.b") == F.col("e.a")).select(F.col("f.a").alias("a"), F.col("e.b").alias("b")).distinct()
        frontier = cut(step.join(known, ["a", "b"], "left_anti"))
        if not frontier.limit(1).count():
            break
        known = cut(known.unionAll(frontier))
    if reflexive:
        nodes = base.select(F.explode(F.array("a", "b")).alias("a")).distinct()
        known = known.unionAll(nodes.select("a", F.col("a").alias("b"))).distinct()
    return known.select(F.col("a").alias(a), F.col("b").alias(b))


def fixpoint(quads: DataFrame, constructs: Sequence[str], prefixes=None, max_rounds: int = 100) -> DataFrame:
    """Constructs until a round adds nothing. All of a round see its first state, so a round is one plan, linear in the rules;
    for rules that only add, the fixpoint is the same in any order."""
    state = cut(set_of(quads))
    n = state.count()
    for _ in range(max_rounds):
        new = cut(union(state, *[compiler.construct(state, c, prefixes) for c in constructs]))
        m = new.count()
        if m == n:
            return new
        state, n = new, m
    raise RuntimeError("no fixpoint")


def _rule(gives: str, where: str, *named: str, apart: tuple[str, str] | None = None) -> str:
    """A construct whose variables in named must not be blank nodes, and whose two in apart must differ."""
    tests = [f"FILTER(!isBlank({v}))" for v in named]
    if apart:
        tests.append(f"FILTER({apart[0]} != {apart[1]})")
    return " ".join(["CONSTRUCT {", gives, "} WHERE {", where, *tests, "}"])


def _expansion() -> dict[str, str]:
    kinds = {"annotation": "owl:AnnotationProperty", "datatype": "owl:DatatypeProperty", "object": "owl:ObjectProperty"}
    out = {
        # what is a class or a property
        "used-is-property": _rule("?p a rdf:Property", "?s ?p ?o"),
        "domain-is-class": _rule("?c a owl:Class", "?p rdfs:domain ?c", "?c"),
        "rdfs-class-is-owl-class": _rule("?c a owl:Class", "?c a rdfs:Class", "?c"),
        "owl-class-is-rdfs-class": _rule("?c a rdfs:Class", "?c a owl:Class", "?c"),
        "sub-and-super-are-classes": _rule("?a a owl:Class , rdfs:Class . ?b a owl:Class , rdfs:Class", "?a rdfs:subClassOf ?b", "?a", "?b"),
        "sub-and-super-are-properties": _rule("?a a rdf:Property . ?b a rdf:Property", "?a rdfs:subPropertyOf ?b", "?a", "?b"),
        "class-is-thing": _rule("?c rdfs:subClassOf owl:Thing", "?c a owl:Class", "?c"),
        "thing-is-class": _rule("owl:Thing a owl:Class", "?c a owl:Class"),
        "property-is-class": _rule("rdf:Property a owl:Class", "?c a owl:Class"),
        # chains and mirrors
        "sub-class-chain": _rule("?a rdfs:subClassOf ?c", "?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?c", "?a", "?b", "?c"),
        "sub-property-chain": _rule("?a rdfs:subPropertyOf ?c", "?a rdfs:subPropertyOf ?b . ?b rdfs:subPropertyOf ?c", "?a", "?b", "?c", apart=("?a", "?c")),
        "inverse-mirror": _rule("?b owl:inverseOf ?a", "?a owl:inverseOf ?b"),
        "inverse-of-inverse": _rule("?a owl:equivalentProperty ?c", "?a owl:inverseOf ?b . ?b owl:inverseOf ?c", "?a", "?b", "?c", apart=("?a", "?c")),
    }
    for what, p in (("class", "owl:equivalentClass"), ("property", "owl:equivalentProperty")):
        out[f"equivalent-{what}-mirror"] = _rule(f"?b {p} ?a", f"?a {p} ?b", "?a", "?b")
        out[f"equivalent-{what}-chain"] = _rule(f"?a {p} ?c", f"?a {p} ?b . ?b {p} ?c", "?a", "?b", "?c", apart=("?a", "?c"))
    # what kinds of properties have, and what they hand down
    for what, kind in kinds.items():
        out[f"{what}-domain"] = _rule("?p rdfs:domain owl:Thing", f"?p a {kind}", "?p")
        out[f"{what}-handed-down"] = _rule(f"?a a {kind}", f"?a rdfs:subPropertyOf ?b . ?b a {kind}", "?a", "?b")
    for what, top in (("datatype", "rdfs:Literal"), ("object", "owl:Thing")):
        out[f"{what}-range"] = _rule(f"?p rdfs:range {top}", f"?p a {kinds[what]}", "?p")
    for what in ("domain", "range"):
        out[f"{what}-handed-down"] = _rule(f"?a rdfs:{what} ?c", f"?a rdfs:subPropertyOf ?b . ?b rdfs:{what} ?c", "?a", "?b")
    return out


def _cleanup() -> dict[str, str]:
    typed = "?p a ?kind FILTER(?kind IN (owl:AnnotationProperty, owl:DatatypeProperty, owl:ObjectProperty))"
    out = {"documentation": _rule("?s ?p ?o", f"?s ?p ?o FILTER(?p IN ({', '.join(f'<{x}>' for x in DOCUMENTATION)}))")}
    for what, kind, top in (("datatype", "owl:DatatypeProperty", "rdfs:Literal"), ("object", "owl:ObjectProperty", "owl:Thing")):
        for side, value in (("domain", "owl:Thing"), ("range", top)):
            two = f"?p a {kind} . ?p rdfs:{side} ?x . ?p rdfs:{side} ?y"
            out[f"{what}-{side}"] = _rule(f"?p rdfs:{side} {value}", two, "?p", apart=("?x", "?y"))
    out["inverse"] = _rule("?a owl:inverseOf ?b", "?a owl:inverseOf ?b")
    for what in ("Annotation", "Datatype", "Object"):
        out[f"{what.lower()}-property"] = _rule("?p a rdf:Property", f"?p a owl:{what}Property", "?p")
    out["rdfs-class"] = _rule("?c a rdfs:Class", "?c a rdfs:Class", "?c")
    for side in ("domain", "range"):
        two = f"{typed} ?p rdfs:{side} ?x . ?p rdfs:{side} ?y . ?x rdfs:subClassOf ?y"
        out[f"wider-{side}"] = _rule(f"?p rdfs:{side} ?y", two, "?p", "?x", "?y", apart=("?x", "?y"))
    out["sub-property"] = _rule("?a rdfs:subPropertyOf ?b", "?a rdfs:subPropertyOf ?b")
    return out


#: The documentation properties that a cleanup drops.
DOCUMENTATION = (
    RDFS + "comment", "http://data.legilux.public.lu/resource/ontology/jolux#alignmentComment", SKOS + "altLabel", RDFS + "label", SKOS + "editorialNote",
)
#: RDFS and OWL entailments, as constructs; they only add, so their order doesn't matter.
EXPANSION: dict[str, str] = _expansion()
#: What expansion made redundant, in this order; each construct's result goes before the next one looks.
CLEANUP: dict[str, str] = _cleanup()
ONTOLOGY_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "dct": DCT}


def expand_ontology(quads: DataFrame, cleanup: bool = True) -> DataFrame:
    """The ontology with its entailments, to a fixpoint; then without what became redundant."""
    out = fixpoint(quads, list(EXPANSION.values()), ONTOLOGY_PREFIXES)
    if cleanup:
        for text in CLEANUP.values():
            out = cut(remove_construct(out, text, ONTOLOGY_PREFIXES))
    return out


# Minting of IRIs


@dataclass(frozen=True)
class Generator:
    """selector: SELECT ?uri of resources it names; variables: SELECT of values for a bound ?uri; template: #{[name]} places."""

    selector: str
    variables: str
    template: str


class MintingError(ValueError):
    """Temporary IRIs that no generator, or more than one, or no values can replace."""


def _start(table: DataFrame, column: str) -> str:
    """What all texts of a column begin with: their least and their greatest do."""
    return os.path.commonprefix([x or "" for x in table.agg(F.min(column), F.max(column)).first()])


def replace_iris(quads: DataFrame, mapping: DataFrame, old: str = "old", new: str = "new", tasks: int | None = None) -> DataFrame:
    """Subjects and objects (not predicates) by a mapping of IRIs: two left joins, dealt out to so many tasks if they are given.

    A literal has a key of its own that no IRI equals, and so has an IRI that begins otherwise than all of the mapping's: a class
    or a value of many quads doesn't come to one task.
    """
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    same = _start(mapping, old)

    def at(rows: DataFrame, c: str) -> DataFrame:
        own = F.concat(F.lit("\0"), F.xxhash64("s", "p", "o").cast("string"))
        rows = rows.withColumn("_key", F.when((F.col(f"{c}_kind") == "iri") & F.col(c).startswith(same), F.col(c)).otherwise(own))
        to = m.withColumnRenamed("_old", "_key")
        if tasks:
            rows, to = rows.repartition(tasks, "_key"), to.repartition(tasks, "_key").hint("merge")
        return rows.join(to, "_key", "left").withColumn(c, F.coalesce("_new", c)).select(*COLUMNS)

    return set_of(at(at(quads.select(*COLUMNS), "s"), "o"), tasks)


def mint(quads: DataFrame, generators: Sequence[Generator], temporary: str, prefixes=None) -> DataFrame:
    """Replace all IRIs that begin with `temporary`, to a fixpoint.

    Every one must be selected exactly once. A generator fires for a resource once its values hold no temporary IRI and
    are one row; the new IRI must not exist. Rounds end when all are done; one without progress raises.
    """
    quads = dataset(quads)
    is_temp = lambda c: c.startswith(temporary)

    def temps() -> DataFrame:
        both = F.explode(F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.when(F.col("o_kind") == "iri", F.col("o"))))
        return state.select(both.alias("iri")).where(F.col("iri").isNotNull() & is_temp(F.col("iri"))).repartition(tasks, "iri").distinct()

    state, chosen = cut(quads), None
    count = state.count()
    tasks = tasks_of(count)  # of every step: none has more rows than twice the quads
    for i, gen in enumerate(generators):
        rows = compiler.select(FrameSource(state, count), gen.selector, prefixes)
        rows = rows.select(F.col(rows.columns[0])["value"].alias("iri"), F.lit(i).alias("generator")).where(is_temp(F.col("iri")))
        chosen = rows if chosen is None else chosen.unionAll(rows)
    todo = cut(chosen)
    times = todo.repartition(tasks, "iri").groupBy("iri").agg(F.count("*").alias("n"))
    odd = temps().join(times.hint("merge"), "iri", "left").where("n is null or n != 1")
    if bad := odd.limit(5).collect():
        raise MintingError(f"not selected exactly once: {[r['iri'] for r in bad]}")
    while left := todo.count():
        mapping = None
        for i, gen in enumerate(generators):
            here = todo.where(F.col("generator") == i).select("iri")
            rows = compiler.select(FrameSource(state, count), gen.variables, prefixes, here.select(terms.iri(F.col("iri")).alias("uri")))
            names = [c for c in rows.columns if c != "uri"]
            flat = rows.select(F.col("uri.value").alias("old"), *[F.col(f"`{c}`")["value"].alias(c) for c in names])
            usable = flat
            for c in names:
                usable = usable.withColumn("_bad", F.col(f"`{c}`").isNull() | is_temp(F.col(f"`{c}`"))) if c == names[0] else usable.withColumn("_bad", F.col("_bad") | F.col(f"`{c}`").isNull() | is_temp(F.col(f"`{c}`")))
            usable = usable if names else usable.withColumn("_bad", F.lit(False))
            once = usable.repartition(tasks, "old").groupBy("old").agg(F.count("*").alias("n"), F.max("_bad").alias("bad"), *[F.first(c).alias(c) for c in names]).where("n = 1 and not bad")
            made = once.select("old", _fill(gen.template, names).alias("new"))
            mapping = made if mapping is None else mapping.unionAll(made)
        mapping = cut(mapping)
        if not mapping.limit(1).count():
            raise MintingError(f"{left} temporary IRIs can't be replaced")
        taken = state.select(F.explode(F.array("s", F.when(F.col("o_kind") == "iri", F.col("o")))).alias("new")).where(F.col("new").startswith(_start(mapping, "new"))).repartition(tasks, "new").distinct()
        made = mapping.select("new").repartition(tasks, "new")
        double = made.groupBy("new").count().where("count > 1").select("new").unionAll(made.join(taken.hint("merge"), "new"))
        if bad := double.limit(5).collect():
            raise MintingError(f"exist already: {[r['new'] for r in bad]}")
        state = cut(replace_iris(state, mapping, tasks=tasks))
        done = mapping.select(F.col("old").alias("iri"), F.lit(True).alias("_done")).repartition(tasks, "iri").hint("merge")
        todo = cut(todo.repartition(tasks, "iri").join(done, "iri", "left").where("_done is null").drop("_done"))
    return state


def _fill(template: str, names: Sequence[str]):
    import re

    parts = re.split(r"#\{\[['\"]?(\w+)['\"]?\]\}", template)
    if bad := [x for x in parts[1::2] if x not in names]:
        raise MintingError(f"the template names {bad}, which no query gives")
    return F.concat(*[F.col(f"`{x}`") if i % 2 else F.lit(x) for i, x in enumerate(parts)])
