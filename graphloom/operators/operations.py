"""Operation trees evaluated for all resources at once, and permissions.

    {id: "root", operations: {edit: {template: "ASK {...}"}, remove: {requires: ["edit"]}, any: {optional: ["edit", "remove"]}},
     groups: {child: {selectorQuery: "SELECT ?x {...}", multiselect: true, operations: {...}}}}

Queries see the resource as ?contextUri. Each ASK is one semi-join over a table of resources; a group's selector is one
join that gives the members of all its parents; paths are joins of (group, resource) results. `..` goes up a group,
`group*` to all members.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.plans import compiler
from graphloom.plans.sparql import UnsupportedSparql, parse_query
from graphloom.sources import json5


class OperationError(ValueError):
    """A tree that isn't well formed, or a selector that gives too many rows."""


@dataclass(frozen=True)
class Operation:
    id: str
    template: str | bool | None = None
    negate: bool = False
    requires: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    extra: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class OperationGroup:
    id: str
    operations: Mapping[str, Operation]
    groups: Mapping[str, OperationGroup]
    selector: str | None = None
    multiselect: bool = False

    def walk(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], OperationGroup]]:
        yield path, self
        for k, g in self.groups.items():
            yield from g.walk((*path, k))


def _group(id_: str, data: Mapping) -> OperationGroup:
    operations = {}
    for k, o in data.get("operations", {}).items():
        given = [x for x in ("template", "requires", "optional") if x in o]
        if len(given) != 1:
            raise OperationError(f"{id_}.{k} needs one of template, requires and optional")
        operations[k] = Operation(k, o.get("template"), bool(o.get("negate")), tuple(o.get("requires", ())), tuple(o.get("optional", ())), {x: y for x, y in o.items() if x not in ("template", "requires", "optional", "negate")})
    groups = {k: _group(k, g) for k, g in data.get("groups", {}).items()}
    if twice := set(operations) & set(groups):
        raise OperationError(f"ids used twice in {id_}: {sorted(twice)}")
    return OperationGroup(id_, operations, groups, data.get("selectorQuery"), bool(data.get("multiselect")))


def load(*texts: str, prefixes: Mapping[str, str] | None = None) -> OperationGroup:
    """One tree; several files become groups of a root. Queries must parse and paths lead somewhere."""
    roots, known = [], dict(prefixes or {})
    for t in texts:
        data = json5.loads(t)
        for k, v in data.get("prefixes", {}).items():
            if known.setdefault(k, v) != v:
                raise OperationError(f"prefix {k} is {known[k]} and {v}")
        roots.append(_group(data["id"], data))
    if len({r.id for r in roots}) != len(roots):
        raise OperationError("two files have one id")
    root = roots[0] if len(roots) == 1 else OperationGroup("root", {}, {r.id: r for r in roots})
    for path, g in root.walk():
        for o in g.operations.values():
            if isinstance(o.template, str) and o.template not in ("true", "false"):
                try:
                    if parse_query(o.template, known).form != "ask":
                        raise OperationError(f"{'/'.join(path)}.{o.id} is no ASK")
                except UnsupportedSparql as e:
                    raise OperationError(f"{'/'.join(path)}.{o.id}: {e}") from e
            for p in (*o.requires, *o.optional):
                _resolve(root, path, p)
    return root


def _resolve(root: OperationGroup, at: tuple[str, ...], path: str) -> tuple[list[str], tuple[str, ...], str]:
    """(steps, the group's path, the operation) of a path from a group."""
    *steps, op = path.split("/")
    here = at
    for s in steps:
        if s == "..":
            if not here:
                raise OperationError(f"{path} leaves the tree")
            here = here[:-1]
        else:
            here = (*here, s.removesuffix("*"))
    g = root
    for k in here:
        if k not in g.groups:
            raise OperationError(f"{path} leads nowhere: no group {k}")
        g = g.groups[k]
    if op not in g.operations:
        raise OperationError(f"{path} leads nowhere: no operation {op}")
    return steps, here, op


def evaluate(source, root: OperationGroup, uris: DataFrame, permissions: Sequence[str] | None = None, prefixes=None) -> DataFrame:
    """(uri, group, parent, member, operation, enabled) for every resource of uris (column s), group member and operation.

    group is the path of ids. A selector without rows gives one member without IRI (none with multiselect); more than one
    row without multiselect raises. Operations not among the permissions (paths group/operation; None: all) are off.
    """
    spark = uris.sparkSession
    # members: uri, chain (the IRIs from the root to the member)
    members: dict[tuple[str, ...], DataFrame] = {(): uris.select(F.col("s").alias("uri"), F.array("s").alias("chain")).distinct()}
    for path, g in root.walk():
        if not path:
            continue
        parents = members[path[:-1]].withColumn("at", F.element_at("chain", -1))
        if g.selector is None:
            members[path] = parents.select("uri", F.concat("chain", F.array("at")).alias("chain"))
            continue
        bound = parents.where("at is not null").select(terms.iri(F.col("at")).alias("contextUri")).distinct()
        rows = compiler.select(source, g.selector.replace("SELECT", "SELECT ?contextUri", 1), prefixes, bound)
        value = next(c for c in rows.columns if c != "contextUri")
        rows = rows.select(F.col("contextUri.value").alias("at"), F.col(f"`{value}`")["value"].alias("m")).distinct()
        joined = parents.join(rows, "at", "inner" if g.multiselect else "left")
        if not g.multiselect:
            n = F.count("*").over(Window.partitionBy("uri", "chain"))
            joined = joined.withColumn("m", F.when(n > 1, F.raise_error(F.concat(F.lit("several members of a group for "), F.col("at"))).cast("string")).otherwise(F.col("m")))
        members[path] = joined.select("uri", F.concat("chain", F.array("m")).alias("chain"))
    results: dict[tuple[tuple[str, ...], str], DataFrame] = {}

    def result(path: tuple[str, ...], op: str, busy: frozenset) -> DataFrame:
        """(uri, chain, enabled) of an operation, once."""
        key = (path, op)
        if key in results:
            return results[key]
        if key in busy:
            raise OperationError(f"{'/'.join(path)}/{op} requires itself")
        g = root
        for k in path:
            g = g.groups[k]
        o, m = g.operations[op], members[path].withColumn("at", F.element_at("chain", -1))
        allowed = permissions is None or "/".join((*path, op)) in permissions
        if not allowed:
            out = m.select("uri", "chain", F.lit(False).alias("enabled"))
        elif o.requires or o.optional:
            tests = [reach(path, p, busy | {key}) for p in (o.requires or o.optional)]
            both = reduce(DataFrame.unionByName, tests)
            how = F.min if o.requires else F.max
            out = _join_back(m, both.groupBy("uri", "chain").agg(how("ok").alias("ok")))
            out = out.select("uri", "chain", (F.coalesce("ok", F.lit(bool(o.requires))) & F.col("at").isNotNull()).alias("enabled"))
        elif isinstance(o.template, bool) or o.template in ("true", "false"):
            on = str(o.template).lower() == "true"
            out = m.select("uri", "chain", (F.lit(on) & F.col("at").isNotNull()).alias("enabled"))
        else:
            bound = m.where("at is not null").select(terms.iri(F.col("at")).alias("contextUri")).distinct()
            held = compiler.ask_each(source, o.template, bound, prefixes).select(F.col("contextUri.value").alias("at"), (F.col("holds") != F.lit(o.negate)).alias("enabled"))
            out = m.join(held, "at", "left").select("uri", "chain", F.coalesce("enabled", F.lit(False)).alias("enabled"))
        results[key] = out
        return out

    def reach(path: tuple[str, ...], text: str, busy: frozenset) -> DataFrame:
        """(uri, chain of the group at path, ok): whether all members that the path reaches have the operation; none: true."""
        steps, target, op = _resolve(root, path, text)
        ups = 0
        while ups < len(steps) and steps[ups] == "..":
            ups += 1
        if any(s == ".." for s in steps[ups:]):
            raise OperationError(f"{text} goes down and up again")
        n = len(path) + 1 - ups
        there = result(target, op, busy).select("uri", F.slice("chain", 1, n).alias("stem"), "enabled")
        ok = there.groupBy("uri", "stem").agg(F.min("enabled").alias("ok"))
        here = members[path].select("uri", "chain", F.slice("chain", 1, n).alias("stem"))
        return _join_back(here, ok, "stem").select("uri", "chain", F.coalesce("ok", F.lit(True)).alias("ok"))

    parts = []
    for path, g in root.walk():
        for op in g.operations:
            r = result(path, op, frozenset())
            parts.append(r.select("uri", F.lit("/".join(path)).alias("group"), F.element_at("chain", -1).alias("member"), F.lit(op).alias("operation"), "enabled"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "uri string, group string, member string, operation string, enabled boolean")


def _join_back(a: DataFrame, b: DataFrame, key: str = "chain") -> DataFrame:
    """Left join on uri and an array key whose elements may be null."""
    a, b = a.withColumn("_k", F.to_json(key)), b.withColumn("_k", F.to_json(key)).drop(key)
    return a.join(b, ["uri", "_k"], "left").drop("_k")


def to_json(results: DataFrame) -> DataFrame:
    """(uri, json): the operations of each group's members."""
    ops = results.groupBy("uri", "group", "member").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("operation", "enabled")))).alias("operations"))
    groups = ops.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("group", "member", F.to_json("operations").alias("operations")))).alias("groups"))
    return groups.select("uri", F.to_json(F.struct("uri", "groups")).alias("json"))


# Permissions


def permissions_of(roles: Mapping[str, Sequence[str]], user_roles: Sequence[str], known: Sequence[str] | None = None, default: Sequence[str] = ()) -> list[str]:
    """All permissions of a user's roles (names regardless of case) and the default ones; an unknown permission raises."""
    if known is not None and (bad := sorted({p for ps in roles.values() for p in ps} - set(known))):
        raise OperationError(f"unknown permissions {bad}")
    mine = {r.lower() for r in user_roles}
    return sorted({*default, *(p for r, ps in roles.items() if r.lower() in mine for p in ps)})


def role_permissions(roles: DataFrame, users: DataFrame) -> DataFrame:
    """(user, permission) of roles (role, permissions array) and users (user, role), by one join."""
    each = roles.select(F.lower("role").alias("role"), F.explode("permissions").alias("permission"))
    return users.select("user", F.lower("role").alias("role")).join(each, "role").select("user", "permission").distinct()


def visible_columns(columns: Sequence[str], blacklist: Mapping[str, Sequence[str]], user_roles: Sequence[str]) -> list[str]:
    """Columns but those blacklisted for all of the user's roles."""
    mine = {r.lower() for r in user_roles}
    return [c for c in columns if c not in blacklist or any(r.lower() in mine for r in blacklist[c])]


def vote(have: str, need: str, strategy: str = "any"):
    """Whether an array of permissions has any or all of those needed."""
    if strategy == "any":
        return F.exists(need, lambda p: F.array_contains(F.col(have), p))
    return F.forall(need, lambda p: F.array_contains(F.col(have), p))
