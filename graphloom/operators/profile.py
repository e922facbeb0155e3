"""Application profiles: types, attributes and rules, read from tolerant JSON, composed by imports, collapsed.

Profiles are small and live on the driver; operators compile them into column expressions.

    {"uri": "urn:p", "prefixes": {...}, "imports": [...], "extra": {...},
     "types": {"Person": {"rules": {"rdfType": "ex:Person", "subClassOf": "Agent"}, "attributes":
        {"name": {"uri": "ex:name", "rules": {"range": {"datatype": "xsd:string"}, "minCardinality": 1}}}}}}
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from graphloom.functions.terms import PREFIXES, expand_curie_text
from graphloom.sources import json5

#: Names of rules that profiles may use; scalar ones hold a text, number or boolean, nested ones hold rules.
SCALAR = ("rdfType", "subClassOf", "datatype", "classId", "embeddedClassId", "inScheme", "memberOf", "literalValue", "resourceReference", "propertyPath", "minCardinality", "maxCardinality", "minLangCardinality", "maxLangCardinality", "filter")
NESTED = ("range", "and", "or", "not", "propertyValue", "constraints", "snippet", "languageIn", "extra")
LINKS = ("rdfType", "datatype", "inScheme", "memberOf", "resourceReference")


class ProfileError(ValueError):
    """A profile that contradicts itself."""


@dataclass(frozen=True)
class Rule:
    """name and value: a text or number, or (and, or, not, range) a tuple of rules."""

    name: str
    value: Any = None

    @property
    def rules(self) -> tuple[Rule, ...]:
        return self.value if isinstance(self.value, tuple) and all(isinstance(x, Rule) for x in self.value) else ()


@dataclass(frozen=True)
class Attribute:
    id: str
    uri: str
    rules: tuple[Rule, ...] = ()
    inverse: bool = False

    def of(self, name: str) -> list[Any]:
        return [r.value for r in self.rules if r.name == name]

    @property
    def range(self) -> tuple[Rule, ...]:
        return tuple(x for r in self.rules if r.name == "range" for x in r.rules)

    @property
    def min(self) -> int | None:
        return max(self.of("minCardinality"), default=None)

    @property
    def max(self) -> int | None:
        return min(self.of("maxCardinality"), default=None)


@dataclass(frozen=True)
class TypeDef:
    id: str
    rules: tuple[Rule, ...] = ()
    attributes: Mapping[str, Attribute] = field(default_factory=dict)

    def of(self, name: str) -> list[Any]:
        return [r.value for r in self.rules if r.name == name]


@dataclass(frozen=True)
class Profile:
    uri: str
    types: Mapping[str, TypeDef] = field(default_factory=dict)
    imports: tuple[Profile, ...] = ()
    extra: tuple[Rule, ...] = ()
    prefixes: Mapping[str, str] = field(default_factory=dict)

    # lookup over imports

    def definitions(self, type_id: str) -> list[TypeDef]:
        """All definitions of a type, own first: the several-profile view."""
        return [p.types[type_id] for p in self.all() if type_id in p.types]

    def all(self) -> list[Profile]:
        out, seen = [], set()

        def walk(p: Profile):
            if p.uri not in seen:
                seen.add(p.uri)
                out.append(p)
                for x in p.imports:
                    walk(x)

        walk(self)
        return out

    def type_ids(self) -> list[str]:
        return list(dict.fromkeys(t for p in self.all() for t in p.types))

    def supers(self, type_id: str) -> list[str]:
        """The type and all its super types, nearest first; a cycle ends."""
        out: list[str] = []
        todo = [type_id]
        while todo:
            t = todo.pop(0)
            if t in out:
                continue
            if not self.definitions(t):
                raise ProfileError(f"unknown type {t}")
            out.append(t)
            todo += [v for d in self.definitions(t) for v in d.of("subClassOf")]
        return out

    def conforms_to(self, type_id: str, other: str) -> bool:
        return other in self.supers(type_id)

    def rdf_types(self, type_id: str) -> list[str]:
        """All classes that an instance must have, inherited ones too."""
        return list(dict.fromkeys(v for t in self.supers(type_id) for d in self.definitions(t) for v in d.of("rdfType")))

    def type_rules(self, type_id: str) -> list[Rule]:
        return [r for t in self.supers(type_id) for d in self.definitions(t) for r in d.rules if r.name != "subClassOf"]

    def attributes(self, type_id: str) -> dict[str, Attribute]:
        """Attributes with inherited and imported rules joined."""
        out: dict[str, Attribute] = {}
        for t in self.supers(type_id):
            for d in self.definitions(t):
                for k, a in d.attributes.items():
                    if k in out and out[k].uri != a.uri:
                        raise ProfileError(f"attribute {k} of {type_id} has two IRIs")
                    out[k] = a if k not in out else replace(out[k], rules=tuple(dict.fromkeys(out[k].rules + a.rules)))
        return out

    def leaf_type(self, classes: Sequence[str]) -> str | None:
        """The one most specific type whose classes are all given; None without one, an error for a tie."""
        have = set(classes)
        fit = [t for t in self.type_ids() if self.rdf_types(t) and set(self.rdf_types(t)) <= have]
        leaves = [t for t in fit if not any(u != t and self.conforms_to(u, t) and not self.conforms_to(t, u) for u in fit)]
        if len(leaves) > 1:
            raise ProfileError(f"several types fit {sorted(have)}: {sorted(leaves)}")
        return leaves[0] if leaves else None


# Reading and writing


def _rule(name: str, value: Any, expand: Callable[[str], str]) -> list[Rule]:
    if name not in SCALAR and name not in NESTED:
        raise ProfileError(f"unknown rule {name}")
    if name == "languageIn":
        return [Rule(name, tuple([value] if isinstance(value, str) else value))]
    if name in ("range", "and", "or", "not"):
        return [Rule(name, tuple(_rules(value, expand)))]
    if name in NESTED:
        return [Rule(name, _freeze(value))]
    out = []
    for v in value if isinstance(value, list) else [value]:
        if not isinstance(v, (str, int, bool)):
            raise ProfileError(f"{name} has a value that is no text, integer or boolean")
        out.append(Rule(name, expand(v) if name in LINKS and isinstance(v, str) else v))
    return out


def _freeze(v: Any) -> Any:
    return tuple(sorted((k, _freeze(x)) for k, x in v.items())) if isinstance(v, dict) else tuple(map(_freeze, v)) if isinstance(v, list) else v


def _rules(data: Any, expand) -> list[Rule]:
    items = data if isinstance(data, list) else [data]
    return [r for x in items for k, v in (x or {}).items() for r in _rule(k, v, expand)]


def load(text: str, resolve: Callable[[str], str] | None = None, prefixes: Mapping[str, str] = PREFIXES) -> Profile:
    """A profile of a tolerant JSON text; resolve gives the text of an import, and each import is read once."""
    cache: dict[str, Profile] = {}

    def read(text: str) -> Profile:
        data = json5.loads(text)
        known = {**prefixes, **data.get("prefixes", {})}
        expand = lambda x: expand_curie_text(x, known)
        types = {}
        for k, t in data.get("types", {}).items():
            attributes = {
                a: Attribute(a, expand(x["uri"]), tuple(_rules(x.get("rules", {}), expand)), bool(x.get("inverse", False))) for a, x in t.get("attributes", {}).items()
            }
            types[k] = TypeDef(k, tuple(_rules(t.get("rules", {}), expand)), attributes)
        imports = []
        for name in data.get("imports", []):
            if name not in cache:
                if resolve is None:
                    raise ProfileError(f"nothing resolves the import {name}")
                cache[name] = read(resolve(name))
            imports.append(cache[name])
        extra = tuple(Rule(k, _freeze(v)) for k, v in data.get("extra", {}).items())
        return Profile(data.get("uri", ""), types, tuple(imports), extra, known)

    return read(text)


def render_template(text: str, values: Mapping[str, object]) -> Profile:
    """A profile of a template text with ${name} places."""
    return load(re.sub(r"\$\{(\w+)\}", lambda m: str(values[m[1]]), text))


def _plain(r: Rule) -> Any:
    if r.name in ("range", "and", "or", "not"):
        return _plain_rules(r.rules)
    return list(r.value) if isinstance(r.value, tuple) else r.value


def _plain_rules(rules: Sequence[Rule]) -> Any:
    """One object where names differ, with a list where one repeats."""
    out: dict[str, Any] = {}
    for r in rules:
        v = _plain(r)
        if r.name in out and r.name in ("range", "and", "or", "not", "languageIn"):
            return [{x.name: _plain(x)} for x in rules]
        out[r.name] = v if r.name not in out else [*(out[r.name] if isinstance(out[r.name], list) else [out[r.name]]), v]
    return out


def dump(p: Profile) -> str:
    """The profile as JSON that load() reads back."""
    types = {
        t.id: {"rules": _plain_rules(t.rules), "attributes": {a.id: {"uri": a.uri, "rules": _plain_rules(a.rules)} | ({"inverse": True} if a.inverse else {}) for a in t.attributes.values()}}
        for t in p.types.values()
    }
    return json5.dumps({"uri": p.uri, "imports": [x.uri for x in p.imports], "extra": {r.name: r.value for r in p.extra}, "types": types})


def collapse(p: Profile) -> Profile:
    """One profile without imports or super types: the strictest cardinalities, ranges joined by and, classes gathered."""
    types = {}
    for t in p.type_ids():
        attributes = {}
        for k, a in p.attributes(t).items():
            rules: list[Rule] = []
            if a.min is not None:
                rules.append(Rule("minCardinality", a.min))
            if a.max is not None:
                rules.append(Rule("maxCardinality", a.max))
            for name, pick in (("minLangCardinality", max), ("maxLangCardinality", min)):
                if a.of(name):
                    rules.append(Rule(name, pick(a.of(name))))
            ranges = list(dict.fromkeys(r.rules for r in a.rules if r.name == "range"))
            if len(ranges) == 1:
                rules.append(Rule("range", ranges[0]))
            elif ranges:
                rules.append(Rule("range", (Rule("and", tuple(x for r in ranges for x in r)),)))
            snippets = list(dict.fromkeys(a.of("snippet")))
            if len(snippets) > 1:
                raise ProfileError(f"{t}.{k} has two snippets")
            rules += [r for r in a.rules if r.name not in ("minCardinality", "maxCardinality", "minLangCardinality", "maxLangCardinality", "range")]
            attributes[k] = Attribute(k, a.uri, tuple(rules), a.inverse)
        types[t] = TypeDef(t, tuple(dict.fromkeys(p.type_rules(t))), attributes)
    extra = [r for x in p.all() for r in x.extra]
    if bad := [r.name for r in extra if r.name not in ("comment", "comments", "label")]:
        raise ProfileError(f"extra rules that can't be merged: {bad}")
    return Profile(p.uri, types, (), tuple(dict.fromkeys(extra)), p.prefixes)


# Conversion profiles: what documents need


@dataclass(frozen=True)
class DocAttribute:
    id: str
    uri: str
    inverse: bool = False
    single: bool = False
    kind: str = "mix"  # datatype, object or mix

    def merge(self, other: DocAttribute) -> DocAttribute:
        """One definition of two: single wins over multiple, mix yields; anything else that differs is a conflict."""
        if (self.uri, self.inverse) != (other.uri, other.inverse):
            raise ProfileError(f"attribute {self.id}: {self.uri} or {other.uri}")
        if "mix" not in (self.kind, other.kind) and self.kind != other.kind:
            raise ProfileError(f"attribute {self.id} is {self.kind} and {other.kind}")
        return DocAttribute(self.id, self.uri, self.inverse, self.single or other.single, other.kind if self.kind == "mix" else self.kind)


@dataclass(frozen=True)
class DocType:
    id: str
    rdf_types: frozenset[str]
    supers: tuple[str, ...] = ()
    attributes: Mapping[str, DocAttribute] = field(default_factory=dict)


@dataclass(frozen=True)
class DocProfile:
    types: Mapping[str, DocType]
    prefixes: Mapping[str, str] = field(default_factory=dict)

    def levels(self) -> dict[str, int]:
        """Leaf types have level 0; a super type is above all its subtypes."""
        below = {t: {s for s, d in self.types.items() if t in d.supers} for t in self.types}
        out: dict[str, int] = {}
        while len(out) < len(self.types):
            ready = [t for t in self.types if t not in out and below[t] <= set(out)]
            if not ready:
                raise ProfileError("types are their own super types")
            for t in ready:
                out[t] = 1 + max((out[s] for s in below[t]), default=-1)
        return out


def doc_profile(p: Profile) -> DocProfile:
    """The conversion profile of an application profile."""
    types = {}
    for t in p.type_ids():
        attributes = {}
        for k, a in p.attributes(t).items():
            names = {r.name for r in a.range}
            kind = "datatype" if names == {"datatype"} else "object" if names and names <= {"classId", "embeddedClassId"} else "mix"
            attributes[k] = DocAttribute(k, a.uri, a.inverse, a.max == 1, kind)
        types[t] = DocType(t, frozenset(p.rdf_types(t)), tuple(p.supers(t)[1:]), attributes)
    return DocProfile(types, p.prefixes)


def merge_doc_profiles(*profiles: DocProfile) -> DocProfile:
    """Imports joined, first to last; types may repeat if one is empty or their classes agree."""
    types: dict[str, DocType] = {}
    prefixes: dict[str, str] = {}
    for p in profiles:
        for k, v in p.prefixes.items():
            if prefixes.setdefault(k, v) != v:
                raise ProfileError(f"prefix {k} is {prefixes[k]} and {v}")
        for t, d in p.types.items():
            if t not in types:
                types[t] = d
                continue
            a = types[t]
            if a.rdf_types and d.rdf_types and a.rdf_types != d.rdf_types:
                raise ProfileError(f"type {t} has two sets of classes")
            attributes = dict(a.attributes)
            for k, x in d.attributes.items():
                attributes[k] = attributes[k].merge(x) if k in attributes else x
            types[t] = DocType(t, a.rdf_types or d.rdf_types, tuple(dict.fromkeys(a.supers + d.supers)), attributes)
    return DocProfile(types, prefixes)
