"""RDF/XML and JSON-LD documents, and a writer for each syntax. Documents are of configuration size: one is parsed in one task
or written by the driver. N-Quads (sources/rdf.py) is the syntax that is read and written in parallel."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from graphloom.functions.terms import LANG_STRING, RDF, RDF_TYPE, STRING, XSD

XML = "http://www.w3.org/XML/1998/namespace"
#: Attributes and elements of RDF/XML that are no properties.
SYNTAX_TERMS = {RDF + x for x in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "Description")}

Row = tuple  # (g, s, s_kind, p, o, o_kind, o_dt, o_lang)


class DocumentError(ValueError):
    """A document that isn't in its syntax."""


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class RdfXml:
    """One RDF/XML document; blank nodes get labels x1, x2, ..., those with an rdf:nodeID keep it with n- before it."""

    def __init__(self, base: str = ""):
        self.base, self.rows, self.made = base, [], 0

    def read(self, text: str) -> list[Row]:
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            raise DocumentError(str(e)) from e
        base, lang = self.scope(root, self.base, "")
        for e in root if _name(root.tag) == RDF + "RDF" else [root]:
            self.node(e, base, lang)
        return self.rows

    @staticmethod
    def scope(e, base: str, lang: str) -> tuple[str, str]:
        return e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)

    def blank(self) -> tuple[str, str]:
        self.made += 1
        return "bnode", f"x{self.made}"

    def add(self, s, p: str, o, dt: str = "", lang: str = "") -> None:
        self.rows.append((None, s[1], s[0], p, o[1], o[0], dt, lang))

    def literal(self, s, p: str, text: str, lang: str, dt: str | None = None) -> None:
        self.add(s, p, ("lit", text), dt or (LANG_STRING if lang else STRING), "" if dt else lang)

    def node(self, e, base: str, lang: str) -> tuple[str, str]:
        base, lang = self.scope(e, base, lang)
        about, id_, label = (e.get(f"{{{RDF}}}{x}") for x in ("about", "ID", "nodeID"))
        if about is not None:
            s = ("iri", urljoin(base, about))
        elif id_ is not None:
            s = ("iri", urljoin(base, "#" + id_))
        else:
            s = ("bnode", "n-" + label) if label is not None else self.blank()
        kind = _name(e.tag)
        if kind != RDF + "Description":
            if ":" not in kind:
                raise DocumentError(f"an element without a namespace, {kind}")
            self.add(s, RDF_TYPE, ("iri", kind))
        self.attributes(s, e, base, lang)
        n = 0
        for child in e:
            p = _name(child.tag)
            if p == RDF + "li":
                n += 1
                p = f"{RDF}_{n}"
            self.property(s, p, child, base, lang)
        return s

    def attributes(self, s, e, base: str, lang: str) -> None:
        for k, v in e.attrib.items():
            p = _name(k)
            if p == RDF_TYPE:
                self.add(s, p, ("iri", urljoin(base, v)))
            elif p not in SYNTAX_TERMS and not p.startswith(XML) and ":" in p:
                self.literal(s, p, v, lang)

    def property(self, s, p: str, e, base: str, lang: str) -> None:
        base, lang = self.scope(e, base, lang)
        kind, at = e.get(f"{{{RDF}}}parseType"), len(self.rows)
        resource, label, dt = (e.get(f"{{{RDF}}}{x}") for x in ("resource", "nodeID", "datatype"))
        own = [k for k in e.attrib if _name(k) not in SYNTAX_TERMS and not _name(k).startswith(XML)]
        if kind == "Resource":
            o = self.blank()
            self.add(s, p, o)
            inner = ET.Element(f"{{{RDF}}}Description", {f"{{{RDF}}}nodeID": "\0"})
            inner.extend(list(e))
            before = len(self.rows)
            self.node(inner, base, lang)
            self.rows[before:] = [tuple(o[1] if x == "n-\0" else x for x in r) for r in self.rows[before:]]
        elif kind == "Collection":
            nodes = [self.blank() for _ in e]
            self.add(s, p, nodes[0] if nodes else ("iri", RDF + "nil"))
            for i, (cell, child) in enumerate(zip(nodes, e)):
                self.add(cell, RDF + "first", self.node(child, base, lang))
                self.add(cell, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else ("iri", RDF + "nil"))
        elif kind is not None:
            inside = (e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in e)
            self.add(s, p, ("lit", inside), RDF + "XMLLiteral")
        elif resource is not None or label is not None or own and not len(e):
            o = ("iri", urljoin(base, resource)) if resource is not None else ("bnode", "n-" + label) if label is not None else self.blank()
            self.add(s, p, o)
            self.attributes(o, e, base, lang)
        elif len(e):
            if len(e) > 1:
                raise DocumentError(f"{p} has {len(e)} values in one element")
            self.rows.append(None)  # the statement stands before those of its object
            o = self.node(e[0], base, lang)
            self.rows[at] = (None, s[1], s[0], p, o[1], o[0], "", "")
        else:
            self.literal(s, p, e.text or "", lang, urljoin(base, dt) if dt else None)
        if (id_ := e.get(f"{{{RDF}}}ID")) is not None:  # the statement has a name of its own
            _, _, _, _, o, o_kind, o_dt, o_lang = self.rows[at]
            name = ("iri", urljoin(base, "#" + id_))
            self.add(name, RDF_TYPE, ("iri", RDF + "Statement"))
            self.add(name, RDF + "subject", s)
            self.add(name, RDF + "predicate", ("iri", p))
            self.add(name, RDF + "object", (o_kind, o), o_dt, o_lang)


def parse_rdfxml(text: str, base: str = "") -> list[Row]:
    return RdfXml(base).read(text)


class JsonLd:
    """One JSON-LD document with contexts inside it: prefixes, terms with @id, @type, @language, @container and @reverse, @vocab and @base."""

    def __init__(self, base: str = ""):
        self.rows, self.made, self.start = [], 0, {"base": base, "vocab": "", "lang": "", "terms": {}}

    def read(self, text: str) -> list[Row]:
        try:
            data = json.loads(text)
        except ValueError as e:
            raise DocumentError(str(e)) from e
        self.top(data, self.start, None)
        return self.rows

    def context(self, given, ctx: dict) -> dict:
        for c in given if isinstance(given, list) else [given]:
            if c is None:
                ctx = self.start
                continue
            if not isinstance(c, dict):
                raise DocumentError(f"a context elsewhere, {c}")
            ctx = {**ctx, "terms": dict(ctx["terms"])}
            ctx |= {k[1:] if k != "@language" else "lang": v or "" for k, v in c.items() if k in ("@base", "@vocab", "@language")}
            for k, v in c.items():
                if not k.startswith("@"):
                    ctx["terms"][k] = v if isinstance(v, dict) else {"@id": v}
        return ctx

    def iri(self, x: str, ctx: dict, vocab: bool = True, seen: tuple = ()) -> str | None:
        if x.startswith("@"):
            return x
        term = ctx["terms"].get(x)
        if vocab and term is not None and x not in seen:
            name = term.get("@id", term.get("@reverse"))
            return self.iri(name, ctx, True, (*seen, x)) if name else None
        if ":" in x:
            head, tail = x.split(":", 1)
            if head == "_" or tail.startswith("//") or head not in ctx["terms"]:
                return x
            return self.iri(head, ctx, True, (*seen, x)) + tail
        if vocab:
            return ctx["vocab"] + x if ctx["vocab"] else None
        return urljoin(ctx["base"], x)

    def ref(self, x: str, ctx: dict, vocab: bool = False) -> tuple[str, str]:
        iri = self.iri(x, ctx, vocab) or urljoin(ctx["base"], x)
        return ("bnode", iri[2:]) if iri.startswith("_:") else ("iri", iri)

    def blank(self) -> tuple[str, str]:
        self.made += 1
        return "bnode", f"j{self.made}"

    def add(self, g, s, p, o, dt="", lang="") -> None:
        self.rows.append((g, s[1], s[0], p, o[1], o[0], dt, lang))

    def top(self, data, ctx: dict, g) -> None:
        for x in data if isinstance(data, list) else [data]:
            inner = self.context(x["@context"], ctx) if "@context" in x else ctx
            graph = next((k for k in x if self.iri(k, inner) == "@graph"), None)
            if graph is None:
                self.node(x, ctx, g)
                continue
            more = [k for k in x if k not in (graph, "@context")]
            name = self.node({k: v for k, v in x.items() if k != graph}, ctx, g)[1] if more else g
            self.top(x[graph], inner, name)

    def node(self, x: dict, ctx: dict, g) -> tuple[str, str]:
        if "@context" in x:
            ctx = self.context(x["@context"], ctx)
        keys = {k: self.iri(k, ctx) for k in x if k != "@context"}
        s = next((self.ref(x[k], ctx) for k, p in keys.items() if p == "@id"), None) or self.blank()
        for k, p in keys.items():
            term, values = ctx["terms"].get(k, {}), x[k] if isinstance(x[k], list) else [x[k]]
            if p == "@type":
                for v in values:
                    self.add(g, s, RDF_TYPE, self.ref(v, ctx, vocab=True))
            elif p == "@reverse":
                for name, given in x[k].items():
                    for v in given if isinstance(given, list) else [given]:
                        self.add(g, self.value(v, {}, ctx, g)[0], self.iri(name, ctx), s)
            elif p is None or p.startswith("@"):
                continue
            elif "@reverse" in term:
                for v in values:
                    self.add(g, self.value(v, term, ctx, g)[0], p, s)
            elif term.get("@container") == "@language" and isinstance(x[k], dict):
                for lang, given in x[k].items():
                    for v in given if isinstance(given, list) else [given]:
                        self.add(g, s, p, ("lit", v), LANG_STRING, lang)
            elif term.get("@container") == "@list":
                self.add(g, s, p, self.list(values, term, ctx, g))
            else:
                for v in values:
                    for w in (v.get("@set") if isinstance(v, dict) and "@set" in v else [v]) or []:
                        if w is not None:
                            self.add(g, s, p, *self.value(w, term, ctx, g))
        return s

    def list(self, values, term: dict, ctx: dict, g) -> tuple[str, str]:
        nodes = [self.blank() for _ in values]
        for i, (n, v) in enumerate(zip(nodes, values)):
            self.add(g, n, RDF + "first", *self.value(v, term, ctx, g))
            self.add(g, n, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else ("iri", RDF + "nil"))
        return nodes[0] if nodes else ("iri", RDF + "nil")

    def value(self, v, term: dict, ctx: dict, g) -> tuple:
        kind = term.get("@type")
        if isinstance(v, dict):
            if "@value" not in v:
                return (self.list(v["@list"], term, ctx, g) if "@list" in v else self.node(v, ctx, g),)
            lang, dt = v.get("@language"), v.get("@type")
            if lang:
                return ("lit", v["@value"]), LANG_STRING, lang
            v, kind, ctx = v["@value"], dt, {**ctx, "lang": ""}
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return (self.ref(v, ctx, vocab=kind == "@vocab"),)
        dt = self.iri(kind, ctx) if kind and not kind.startswith("@") else None
        if isinstance(v, bool):
            return ("lit", str(v).lower()), dt or XSD + "boolean", ""
        if isinstance(v, int) or isinstance(v, float) and v.is_integer() and dt != XSD + "double" and abs(v) < 1e21:
            return ("lit", str(int(v))), dt or XSD + "integer", ""
        if isinstance(v, float):
            return ("lit", _double(v)), dt or XSD + "double", ""
        lang = term.get("@language", ctx["lang"]) if dt is None else ""
        return ("lit", v), dt or (LANG_STRING if lang else STRING), lang or ""


def _double(v: float) -> str:
    """The canonical text of a double: one digit before the point, one at least after it."""
    number, power = f"{v:.15E}".split("E")
    number = number.rstrip("0")
    return f"{number}{'0' if number.endswith('.') else ''}E{int(power)}"


def parse_jsonld(text: str, base: str = "") -> list[Row]:
    return JsonLd(base).read(text)


# Writers


def _split(iri: str) -> tuple[str, str]:
    m = re.search(r"[A-Za-z_][\w.-]*$", iri)
    if not m:
        raise DocumentError(f"{iri} can't be an XML name")
    return iri[: m.start()], m[0]


def _by_subject(rows: Iterable[Row]):
    out: dict = {}
    for g, s, s_kind, p, o, o_kind, o_dt, o_lang in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
        out.setdefault((g, s_kind, s), []).append((p, o_kind, o, o_dt, o_lang))
    return out


def to_rdfxml(rows: Iterable[Row], prefixes: dict[str, str] | None = None) -> str:
    """One rdf:Description a subject; graphs aren't in this syntax, so rows of named graphs raise."""
    spaces = {RDF: "rdf"} | {v: k for k, v in (prefixes or {}).items()}
    body = []
    for (g, kind, s), facts in _by_subject(rows).items():
        if g is not None:
            raise DocumentError("RDF/XML has no named graphs")
        body.append(f"  <rdf:Description {'rdf:about' if kind == 'iri' else 'rdf:nodeID'}={quoteattr(s)}>")
        for p, o_kind, o, dt, lang in facts:
            space, local = _split(p)
            tag = f"{spaces.setdefault(space, f'ns{len(spaces)}')}:{local}"
            if o_kind != "lit":
                body.append(f"    <{tag} {'rdf:resource' if o_kind == 'iri' else 'rdf:nodeID'}={quoteattr(o)}/>")
            else:
                said = f' xml:lang="{lang}"' if lang else "" if dt in ("", STRING) else f" rdf:datatype={quoteattr(dt)}"
                body.append(f"    <{tag}{said}>{escape(o, {chr(13): '&#13;'})}</{tag}>")
        body.append("  </rdf:Description>")
    names = "".join(f" xmlns:{k}={quoteattr(v)}" for v, k in spaces.items())
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', f"<rdf:RDF{names}>", *body, "</rdf:RDF>", ""])


def to_jsonld(rows: Iterable[Row]) -> str:
    """Flattened: every subject one object, named graphs under @graph."""
    graphs: dict = {}
    for (g, kind, s), facts in _by_subject(rows).items():
        x: dict = {"@id": s if kind == "iri" else "_:" + s}
        for p, o_kind, o, dt, lang in facts:
            ref = o if o_kind == "iri" else "_:" + o
            if p == RDF_TYPE and o_kind != "lit":
                x.setdefault("@type", []).append(ref)
            elif o_kind != "lit":
                x.setdefault(p, []).append({"@id": ref})
            else:
                x.setdefault(p, []).append({"@value": o} | ({"@language": lang} if lang else {} if dt in ("", STRING) else {"@type": dt}))
        graphs.setdefault(g, []).append(x)
    return json.dumps([*graphs.pop(None, []), *({"@id": g, "@graph": xs} for g, xs in graphs.items())], ensure_ascii=False, indent=1)


def to_trig(rows: Iterable[Row], prefixes: dict[str, str] | None = None) -> str:
    """Turtle, with a block for each named graph."""
    spaces = sorted((prefixes or {}).items(), key=lambda kv: -len(kv[1]))

    def iri(x: str) -> str:
        if x == RDF_TYPE:
            return "a"
        for k, v in spaces:
            if x.startswith(v) and re.fullmatch(r"[A-Za-z_]\w*", x[len(v) :]):
                return f"{k}:{x[len(v):]}"
        return f"<{x}>"

    def node(kind: str, x: str, dt: str = "", lang: str = "") -> str:
        if kind != "lit":
            return "_:" + x if kind == "bnode" else f"<{x}>" if x == RDF_TYPE else iri(x)
        text = '"' + x.translate({92: "\\\\", 34: '\\"', 10: "\\n", 13: "\\r", 9: "\\t"}) + '"'
        return f"{text}@{lang}" if lang else text if dt in ("", STRING) else f"{text}^^{iri(dt)}"

    out, open_ = [f"@prefix {k}: <{v}> ." for k, v in sorted((prefixes or {}).items())], None
    for (g, kind, s), facts in _by_subject(rows).items():
        if g != open_:
            out += (["}"] if open_ is not None else []) + ([f"<{g}> {{"] if g is not None else [])
            open_ = g
        by: dict[str, list[str]] = {}
        for p, *o in facts:
            by.setdefault(p, []).append(node(o[0], o[1], o[2], o[3]))
        out.append(f"{node(kind, s)} " + " ;\n    ".join(f"{iri(p)} {' , '.join(o)}" for p, o in by.items()) + " .")
    return "\n".join([*out, *(["}"] if open_ is not None else []), ""])
