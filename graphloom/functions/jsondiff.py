"""Reading of JSON documents into quads, and differences of JSON values: plain Python that workers run."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
RESOURCE = "http://www.w3.org/2000/01/rdf-schema#Resource"


class ConversionError(ValueError):
    """A graph or document that its profile doesn't allow."""


def json_reader(types: Mapping[str, tuple], prefixes: Mapping[str, str]) -> Callable[[str], Iterator[tuple]]:
    """A function from a document's text to quads; types: (classes, attribute -> (IRI, whether inverse)) by type."""

    def expand(key: str) -> str:
        p, _, local = key.partition(":")
        return prefixes[p] + local if p in prefixes else key

    def rows(text: str) -> Iterator[tuple]:
        doc = json.loads(text)
        for r in [doc["data"], *doc.get("included", [])]:
            classes, attributes = types[r["type"]]
            for c in classes:
                yield (None, r["uri"], "iri", RDF_TYPE, c, "iri", "", "")
            for name, by_type in (r.get("attributes") or {}).items():
                if name not in attributes:
                    raise ConversionError(f"{r['type']} has no attribute {name}")
                uri, inverse = attributes[name]
                for key, values in by_type.items():
                    dt = expand(key)
                    if isinstance(values, dict):
                        pairs = [(lang, x) for lang, xs in values.items() for x in (xs if isinstance(xs, list) else [xs])]
                    else:
                        pairs = [("", x) for x in (values if isinstance(values, list) else [values])]
                    for lang, x in pairs:
                        if x is None or isinstance(x, str) and not x.strip():
                            continue
                        lex = ("true" if x else "false") if isinstance(x, bool) else str(x)
                        if key == "references" or dt == RESOURCE:
                            yield (None, lex, "iri", uri, r["uri"], "iri", "", "") if inverse else (None, r["uri"], "iri", uri, lex, "iri", "", "")
                        else:
                            yield (None, r["uri"], "iri", uri, lex, "lit", LANG_STRING if lang else dt, lang)

    return rows


def diff(a, b, path: str = "", ignore: Sequence[str] = (), ordered: Sequence[str] = (), id_field: str = "id", tolerance: float = 1e-7) -> list[tuple]:
    """(path, kind, old, new) between two JSON values.

    Arrays of objects pair by id (the first match, which may pair again); of texts and booleans compare as sets unless
    their field is in `ordered`; of numbers by place. Floats within the tolerance are equal.
    """

    def name(x):
        return "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "decimal" if isinstance(x, float) else "string" if isinstance(x, str) else type(x).__name__

    out: list[tuple] = []
    say = lambda p, kind, x=None, y=None: out.append((p, kind, None if x is None else json.dumps(x, sort_keys=True), None if y is None else json.dumps(y, sort_keys=True)))
    if a is None and b is None:
        return out
    both_numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted(set(a) | set(b)):
            if k in ignore:
                continue
            if k not in b:
                say(f"{path}.{k}", "field_only_in_from", a[k])
            elif k not in a:
                say(f"{path}.{k}", "field_only_in_to", None, b[k])
            else:
                out += diff(a[k], b[k], f"{path}.{k}", ignore, ordered, id_field, tolerance)
    elif isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            say(path, "different_array_size", len(a), len(b))
        objects = all(isinstance(x, dict) and id_field in x for x in [*a, *b])
        field = path.rsplit(".", 1)[-1]
        if objects:
            for x in a:
                y = next((y for y in b if y[id_field] == x[id_field]), None)
                if y is None:
                    say(f"{path}[{x[id_field]}]", "element_only_in_from", x)
                else:
                    out += diff(x, y, f"{path}[{x[id_field]}]", ignore, ordered, id_field, tolerance)
            for y in b:
                if not any(x[id_field] == y[id_field] for x in a):
                    say(f"{path}[{y[id_field]}]", "element_only_in_to", None, y)
        elif field not in ordered and all(isinstance(x, (str, bool)) for x in [*a, *b]):
            for x in sorted(map(str, set(a) - set(b))):
                say(path, "element_only_in_from", x)
            for y in sorted(map(str, set(b) - set(a))):
                say(path, "element_only_in_to", None, y)
        else:
            for i, (x, y) in enumerate(zip(a, b)):
                out += diff(x, y, f"{path}[{i}]", ignore, ordered, id_field, tolerance)
    elif both_numbers and (isinstance(a, float) or isinstance(b, float)):
        if abs(a - b) > tolerance:
            say(path, "different_decimal_values", a, b)
    elif name(a) != name(b):
        say(path, "different_node_types", a, b)
    elif a != b:
        say(path, f"different_{name(a)}_values", a, b)
    return out
