"""RDF terms as structs and the scalar functions over them.

A term is a struct (kind, value, dt, lang): kind is iri, bnode or lit; value an IRI, label or lexical form; dt a datatype
IRI, "" unless a literal; lang a language tag, "" without one. Two terms are equal if all four are.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCT = "http://purl.org/dc/terms/"

#: Well-known namespaces; callers may pass their own.
PREFIXES: dict[str, str] = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "sh": SH, "skos": SKOS, "dct": DCT, "foaf": "http://xmlns.com/foaf/0.1/"}

RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"
STRING = XSD + "string"
NUMERIC = tuple(XSD + x for x in ("integer", "int", "long", "short", "byte", "decimal", "double", "float", "nonNegativeInteger", "positiveInteger"))

TERM = T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "value", "dt", "lang")])


def _s(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def term(kind, value, dt="", lang="") -> Column:
    return F.struct(_s(kind).alias("kind"), _s(value).alias("value"), _s(dt).alias("dt"), _s(lang).alias("lang"))


def iri(value) -> Column:
    return term("iri", value)


def bnode(label) -> Column:
    return term("bnode", label)


def literal(value, dt: str = STRING, lang="") -> Column:
    return term("lit", value, LANG_STRING if not isinstance(lang, Column) and lang else dt, lang)


def term_equal(a: Column, b: Column) -> Column:
    """Term equality: lexical form, datatype and language, not value."""
    return (a["value"] == b["value"]) & (a["kind"] == b["kind"]) & (a["dt"] == b["dt"]) & (a["lang"] == b["lang"])


def is_numeric(t: Column) -> Column:
    return t["dt"].isin(*NUMERIC)


def number(t: Column) -> Column:
    """A numeric literal's value as a double, else null."""
    return F.when(is_numeric(t), t["value"].try_cast("double"))


def value_equal(a: Column, b: Column) -> Column:
    """Value equality: numbers by value, else terms."""
    return F.when(is_numeric(a) & is_numeric(b), number(a) == number(b)).otherwise(term_equal(a, b))


# IRIs


def expand_curie(c: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """prefix:local to an IRI. Unchanged: no colon, a local part that begins with /, an unknown prefix."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    prefix, local = F.substring_index(c, ":", 1), F.substr(c, F.instr(c, ":") + 1)
    known = F.try_element_at(table, prefix)
    return F.when(~c.contains(":") | local.startswith("/") | known.isNull(), c).otherwise(F.concat(known, local))


def expand_curie_text(text: str, prefixes: Mapping[str, str] = PREFIXES) -> str:
    """expand_curie for a text of the plan."""
    prefix, colon, local = text.partition(":")
    return prefixes[prefix] + local if colon and not local.startswith("/") and prefix in prefixes else text


def namespace(c: Column) -> Column:
    """The IRI up to its last #, else its last /."""
    return F.regexp_extract(c, r"^(.*#|[^#]*/)", 1)


def local_name(c: Column) -> Column:
    """What follows the last #, else the last /."""
    return F.regexp_extract(c, r"^(?:.*#|[^#]*/)?(.*)$", 1)


def shorten_iri(c: Column, prefixes: Mapping[str, str] = PREFIXES, strict: bool = True) -> Column:
    """prefix:local of an IRI split before its last NCName; an unknown namespace raises, or stays if not strict."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in (kv[1], kv[0])])
    local = F.regexp_extract(c, r"([\p{L}_][\p{L}\p{N}._-]*)$", 1)
    space = F.substring(c, F.lit(1), F.length(c) - F.length(local))
    known = F.try_element_at(table, space)
    bad = F.raise_error(F.concat(F.lit("unknown namespace of "), c)).cast("string") if strict else c
    return F.when(c.isNull(), c).when(known.isNull(), bad).otherwise(F.concat(known, F.lit(":"), local))


def camel_short(c: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """prefixLocalName of an IRI."""
    short = shorten_iri(c, prefixes)
    local = F.substr(short, F.instr(short, ":") + 1)
    return F.concat(F.substring_index(short, ":", 1), F.upper(F.substring(local, 1, 1)), F.substr(local, F.lit(2)))


def camel_expand(c: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """The IRI of a prefixLocalName: the prefix ends before the first capital."""
    prefix, rest = F.regexp_extract(c, r"^([^\p{Lu}]*)", 1), F.regexp_extract(c, r"^[^\p{Lu}]*(.*)$", 1)
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return F.concat(F.try_element_at(table, prefix), F.lower(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))


#: Characters that need no percent-encoding in each component of a URI (RFC 3986): unreserved ones, and those named.
UNRESERVED = r"A-Za-z0-9._~\-"
SUB = "!$&'()*+,;="
COMPONENTS: dict[str, str] = {
    "scheme": r"A-Za-z0-9+.\-", "authority": UNRESERVED + SUB + ":@", "user_info": UNRESERVED + SUB + ":", "host": UNRESERVED + SUB, "port": "0-9",
    "path": UNRESERVED + SUB + ":@/", "path_segment": UNRESERVED + SUB + ":@", "query": UNRESERVED + SUB + ":@/?", "query_param": UNRESERVED + "!$'()*,;:@/?", "fragment": UNRESERVED + SUB + ":@/?", "uri": UNRESERVED,
}


def percent_encode(c: Column, component: str = "path_segment") -> Column:
    """UTF-8 bytes of characters outside the component's as %XX, in JVM code."""
    keep = COMPONENTS[component].replace("[", r"\[")
    parts = F.regexp_extract_all(c, F.lit(f"([{keep}]+|[^{keep}]+)"), 1)
    code = lambda x: F.when(x.rlike(f"^[{keep}]"), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "utf-8")), "(..)", "%$1"))
    return F.array_join(F.transform(parts, code), "")


def percent_decode(c: Column) -> Column:
    """%XX sequences as UTF-8; a plus stays a plus."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def is_absolute_iri(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*$")


def property_path_iri(path: Column, base: str = "urn:path/") -> Column:
    return F.concat(F.lit(base), percent_encode(path))


def iri_property_path(c: Column, base: str = "urn:path/") -> Column:
    return percent_decode(F.substr(c, F.lit(len(base) + 1)))


# Texts of terms


def escape(c: Column) -> Column:
    """A lexical form between quotation marks."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ntriples(t: Column) -> Column:
    """The N-Triples text of a term."""
    tail = F.when(t["lang"] != "", F.concat(F.lit("@"), t["lang"])).when((t["dt"] == STRING) | (t["dt"] == ""), F.lit("")).otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    return (
        F.when(t["kind"] == "iri", F.concat(F.lit("<"), t["value"], F.lit(">")))
        .when(t["kind"] == "bnode", F.concat(F.lit("_:"), t["value"]))
        .otherwise(F.concat(F.lit('"'), escape(t["value"]), F.lit('"'), tail))
    )


def sparql_literal(t: Column) -> Column:
    """A literal for an update text: three single quotes, backslashes and quotes escaped, language or datatype behind."""
    body = F.replace(F.replace(t["value"], F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    tail = F.when(t["lang"] != "", F.concat(F.lit("@"), t["lang"])).otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    return F.concat(F.lit("'''"), body, F.lit("'''"), tail)


def parse_term(c: Column) -> Column:
    """The term of an N-Triples text; null where it is none."""
    lexical = F.regexp_extract(c, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        lexical = F.replace(lexical, F.lit(a), F.lit(b))
    lexical = F.replace(lexical, F.lit("\\\\"), F.lit("\\"))
    lang, dt = F.regexp_extract(c, r'(?s)"@([A-Za-z0-9-]+)$', 1), F.regexp_extract(c, r'(?s)"\^\^<([^>]*)>$', 1)
    kind = F.when(lang != "", F.lit(LANG_STRING)).when(dt != "", dt).otherwise(F.lit(STRING))
    return (
        F.when(c.rlike(r"^<[^<>\s]*>$"), iri(F.substr(c, F.lit(2), F.length(c) - 2)))
        .when(c.rlike(r"^_:\S+$"), bnode(F.substr(c, F.lit(3))))
        .when(c.rlike(r'(?s)^".*"(@[A-Za-z0-9-]+|\^\^<[^>]*>)?$'), term("lit", lexical, kind, lang))
    )


def node_text(t: Column) -> Column:
    """IRI or lexical form; "" for a blank node."""
    return F.when(t["kind"] == "bnode", F.lit("")).otherwise(t["value"])


# JSON values


def as_string(t: Column) -> Column:
    """For JSON: null for the IRI text null, an error for a blank node."""
    bad = F.raise_error(F.lit("a blank node has no JSON value")).cast("string")
    return F.when(t["kind"] == "bnode", bad).when((t["kind"] == "iri") & (t["value"] == "null"), F.lit(None)).otherwise(t["value"])


def as_boolean(t: Column) -> Column:
    return F.when(t["value"].isin("true", "1"), True).when(t["value"].isin("false", "0"), False)


def as_integer(t: Column) -> Column:
    return t["value"].try_cast("long")


def as_decimal(t: Column) -> Column:
    return t["value"].try_cast("double")


def language_map(values: Column) -> Column:
    """Array of terms to a map from language to text; the last of a language wins."""
    kept = F.aggregate(
        values,
        F.create_map().cast("map<string,string>"),
        lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != t["lang"]), F.create_map(t["lang"], t["value"])),
    )
    return kept


def language_set(values: Column) -> Column:
    """The languages of an array of terms."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda t: t["lang"])))


# Digests and templates


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_key(c: Column) -> Column:
    return F.md5(c)


def render_template(template: str, values: Mapping[str, object], missing: str | None = None) -> str:
    """#{[name]} places of a text of the plan. A name without a value raises, or becomes `missing`. Never for SQL."""

    def fill(m: re.Match) -> str:
        if m[1] in values:
            return str(values[m[1]])
        if missing is None:
            raise KeyError(m[1])
        return missing

    return re.sub(r"#\{\[['\"]?(\w+)['\"]?\]\}", fill, template)


def regex_groups(c: Column, pattern: str) -> Column:
    """A map of a pattern's named groups to what they match; null where it doesn't match as a whole."""
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    index = {n: i for n, i in re.compile(pattern.replace("(?<", "(?P<")).groupindex.items()}
    pairs = [x for n in names for x in (F.lit(n), F.regexp_extract(c, f"^(?:{pattern})$", index[n]))]
    return F.when(c.rlike(f"^(?:{pattern})$"), F.create_map(*pairs))
