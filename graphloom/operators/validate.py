"""Validation of instances against a profile: value rules, cardinalities, and report quads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, SH, XSD
from graphloom.operators.access import find_all, raw_values, rule_test
from graphloom.operators.profile import Profile
from graphloom.sources.quads import COLUMNS, as_source, set_of


def check_values(source, profile: Profile, type_id: str) -> DataFrame:
    """(s, attribute, rule, value, conforms): every value of every attribute against each rule of its range."""
    source, parts = as_source(source), []
    instances = find_all(source, profile, type_id)
    for name, a in profile.attributes(type_id).items():
        for r in a.range:
            rows = raw_values(source, a).join(instances, "s", "left_semi")
            rows, fine = rule_test(source, profile, [r], F.col("value"), rows)
            parts.append(rows.select("s", F.lit(name).alias("attribute"), F.lit(r.name).alias("rule"), "value", F.coalesce(fine, F.lit(False)).alias("conforms")))
    return reduce(DataFrame.unionByName, parts)


def check_cardinalities(source, profile: Profile, type_id: str) -> DataFrame:
    """(s, attribute, rule, limit, n): violations only. Instances without a value count 0; limits per language compare.

    Language limits hold for the least and the most frequent language of a subject.
    """
    source, parts = as_source(source), []
    instances = find_all(source, profile, type_id)
    for name, a in profile.attributes(type_id).items():
        low, high = a.min, a.max
        lang_low, lang_high = max(a.of("minLangCardinality"), default=None), min(a.of("maxLangCardinality"), default=None)
        if low is None and high is None and lang_low is None and lang_high is None:
            continue
        values = raw_values(source, a)
        if low is not None or high is not None:
            n = values.groupBy("s").agg(F.count("*").alias("n"))
            n = instances.join(n, "s", "left").select("s", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
            for rule, limit, bad in (("minCardinality", low, F.col("n") < (low or 0)), ("maxCardinality", high, F.col("n") > (high or 0))):
                if limit is not None:
                    parts.append(n.where(bad).select("s", F.lit(name).alias("attribute"), F.lit(rule).alias("rule"), F.lit(limit).alias("limit"), "n"))
        if lang_low is not None or lang_high is not None:
            by = values.join(instances, "s", "left_semi").where(F.col("value.lang") != "").groupBy("s", "value.lang").agg(F.count("*").alias("k"))
            by = by.groupBy("s").agg(F.min("k").alias("least"), F.max("k").alias("most"))
            for rule, limit, c in (("minLangCardinality", lang_low, "least"), ("maxLangCardinality", lang_high, "most")):
                if limit is not None:
                    bad = F.col(c) < limit if c == "least" else F.col(c) > limit
                    parts.append(by.where(bad).select("s", F.lit(name).alias("attribute"), F.lit(rule).alias("rule"), F.lit(limit).alias("limit"), F.col(c).alias("n")))
    return reduce(DataFrame.unionByName, parts) if parts else instances.limit(0).select("s", *[F.lit(None).cast(k).alias(c) for c, k in (("attribute", "string"), ("rule", "string"), ("limit", "int"), ("n", "long"))])


def report(violations: DataFrame) -> DataFrame:
    """Report quads of rows with s, attribute and rule: a validation result each, named by a digest of the row."""
    node = F.concat(F.lit("r"), F.substring(F.sha2(F.to_json(F.struct(*violations.columns)), 256), 1, 32))
    facts = F.array(
        F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(SH + "ValidationResult").alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt")),
        F.struct(F.lit(SH + "focusNode").alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt")),
        F.struct(F.lit(SH + "resultPath").alias("p"), F.col("attribute").alias("o"), F.lit("lit").alias("o_kind"), F.lit(XSD + "string").alias("o_dt")),
        F.struct(F.lit(SH + "resultMessage").alias("p"), F.col("rule").alias("o"), F.lit("lit").alias("o_kind"), F.lit(XSD + "string").alias("o_dt")),
    )
    rows = violations.select(node.alias("s"), F.explode(facts).alias("f"))
    return set_of(rows.select(F.lit(None).cast("string").alias("g"), "s", F.lit("bnode").alias("s_kind"), "f.p", "f.o", "f.o_kind", "f.o_dt", F.lit("").alias("o_lang")).select(*COLUMNS))
