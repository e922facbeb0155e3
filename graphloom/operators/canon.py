"""Canonical forms: digests over blank nodes, order-independent hashes, canonical order, skolem IRIs, sorted text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.operators.ranks import ranked
from graphloom.sources.quads import set_of
from graphloom.sources.shared import cut, in_order

SKOLEM = "/.well-known/genid/"


class DigestError(ValueError):
    """Blank nodes in a cycle have no digest here."""


def triple_text(blank: str | None = "") -> Column:
    """The N-Triples text of a quad without its graph; blank nodes become `blank` (None: their labels stay)."""
    s, o = terms.term(F.col("s_kind"), F.col("s")), terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    st, ot = terms.ntriples(s), terms.ntriples(o)
    if blank is not None:
        st = F.when(F.col("s_kind") == "bnode", F.lit(blank)).otherwise(st)
        ot = F.when(F.col("o_kind") == "bnode", F.lit(blank)).otherwise(ot)
    return F.concat_ws(" ", st, F.concat(F.lit("<"), F.col("p"), F.lit(">")), ot)


def blank_digests(quads: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, digest) of every blank node: SHA-256 of the sorted digests of its triples, leaves first.

    One join and one aggregation a level of nesting; raises where nodes are left that never become ready (a cycle).
    """
    own = set_of(quads).where(F.col("s_kind") == "bnode")
    nodes = set_of(quads).select(F.explode(F.array(F.when(F.col("s_kind") == "bnode", F.col("s")), F.when(F.col("o_kind") == "bnode", F.col("o")))).alias("node")).where("node is not null").distinct()
    done = cut(nodes.join(own.select(F.col("s").alias("node")), "node", "left_anti").select("node", F.sha2(F.lit(""), 256).alias("digest")))
    have, total = done.count(), nodes.count()
    for _ in range(max_depth):
        if have == total:
            return done
        child = done.select(F.col("node").alias("o_node"), "digest").hint("merge")  # files of like digests are small, their rows aren't
        rows = own.join(child, (F.col("o_kind") == "bnode") & (F.col("o") == F.col("o_node")), "left")
        ready = rows.groupBy(F.col("s").alias("node")).agg(
            F.max((F.col("o_kind") == "bnode") & F.col("digest").isNull()).alias("waits"),
            F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat(F.coalesce("digest", F.lit("")), triple_text()), 256))), ""), 256).alias("digest"),
        )
        done = cut(done.unionByName(ready.where(~F.col("waits")).select("node", "digest").join(done.hint("merge"), "node", "left_anti")))
        now = done.count()
        if now == have:
            break
        have = now
    if have != total:
        raise DigestError(f"{total - have} blank nodes in cycles or too deep")
    return done


def model_digest(quads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row with digest (or one for each value of `by`, such as the graph): it depends on no row order or blank label.

    Roots are triples of IRIs, and of blank nodes that are never objects.
    """
    by = by or []
    quads = set_of(quads)
    d = blank_digests(quads)
    objects = quads.where(F.col("o_kind") == "bnode").select(F.col("o").alias("s")).distinct()
    inner = quads.where(F.col("s_kind") == "bnode").join(objects, "s", "left_semi")
    roots = quads.join(inner.select("s").distinct().withColumn("_in", F.lit(True)), "s", "left").where((F.col("s_kind") == "iri") | F.col("_in").isNull())
    rows = roots.join(d.hint("merge"), (F.col("o_kind") == "bnode") & (F.col("o") == F.col("node")), "left")
    one = F.sha2(F.concat(F.coalesce("digest", F.lit("")), triple_text()), 256)
    return joined_sha256(rows.select(*by, one.alias("d")), "d", by)


def joined_sha256(texts: DataFrame, column: str, by: list[str], order: list[Column] | None = None, between: str = "") -> DataFrame:
    """by and digest: the SHA-256 of the texts of each value of by, in order (their own by default), one after another.

    SHA-256 needs its input in one sequence, but not at once: sorted partitions stream through it. Without by the sort itself
    is parallel, and one task streams over its partitions; the driver gets the digest alone.
    """
    order = order or [F.col(column)]
    gap = between.encode()
    if not by:

        def whole(batches):
            import pyarrow as pa

            sha, last = hashlib.sha256(), -1
            for batch in batches:
                ids = batch.column(0)
                if batch.num_rows:
                    if ids[0].as_py() <= last:
                        raise DigestError("sorted partitions out of order")
                    block = gap.join(x.encode() for x in batch.column(1).to_pylist())
                    sha.update(gap + block if last >= 0 else block)
                    last = ids[-1].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()])], names=["digest"])

        rows = cut(texts.orderBy(*order).select(F.monotonically_increasing_id().alias("id"), F.col(column).alias("text")), "sorted")
        return in_order(rows).mapInArrow(whole, "digest string")

    keys = [f"k{i}" for i in range(len(by))]
    flat = texts.select(F.to_json(F.struct(*by)).alias("key"), *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(column).alias("text"), F.struct(*order).alias("place"))
    dealt = flat.repartition("key").sortWithinPartitions("key", "place").drop("place")

    def run(batches):
        import pyarrow as pa

        key, sha, at = None, None, None

        def told():
            return pa.RecordBatch.from_arrays([*(c.slice(0, 1) for c in at), pa.array([sha.hexdigest()])], names=[*keys, "digest"])

        for batch in batches:
            for i, (k, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())):
                if sha is None or k != key:
                    if sha is not None:
                        yield told()
                    key, sha, at = k, hashlib.sha256(text.encode()), [batch.column(c).slice(i, 1) for c in keys]
                else:
                    sha.update(gap + text.encode())
        if sha is not None:
            yield told()

    schema = ", ".join(f"{k} {flat.schema[k].dataType.simpleString()}" for k in keys) + ", digest string"
    return dealt.mapInArrow(run, schema).withColumnsRenamed(dict(zip(keys, by)))


def model_hash(quads: DataFrame) -> DataFrame:
    """One row with hash: xor_hash() of a graph without blank nodes, the SHA-256 of its sorted Turtle with some."""
    quads = set_of(quads)
    if not quads.where((F.col("s_kind") == "bnode") | (F.col("o_kind") == "bnode")).limit(1).count():
        return xor_hash(quads)
    blocks = sorted_turtle(quads, sort=False)
    return joined_sha256(blocks, "text", [], [F.col("rank"), F.col("s")], between="\n\n").withColumnRenamed("digest", "hash")


def xor_hash(quads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row with hash: the XOR of the SHA-256 of all distinct triples, for graphs without blank nodes; none: 32 zero bytes.

    Eight slices of 32 bits, so the partial aggregation before the shuffle sends 64 bytes a group.
    """
    by = by or []
    t = set_of(quads).select(*by, F.sha2(triple_text(None), 256).alias("d"))
    slices = [F.bit_xor(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"x{i}") for i in range(8)]
    text = F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(F.col(f"x{i}"), F.lit(0)))), 8, "0") for i in range(8)])
    return t.groupBy(*by).agg(*slices).select(*by, text.alias("hash"))


def relabel(quads: DataFrame) -> DataFrame:
    """Blank nodes labelled by their digests; nodes of equal content become one."""
    d = blank_digests(quads)
    s, o = (d.select(F.col("node").alias(f"_{x}"), F.col("digest").alias(f"_{x}d")).hint("merge") for x in "so")
    rows = quads.join(s, (F.col("s_kind") == "bnode") & (F.col("s") == F.col("_s")), "left").join(o, (F.col("o_kind") == "bnode") & (F.col("o") == F.col("_o")), "left")
    return set_of(rows.select("g", F.coalesce("_sd", "s").alias("s"), "s_kind", "p", F.coalesce("_od", "o").alias("o"), "o_kind", "o_dt", "o_lang"))


def canonical_order() -> list[Column]:
    """IRIs before blank nodes; subject, predicate; objects IRI, literal, blank node; language, datatype, text."""
    return [
        F.when(F.col("s_kind") == "iri", 0).otherwise(1), F.col("s"), F.col("p"),
        F.when(F.col("o_kind") == "iri", 0).when(F.col("o_kind") == "lit", 1).otherwise(2), F.col("o_lang"), F.col("o_dt"), F.col("o"),
    ]


def canonical_sort(quads: DataFrame) -> DataFrame:
    """Distinct quads, blank nodes relabelled, in canonical order."""
    return relabel(quads).orderBy(*canonical_order())


def canonical_ranks(quads: DataFrame) -> DataFrame:
    """Distinct quads, blank nodes relabelled, with n: the place in canonical order, from 1."""
    return ranked(relabel(quads), *canonical_order()).withColumn("n", F.col("n") + 1)


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    return model_digest(a).first() == model_digest(b).first()


def skolemize(quads: DataFrame, base: str = "urn:skolem") -> DataFrame:
    """Blank nodes as IRIs <base>/.well-known/genid/<label>."""
    to = lambda c: F.concat(F.lit(base + SKOLEM), c)
    return quads.select(
        "g", F.when(F.col("s_kind") == "bnode", to(F.col("s"))).otherwise(F.col("s")).alias("s"), F.lit("iri").alias("s_kind"), "p",
        F.when(F.col("o_kind") == "bnode", to(F.col("o"))).otherwise(F.col("o")).alias("o"), F.when(F.col("o_kind") == "bnode", "iri").otherwise(F.col("o_kind")).alias("o_kind"), "o_dt", "o_lang",
    )


def deskolemize(quads: DataFrame, base: str = "urn:skolem") -> DataFrame:
    """The blank node back from each such IRI."""
    root = base + SKOLEM
    back = lambda c, k: F.when((k == "iri") & c.startswith(root), F.substr(c, F.lit(len(root) + 1))).otherwise(c)
    kind = lambda c, k: F.when((k == "iri") & c.startswith(root), F.lit("bnode")).otherwise(k)
    s, sk, o, ok = F.col("s"), F.col("s_kind"), F.col("o"), F.col("o_kind")
    return quads.select("g", back(s, sk).alias("s"), kind(s, sk).alias("s_kind"), "p", back(o, ok).alias("o"), kind(o, ok).alias("o_kind"), "o_dt", "o_lang")


def sorted_turtle(quads: DataFrame, sort: bool = True) -> DataFrame:
    """(rank, s, subject, text) in order: one Turtle block a subject, its predicates and objects in canonical order.

    Predicates stand under each other, padded to the longest; objects of one stand under each other, too.
    """
    rows = relabel(quads)
    s, o = terms.term(F.col("s_kind"), F.col("s")), terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    place = F.struct(F.when(F.col("o_kind") == "iri", 0).when(F.col("o_kind") == "lit", 1).otherwise(2).alias("k"), "o_lang", "o_dt", "o", terms.ntriples(o).alias("text"))
    rank = F.when(F.col("s_kind") == "iri", 0).otherwise(1).alias("rank")
    lines = rows.groupBy(rank, "s", terms.ntriples(s).alias("subject"), "p").agg(F.array_sort(F.collect_set(place)).alias("objects"))
    short = F.when(F.col("p") == terms.RDF_TYPE, F.lit("a")).otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">")))
    lines = lines.select("rank", "s", "subject", F.struct("p", short.alias("name"), F.col("objects.text").alias("objects")).alias("line"))
    blocks = lines.groupBy("rank", "s", "subject").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    text = F.expr("""concat(subject, '\n', array_join(transform(lines, x -> concat(rpad(x.name, width + 1, ' '), array_join(transform(x.objects,
        (o, i) -> concat(if(i = 0, '', repeat(' ', width + 1)), ' ', o, if(i + 1 < size(x.objects), ',', ';'), '\n')), ''))), ''), '.')""")
    blocks = blocks.withColumn("width", F.expr("array_max(transform(lines, x -> length(x.name)))")).select("rank", "s", "subject", text.alias("text"))
    return blocks.orderBy("rank", "s") if sort else blocks
