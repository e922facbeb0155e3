"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become arrays of word hashes. Of every SPAN consecutive words, the least hash of the K-grams inside is kept as a
fingerprint, so two texts that share SPAN words share a fingerprint whatever stands around. Fingerprints of documents
join those of the benchmark; hits extend: for the documents that have one, every window of SPAN words is held against the
benchmark's windows exactly. An item of fewer words is one window, and its length joins the fingerprints unthinned.

The documents' side is never shuffled by fingerprint while the benchmark's fits a broadcast (common.sized() sums
its bytes first); beyond that both joins are plain ones that Spark may shuffle and split. What is grouped by document shrinks
before it is shuffled.

Defined cases: a null or empty text has no words; a null item_id counts as the text "null"; repeated documents give a row
each; items that repeat or share windows all count; an empty benchmark hits nothing; further columns are not read by find()
and pass through clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, sized

#: Words of a window, and of the K-grams that are hashed.
SPAN, K = 10, 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """An array of the hashes of a text's words, lower-cased in A-Z only."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")
    lowered = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(words, lambda w: F.xxhash64(lowered(w)))


def _grams(h: str, n: int) -> str:
    """SQL for the hashes of all n-grams of an array of word hashes (none: an empty array)."""
    parts = ", ".join(f"get({h}, i + {j})" for j in range(n))
    return f"if(size({h}) < {n}, array(), transform(sequence(0, size({h}) - {n}), i -> xxhash64({n}, {parts})))"


def _windows(h: str, n: int) -> str:
    """SQL for all n-grams of an array of word hashes, each by two hashes: 128 bits that decide."""
    parts = ", ".join(f"get({h}, i + {j})" for j in range(n))
    back = ", ".join(f"get({h}, i + {j})" for j in reversed(range(n)))
    return f"if(size({h}) < {n}, array(), transform(sequence(0, size({h}) - {n}), i -> named_struct('w', xxhash64({n}, {parts}), 'v', xxhash64({back}, {n}))))"


def _winnowed(g: str) -> str:
    """SQL for the distinct least K-gram hashes of all windows of SPAN words."""
    width = SPAN - K + 1
    return f"if(size({g}) < {width}, array(), array_distinct(transform(sequence(0, size({g}) - {width}), i -> array_min(slice({g}, i + 1, {width})))))"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return _find(docs, benchmark).drop("text_hash")


def _find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find(), and text_hash."""
    items = materialize(
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), word_hashes(F.col("text")).alias("h"))
        .where(F.size("h") > 0)
        .withColumn("g", F.expr(_grams("h", K))),
        "items",
    )
    short = sorted(r["n"] for r in items.where(F.size("h") < SPAN).select(F.size("h").alias("n")).distinct().collect())  # of 1 to 9
    lengths = [*short, SPAN]
    windows = None
    for n in lengths:
        of = items.where(F.size("h") >= SPAN) if n == SPAN else items.where(F.size("h") == n)
        of = of.select(F.lit(n).alias("n"), F.explode(F.expr(_windows("h", n))).alias("x"), "item").select("n", "x.w", "x.v", "item")
        windows = of if windows is None else windows.unionAll(of)
    windows = materialize(windows.groupBy("n", "w", "v").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    prints = items.where(F.size("h") >= SPAN).select(F.explode(F.expr(_winnowed("g"))).alias("f"))
    prints = prints.unionAll(windows.where(F.col("n") < SPAN).select(F.col("w").alias("f"))).distinct()

    # fingerprints of the documents, those of short items' lengths unthinned
    key = [F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash")]
    hashed = docs.select(*key, word_hashes(F.col("text")).alias("h")).withColumn("g", F.expr(_grams("h", K)))
    probes = f"concat({', '.join([_winnowed('g'), *(_grams('h', n) for n in short)])})"
    probed = hashed.select("row", "doc_id", "text_hash", F.size("h").cast("long").alias("n_words"), F.explode_outer(F.expr(probes)).alias("f"))
    flagged = probed.join(sized(prints).withColumn("hit", F.lit(1)), "f", "left")
    met = materialize(
        flagged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.max("hit").alias("hit")),
        "met",
    )

    # extension: all windows of the documents that met a fingerprint
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["text_hash"].eqNullSafe(b["text_hash"])
    wanted = sized(met.where("hit = 1").select("doc_id", "text_hash").distinct())
    again = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    again = again.join(wanted, same(again, wanted), "left_semi").withColumn("h", word_hashes(F.col("text")))
    shown = None
    for n in lengths:
        at = again.select("doc_id", "text_hash", F.lit(n).alias("n"), F.posexplode(F.expr(_windows("h", n))).alias("at", "x"))
        shown = at if shown is None else shown.unionAll(at)
    shown = shown.select("doc_id", "text_hash", "n", "at", "x.w", "x.v")
    hits = shown.join(sized(windows), ["n", "w", "v"]).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    covered = """aggregate(spans, named_struct('n', 0L, 'end', 0L), (a, x) -> named_struct(
        'n', a.n + greatest(0L, x.at + x.n - greatest(a.end, cast(x.at as bigint))), 'end', greatest(a.end, cast(x.at + x.n as bigint))), a -> a.n)"""
    hits = hits.select("doc_id", "text_hash", F.expr(covered).alias("n_hit"), "items")
    out = met.alias("m").join(hits.alias("x"), same(met, hits), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        met["doc_id"],
        met["text_hash"],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; rows go by doc_id and text, so others with their id, or with none, stay."""
    gone = sized(materialize(_find(docs, benchmark).where("contaminated").select("doc_id", "text_hash").distinct(), "gone"))
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")
