"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of language bits for each slot. An n-gram's slots, ANDed, give all languages that
contain it. A text's n-grams add to the popcount of each language that they return; from a popcount we take the false
positives that the language's fill rate predicts, and the largest corrected count decides.

Fitting takes at most about `per_language` labelled documents of each language, chosen by a hash of doc_id; labels come
from the training fold only. The filter has a fixed number of slots, so what the driver collects and sends is bounded
(`slots` rows) whatever the corpus.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; ties go to the first language in
order of name; with no labelled document every text is `und`; documents with a null id never teach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import STEP, code_points, column_names, held_out, in_training_fold, letter_fold, map_texts, mix64, text_slices, trimmed

#: n-gram sizes, in code points of lower-cased letters with runs of anything else as one space.
SIZES = (2, 3, 4)
#: Slots of the filter and slots that an n-gram sets.
SLOTS, PROBES = 1 << 20, 3
#: n-grams that a task holds at once when it counts.
HELD = 500_000
#: Labelled documents of each language that a fit takes.
PER_LANGUAGE = 2000
#: An n-gram counts as a language's if it is in at least so many of its sampled documents ...
LEAST_DOCS = 2
#: ... and at least this share as frequent in it as in the language that has it most.
LEAST_SHARE = 0.1


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    bits: np.ndarray  # (slots, words) uint64
    false_positive: np.ndarray  # per language


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts and the index of the text of each; a text's edges count as spaces."""
    points, owner = code_points(texts)
    folded = letter_fold()[points]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    hashes, owners, h = [], [], folded
    for n in range(2, max(SIZES) + 1):
        h = (h[:-1] * STEP) ^ folded[n - 1 :]
        if n in SIZES:
            inside = owner[: len(h)] == owner[n - 1 :]
            hashes.append(mix64(h[inside] * np.uint64(8) + np.uint64(n)))
            owners.append(owner[n - 1 :][inside])
    return np.concatenate(hashes), np.concatenate(owners)


def _slots(h: np.ndarray, probe: int, slots: int) -> np.ndarray:
    return ((h >> np.uint64(20 * probe)) & np.uint64(slots - 1)).astype(np.int64)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, slots: int = SLOTS) -> LanguageFilters:
    """Filters from text and lang of the training fold; at most about per_language documents a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training_fold(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    words = max(1, -(-len(languages) // 64))
    bits = np.zeros((slots, words), dtype=np.uint64)
    if not languages:
        return LanguageFilters((), bits, np.zeros(0))
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    place = (F.abs(F.xxhash64("doc_id") % 1_000_000)) / 1_000_000
    index = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    sample = labelled.where(place < rate[F.col("lang")]).select(index[F.col("lang")].alias("i"), "text")

    def count(batches):
        held, size = [], 0

        def summed():
            key = np.concatenate(held)
            key = key[np.lexsort((key[:, 1], key[:, 0]))]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            n = np.diff(np.append(first, len(key)))
            return pa.RecordBatch.from_arrays([pa.array(key[first, 0]), pa.array(key[first, 1].astype(np.int32)), pa.array(n)], names=["h", "i", "n"])

        for batch in batches:
            index = batch.column("i").to_numpy()
            for a, texts in text_slices(batch.column("text")):
                h, owner = _grams(texts)
                _, once = np.unique(mix64(h + (owner + 1).astype(np.uint64) * STEP), return_index=True)  # once for each text
                held.append(np.stack([h[once].view(np.int64), index[a + owner[once]].astype(np.int64)], axis=1))
                size += len(once)
                if size > HELD:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    sampled = sample.groupBy("i").count()
    frequent = sample.select("i", "text").mapInArrow(trimmed(count), "h long, i int, n long").groupBy("h", "i").agg(F.sum("n").alias("n"))
    shares = frequent.join(F.broadcast(sampled), "i").select("h", "i", "n", (F.col("n") / F.col("count")).alias("share"))
    grams = (
        shares.groupBy("h")
        .agg(F.max("share").alias("top"), F.collect_list(F.struct("i", "n", "share")).alias("of"))
        .select("h", "top", F.explode("of").alias("x"))
        .where((F.col("x.n") >= LEAST_DOCS) & (F.col("x.share") >= LEAST_SHARE * F.col("top")))
    )
    masks = grams.groupBy("h").agg(
        *[F.expr(f"bit_or(if(x.i div 64 = {w}, shiftleft(1L, x.i % 64), 0L))").alias(f"w{w}") for w in range(words)]
    )
    probes = F.explode(F.array(*[F.shiftrightunsigned("h", 20 * k).bitwiseAND(slots - 1) for k in range(PROBES)]))
    rows = (
        masks.select(probes.alias("slot"), *[f"w{w}" for w in range(words)])
        .groupBy("slot")
        .agg(*[F.expr(f"bit_or(w{w})").alias(f"w{w}") for w in range(words)])
    )
    got = rows.toPandas()  # at most `slots` rows
    for w in range(words):
        bits[got["slot"].to_numpy(), w] = got[f"w{w}"].to_numpy().astype(np.uint64)
    fill = np.array([float(((bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))])
    return LanguageFilters(languages, bits, fill**PROBES)


def _classify(texts: list[str], model: LanguageFilters) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each text (-1: und) and its score."""
    n, k = len(texts), len(model.languages)
    h, owner = _grams(texts)
    slots, words = model.bits.shape
    total = np.bincount(owner, minlength=n).astype(float)  # 0 where a text has no letter
    counts = np.zeros((k, n))
    for w in range(words):
        row = model.bits[:, w]
        mask = row[_slots(h, 0, slots)]
        for probe in range(1, PROBES):
            mask &= row[_slots(h, probe, slots)]
        for i in range(64 * w, min(k, 64 * w + 64)):
            hit = (mask >> np.uint64(i % 64)) & np.uint64(1)
            counts[i] = np.bincount(owner[hit.astype(bool)], minlength=n)
    p = model.false_positive[:, None] if k else np.zeros((0, 1))
    fixed = np.maximum(counts - total * p, 0) / np.maximum(1 - p, 1e-9)
    if not k:
        return np.full(n, -1), np.zeros(n)
    best = fixed.argmax(axis=0)
    top, among = fixed[best, np.arange(n)], fixed.sum(axis=0)
    cover = np.minimum(1.0, top / np.maximum(total, 1))
    score = np.where(among > 0, top / np.maximum(among, 1e-9), 0.0) * cover
    none = total == 0
    return np.where(none, -1, best), np.where(none, 0.0, np.clip(score, 0, 1))


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred, score of every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots * words * 8 bytes

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for a, texts in text_slices(batch.column("text")):
                best, score = _classify(texts, model)
                ids = batch.column("doc_id").slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def predict(docs: DataFrame, model: LanguageFilters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; fits on docs when no model is given."""
    found = identify(docs, model or fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageFilters | None = None) -> DataFrame:
    """docs without those whose language is `und`, in one pass without a shuffle; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    (keep,) = column_names(docs, "identified")
    return map_texts(docs, lambda texts: [pa.array(_classify(texts, shared.value)[0] >= 0)], [(keep, "boolean")]).where(F.col(keep)).select(*docs.columns)
