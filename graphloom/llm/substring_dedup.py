"""Substring dedup by MinHash banding of paragraphs.

Texts fall into units. A paragraph is a line of STRETCH words or more, or what shorter lines in a row, up to a blank one,
form together; lines of more than LONG words are cut by content into pieces of about PIECE words. Beside them, so that no
passage hides inside a paragraph, a stretch of STRETCH words begins at every anchor: a place whose 5-word shingle has the
least hash of some REACH in a row. Every passage of REACH + STRETCH - 1 = 49 words or more has one inside, in all copies.

1.  Banding. A paragraph has MinHash bands of ROWS[0] rows, as many as give a pair at PERCENT the chance RECALL to collide.
    Two stretches of 20 words reach PERCENT only where they differ at the outermost words, so a stretch has one band, of all
    its rows. Units equal word for word count as one class from the start.
2.  Colliding classes are verified by their exact sets: each against the hub of its lists; then, in lists that hold several
    components, all pairs of different ones, or, with more than LIST classes, each against HUBS of them. Lists that are still
    open are banded anew with more rows, and as many more bands as keep RECALL, so classes that share a common passage only
    part before any pair is formed; with the most rows all pairs are. Of all these pairs, only ones form that a bound of the
    exact similarity, by parity bits of the sets, lets pass.
3.  Components of the links are groups of near copies. The first occurrence (least doc_id, null last, then row, then place)
    of a group or class stays and all others go. A stretch is compared word by word (by 16 bits of a hash) with the first one
    on both sides, up to REACH words, within which the next stretch begins, so a repeat ends where its copies differ.

Only a filter of a size set by a count, FILTER bits at most, reaches the driver. It tells the second pass over the texts
which units to deal out; where it is full it only thins out less.

Defined cases: null or empty texts have no paragraph; repeats of fewer than STRETCH words never count; repeated rows with one
doc_id repeat each other from the second on; of a word that repeats on and on the first STRETCH stay; very long texts are
taken whole; an empty table gives no row; further columns, whatever their names, are not read by dedup() and pass through
remove().
"""

from __future__ import annotations

import re
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import STEP, column_names, materialize, mix64, sized, text_slices, trimmed
from graphloom.llm.ngram_join import PERCENT, WORDS, _binaries, components, shingles, words_of

#: Words of a stretch, and the least of a paragraph; shingles in a row of which the least is an anchor.
STRETCH, REACH = 20, 30
#: Lines of more than LONG words are cut where a shingle's hash is the least of PIECE / 2 on either side.
LONG, PIECE = 120, 60
#: Rows of a band, from one level of banding to the next, and the chance of a pair at the threshold to collide.
ROWS, RECALL = (2, 4, 8), 0.998
#: Classes of a list of which all pairs are verified, and the classes of a longer one that all others are held against.
LIST, HUBS = 16, 4
#: Most bits of a filter, the bits of one row that reaches the driver, and the places that a key sets.
FILTER, CHUNK_BITS, PROBES = 1 << 28, 1 << 16, 3
#: Rows of tokens that a task holds at once.
HELD = 400_000

_rng = np.random.default_rng(20240307)
PLACES, PLACES_AGAIN = (_rng.integers(0, 2**63, STRETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
AGAIN = np.uint64(0x5BD1_E995_7A3C_11D3)


def bands(rows: int, percent: int = PERCENT, recall: float = RECALL) -> int:
    """The least number of bands of so many rows with which a pair at percent collides with a chance of recall."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows)) if percent < 100 else 1


def band_tokens(s: np.ndarray, first: np.ndarray, rows: int, percent: int) -> np.ndarray:
    """(sets, bands) tokens of sets of shingle hashes that lie one after another in s, each from its first on."""
    n = bands(rows, percent)
    rng = np.random.default_rng(rows)
    factor = rng.integers(0, 2**63, (n, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    more = rng.integers(0, 2**63, (n, rows), dtype=np.uint64)
    out = np.zeros((len(first), n), dtype=np.uint64)
    for i in range(n):
        for k in range(rows):
            h = s * factor[i, k] + more[i, k]
            h ^= h >> np.uint64(32)
            out[:, i] = mix64(out[:, i] + np.minimum.reduceat(h, first) * STEP + np.uint64(i * 16 + k + 1))
    return out


def _sliding(x: np.ndarray, of, width: int) -> np.ndarray:
    """of (minimum or maximum) over width values from each place on."""
    have = 1
    while have < width:
        d = min(have, width - have)
        x = of(x[:-d], x[d:]) if len(x) > d else x[:0]
        have += d
    return x


def anchors(s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose shingle is the least of REACH in a row within one text, and that have STRETCH words before its end."""
    n = len(doc)
    if n < REACH + WORDS - 1:
        return np.zeros(0, np.int64)
    least = _sliding(s, np.minimum, REACH)
    inside = doc[REACH + WORDS - 2 :] == doc[: n - REACH - WORDS + 2]
    edge = np.zeros(REACH - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), np.maximum, REACH) == s
    at = np.flatnonzero(chosen)
    at = at[at + STRETCH <= n]
    return at[doc[at + STRETCH - 1] == doc[at]]


def paragraphs(h: np.ndarray, s: np.ndarray, doc: np.ndarray, starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of every paragraph, however short."""
    line = np.cumsum(data == 10)[starts]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    short = np.diff(np.append(first, len(h))) < STRETCH
    on = np.zeros(len(first), dtype=bool)
    on[1:] = short[1:] & short[:-1] & (np.diff(line[first]) == 1) & (np.diff(doc[first]) == 0)
    first = first[~on]
    words = np.diff(np.append(first, len(h)))
    half = PIECE // 2
    if (words > LONG).any() and len(s) > 2 * half:
        least = _sliding(s, np.minimum, half)  # of the half places from each on
        at = np.arange(half, len(s) - half)
        cut = at[(s[at] < least[at - half]) & (s[at] <= least[at + 1])]  # strict on one side: at least half apart
        of = np.searchsorted(first, cut, side="right") - 1
        cut = cut[(words[of] > LONG) & (cut - first[of] >= half) & (first[of] + words[of] - cut >= half)]
        first = np.sort(np.concatenate([first, cut]))
        words = np.diff(np.append(first, len(h)))
    return first, words


class Units:
    """The units of some texts: h, doc, edge (first word of each text), n_paragraphs; first, words, c, check of each unit, stretches
    first; n_stretches; sets: the shingles of the paragraphs one after another, set_first and set_size where each one's lie."""

    def __init__(self, texts: list[str]):
        self.h, self.doc, starts, _, _, data = words_of(texts)
        h, doc = self.h, self.doc
        s = shingles(h)
        self.edge = np.searchsorted(doc, np.arange(len(texts)))
        at = anchors(s, doc)
        first, words = paragraphs(h, s, doc, starts, data) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.n_paragraphs = np.bincount(doc[first], minlength=len(texts))
        first, words = first[words >= STRETCH], words[words >= STRETCH]
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(STRETCH):
            a += h[at + k] * PLACES[k]
            b += h[at + k] * PLACES_AGAIN[k]
        if len(first):
            each = np.repeat(np.arange(len(first)), words)
            place = (np.arange(len(each)) - np.repeat(np.cumsum(words) - words, words)).astype(np.uint64)
            of, begin = h[np.repeat(first, words) + place.astype(np.int64)], np.cumsum(words) - words
            x = np.add.reduceat(mix64(of + place * STEP), begin)
            y = np.add.reduceat(mix64((of ^ AGAIN) + place * STEP), begin)
        else:
            x = y = np.zeros(0, np.uint64)
        self.n_stretches = len(at)
        self.first, self.words = np.concatenate([at, first]), np.concatenate([np.full(len(at), STRETCH), words])
        self.c = mix64(np.concatenate([a, x + words.astype(np.uint64)]))
        self.check = mix64(np.concatenate([b, y + words.astype(np.uint64)]))
        self.set_size = words - WORDS + 1
        self.set_first = np.cumsum(self.set_size) - self.set_size
        self.sets = s[np.repeat(first - self.set_first, self.set_size) + np.arange(int(self.set_size.sum()))]


def tokens(docs: DataFrame, percent: int) -> DataFrame:
    """(token, c, n): how often the classes have each band token, summed up within a task as far as it holds them."""

    def run(batches):
        held, size = [], 0

        def summed():
            t, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c, t))
            t, c = t[order], c[order]
            first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
            n = np.diff(np.append(first, len(t)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (t[first].view(np.int64), c[first].view(np.int64), n)], names=["token", "c", "n"])

        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                u = Units(texts)
                k = u.n_stretches
                if k:
                    held.append((u.c[:k], u.c[:k]))
                if len(u.c) > k:
                    t = band_tokens(u.sets, u.set_first, ROWS[0], percent)
                    held.append((t.ravel(), np.repeat(u.c[k:], t.shape[1])))
                size += sum(len(x[0]) for x in held[-2:])
                if size > HELD:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return docs.select("text").mapInArrow(trimmed(run), "token long, c long, n long")


def _repeated(batches):
    """Of rows sorted by (token, c) the sums of each that stand for two units or more; many: the token has other classes, too."""
    held, before = np.zeros((3, 0), dtype=np.int64), None

    def emit(rows, after):
        nonlocal before
        t = rows[0]
        same = t[1:] == t[:-1]
        many = np.append(before is not None and t[0] == before, same) | np.append(same, after is not None and t[-1] == after)
        before = t[-1]
        keep = many | (rows[2] > 1)
        return pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(rows[1][keep]), pa.array(many[keep])], names=["token", "c", "many"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([x.to_numpy() for x in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        first = np.flatnonzero(np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))
        rows = np.stack([rows[0][first], rows[1][first], np.add.reduceat(rows[2], first)])
        if rows.shape[1] > 1:
            yield emit(rows[:, :-1], rows[0, -1])
        held = rows[:, -1:]
    if held.shape[1]:
        yield emit(held, None)


def key_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter over the column c, of about 16 bits a key, CHUNK_BITS at least and FILTER bits at most, as 64-bit words."""
    size = min(FILTER, max(CHUNK_BITS, 1 << (16 * ids.count()).bit_length()))
    probes = F.explode(F.array(*[F.shiftrightunsigned("c", 18 * i).bitwiseAND(F.lit(size - 1)) for i in range(PROBES)]))
    bits = ids.select(probes.alias("x")).select(F.shiftright("x", 16).alias("chunk"), F.col("x").bitwiseAND(F.lit(CHUNK_BITS - 1)).alias("bit"))

    def pack(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(chunk):
                x = held.setdefault(int(k), np.zeros(CHUNK_BITS // 8, dtype=np.uint8))
                some = bit[chunk == k]
                np.bitwise_or.at(x, some >> 3, (1 << (some & 7)).astype(np.uint8))
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(size // 8, dtype=np.uint8)
    for r in bits.repartition("chunk").mapInArrow(trimmed(pack), "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] * CHUNK_BITS // 8 : (r["chunk"] + 1) * CHUNK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out.view("<u8")


def _holds(known: np.ndarray, c: np.ndarray) -> np.ndarray:
    out, mask = np.ones(len(c), dtype=bool), np.uint64(64 * len(known) - 1)
    for i in range(PROBES):
        x = (c >> np.uint64(18 * i)) & mask
        out &= ((known[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def _around(h: np.ndarray, doc: np.ndarray, at: np.ndarray, step: int) -> pa.Array:
    """16 bits of each of the REACH words from at on, backwards or forwards; 0 beyond the text."""
    i = at[:, None] + step * np.arange(REACH)
    out = np.maximum(h[np.clip(i, 0, len(h) - 1)] >> np.uint64(48), np.uint64(1)).astype("<u2")
    here = doc[at - step]
    out[(i < 0) | (i >= len(h)) | (doc[np.clip(i, 0, len(h) - 1)] != here[:, None])] = 0
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REACH), len(at), [None, pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.binary())


def occurrences(docs: DataFrame, known: np.ndarray, linked: np.ndarray) -> DataFrame:
    """(doc_id, row, c, check, p, n, left, right, members) of the units whose class is known: first word, number of words, for
    stretches the words around, for paragraphs in linked the set; and of each document, with p = -1 and n paragraphs."""
    shared = docs.sparkSession.sparkContext.broadcast((known, linked))

    def run(batches):
        known, linked = shared.value
        for batch in batches:
            for a, texts in text_slices(batch.column("text")):
                u = Units(texts)
                ids, rows, every = batch.column("doc_id").slice(a, len(texts)), batch.column("row").slice(a, len(texts)), pa.array(np.arange(len(texts)))
                hit = np.flatnonzero(_holds(known, u.c))
                of = pa.array(u.doc[u.first[hit]])
                short = hit[hit < u.n_stretches]
                long = hit[hit >= u.n_stretches]
                blank = pa.nulls(len(long), pa.binary())
                at = u.first[short]
                if len(short):
                    after = np.minimum(at + STRETCH, len(u.h))
                    left = pa.concat_arrays([_around(u.h, u.doc, at - 1, -1), blank])
                    right = pa.concat_arrays([_around(u.h, u.doc, after, 1), blank])
                else:
                    left = right = blank
                wanted = _holds(linked, u.c[long])
                members = [u.sets[u.set_first[i] : u.set_first[i] + u.set_size[i]] if w else None for i, w in zip(long - u.n_stretches, wanted)]
                members = [None] * len(short) + [m if m is None else np.unique(m).tobytes() for m in members]
                zero = np.zeros(len(texts), np.int64)
                none = pa.nulls(len(texts), pa.binary())
                names = ["doc_id", "row", "c", "check", "p", "n", "left", "right", "members"]
                yield pa.RecordBatch.from_arrays([ids, rows, *map(pa.array, (zero, zero, zero - 1, u.n_paragraphs.astype(np.int64))), none, none, none], names=names)
                p = u.first[hit] - u.edge[u.doc[u.first[hit]]]
                numbers = [pa.array(x) for x in (u.c[hit].view(np.int64), u.check[hit].view(np.int64), p, u.words[hit].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([ids.take(of), rows.take(of), *numbers, left, right, pa.array(members, pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(
        trimmed(run), f"doc_id {kind}, row long, c long, check long, p long, n long, left binary, right binary, members binary"
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets (c, members) reach the similarity."""

    def check(batches):
        for batch in batches:
            (x, of_x), (y, of_y), keep = _binaries(batch.column(2)), _binaries(batch.column(3)), []
            for i in range(batch.num_rows):
                both = np.sort(np.concatenate([of_x[x[i] : x[i + 1]], of_y[y[i] : y[i + 1]]]).view(np.uint64))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("c").alias("a"), F.col("members").alias("of_a"))
    two = sets.select(F.col("c").alias("b"), F.col("members").alias("of_b"))
    sized = pairs.join(one, "a").join(two, "b").where(F.least(F.length("of_a"), F.length("of_b")) * 100 >= F.greatest(F.length("of_a"), F.length("of_b")) * percent)
    return sized.select("a", "b", "of_a", "of_b").mapInArrow(trimmed(check), "a long, b long")


def _banded(sets: DataFrame, rows: int, percent: int) -> DataFrame:
    """(token, c) of sets (c, members) by bands of so many rows."""

    def run(batches):
        for batch in batches:
            at, data = _binaries(batch.column(1))
            if not batch.num_rows:
                continue
            t = band_tokens(data[at[0] : at[-1]].view(np.uint64), (at[:-1] - at[0]) // 8, rows, percent)
            yield pa.RecordBatch.from_arrays([pa.array(t.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), t.shape[1]))], names=["token", "c"])

    return sets.select("c", "members").mapInArrow(trimmed(run), "token long, c long")


def sized_sets(places: DataFrame) -> DataFrame:
    """(c, n, p0 to p3, members) of the classes that have a set: its size and, for each of 256 places, the parity of its shingles there."""

    def run(batches):
        for batch in batches:
            at, data = _binaries(batch.column(1))
            odd = np.zeros((batch.num_rows, 256), dtype=np.uint8)
            for i in range(batch.num_rows):
                odd[i] = np.bincount(data[at[i] : at[i + 1] : 8], minlength=256) & 1  # of each hash its lowest byte
            words = np.packbits(odd, axis=1, bitorder="little").view("<i8").reshape(-1, 4)
            n = (np.diff(at) // 8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)], batch.column(1)], names=["c", "n", *PARITY, "members"])

    sets = places.where("members is not null").groupBy("c").agg(F.first("members").alias("members"))
    return sets.mapInArrow(trimmed(run), "c long, n int, p0 long, p1 long, p2 long, p3 long, members binary")


PARITY = ("p0", "p1", "p2", "p3")


def _across(left: DataFrame, right: DataFrame, on, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes of two sides with c, root, n and the parity bits (on the right with a 1 after their names)
    that are of different components and can reach the similarity: every bit that differs is a shingle of one set alone."""
    apart = sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}1"))) for p in PARITY)
    close = (F.col("n") + F.col("n1") - apart) * (100 + percent) >= (F.col("n") + F.col("n1")) * (2 * percent)
    sizes = F.least("n", "n1") * 100 >= F.greatest("n", "n1") * percent
    both = left.join(right, on & (F.col("root1") != F.col("root")) & sizes & close)
    return both.select(F.greatest("c1", "c").alias("a"), F.least("c1", "c").alias("b")).distinct()


def link(lists: DataFrame, sets: DataFrame, percent: int, level: int = 0, root: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components that verified pairs of classes from a list (token, c), and those of root, make."""

    def joined(found: DataFrame, root: DataFrame | None) -> DataFrame:
        if root is None:
            return components(found)
        return components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found)) if found.limit(1).count() else root

    if root is None:
        fame = lists.groupBy("c").agg(F.count("*").alias("fame"))
        hub = lists.join(fame, "c").groupBy("token").agg(F.max(F.struct("fame", "c")).alias("hub")).select("token", F.col("hub.c").alias("h"))
        met = lists.join(hub, "token").where("c != h").groupBy("c", "h").agg(F.count("*").alias("k"))
        best = met.groupBy("c").agg(F.max(F.struct("k", "h")).alias("x")).select("c", F.col("x.h").alias("h"))
        root = joined(verified(best.select(F.greatest("c", "h").alias("a"), F.least("c", "h").alias("b")).distinct(), sets, percent), None)

    light = [F.col(x) for x in ("c", "root", "n", *PARITY)]

    def opened(lists: DataFrame, root: DataFrame) -> DataFrame:
        """Rows of the lists that hold several components, with k: how many classes a list has."""
        placed = lists.join(root, lists["c"] == root["node"], "left").withColumn("root", F.coalesce("root", "c")).drop("node")
        mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k")).where("x != y")
        return placed.join(mixed.select("token", "k"), "token")

    open_ = materialize(opened(lists, root).join(sets.select("c", "n", *PARITY), "c"), "open")
    if not open_.limit(1).count():
        return root
    long = open_.where(F.col("k") > LIST)
    side = [x.alias(f"{name}1") for x, name in zip(light, ("c", "root", "n", *PARITY))]
    near = open_.where(F.col("k") <= LIST)
    pairs = _across(near, near.select(F.col("token").alias("token1"), *side), (F.col("token") == F.col("token1")) & (F.col("c1") > F.col("c")), percent)
    picked = [F.max(F.struct(F.xxhash64("c", F.lit(i)).alias("x"), *light)).alias(f"h{i}") for i in range(HUBS)]
    hubs = long.groupBy("token").agg(*picked).select(F.col("token").alias("token1"), F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HUBS)]))).alias("h"))
    hubs = hubs.select("token1", *[F.col(f"h.{x}").alias(f"{x}1") for x in ("c", "root", "n", *PARITY)]).hint("rebalance")
    pairs = pairs.unionAll(_across(long, hubs, F.col("token") == F.col("token1"), percent)).distinct()
    root = joined(materialize(verified(pairs, sets, percent), "links"), root)

    still = materialize(opened(long.drop("root", "k"), root), "open")
    if not still.limit(1).count():
        return root
    if level + 1 < len(ROWS):
        some = sets.join(still.select("c").distinct(), "c", "left_semi")
        return link(materialize(_banded(some, ROWS[level + 1], percent), "lists"), sets, percent, level + 1, root)
    pairs = _across(still, still.select(F.col("token").alias("token1"), *side), (F.col("token") == F.col("token1")) & (F.col("c1") > F.col("c")), percent)
    return joined(materialize(verified(pairs, sets, percent), "links"), root)


def _extend(kind: pa.DataType):
    def run(batches):
        """Of units beside the first of their class the words that are equal on both sides, too: what goes is a to b (none: a = b)."""
        for batch in batches:
            t = {c: batch.column(c) for c in batch.schema.names}
            row, p, n, row1, p1, n1 = (t[c].to_numpy() for c in ("row", "p", "n", "row1", "p1", "n1"))
            a, b = p.copy(), p + n
            has = np.flatnonzero(pc.and_(pc.is_valid(t["left"]), pc.is_valid(t["left1"])).to_numpy(zero_copy_only=False))
            if len(has):
                some = pa.array(has)
                x, y, x1, y1 = (np.frombuffer(b"".join(t[c].take(some).to_pylist()), "<u2").reshape(-1, REACH) for c in ("left", "right", "left1", "right1"))
                a[has] -= np.logical_and.accumulate((x == x1) & (x != 0), axis=1).sum(axis=1)
                b[has] += np.logical_and.accumulate((y == y1) & (y != 0), axis=1).sum(axis=1)
            first = (row == row1) & (p == p1) & (n == n1)
            a = np.where(row == row1, np.maximum(a, p1 + n1), a)
            b = np.where(first, a, np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([t["row"], t["p"], t["n"], pa.array(a), pa.array(b), t["keeper"].cast(kind), t["across"]], names=["row", "p", "n", "a", "b", "keeper", "across"])

    return run


def _union(begin, end) -> tuple[np.ndarray, np.ndarray]:
    """(first, one after the last) of the ranges' unions."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1])) if len(order) else np.zeros(0, np.int64)
    return begin[first], np.maximum.reduceat(reach, first) if len(first) else first


def _by_document(kind: pa.DataType):
    names = ["row", "n_repeated", "n_removed", "removed_words", "keeper_ids", "removed"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.string())

    def tally(row, t):
        p, n, a, b = (t.column(c).to_numpy() for c in ("p", "n", "a", "b"))
        other = t.column("across").to_numpy()
        gone = np.flatnonzero(b > a)
        start, end = _union(a[gone], b[gone])
        keepers = pc.unique(t.column("keeper").take(pa.array(gone))).to_pylist()
        repeated = len(_union(p[other], (p + n)[other] + REACH - STRETCH)[0])  # stretches of one passage lie no further apart
        return row, repeated, len(start), int((end - start).sum()), sorted(k for k in keepers if k is not None), ",".join(f"{i}:{j}" for i, j in zip(start, end))

    def run(batches):
        """Of rows sorted by row one for each document."""
        open_ = []  # batches of the documents that aren't complete

        def told(t):
            row = t.column("row").to_numpy()
            at = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
            found = [tally(int(row[x]), t.slice(x, y - x)) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row").to_numpy()
            open_.append(batch)
            if open_[0].column("row")[0].as_py() == row[-1]:
                continue
            done = int(np.searchsorted(row, row[-1]))
            yield told(pa.Table.from_batches([*open_[:-1], batch.slice(0, done)]).combine_chunks())
            open_ = [batch.slice(done)]
        if open_:
            yield told(pa.Table.from_batches(open_).combine_chunks())

    return run


def _found(docs: DataFrame, percent: int) -> DataFrame:
    """row, doc_id and the columns of dedup() for docs with doc_id, row, text."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    said, arrow = kind.simpleString(), to_arrow_type(kind)
    lists = materialize(tokens(docs, percent).repartition("token").sortWithinPartitions("token", "c").mapInArrow(trimmed(_repeated), "token long, c long, many boolean"), "lists")
    met = materialize(lists.where("many").select("token", "c"), "met")
    known, linked = key_filter(lists.select("c").distinct()), key_filter(met.select("c").distinct())
    places = materialize(occurrences(docs, known, linked), "places")
    near = link(met, materialize(sized_sets(places), "sets"), percent).select(F.col("node").alias("c"), "root")
    near = near.unionAll(near.select(F.col("root").alias("c"), "root").distinct())
    near = sized(near)

    units = places.where("p >= 0").drop("members").join(near, "c", "left")
    units = units.select("doc_id", "row", "p", "n", "left", "right", F.coalesce("root", "c").alias("g"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("v"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "p", "n", "left", "right")
    heads = units.groupBy("g", "v").agg(F.count("*").alias("k"), F.min(order).alias("x"), (F.min("row") != F.max("row")).alias("across")).where("k > 1")
    heads = heads.hint("rebalance").select("g", "v", "across", *[F.col(f"x.{c}").alias(f"{c}1") for c in ("row", "p", "n", "left", "right")], F.col("x.doc_id").alias("keeper"))
    both = units.join(heads, ["g", "v"]).select("row", "p", "n", "left", "right", "row1", "p1", "n1", "left1", "right1", "keeper", "across")
    marks = both.mapInArrow(trimmed(_extend(arrow)), f"row long, p long, n long, a long, b long, keeper {said}, across boolean")
    tallies = marks.repartition("row").sortWithinPartitions("row").mapInArrow(
        trimmed(_by_document(arrow)), f"row long, n_repeated long, n_removed long, removed_words long, keeper_ids array<{said}>, removed string"
    )
    zero = F.lit(0).cast("long")
    out = places.where("p < 0").select("doc_id", "row", F.col("n").alias("n_paragraphs")).join(tallies, "row", "left")
    return out.select(
        "row", "doc_id", "n_paragraphs", *[F.coalesce(c, zero).alias(c) for c in ("n_repeated", "n_removed", "removed_words")],
        F.coalesce("keeper_ids", F.array().cast(f"array<{said}>")).alias("keeper_ids"), F.coalesce("removed", F.lit("")).alias("removed"),
    )


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_repeated (stretches of words that other rows have, too), n_removed (those that go,
    repeats within the text among them), removed_words, keeper_ids (documents that hold the first ones), removed
    (first:after in words, comma-joined)."""
    return _found(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), percent).drop("row")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remove(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the repeats cut out of text, row by row, whether doc_id repeats or is null."""
    row, gone = column_names(docs, "row", "removed")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    found = _found(docs.select("doc_id", F.col(row).alias("row"), "text"), percent).where("n_removed > 0").select(F.col("row").alias(row), F.col("removed").alias(gone))

    @F.pandas_udf(T.StringType())
    def cut(texts, spans):
        out = []
        for text, said in zip(texts, spans):
            if said:
                at, left, end = 0, [], [m.span() for m in WORD.finditer(text)]
                for a, b in (map(int, x.split(":")) for x in said.split(",")):
                    left.append(text[at : end[a][0]])
                    at = end[b - 1][1]
                text = "".join([*left, text[at:]])
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    marked = docs.join(found, row, "left")
    text = F.when(F.col(gone).isNotNull(), cut(F.col("text"), F.col(gone))).otherwise(F.col("text"))
    return marked.withColumn("text", text).select(*[c for c in docs.columns if c != row])
