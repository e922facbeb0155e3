"""N-gram Jaccard join over word shingles: a grouped prefix join.

A document's set holds the hashes of its distinct 5-word shingles. In one global order (shingles seen often last, then
by hash) two sets with a Jaccard similarity of at least T share a shingle of their prefixes, n - ceil(T n) + 1 long.

1.  A sketch of fixed size (SKETCH counters) tells which shingles are frequent. It only shapes the order: whatever it
    says, the prefix filter stays exact.
2.  Documents with one prefix and size collapse into a group, equal sets into a class. Groups' prefixes deal out by
    shingle; shingles of one group alone go. Groups then expand into classes.
3.  Verification: first of each class against the one that is most often the hub of its lists, the class that shares
    most with others; then, among the lists that still hold classes of different components, of the pairs across
    components that the first round hasn't seen. Lists whose classes are all connected need no pair, so a group of
    thousands of near copies takes about as many checks as it has members. A pair is first held to a bound: each class has
    about one bit a shingle, the parity of the shingles that fall on it, and every bit in which two classes differ is a
    shingle that they don't share. Only pairs within the bound are compared by their sets, exactly.
4.  Components by alternating large and small stars.

Nothing about documents reaches the driver but the sketch (SKETCH bytes) and counts. Only connectivity is computed: links
within a component that is already connected are neither checked nor counted. Candidate ids are broadcast only if they are few, by their bytes.

Defined cases: a null or empty text, or one of white space, has the empty set and links with nothing; with fewer than
five words the whole sequence is one shingle; equal texts link; repeated rows repeat; a null doc_id counts after others
in a component; very long texts are taken whole; an empty table gives no row; further columns, whatever their names, are
not read by join() and pass through distinct_documents().
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import STEP, column_names, discard, materialize, mix64, sized, text_slices, trimmed

WORDS = 5
#: Similarity as a percentage.
PERCENT = 75
SKETCH = 1 << 24
#: Occurrences from which a counter makes its shingles frequent.
FREQUENT = 8
#: Counters of one row that reaches the driver.
PACK = 1 << 16
#: Groups whose prefix a task remembers to have sent; it may send one again later.
SEEN = 100_000

_rng = np.random.default_rng(20240229)
#: Random 64-bit numbers: one for each byte, an odd base for places, odd factors for places in a shingle.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
FACTORS = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SET_SALT = np.uint64(0xA5A5_1234_89AB_CDEF)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(BASE), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(texts: list[str]):
    """(hash, text index, first byte, byte after the last) of every word, and the bytes of all texts together."""
    parts = [t.encode().lower() for t in texts]
    joined = b"\n" + b"\n".join(parts) + b"\n"
    bounds = np.cumsum([1] + [len(p) + 1 for p in parts])  # where each text begins
    data = np.frombuffer(joined, dtype=np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, ends, bounds, data
    lengths = ends - starts
    flat = np.flatnonzero(~space)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(flat)) - np.repeat(first, lengths)
    h = np.add.reduceat(BYTE[data[flat]] * _powers(int(lengths.max()))[place], first)
    h = mix64(h + lengths.astype(np.uint64) * STEP)
    return h, np.searchsorted(bounds, starts, side="right") - 1, starts, ends, bounds, data


def shingles(h: np.ndarray) -> np.ndarray:
    """The hash of the WORDS words from each place on; fewer than h by WORDS - 1."""
    n = max(0, len(h) - WORDS + 1)
    s = h[:n] * FACTORS[0]
    for k in range(1, WORDS):
        s += h[k : n + k] * FACTORS[k]
    return mix64(s)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, doc, *_ = words_of(texts)
    empty, s = np.zeros(0, dtype=np.uint64), shingles(h)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = edge[i], edge[i + 1]
        if b - a >= WORDS:
            out.append(np.unique(s[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def _sets_of(column: pa.Array):
    """(first row, sets of the texts) of slices of a batch."""
    for a, texts in text_slices(column):
        yield a, shingle_sets(texts)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _identity(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    sums = np.array([mix64(s + STEP).sum(), mix64(s ^ SET_SALT).sum()], dtype=np.uint64)
    return mix64(sums + np.uint64(len(s))).tobytes()


def parity_bits(s: np.ndarray) -> bytes:
    """For each of m places, m the least power of two from len(s) and 64 on, the parity of the hashes that fall on it."""
    m = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_common(n: int, m: int, x: bytes, y: bytes) -> int:
    """An upper bound of the intersection of two sets of n and m, from their parity bits (the longer ones fold)."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64), type=kind))


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """Per counter 0, or the power of two of its count from FREQUENT on.

    A task counts in a sketch of its own and reports the counters that stand above what chance gives one. The sums are
    packed by executors, so SKETCH bytes in SKETCH / PACK rows reach the driver, whatever the corpus.
    """

    def count(batches):
        sketch, total = np.zeros(SKETCH, dtype=np.uint16), 0
        for batch in batches:
            for _, sets in _sets_of(batch.column(0)):
                found, n = np.unique(np.concatenate(sets) & np.uint64(SKETCH - 1), return_counts=True)
                found = found.astype(np.int64)
                sketch[found] = np.minimum(sketch[found] + n, 65535)
                total += int(n.sum())
        often = np.flatnonzero(sketch >= 2 + int(3 * total / SKETCH))
        for a in range(0, len(often), PACK):
            some = often[a : a + PACK]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sketch[some].astype(np.int64))], names=["bucket", "n"])

    def pack(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bucket, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(bucket // PACK):
                of = bucket // PACK == k
                held.setdefault(int(k), np.zeros(PACK, dtype=np.uint8))[bucket[of] % PACK] = np.log2(n[of]).astype(np.uint8)
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["k", "levels"])

    counts = docs.select("text").mapInArrow(trimmed(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    packed = counts.where(F.col("n") >= FREQUENT).repartition(F.floor(F.col("bucket") / PACK)).mapInArrow(trimmed(pack), "k long, levels binary")
    levels = np.zeros(SKETCH, dtype=np.uint8)
    for r in packed.toLocalIterator():
        levels[r["k"] * PACK : (r["k"] + 1) * PACK] = np.frombuffer(r["levels"], np.uint8)
    return levels


def prefixes(docs: DataFrame, levels: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n, class_id (null: empty set), group_id, bits, prefix (empty where the task has just sent that of the group)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        levels, seen = shared.value, set()
        for batch in batches:
            for a, sets in _sets_of(batch.column(1)):
                ids, groups, bits, heads = [], [], [], []
                if len(seen) > SEEN:
                    seen.clear()
                for s in sets:
                    n = len(s)
                    if not n:
                        ids.append(None)
                        groups.append(None)
                        bits.append(None)
                        heads.append(s)
                        continue
                    level = levels[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    ordered = s[np.argsort(level, kind="stable")] if level.any() else s
                    head = ordered[: prefix_length(n, percent)]
                    group = int(mix64(np.array([mix64(head + np.uint64(n)).sum()], dtype=np.uint64)).view(np.int64)[0])
                    ids.append(_identity(s))
                    groups.append(group)
                    bits.append(parity_bits(s))
                    heads.append(head[:0] if group in seen else head)
                    seen.add(group)
                size = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(sets)), batch.column(2).slice(a, len(sets)), size, pa.array(ids, pa.binary()), pa.array(groups, pa.int64()), pa.array(bits, pa.binary()), _lists(heads, pa.int64())],
                    names=["doc_id", "text_hash", "n", "class_id", "group_id", "bits", "prefix"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(trimmed(run), f"doc_id {kind}, text_hash long, n long, class_id binary, group_id long, bits binary, prefix array<long>")


def _shared_only(batches):
    """Of rows sorted by (token, group_id) the distinct ones whose token has two groups or more; holds one row back."""
    last = np.zeros((0, 3), dtype=np.int64)
    before = None  # the token before last's

    def emit(rows, after):
        nonlocal before
        t = rows[:, 0]
        same = t[1:] == t[:-1]
        keep = np.append(before is not None and t[0] == before, same) | np.append(same, after is not None and t[-1] == after)
        before = t[-1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(rows[keep].T)], names=["token", "group_id", "pos"])

    for batch in batches:
        rows = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[new]
        if len(rows) > 1:
            yield emit(rows[:-1], rows[-1, 0])
        last = rows[-1:]
    if len(last):
        yield emit(last, None)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for all nodes but the roots, root the least node: alternating large and small stars.

    Least neighbours are partial aggregates. They are dealt anew before the joins, for AQE splits the rows of a centre only
    where both sides of a join come straight from a shuffle.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = materialize(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, now = now, materialize(small.distinct(), "edges")
        discard(old, large)
        # done where every node is below one root, and no root below another node
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("x")).select("x.*")
        odd = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least")).where("below > 1 or (below = 1 and least = 0)")
        if not odd.limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a binary Arrow column without nulls; no copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of class ids whose sets reach the similarity."""

    def bound(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            keep = []
            for n, m, x, y in rows:
                common = most_common(n, m, x, y)
                keep.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: classes.select(F.col("class_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(trimmed(bound), "a binary, b binary")
    pairs = materialize(held, "within")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct().join(classes.select("class_id", "least_id"), "class_id")
    wanted = sized(materialize(wanted.select("least_id").distinct(), "wanted"))
    texts = docs.select("doc_id", "text")
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["least_id"]), "left_semi")

    def run(batches):
        for batch in batches:
            for _, sets in _sets_of(batch.column(0)):
                some = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_identity(s) for s in some], pa.binary()), pa.array([s.tobytes() for s in some], pa.binary())], names=["class_id", "members"])

    sets = texts.select("text").mapInArrow(trimmed(run), "class_id binary, members binary").dropDuplicates(["class_id"])

    def check(batches):
        for batch in batches:
            (x, of_x), (y, of_y), keep = _binaries(batch.column(2)), _binaries(batch.column(3)), []
            for i in range(batch.num_rows):
                both = np.sort(np.concatenate([of_x[x[i] : x[i + 1]], of_y[y[i] : y[i + 1]]]).view(np.uint64))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("class_id").alias("a"), F.col("members").alias("of_a"))
    two = sets.select(F.col("class_id").alias("b"), F.col("members").alias("of_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(trimmed(check), "a binary, b binary")


def connect(lists: DataFrame, check, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the components of all pairs that share a list (token, c, n: size of c, pos) and pass check(pairs).

    pos is the token's place in the order of c. If it is the first that two classes share, what they share is at most the
    rest from there on; a pair that passes the check is met at that token, so elsewhere it may be left out.
    """

    def near(m, p, n, q):
        fits = F.greatest(m, n) * percent <= F.least(m, n) * 100
        return fits & (F.least(m - p, n - q) * (100 + percent) >= (m + n) * percent)

    length = lists.groupBy("token").agg(F.count("*").alias("k"))
    fame = lists.join(length, "token").groupBy("c").agg((F.sum("k") / F.first("n")).alias("fame"))
    hub = lists.join(fame, "c").groupBy("token").agg(F.max(F.struct("fame", "c", "n", "pos")).alias("hub"))
    met = lists.join(hub, "token").where((F.col("c") != F.col("hub.c")) & near(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
    met = met.groupBy("c", F.col("hub.c").alias("h")).agg(F.count("*").alias("k"))
    best = met.groupBy("c").agg(F.max(F.struct("k", "h")).alias("x")).select("c", F.col("x.h").alias("h"))
    first = materialize(best.select(F.greatest("c", "h").alias("a"), F.least("c", "h").alias("b")).distinct(), "pairs")
    root = components(materialize(check(first), "links"))

    placed = lists.join(root, lists["c"] == root["node"], "left").select("token", "c", "n", "pos", F.coalesce("root", "c").alias("root"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("token")
    right = materialize(placed.join(mixed, "token"), "open")
    left = right.select("token", *[F.col(x).alias(f"{x}1") for x in ("c", "n", "pos", "root")])
    apart = (F.col("c1") > F.col("c")) & (F.col("root1") != F.col("root"))
    across = left.join(right, "token").where(apart & near(F.col("n1"), F.col("pos1"), F.col("n"), F.col("pos")))
    second = across.select(F.col("c1").alias("a"), F.col("c").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = materialize(second, "pairs")
    if second.limit(1).count():
        more = materialize(check(second), "links")
        if more.limit(1).count():
            root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    return root


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, class_id of every document, and keeper: (no_id, doc_id, text_hash) of the
    first row of its component, by doc_id (null last), then text_hash (null: empty set)."""
    docs = docs.select("doc_id", "text")
    rows = materialize(prefixes(docs, frequency_levels(docs), percent), "prefixes")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = materialize(
        rows.where("n > 0").groupBy("class_id").agg(F.min("doc_id").alias("least_id"), F.min(row).alias("keeper"), F.first("n").alias("n"), F.first("group_id").alias("group_id"), F.first("bits").alias("bits")), "classes"
    )
    tokens = rows.where(F.size("prefix") > 0).select("group_id", F.posexplode("prefix").alias("pos", "token")).select("token", "group_id", F.col("pos").cast("long").alias("pos"))
    lists = tokens.repartition("token").sortWithinPartitions("token", "group_id").mapInArrow(trimmed(_shared_only), "token long, group_id long, pos long")
    # groups expand into classes; classes of one group are a list of their own
    crowd = classes.groupBy("group_id").agg(F.count("*").alias("k")).where("k > 1").select("group_id")
    member = classes.select("group_id", F.col("class_id").alias("c"), "n")
    within = member.join(crowd, "group_id").select(F.col("group_id").alias("token"), "c", "n", F.lit(0).cast("long").alias("pos"))
    lists = materialize(lists.join(member, "group_id").select("token", "c", "n", "pos").unionAll(within), "lists")

    root = connect(lists, lambda pairs: verify(pairs, docs, classes, percent), percent)
    rooted = classes.join(root, classes["class_id"] == root["node"], "left").select("class_id", "least_id", "keeper", F.coalesce("root", "class_id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("keeper").alias("keeper"))
    named = rooted.drop("keeper").join(least, "root").select("class_id", "component_id", "keeper")
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class_id").join(named, "class_id", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class_id", "keeper")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (equal sets share it; null: empty set) of every document."""
    return _grouped(docs, percent).drop("text_hash", "keeper")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one text of each group: that of the least doc_id (null after others), and of its texts that of the least hash.

    Rows go by doc_id and text, so other texts with the id of a row that goes stay. Rows that repeat the kept one, id and
    text, stay if their id isn't null; of rows with null ids one stays.
    """
    found = _grouped(docs, PERCENT).where("keeper is not null")
    gone = found.where(~(F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.text_hash") == F.col("text_hash"))))
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    text_hash = F.xxhash64("text")
    named = docs.where("doc_id is not null")
    named = named.join(sized(gone.where("_id is not null")), (named["doc_id"] == gone["_id"]) & (text_hash == gone["_hash"]), "left_anti")
    hash_name, *_ = column_names(docs, "text_hash")
    unnamed = docs.where("doc_id is null").withColumn(hash_name, text_hash)
    unnamed = unnamed.join(sized(gone.where("_id is null")), unnamed[hash_name] == gone["_hash"], "left_anti")
    words = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))  # others have the empty set and link with nothing
    unnamed = unnamed.where(words).dropDuplicates([hash_name]).unionAll(unnamed.where(~words))
    return named.select(*docs.columns).unionAll(unnamed.select(*docs.columns))
