"""Each operator against a plain version, over the edge cases of conftest.py and the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, decontam, langid, ngram_join, quality, registry, secrets, shards, substring_dedup, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


# 1


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark, given):
    hard = [(1, 0, "user", r"\### <turn role=\"x\"> </turn>"), (1, 1, "assistant", "\\"), (1, 2, "assistant", None), (1, 2, "assistant", "<turn\n</turn>\n"), (2, None, None, 'a "q" \\" 😀'), (None, 0, "we\"ird\\</turn>", ""), (1, 2, "assistant", "<turn\n</turn>\n")]
    table = events(spark, hard).unionByName(given("conversations"))
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(table))).collect()}
    assert got == {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.message_log(table), dealt=True))).collect()}
    want = defaultdict(list)
    for r in table.collect():
        want[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    assert got.keys() == want.keys()
    segments = chat.render(chat.fold(table)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "segment"))).alias("s"))
    texts = {r["conv_id"]: "".join(x["segment"] for x in r["s"]) for r in segments.collect()}
    for k, turns in want.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for _, a, b in turns))
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(said), sha(said)) and got[k]["formatted_chars"] == len(texts[k])
        assert chat.parse(texts[k]) == [(a, b) for _, a, b in turns]


def test_chat_folds_events(spark):
    log = [(1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "He"), (1, 2, "delta", None, "assistant", "llo"), (1, 3, "edit", 0, "user", "hi!"), (1, 4, "message", None, "user", "more"), (1, 5, "regenerate", 1, "assistant", "Hey"), (1, 6, "delta", 5, "assistant", " you"), (2, 0, "delta", None, "assistant", "alone")]
    table = spark.createDataFrame(log, "conv_id long, turn long, op string, target long, role string, text string")
    got = sorted((r["conv_id"], r["message"], r["role"], r["text"]) for r in chat.fold(table).collect())
    assert got == [(1, 0, "user", "hi!"), (1, 1, "assistant", "Hey you"), (2, 0, "assistant", "alone")]
    assert chat.digests(chat.render(chat.fold(table.limit(0)))).count() == 0
    assert chat.message_log(table.limit(0)).count() == 0


def test_chat_log_has_every_kind_of_event_and_ids_stay(spark):
    big = 2**53
    said = [(i, t, ("user", "assistant")[t % 2], f"text {i} {t}") for i in (big, big + 1, None) for t in range(12)]
    log = chat.message_log(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    assert {r["op"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted((str(r["conv_id"]), r["message"], r["role"], r["text"]) for r in chat.fold(log, dealt=True).collect())
    assert got == sorted((str(i), t, role, text) for i, t, role, text in said)


# 2


def components_of(rows):
    sets = []
    for _, t, *_ in rows:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))


def join_rows(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_join_of_edge_cases(docs, doc_rows, no_docs):
    assert join_rows(ngram_join.join(docs)) == components_of(doc_rows)
    assert ngram_join.join(no_docs).count() == 0
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_join_of_a_star_of_near_copies(spark):
    """Copies that are near to one base only, and chains: components need the base, whatever the order."""
    rnd, base = random.Random(5), [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for at in rnd.sample(range(0, 200), 4):
            w[at] = f"n{i}_{at}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(150)]
    for i in range(12):
        rows.append((2000 + i, " ".join(chain[4 * i : 4 * i + 100])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert join_rows(ngram_join.join(table)) == components_of(rows)


def test_join_of_the_table(given):
    rows = [(r["doc_id"], r["text"]) for r in given("documents").collect()]
    assert join_rows(ngram_join.join(given("documents"))) == components_of(rows)


def test_bounds_of_the_join():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        n, m = rnd.integers(1, 400, 2)
        pool = rnd.integers(0, 2**63, 500).astype(np.uint64)
        a, b = np.unique(rnd.choice(pool, n)), np.unique(rnd.choice(pool, m))
        assert ngram_join.most_common(len(a), len(b), ngram_join.parity_bits(a), ngram_join.parity_bits(b)) >= len(np.intersect1d(a, b))


# 3


def test_shards(docs, doc_rows, no_docs):
    got = shards.shard(docs, name="test").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in doc_rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.shard(no_docs, name="test").count() == 0


def test_shards_balance_and_grow():
    rnd = random.Random(3)
    size = tuple(rnd.randint(1000, 9000) for _ in range(4096))
    m = shards.SlotMap(1, 24, tuple(i % 24 for i in range(4096)), size, (1,) * 4096)
    new = shards.rebalance(m)
    assert new.version == 2 and max(new.loads()) - min(new.loads()) <= 0.002 * sum(size) / 24
    big = shards.grow(new)
    assert big.n_shards == 25 and all(a == b or b == 24 for a, b in zip(new.shard_of, big.shard_of))
    assert abs(big.loads()[24] - sum(size) / 25) < 9000


def test_shards_edit_the_stored_map(spark, given):
    docs, name = given("documents"), f"edited-{random.random()}"
    shards.shard(docs, name=name).count()
    first, second = shards.load(spark, f"{name}-24", 1), shards.load(spark, f"{name}-24")
    assert (first.version, second.version) == (1, 2) and first.shard_of == tuple(i % 24 for i in range(4096))
    again = shards.shard(docs, name=name)
    assert shards.load(spark, f"{name}-24").version == 2 and {r[0] for r in again.select("map_version").distinct().collect()} == {2}
    more = docs.unionByName(docs.limit(60).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.concat("text", F.lit(" more"))}))
    shards.shard(more, name=name).count()
    third = shards.load(spark, f"{name}-24")
    moved = sum(a != b for a, b in zip(second.shard_of, third.shard_of))
    assert third.version == 3 and 0 < moved < 200 and third.n_rows != second.n_rows
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        shards.save(spark, third, f"{name}-24")


def test_shards_against_a_plain_version(spark, docs, doc_rows):
    """Slots by the hash as Spark defines it, computed here; shards by the stored map; places by sorting."""
    import xxhash

    name = f"plain-{random.random()}"
    got = Counter(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot")) for r in shards.shard(docs, name=name).collect())
    m = shards.load(spark, f"{name}-24")

    def slot_of(i, t):
        seed = 42 if i is None else xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64((t or "").encode(), seed=seed).intdigest()
        return (h - 2**64 if h >= 2**63 else h) % shards.VIRTUAL_SLOTS

    rows = sorted((slot_of(i, t), i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, i) for i, t, *_ in doc_rows)
    want, seen = Counter(), Counter()
    for v, _, _, crc, size, i in rows:
        k = m.shard_of[v]
        want[(i, size, crc, k, seen[k], v)] += 1
        seen[k] += 1
    assert got == want


def test_shards_of_the_table(given):
    loads = [r["b"] for r in shards.shard(given("documents"), name="table").groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 24 and max(loads) <= 1.25 * min(loads)  # 200 documents of up to a shard's size


# 4


@pytest.fixture(scope="module")
def reference_encoder():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tree_equals_plain_encoding(reference_encoder):
    codec, rnd = bpe.Codec(*bpe.read_ranks(), leaf=7, window=2), random.Random(0)
    letters = "ab '\n\t x1é你 's'rell  -!?　\x1c\0😀"
    for _ in range(1500):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120)))
        assert codec.encode(t).tolist() == reference_encoder.encode_ordinary(t), t
        assert codec.decode(codec.encode(t)) == t.encode()


def test_bpe_of_edge_cases(docs, doc_rows, no_docs, reference_encoder):
    want = Counter()
    for i, t, *_ in doc_rows:
        ids = np.array(reference_encoder.encode_ordinary(t or ""), dtype="<u4")
        want[(i, len(ids), sha(ids.tobytes()), sha(t or ""))] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(docs).collect()) == want
    assert bpe.token_digests(no_docs).count() == 0
    assert bpe.encode_documents(docs).columns[-2:] == ["token_ids_", "decoded"]


# 5


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_paragraphs(text, least=substring_dedup.STRETCH):
    """The words of each paragraph of a text without long lines, by the rule of the operator."""
    out, last, blank = [], None, True
    for line in (text or "").split("\n"):
        w = words(line)
        if w:
            join = out and not blank and len(w) < least and last < least
            if join:
                out[-1] += w
            else:
                out.append(w)
            last = len(w)
        blank = not w
    return [p for p in out if len(p) >= least]


def shingle_set(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_repeats(texts, least):
    """Per text whether it has a window of least words that another has, or a paragraph whose 5-word shingles are 75 % another's."""
    seen, out = defaultdict(set), [False] * len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(i)
    for rows in seen.values():
        if len(rows) > 1:
            for i in rows:
                out[i] = True
    sets, at = [(i, shingle_set(p)) for i, t in enumerate(texts) for p in plain_paragraphs(t)], defaultdict(set)
    for k, (_, x) in enumerate(sets):
        for s in x:
            at[s].add(k)
    for k, (i, x) in enumerate(sets):
        for m in set().union(*(at[s] for s in x)):
            j, y = sets[m]
            if i != j and 100 * len(x & y) >= 75 * len(x | y):
                out[i] = out[j] = True
    return out


def dedup_rows(df):
    return {r["doc_id"]: r for r in substring_dedup.dedup(df).collect()}


def test_dedup_of_the_table_against_brute_force(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given("documents").collect()]
    got, texts = dedup_rows(given("documents")), [t for _, t in rows]
    assert sorted(got) == sorted(i for i, _ in rows)
    long, any_ = plain_repeats(texts, 51), plain_repeats(texts, 20)
    for (i, t), must, may in zip(rows, long, any_):
        flagged = got[i]["n_repeated"] > 0
        assert flagged >= must and (may or not flagged or max(map(len, map(words, t.split("\n")))) > substring_dedup.LONG), i
    left = Counter()
    for r in substring_dedup.remove(given("documents")).collect():
        w = words(r["text"])
        left.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
    assert all(n == 1 for n in left.values())  # of no passage of over 50 words a second copy stays
    was = {tuple(w[k : k + 51]) for w in map(words, texts) for k in range(len(w) - 50)}
    assert set(left) <= was or len(set(left) - was) < 0.02 * len(left)  # only across a cut are there new ones


def edited(rnd, w, n):
    w = list(w)
    for k in rnd.sample(range(len(w)), n):
        w[k] = f"edit{rnd.randint(0, 10**9)}"
    return w


@pytest.mark.parametrize("n, edits", [(40, 1), (60, 1), (100, 2), (110, 3)])
def test_dedup_recall_of_near_paragraphs(spark, n, edits):
    rnd, rows, pairs = random.Random(n), [], 0
    while pairs < 150:
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
        v = edited(rnd, w, edits)
        x, y = shingle_set(w), shingle_set(v)
        if 100 * len(x & y) >= 75 * len(x | y):
            rows += [(2 * pairs, "alone one two\n\n" + " ".join(w)), (2 * pairs + 1, " ".join(v) + "\n\nother words here")]
            pairs += 1
    got = dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = sum(got[2 * i]["n_repeated"] > 0 and got[2 * i + 1]["keeper_ids"] == [2 * i] and got[2 * i + 1]["removed_words"] == n for i in range(pairs))
    assert found >= 0.98 * pairs


def test_dedup_passages_go_up_to_their_borders(spark, prose):
    """Passages of 51 words at any place of two lines, alone among other words: all of both copies' words are told, no more."""
    rows = []
    for k in range(60):
        passage = prose(1000 + k, 51)
        rows += [(2 * k, f"{prose(5000 + k, 30 + k)} first{k} {passage} last{k} {prose(6000 + k, 90 - k)}"), (2 * k + 1, f"{prose(7000 + k, 80)} other{k}\n{passage}\nmore{k} {prose(8000 + k, 40)}")]
    got = dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    for k in range(60):
        assert got[2 * k]["n_repeated"] == got[2 * k + 1]["n_repeated"] == 1 and got[2 * k]["removed"] == ""
        assert got[2 * k + 1]["removed"] == "81:132" and got[2 * k + 1]["keeper_ids"] == [2 * k]


def test_dedup_of_lines_around_one_passage(spark, prose):
    """Lists longer than LIST are banded anew: lines that share a passage stay apart, near copies among them are found."""
    shared, rows = prose(77, 18), []
    for k in range(60):
        own = prose(100 + k, 30)
        rows.append((2 * k, f"{own} {shared}"))
        rows.append((2 * k + 1, f"{own} {shared} end{k}" if k % 2 else f"{prose(900 + k, 30)} {shared}"))
    got = dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    for k in range(60):
        assert (got[2 * k]["n_repeated"] > 0) == (got[2 * k + 1]["n_repeated"] > 0) == bool(k % 2)
        assert got[2 * k + 1]["keeper_ids"] == ([2 * k] if k % 2 else [])


def test_dedup_of_edge_cases(spark, docs, doc_rows, no_docs, prose):
    got = dedup_rows(docs)
    assert 13 in got[14]["keeper_ids"] and got[13]["n_repeated"] > 0 and got[17]["n_repeated"] == 0 and got[5]["n_paragraphs"] == 0
    assert substring_dedup.dedup(docs).count() == len(doc_rows)
    assert substring_dedup.dedup(no_docs).count() == substring_dedup.remove(no_docs).count() == 0
    text = prose(3, 80)
    kinds = "doc_id long, text string, removed string, _id int, row string"
    some = spark.createDataFrame([(7, text, "r", 1, "a")] * 3 + [(None, text, None, 2, "b")] * 2 + [(8, None, "n", 3, "c"), (8, "short", "n", 3, "c")], kinds).repartition(2)
    out = substring_dedup.remove(some)
    assert out.schema == some.schema
    left = Counter(tuple(r) for r in out.collect())
    assert left == Counter({(7, text, "r", 1, "a"): 1, (7, "", "r", 1, "a"): 2, (None, "", None, 2, "b"): 2, (8, None, "n", 3, "c"): 1, (8, "short", "n", 3, "c"): 1})
    same = substring_dedup.dedup(spark.createDataFrame([(1, "same " * 400)], "doc_id long, text string")).first()
    assert same["n_repeated"] == 0 and same["removed_words"] == 380


def test_dedup_bands():
    for rows in substring_dedup.ROWS:
        n = substring_dedup.bands(rows)
        assert 1 - (1 - 0.75**rows) ** n >= substring_dedup.RECALL > 1 - (1 - 0.75**rows) ** (n - 1)


# 6


def base_counts(t):
    w = SPACE.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often, marks = Counter(windows), set()
    for k, x in enumerate(windows):
        if often[x] > 1:
            marks |= {k, k + 1, k + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marks))


def test_quality_counts(docs, doc_rows, no_docs, given):
    got = Counter(tuple(r)[:6] for r in quality.measurements(docs).select("doc_id", *quality.COUNTS).collect())
    assert got == Counter((i, *base_counts(t)) for i, t, *_ in doc_rows)
    out = quality.predict(docs, given("labels").limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in out)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in out)
    assert quality.predict(no_docs, given("labels")).count() == 0


def test_quality_verdicts_against_a_plain_version(spark, sf_dir):
    """The rules as the operator learnt them, applied row by row, one after another."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learnt = quality.fit(docs, labels)
    assert learnt
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in quality.predict(docs, labels).collect():
        data = dict(zip([*quality.COUNTS, *quality.RATIOS], quality.measure(texts[r["doc_id"]] or "")))
        low = any(all(data[c.feature] >= c.threshold if c.at_least else data[c.feature] <= c.threshold for c in rule) for rule in learnt)
        failed = data["n_words"] < 50 or 100 * data["n_repeat_words"] > 50 * data["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and not low)


def test_quality_rules_learn():
    rnd = np.random.default_rng(1)
    x, y = rnd.uniform(0, 1, 3000), rnd.uniform(0, 1, 3000)
    low = (x > 0.8) & (y < 0.5) | (y > 0.95)
    noisy = low ^ (rnd.uniform(0, 1, 3000) < 0.02)
    found = quality.learn({"x": x, "y": y}, noisy)
    hit = np.zeros(3000, bool)
    for r in found:
        hit |= quality._covers(r, {"x": x, "y": y}, 3000)
    assert (hit == low).mean() > 0.97


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rest = quality.predict(docs, known).join(labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0), "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rest]) > 0.93


# 7, 9


def test_toxicity_on_held_out_rows(spark, sf_dir, no_docs, docs, given):
    d, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    rows = toxicity.predict(d, labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([a > b for a in pos for b in neg]) > 0.85 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    model = toxicity.fit(given("documents"), given("labels"))
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored) and len({r["score"] for r in scored if r["doc_id"] in (4, 5, 6)}) == 1
    assert toxicity.predict(no_docs, given("labels")).count() == 0
    assert toxicity.predict(docs, given("labels").limit(0)).where("score between 0 and 1").count() == docs.count()


def test_language_on_held_out_rows(given, docs, no_docs):
    d = given("documents")
    rows = langid.predict(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95 and {r["held_out"] for r in rows} == {True}
    out = langid.identify(docs, langid.fit(d)).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (4, 5, 6, 19)) and len(out) == docs.count()
    assert langid.predict(no_docs).count() == 0 and langid.keep_identified(docs, langid.fit(d)).columns == docs.columns
    assert {r["lang_pred"] for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 8


def plain_spans(t):
    kinds = [re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    out = []
    for k, r in enumerate(kinds):
        for m in r.finditer(t or ""):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secret_base_spans(docs, doc_rows, no_docs, given):
    for table, rows in ((docs, doc_rows), (given("documents"), [(r["doc_id"], r["text"]) for r in given("documents").collect()])):
        want = Counter()
        for i, t, *_ in rows:
            s = plain_spans(t)
            want[(i, *(sum(k == x for _, x, _ in s) for k in range(3)), sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s)))] += 1
        assert Counter(tuple(r)[:5] for r in secrets.find(table).collect()) == want
    assert secrets.find(no_docs).count() == 0


def test_secret_spans_against_a_plain_version(spark, docs, doc_rows, given):
    """All runs of all texts, their p-values, and the procedure of Benjamini and Hochberg over each class of length, in plain loops."""
    for table, rows in ((docs, [(i, t) for i, t, *_ in doc_rows]), (given("documents"), [(r["doc_id"], r["text"]) for r in given("documents").collect()])):
        letters = secrets.letter_model(sum((secrets.bigrams([t or ""]) for _, t in rows), np.zeros((26, 26))))
        runs = []
        for k, (_, t) in enumerate(rows):
            for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t or ""):
                for a, b in secrets._rests(*m.span(), secrets.base_spans(t), t):
                    p_random, p_text = secrets.battery(t[a:b], letters)
                    level = min(secrets.BINS - 1, int(-np.log10(max(p_text, 1e-300)) / secrets.BIN))
                    runs.append((min(secrets.LENGTHS - 1, (b - a).bit_length()), level if p_random >= secrets.ALPHA else -1, k, a, b))
        found = defaultdict(list)
        for length in {r[0] for r in runs}:
            of = sorted((r for r in runs if r[0] == length), key=lambda r: -r[1])
            last = 0
            for n in range(1, len(of) + 1):
                end_of_ties = n == len(of) or of[n][1] != of[n - 1][1]
                if end_of_ties and of[n - 1][1] >= 0 and 10.0 ** (-secrets.BIN * of[n - 1][1]) <= secrets.FDR * n / len(of):
                    last = n
            for _, _, k, a, b in of[:last]:
                found[k].append((a, 3, b))
        want = Counter()
        for k, (i, t) in enumerate(rows):
            spans = sorted(secrets.base_spans(t or "") + found[k])
            want[(i, ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in spans))] += 1
        assert Counter((r["doc_id"], r["spans"]) for r in secrets.find(table).collect()) == want


def test_ids_of_any_size_stay_as_they_are(spark, given):
    """Ids beyond 2^53 beside a null in one batch."""
    ids = [2**53, 2**53 + 1, None, -(2**62) - 1]
    table = spark.createDataFrame([(i, f"some words of text {k} password=abcdef12", "x", "en") for k, i in enumerate(ids)], "doc_id long, text string, size string, lang string").coalesce(1)
    labels = given("labels").limit(0)
    key = lambda xs: sorted(xs, key=str)
    for out in (quality.predict(table, labels), toxicity.predict(table, labels), secrets.find(table), langid.predict(table), bpe.token_digests(table), ngram_join.join(table), substring_dedup.dedup(table), shards.shard(table, name="big")):
        assert key(r["doc_id"] for r in out.collect()) == key(ids)


def test_randomness_battery(spark):
    rnd = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rnd.choice(alphabet) for _ in range(40)) for _ in range(60)]
    plain = ["TheQuickBrownFoxJumpsOverTheLazyDog", "internationalization_of_long_words", "aaaaaaaaaaaaaaaaaaaaaaaa1", "2024-01-02-2024-01-03-2024", "src/main/java/org/example/Application", "ABCABCABCABCABCABCABCABC12"]
    rows = [(i, f"key {k} end") for i, k in enumerate(keys)] + [(100 + i, f"word {w} end") for i, w in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.find(docs).where("spans like '%random%'").collect()}
    assert len(found & set(range(60))) >= 54 and not found & set(range(100, 110))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(("[random]" in clean[i]) == (i in found) for i in clean) and clean[100] == "word TheQuickBrownFoxJumpsOverTheLazyDog end"


def test_keys_of_letters_and_rests_of_runs(spark, prose):
    """Random keys of one case are found, words of one case aren't; a key that a sign joins to another span is one, too."""
    rnd = random.Random(3)
    key = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    upper, lower_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = [key(a, n) for a in (upper, lower_) for n in (24, 32, 40) for _ in range(20)]
    words = ["internationalorganization", "INTERNATIONALORGANIZATION", "thepeoplewhocouldnotcomehome", "differentgovernmentsthinkalike", "BEFOREANDAFTEREVERYSENTENCE"]
    rests = [key(upper + lower_ + "0123456789", 40) for _ in range(20)]
    rows = [(i, f"key {k} end") for i, k in enumerate(keys)] + [(200 + i, f"word {w} end") for i, w in enumerate(words)]
    rows += [(300 + i, f"AKIA{key(upper, 16)}{'/+-_='[i % 5]}{k} end") for i, k in enumerate(rests)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.find(docs).where("spans like '%random%'").collect()}
    assert len(found & set(range(120))) >= 108 and not found & set(range(200, 205)) and len(found & set(range(300, 320))) >= 17
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(("[random]" in clean[i]) == (i in found) for i in clean)
    assert all((k in clean[300 + i]) != (300 + i in found) for i, k in enumerate(rests)) and all(clean[200 + i] == f"word {w} end" for i, w in enumerate(words))
    a = "deadbeef" * 3
    assert list(secrets._rests(0, 60, secrets.base_spans(a + "/" * 36), a + "/" * 36)) == [(25, 60)]


# 10

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = Counter()
    for i, t, *_ in rows:
        w, hit, ids = ITEM.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out[(i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))] += 1
    return out


def test_decontamination(spark, docs, doc_rows, no_docs, given):
    words = doc_rows[0][1].split()
    items = [(1, " ".join(words[20:45])), (2, " ".join(words[40:47]).upper()), (3, "ONE two-three"), (4, ""), (5, None), (6, "never seen words " * 5), (7, "same same"), (8, " ".join(words[20:45])), (9, "É"), (10, "x" * 50_000)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontam.find(docs, table).collect()) == leaks(doc_rows, items)
    assert decontam.find(no_docs, table).count() == 0 and decontam.find(docs, table.limit(0)).where("contaminated").count() == 0
    kept = decontam.clean(docs, table)
    assert kept.columns == docs.columns and 0 not in {r["doc_id"] for r in kept.collect()}
    rows = [(r["doc_id"], r["text"]) for r in given("documents").collect()]
    assert Counter(tuple(r) for r in decontam.find(given("documents"), given("benchmark")).collect()) == leaks(rows, [tuple(r) for r in given("benchmark").collect()])


def test_decontamination_without_broadcasts(docs, given, monkeypatch):
    want = Counter(tuple(r) for r in decontam.find(given("documents"), given("benchmark")).collect())
    monkeypatch.setattr(decontam, "sized", lambda df: df)
    assert Counter(tuple(r) for r in decontam.find(given("documents"), given("benchmark")).collect()) == want


def test_native_plans_run_no_python(spark, sf_dir):
    for name in ("op3_sharding", "op10_decontamination"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
