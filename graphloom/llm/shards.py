"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's hash puts it into one of VIRTUAL_SLOTS slots for good. One aggregation gives the bytes of each slot, and a
versioned map gives each slot its shard. Version 1 deals slots in turn; a rebalancing edits it: slots move, or swap,
between the fullest and the emptiest shard until their sizes are near equal. Growing by a shard is such an edit too, and
moves slots into the new shard only. Maps have VIRTUAL_SLOTS rows whatever the table, so the driver may edit them.

Every version is stored, in the shared folder under a name, and none is ever overwritten. A run takes the newest version,
measures the table's loads and stores an edit as the next version, or none if the sizes are still near equal.

A record's slot in its shard, gapless from 0, is its rank in its virtual slot plus the records in the shard's earlier
virtual slots: no window spans a whole shard.

The hash takes id and text, so copies of a text with ids of their own spread. Defined cases: a null text is an empty one; a
null id hashes as such; repeated rows share a virtual slot and have slots of their own; an
empty table gives no row; further columns pass through place() with ours renamed where names clash.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import column_names, shared_dir

VIRTUAL_SLOTS = 4096
SHARDS = 24
#: Rebalancing stops when the fullest shard has at most this share more than the emptiest, or nothing helps.
TOLERANCE = 0.001


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] under a version; load holds bytes and records of each slot as last measured."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    n_bytes: tuple[int, ...]
    n_rows: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.n_bytes[slot]
        return out


def measured(m: SlotMap, records: DataFrame) -> SlotMap:
    """m with the loads of records (virtual_slot, size)."""
    n_bytes, n_rows = [0] * len(m.shard_of), [0] * len(m.shard_of)
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        n_bytes[r["virtual_slot"]], n_rows[r["virtual_slot"]] = r["b"], r["n"]
    return replace(m, n_bytes=tuple(n_bytes), n_rows=tuple(n_rows))


def dealt(slots: int = VIRTUAL_SLOTS, n_shards: int = SHARDS) -> SlotMap:
    """Version 1: slots in turn, without loads."""
    return SlotMap(1, n_shards, tuple(i % n_shards for i in range(slots)), (0,) * slots, (0,) * slots)


def rebalance(old: SlotMap, tolerance: float = TOLERANCE) -> SlotMap:
    """The next version, sizes near equal: moves and swaps between the fullest and the emptiest shard; old where nothing moves."""
    of, size = list(old.shard_of), old.n_bytes
    held = [sorted((size[s], s) for s in range(len(of)) if of[s] == k and size[s]) for k in range(old.n_shards)]
    load = old.loads()
    for _ in range(8 * len(of)):
        a, b = load.index(max(load)), load.index(min(load))
        gap = load[a] - load[b]
        if gap <= tolerance * max(1, sum(load) / len(load)):
            break
        # the pair (x from a, y or nothing from b) whose difference is nearest to half the gap
        best = None
        for x, s in held[a]:
            options = [(0, None)]
            i = bisect_left(held[b], (x - gap // 2, -1))
            options += held[b][max(0, i - 1) : i + 1]
            for y, t in options:
                d = x - y
                if 0 < d < gap and (best is None or abs(2 * d - gap) < best[0]):
                    best = (abs(2 * d - gap), (x, s), (y, t))
        if best is None:
            break
        _, (x, s), (y, t) = best
        held[a].remove((x, s))
        held[b].insert(bisect_left(held[b], (x, s)), (x, s))
        of[s] = b
        if t is not None:
            held[b].remove((y, t))
            held[a].insert(bisect_left(held[a], (y, t)), (y, t))
            of[t] = a
        load[a] += y - x
        load[b] += x - y
    return old if tuple(of) == old.shard_of else replace(old, version=old.version + 1, shard_of=tuple(of))


def grow(old: SlotMap) -> SlotMap:
    """The next version with one more shard: slots move from the fullest shards into the new one only."""
    of, size, new = list(old.shard_of), old.n_bytes, old.n_shards
    load = [*old.loads(), 0]
    want = sum(load) / (new + 1)
    held = [sorted((size[s], s) for s in range(len(of)) if of[s] == k and size[s]) for k in range(new)]
    while load[new] < want:
        a = max(range(new), key=load.__getitem__)
        fit = [h for h in held[a] if h[0] <= want - load[new]]
        if not fit or load[a] <= want:
            break
        x, s = fit[len(fit) // 2]
        held[a].remove((x, s))
        of[s] = new
        load[a] -= x
        load[new] += x
    return replace(old, version=old.version + 1, n_shards=new + 1, shard_of=tuple(of))


def map_table(spark: SparkSession, m: SlotMap) -> DataFrame:
    """The map as rows (map_version, virtual_slot, shard, first): first is the slot of its first record in the shard."""
    seen, rows = [0] * m.n_shards, []
    for slot, shard in enumerate(m.shard_of):
        rows.append(f"({slot},{shard},{seen[shard]}L)")
        seen[shard] += m.n_rows[slot]
    table = spark.sql(f"select * from values {','.join(rows)} as t(virtual_slot, shard, first)")
    return table.select(F.lit(m.version).alias("map_version"), "virtual_slot", "shard", "first")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/slot-maps/{name}"


def save(spark: SparkSession, m: SlotMap, name: str) -> str:
    """Store a version of a map beside the others; a version that is there already is an error, so no edit is lost."""
    path = f"{_folder(spark, name)}/version={m.version}"
    rows = ",".join(f"({i},{k},{b}L,{n}L)" for i, (k, b, n) in enumerate(zip(m.shard_of, m.n_bytes, m.n_rows)))
    table = spark.sql(f"select *, {m.n_shards} as n_shards from values {rows} as t(virtual_slot, shard, n_bytes, n_rows)")
    table.coalesce(1).write.mode("errorifexists").parquet(path)
    return path


def load(spark: SparkSession, name: str, version: int | None = None) -> SlotMap | None:
    """The newest stored version of a map, or the one asked for; None where none is stored."""
    try:
        stored = spark.read.parquet(_folder(spark, name))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    version = version or stored.agg(F.max("version")).first()[0]
    rows = sorted(stored.where(F.col("version") == version).collect(), key=lambda r: r["virtual_slot"])
    if not rows:
        return None
    return SlotMap(version, rows[0]["n_shards"], *(tuple(r[c] for r in rows) for c in ("shard", "n_bytes", "n_rows")))


def with_virtual_slot(df: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """df with size (UTF-8 bytes of text plus 8), text_crc32 and virtual_slot."""
    text = F.coalesce("text", F.lit(""))
    size, crc, slot = column_names(df, "size", "text_crc32", "virtual_slot")
    return df.withColumns(
        {
            size: F.octet_length(text).cast("long") + 8,
            crc: F.crc32(text),
            slot: F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int"),
        }
    )


def place(records: DataFrame, table: DataFrame) -> DataFrame:
    """records (doc_id, size, text_crc32, virtual_slot) with shard, and slot: the place in the shard, gapless from 0."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = records.withColumn("rank", rank)
    return ranked.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("first") + F.col("rank")).drop("rank", "first")


def shard(docs: DataFrame, n_shards: int = SHARDS, name: str = "documents") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every document.

    The map of that name and number of shards is edited where the documents' sizes call for it.
    """
    spark, name = docs.sparkSession, f"{name}-{n_shards}"
    records = with_virtual_slot(docs.select("doc_id", "text")).drop("text")
    old = load(spark, name)
    m = measured(old or dealt(n_shards=n_shards), records)
    if old is None:
        save(spark, m, name)
    new = rebalance(m)
    if new.version != m.version:
        save(spark, new, name)
    return place(records, map_table(spark, new)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
