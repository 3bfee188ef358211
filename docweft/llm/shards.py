"""Sharding by fixed virtual slots.

Every record is hashed to one of thousands of slots, for good. A small map says
which shard holds each slot; its versions are kept. Rebalancing edits the map:
whole slots move from the heaviest shard to the lightest, by the bytes counted
per slot, until no move helps. A new shard takes slots only into itself.

Only the slots' totals reach the driver: their number is a parameter, whatever
the input's size.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import save

SLOTS = 4096
#: Rows of a slot that are numbered in one task, about: larger slots are numbered in parts.
PART_ROWS = 1_000_000


def listed(spark: SparkSession, **columns: tuple[str, tuple[int, ...] | list[int]]) -> DataFrame:
    """A table of vslot (0, 1, ...) and integer columns, as one SQL literal."""
    arrays = [F.split(F.lit(",".join(map(str, values))), ",").alias(name) for name, (_, values) in columns.items()]
    zipped = spark.range(1).select(*arrays).select(F.posexplode(F.arrays_zip(*columns)).alias("vslot", "x"))
    return zipped.select("vslot", *(F.col(f"x.{name}").cast(kind).alias(name) for name, (kind, _) in columns.items()))


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot], with the bytes and rows of each slot when the map was made."""

    version: int
    shard_of: tuple[int, ...]
    n_bytes: tuple[int, ...]
    n_rows: tuple[int, ...]

    @property
    def shards(self) -> int:
        return max(self.shard_of) + 1

    def loads(self, shards: int | None = None) -> list[int]:
        out = [0] * (shards or self.shards)
        for s, b in zip(self.shard_of, self.n_bytes, strict=True):
            out[s] += b
        return out

    def rebalanced(self, shards: int | None = None) -> SlotMap:
        """Next version: move the slot that best halves the gap of heaviest and lightest, while one does."""
        shards = shards or self.shards
        owner, load = list(self.shard_of), self.loads(shards)
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, (s, b) in enumerate(zip(owner, self.n_bytes, strict=True)):
            if b:
                held[s].append((b, slot))
        for x in held:
            x.sort()
        while True:
            heavy, light = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[heavy] - load[light]
            k = bisect.bisect_right(held[heavy], (gap // 2, len(owner)))
            near = [held[heavy][i] for i in (k - 1, k) if 0 <= i < len(held[heavy]) and held[heavy][i][0] < gap]
            if not near:
                return SlotMap(self.version + 1, tuple(owner), self.n_bytes, self.n_rows)
            b, slot = min(near, key=lambda x: (abs(2 * x[0] - gap), x))
            held[heavy].remove((b, slot))
            bisect.insort(held[light], (b, slot))
            owner[slot] = light
            load[heavy] -= b
            load[light] += b

    def grown(self) -> SlotMap:
        """Next version with one more shard, which takes slots from the heaviest until it has its share."""
        new, owner, load = self.shards, list(self.shard_of), [*self.loads(), 0]
        share = sum(load) / (new + 1)
        for slot in sorted(range(len(owner)), key=lambda s: (-self.n_bytes[s], s)):
            old = owner[slot]
            if load[old] - self.n_bytes[slot] >= share * 0.98 and load[new] + self.n_bytes[slot] <= share:
                owner[slot] = new
                load[old] -= self.n_bytes[slot]
                load[new] += self.n_bytes[slot]
        return SlotMap(self.version + 1, tuple(owner), self.n_bytes, self.n_rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return listed(spark, shard=("int", self.shard_of), n_rows=("bigint", self.n_rows), n_bytes=("bigint", self.n_bytes)).select(F.lit(self.version).alias("version"), "vslot", "shard", "n_rows", "n_bytes")

    def store(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table at `path`."""
        self.frame(spark).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.filter(F.col("version") == version).orderBy("vslot").collect()
    return SlotMap(version, tuple(r["shard"] for r in rows), tuple(r["n_bytes"] for r in rows), tuple(r["n_rows"] for r in rows))


def slot_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null text: null) and vslot.

    The slot hashes doc_id with the text's checksum, so rows that repeat an id, or
    have none, still spread; exact repeats of a whole row share a slot.
    """
    crc = F.crc32(F.col("text").cast("binary"))
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1).cast("long")).alias("size"), crc.alias("text_crc32")).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_map(records: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 0 (slots dealt round) for the records' totals per slot."""
    totals = {r["vslot"]: (r["b"], r["n"]) for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    return SlotMap(0, tuple(k % shards for k in range(slots)), tuple(totals.get(k, (0, 0))[0] for k in range(slots)), tuple(totals.get(k, (0, 0))[1] for k in range(slots)))


def numbered(records: DataFrame, start: SlotMap, part_rows: int = PART_ROWS) -> DataFrame:
    """Records with `inside`, their place in their slot, gapless from 0.

    A slot of more than `part_rows` rows is cut into parts by rid, the row's saved
    number, so exact repeats of a row do not meet in one task either. The parts'
    counts are a table of slots + rows / part_rows rows; they are put one after another.
    """
    parts = listed(records.sparkSession, parts=("bigint", [max(1, -(-n // part_rows)) for n in start.n_rows]))
    cut = records.join(F.broadcast(parts), "vslot").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts", "rid")
    upto = Window.partitionBy("vslot").orderBy("part")  # parts of one slot
    offsets = cut.groupBy("vslot", "part").agg(F.count("*").alias("n")).select("vslot", "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    own = cut.withColumn("own", F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    return own.join(offsets, ["vslot", "part"]).withColumn("inside", F.col("before") + F.col("own")).drop("part", "own", "before")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, store: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, vslot, shard and slot (place in the shard, gapless from 0).

    Shards have near equal bytes, as near as the largest slot and row allow. Rows
    in a slot of `part_rows` rows or fewer stand in order of doc_id (nulls first),
    checksum and size; larger slots are ordered so in parts. With `store`, versions
    0 and 1 of the map are appended to that table. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    records = save(slot_records(docs, slots).withColumn("rid", F.monotonically_increasing_id()), "records")
    start = slot_map(records, shards, slots)
    final = start.rebalanced(shards)
    if store:
        start.store(spark, store)
        final.store(spark, store)
    before, first = [0] * shards, []
    for owner, n in zip(final.shard_of, final.n_rows, strict=True):
        first.append(before[owner])
        before[owner] += n
    places = listed(spark, shard=("int", final.shard_of), first=("bigint", first))
    placed = numbered(records, start, part_rows).join(F.broadcast(places), "vslot")  # `slots` rows of 16 bytes
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("inside")).alias("slot"))
