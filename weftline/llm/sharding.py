"""Sharding by fixed virtual slots.

Every record hashes into one of some thousands of virtual slots, for good. Bytes are summed per
slot, and a small versioned map says which shard holds which slot. Rebalancing writes a new version
of that map, in which few slots change place; records are never hashed anew.

A record's slot depends on its doc_id, so that rows of one doc_id stay together. Rows without a
doc_id, and those of a doc_id that has more bytes than a mean slot, are spread over all slots.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

SLOTS = 4096
RECORD_BYTES = 8
MAP_SCHEMA = "version long, virtual_slot int, shard int, slot_bytes long, slot_rows long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 of each row. A null text has no bytes."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(raw) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )


def slotted(docs: DataFrame, path: str, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row, as a table below ``path``.

    The table is written once: a row that is spread has its slot from a number of its own in it, which
    another reading of ``docs`` need not repeat.
    """
    home = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(slots)).cast("int")
    spread = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    rows = materialise(sized(docs).withColumn("spread", spread).withColumn("home", F.when(F.col("doc_id").isNotNull(), home)), f"{path}/sized")
    by_slot = rows.groupBy("home").agg(F.sum("size").alias("b"))
    total = by_slot.agg(F.sum("b")).first()[0] or 0
    mean = math.ceil(total / slots)
    # a key has to be in a slot over the mean to be over it; both are fewer than there are slots
    full = F.broadcast(by_slot.filter(F.col("home").isNotNull() & (F.col("b") > mean)).select("home"))
    heavy = rows.join(full, "home", "left_semi").groupBy("doc_id").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    heavy = materialise(heavy.filter((F.col("n") > 1) & (F.col("b") > mean)).select("doc_id", F.lit(True).alias("heavy")), f"{path}/heavy")
    placed_rows = rows.join(F.broadcast(heavy), "doc_id", "left")
    slot = F.when(F.col("home").isNull() | F.col("heavy"), F.col("spread")).otherwise(F.col("home"))
    return placed_rows.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes, rows and largest row of each slot that has any: at most ``slots`` rows, summed before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"), F.max("size").alias("largest"))


def packed(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """slot -> shard: the largest slot left goes to the lightest shard; ties by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def rebalanced(current: dict[int, int], sizes: dict[int, int], shards: int, slack: float = 0.001, row: int | None = None) -> dict[int, int]:
    """A map for new sizes or another number of shards that moves slots only off shards over the mean.

    Slots of a shard that is no more are placed anew. A shard gives up slots, largest first that
    fits, until it is within ``slack`` of the mean; what was given up is packed greedily. Then a slot goes
    from the fullest shard to the lightest, or changes places with one of it, until they differ by
    ``slack`` of the mean, and by a ``row``'s size, at most, or nothing evens them out. Ties go by number.
    """
    mean = sum(sizes.values()) / max(1, shards)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    loose = []
    for slot in sorted(sizes):
        at = current.get(slot)
        (held[at] if at is not None and at in held else loose).append(slot)
    load = {s: sum(sizes[x] for x in own) for s, own in held.items()}
    for s, own in held.items():
        for slot in sorted(own, key=lambda x: (-sizes[x], x)):
            if load[s] > mean * (1 + slack) and sizes[slot] <= load[s] - mean * (1 - slack):
                loose.append(slot)
                own.remove(slot)
                load[s] -= sizes[slot]
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda x: (-sizes[x], x)):
        at, s = heapq.heappop(heap)
        held[s].append(slot)
        load[s] += sizes[slot]
        heapq.heappush(heap, (at + sizes[slot], s))
    goal = slack * mean if row is None else min(slack * mean, row)
    for _ in range(len(sizes)):
        full, light = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[light]
        if gap <= goal:
            break
        back = sorted([(0, -1), *((sizes[x], x) for x in held[light])])  # -1: nothing comes back
        near = []
        for slot in held[full]:
            at = bisect.bisect(back, (sizes[slot] - gap / 2,))
            near += [(abs(2 * (sizes[slot] - size) - gap), slot, other) for size, other in back[max(0, at - 1) : at + 1] if 0 < sizes[slot] - size < gap]
        if not near:
            break
        _, slot, other = min(near)
        held[full].remove(slot)
        held[light].append(slot)
        if other >= 0:
            held[light].remove(other)
            held[full].append(other)
        moved = sizes[slot] - sizes.get(other, 0)
        load[full] -= moved
        load[light] += moved
    return {slot: s for s, own in held.items() for slot in own}


class SlotMap:
    """The stored map: one Parquet folder per version below ``path``; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, to: dict[int, int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
        rows = [(version, slot, shard, *sizes.get(slot, (0, 0))) for slot, shard in sorted(to.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{self.path}/version={version:06d}/map")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version:06d}/map")

    def create(self, sizes: DataFrame, shards: int) -> DataFrame:
        """Version 1. ``sizes`` has a row per slot at most, so the driver holds thousands of numbers."""
        by = {r[0]: (r[1], r[2]) for r in sizes.select("virtual_slot", "slot_bytes", "slot_rows").collect()}
        return self.write(1, packed(((s, b) for s, (b, _) in by.items()), shards), by)

    def rebalance(self, version: int, sizes: DataFrame, shards: int, row: int | None = None) -> DataFrame:
        """Version + 1: the map of ``version`` edited for new sizes or another number of shards."""
        by = {r[0]: (r[1], r[2]) for r in sizes.select("virtual_slot", "slot_bytes", "slot_rows").collect()}
        old = {r[0]: r[1] for r in self.read(version).select("virtual_slot", "shard").collect()}
        return self.write(version + 1, rebalanced(old, {s: b for s, (b, _) in by.items()}, shards, row=row), by)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the place in the shard from 0 without gaps.

    A slot's rows are numbered by (doc_id, text_crc32, size); its offset is the number of rows in the
    shard's lower slots. The window over the map has a row per slot; no task sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # the map has SLOTS rows at most, whatever the input
    return rows.withColumn("n", F.row_number().over(inside)).join(F.broadcast(bases), "virtual_slot").withColumn("slot", (F.col("base") + F.col("n") - 1).cast("long"))


def shard_documents(docs: DataFrame, path: str, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Every row of ``docs`` with its shard; the versions of the map are stored below ``path``.

    Version 1 deals the slots evenly, whatever they hold; version 2 is that one rebalanced by the bytes
    per slot, and decides. The law is ``bytes``: shards have nearly the same sum of size (UTF-8 bytes
    plus 8), to within the largest row's where slots differ finely enough, as far as no single row is larger than a shard. Null and empty texts have size 8; rows
    without doc_id, and repeated rows, are rows of their own; equal rows of a shard are numbered in any
    order. An empty table gives no rows. Columns of ``docs`` besides doc_id and text are not read.
    """
    rows = slotted(docs, path, slots)
    sizes = materialise(slot_sizes(rows), f"{path}/slots")
    maps = SlotMap(docs.sparkSession, path)
    maps.write(1, {s: s % shards for s in range(slots)}, {})
    largest = sizes.agg(F.max("largest")).first()[0]
    return placed(rows, maps.rebalance(1, sizes, shards, largest)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
