"""Sharding by fixed virtual slots.

Records are hashed into ``SLOTS`` slots, a number that never changes. Bytes and rows are added up per slot, and a small
versioned table says which shard holds which slot. Rebalancing and new shards only edit that table: whole slots move,
no record is hashed anew. The law kept is ``bytes``: shard sizes are near equal.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.session import fresh_dir, settle

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16  # bytes a row costs beyond its text

Load = tuple[int, int]  # bytes and rows of a slot


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, record, copy): what is known of every row once its text has been read.

    ``record`` hashes id and text; ``copy`` tells equal records apart.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("record"),
        F.monotonically_increasing_id().alias("copy"),
    )


def in_slots(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`sized` with ``vslot``.

    A record that alone has more than a mean slot's bytes or rows (equal rows, many times) is spread over as many slots
    as it fills. There are at most 2 * SLOTS such records, since each holds more than 1 / SLOTS of all bytes or rows:
    that bounds the broadcast.
    """
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = F.greatest(F.col("bytes") / F.lit(float(max(total, 1))), F.col("n") / F.lit(float(max(n, 1)))) * SLOTS
    heavy = rows.groupBy("record").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (share > 1))
    heavy = settle(heavy.select("record", F.ceil(share).alias("pieces")))
    piece = F.coalesce(F.pmod("copy", "pieces"), F.lit(0))
    hashed = F.pmod(F.xxhash64("record", piece), F.lit(SLOTS)).cast("int")
    return rows.join(F.broadcast(heavy), "record", "left").withColumn("vslot", hashed).drop("pieces")


def slot_loads(slotted: DataFrame) -> dict[int, Load]:
    """Bytes and rows of the slots in use, SLOTS entries at most."""
    found = slotted.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()
    return {r[0]: (r[1], r[2]) for r in found}


def even_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The first version: slots dealt over the shards in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(slot_map: list[int], loads: dict[int, Load], shards: int) -> list[int]:
    """The next version of ``slot_map`` over ``shards`` shards (as many as before, or more).

    The fullest shard gives the emptiest one the slot that comes closest to evening them out, until no such move is
    left; a shard that is new fills that way. At the end the fullest shard is above the emptiest by no more than its
    smallest slot. What does not help to balance stays where it is.
    """
    out = list(slot_map)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    size = [0] * shards
    for slot, (b, _) in loads.items():
        held[out[slot]].append((b, slot))
        size[out[slot]] += b
    for h in held:
        h.sort()
    order = sorted((size[k], k) for k in range(shards))
    while len(order) > 1:
        (low, e), (high, f) = order[0], order[-1]
        gap = high - low
        i = bisect_left(held[f], (gap / 2, -1))
        near = [held[f][j] for j in (i - 1, i) if 0 <= j < len(held[f]) and 0 < held[f][j][0] < gap]
        if not near:
            break
        b, slot = min(near, key=lambda x: (abs(gap - 2 * x[0]), x))
        held[f].remove((b, slot))
        insort(held[e], (b, slot))
        out[slot] = e
        order = order[1:-1]
        insort(order, (low + b, e))
        insort(order, (high - b, f))
    return out


class SlotMaps:
    """The versioned slot-to-shard table in a folder: one Parquet part per version, never rewritten."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_dir(spark, "slots")

    def store(self, version: int, slot_map: list[int], loads: dict[int, Load]) -> DataFrame:
        """Write a version; it has the slots' loads as they were when it was made."""
        rows = [(slot, shard, *loads.get(slot, (0, 0))) for slot, shard in enumerate(slot_map)]
        df = self.spark.createDataFrame(rows, "vslot int, shard int, bytes long, rows long")
        df.coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def assignment(self, version: int) -> list[int]:
        """The map of a version as a list (SLOTS entries)."""
        return [r.shard for r in self.read(version).orderBy("vslot").collect()]


def _starts(version: DataFrame) -> DataFrame:
    """(vslot, shard, start): where a slot's rows begin in its shard. SLOTS rows, so it may be broadcast."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    return version.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))


def sharded(docs: DataFrame, shards: int = SHARDS, maps: SlotMaps | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, shard, slot): where every row goes.

    ``slot`` is the row's place in its shard, gapless from 0: the rows of a virtual slot stand together, by doc_id.
    Version 0 of the map deals the slots in turn; version 1, the one used, is edited by the bytes counted. A NULL text
    has no bytes and the checksum of an empty one; NULL ids are hashed like any value; repeated rows are placed each,
    and copies of one record that outgrow a slot are spread; the very long text of one record is one slot's load and
    cannot be split; an empty table gives no rows. Only doc_id and text are read.
    """
    maps = maps or SlotMaps(docs.sparkSession)
    rows = settle(sized(docs))
    slotted = settle(in_slots(rows))
    loads = slot_loads(slotted)
    first = even_map(shards)
    maps.store(0, first, loads)
    now = maps.store(1, rebalanced(first, loads, shards), loads)
    inside = Window.partitionBy("vslot").orderBy("doc_id", "record", "copy")
    placed = slotted.withColumn("__at", F.row_number().over(inside) - 1).join(F.broadcast(_starts(now)), "vslot")
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("__at")).cast("long").alias("slot"))


def with_shards(docs: DataFrame, version: DataFrame, name: str = "shard") -> DataFrame:
    """``docs`` with the shard that a stored version gives each record, texts unshuffled.

    Copies of a record stay in one slot here, so that a record is found again from its content alone.
    """
    hashed = F.pmod(F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(0).cast("long")), F.lit(SLOTS)).cast("int")
    m = version.select(F.col("vslot").alias("__vslot"), F.col("shard").alias("__shard"))
    d = docs.select(docs["*"], hashed.alias("__at"))
    return d.join(F.broadcast(m), F.col("__at") == F.col("__vslot")).select(*(d[c] for c in docs.columns), F.col("__shard").alias(name))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(vslot, src, dst, bytes): the slots that an edit of the map moves."""
    a = after.select("vslot", F.col("shard").alias("dst"), "bytes")
    return before.select("vslot", F.col("shard").alias("src")).join(a, "vslot").where("src <> dst")


def law() -> list[Column]:
    """The law's name, and the empty column of a law that is not ``key``."""
    return [F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")]
