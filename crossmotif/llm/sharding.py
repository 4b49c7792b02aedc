"""Sharding by fixed virtual slots (built-in functions only).

Records hash into ``SLOTS`` slots that never change. Bytes are aggregated per slot, and a
slot-to-shard map, stored with a version number, says where each slot lives. Rebalancing
edits entries of the map and raises its version; records are never rehashed. Only the slot
table, ``SLOTS`` rows whatever the input, reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossmotif.runtime import pick, stored

SLOTS = 4096
OVERHEAD = 16
SHARDS = 40
MAP_SCHEMA = "version int, slot int, shard int"


def slotted(docs: DataFrame, law: str, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot). Under ``key`` the slot hashes the id alone; otherwise id and
    content, so that rows without an id spread as well."""
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.xxhash64("doc_id") if law == "key" else F.xxhash64("doc_id", "text_crc32")
    return rows.withColumn("vslot", F.pmod(key, F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> dict[int, int]:
    """Bytes of every slot: at most ``slots`` entries."""
    sums = {r["vslot"]: r["b"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}
    return {s: sums.get(s, 0) for s in range(slots)}


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 1: slots dealt round the shards."""
    return {s: s % shards for s in range(slots)}


def rebalanced(where: dict[int, int], load: dict[int, int], shards: int, tolerance: float = 0.0) -> dict[int, int]:
    """The map edited until no move or swap of slots evens the heaviest and the lightest shard further.

    Slots above the mean are taken off, largest first, and given to the lightest shard; then the heaviest
    shard trades single slots with the lightest while that lowers their difference.
    """
    total = [0] * shards
    homes: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in where.items():
        total[shard] += load[slot]
        homes[shard].append(slot)
    mean = sum(total) / shards
    loose = []
    for shard in range(shards):
        for slot in sorted(homes[shard], key=lambda s: (load[s], s)):
            if total[shard] <= mean * (1 + tolerance):
                break
            homes[shard].remove(slot)
            total[shard] -= load[slot]
            loose.append(slot)
    heap = [(total[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-load[s], s)):
        have, shard = heapq.heappop(heap)
        homes[shard].append(slot)
        total[shard] = have + load[slot]
        heapq.heappush(heap, (total[shard], shard))
    for _ in range(4 * shards):
        high, low = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        out = [(load[s], s) for s in homes[high]] + [(0, -1)]
        back = [(load[s], s) for s in homes[low]] + [(0, -1)]
        best = min(((abs(gap - 2 * (a - b)), a, b, x, y) for a, x in out for b, y in back if a > b), default=None)
        if best is None or best[0] >= gap:
            break
        _, a, b, x, y = best
        for slot, old, new, size in ((x, high, low, a), (y, low, high, b)):
            if slot >= 0:
                homes[old].remove(slot)
                homes[new].append(slot)
                total[old] -= size
                total[new] += size
    return {slot: shard for shard, own in enumerate(homes) for slot in own}


def grown(where: dict[int, int], shards: int) -> dict[int, int]:
    """The map for one more shard: every old shard gives up its last slots, nothing moves between old shards."""
    target = len(where) // (shards + 1)
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in sorted(where.items()):
        own[shard].append(slot)
    out = dict(where)
    for _ in range(target):
        donor = max(own, key=lambda s: (len(own[s]), s))
        out[own[donor].pop()] = shards
    return out


def save_map(spark: SparkSession, versions: list[dict[int, int]], name: str = "slot-map") -> DataFrame:
    """The versioned map as a stored table: one row per version and slot."""
    rows = [(v, slot, shard) for v, where in enumerate(versions, 1) for slot, shard in sorted(where.items())]
    return stored(spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1), name)


def shard(
    docs: DataFrame, law: str = "bytes", shards: int = SHARDS, slots: int = SLOTS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    ``bytes``: the first map is rebalanced by the bytes of its slots; shard sizes end within about one
    record of each other. ``rows``: the same with every record weighing one, and the remainder settled by
    position, so counts differ by one at most. ``key``: shard = map(hash(doc_id)), independent of the data,
    and ``grown_shard`` is the shard after one more is added. ``slot`` numbers the records of a shard from 0
    without gaps, in the order of (virtual slot, doc_id, crc, size). Null texts weigh the overhead only; null
    ids are hashed by content (under ``key`` they share a slot); repeated rows count each time. An empty table gives no row.
    """
    spark = docs.sparkSession
    rows = stored(slotted(docs, law, slots, id_col, text_col), "slotted")
    versions = [first_map(shards, slots)]
    if law == "key":
        versions.append(grown(versions[0], shards))
        current = 1
    elif law in ("bytes", "rows"):
        weights = slot_bytes(rows if law == "bytes" else rows.withColumn("size", F.lit(1)), slots)
        versions.append(rebalanced(versions[0], weights, shards))
        current = 2
    else:
        raise ValueError(f"unknown law {law!r}")
    stored_map = save_map(spark, versions)
    now = stored_map.where(F.col("version") == current).select(F.col("slot").alias("vslot"), "shard")
    counts = rows.groupBy("vslot").agg(F.count("*").alias("n")).join(F.broadcast(now), "vslot")
    if law == "rows":
        # One running number over slots grouped by shard; equal stretches of it are the final shards.
        before = Window.orderBy("shard", "vslot").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("at", F.row_number().over(within).cast("long") - 1).join(F.broadcast(offsets), "vslot")
    out = out.withColumn("place", F.col("before") + F.col("at"))
    if law == "rows":
        total = rows.count()
        size, extra = divmod(total, shards)
        wide = (size + 1) * extra
        place = F.col("place")
        inner = F.when(place < wide, place % (size + 1)).otherwise((place - wide) % max(size, 1))
        which = F.when(place < wide, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - wide) / max(size, 1)))
        out = out.withColumn("shard", which.cast("int")).withColumn("place", inner)
    if law == "key":
        then = stored_map.where("version = 2").select(F.col("slot").alias("vslot"), F.col("shard").alias("grown_shard"))
        out = out.join(F.broadcast(then), "vslot")
    else:
        out = out.withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("place").cast("long").alias("slot"),
        "grown_shard", "vslot", F.lit(current).alias("map_version"),
    )
