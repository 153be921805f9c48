"""Sharding by fixed virtual slots: records hash into thousands of slots, a small versioned map names the shard of each.

A record's slot is a hash of it and never changes. The bytes of each slot are added up, and a rebalancing edits the
map: it moves or exchanges whole slots between shards until no move brings the loads closer, and
stores the result as the next version. Only the map (one row per slot) passes through the driver.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleslens.llm.common import stored, text_or_empty

#: Slots of every map; fixed for the life of a corpus, and the bound of what the driver holds.
SLOTS = 16384
MAP = "version long, virtual_slot int, shard int, bytes long"


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16 for the record), text_crc32, virtual_slot.

    The slot is a hash of the record: its id, size and text. Records that are alike in these, as when a third of
    the rows has no id and one text, are told apart by their place in the input, so that no slot gets them all.
    """
    text = text_or_empty()
    own = ["doc_id", "size", "text_crc32"]
    records = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"))
    records = stored(records)
    alike = records.groupBy(*own).agg(F.count("*").alias("k")).filter("k > 1")
    if alike.head(1):
        twice = alike.select(*[F.col(c).alias(f"__{c}") for c in own], F.lit(True).alias("twice"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own]
        records = records.join(twice, same, "left").withColumn("place", F.when(F.col("twice"), F.col("place")))
    else:
        records = records.withColumn("place", F.lit(None).cast("long"))
    return records.select(*own, F.pmod(F.xxhash64(*own, "place"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every slot that has rows; at most one entry per slot."""
    sums = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return {r.virtual_slot: (r.b, r.n) for r in sums.collect()}


def rebalanced(shard_of: Sequence[int], load: Sequence[int], shards: int) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard while that narrows the gap between them.

    Each edit is the move, or the exchange of two slots, whose difference is nearest to half of
    the gap. Slots on shards that no longer exist are dealt out first.
    """
    shard_of = list(shard_of)
    total = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    loose = []
    for slot, s in enumerate(shard_of):
        if load[slot] and 0 <= s < shards:
            total[s] += load[slot]
            own[s].append((load[slot], slot))
        elif load[slot]:
            loose.append((load[slot], slot))
        elif not 0 <= s < shards:
            shard_of[slot] = slot % shards
    heap = [(t, s) for s, t in enumerate(total)]
    heapq.heapify(heap)
    for size, slot in sorted(loose, reverse=True):
        t, s = heapq.heappop(heap)
        shard_of[slot] = s
        own[s].append((size, slot))
        total[s] = t + size
        heapq.heappush(heap, (total[s], s))
    for x in own:
        x.sort()

    def best(high: int, low: int) -> tuple[int, tuple | None, tuple | None]:
        gap = total[high] - total[low]
        found: tuple[int, tuple | None, tuple | None] = (gap, None, None)
        for item in own[high]:
            want = item[0] - gap // 2  # size to get back in exchange
            at = bisect.bisect_left(own[low], (want, -1))
            for back in [None] + own[low][max(0, at - 1):at + 1]:
                rest = abs(gap - 2 * (item[0] - (back[0] if back else 0)))
                if rest < found[0]:
                    found = (rest, item, back)
        return found

    for _ in range(20 * shards + len(shard_of)):
        high = max(range(shards), key=total.__getitem__)
        for low in sorted(range(shards), key=total.__getitem__)[:8]:
            rest, item, back = best(high, low)
            if item is not None:
                break
        else:
            break
        for got, a, b in ((item, high, low), (back, low, high)):
            if got is not None:
                own[a].remove(got)
                bisect.insort(own[b], got)
                total[a] -= got[0]
                total[b] += got[0]
                shard_of[got[1]] = b
    return shard_of


def first_map(slots: int, shards: int) -> list[int]:
    return [slot % shards for slot in range(slots)]


def map_rows(spark: SparkSession, version: int, shard_of: Sequence[int], load: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(version, i, s, load[i]) for i, s in enumerate(shard_of)], MAP)


def append_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int], load: Sequence[int]) -> None:
    """Add a version to a stored map. Earlier versions stay, so any past layout can be read again."""
    map_rows(spark, version, shard_of, load).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """The given or the last version of a stored map."""
    df = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    rows = df.filter(F.col("version") == version).orderBy("virtual_slot").collect()
    return version, [r.shard for r in rows]


def grown(shard_of: Sequence[int], load: Sequence[int], shards: int) -> list[int]:
    """The map with one more shard, which takes slots from the fullest ones until it has its share; no other row moves."""
    shard_of, new = list(shard_of), shards
    total = [0] * (shards + 1)
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, s in enumerate(shard_of):
        total[s] += load[slot]
        own[s].append((load[slot], slot))
    for x in own:
        x.sort()
    share = sum(total) / (shards + 1)
    while total[new] < share:
        high = max(range(shards), key=total.__getitem__)
        fit = [x for x in own[high] if x[0] and total[new] + x[0] <= share + x[0] / 2]
        if not fit:
            break
        size, slot = fit[-1]
        own[high].remove((size, slot))
        total[high] -= size
        total[new] += size
        shard_of[slot] = new
    return shard_of


def shard(docs: DataFrame, shards: int, path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot of every row.

    The map at ``path`` is read, edited for the present bytes and stored as its next version; with
    no path the edit starts from the even map. ``slot`` numbers the rows of a shard from 0 without
    gaps, by virtual slot and id; equal rows (same id twice) get numbers of their own.
    Null texts count as empty; an empty table gives no rows. Rows are numbered inside virtual slots
    and offset by the rows of the slots before, so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    slotted = stored(with_slots(docs, slots))
    sums = slot_bytes(slotted)
    load = [sums.get(i, (0, 0))[0] for i in range(slots)]
    version, now = (0, first_map(slots, shards)) if path is None else _current(spark, path, slots, shards)
    now = rebalanced(now, load, shards)
    if path is not None:
        append_map(spark, path, version + 1, now, load)
    before, seen = [0] * slots, [0] * shards
    for i in range(slots):
        before[i] = seen[now[i]]
        seen[now[i]] += sums.get(i, (0, 0))[1]
    layout = spark.createDataFrame([(i, now[i], before[i]) for i in range(slots)], "virtual_slot int, shard int, before long")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (slotted.withColumn("n", F.row_number().over(inside) - 1)
            .join(F.broadcast(layout), "virtual_slot")  # one row per slot: SLOTS rows at every size
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("before") + F.col("n")).alias("slot")))


def _current(spark: SparkSession, path: str, slots: int, shards: int) -> tuple[int, list[int]]:
    try:
        return read_map(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        even = first_map(slots, shards)
        append_map(spark, path, 1, even, [0] * slots)
        return 1, even
