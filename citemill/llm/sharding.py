"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots (thousands, whatever the number of shards). Bytes and
rows are summed per slot, and a versioned map assigns slots to shards. A change of the load or of the number of shards
edits the map and gives it the next version; records never hash anew, so only the rows of edited slots move.

Law held here: ``bytes``, the shards' sizes are near equal.

Defined results: records without a key are dealt over all slots by their place in the input; a null text has no bytes; rows
that repeat a key share a slot and get different places (ties by checksum, then size); an empty table gives an empty result; columns
besides key and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, fresh_path, settled, text_or_empty

SLOTS = 8192
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """shard[s] is the shard of virtual slot s; history is kept by storing each version beside the others."""

    version: int
    n_shards: int
    shard: tuple[int, ...]

    @classmethod
    def first(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, n_shards, tuple(s % n_shards for s in range(slots)))

    def edited(self, load: list[int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots leave shards over the mean, and go to the lightest; then single moves and swaps
        between the heaviest and the lightest shard narrow the spread as long as they help."""
        n = n_shards or self.n_shards
        shard, total = list(self.shard), [0] * n
        for s, b in enumerate(load):
            if shard[s] < n:
                total[shard[s]] += b
        mean = sum(load) / n
        pool = [s for s in range(len(load)) if shard[s] >= n]
        for s in sorted((s for s in range(len(load)) if shard[s] < n), key=lambda s: (-load[s], s)):
            if total[shard[s]] - load[s] >= mean:
                total[shard[s]] -= load[s]
                pool.append(s)
        # what still exceeds the mean gives up its largest slots as well, so that the pool can even everything out
        own: list[list[int]] = [[] for _ in range(n)]
        taken = set(pool)
        for s in range(len(load)):
            if s not in taken:
                own[shard[s]].append(s)
        for k in range(n):
            own[k].sort(key=lambda s: (load[s], s))
            while own[k] and total[k] > mean:
                s = own[k].pop()
                total[k] -= load[s]
                pool.append(s)
        for s in sorted(pool, key=lambda s: (-load[s], s)):
            k = min(range(n), key=lambda k: (total[k], k))
            shard[s] = k
            total[k] += load[s]
            own[k].append(s)
        for _ in range(64 * n):
            high, low = max(range(n), key=lambda k: (total[k], k)), min(range(n), key=lambda k: (total[k], k))
            gap = total[high] - total[low]
            best: tuple[int, int, int | None] | None = None
            light = sorted(own[low], key=lambda s: load[s])
            sizes = [load[s] for s in light]
            for s in own[high]:
                if 0 < load[s] < gap:
                    best = min(best or (gap, 0, 0), (abs(gap - 2 * load[s]), s, -1))
                t = _nearest(sizes, load[s] - gap // 2)
                if t is not None and 0 < load[s] - sizes[t] < gap:
                    best = min(best or (gap, 0, 0), (abs(gap - 2 * (load[s] - sizes[t])), s, light[t]))
            if best is None or best[0] >= gap:
                break
            _, s, t = best
            for x, a, b in ((s, high, low), (t, low, high)):
                if x >= 0:
                    own[a].remove(x)
                    own[b].append(x)
                    shard[x] = b
                    total[a] -= load[x]
                    total[b] += load[x]
        return SlotMap(self.version + 1, n, tuple(shard))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, s, k) for s, k in enumerate(self.shard)]
        return spark.createDataFrame(rows, "version int, n_shards int, vslot int, shard int")


def _nearest(sizes: list[int], want: int) -> int | None:
    import bisect

    i = bisect.bisect_left(sizes, want)
    near = [j for j in (i - 1, i) if 0 <= j < len(sizes)]
    return min(near, key=lambda j: abs(sizes[j] - want)) if near else None


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds one version to the stored map; versions are never overwritten."""
    slot_map.frame(spark).coalesce(1).write.mode("error").parquet(f"{path}/v={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{path}/v={version}").orderBy("vslot").collect()  # one row per virtual slot
    return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows))


def slotted(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size (UTF-8 bytes plus 16), text_crc32, vslot; stored, so that a record without a key keeps the slot that it was dealt."""
    body = text_or_empty(text)
    spread = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    found = df.select(
        F.col(key),
        (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(spread, F.lit(slots)).cast("int").alias("vslot"),
    )
    return settled(found)


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot; partial sums per task, then one row per slot (a fixed number)."""
    load, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        load[r.vslot], count[r.vslot] = r.b, r.n
    return load, count


def assign(rows: DataFrame, slot_map: SlotMap, counts: list[int], key: str = "doc_id") -> DataFrame:
    """Adds shard and the record's place there. A place is the number of rows in the shard's earlier virtual slots plus
    the rank in the own one, so that ranking is spread over all virtual slots and no shard is sorted as a whole."""
    base, at = [], [0] * slot_map.n_shards
    for s, k in enumerate(slot_map.shard):
        base.append((s, k, at[k]))
        at[k] += counts[s]
    places = rows.sparkSession.createDataFrame(base, "vslot int, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(key, "text_crc32", "size"))
    ranked = rows.withColumn("_rank", rank)
    return ranked.join(F.broadcast(places), "vslot").withColumn("slot", F.col("base") + F.col("_rank") - 1)


def op6_virtual_slots(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    rows = slotted(documents(spark, sf_dir, "doc_id", "text"))
    load, counts = slot_loads(rows)
    path, first = fresh_path(spark, "slot-map"), SlotMap.first(n_shards)
    save_map(spark, first, path)
    save_map(spark, first.edited(load), path)
    current = load_map(spark, path, first.version + 1)
    return assign(rows, current, counts).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(current.version).alias("map_version"),
    )
