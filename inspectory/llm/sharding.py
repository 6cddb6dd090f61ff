"""Sharding by fixed virtual slots.

Each record hashes to one of thousands of slots that never change. Bytes are summed by slot, and a versioned map tells
which shard owns which slot. A run loads the newest version, edits it where the sums ask for it, and writes the next one
once; only the edited slots' records move. A version that exists is never written again. Only the slot sums (one row for
each slot, a fixed number) reach the driver.

A null id has a hash like any other value; a null text has no bytes and a very long one only its number of them; repeated
rows and other ties each keep a place of their own; an empty table gives an empty result and leaves the map as it was.
Input columns named like the added ones are replaced, other columns are kept.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, written

SLOTS, ROW_OVERHEAD = 8192, 16


@dataclass(frozen=True)
class SlotMap:
    """Owner of each slot. Every edit makes a new version."""

    owners: tuple[int, ...]
    shards: int
    version: int = 0
    log: tuple[str, ...] = field(default=())

    @staticmethod
    def even(slots: int, shards: int) -> SlotMap:
        return SlotMap(tuple(s % shards for s in range(slots)), shards, 0, ("even",))

    def rebalanced(self, loads: dict[int, int], shards: int | None = None) -> SlotMap:
        """A shard above the mean keeps its largest slots that fit below it and gives up the rest; freed slots go, largest first, to the lightest shard."""
        shards = shards or self.shards
        mean = sum(loads.values()) / shards
        held: dict[int, list[int]] = {}
        for slot, shard in enumerate(self.owners):
            held.setdefault(shard, []).append(slot)
        total, freed, owners = [0] * shards, [], list(self.owners)
        for shard, slots in held.items():
            over, load = sum(loads.get(s, 0) for s in slots) > mean, 0
            for s in sorted(slots, key=lambda s: (-loads.get(s, 0), s)):
                if shard >= shards or (over and load + loads.get(s, 0) > mean):
                    freed.append(s)
                else:
                    load += loads.get(s, 0)
            if shard < shards:
                total[shard] = load
        light = [(load, shard) for shard, load in enumerate(total)]
        heapq.heapify(light)
        for s in sorted(freed, key=lambda s: (-loads.get(s, 0), s)):
            load, shard = heapq.heappop(light)
            owners[s] = shard
            heapq.heappush(light, (load + loads.get(s, 0), shard))
        moved = sum(a != b for a, b in zip(owners, self.owners))
        if not moved and shards == self.shards:
            return self
        return SlotMap(tuple(owners), shards, self.version + 1, (*self.log, f"rebalanced: {moved} slots moved"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version; an error if it exists."""
        rows = [(self.shards, s, o) for s, o in enumerate(self.owners)]
        spark.createDataFrame(rows, "shards int, virtual_slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A version, the newest by default; none if there is no map yet."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = [int(f.getPath().getName()[8:]) for f in store.listStatus(at) if f.getPath().getName().startswith("version=")] if store.exists(at) else []
        if not known:
            return None
        version = max(known) if version is None else version
        saved = spark.read.parquet(f"{path.rstrip('/')}/version={version}").orderBy("virtual_slot").collect()  # a fixed number of rows
        return SlotMap(tuple(r.shard for r in saved), saved[0].shards, version, ("loaded",))


def with_slot(df: DataFrame, id_col: str = "doc_id", slots: int = SLOTS, tie: tuple[str, ...] = ()) -> DataFrame:
    """A slot by hash of the id, and of what tells unlike rows of one id (or of none) apart."""
    return df.withColumn("virtual_slot", F.pmod(F.xxhash64(id_col, *tie), F.lit(slots)).cast("int"))


def shard_by_slots(sized: DataFrame, shards: int, id_col: str = "doc_id", tie: tuple[str, ...] = (), slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Add shard, slot (place in its shard, gapless from 0), virtual_slot and map_version to rows that have a ``size``; returns the map too."""
    spark = sized.sparkSession
    rows = written(with_slot(sized, id_col, slots, tie), "slotted")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most `slots` rows
    loads, counts = {r.virtual_slot: r.bytes for r in sums}, {r.virtual_slot: r.rows for r in sums}
    path = map_path or f"{scratch_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    last = SlotMap.load(spark, path)
    if last is not None and len(last.owners) != slots:
        raise ValueError(f"the map at {path} has {len(last.owners)} slots, not {slots}: their number never changes")
    if last is None:
        (last := SlotMap.even(slots, shards)).save(spark, path)
    now = last.rebalanced(loads, shards)
    if now is not last:
        now.save(spark, path)
    ends, table = [0] * shards, []
    for s, shard in enumerate(now.owners):
        table.append((s, shard, ends[shard]))
        ends[shard] += counts.get(s, 0)
    owners = spark.createDataFrame(table, "virtual_slot int, shard int, before long")  # a fixed number of rows
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, *tie))
    out = rows.drop("shard", "before").join(F.broadcast(owners), "virtual_slot")
    return out.withColumn("slot", (F.col("before") + place - 1).cast("long")).withColumn("map_version", F.lit(now.version)).drop("before"), now


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD
    sized = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed, _ = shard_by_slots(sized, 40, tie=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
