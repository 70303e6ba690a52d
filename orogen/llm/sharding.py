"""Sharding by fixed virtual slots and a versioned slot-to-shard map. DataFrame functions only.

Records are hashed into a fixed number of virtual slots, bytes are summed per slot, and a small map
sends each slot to a shard. Rebalancing edits the map: slots move from the fullest to the emptiest
shard while that narrows the gap, and the edit is stored as a new version. Records never change their
slot, so a new version moves only the slots that it names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cells_for, documents, materialize, scratch_dir

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shards[slot] is the slot's shard."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def column(self, slot: Column) -> Column:
        """The shard of a slot, as one constant array inside the plan (n_slots entries, fixed)."""
        return F.split(F.lit(",".join(map(str, self.shards))), ",")[slot.cast("int")].cast("int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version; earlier ones stay, so any version can be read again."""
        rows = spark.range(len(self.shards)).select(F.col("id").alias("slot"), self.column(F.col("id")).alias("shard"), F.lit(self.n_shards).alias("n_shards"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest version stored in a folder; None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(x.removeprefix("version=")) for x in names if x.startswith("version=")), default=None)


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    return SlotMap(0, n_shards, tuple(s % n_shards for s in range(n_slots)))


def rebalance(old: SlotMap, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
    """Edit the map until no single move from the fullest to the emptiest shard narrows their gap.

    The work is bounded by the number of slots, whatever the number of records.
    """
    n = n_shards or old.n_shards
    shards = [s % n for s in old.shards]
    loads = [0] * n
    held: list[dict[int, int]] = [{} for _ in range(n)]
    for slot, shard in enumerate(shards):
        if size := slot_bytes.get(slot, 0):
            loads[shard] += size
            held[shard][slot] = size
    for _ in range(8 * len(shards)):
        full = max(range(n), key=lambda s: (loads[s], -s))
        bare = min(range(n), key=lambda s: (loads[s], s))
        gap = loads[full] - loads[bare]
        moves = [(abs(gap - 2 * size), slot) for slot, size in held[full].items() if size < gap]
        if not moves:
            break
        slot = min(moves)[1]
        size = held[full].pop(slot)
        held[bare][slot] = size
        loads[full] -= size
        loads[bare] += size
        shards[slot] = bare
    return SlotMap(old.version + 1, n, tuple(shards))


def record_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null text as the empty one), text_key."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("text_key"),
    )


def slots_of(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds virtual_slot, which the text alone decides: equal texts share a slot and so a shard."""
    return records.withColumn("virtual_slot", F.pmod(F.xxhash64("text_key", "size"), F.lit(n_slots)))


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row of docs into one of n_shards shards so that bytes are near equal.

    Returns per row: doc_id, size, text_crc32, law ('bytes'), shard, slot (the row's place in its
    shard, gapless from 0), grown_shard (null under this law), virtual_slot, map_version. Repeated
    rows each keep their own place. Null doc_id and null text are hashed like values; an empty table
    gives no rows; other columns are not read. Equal texts, and one row larger than a fair share, stay
    together, so the shard that holds a heavier group than that is larger than the others, which are near
    equal among themselves. map_path: the folder of the map's versions; the newest one is edited and stored
    as the next. Without it, a folder of scratch begins with the even map as version 0.
    """
    spark = docs.sparkSession
    map_path = map_path or f"{scratch_dir(spark)}/shard-map-{uuid.uuid4().hex}"
    version = latest_version(spark, map_path)
    if version is None:
        version = 0
        first_map(n_shards, n_slots).save(spark, map_path)
    old = load_map(spark, map_path, version)
    records = materialize(record_digests(docs, doc_id, text), "shard-records")
    placed = slots_of(records, len(old.shards))
    per_slot = {r["virtual_slot"]: r["b"] for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}
    rebalance(old, per_slot, n_shards).save(spark, map_path)
    new = load_map(spark, map_path, version + 1)
    cell = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(cells_for(records.count())))
    keys = ["shard", "cell", "doc_id", "size", "text_crc32", "virtual_slot"]
    same = placed.withColumn("shard", new.column(F.col("virtual_slot"))).withColumn("cell", cell).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size", "virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = same.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    first = cells.select("shard", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rows = same.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(first, ["shard", "cell"])
    at = F.col("first") + F.col("before")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.explode(F.sequence(at, at + F.col("n") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(new.version).alias("map_version"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), n_shards=16)
