"""Sharding by fixed virtual slots.

A record hashes to one of thousands of virtual slots for ever. What moves is the map from slots to shards: it is stored
in versions that never change, and a rebalancing loads the last one and stores a new one, in which single slots have
moved from the heaviest shard to the lightest, by the bytes that each slot holds.

Defined results: a null text has size 1 and crc32 0; records hash by id and text, and rows that are alike in both by
their number too, so repeated or null ids spread. Groups of equal texts are not kept together: a group may hold more
bytes than a shard's share, and its copies are dealt out by their ids like other records. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, repeated, shared_folder, written

SLOTS = 4096


@dataclass
class SlotMap:
    """Slot -> shard in all versions. ``shards``: their number in the last one."""

    shards: int
    slots: int = SLOTS
    versions: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.versions = self.versions or [np.arange(self.slots) % self.shards]

    def at(self, version: int | None = None) -> np.ndarray:
        """Slot -> shard in a version; the newest by default."""
        return self.versions[-1 if version is None else version].copy()

    def rebalance(self, weight: np.ndarray, tolerance: float = 0.0005) -> int:
        """Adds a version that evens out the weights of the shards; returns the number of slots that moved."""
        owner = self.at()
        load = np.bincount(owner, weight, self.shards)
        goal = tolerance * max(1.0, load.mean())
        moves: dict[int, tuple[int, int, int]] = {}
        for _ in range(8 * self.slots):
            high, low = int(load.argmax()), int(load.argmin())
            gap = load[high] - load[low]
            own = np.flatnonzero((owner == high) & (weight > 0) & (weight < gap))
            if gap <= goal or not len(own):
                break
            slot = int(own[np.abs(weight[own] - gap / 2).argmin()])
            owner[slot] = low
            load[high] -= weight[slot]
            load[low] += weight[slot]
            moves[slot] = (slot, moves.get(slot, (0, high))[1], low)
        self.versions.append(owner)
        return sum(x[1] != x[2] for x in moves.values())

    def grow(self, weight: np.ndarray) -> int:
        """Adds a shard and a version in which slots move into it only, until it holds its share."""
        owner = self.at()
        load = np.bincount(owner, weight, self.shards + 1)
        share, moves = load.sum() / (self.shards + 1), []
        while load[self.shards] < share:
            high = int(load[: self.shards].argmax())
            own = np.flatnonzero((owner == high) & (weight > 0) & (weight <= share - load[self.shards]))
            if not len(own):
                break
            slot = int(own[weight[own].argmax()])
            owner[slot] = self.shards
            load[high] -= weight[slot]
            load[self.shards] += weight[slot]
            moves.append((slot, high, self.shards))
        self.shards += 1
        self.versions.append(owner)
        return len(moves)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Stores the versions that ``folder`` does not have yet, each as a table of slots times one row: slot, shard,
        shards. A stored version is never written again."""
        have = _stored(spark, folder)
        for v in range(have, len(self.versions)):
            rows = [(s, int(k), self.shards if v == len(self.versions) - 1 else int(self.versions[v].max()) + 1) for s, k in enumerate(self.versions[v])]
            spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={v}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> SlotMap | None:
        """The stored map; None if there is none."""
        rows = [spark.read.parquet(f"{folder}/version={v}").collect() for v in range(_stored(spark, folder))]
        if not rows:
            return None
        return SlotMap(rows[-1][0]["shards"], len(rows[0]), [np.array([k for _, k in sorted((r["slot"], r["shard"]) for r in own)]) for own in rows])


def _stored(spark: SparkSession, folder: str) -> int:
    """The number of versions in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files, n = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    while files.exists(path(f"{folder}/version={n}/_SUCCESS")):
        n += 1
    return n


def shard(documents: DataFrame, shards: int = 16, slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows with doc_id, size, text_crc32, virtual_slot, shard and slot, the row's place in its shard, and the map.

    ``folder``: where the map is stored; what is there is edited, and the rows are dealt by what is read back from it. By
    default a new place in the shared folder. Texts are read once and never shuffled; what follows works on a few numbers
    a row. The driver sees one row of sums for each virtual slot.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_folder(spark)}/trailgrid/slot-map-{uuid.uuid4().hex}"
    text = F.col("text").cast("string")
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("hash", F.xxhash64("doc_id", "size", "text_crc32"))
    narrow = written(narrow, "sizes")
    kept = numbered(narrow, repeated(narrow)).withColumn("virtual_slot", F.pmod(F.xxhash64("hash", "number"), F.lit(slots)).cast("long"))
    kept = written(kept.drop("hash"), "slots")
    weight, rows = np.zeros(slots), np.zeros(slots, np.int64)
    for r in kept.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        weight[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["n"]
    owners = SlotMap.load(spark, folder) or SlotMap(shards, slots)
    if owners.slots != slots or owners.shards > shards:
        raise ValueError(f"the stored map has {owners.slots} slots and {owners.shards} shards")
    while owners.shards < shards:
        owners.grow(weight)
    owners.rebalance(weight)
    owners.save(spark, folder)
    owners = SlotMap.load(spark, folder)
    owner = owners.at()
    first = np.zeros(slots, np.int64)
    for k in range(shards):
        own = np.flatnonzero(owner == k)
        first[own] = np.cumsum(rows[own]) - rows[own]
    plan = spark.createDataFrame([(v, int(owner[v]), int(first[v])) for v in range(slots)], "virtual_slot long, shard int, first long")
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "number")
    placed = kept.withColumn("place", F.row_number().over(in_slot) - 1).join(F.broadcast(plan), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"), F.col("virtual_slot").cast("int").alias("virtual_slot")
    ), owners
