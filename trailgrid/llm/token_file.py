"""Token files with directly addressable codes.

An id is split into 8-bit chunks. The first chunks of all ids stand in level 1, the second chunks of those ids that
have one in level 2, and so on; each level has a bitmap that says which of its ids continue, and a directory with the
number of ones before each 512 bits. So any token is read by one byte, one bit and one rank a level, without decoding
its block. A file is a table of blocks in the shared folder, one shard of ascending doc_id for each range partition.

Defined results: a null or empty text is the end id alone; rows are ordered by doc_id, null first, then by a hash of
the text, and repeated rows stand side by side; a very long text makes a block of its own; an empty table gives an
empty file; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bases, slices, small_batches, written
from .tokens import encoder

RANK_BITS = 512
BLOCK_TOKENS = 1 << 20


def encode_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, bitmap, rank directory) of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        steps = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(steps, dtype=np.uint32)])
        out.append(((rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        if not more.any():
            return out
        rest = rest[more] >> 8


def decode_levels(levels: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """All ids of a block."""
    value = None
    for chunks, bitmap, _ in reversed(levels):
        own = np.frombuffer(chunks, np.uint8).astype("<u4")
        if value is not None:
            own[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(own), bitorder="little").astype(bool)] |= value << 8
        value = own
    return value


def token_at(levels: list[tuple[bytes, bytes, bytes]], i: int) -> int:
    """One id, by one byte, one bit and one rank in each level that it reaches."""
    value = shift = 0
    for chunks, bitmap, ranks in levels:
        value |= chunks[i] << shift
        if not bitmap[i >> 3] >> (i & 7) & 1:
            return value
        first = i // RANK_BITS * RANK_BITS
        before = int.from_bytes(bitmap[first >> 3 : (i >> 3) + 1], "little") & ((1 << (i - first)) - 1)
        i = int.from_bytes(ranks[4 * (i // RANK_BITS) : 4 * (i // RANK_BITS) + 4], "little") + before.bit_count()
        shift += 8
    raise ValueError("a continuation bit in the last level")


_FILE = "shard long, block long, start long, n_tokens long, doc_ids array<long>, lengths array<long>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> DataFrame:
    """Encodes all documents and writes the file; returns its blocks, read back."""
    spark = documents.sparkSession
    small_batches(spark)
    end = np.uint32(end_id).astype("<u4").tobytes()
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        block = start = held = 0
        doc_ids: list = []
        parts: list[bytes] = []

        def out() -> pa.RecordBatch:
            nonlocal block, start, held
            levels = list(zip(*encode_levels(np.frombuffer(b"".join(parts), "<u4")), strict=True))
            row = [[shard], [block], [start], [held], [list(doc_ids)], [[len(x) // 4 for x in parts]], *([list(x)] for x in levels)]
            block, start, held = block + 1, start + held, 0
            doc_ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= block_tokens:
                    yield out()
        if doc_ids:
            yield out()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(partition, _FILE), "tokens")


def read_documents(blocks: DataFrame) -> DataFrame:
    """What the file holds of each document: doc_id, start, n_tokens, ids_crc32."""
    before = bases((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for row in batch.to_pylist():
                ids = decode_levels(list(zip(row["chunks"], row["bitmaps"], row["ranks"], strict=True)))
                if not len(ids) == row["n_tokens"] == sum(row["lengths"]):
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: {len(ids)} ids, {row['n_tokens']} were written")
                raw, ends = ids.tobytes(), np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [row["doc_ids"], starts + row["start"] + before[row["shard"]], row["lengths"], crcs]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return blocks.select([x.split()[0] for x in _FILE.split(", ")]).mapInArrow(decode, ", ".join(f"{x} long" for x in names))
