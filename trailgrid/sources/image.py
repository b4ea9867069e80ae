"""File tables on a device: pieces of a disk image, put together by run lists without opening the device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one read of the device.
CHUNK = 1 << 20


def read_plan(extents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What has to be read: file, offset, length, logical_offset of the physical parts of ``extents`` (file,
    logical_offset, length, physical_offset), each within one chunk of the device."""
    real = extents.where("physical_offset is not null and length > 0")
    first, last = F.floor(F.col("physical_offset") / chunk), F.floor((F.col("physical_offset") + F.col("length") - 1) / chunk)
    cut = real.withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("physical_offset"), F.col("chunk") * chunk)
    end = F.least(F.col("physical_offset") + F.col("length"), (F.col("chunk") + 1) * chunk)
    return cut.select("file", start.alias("offset"), (end - start).alias("length"), (F.col("logical_offset") + start - F.col("physical_offset")).alias("logical_offset"), "chunk")


def bytes_read(plan: DataFrame) -> DataFrame:
    """file, n_reads and n_bytes of a plan."""
    return plan.groupBy("file").agg(F.count("*").alias("n_reads"), F.sum("length").alias("n_bytes"))


def reassembled(extents: DataFrame, device: DataFrame, chunk: int = CHUNK, holes: bool = False) -> DataFrame:
    """file, logical_offset, data of the physical parts, which come from ``device`` (chunk, data: whole chunks by their
    number). What the device does not hold is an error. ``holes``: parts without a place are there too, as zeros."""
    plan = read_plan(extents, chunk)
    met = plan.join(device.select("chunk", "data"), "chunk", "left")
    within = (F.col("offset") % chunk).cast("int")
    data = F.substring("data", within + 1, F.col("length").cast("int"))
    lost = F.concat(F.lit("the device holds no data at "), F.col("offset").cast("string"))
    checked = F.when(F.coalesce(F.octet_length(data), F.lit(-1)) < F.col("length"), F.raise_error(lost).cast("binary")).otherwise(data)
    out = met.select("file", "logical_offset", checked.alias("data"))
    if not holes:
        return out
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("n").cast("int")))
    cut = extents.where("physical_offset is null and length > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))))
    cut = cut.withColumn("n", F.least(F.lit(chunk).cast("long"), F.col("length") - F.col("at")))
    return out.unionByName(cut.select("file", (F.col("logical_offset") + F.col("at")).alias("logical_offset"), zeros.alias("data")))


def joined(pieces: Column) -> Column:
    """The bytes of an array of (logical_offset, data) in order."""
    return F.aggregate(F.array_sort(pieces), F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["data"]))


def fixed_records(pieces: DataFrame, size: int) -> DataFrame:
    """file, entry_id, record of ``size`` bytes each, from pieces of any lengths (file, logical_offset, data). A record
    has at most as many slices as pieces meet in it; none is held with others."""
    end = F.col("logical_offset") + F.octet_length("data")
    cut = pieces.withColumn("entry_id", F.explode(F.sequence(F.floor(F.col("logical_offset") / size), F.floor((end - 1) / size))))
    start = F.greatest(F.col("logical_offset"), F.col("entry_id") * size)
    stop = F.least(end, (F.col("entry_id") + 1) * size)
    part = F.substring("data", (start - F.col("logical_offset")).cast("int") + 1, (stop - start).cast("int"))
    sliced = cut.select("file", "entry_id", F.struct(start.alias("logical_offset"), part.alias("data")).alias("x"))
    whole = sliced.groupBy("file", "entry_id").agg(joined(F.collect_list("x")).alias("record"))
    return whole.where(F.octet_length("record") == size)


def snapshot(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """A file as a table of blocks of ``size`` bytes in order: file, block, data; places that nothing fills are zeros
    within a block. The last block ends where the file does."""
    end = F.col("logical_offset") + F.octet_length("data")
    cut = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("logical_offset") / size), F.floor((end - 1) / size))))
    start, stop = F.greatest(F.col("logical_offset"), F.col("block") * size), F.least(end, (F.col("block") + 1) * size)
    part = F.substring("data", (start - F.col("logical_offset")).cast("int") + 1, (stop - start).cast("int"))
    sliced = cut.select("file", "block", F.struct((start - F.col("block") * size).alias("logical_offset"), part.alias("data")).alias("x"))

    def put(out: Column, x: Column) -> Column:
        gap = F.greatest(x["logical_offset"] - F.octet_length(out), F.lit(0)).cast("int")
        return F.concat(out, F.unhex(F.repeat(F.lit("00"), gap)), x["data"])

    return sliced.groupBy("file", "block").agg(F.aggregate(F.array_sort(F.collect_list("x")), F.lit(b"").cast("binary"), put).alias("data"))
