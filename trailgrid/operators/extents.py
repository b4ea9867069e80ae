"""Byte extents: run lists, merging, aligning, cutting, and finding what holds an offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTOR = 512


def runs_to_extents(runs: DataFrame, cluster: int, block: int = 1 << 16) -> DataFrame:
    """file, logical_offset, length, physical_offset from (file, run_no, clusters, delta): running sums of lengths
    and of signed cluster deltas; a null delta is a hole. Runs without length are skipped. Sums run within ``block`` runs,
    and the blocks' sums are strung together, so a file of very many runs is many tasks."""
    cut = runs.withColumn("block", F.floor(F.col("run_no") / block)).withColumn("move", F.coalesce("delta", F.lit(0)))
    sums = cut.groupBy("file", "block").agg(F.sum("clusters").alias("c"), F.sum("move").alias("m"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "block", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("c", "m")))
    order = Window.partitionBy("file", "block").orderBy("run_no")
    before = F.col("c") + F.coalesce(F.sum("clusters").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("m") + F.sum("move").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = cut.join(starts, ["file", "block"]).select("file", (before * cluster).alias("logical_offset"), (F.col("clusters") * cluster).alias("length"), F.when(F.col("delta").isNotNull(), at * cluster).alias("physical_offset"))
    return out.where("length > 0")


def physical(extents: DataFrame) -> DataFrame:
    """Without holes."""
    return extents.where("physical_offset is not null")


def distinct(extents: DataFrame, strict: bool = False) -> DataFrame:
    """Each (offset, length) once; empty ones are dropped, or an error if ``strict``."""
    kept = extents.where(F.when(F.col("length") <= 0, F.raise_error(F.lit("empty extent"))).otherwise(F.lit(True)).cast("boolean")) if strict else extents.where("length > 0")
    return kept.dropDuplicates([c for c in ("file", "offset", "length") if c in extents.columns])


def align(extents: DataFrame, sector: int = SECTOR) -> DataFrame:
    """Outward to whole sectors."""
    first = F.col("offset") - F.col("offset") % sector
    last = F.ceil((F.col("offset") + F.col("length")) / sector) * sector
    return extents.withColumns({"offset": first, "length": (last - first).cast("long")})


def merge(extents: DataFrame, by: str = "file", width: int = 1 << 32) -> DataFrame:
    """Joins extents where one ends exactly where the next begins: islands by a running sum of gaps. Islands are found in
    stretches of ``width`` bytes; only the first and the last one of a stretch can go on in another, so only these meet by
    file."""

    def islands(rows: DataFrame, parts: list[str], order: list[str]) -> DataFrame:
        ahead = Window.partitionBy(*parts).orderBy(*order)
        gap = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(ahead) != F.col("offset"), F.lit(True)).cast("int")
        marked = rows.withColumn("gap", gap).withColumn("island", F.sum("gap").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*parts, "island").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"))

    near = islands(extents.withColumn("stretch", F.floor(F.col("offset") / width)), [by, "stretch"], ["offset", "length"])
    own = Window.partitionBy(by, "stretch")
    near = near.withColumn("edge", (F.col("island") == F.min("island").over(own)) | (F.col("island") == F.max("island").over(own)))
    whole = near.where("not edge").select(by, "offset", "length")
    edges = near.where("edge").select(by, "stretch", F.col("island").alias("place"), "offset", "length")
    return whole.unionByName(islands(edges, [by], ["stretch", "place"]).select(by, "offset", "length"))


def cut(extents: DataFrame, most: int) -> DataFrame:
    """Pieces of at most ``most`` bytes."""
    pieces = extents.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(most).cast("long"))))
    return pieces.withColumns({"offset": F.col("offset") + F.col("at"), "length": F.least(F.lit(most).cast("long"), F.col("length") - F.col("at"))}).drop("at")


def total(extents: DataFrame) -> DataFrame:
    """The end of each file's last extent: file, logical_size."""
    return extents.groupBy("file").agg(F.max_by(F.col("logical_offset") + F.col("length"), F.col("logical_offset")).alias("logical_size"))


def totals(paths: DataFrame) -> DataFrame:
    """n_paths, n_entries of resolved paths (frn, path)."""
    return paths.agg(F.count("*").alias("n_paths"), F.count_distinct("frn").alias("n_entries"))


def containing(probes: DataFrame, extents: DataFrame, bucket: int) -> DataFrame:
    """The extent that holds each probe's position: an as-of search as an equi-join on buckets of ``bucket`` bytes.
    ``probes``: file, probe; ``extents``: file, offset, length, not overlapping."""
    spread = extents.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("offset") / bucket), F.floor((F.col("offset") + F.col("length") - 1) / bucket))))
    keyed = probes.withColumn("bucket", F.floor(F.col("probe") / bucket))
    inside = (F.col("probe") >= F.col("offset")) & (F.col("probe") < F.col("offset") + F.col("length"))
    return keyed.join(spread, ["file", "bucket"]).where(inside).drop("bucket")
