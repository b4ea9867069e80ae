"""The index: rows with their segments, inverted tables over them, and how they are stored."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgrid.functions.paths import canonical, extension, folded, place, suffix, terminal, trigrams
from trailgrid.storage import delete, exists, replace, written

VERSION = 2


def build(rows: DataFrame, drive: Column) -> DataFrame:
    """drive, path in canonical form, has_deleted_entries, segs in lower case, term, ext, and place for scopes."""
    segs = folded(F.col("path"))
    base = rows.select(drive.alias("drive"), canonical(F.col("path")).alias("path"), "has_deleted_entries", segs.alias("segs"), place(F.col("path")).alias("place"))
    return base.withColumn("term", terminal(F.col("segs"))).withColumn("ext", suffix(F.col("term")))


def numbered(index: DataFrame) -> DataFrame:
    """With row_index, the place of a row in its drive by path. Rows are numbered within ranges, and the ranges' numbers
    of rows are strung together, so a drive is as many tasks as it has ranges."""
    order = ("drive", "path", "has_deleted_entries")
    ranged = written(index.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("drive", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("drive").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).select(F.col("drive").alias("_drive"), F.col("part").alias("_part"), "before")
    own = F.row_number().over(Window.partitionBy("drive", "part").orderBy("path", "has_deleted_entries")).cast("long") - 1
    placed = ranged.withColumn("own", own).join(starts, F.col("drive").eqNullSafe(F.col("_drive")) & (F.col("part") == F.col("_part")))
    return placed.withColumn("row_index", F.col("own") + F.col("before")).drop("part", "own", "before", "_drive", "_part")


@dataclass
class Stored:
    """An index as it is stored: rows with row_index; postings (drive, segment, row_index); trigrams (trigram, segment)."""

    rows: DataFrame
    postings: DataFrame
    trigrams: DataFrame


def tables(rows: DataFrame) -> Stored:
    """The inverted tables of numbered rows."""
    postings = rows.select("drive", F.explode(F.array_distinct("segs")).alias("segment"), "row_index")
    segments = postings.select("segment").distinct()
    return Stored(rows, postings, segments.select(F.explode(trigrams(F.col("segment"))).alias("trigram"), "segment"))


def write(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows by drive, in ranges of ext and term; postings in ranges of segments, trigrams in ranges of trigrams, so that
    scans skip what they do not ask for; a manifest beside them. All of it is written beside ``path`` and takes its place
    by one renaming. ``mode``: overwrite, ignore or errorifexists."""
    spark = index.sparkSession
    if mode != "overwrite" and exists(spark, path):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        rows = written(numbered(index), "numbered")
        stored = tables(rows)
        rows.repartitionByRange("drive", "ext", "term").sortWithinPartitions("drive", "ext", "term").write.partitionBy("drive").parquet(f"{new}/rows")
        stored.postings.repartitionByRange("segment").sortWithinPartitions("segment").write.parquet(f"{new}/postings")
        stored.trigrams.repartitionByRange("trigram").sortWithinPartitions("trigram", "segment").write.parquet(f"{new}/trigrams")
        n = rows.count()
        spark.createDataFrame([(json.dumps({"version": VERSION, "rows": n}),)], "value string").coalesce(1).write.text(f"{new}/manifest")
        replace(spark, new, path.rstrip("/"))
    finally:
        delete(spark, new)


def stored(spark: SparkSession, path: str, validate: bool = False) -> Stored:
    """An index of this version with its tables. ``validate``: raises if something in it does not fit together."""
    found = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if found.get("version") != VERSION:
        raise ValueError(f"{path}: index version {found.get('version')} is not supported; build it again")
    out = Stored(*(spark.read.parquet(f"{path}/{name}") for name in ("rows", "postings", "trigrams")))
    if validate and not (bad := violations(out)).isEmpty():
        raise ValueError(f"{path}: the index is damaged, as {bad.first().asDict()}")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an index of this version."""
    return stored(spark, path).rows


def segment_postings(index: DataFrame) -> DataFrame:
    """segment, row_index."""
    return index.select("row_index", F.explode(F.array_distinct("segs")).alias("segment"))


def suffix_postings(index: DataFrame) -> DataFrame:
    """ext, row_index."""
    return index.where("ext is not null").select("ext", "row_index")


def trigrams_of(needle: str) -> list[str]:
    """The distinct runs of three UTF-8 bytes of a needle in lower case, as hex; none for shorter ones."""
    raw = needle.lower().encode()
    return sorted({raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)})


def trigram_candidates(index: Stored, needle: str) -> DataFrame:
    """Segments that have every trigram of a needle, checked against it: segment."""
    wanted = trigrams_of(needle)
    if not wanted:
        return index.postings.where(F.contains("segment", F.lit(needle.lower()))).select("segment").distinct()
    hits = index.trigrams.where(F.col("trigram").isin(wanted)).groupBy("segment").agg(F.count("*").alias("n"))
    return hits.where((F.col("n") == len(wanted)) & F.contains("segment", F.lit(needle.lower()))).select("segment")


def rows_of_segments(index: Stored, found: DataFrame) -> DataFrame:
    """Rows that have any of the segments, each once: drive, row_index."""
    return index.postings.join(found, "segment", "left_semi").select("drive", "row_index").distinct()


def extension_counts(rows: DataFrame) -> DataFrame:
    """Rows for each extension in lower case: extension, n."""
    name = F.coalesce(F.lower(extension(terminal(F.filter(F.split("path", r"[/\\]"), lambda s: s != "")))), F.lit("(no extension)"))
    return rows.groupBy(name.alias("extension")).agg(F.count("*").alias("n"))


def needle_counts(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows for each of several queries, in one pass."""
    counts = rows.agg(*(F.count_if(p).alias(k) for k, p in predicates.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in predicates)), F.array(*(F.col(k) for k in predicates)))).alias("needle", "n"))


def violations(index: Stored) -> DataFrame:
    """What does not fit together in an index; nothing, if it is intact: kind, drive, row_index, segment.

    ``columns``: a row whose stored columns do not follow from its path; ``no posting``: a segment of a row that no
    posting leads from; ``no row``: a posting that leads nowhere; ``no trigram`` and ``no segment``: a trigram that is
    missing, or that stands for a segment that no row has."""
    rows, postings = index.rows, index.postings.select("drive", "segment", "row_index")
    segs = folded(F.col("path"))
    odd = ~(F.col("segs") == segs) | ~F.col("term").eqNullSafe(terminal(segs)) | ~F.col("ext").eqNullSafe(suffix(terminal(segs)))
    none = F.lit(None).cast("string")

    def of(kind: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "drive", "row_index", "segment")

    should = rows.select("drive", F.explode(F.array_distinct(segs)).alias("segment"), "row_index")
    grams = should.select("segment").distinct().select(F.explode(trigrams(F.col("segment"))).alias("trigram"), "segment")

    def lacking(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """By sorted sides: files of an index are so much smaller than their rows that Spark would send all of a side to the driver."""
        return left.join(right.hint("merge"), on, "left_anti")

    lone = [("no trigram", lacking(grams, index.trigrams, ["trigram", "segment"])), ("no segment", lacking(index.trigrams, grams, ["trigram", "segment"]))]
    out = of("columns", rows.where(odd).withColumn("segment", none))
    out = out.unionByName(of("no posting", lacking(should, postings, ["drive", "segment", "row_index"])))
    out = out.unionByName(of("no row", lacking(postings, should, ["drive", "segment", "row_index"])))
    for kind, df in lone:
        out = out.unionByName(of(kind, df.select("segment").distinct().withColumns({"drive": none, "row_index": F.lit(None).cast("long")})))
    return out
