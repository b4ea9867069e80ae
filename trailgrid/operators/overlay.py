"""Base and overlay: merging, differences, upserts and refreshes of a subtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.functions.paths import drive

_ROW = ("path", "has_deleted_entries")


def merge(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """One row a path, the overlay's where both have it. A union and an aggregation with partial sums: no join. Where
    the base has a drive, so have the rows; it follows from the path where the overlay has none."""
    both = base.select(*_ROW, F.lit(0).alias("rank")).unionByName(overlay.select(*_ROW, F.lit(1).alias("rank")))
    merged = both.groupBy("path").agg(F.max(F.struct("rank", F.col("has_deleted_entries").alias("d"))).alias("row")).select("path", F.col("row.d").alias("has_deleted_entries"))
    return merged.withColumn("drive", drive(F.col("path"))) if "drive" in base.columns else merged


def merge_prefiltered(base: DataFrame, overlay: DataFrame, keep: Column) -> DataFrame:
    """The merge with each side filtered first and base rows that appear more than once kept beyond the first of
    each path, as an engine that filters its sides before merging returns them."""
    left, right = base.select(*_ROW).where(keep), overlay.select(*_ROW).where(keep)
    counted = left.groupBy(*_ROW).count().withColumnRenamed("count", "n")
    over = right.groupBy("path").agg(F.count("*").alias("skip"))
    first = F.max_by("skip", F.lit(1))
    rest = counted.join(over, "path", "left").groupBy("path").agg(F.min("has_deleted_entries").alias("has_deleted_entries"), (F.sum("n") - F.coalesce(first, F.lit(0))).alias("n"))
    return right.unionByName(rest.where("n > 0").select("path", "has_deleted_entries", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_")).drop("_"))


def diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """The overlay that turns base into current: changed and new rows, and tombstones for paths that are gone."""
    b = base.select("path", F.col("has_deleted_entries").alias("was")).dropDuplicates(["path"])
    c = current.select("path", F.col("has_deleted_entries").alias("now")).dropDuplicates(["path"])
    both = b.join(c, "path", "full_outer")
    changed = F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("was"))
    gone = F.col("now").isNull() & ~F.col("was")
    return both.where(changed | gone).select("path", F.coalesce("now", F.lit(True)).alias("has_deleted_entries"))


def upsert(overlay: DataFrame, rows: DataFrame) -> DataFrame:
    """All of ``rows``, and the overlay's rows whose path none of them has, as often as they are there. Where the overlay
    has a drive, so have the rows, by their path."""
    left = overlay.select(*_ROW).join(rows.select("path").hint("merge"), "path", "left_anti")
    out = left.unionByName(rows.select(*_ROW))
    return out.withColumn("drive", drive(F.col("path"))) if "drive" in overlay.columns else out


def surely_absent(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that SQL's NOT IN may keep: with an unknown path among ``others`` none, and those of unknown path only if there
    are no others. Paths themselves are left to be compared."""
    seen = others.agg(F.count("*").alias("_n"), F.count_if(F.col("path").isNull()).alias("_unknown"))
    return rows.crossJoin(F.broadcast(seen)).where("_n = 0 or _unknown = 0 and path is not null").drop("_n", "_unknown")


def refresh(base: DataFrame, overlay: DataFrame, current: DataFrame, in_scope: Column) -> DataFrame:
    """The overlay after a subtree was read anew: outside of it nothing changes, inside it is the difference."""
    return overlay.where(~in_scope).select(*_ROW).unionByName(diff(base.where(in_scope), current.where(in_scope)))
