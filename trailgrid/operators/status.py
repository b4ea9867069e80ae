"""Readiness of drives, and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def readiness(drives: DataFrame) -> DataFrame:
    """drive, ready_at: the older of the two times if both are there, else null."""
    both = F.col("snapshot_at").isNotNull() & F.col("index_at").isNotNull()
    return drives.select("drive", F.when(both, F.least("snapshot_at", "index_at")).alias("ready_at"))


def summary(ready: DataFrame) -> DataFrame:
    """n_drives, n_ready, oldest, newest."""
    return ready.agg(F.count("*").alias("n_drives"), F.count("ready_at").alias("n_ready"), F.min("ready_at").alias("oldest"), F.max("ready_at").alias("newest"))


def by_drive(status: DataFrame) -> DataFrame:
    """Drives in the order of their letters."""
    return status.orderBy(F.upper("drive"))


def age_seconds(at: Column, now: Column) -> Column:
    """Whole seconds, never below 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000))


def stale(ready: DataFrame, now: Column, most: int) -> DataFrame:
    """Drives that are not ready or were ready too long ago."""
    return ready.withColumn("age", age_seconds(F.col("ready_at"), now)).where(F.col("ready_at").isNull() | (F.col("age") > most))


def ring(log: DataFrame, by: str, most: int = 2048) -> DataFrame:
    """The last events of each stream."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id")))
    return log.withColumn("rank", rank).where(F.col("rank") <= most)


def replayed(log: DataFrame, by: str, seen: DataFrame, most: int = 2048) -> tuple[DataFrame, DataFrame]:
    """What a reader of each stream gets who has read up to ``seen`` (the stream, last event_id), and how many events the
    ring has lost for it meanwhile: (events, the stream and n_lost)."""
    kept = ring(log, by, most).drop("rank")
    new = kept.join(seen.select(by, F.col("event_id").alias("_last")), by, "left").where(F.col("_last").isNull() | (F.col("event_id") > F.col("_last"))).drop("_last")
    first = kept.groupBy(by).agg(F.min("event_id").alias("_first"))
    lost = log.join(seen.select(by, F.col("event_id").alias("_last")), by).join(first, by).where((F.col("event_id") > F.col("_last")) & (F.col("event_id") < F.col("_first")))
    return new, lost.groupBy(by).agg(F.count("*").alias("n_lost"))


def captured(target: Column, level: Column, prefix: str, noisy: list[str] = ()) -> Column:
    """Own targets, and warnings or worse of others, without noisy ones."""
    keep = F.startswith(target, F.lit(prefix)) | level.isin("WARN", "ERROR")
    for name in noisy:
        keep = keep & ~F.startswith(target, F.lit(name))
    return keep


def correlated(log: DataFrame, correlation_id: str) -> DataFrame:
    """Events of one request."""
    return log.where(F.col("correlation_id") == correlation_id)
