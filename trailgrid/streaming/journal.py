"""Journals as Structured Streaming: micro-batches of events folded into stored links."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailgrid.functions.paths import affects_topology, reason_names
from trailgrid.operators.journal import apply, check_continuity, link_state
from trailgrid.operators.live import observed as live_paths
from trailgrid.operators.live import within
from trailgrid.plans.scopes import Scope
from trailgrid.sources import usn
from trailgrid.storage import delete, exists, fresh, replace

EVENT = usn.EVENT
#: Least and usual milliseconds between two looks at the journal.
FLOOR_MS, POLL_MS = 50, 500
#: Folders of a new table of links; a micro-batch writes those anew that its entries are in.
BUCKETS = 64


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Events of Parquet batches that arrive in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def read_buffers(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Events of journal buffers that arrive in a folder, as Parquet rows with a binary column ``buffer``."""
    return usn.events(spark.readStream.schema("buffer binary").option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def observed(events: DataFrame) -> DataFrame:
    """Topology events with the names of their reasons."""
    return events.where(affects_topology(F.col("reason"))).withColumn("reason_names", reason_names(F.col("reason")))


def live_links(events: DataFrame) -> DataFrame:
    """The state of each link as a streaming aggregation; state is one row a link."""
    return link_state(events)


def watch(
    events: DataFrame, base: DataFrame, root_prefix: str, checkpoint: str, see: Callable[[DataFrame], None],
    scopes: list[Scope] | None = None, table: str | None = None, poll: int | None = None,
) -> StreamingQuery:
    """Gives each micro-batch's topology events to ``see`` with the paths of their entries just after them, those in
    ``scopes`` alone. Publishes nothing: the links that events have brought stand in a :class:`LinkTable` of the watch."""
    spark = base.sparkSession
    store = LinkTable(spark, table or fresh(spark, "watch"))
    if store.manifest() is None:
        store.publish(base.select("frn", "parent_frn", "name", F.lit(False).alias("is_deleted")), -1)

    def step(batch: DataFrame, number: int) -> None:
        topology = batch.where(affects_topology(F.col("reason")))
        see(within(live_paths(topology, store.links(), root_prefix), scopes or []))
        changed = store.changed(topology)
        if changed:
            store.publish(apply(store.links(changed), topology), number)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if poll is None else writer.trigger(processingTime=f"{poll_ms(poll)} milliseconds")).start()


def poll_ms(asked: int | None) -> int:
    """Milliseconds between two looks."""
    return max(FLOOR_MS, POLL_MS if asked is None else asked)


class LinkTable:
    """Links by buckets of their entry, each bucket in the version that last changed it. A manifest names the versions
    and holds the checkpoint; it takes the place of the one before by a renaming, so links and checkpoint are published
    together. Buckets that a manifest no longer names are deleted after the next one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.n = (self.manifest() or {"n": buckets})["n"]

    def bucket(self) -> F.Column:
        """The bucket of an entry."""
        return F.pmod(F.xxhash64("frn"), F.lit(self.n)).cast("int")

    def changed(self, events: DataFrame) -> set[int]:
        """The buckets that events change."""
        return {r[0] for r in events.select(self.bucket()).distinct().collect()}

    def manifest(self) -> dict | None:
        """What was published last; None if nothing was."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifest").first()[0])

    def _folders(self, buckets: dict[str, int]) -> list[str]:
        return [f"{self.path}/v{v}/bucket={b}" for b, v in buckets.items()]

    def links(self, only: set[int] | None = None) -> DataFrame:
        """frn, parent_frn, name, is_deleted of all buckets, or of some."""
        buckets = {b: v for b, v in (self.manifest() or {"buckets": {}})["buckets"].items() if only is None or int(b) in only}
        schema = "frn long, parent_frn long, name string, is_deleted boolean"
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._folders(buckets))

    def publish(self, links: DataFrame, batch: int, checkpoint: dict | None = None) -> None:
        """Links of some buckets, complete in each, and the checkpoint that goes with them. The same batch again writes
        the same version again."""
        before = self.manifest() or {"batch": None, "buckets": {}, "old": []}
        version = batch
        links.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        buckets = before["buckets"] | {str(b): version for b in self.changed(links)}
        old = [f for f in self._folders(before["buckets"]) if f not in self._folders(buckets)]
        now = {"batch": batch, "n": self.n, "buckets": buckets, "old": old, "checkpoint": checkpoint}
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest.new")
        replace(self.spark, f"{self.path}/manifest.new", f"{self.path}/manifest")
        for folder in before["old"]:
            if folder not in self._folders(buckets):
                delete(self.spark, folder)


def publish(
    events: DataFrame, base: DataFrame, table: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None,
    state: dict | None = None, cursor: Callable[[], dict] | None = None, poll: int | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Folds each micro-batch into the links of a :class:`LinkTable`, starting from ``base``: only buckets with changed
    entries are written anew. A batch that is run again gives the same links again.

    ``state`` (journal_id, snapshot_usn, next_usn) and ``cursor`` (the journal's own, asked before each batch): a gap in
    the journal ends the stream with an error before anything is published. ``poll``: milliseconds between two looks;
    without it the stream ends when it has seen what is there."""
    spark = base.sparkSession
    store = LinkTable(spark, table, buckets)
    if store.manifest() is None:
        store.publish(base.select("frn", "parent_frn", "name", "is_deleted"), -1, state)

    def fold(batch: DataFrame, number: int) -> None:
        known = store.manifest()["checkpoint"] or state
        if cursor is not None and known:
            check_continuity(known, cursor())
        seen = batch.agg(F.max("usn")).first()[0]
        topology = batch.where(affects_topology(F.col("reason")))
        changed = store.changed(topology)
        new = known | {"next_usn": max(known["next_usn"], seen)} if known and seen is not None else known
        if changed or new != known:
            store.publish(apply(store.links(changed), topology), number, new)
        if after:
            after(store.links(), number)

    writer = events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if poll is None else writer.trigger(processingTime=f"{poll_ms(poll)} milliseconds")).start()
