"""Change journals: the state of links after a run of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrid.functions.paths import DELETED_REASONS, affects_topology, is_directory

_LINK = ("frn", "parent_frn", "name")


def link_state(events: DataFrame) -> DataFrame:
    """frn, parent_frn, name, is_deleted, usn: a link is deleted if its last topology event says so; within one event
    a deletion is applied last, so a closed form by the largest usn is enough and no per-key state is kept."""
    topology = events.where(affects_topology(F.col("reason")))
    dead = F.col("reason").bitwiseAND(F.lit(DELETED_REASONS)) != 0
    return topology.groupBy(*_LINK).agg(F.max_by(dead, "usn").alias("is_deleted"), F.max("usn").alias("usn"))


def node_state(events: DataFrame) -> DataFrame:
    """frn, is_directory by the last topology event of an entry."""
    topology = events.where(affects_topology(F.col("reason")))
    return topology.groupBy("frn").agg(F.max_by(is_directory(F.col("file_attributes")), "usn").alias("is_directory"))


def apply(links: DataFrame, events: DataFrame) -> DataFrame:
    """Links after the events; unknown entries come in, known links keep their state where no event speaks of them."""
    new = link_state(events).select(*_LINK, F.col("is_deleted").alias("new"))
    both = links.select(*_LINK, F.col("is_deleted").alias("old")).join(new, list(_LINK), "full_outer")
    return both.select(*_LINK, F.coalesce("new", "old").alias("is_deleted"))


def check_continuity(checkpoint: dict, cursor: dict) -> None:
    """Raises if the journal no longer holds what follows the snapshot."""
    if checkpoint["journal_id"] != cursor["journal_id"]:
        raise ValueError("the journal was made anew since the snapshot")
    if checkpoint["snapshot_usn"] < cursor["lowest_valid_usn"]:
        raise ValueError("events since the snapshot are gone from the journal")
    if checkpoint["next_usn"] > cursor["next_usn"]:
        raise ValueError("the checkpoint is ahead of the journal")
