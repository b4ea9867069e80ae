"""Live state of drives: journals against checkpoints, paths as of each event, and answers with a fallback."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrid.functions.paths import affects_topology, is_directory, joined, reason_names
from trailgrid.operators.resolve import ROOT
from trailgrid.plans.scopes import Scope, in_scope
from trailgrid.storage import written

_LINK = ("frn", "parent_frn", "name")


def journals(cursors: DataFrame, active: bool | None = None) -> DataFrame:
    """The journals' state by drive, all or those that are (not) active: those with an id."""
    out = cursors.withColumn("active", F.col("journal_id").isNotNull())
    return (out if active is None else out.where(F.col("active") == active)).orderBy("drive")


def continuity(checkpoints: DataFrame, cursors: DataFrame) -> DataFrame:
    """drive, state: ``ok``, ``no journal``, ``new journal``, ``gap`` (events since the snapshot are gone) or ``ahead``.

    ``checkpoints``: drive, journal_id, snapshot_usn, next_usn; ``cursors``: drive, journal_id, lowest_valid_usn,
    next_usn."""
    c = cursors.select("drive", F.col("journal_id").alias("_id"), "lowest_valid_usn", F.col("next_usn").alias("head"))
    state = (
        F.when(F.col("_id").isNull(), "no journal").when(F.col("_id") != F.col("journal_id"), "new journal")
        .when(F.col("snapshot_usn") < F.col("lowest_valid_usn"), "gap").when(F.col("next_usn") > F.col("head"), "ahead").otherwise("ok")
    )
    return checkpoints.join(c, "drive", "left").select("drive", state.alias("state"))


def dirty(states: DataFrame) -> DataFrame:
    """Drives whose published rows are older than what has been read: drive, behind (events' positions)."""
    apart = states.where(~F.col("current_next_usn").eqNullSafe(F.col("published_last_usn")))
    return apart.select("drive", (F.col("current_next_usn") - F.coalesce("published_last_usn", F.lit(0))).alias("behind"))


def observed(events: DataFrame, base: DataFrame, root_prefix: str, root: int = ROOT) -> DataFrame:
    """Each topology event with the paths of its entry as they are just after it: frn, parent_frn, usn, name,
    is_directory, reason_names, projected_paths.

    A link is there from its first event on, or from the start if it is in ``base`` (frn, parent_frn, name); deleted ones
    still lead to paths. So an event's paths follow links upwards that were there by its usn, a join for each level. A
    chain that comes back to an entry that it has passed is not followed."""
    topology = events.where(affects_topology(F.col("reason")))
    known = base.select(*_LINK, F.lit(-(2**63)).alias("since"))
    links = topology.select(*_LINK, F.col("usn").alias("since")).unionByName(known).groupBy(*_LINK).agg(F.min("since").alias("since"))
    links = written(links.select(F.col("frn").alias("at"), F.col("parent_frn").alias("up"), F.col("name").alias("above"), "since"), "links")
    topology = written(topology, "topology")
    walk = topology.select("usn", F.col("frn").alias("at"), F.lit(None).cast("string").alias("path"), F.array("frn").alias("chain"))
    ends = [walk.where(F.col("at") == root).select("usn", F.lit(root_prefix).alias("path"))]
    while True:
        met = walk.join(links, "at").where((F.col("since") <= F.col("usn")) & ~F.array_contains("chain", F.col("up")))
        path = F.when(F.col("path").isNull(), F.col("above")).otherwise(F.concat("above", F.lit("\\"), "path"))
        walk = written(met.select("usn", F.col("up").alias("at"), path.alias("path"), F.array_append("chain", F.col("up")).alias("chain")), "walk")
        if walk.isEmpty():
            break
        ends.append(walk.where(F.col("at") == root).select("usn", joined(F.lit(root_prefix), F.col("path")).alias("path")))
    paths = reduce(DataFrame.unionByName, ends).groupBy("usn").agg(F.sort_array(F.collect_set("path")).alias("projected_paths"))
    out = topology.join(paths, "usn", "left").withColumn("projected_paths", F.coalesce("projected_paths", F.array().cast("array<string>")))
    return out.select(*_LINK[:2], "usn", "name", is_directory(F.col("file_attributes")).alias("is_directory"), reason_names(F.col("reason")).alias("reason_names"), "projected_paths")


def within(observed_events: DataFrame, scopes: list[Scope]) -> DataFrame:
    """Events of which any projected path is in any scope; all, if there is no scope."""
    return observed_events.where(F.exists("projected_paths", lambda p: in_scope(p, scopes))) if scopes else observed_events


def served(live: DataFrame, published: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of every drive, live ones where :func:`continuity` says ok, else the last published ones, marked degraded.
    All have a drive; there is one state for each."""
    fine = F.col("state") == "ok"
    now = live.join(states.where(fine).select("drive"), "drive", "left_semi").withColumn("degraded", F.lit(None).cast("string"))
    then = published.join(states.where(~fine).select("drive", F.col("state").alias("degraded")), "drive")
    return now.unionByName(then.select(*now.columns))


def answered(drives: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """The rows of all drives that answer, and why others did not; an error only if none does."""
    rows, failed = [], {}
    for drive, ask in drives.items():
        try:
            rows.append(ask())
        except Exception as e:  # whatever a drive's source raises  # noqa: BLE001
            failed[drive] = str(e)
    if not rows:
        raise RuntimeError("; ".join(f"{d}: {why}" for d, why in sorted(failed.items())) or "no drive was asked")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), failed


def index_sources(indexed: set[str], cached: set[str]) -> tuple[list[str], list[str]]:
    """Of the drives to be indexed, those whose table must be read first, and those that have it in memory already."""
    return sorted(indexed - cached), sorted(indexed & cached)
