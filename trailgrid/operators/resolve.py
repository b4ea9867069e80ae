"""Paths from links, as joins: folders level by level from the root, plain listings by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.functions.paths import joined, record_number
from trailgrid.storage import written

ROOT = 5


def namespace_rank(namespace: Column) -> Column:
    """Win32 first, then Win32 and DOS, POSIX, DOS, others."""
    return F.when(namespace == 1, 0).when(namespace == 3, 1).when(namespace == 0, 2).when(namespace == 2, 3).otherwise(4)


def best_names(links: DataFrame, key: str = "frn") -> DataFrame:
    """One name for each (entry, parent): lowest rank, then the first by ``ordinal``."""
    best = F.min_by(F.struct(*(F.col(c) for c in links.columns if c not in (key, "parent_frn"))), F.struct(namespace_rank(F.col("namespace")), F.col("ordinal")))
    return links.groupBy(key, "parent_frn").agg(best.alias("best")).select(key, "parent_frn", "best.*")


def directory_names(links: DataFrame) -> DataFrame:
    """One name for each entry, for plain listings: lowest rank, then the shortest in bytes."""
    best = F.min_by(F.struct("parent_frn", "name"), F.struct(namespace_rank(F.col("namespace")), F.octet_length("name"), F.col("name")))
    return links.groupBy("frn").agg(best.alias("best")).select("frn", "best.parent_frn", "best.name")


def resolve(links: DataFrame, root_prefix: str, key: str = "record", root: int = ROOT) -> DataFrame:
    """Every path of every entry, at any depth: frn, path, depth, has_deleted_entries.

    ``links``: frn, parent_frn, name, is_deleted. ``key``: parents are found by the 48-bit ``record`` number or the
    whole ``frn``. An entry gets a path for each path of each of its parents (hard links); entries whose chain does not
    reach the root get none, and a link that leads back into its own chain is not followed. A path that an entry gets
    twice keeps the version with the fewest deleted components.

    Only entries that are parents are followed from the root, each level written once; all entries meet their parents'
    paths in one join in the end, which Spark can split where a folder holds very many."""
    of = record_number if key == "record" else (lambda c: c)
    edges = links.select(of(F.col("frn")).alias("k"), of(F.col("parent_frn")).alias("parent"), "frn", "name", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"))
    edges = written(edges, "edges")
    above = edges.select(F.col("parent").alias("k")).distinct()
    folders = written(edges.join(above, "k", "left_semi").select("k", "parent", "name", "is_deleted"), "folders")
    level = links.sparkSession.createDataFrame([(root, root_prefix, 0, 0, [root])], "k long, base string, dead int, depth int, chain array<long>")
    levels = [level]
    while True:
        level = written(_below(folders, level).select("k", "base", "dead", "depth", "chain"), "level")
        if level.isEmpty():
            break
        levels.append(level)
    every = _below(edges, reduce(DataFrame.unionByName, levels))
    once = every.groupBy("frn", F.col("base").alias("path")).agg(F.min(F.struct("dead", "depth")).alias("best"))
    return once.select("frn", "path", F.col("best.depth").alias("depth"), (F.col("best.dead") > 0).alias("has_deleted_entries"))


def _below(edges: DataFrame, level: DataFrame) -> DataFrame:
    """What stands directly below the entries of a level."""
    met = edges.join(level.withColumnRenamed("k", "parent"), "parent").where(~F.array_contains("chain", F.col("k")))
    return met.withColumns(
        {
            "base": joined(F.col("base"), F.col("name")), "dead": F.col("dead") + F.col("is_deleted").cast("int"),
            "depth": F.col("depth") + 1, "chain": F.array_append("chain", F.col("k")),
        }
    )


def project(paths: DataFrame) -> DataFrame:
    """Index rows of resolved paths: a path is live if any entry that has it is."""
    return paths.groupBy("path").agg((~F.bool_or(~F.col("has_deleted_entries"))).alias("has_deleted_entries"))


_NOWHERE = -1


def list_paths(links: DataFrame, root: int = ROOT) -> DataFrame:
    """One path for each entry by its directory name, at any depth: frn, path, complete. A chain that breaks gives the
    part that is known; a chain that runs into a cycle breaks above the cycle's smallest entry.

    Only entries that are parents walk upwards, and each round doubles the distance that they have gone; all entries
    meet their parents' paths in one join in the end."""
    names = directory_names(links)
    steps = written(names.select("frn", record_number(F.col("frn")).alias("k"), record_number(F.col("parent_frn")).alias("at"), F.col("name").alias("path")), "steps")
    folders = steps.join(steps.select(F.col("at").alias("k")).distinct(), "k", "left_semi")
    folders = written(folders.groupBy("k").agg(F.min_by(F.struct("at", "path"), "frn").alias("x")).select("k", "x.at", "x.path", F.lit("open").alias("state")), "folders")
    walked = _walked(folders, root)
    circling = walked.where("state = 'open'").select("k")
    if not circling.isEmpty():
        ends = _cycle_ends(folders.join(circling, "k", "left_semi").select("k", "at"))
        cut = folders.join(ends.withColumn("ends", F.lit(True)), "k", "left")
        walked = _walked(cut.select("k", F.when(F.col("ends"), F.lit(_NOWHERE)).otherwise(F.col("at")).alias("at"), "path", "state"), root)
        own = steps.join(ends.withColumn("ends", F.lit(True)), "k", "left").withColumn("at", F.when(F.col("ends"), F.lit(_NOWHERE)).otherwise(F.col("at")))
    else:
        own = steps
    return _stepped(own, walked, root).select("frn", "path", (F.col("state") == "whole").alias("complete"))


def _stepped(rows: DataFrame, walked: DataFrame, root: int) -> DataFrame:
    """Rows with k, at and path, gone on by the way that their ``at`` has gone."""
    above = walked.select(F.col("k").alias("at"), F.col("at").alias("_at"), F.col("path").alias("_path"), F.col("state").alias("_state"))
    state = F.when(F.col("at") == root, "whole").when(F.col("_path").isNull(), "broken").otherwise(F.col("_state"))
    path = F.when((F.col("at") == root) | F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", F.lit("\\"), "path"))
    gone = rows.join(above, "at", "left").withColumns({"state": state, "path": path, "at": F.coalesce("_at", "at")})
    return gone.drop("_at", "_path", "_state")


def _walked(folders: DataFrame, root: int) -> DataFrame:
    """k, at, path, state: ``whole`` up to the root, ``broken``, or ``open`` for entries whose way has no end.

    Of the entries whose way ends, some one at up to twice the distance of the last ones ends in the next round; so if
    none does, what is open runs in circles, and no path has grown beyond twice the depth."""
    left = -1
    while True:
        open_ = folders.where("state = 'open'")
        n = open_.count()
        if n in (0, left):
            return folders
        left = n
        closed = folders.where("state <> 'open'")
        folders = written(closed.unionByName(_stepped(open_.drop("state"), folders, root).select("k", "at", "path", "state")), "walked")


def _cycle_ends(steps: DataFrame) -> DataFrame:
    """The smallest entry of each cycle: k. ``steps``: k, at of entries whose way has no end."""
    n, gone = steps.count(), 1
    walked = written(steps.withColumn("low", F.least("k", "at")), "circles")
    while gone < n:
        ahead = walked.select(F.col("k").alias("at"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        walked = written(walked.join(ahead, "at").select("k", F.col("_at").alias("at"), F.least("low", "_low").alias("low")), "circles")
        gone *= 2
    within = walked.select(F.col("at").alias("k")).distinct()
    return walked.join(within, "k", "left_semi").where("k = low").select("k")
