"""Rules files, checkpoints and directory trees on the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from trailgrid.plans.rules import EXTENSION, RuleFile, parse_file


def rule_files(folder: str) -> list[RuleFile]:
    """The rules files that stand directly in a folder."""
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(EXTENSION):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out.append(parse_file(os.path.join(folder, name), f.read(), git_root(folder)))
    return out


def git_root(folder: str) -> str | None:
    """The nearest folder from ``folder`` upwards that holds a repository."""
    at = os.path.abspath(folder)
    while not os.path.exists(os.path.join(at, ".git")):
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return at


def unknown(found: list[RuleFile], known: list[RuleFile]) -> list[RuleFile]:
    """The files whose paths are not among those that are known already."""
    have = {f.path for f in known}
    return [f for f in found if f.path not in have]


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, has_deleted_entries of a live tree, the root first."""
    rows = [(root, False)]
    for folder, folders, files in os.walk(root):
        rows += [(os.path.join(folder, x), False) for x in sorted(folders + files)]
    return spark.createDataFrame(rows, "path string, has_deleted_entries boolean")


def save_checkpoint(path: str, checkpoint: dict) -> None:
    """By a temporary file that takes the place of the old one."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(checkpoint, f)
    os.replace(f"{path}.tmp", path)


def load_checkpoint(path: str) -> dict:
    """As saved."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
