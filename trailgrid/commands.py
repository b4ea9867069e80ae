"""What the command line does with tables: lines of results, one-row upserts, listings of rules and journals."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trailgrid.operators.live import journals
from trailgrid.operators.overlay import upsert

#: Codes of terminals for yellow, red and green, and for none.
_YELLOW, _RED, _GREEN, _PLAIN = "\x1b[33m", "\x1b[31m", "\x1b[32m", "\x1b[39m"


def line(row: Row, colour: bool = False) -> str:
    """A result's path: yellow if rules filter it out, red if something on it is deleted, else green."""
    if not colour:
        return row["path"]
    paint = _YELLOW if row["is_filtered"] else _RED if row["has_deleted_entries"] else _GREEN
    return f"{paint}{row['path']}{_PLAIN}"


def show(rows: DataFrame, out: TextIO, colour: bool = False, stop: Callable[[], bool] = lambda: False) -> int:
    """Writes a line a row, partition by partition; ends early if ``stop`` says so, and cancels what still runs. Returns
    the number of lines."""
    session, n = rows.sparkSession, 0
    tag = f"show-{id(rows)}"
    session.addTag(tag)
    try:
        for row in rows.toLocalIterator():
            if stop():
                session.interruptTag(tag)
                break
            out.write(line(row, colour) + "\n")
            n += 1
    finally:
        session.removeTag(tag)
    return n


def columns(values: list[str], width: int, gap: int = 2) -> list[str]:
    """Values laid out in columns, filled downwards, as lines of at most ``width``."""
    if not values:
        return []
    cell = max(1, *map(len, values))
    n = max(1, (width + gap) // (cell + gap))
    rows = -(-len(values) // n)
    return ["".join(values[r + c * rows].ljust(cell + gap) for c in range(n) if r + c * rows < len(values)).rstrip() for r in range(rows)]


def moved(overlay: DataFrame, source: str, target: str) -> DataFrame:
    """The overlay after a file was renamed: the old path deleted, the new one there."""
    return upsert(overlay, overlay.sparkSession.createDataFrame([*{source: True, target: False}.items()], "path string, has_deleted_entries boolean"))


def synced(overlay: DataFrame, path: str, is_there: bool) -> DataFrame:
    """The overlay after a look at one path."""
    return upsert(overlay, overlay.sparkSession.createDataFrame([(path, not is_there)], "path string, has_deleted_entries boolean"))


def query_journals(spark: SparkSession, cursors: Iterable[dict], active: bool | None = None) -> list[str]:
    """A line for each drive's journal, all or the (in)active ones, drives in order."""
    schema = "drive string, journal_id long, first_usn long, next_usn long, lowest_valid_usn long, max_usn long"
    known = [tuple(c.get(x.split()[0]) for x in schema.split(", ")) for c in cursors]
    found = journals(spark.createDataFrame(known, schema), active)
    text = F.when(F.col("active"), F.format_string("%s: journal %016x, events %d to %d, valid from %d", "drive", "journal_id", "first_usn", "next_usn", "lowest_valid_usn"))
    return [r[0] for r in found.select(F.coalesce(text, F.concat("drive", F.lit(": no journal")))).collect()]
