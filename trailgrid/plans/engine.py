"""A query plan and the session that runs it over an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.functions.paths import drive, folded, terminal
from trailgrid.operators.overlay import merge
from trailgrid.plans.querylang import Rule, parse, predicate
from trailgrid.plans.rules import RuleSet
from trailgrid.plans.scopes import Scope, drive_letters, in_scope


def deleted_filter(deleted: Column, include: bool = False, only: bool = False) -> Column:
    """``only`` wins over ``include``; live rows alone by default."""
    return deleted if only else (F.lit(True) if include else ~deleted)


def filtered_filter(filtered: Column, show: bool = False, only: bool = False) -> Column:
    """The same for rows that rules filter out."""
    return filtered if only else (F.lit(True) if show else ~filtered)


@dataclass(frozen=True)
class QueryPlan:
    """What to look for and what to show; a limit of 0 is none."""

    query: tuple[str, ...]
    scopes: tuple[Scope, ...] = ()
    drives: str = "*"
    limit: int | None = None
    include_deleted: bool = False
    only_deleted: bool = False
    show_filtered: bool = False
    only_filtered: bool = False
    compat: str = "scan"

    @staticmethod
    def of(kind: str, needle: str = "", **more) -> QueryPlan:
        """A plan of one rule, for embedding."""
        text = {"all": "<>", "contains": needle, "prefix": f"<{needle}", "suffix": f"{needle}>", "exact": f"<{needle}>"}[kind]
        return QueryPlan((text,), **more)

    def groups(self) -> list[list[Rule]]:
        """The parsed query."""
        return parse(self.query)


def run(rows: DataFrame, plan: QueryPlan, rules: RuleSet | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of an index (path, has_deleted_entries, and what is stored of segs, term, ext, place and drive) that a plan
    selects, with is_filtered. Everything is one predicate over the scan; a limit takes the first rows, drives in the
    order of the plan's list and each drive's rows by ``order``."""
    have = set(rows.columns)
    segs = F.col("segs") if "segs" in have else folded(F.col("path"))
    term = F.col("term") if "term" in have else terminal(segs)
    own = F.col("drive") if "drive" in have else drive(F.col("path"))
    out, letters = rows, []
    if plan.drives != "*" or plan.scopes:
        letters = drive_letters(plan.drives, [], [s.root for s in plan.scopes])
        out = out.where(own.isin(letters)) if letters else out
    out = out.where(deleted_filter(F.col("has_deleted_entries"), plan.include_deleted, plan.only_deleted))
    out = out.where(in_scope(F.col("path"), list(plan.scopes), F.col("place") if "place" in have else None)) if plan.scopes else out
    out = out.where(predicate(plan.groups(), segs, term, plan.compat, ext=F.col("ext") if "ext" in have else None))
    out = out.withColumn("is_filtered", rules.filtered(F.col("path")) if rules else F.lit(False))
    out = out.where(filtered_filter(F.col("is_filtered"), plan.show_filtered, plan.only_filtered))
    if plan.limit:
        by_drive = [F.array_position(F.array(*map(F.lit, letters)), own)] if letters else [own] if "drive" in have else []
        out = out.orderBy(*by_drive, *(order or (["row_index"] if "row_index" in have else ["path"]))).limit(plan.limit)
    return out.select(*(c for c in ("drive",) if c in have), "path", "has_deleted_entries", "is_filtered")


@dataclass
class Session:
    """An index and its overlay, kept for many queries. :meth:`warm` holds rows in the executors' memory and disks, a
    drive at a time, until :meth:`cool`."""

    base: DataFrame
    overlay: DataFrame | None = None
    rules: RuleSet | None = None
    cached: dict[str, DataFrame] = field(default_factory=dict)
    held: dict[str, DataFrame] = field(default_factory=dict)

    def rows(self, mode: str = "resolved") -> DataFrame:
        """Base rows with the overlay's in their place."""
        if mode not in self.cached:
            self.cached[mode] = self.base if self.overlay is None else merge(self.base, self.overlay)
        return self.cached[mode]

    def warm(self, drives: list[str]) -> dict[str, int]:
        """Reads the rows of drives one after the other and keeps them; returns how many each has."""
        have = "drive" in self.base.columns
        for d in drives:
            if d not in self.held:
                own = F.col("drive") if have else drive(F.col("path"))
                self.held[d] = self.rows().where(own == d).persist()
        return {d: self.held[d].count() for d in drives}

    def cool(self) -> None:
        """Gives back what :meth:`warm` holds."""
        for rows in self.held.values():
            rows.unpersist()
        self.held.clear()

    def query(self, plan: QueryPlan) -> DataFrame:
        """The rows of a plan, from warm drives if it names such alone; by path if there is an overlay."""
        letters = drive_letters(plan.drives, [], [s.root for s in plan.scopes])
        rows = self.rows()
        if letters and all(d in self.held for d in letters):
            rows = reduce(DataFrame.unionByName, (self.held[d] for d in letters))
        return run(rows, plan, self.rules, ["path"] if self.overlay is not None else None)

    def visit(self, plan: QueryPlan, visitor: Callable[[object], bool | None]) -> int:
        """Gives rows to ``visitor`` one by one until it returns False; returns how many it saw."""
        n = 0
        for row in self.query(plan).toLocalIterator():
            n += 1
            if visitor(row) is False:
                break
        return n
