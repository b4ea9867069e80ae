"""Choosing how a stored index answers a query: by its inverted tables where a rule allows it, else by a scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.operators.index import Stored, rows_of_segments, trigram_candidates, trigrams_of
from trailgrid.plans.engine import QueryPlan, run
from trailgrid.plans.querylang import Rule, predicate
from trailgrid.plans.rules import RuleSet

#: Ways to rows, the most selective first.
_WAYS = ("term", "ext", "trigrams", "segments")


@dataclass(frozen=True)
class Access:
    """The way to the rows of a group of rules, and the rule that it goes by; ``scan`` goes by none."""

    way: str
    rule: Rule | None = None


def access(rules: list[Rule], compat: str) -> Access:
    """The most selective way that one of the rules allows; the other rules are tested on its rows."""

    def way(rule: Rule) -> str | None:
        if rule.kind == "exact":
            return "term"
        if rule.kind == "suffix" and compat == "index" and rule.needle.startswith(".") and len(rule.needle) > 1:
            return "ext"
        if rule.kind == "contains" and trigrams_of(rule.needle):
            return "trigrams"
        return "segments" if rule.kind == "prefix" else None

    found = [(_WAYS.index(w), -len(r.needle), i) for i, r in enumerate(rules) if (w := way(r))]
    if not found:
        return Access("scan")
    best = rules[min(found)[2]]
    return Access(way(best), best)


def accesses(plan: QueryPlan) -> list[Access]:
    """The way of each alternative; one scan for all, if any of them needs one."""
    found = [access(group, plan.compat) for group in plan.groups()]
    return [Access("scan")] if any(a.way == "scan" for a in found) else found


def _reached(index: Stored, way: Access) -> DataFrame:
    """The rows that an access leads to, some of which may not match."""
    needle = way.rule.needle
    if way.way == "term":
        return index.rows.where(F.col("term") == needle)
    if way.way == "ext":
        return index.rows.where(F.col("ext") == needle)
    found = trigram_candidates(index, needle) if way.way == "trigrams" else index.postings.where(F.startswith("segment", F.lit(needle))).select("segment").distinct()
    return index.rows.join(rows_of_segments(index, found), ["drive", "row_index"], "left_semi")


def search(index: Stored, plan: QueryPlan, rules: RuleSet | None = None) -> DataFrame:
    """What :func:`trailgrid.plans.engine.run` gives on the index's rows, by the chosen ways."""
    ways = accesses(plan)
    if ways[0].way == "scan":
        return run(index.rows, plan, rules)
    segs, term, ext = F.col("segs"), F.col("term"), F.col("ext")
    tests: list[Column] = [F.coalesce(predicate([g], segs, term, plan.compat, ext=ext), F.lit(False)) for g in plan.groups()]
    parts = []
    for i, way in enumerate(ways):  # a row that several alternatives match comes by the first of them
        part = _reached(index, way).where(tests[i])
        parts.append(part.where(~reduce(Column.__or__, tests[:i])) if i else part)
    return run(reduce(DataFrame.unionByName, (p.select(*index.rows.columns) for p in parts)), plan, rules)
