"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. The rates r of its documents, 0 to 2 copies, are those of least entropy that meet
the target: r = min(2, exp(lambda * size / mean size)). The convex dual has one lambda a source and is solved by
Newton iterations; each iteration is one aggregation of a table of distinct (source, size) pairs for all sources at
once. Rates become whole copies by a hash of the row, and one threshold a source is moved, by a distributed radix
search, to where the words taken come nearest to the target. Rows that are alike in every column are numbered apart, so
each draws a hash of its own.

Sums that decide anything are sums of integers, so reruns agree whatever the order of the rows.

Defined results: a null text has size 0; a null source is a source of its own, the last in order; documents of size 0
are taken at rate 1; repeated rows are documents of their own, taken as often together as the target needs; an empty
table gives an empty result; extra columns are kept by :func:`mixed`, and tell rows apart.

The driver holds a few numbers for each source.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, repeated, row_hash, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Rates and hashes are integers of this unit.
UNIT = 1 << 40
#: Steps of the radix search for an edge: 2048 ranges of keys each.
STEPS = (1 << 30, 1 << 19, 1 << 8, 1)
#: Sources up to this number are sent to the executors with their parameters; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000
_WORDS = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """The target of each source: a share of all words by weight, at most ``cap`` times the source's own words, what
    is above that being shared out again by weight."""
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    size, weight = dict(sizes), {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, rest, free = {}, share * sum(size.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total >= cap * size[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in free}
        for s in full:
            out[s] = cap * size[s]
        rest -= sum(cap * size[s] for s in full)
        free = [s for s in free if s not in set(full)]
    return out


def _with(df: DataFrame, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Joins parameters of the sources to ``df`` by ``source``, null being a source."""
    rows = list(rows)
    small = df.sparkSession.createDataFrame(rows, schema).withColumnRenamed("source", "_source")
    small = F.broadcast(small) if len(rows) <= BROADCAST_SOURCES else small
    return df.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def rate(lam: str = "lambda", mean: str = "mean", size: str = "size"):
    """The rate as an integer of UNIT."""
    power = F.least(F.col(lam) * F.col(size) / F.col(mean), F.lit(1.0))
    return F.when(F.col(size) == 0, F.lit(UNIT)).otherwise(F.round(F.least(F.lit(CAP), F.exp(power)) * UNIT)).cast("long")


def solve(pairs: DataFrame, stats: dict, goal: dict, rounds: int = 60) -> dict:
    """lambda of each source by safeguarded Newton steps. ``pairs``: source, size, n; ``stats``: source -> (rows,
    words); ``goal``: source -> words."""
    lam = dict.fromkeys(stats, 0.0)
    mean = {s: max(1.0, words / max(1, n)) for s, (n, words) in stats.items()}
    low, high, open_ = dict.fromkeys(stats, -math.inf), dict.fromkeys(stats, math.inf), set()
    for s, (_, words) in stats.items():
        if goal[s] >= CAP * words:
            lam[s] = 1e9
        elif words:
            open_.add(s)
    for _ in range(rounds):
        if not open_:
            break
        asked = _with(pairs, [(s, lam[s], mean[s]) for s in open_], "source string, lambda double, mean double")
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        scaled = asked.withColumn("r", rate())
        slope = F.when(F.col("r") < int(CAP * UNIT), F.round(F.col("r") * F.col("size") / F.col("mean"))).otherwise(0).cast("long")
        sums = scaled.groupBy("source").agg(F.sum(words * F.col("r").cast("decimal(13,0)")).alias("got"), F.sum(words * slope.cast("decimal(17,0)")).alias("slope"))
        for r in sums.collect():  # one row a source
            s, off, slope_at = r["source"], int(r["got"]) / UNIT - goal[r["source"]], int(r["slope"]) / UNIT
            if abs(off) <= max(0.25, 1e-7 * goal[s]):
                open_.discard(s)
                continue
            if off > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - off / slope_at if slope_at > 0 else math.nan
            if not low[s] < step < high[s] or abs(step - lam[s]) > 4 + abs(lam[s]):
                ends = (low[s], high[s])
                step = sum(ends) / 2 if all(map(math.isfinite, ends)) else lam[s] + (2 + abs(lam[s])) * (1 if off < 0 else -1)
            if step == lam[s]:
                open_.discard(s)
            lam[s] = step
    return {s: (lam[s], mean[s]) for s in stats}


def copies():
    """Whole copies: one or none above the lower whole number, by the key against the source's edge."""
    return F.col("base") + F.when((F.col("key") < F.col("edge")) | (F.col("key") == F.col("one")), 1).otherwise(0)


def _rounding(df: DataFrame) -> DataFrame:
    """base, and key: where in 0 .. 2 * UNIT the source's edge must be for one copy more."""
    base = F.when(F.col("r") < UNIT, 0).otherwise(1)
    return df.withColumn("base", base.cast("long")).withColumn("key", (F.col("u") - (F.col("r") - base * UNIT) + UNIT).cast("long"))


def edges(rows: DataFrame, goal: dict) -> dict:
    """For each source the edge up to which the words taken stay within its goal, by rounds of sums in ranges of keys,
    and the key of one more document that brings them nearest to it."""
    need = {r["source"]: goal[r["source"]] - int(r["words"]) for r in rows.groupBy("source").agg(F.sum((F.col("base") * F.col("size")).cast("decimal(20,0)")).alias("words")).collect()}
    start = dict.fromkeys(need, 0)
    span = 2 * UNIT
    past = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # up to 2048 rows a source
    for width in STEPS:
        asked = _with(rows, ((s, start[s], float(need[s])) for s in need), "source string, from_key long, need double").where((F.col("key") >= F.col("from_key")) & (F.col("key") < F.col("from_key") + span))
        sums = asked.groupBy("source", "need", F.floor((F.col("key") - F.col("from_key")) / width).alias("bin")).agg(F.sum(F.col("size").cast("decimal(20,0)")).alias("words"))
        run = sums.withColumn("past", F.coalesce(F.sum("words").over(past), F.lit(0).cast("decimal(30,0)")))
        over = F.col("past") + F.col("words") > F.col("need")
        first = F.min(F.when(over, F.struct("bin", "past")))
        crossed = run.groupBy("source").agg(first.alias("at"), F.sum("words").alias("all")).collect()
        for r in crossed:
            start[r["source"]] += r["at"]["bin"] * width if r["at"] else span
            need[r["source"]] -= int(r["at"]["past"] if r["at"] else r["all"])
        for s in need.keys() - {r["source"] for r in crossed}:
            start[s] += span
        span = width
    # what is still missing is less than the next document: one document of about that size makes up for it
    left = _with(rows, ((s, start[s], float(need[s])) for s in need), "source string, edge long, need double").where((F.col("key") >= F.col("edge")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("need")))
    nearest = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("need")).alias("off"), "key")).alias("best")).collect()
    one = {r["source"]: r["best"]["key"] for r in nearest}
    return {s: (start[s], one.get(s, -1)) for s in start}


def _drawn(rows: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """Adds u, a draw in 0 .. UNIT for each row."""
    return numbered(rows, repeats).withColumn("u", F.shiftrightunsigned(F.xxhash64("hash", "number"), 24)).drop("number")


def plan(documents: DataFrame, weights=WEIGHTS, share: float = SHARE) -> tuple[DataFrame, list[tuple], DataFrame | None]:
    """The narrow rows (doc_id, source, size, hash, u), the parameters of each source: (source, source_size, target,
    lambda, mean, edge, one), and the hashes of repeated rows, if there are any."""
    narrow = written(sized(documents.withColumn("hash", row_hash(documents))).select("doc_id", "source", "size", "hash"), "narrow")
    repeats = repeated(narrow)
    rows = written(_drawn(narrow, repeats), "mixing")
    pairs = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    found = pairs.groupBy("source").agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("size")).cast("decimal(20,0)")).alias("words")).collect()
    stats = {r["source"]: (r["n"], int(r["words"])) for r in found}
    goal = targets([(s, words) for s, (_, words) in stats.items()], weights, share)
    solved = solve(pairs, stats, goal)
    if not stats:
        return rows, [], None
    rated = _rounding(_with(rows, ((s, *x) for s, x in solved.items()), "source string, lambda double, mean double").withColumn("r", rate()))
    edge = edges(rated, goal)
    return rows, [(s, words, float(goal[s]), *solved[s], *edge[s]) for s, (_, words) in stats.items()], repeats


_PARAMETERS = "source string, source_size long, target double, lambda double, mean double, edge long, one long"


def sized(documents: DataFrame) -> DataFrame:
    """Adds the number of words."""
    text = F.col("text").cast("string")
    return documents.withColumns(
        {
            "doc_id": F.col("doc_id").cast("long"),
            "source": F.col("source").cast("string"),
            "size": F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long"),
        }
    )


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of every document."""
    rows, parameters, _ = plan(documents, weights, share)
    rated = _rounding(_with(rows, parameters, _PARAMETERS).withColumn("r", rate())).withColumn("copies", copies())
    return rated.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed(documents: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with the columns that they have."""
    _, parameters, repeats = plan(documents, weights, share)
    kept = documents.select("doc_id", "source", "text", F.struct([F.col(c) for c in documents.columns]).alias("row"), row_hash(documents).alias("hash"))
    rated = _rounding(_with(_drawn(sized(kept), repeats), parameters, _PARAMETERS).withColumn("r", rate())).withColumn("copies", copies())
    return rated.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")
