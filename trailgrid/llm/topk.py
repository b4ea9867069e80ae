"""Exact top-k search by block-at-a-time pruning.

Vectors are turned into whole numbers. Rows are put in the order of the nearest of a few centres, which come from a
bounded sample and decide nothing but this order, and are cut into chunks and blocks. A block keeps the largest and
smallest value of each term (component). For a query, the sum over the terms of the largest product that the block could
give bounds every score in it. Blocks are taken in the order of their bounds and scored through their forward index, the
rows of the block, until the next bound is below the query's k-th score. Bounds equal to the k-th score are still
scored, as ties go to the smaller id.

Queries are a stated set. Groups of them first meet the bounds of all blocks and score the one chunk that promises most;
that gives each query a k-th score. With it the bounds are met again, and only chunks with a block whose bound reaches
the k-th score of some query go to the group, which scores them one after the other, the most promising first, and hands
the k-th scores from chunk to chunk. What leaves a group is k rows a query, whatever the number of chunks (as many
times, where there are fewer groups than tasks, as their chunks are dealt to several tasks).

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
shorter vectors count as filled up with zeros; components and scores are exact at any size, and a score that a long
cannot hold is null at its right rank; a row is never its own result, but other rows with its id are; repeated rows are
all candidates and rank side by side; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, written

CHUNK, GROUP, BLOCK = 2048, 512, 128
#: Chunks whose bounds stand in one row.
PAGE = 256
#: Rows and bytes of the sample that the centres come from, and centres at most.
SAMPLE, SAMPLE_BYTES, CENTRES = 4096, 16_000_000, 512


@dataclass(frozen=True)
class Numbers:
    """How the whole numbers floor(scale * x) are kept: in ``kind``, or as the doubles x themselves if that is None.
    ``work``: the type in which all sums are exact. ``wide``: bytes of a key in the order of scores beyond a long."""

    dim: int
    scale: float
    kind: str | None
    work: type
    wide: int

    @staticmethod
    def of(dim: int, scale: float, largest: float) -> Numbers:
        """For vectors of at most ``dim`` components of at most ``largest``."""
        if largest * scale < 2.0**50:
            most = math.floor(largest * scale) + 1
            sums = dim * most * most * 4
            if sums < 2**62:
                kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
                return Numbers(dim, scale, kind, np.float32 if sums < 2**24 else np.float64 if sums < 2**53 else object, 0)
        bits = 2 * (math.frexp(largest)[1] + math.frexp(scale)[1] + 1) + dim.bit_length() + 2
        return Numbers(dim, scale, None, object, max(9, bits // 8 + 1))

    def matrix(self, rows: list) -> bytes:
        """Rows of doubles as they are kept."""
        out = np.zeros((len(rows), self.dim))
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return (np.floor(out * self.scale).astype(self.kind) if self.kind else out).tobytes()

    def read(self, raw: bytes) -> np.ndarray:
        """As kept, ready for sums."""
        x = np.frombuffer(raw, self.kind or "<f8").reshape(-1, self.dim)
        if self.kind:
            return x.astype(self.work)
        whole = [[math.floor(v * self.scale) if abs(v) < 2.0**500 else int(v) * int(self.scale) for v in row] for row in x.tolist()]
        return np.array(whole, object).reshape(x.shape)

    def key(self, score) -> bytes:
        """In the order of scores."""
        return (int(score) + (1 << (8 * self.wide - 2))).to_bytes(self.wide, "big")

    def of_key(self, key: bytes) -> int:
        """The score of a key."""
        return int.from_bytes(key, "big") - (1 << (8 * self.wide - 2))


def extremes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of each term in each block."""
    starts = np.arange(0, len(x), BLOCK)
    return np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): no score of the block is greater."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


@dataclass
class Best:
    """The k best rows of each query of a group, by score and then by smaller (id, row), of the chunks met so far."""

    q: np.ndarray
    q_rows: np.ndarray
    k: int
    kth: np.ndarray
    scored: int = 0
    found: list[list[np.ndarray]] = field(default_factory=lambda: [[], [], [], []])

    def meet(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores the blocks of a chunk that may hold one of the k best rows of some query."""
        starts, n = np.arange(0, len(x), BLOCK), len(x)
        bound = bounds(self.q, *extremes(x))
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.ones(len(self.q), bool)
        for step in range(len(starts)):
            now = order[:, step]
            active &= (bound[np.arange(len(self.q)), now] >= self.kth).astype(bool)
            if not active.any():
                return
            for block in np.unique(now[active]).tolist():
                asked, first, last = np.flatnonzero(active & (now == block)), starts[block], min(n, starts[block] + BLOCK)
                score = self.q[asked] @ x[first:last].T
                good = (score >= self.kth[asked, None]).astype(bool) & (rows[None, first:last] != self.q_rows[asked, None])
                at, place = np.nonzero(good)
                for column, new in zip(self.found, (asked[at], score[at, place], ids[first + place], rows[first + place]), strict=True):
                    column.append(new)
                self.scored += len(asked)
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """query, score, id, row of the k best so far, in order."""
        if not self.found[0]:
            return [np.zeros(0, np.int64)] * 4
        query, score, ids, rows = (np.concatenate(x) for x in self.found)
        rank = np.unique(score, return_inverse=True)[1]
        order = np.lexsort((rows, ids, -rank, query))
        query = query[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        best = order[place < self.k]
        last = order[place == self.k - 1]
        self.found = [[x[best]] for x in (np.concatenate(self.found[0]), score, ids, rows)]
        self.kth[self.found[0][0][place[place < self.k] == self.k - 1]] = score[last]
        return [x[0] for x in self.found]


def _packed(rows: DataFrame, size: int, numbers: Numbers) -> DataFrame:
    """Runs of at most ``size`` rows in the order of (centre, vec_id, row): run, ids, rows, matrix, high and low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal made
            take, held[:] = held[:size], held[size:]
            matrix = numbers.matrix([x[2] for x in take])
            kept = np.frombuffer(matrix, numbers.kind or "<f8").reshape(len(take), numbers.dim)
            high, low = extremes(kept)
            cells = [np.array([x[i] for x in take], "<i8").tobytes() for i in (0, 1)] + [matrix, high.tobytes(), low.tobytes()]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), *(pa.array([x], pa.binary()) for x in cells)], ["run", "ids", "rows", "matrix", "high", "low"])

        for batch in slices(batches):
            held.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while len(held) >= size:
                yield out()
        if held:
            yield out()

    ordered = rows.repartitionByRange("centre", "vec_id", "row").sortWithinPartitions("centre", "vec_id", "row")
    return written(ordered.select("vec_id", "row", "x").mapInArrow(run, "run long, ids binary, rows binary, matrix binary, high binary, low binary"), "runs")


def _centred(vectors: DataFrame, n: int, dim: int, largest: float, rounds: int = 4) -> DataFrame:
    """With the number of the nearest centre; a few rounds of k-means over the sample."""
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    draw = F.pmod(F.xxhash64("vec_id", "row"), F.lit(max(1, n // size))) == 0
    unit = 1 / max(largest, 1e-300)

    def filled(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), dim), np.float32)
        for i, x in enumerate(rows):
            out[i, : len(x)] = np.array(x) * unit
        return out

    sample = filled([r["x"] for r in vectors.where(draw).select("x").limit(size).collect()])
    centres = sample[: max(1, min(CENTRES, n // (2 * BLOCK), len(sample)))]

    def nearest(x: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1) / 2 - x @ centres.T).argmin(axis=1) if len(centres) else np.zeros(len(x), np.int64)

    for _ in range(rounds if len(centres) > 1 else 0):
        own = nearest(sample)
        n_own = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n_own[:, None] > 0, sums / np.maximum(n_own, 1)[:, None], centres).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre = nearest(filled(batch.column(2).to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre.astype(np.int32))], [*batch.schema.names, "centre"])

    return vectors.mapInArrow(run, "vec_id long, row long, x array<double>, asks boolean, centre int")


def _promising(groups: DataFrame, pages: DataFrame, n_pages: int, numbers: Numbers) -> DataFrame:
    """g, run and how much is to be expected of it: for groups without ``floor`` the chunk of each page whose bounds are
    highest; else every chunk with a block whose bound reaches a query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for g, rows, matrix, floor, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = numbers.read(matrix)
                high, low = (np.concatenate([numbers.read(x[i]) for x in chunks]) for i in ("high", "low"))
                starts = np.cumsum([0, *(len(numbers.read(x["high"])) for x in chunks[:-1])])
                bound = np.maximum.reduceat(bounds(q, high, low), starts, axis=1)
                if floor is None:
                    promise = bound.mean(axis=0) if numbers.work is not object else bound.sum(axis=0)
                    chosen, worth = np.array([int(np.argmax(promise))]), np.zeros(1)
                    worth = np.array([min(float(promise[chosen[0]]), 1e300)]) if numbers.wide == 0 else worth
                else:
                    kth = _kth(floor, np.frombuffer(rows, "<i8"), numbers)
                    chosen = np.flatnonzero((bound >= kth[:, None]).astype(bool).any(axis=0))
                    finite = np.where(kth == -np.inf, 0, kth)
                    worth = (bound - finite[:, None]).max(axis=0)[chosen].astype(np.float64) if numbers.wide == 0 else np.zeros(len(chosen))
                runs = np.array([x["run"] for x in chunks])[chosen]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(worth, pa.float64())], ["g", "run", "worth"])

    every = groups.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))))
    met = every.join(pages, "page").select("g", "rows", "matrix", "floor", "chunks")
    return met.mapInArrow(run, "g long, run long, worth double")


def _kth(floor: list[dict], rows: np.ndarray, numbers: Numbers) -> np.ndarray:
    """The k-th score so far of each query of a group."""
    known = {x["row"]: numbers.of_key(x["key"]) if numbers.wide else x["score"] for x in floor}
    return np.array([known.get(r, -np.inf) for r in rows.tolist()], object if numbers.work is object else np.float64)


_FLOOR = "array<struct<row: bigint, score: bigint, key: binary>>"
_HITS = "g long, query_row long, query_id long, vec_id long, row long, score long, key binary"


def _meetings(asked: DataFrame, groups: DataFrame, chunks: DataFrame, k: int, numbers: Numbers) -> DataFrame:
    """The k best rows of each query in the chunks of a place. ``asked``: g, part, run, worth."""

    def hits(g: int, ids: np.ndarray, best: Best) -> pa.RecordBatch:
        query, score, vec, row = best.settle()
        fits = [-(2**63) <= s < 2**63 for s in score.tolist()]
        cells = [pa.array([g] * len(query), pa.int64()), pa.array(best.q_rows[query], pa.int64()), pa.array(ids[query], pa.int64()), pa.array(vec, pa.int64()), pa.array(row, pa.int64())]
        cells += [pa.array([int(s) if f else None for s, f in zip(score.tolist(), fits, strict=True)], pa.int64()), pa.array([numbers.key(s) if numbers.wide else None for s in score.tolist()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, [x.split()[0] for x in _HITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, g, ids = None, None, None
        for batch in slices(batches, 8):
            for own, is_chunk, own_ids, rows, matrix, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, own_ids, rows = numbers.read(matrix), np.frombuffer(own_ids, "<i8"), np.frombuffer(rows, "<i8")
                if is_chunk:
                    best.meet(x, own_ids, rows)
                    continue
                if best is not None:
                    yield hits(g, ids, best)
                best, g, ids = Best(x, rows, k, _kth(floor or [], rows, numbers)), own, own_ids
        if best is not None:
            yield hits(g, ids, best)

    cells = ("ids", "rows", "matrix")
    heads = asked.select("g", "part").distinct().join(groups, "g").select("g", "part", F.lit(False).alias("is_chunk"), F.lit(0.0).alias("worth"), *cells, "floor")
    tails = asked.join(chunks, "run").select("g", "part", F.lit(True).alias("is_chunk"), "worth", *cells, F.lit(None).cast(_FLOOR).alias("floor"))
    placed = heads.unionByName(tails).repartition("g", "part").sortWithinPartitions("g", "part", "is_chunk", F.desc("worth"))
    return placed.select("g", "is_chunk", *cells, "floor").mapInArrow(run, _HITS)


def top_k(rows: DataFrame, queries: F.Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row that ``queries`` selects."""
    spark = rows.sparkSession
    small_batches(spark)
    parts = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    taken = rows.where(good & F.col("vec_id").isNotNull())
    vectors = taken.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), parts.alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    vectors = written(vectors, "vectors")
    found = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    n, dim, largest = found["n"], max(1, found["dim"] or 1), found["largest"] or 0.0
    numbers = Numbers.of(dim, scale, largest)
    centred = written(_centred(vectors, n, dim, largest), "centred")
    chunks = _packed(centred, CHUNK, numbers)
    floorless = F.lit(None).cast(_FLOOR).alias("floor")
    groups = _packed(centred.where("asks"), GROUP, numbers).select(F.col("run").alias("g"), "ids", "rows", "matrix", floorless)
    n_chunks, n_groups = chunks.count(), max(1, groups.count())
    n_pages = max(1, math.ceil(n_chunks / PAGE))
    pages = chunks.select(F.pmod(F.xxhash64("run"), F.lit(n_pages)).alias("page"), F.struct("run", "high", "low").alias("x")).groupBy("page").agg(F.collect_list("x").alias("chunks"))
    pages = written(pages, "pages")
    first = written(_promising(groups, pages, n_pages, numbers).groupBy("g").agg(F.max(F.struct("worth", "run")).alias("x")).select("g", "x.run", "x.worth"), "first")
    begun = written(_meetings(first.withColumn("part", F.lit(0)), groups, chunks, k, numbers), "begun")
    # a query with k results so far has a k-th score; its own group gets it
    kth = begun.groupBy("g", F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("score"), F.min("key").alias("key")).where(F.col("n") >= k)
    floors = kth.groupBy("g").agg(F.collect_list(F.struct("row", "score", "key")).alias("known"))
    raised = groups.join(floors, "g", "left").withColumn("floor", F.coalesce("known", F.array().cast(_FLOOR))).drop("known")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(math.ceil(tasks / n_groups), math.ceil(n_chunks / 4)))
    rest = _promising(raised, pages, n_pages, numbers).join(first.select("g", "run"), ["g", "run"], "left_anti")
    rest = written(rest.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(shares))), "promising")
    hits = begun.unionByName(_meetings(rest, raised, chunks, k, numbers))
    best = Window.partitionBy("query_row").orderBy(F.desc("key"), F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
