"""What the operators share: tables, tables written to the shared folder, prefix sums, word caches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgrid.storage import delete, fresh, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of the tables that this driver has written and not deleted.
_made: list[str] = []


def written(df: DataFrame, label: str, compression: str = "snappy", files: int | None = None) -> DataFrame:
    """Writes ``df`` to a new Parquet table in the shared folder and reads it: the lineage is cut, and what is
    decided in it stays as it is if an executor is lost. ``files``: at most so many, for tables that are known to be
    small. :func:`drop_written` deletes them all."""
    spark = df.sparkSession
    path = fresh(spark, label)
    _made.append(path)
    (df.coalesce(files) if files else df).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that :func:`written` has made, but for the first ``since`` of them; returns how many are left.
    What still reads them must have been written elsewhere."""
    while len(_made) > since:
        delete(spark, _made.pop())
    return len(_made)


def made() -> int:
    """How many tables there are, for :func:`drop_written`."""
    return len(_made)


def bases(counts: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Exclusive prefix sums of (part, count), one entry for each part (bounded by the number of partitions)."""
    out, at = {}, 0
    for part, n in sorted(counts):
        out[part] = at
        at += n
    return out


def lookup(spark: SparkSession, pairs: dict[int, int], key: str, value: str) -> DataFrame:
    """A small frame of a driver-side map whose size is bounded by the number of partitions, slots or sources."""
    return spark.createDataFrame([(int(k), int(v)) for k, v in pairs.items()] or [(-1, 0)], f"{key} long, {value} long")


def row_hash(rows: DataFrame) -> F.Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*(F.to_json(c) if "map<" in kind else F.col(c) for c, kind in rows.dtypes))


def repeated(rows: DataFrame) -> DataFrame | None:
    """Values of ``hash`` that several rows have; None if there are none."""
    found = written(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeats")
    return None if found.isEmpty() else found


def numbered(rows: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """Adds ``number``, which tells apart rows whose ``hash`` is in ``repeats``, as they are alike: those of a partition
    become one row, the partitions' numbers are strung together, and the rows come back. So however often a row is
    repeated, no task holds more of it than one partition does."""
    if repeats is None:
        return rows.withColumn("number", F.lit(0).cast("long"))
    once = rows.join(repeats, "hash", "left_anti").withColumn("number", F.lit(0).cast("long"))
    many = rows.join(repeats, "hash", "left_semi").withColumn("part", F.spark_partition_id())
    alike = many.groupBy("hash", "part").agg(F.count("*").alias("n"), F.first(F.struct(*rows.columns)).alias("row"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = alike.withColumn("before", before).select("row.*", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("number"))
    return once.unionByName(apart)


def crc32_id(column) -> F.Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(column.cast("string").cast("binary"))


#: Caches that outlive a task in a reused worker; a task of another kind empties them.
CACHES: list[dict] = []


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python 1024 at a time in this session, unless it has a number of its own: batches of whole
    texts are held several times over, in the executor and in its workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own
        spark.conf.set(key, "1024")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows without copying, as what Python makes of a batch's texts is many times their
    size."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def tidy(keep: dict | None = None) -> None:
    """Gives memory of earlier tasks in this worker back to the system: caches but ``keep``, and freed pages."""
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class WordTable:
    """Word -> row number, with rows that ``compute`` fills for the new words of a batch at once.

    The cache is bounded: beyond ``most`` words it starts anew, which changes speed, never results.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], most: int = 150_000):
        self.compute, self.most = compute, most
        self.rows: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.used = 0

    def see(self, words: Iterable[str]) -> None:
        """Makes sure that all of ``words`` have rows; call once for each batch, before :meth:`of`."""
        new = set(words).difference(self.rows)
        if not new:
            return
        if len(self.rows) + len(new) > self.most and self.rows:
            raise OverflowError
        got = self.compute(ordered := list(new))
        if self.values is None:
            self.values = np.zeros((max(1024, 2 * len(ordered)), *got.shape[1:]), got.dtype)
        while self.used + len(ordered) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.used : self.used + len(ordered)] = got
        self.rows.update(zip(ordered, range(self.used, self.used + len(ordered)), strict=True))
        self.used += len(ordered)

    def of(self, words: list[str]) -> np.ndarray:
        """The rows' values for ``words``, in their order."""
        try:
            self.see(words)
        except OverflowError:
            self.rows, self.values, self.used = {}, None, 0
            self.see(words)
        if self.values is None:  # no word yet, and none asked for
            self.see(["a"])
        return self.values[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of ``words`` as one array of code points, and each word's length."""
    text = "".join(words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))
