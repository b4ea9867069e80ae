"""Merkle fixity audit of WARC archives.

An archive is a sequence of records in the order of page_id, cut into files of about ``FILE`` bytes. Its index holds each
record's file, offset in the file, length and hash. The hashes of all records that begin in the same range of ``RANGE``
bytes of a file are hashed together with their offsets in order, and ``FANOUT`` nodes at a time form the next level, up to one root. A
replica is read from its bytes: what a record is stands in its own header, where it lies follows from the lengths before
it, so a lost or added record moves those behind it in its file. Two replicas are compared from the root down: only the
children of nodes that differ are joined, so an intact replica costs one comparison and a damaged record one path.

Defined results: null urls and bodies are empty; records stand in the order of page_id, null first, then of their
hash, so repeated rows stand side by side and are told apart by their order; very long pages are one record that begins
one range; a record whose header cannot be read has no page_id; an empty table has an empty tree; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bases, lookup, written

FILE = 1 << 26
RANGE = 1 << 16
FANOUT = 16
#: Ranges that a file may have; more than FILE / RANGE, as the last record and added ones go beyond.
RANGES = 1 << 16


def warc_record(page_id: F.Column, url: F.Column, body: F.Column) -> F.Column:
    """One resource record as bytes."""
    page = F.coalesce(body.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, page, F.lit("\r\n\r\n")).cast("binary")


def records(pages: DataFrame) -> DataFrame:
    """page_id and record of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def page_of(record: F.Column) -> F.Column:
    """The page_id that a record's header names; null if it names none."""
    head = F.decode(F.substring(record, 1, 512), "iso-8859-1")
    return F.nullif(F.regexp_extract(head, r"\r\nWARC-Record-ID: <urn:page:(-?[0-9]{1,19})>\r\n", 1), F.lit("")).try_cast("long")


def _strung(rows: DataFrame, order: list[str], value: str, label: str) -> DataFrame:
    """Adds ``before``, the sum of ``value`` of all rows before a row. Running sums within ordered partitions are joined
    by one sum a partition."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id().cast("long")), label)
    sums = kept.groupBy("part").agg(F.sum(value).alias("n")).collect()
    parts = lookup(spark, bases((r["part"], r["n"]) for r in sums), "part", "first")
    running = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kept.withColumn("running", running).join(F.broadcast(parts), "part").withColumn("before", F.col("first") + F.col("running") - F.col(value)).drop("part", "running", "first")


def indexed(archive: DataFrame, size: int = FILE) -> DataFrame:
    """The archive's index: page_id, file, offset, n_bytes, sha256. Only these numbers are shuffled."""
    narrow = archive.select("page_id", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("sha256"))
    placed = written(_strung(narrow, ["page_id", "sha256"], "n_bytes", "hashes").withColumn("file", F.floor(F.col("before") / size)), "placed")
    starts = placed.groupBy("file").agg(F.min("before").alias("start"))
    return written(placed.join(starts, "file").select("page_id", "file", (F.col("before") - F.col("start")).alias("offset"), "n_bytes", "sha256"), "index")


def read(replica: DataFrame) -> DataFrame:
    """What a replica holds, in the columns of :func:`indexed`. ``replica``: file, place (the order in it) and record."""
    narrow = replica.select("file", "place", page_of(F.col("record")).alias("page_id"), F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("sha256"))
    strung = written(_strung(narrow, ["file", "place"], "n_bytes", "read"), "strung")
    starts = strung.groupBy("file").agg(F.min("before").alias("start"))
    return written(strung.join(starts, "file").select("page_id", "file", (F.col("before") - F.col("start")).alias("offset"), "n_bytes", "sha256"), "found")


def _node(span: int) -> F.Column:
    return F.col("file") * RANGES + F.floor(F.col("offset") / span)


def tree(hashes: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels from the ranges up to the root: node, hash."""

    def join(rows: DataFrame, parent: F.Column, order: str, value: str) -> DataFrame:
        # a node has at most the records of one range, or `fanout` children
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("value"))))
        joined = F.array_join(F.transform(ordered, lambda x: x["value"]), "")
        return rows.groupBy(parent.alias("node")).agg(F.sha2(joined.cast("binary"), 256).alias("hash"))

    # a record that lies elsewhere counts as another one
    placed = hashes.withColumn("placed", F.concat_ws(":", "offset", "sha256"))
    levels = [written(join(placed, _node(span), "offset", "placed"), "level")]
    while levels[-1].agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] > 0:
        levels.append(written(join(levels[-1], F.floor(F.col("node") / fanout), "node", "hash"), "level"))
    return levels


def mismatching_ranges(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Numbers of the ranges that differ. The roots are compared first; below them only children of nodes that differ
    are compared. Levels that only the deeper tree has are its first child all the way down for the other one."""
    depth = max(len(left), len(right))
    bad = None
    for k in reversed(range(depth)):
        a, b = (levels[k] if k < len(levels) else None for levels in (left, right))
        if a is None or b is None:  # only one tree goes so high: its nodes differ from nothing
            both = (a if b is None else b).select("node")
            bad = written(both if bad is None else both.withColumn("up", F.floor(F.col("node") / fanout)).join(_up(bad), "up", "left_semi").select("node"), "differ")
            continue
        if bad is not None:
            a, b = (x.withColumn("up", F.floor(F.col("node") / fanout)).join(_up(bad), "up", "left_semi") for x in (a, b))
        both = a.select("node", F.col("hash").alias("a")).join(b.select("node", F.col("hash").alias("b")), "node", "full_outer")
        bad = written(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "differ")
        if k and bad.isEmpty():
            return bad
    return bad


def _up(bad: DataFrame) -> DataFrame:
    return bad.withColumnRenamed("node", "up")


def audit(expected: DataFrame, found: DataFrame, span: int = RANGE) -> DataFrame:
    """Every record of the index with its status, and records that only the replica has.

    ``expected``, ``found``: results of :func:`indexed` and :func:`read`. Columns: page_id, file, offset, n_bytes, sha256,
    found_offset, status: ``ok``; ``moved`` (the same bytes elsewhere in the file); ``corrupt`` (a record of the page with
    other bytes); ``missing``; or ``extra``. Records of ranges that agree are ok without being looked at."""
    bad = mismatching_ranges(tree(expected, span), tree(found, span))
    mine, other = expected.withColumn("node", _node(span)), found.withColumn("node", _node(span))
    intact = mine.join(bad, "node", "left_anti").withColumn("found_offset", F.col("offset")).withColumn("status", F.lit("ok"))

    def numbered(rows: DataFrame, *by: str) -> DataFrame:
        """Records that are alike in ``by``, told apart by their order in the file."""
        return rows.withColumn("copy", F.row_number().over(Window.partitionBy("file", *by).orderBy("offset")))

    def met(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        right = right.select(*(F.col(c).alias(f"_{c}") for c in right.columns))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("file", *by, "copy")]
        return left.join(right, same, "full_outer")

    names = ("page_id", "file", "offset", "n_bytes", "sha256")
    suspect, there = (numbered(rows.join(bad, "node", "left_semi").select(*names), "page_id", "sha256") for rows in (mine, other))
    first = written(met(suspect, there, "page_id", "sha256"), "matched")
    here = first.where("copy is not null and _copy is not null")
    same = here.select(*names, F.col("_offset").alias("found_offset"), F.when(F.col("offset") == F.col("_offset"), "ok").otherwise("moved").alias("status"))
    rest = numbered(first.where("_copy is null").select(*names), "page_id")
    more = numbered(first.where("copy is null").select(*(F.col(f"_{c}").alias(c) for c in names)), "page_id")
    second = met(rest, more, "page_id")
    status = F.when(F.col("_copy").isNull(), "missing").when(F.col("copy").isNull(), "extra").otherwise("corrupt")
    lone = second.select(*(F.when(F.col("copy").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names), F.col("_offset").alias("found_offset"), status.alias("status"))
    out = (*names, "found_offset", "status")
    return intact.select(*out).unionByName(same.select(*out)).unionByName(lone.select(*out))
