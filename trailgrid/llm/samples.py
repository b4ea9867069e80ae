"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Labels that are learned, the most frequent ones, and bytes of text of all of them together.
MOST_LABELS = 1000
BYTES = 64_000_000


def labelled_sample(rows: DataFrame, per_label: int, bytes_per_label: int, seed: int = 7) -> list[tuple[object, str]]:
    """(label, text) of about ``per_label`` rows and at most about ``bytes_per_label`` of text for each label, of the
    ``MOST_LABELS`` most frequent labels, and at most about ``BYTES`` of text in all.

    ``rows``: label, doc_id, text, none of them null. A row is in or out by a hash of its id and the rate of its
    label, so the sample is the same in every run and is found without a shuffle of texts.
    """
    taken = _drawn(rows, per_label, bytes_per_label, seed)
    return [] if taken is None else _ordered(taken.collect(), per_label)


def taught(rows: DataFrame, per_label: int, bytes_per_label: int, train: Callable[[list[tuple[object, str]]], object], seed: int = 7) -> object:
    """What ``train`` makes of the labelled sample, in one task of an executor: what it needs on its way is many times the
    sample's size, and the driver gets its result only."""
    taken = _drawn(rows, per_label, bytes_per_label, seed)
    if taken is None:
        return train([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        found = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        made = pickle.dumps(train(_ordered(found, per_label)))
        del found
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["model"])

    got = taken.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else train([])


def _drawn(rows: DataFrame, per_label: int, bytes_per_label: int, seed: int) -> DataFrame | None:
    """label, draw and text of the sample's rows; None if there is no row."""
    size = F.octet_length("text").cast("long")
    found = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()
    if not found:
        return None
    most = min(bytes_per_label, BYTES / len(found))
    rate = [(r["label"], float(min(1.0, per_label / r["n"], most / max(1, r["bytes"])))) for r in found]
    rates = rows.sparkSession.createDataFrame(rate, f"label {rows.schema['label'].dataType.simpleString()}, rate double")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / float(1 << 53)
    return rows.join(F.broadcast(rates), "label").withColumn("draw", draw).where("draw < rate").select("label", "draw", "text")


def _ordered(taken: Iterable[tuple], per_label: int) -> list[tuple[object, str]]:
    out: dict[object, list] = {}
    for label, draw, text in taken:
        out.setdefault(label, []).append((draw, text))
    return [(label, text) for label in sorted(out) for _, text in sorted(out[label])[: 2 * per_label]]
