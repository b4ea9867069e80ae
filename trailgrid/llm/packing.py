"""Sum-of-squares online packing of token sequences.

Every document is cut at multiples of the window length; what is left over, 1 to 2047 ids, is an item. Each item goes,
as it comes, to the fill level at which the sum of the squared numbers of open windows per level grows least: levels
that many windows share are thinned out and windows close full.

Texts are tokenized where they lie, and only numbers leave that step: lengths, checksums, and checksums of runs of
``STEP`` ids of the item. The items of ``GROUP`` documents and more are packed together from these numbers, so open
windows hold no ids, and most windows close by the sum of squares. When a group ends, the windows that are still open are
poured into each other, cutting at multiples of ``STEP`` ids, so that each but one keeps fewer than ``STEP`` ids of
padding.

Defined results: a null or empty text is the end id alone; repeated rows and repeated or null ids are packed row by
row; very long texts give full windows and one item; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bases, lookup, slices, small_batches, written
from .tokens import encoder

WINDOW = 2048
#: Ids between two places where a left-over item may be cut.
STEP = 64
#: Documents that are packed together at least, if there are so many.
GROUP = 100_000


#: A change that no level can bring.
_NEVER = 1 << 60


class SumOfSquares:
    """The open windows of one partition: a level array and, for each level, the windows that stand there."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.taken = np.full(window + 1, _NEVER, np.int64)
        self.put = np.ones(window + 1, np.int64)
        self.taken[0] = self.put[window] = 0
        self.standing: list[list[list]] = [[] for _ in range(window)]

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose choice makes the sum of squares least; the fullest of equals."""
        top = self.window - size
        # taking a window from a level changes the sum by 1 - 2n, putting one to a level by 2n + 1; a full window closes
        # and counts nowhere
        change = self.taken[: top + 1] + self.put[size:]
        return top - int(change[::-1].argmin())

    def _count(self, level: int, more: int) -> None:
        self.count[level] += more
        n = self.count[level]
        self.taken[level] = 1 - 2 * n if n else _NEVER
        self.put[level] = 2 * n + 1

    def place(self, size: int, item) -> list | None:
        """Places an item; returns the window's items if that closed it."""
        level = self.level_for(size)
        items = []
        if level:
            items = self.standing[level].pop()
            self._count(level, -1)
        items.append(item)
        if level + size == self.window:
            return items
        self.standing[level + size].append(items)
        self._count(level + size, 1)
        return None

    def open(self) -> list[list]:
        """The open windows, the emptiest first."""
        return [items for level in self.standing for items in level]


def pour(windows: list[list], window: int = WINDOW, step: int = STEP) -> Iterator[list]:
    """Fills open windows, given from the emptiest on as lists of (item, start, length), from the emptiest ones."""
    left = deque(windows)
    while left:
        items = left.pop()
        level = sum(x[2] for x in items)
        while level < window and left:
            item, start, length = left[0].pop()
            take = length if length <= window - level else (window - level) // step * step
            if take:
                items.append((item, start, take))
                level += take
            if take < length:
                left[0].append((item, start + take, length - take))
                break
            if not left[0]:
                left.popleft()
        yield items


def _zeros(crc: int, n: int) -> int:
    """What ``n`` zero bytes make of a checksum's bits."""
    for _ in range(n):
        crc = _BYTE[crc & 255] ^ crc >> 8
    return crc


#: Checksums of single bytes without the inversions at both ends.
_BYTE = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
_STEP = [_zeros(1 << i, 4 * STEP) for i in range(32)]


def joined(checksums: list[int], last: int) -> int:
    """The checksum of runs of ``STEP`` ids that follow each other, the last one of ``last`` ids."""
    out = checksums[0]
    for k, crc in enumerate(checksums[1:], 2):
        if k < len(checksums) or last == STEP:
            moved = 0
            for i in range(32):
                if out >> i & 1:
                    moved ^= _STEP[i]
        else:
            moved = _zeros(out, 4 * last)
        out = moved ^ crc
    return out


_COLUMNS = ["part", "seq", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
_MEASURED = "doc_id long, total long, windows binary, item long, steps binary"


def _measure(documents: DataFrame, tokenizer: str, end: bytes, window: int) -> DataFrame:
    """Of each document: the number of its ids, checksums of its full windows, of the item and of the item's runs."""
    schema = pa.schema([("doc_id", pa.int64()), ("total", pa.int64()), ("windows", pa.binary()), ("item", pa.int64()), ("steps", pa.binary())])

    def crcs(raw: bytes, ids: int) -> bytes:
        return np.array([zlib.crc32(raw[a : a + 4 * ids]) for a in range(0, len(raw), 4 * ids)], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches):
            rows = []
            for ids in encode([x or "" for x in batch.column(1).to_pylist()]):
                ids += end
                whole = len(ids) - len(ids) % (4 * window)
                item = ids[whole:]
                rows.append((len(ids) // 4, crcs(ids[:whole], window), zlib.crc32(item), crcs(item, STEP)))
            cells = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(cells, list(schema)[1:], strict=True))], schema=schema)

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, _MEASURED)


def _pack_group(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, done = TaskContext.get().partitionId(), SumOfSquares(window), 0
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (len(_COLUMNS) - 1)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([part] * len(columns[0]), *columns)], _COLUMNS)

        def emit(pieces: list) -> None:
            nonlocal done
            at = 0
            for (doc_id, base, total, crc, steps), start, length in pieces:
                if length < total - base:
                    runs = np.frombuffer(steps, "<u4")[start // STEP : -(-(start + length) // STEP)].tolist()
                    crc = joined(runs, length - (len(runs) - 1) * STEP)
                rows.append((done, doc_id, base + start, length, crc, total, at))
                at += length
            done += 1

        for batch in batches:
            for doc_id, total, windows, crc, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = total - total % window
                for k, own in enumerate(np.frombuffer(windows, "<u4").tolist()):
                    rows.append((done, doc_id, k * window, window, own, total, 0))
                    done += 1
                if total > whole:
                    closed = packer.place(total - whole, ((doc_id, whole, total, crc, steps), 0, total - whole))
                    if closed:
                        emit(closed)
                if len(rows) >= 50_000:
                    yield out()
            yield out()
        for pieces in pour(packer.open(), window):
            emit(pieces)
        yield out()

    return run


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Tokenizing keeps the input's partitions; the numbers that it leaves are packed by groups of partitions, without a
    shuffle, and the sequence numbers of the groups are strung together by a prefix sum of one count a group.
    """
    if window % STEP:
        raise ValueError(f"the window is a multiple of {STEP}")
    small_batches(documents.sparkSession)
    measured = written(_measure(documents, tokenizer, np.uint32(end_id).astype("<u4").tobytes(), window), "measured")
    groups = max(1, measured.count() // GROUP)
    pieces = measured.coalesce(groups).mapInArrow(_pack_group(window), ", ".join(f"{x} long" for x in _COLUMNS))
    pieces = written(pieces, "packing")
    counts = pieces.groupBy("part").agg((F.max("seq") + 1).alias("n")).collect()  # one row a group
    before = lookup(documents.sparkSession, bases((r["part"], r["n"]) for r in counts), "part", "before")
    return pieces.join(F.broadcast(before), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("seq")).alias("sequence_id"), "offset"
    )
