"""Journal buffers: records of versions 2 and 3, decoded in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed layouts: what stands before the name, by version.
_V2 = struct.Struct("<IHHQQqqIIIIHH")
_V3 = struct.Struct("<IHH16s16sqqIIIIHH")
EVENT = "frn long, parent_frn long, usn long, reason long, file_attributes long, name string"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def decode(buffer: bytes) -> Iterator[tuple[int, int, int, int, int, str]]:
    """frn, parent_frn, usn, reason, file_attributes, name of the records of a buffer; other versions are skipped. Of
    128-bit ids the low 64 bits count."""
    at = 0
    while at + 8 <= len(buffer):
        length, major = struct.unpack_from("<IH", buffer, at)
        if not length or at + length > len(buffer):
            raise ValueError(f"a record of {length} bytes at {at} in a buffer of {len(buffer)}")
        if major in (2, 3):
            layout = _V2 if major == 2 else _V3
            if length < layout.size:
                raise ValueError(f"a record of version {major} at {at} has {length} bytes only")
            _, _, _, frn, parent, usn, _, reason, _, _, attributes, size, start = layout.unpack_from(buffer, at)
            if major == 3:
                frn, parent = (int.from_bytes(x[:8], "little") for x in (frn, parent))
            if start + size > length:
                raise ValueError(f"the name of the record at {at} goes beyond it")
            yield _signed(frn), _signed(parent), usn, reason, attributes, buffer[at + start : at + start + size].decode("utf-16-le")
        at += length


def encode(events: list[tuple], version: int = 2) -> bytes:
    """A buffer of one version that :func:`decode` reads."""
    out = []
    for frn, parent, usn, reason, attributes, name in events:
        raw = name.encode("utf-16-le")
        layout = _V2 if version == 2 else _V3
        length = -(-(layout.size + len(raw)) // 8) * 8
        ids = [x & (1 << 64) - 1 for x in (frn, parent)]
        ids = ids if version == 2 else [x.to_bytes(16, "little") for x in ids]
        head = layout.pack(length, version, 0, *ids, usn, 0, reason, 0, 0, attributes, len(raw), layout.size)
        out.append((head + raw).ljust(length, b"\0"))
    return b"".join(out)


def events(buffers: DataFrame) -> DataFrame:
    """The events of a binary column ``buffer``, a buffer a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()]
        names = [x.split()[0] for x in EVENT.split(", ")]
        for batch in batches:
            for raw in batch.column(0):
                cells = list(zip(*decode(raw.as_py() or b""), strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds, strict=True)], names)

    return buffers.select("buffer").mapInArrow(run, EVENT)
