"""Audio features over 8-bit samples.

Bytes are kept losslessly as 8-bit mono PCM in WAV form, one media value a row. Features come from the stored bytes:
a polyphase resampler (by 2/5, from 16,000 to 6,400 samples a second), overlapped Hann frames of 25 ms every 10 ms,
log energies of 20 mel bands, and segments by hysteresis on the frame energy: a segment begins above the upper
threshold and ends below the lower one. Features are stored as Arrow record batches, one a document, whose log_mel
column has Arrow's fixed-shape tensor type, 32 frames by 20 bands, beside the time span of each tensor; what the digests
say of features is read back from them.

Defined results: a null or empty text is one unit of 192 spaces; silence has no segment; equal texts have equal media
and features, as each text is computed on its own; very long texts are worked through in runs of frames of bounded
size; repeated rows are repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, written

UNIT = 192
RATE, UP, DOWN = 16_000, 2, 5
FRAME, HOP, FFT, BANDS, PATCH = 160, 64, 256, 20, 32
TAPS = 12
_RUN = 4096
_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM."""
    return _HEAD.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of :func:`to_wav`, after checks of the header."""
    riff, size, wave, fmt, _, kind, channels, rate, _, _, bits, data, n = _HEAD.unpack_from(media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or rate != RATE or size != 36 + n or len(media) != _HEAD.size + n:
        raise ValueError("not an 8-bit mono PCM file as stored here")
    return media[_HEAD.size :]


def _phases() -> np.ndarray:
    """The low-pass filter of the resampler, split into its phases: (UP, TAPS)."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    taps = np.sinc(n / DOWN) * np.hamming(UP * TAPS)
    return (taps / taps.sum() * UP).reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def _mel() -> np.ndarray:
    """Triangular mel bands over the bins of the transform."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), BANDS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    bins = np.fft.rfftfreq(FFT, 1 / rate)
    up, down = (bins[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - bins[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_FILTER, _BANK, _HANN = _phases(), _mel(), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """By UP / DOWN; each phase of the filter meets only the samples that it needs."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for r in range(UP):
        own = out[r::UP]
        own[:] = windows[r * DOWN // UP :: DOWN][: len(own)] @ _FILTER[r * DOWN % UP]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log mel energies and each frame's energy in decibels."""
    y = resample((samples.astype(np.float32) - 128) / 128)
    frames = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros((frames - 1) * HOP + FRAME - len(y), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mel, energy = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, _RUN):
        w = windows[a : a + _RUN]
        power = np.abs(np.fft.rfft(w * _HANN, FFT)) ** 2
        mel[a : a + _RUN] = np.log(power.astype(np.float32) @ _BANK + 1e-6)
        energy[a : a + _RUN] = 10 * np.log10((w * w).mean(axis=1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, over: float = 1.0, under: float = -1.0) -> list[tuple[float, float]]:
    """Spans in seconds: from a frame ``over`` decibels above the median to one ``under`` it."""
    middle = float(np.median(energy))
    state = np.where(energy >= middle + over, 1, np.where(energy < middle + under, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    change = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    rate = RATE * UP / DOWN
    return [(a * HOP / rate, ((b - 1) * HOP + FRAME) / rate) for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)]


def patches(mel: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Tensors of PATCH frames by BANDS, the last one filled up with the quietest value, and their time spans."""
    n, rate = -(-len(mel) // PATCH), RATE * UP / DOWN
    full = np.full((n * PATCH, BANDS), np.float32(np.log(1e-6)))
    full[: len(mel)] = mel
    return full.reshape(n, PATCH, BANDS), [(k * PATCH * HOP / rate, ((min(len(mel), (k + 1) * PATCH) - 1) * HOP + FRAME) / rate) for k in range(n)]


TENSOR = pa.fixed_shape_tensor(pa.float16(), (PATCH, BANDS))
#: Fixed schema of the batches in which features are stored.
FEATURES = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", TENSOR)])


def to_batch(mel: np.ndarray) -> bytes:
    """The tensors of a document with their time spans, as the bytes of an Arrow record batch."""
    tensor, spans = patches(mel)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.astype(np.float16).ravel()), PATCH * BANDS)
    cells = [pa.array([s[i] for s in spans], pa.float64()) for i in (0, 1)] + [pa.ExtensionArray.from_storage(TENSOR, flat)]
    return pa.RecordBatch.from_arrays(cells, schema=FEATURES).serialize().to_pybytes()


def from_batch(raw: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The tensors (n, PATCH, BANDS) and their spans, as :func:`to_batch` wrote them."""
    batch = pa.ipc.read_record_batch(pa.py_buffer(raw), FEATURES)
    return batch.column(2).to_numpy_ndarray(), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))


def store(documents: DataFrame) -> DataFrame:
    """Writes doc_id, n_bytes and media, and reads them back."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                media.append(to_wav(raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(pack, "doc_id long, n_bytes long, media binary"), "media", "zstd")


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<double>, tensors binary"


def tensors(media: DataFrame) -> DataFrame:
    """What the stored media of each document hold, its segments (starts and ends in turn) and its tensors as
    :func:`to_batch` writes them."""
    names = [x.split()[0] for x in _STORED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for wav in batch.column(2).to_pylist():
                payload = from_wav(wav)
                mel, energy = log_mel(np.frombuffer(payload, np.uint8))
                spans = [t for span in segments(energy) for t in span]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), spans, to_batch(mel)))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _STORED)


def describe(spans: list[float], raw: bytes) -> str:
    """A digest of stored features: tensors and the seconds that they span, segments and their seconds, some mean band
    levels, and a hash of the tensors."""
    tensor, times = from_batch(raw)
    level = ",".join(f"{x:.1f}" for x in tensor.reshape(-1, BANDS)[:, :: BANDS // 5].mean(axis=0, dtype=np.float64))
    steps = hashlib.blake2b(tensor.astype("<f2").tobytes(), digest_size=8).hexdigest()
    active = sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True))
    return f"tensors={len(tensor)};seconds={times[-1][1]:.3f};segments={len(spans) // 2};active={active:.2f};mel={level};hash={steps}"


def digests(media: DataFrame) -> DataFrame:
    """What the stored media of each document hold, and its features, both stored and read back."""
    stored = written(tensors(media), "tensors", "zstd")
    kept = [x.split()[0] for x in _STORED.split(", ")][:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = [describe(*x) for x in zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(said, pa.string())], [*kept, "feature"])

    return stored.mapInArrow(run, ", ".join(_STORED.split(", ")[:-2]) + ", feature string")
