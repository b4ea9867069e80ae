"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its 2 to 4 character n-grams with its two ends marked, hashed to buckets. A text is the average
of the embeddings of all its subwords; a linear softmax over that average gives the language. Embeddings and softmax
are trained together by stochastic gradient descent in numpy on a bounded sample: ``PER_LABEL`` rows and
``BYTES_PER_LABEL`` bytes of text for each language. Since the softmax is linear, each bucket's embedding is folded
into its logits after training, and each distinct word's sum of logits is found once.

A part of the sample is kept from training: a temperature is fitted to its texts and to their first 1, 2, 4 and 8
words, and the rejection threshold is the score below which at most ``REJECT_RATE`` of them falls.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; with no labelled row
every text is ``und``; very long texts are read whole; repeated rows have equal results; an empty table gives an empty
result; extra columns are kept by :func:`accepted` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, code_points, crc32_id, slices, small_batches, tidy
from .samples import taught

PER_LABEL = 1200
BYTES_PER_LABEL = 5_000_000
REJECT_RATE = 0.0005
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
_words = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters; empty if there is no letter."""
    found = _words(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) else []


def subwords(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of ``names`` and the word that each belongs to, in the order of the words."""
    points, lengths = code_points([f"<{x}>" for x in names])
    owner = np.repeat(np.arange(len(names)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters up to the word's end
    buckets, owners = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        following = np.zeros(len(points), np.uint64)
        following[: max(0, len(points) - n + 1)] = points[n - 1 :]
        rolling = rolling * np.uint64(0x100000001B3) + following + np.uint64(n)
        if n in GRAMS:
            mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            inside = left >= n
            buckets.append((mixed >> np.uint64(49)).astype(np.int64)[inside])
            owners.append(owner[inside])
    bucket, word = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(word, kind="stable")
    return bucket[order], word[order]


@dataclass
class Model:
    """labels, logits of each bucket, temperature, and the score below which a text is rejected."""

    labels: list[str]
    logits: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def word_rows(self, names: list[str]) -> np.ndarray:
        """For each word the sum of its subwords' logits, and their number."""
        bucket, word = subwords(names)
        sums = np.zeros((len(bucket) + 1, len(self.labels)))
        np.cumsum(self.logits[bucket], axis=0, out=sums[1:])
        ends = np.searchsorted(word, np.arange(len(names) + 1))
        return np.concatenate([sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)[:, None]], axis=1).astype(np.float32)

    def scores(self, means: np.ndarray) -> np.ndarray:
        """Probabilities of averaged logits."""
        z = means / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _averages(model: Model, table: WordTable, texts: list[list[str]]) -> np.ndarray:
    got = table.of([w for x in texts for w in x])
    sums = np.zeros((len(got) + 1, len(model.labels) + 1))
    np.cumsum(got, axis=0, out=sums[1:])
    ends = np.cumsum([0, *map(len, texts)])
    total = sums[ends[1:]] - sums[ends[:-1]]
    return total[:, :-1] / np.maximum(total[:, -1:], 1)


def train(sample: list[tuple[str, str]], dim: int = 12, epochs: int = 4, batch: int = 64, examples: int = 14_000, seed: int = 11) -> Model | None:
    """Stochastic gradient descent over windows of the sampled texts; calibration on every fifth text."""
    rng = np.random.default_rng(seed)
    pool: dict[str, str] = {}  # each word is held once
    parsed = [(label, [pool.setdefault(x, x) for x in w]) for label, text in sample if (w := words(text))]
    labels = sorted({label for label, _ in parsed})
    if not labels:
        return None
    number = {label: i for i, label in enumerate(labels)}
    taught = [x for i, x in enumerate(parsed) if i % 5] or parsed
    held = [x for i, x in enumerate(parsed) if i % 5 == 0]
    held += [(label, w[:n]) for label, w in held for n in (1, 2, 4, 8)]
    windows = []
    for i in rng.integers(0, len(taught), examples):
        label, w = taught[i]
        n = int(rng.integers(1, 31))
        at = int(rng.integers(0, max(1, len(w) - n + 1)))
        windows.append((number[label], w[at : at + n]))
    distinct = sorted({x for _, w in windows for x in w})
    at = {x: i for i, x in enumerate(distinct)}
    bucket, word = subwords(distinct)
    ends = np.searchsorted(word, np.arange(len(distinct) + 1))
    pieces = [np.concatenate([bucket[ends[at[x]] : ends[at[x] + 1]] for x in w]) for _, w in windows]
    y = np.array([k for k, _ in windows])
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft = np.zeros((dim, len(labels)), np.float32)
    soft += rng.normal(0, 0.1, soft.shape)
    steps, done = max(1, epochs * examples // batch), 0
    for _ in range(epochs):
        order = rng.permutation(examples)
        for a in range(0, examples - batch + 1, batch):
            rows = order[a : a + batch]
            sizes = np.array([len(pieces[i]) for i in rows])
            index = np.concatenate([pieces[i] for i in rows])
            mean = np.add.reduceat(embed[index], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            z = mean @ soft
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(batch), y[rows]] -= 1
            rate = 0.6 * (1 - done / steps)
            back = (z @ soft.T) / sizes[:, None]
            soft -= rate / batch * (mean.T @ z)
            np.add.at(embed, index, np.repeat((-rate * back).astype(np.float32), sizes, axis=0))
            done += 1
    model = Model(labels, (embed @ soft).astype(np.float32))
    return calibrate(model, held, number)


def calibrate(model: Model, held: list[tuple[str, list[str]]], number: dict[str, int]) -> Model:
    """Temperature by least log loss; threshold by the rate of held texts below it."""
    if not held:
        return model
    means = _averages(model, WordTable(model.word_rows), [w for _, w in held])
    y = np.array([number[label] for label, _ in held])
    losses = []
    for t in (grid := np.geomspace(0.02, 10, 80)):
        model.temperature = float(t)
        losses.append(-np.log(np.maximum(model.scores(means)[np.arange(len(y)), y], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    best = np.sort(model.scores(means).max(axis=1))
    model.threshold = float(best[int(REJECT_RATE * len(best))]) * (1 - 1e-6)
    return model


def fit(documents: DataFrame) -> Model | None:
    """Learns from rows with a language and crc32(doc_id) mod 3 other than 1, by a bounded sample."""
    rows = documents.select(F.col("lang").cast("string").alias("label"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (crc32_id(F.col("doc_id")) % 3 != 1))
    return taught(rows, PER_LABEL, BYTES_PER_LABEL, train)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        table = WordTable(model.word_rows) if model else None
        for batch in batches:
            parsed = [words(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            p = model.scores(_averages(model, table, parsed)) if model and parsed else np.zeros((len(parsed), 1))
            best = p.argmax(axis=1)
            known = [bool(w) and model is not None for w in parsed]
            top = np.round(p[np.arange(len(best)), best], 6)
            label = [model.labels[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)]
            reject = [not k or s < model.threshold for s, k in zip(top, known, strict=True)]
            out = [*batch.columns[:-1], pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document."""
    small_batches(documents.sparkSession)
    held = F.coalesce(crc32_id(F.col("doc_id").cast("long")) % 3 == 1, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    run = _predict(fit(documents))
    return rows.mapInArrow(lambda batches: run(slices(batches)), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns; scored in one pass, without a join."""
    small_batches(documents.sparkSession)
    run = _predict(fit(documents))
    schema = documents.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                own.append(batch)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"])

        for judged in run(texts()):  # a batch for each batch, with one word table for the task
            yield own.pop().filter(pa.array([not x for x in judged.column(2).to_pylist()], pa.bool_()))

    return documents.mapInArrow(keep, schema)
