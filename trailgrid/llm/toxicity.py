"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystrom landmarks.

The kernel compares two words by the triples of letters that they share in order, each weighted by ``DECAY`` for every
character that it skips, up to ``SPAN`` characters; characters that are no letters are skipped at the same price. So
``i.d-i_o t`` stays near ``idiot``. Landmarks are a bounded number of words, the kernel to them gives each word a
short vector, and a linear machine with squared hinge loss separates words that make a sentence toxic from those that
do not. Labels belong to documents: a clean document is clean throughout, and a toxic document's witness is the word
that the machine finds worst, chosen anew in each round; beside these stand plain insults, words that cover the toxic
documents and have no clean words as near as their own bent forms, and those forms: with any one letter put in anywhere,
with letters doubled or trebled, or dots between all of them. A text scores by its three worst different words, put on
the scale 0 to 1 by a logistic fit on texts kept from training, beside them clean ones with one insult or bent form put
in: one word is enough, or three that are bad alike.

As the machine is linear in the kernel, landmarks and weights are folded into one table over letter triples.

Training reads at most ``PER_LABEL`` documents and ``BYTES_PER_LABEL`` bytes for each label.

Defined results: null and empty texts have no word and get the score of no evidence; with one label or none every
score is 0; a document with several labels is toxic if one says so; very long texts are read whole; repeated rows have
equal scores; an empty table gives an empty result; extra columns are kept by :func:`clean` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, code_points, crc32_id, slices, small_batches, tidy
from .samples import labelled_sample, taught

PER_LABEL = 1500
BYTES_PER_LABEL = 6_000_000
DECAY = 0.9
SPAN = 7
LANDMARKS = 192
#: Words of clean sentences that a training round uses at most, besides the worst ones, and texts that count for one.
CLEAN_WORDS = 40_000
CLEAN_TEXTS = 30
#: Least logarithm of how much oftener a covering word is in toxic texts.
MIN_RATIO = 3.0
#: Texts that a covering word must tell, and covering words after which a text no longer counts.
MIN_TEXTS = 4
COVERS = 8
#: A plain insult is in this share of the toxic texts, and so many times likelier there than words near it in clean ones.
INSULT_SHARE, INSULT_RATIO = 0.05, 8.0
#: Covering words that may be plain insults, letters put into them, and bent forms of all of them together.
INSULTS, ALPHABET, BENT = 64, 40, 6000
#: Words by which a text scores.
WORST = 3
#: Likelihood of a label under which its text takes no part in the scale.
MISLABELLED = 0.05
#: Weight of an insult's bent forms together, as a part of the word's own.
BENDING = 3.0
_CODES = 64
_spelled = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def words(text: str | None) -> list[str]:
    """Lower-cased words between white space; three or more single characters in a row are one word."""
    if not text:
        return []
    return _spelled.sub(lambda m: "".join(m[0].split()), text.lower()).split()


def letter_codes(points: np.ndarray) -> np.ndarray:
    """1 to 26 for a to z, 27 to 62 for other letters, 0 for what is no letter."""
    low = np.array([0 if not chr(c).isalpha() else c - 96 if 97 <= c <= 122 else 27 + c % 36 for c in range(0x250)], np.int64)
    return np.where(points < 0x250, low[np.minimum(points, 0x24F)], 27 + points.astype(np.int64) % 36)


def triples(names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of gaps: the triples' codes, the words that they belong to, and their weight."""
    points, lengths = code_points(names)
    codes = letter_codes(points)
    owner = np.repeat(np.arange(len(names)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    for last in range(2, SPAN):
        m = len(points) - last
        if m <= 0:
            return
        whole = (left[:m] > last) & (codes[:m] > 0) & (codes[last:] > 0)
        for mid in range(1, last):
            at = np.flatnonzero(whole & (codes[mid : mid + m] > 0))
            yield (codes[at] * _CODES + codes[at + mid]) * _CODES + codes[at + last], owner[at], DECAY ** (last - 2)


def project(names: list[str], table: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Sums of a table over the triples of each word, divided by the length of the word's own vector. ``place``: the
    table's row for each triple, if the table holds but some; a table of all triples has one column."""
    out = np.zeros((len(names), table.shape[1]), np.float64)
    for first in range(0, len(names), 4000):
        part = names[first : first + 4000]
        sums, norm = out[first : first + len(part)], np.zeros(len(part))
        for code, owner, weight in triples(part):
            norm += weight**2 * np.bincount(owner, minlength=len(part))
            if place is None:
                sums[:, 0] += weight * np.bincount(owner, table[code, 0], len(part))
            elif len(owner):
                at = place[code]
                known = at > 0
                at, owner = at[known], owner[known]
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                if len(starts):
                    sums[owner[starts]] += weight * np.add.reduceat(table[at], starts, axis=0)
        sums /= np.sqrt(np.maximum(norm, 1e-12))[:, None]
    return out


def vectors(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of landmarks, a column each, over the triples that they have, and each triple's row; row 0 is
    for all others."""
    found = list(triples(names))
    codes = np.unique(np.concatenate([code for code, _, _ in found]))
    place = np.zeros(_CODES**3, np.int32)
    place[codes] = np.arange(1, len(codes) + 1)
    out = np.zeros((len(codes) + 1, len(names)), np.float32)
    for code, owner, weight in found:
        np.add.at(out, (place[code], owner), weight)
    return out / np.maximum(np.linalg.norm(out, axis=0), 1e-12), place


@dataclass
class Model:
    """A table over letter triples, its bias, and the logistic scale."""

    table: np.ndarray
    bias: float
    slope: np.ndarray = field(default_factory=lambda: np.zeros(WORST))
    shift: float = 0.0

    def margins(self, names: list[str]) -> np.ndarray:
        """The machine's value for each word."""
        return (project(names, self.table[:, None])[:, 0] + self.bias).astype(np.float32)

    def score(self, worst: np.ndarray) -> np.ndarray:
        """0 to 1, from the margins of each text's worst words."""
        return 1 / (1 + np.exp(-np.clip(worst @ self.slope + self.shift, -40, 40)))


_ROWS = 4096


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25, start: np.ndarray | None = None) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps over blocks of rows; the last weight is the bias."""
    w = np.zeros(x.shape[1] + 1) if start is None else start
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(len(w))
        for first in range(0, len(x), _ROWS):
            a = np.concatenate([x[first : first + _ROWS], np.ones((len(x[first : first + _ROWS]), 1))], axis=1, dtype=np.float64)
            goal, c = y[first : first + _ROWS], cost[first : first + _ROWS]
            inside = goal * (a @ w) < 1
            a, goal, c = a[inside], goal[inside], c[inside]
            left += (a * c[:, None]).T @ a
            right += a.T @ (c * goal)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _worst(margins: np.ndarray, empty: float) -> np.ndarray:
    """The ``WORST`` greatest margins of a text's different words, greatest first."""
    if len(margins) < WORST:
        margins = np.concatenate([margins, np.full(WORST - len(margins), empty)])
    return -np.sort(np.partition(-margins, WORST - 1)[:WORST])


def _margins(model: Model, distinct: list[str]) -> dict[str, float]:
    return dict(zip(distinct, model.margins(distinct).tolist(), strict=True))


def covering(toxic: list[list[str]], ratio: dict[str, float]) -> list[str]:
    """Words that tell toxic texts, each the best for at least ``MIN_TEXTS`` texts that fewer than ``COVERS`` words before
    it are in. Equal texts count once and a text leaves when it is covered, so its filler is not among them."""
    left = [(set(w), 0) for w in sorted({tuple(w) for w in toxic})]
    out: list[str] = []
    n = Counter(x for w, _ in left for x in w if ratio[x] >= MIN_RATIO)
    while n:
        best = max(n, key=lambda x: (ratio[x] * n[x] ** 0.5, x))
        if n.pop(best) < MIN_TEXTS:
            break
        out.append(best)
        rest = []
        for w, k in left:
            if best in w and k + 1 == COVERS:
                n.subtract(x for x in w if x in n)
            else:
                rest.append((w, k + (best in w)))
        left = rest
    return out


def bent(word: str, alphabet: str) -> list[str]:
    """The word with dots between its letters, with each letter doubled or trebled, and with one letter put in between
    any two."""
    n = len(word)
    more = [".".join(word), *(word[:k] + word[k] * m + word[k:] for k in range(n) for m in (1, 2))]
    return list(dict.fromkeys(more + [word[:k] + c + word[k:] for c in alphabet for k in range(1, n)]))


def insults(cover: list[str], bad: Counter, n_toxic: int, good: Counter, n_fine: int) -> list[str]:
    """The covering words that are frequent enough and have hardly a clean word as near as nine in ten of their own bent
    forms."""
    cover = sorted((x for x in cover if bad[x] >= INSULT_SHARE * n_toxic and len(x) > 2), key=lambda x: (-bad[x], x))[:INSULTS]
    cover = [x for x in cover if sum(map(str.isalpha, x)) >= 3]
    if not cover:
        return []
    basis, place = vectors(cover)
    edge = [np.quantile(project(bent(x, "aeinrst"), basis[:, [j]], place), 0.1) for j, x in enumerate(cover)]
    clean, crowd = sorted(good), np.zeros(len(cover))
    for first in range(0, len(clean), _ROWS):
        names = clean[first : first + _ROWS]
        crowd += np.array([good[x] for x in names]) @ (project(names, basis, place) > edge)
    return [x for x, n in zip(cover, crowd, strict=True) if bad[x] / n_toxic * n_fine >= INSULT_RATIO * (n + 0.5)]


def train(sample: list[tuple[int, str]], rounds: int = 3) -> Model | None:
    """Rounds of choosing witnesses and fitting the machine; the logistic scale comes from every fourth text."""
    pool: dict[str, str] = {}  # each word is held once
    parsed = [(label, sorted({pool.setdefault(x, x) for x in words(text)})) for label, text in sample]
    held = [x for i, x in enumerate(parsed) if i % 4 == 0]
    taught = [x for i, x in enumerate(parsed) if i % 4]
    toxic, fine = [w for label, w in taught if label and w], [w for label, w in taught if not label]
    if not toxic or not fine:
        return None
    bad, good = Counter(x for w in toxic for x in w), Counter(x for w in fine for x in w)
    ratio = {x: np.log((n + 0.5) / (len(toxic) + 1) * (len(fine) + 1) / (good[x] + 0.5)) for x, n in bad.items()}
    ranked = sorted(ratio, key=lambda x: (-ratio[x] * bad[x] ** 0.5, x))
    usual = sorted(good, key=lambda x: (-good[x], x))
    landmarks = list(dict.fromkeys(x for x in (*ranked[: LANDMARKS * 3 // 4], *usual[: LANDMARKS // 4]) if sum(map(str.isalpha, x)) >= 3))
    if not landmarks:
        return None
    basis, place = vectors(landmarks)
    value, vector = np.linalg.eigh((basis.T @ basis).astype(np.float64))
    kept = value > 1e-6 * value.max()
    root = vector[:, kept] / np.sqrt(value[kept])
    clean = sorted(good)
    plain = insults(covering(toxic, ratio), bad, len(toxic), good, len(fine))
    letters = Counter(c for x in clean for c in x if c.isalpha())
    alphabet = "".join(sorted(letters, key=lambda c: (-letters[c], c))[:ALPHABET])
    forms = {}
    for word in plain:
        every = [y for y in bent(word, alphabet) if y not in good]
        forms[word] = every[:: max(1, -(-len(every) * len(plain) // BENT))]
    model = w = None
    at_row: dict[str, int] = {}
    kernels: list[np.ndarray] = []
    hard: list[str] = clean[:: max(1, len(clean) // CLEAN_WORDS)]
    for _ in range(rounds):
        if model is None:
            witness = Counter(max(w, key=lambda x: (ratio[x] * bad[x] ** 0.5, x)) for w in toxic)
        else:
            margin = _margins(model, sorted(bad))
            witness = Counter(max(w, key=lambda x: (margin[x], x)) for w in toxic)
            of_clean = model.margins(clean)
            hard = list(dict.fromkeys(hard + [clean[i] for i in np.argsort(-of_clean, kind="stable")[:3000]]))
        for word in plain:
            witness[word] = max(witness[word], bad[word])
        put_in = Counter({y: BENDING * witness[word] / len(forms[word]) for word in plain for y in forms[word]})
        names = [*witness, *put_in, *hard]
        new = list(dict.fromkeys(x for x in names if x not in at_row))
        for first in range(0, len(new), _ROWS):  # what earlier rounds had stays
            part = new[first : first + _ROWS]
            at_row.update(zip(part, range(len(at_row), len(at_row) + len(part)), strict=True))
            kernels.append((project(part, basis, place) @ root).astype(np.float32))
        x = np.concatenate(kernels)[[at_row[x] for x in names]]
        y = np.array([1.0] * (len(witness) + len(put_in)) + [-1.0] * len(hard))
        cost = np.array([20.0 * n / len(toxic) * 100 for n in (*witness.values(), *put_in.values())] + [float(min(good[x], CLEAN_TEXTS)) for x in hard])
        w = _machine(x, y, cost, start=w)
        model = Model((basis @ (root @ w[:-1]))[place].astype(np.float64), float(w[-1]))
    held = held if {bool(label) for label, _ in held} == {True, False} else parsed
    margin = _margins(model, sorted({x for _, w in held for x in w}))
    at = [_worst(np.array([margin[x] for x in w]), model.bias) for _, w in held]
    label = [bool(y) for y, _ in held]
    # clean texts with one insult or bent form, as many as there are toxic ones
    whole, harmless = [model.margins([x, *forms[x]]) for x in plain], [a for a, y in zip(at, label, strict=True) if not y]
    for i in range(sum(label) if plain else 0):
        own = whole[i % len(whole)]
        at.append(-np.sort(-np.append(harmless[i * 104729 % len(harmless)], own[i * 7919 % len(own)]))[:WORST])
        label.append(True)
    return _scale(model, np.array(at), np.array(label))


def _logistic(z: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by damped Newton steps."""
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w)), z.T @ (p - goal) + 1e-3 * w)
        w = w - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return w


def _scale(model: Model, at: np.ndarray, label: np.ndarray) -> Model:
    """A logistic curve through held-out margins, with smoothed goals, so that separable ones keep it finite. Texts
    whose label a first curve finds less likely than ``MISLABELLED`` do not flatten the next ones, as long as nine in
    ten of their label stay. The curve is over the means of the one, two and three greatest margins, and a mean whose
    weight would be negative is left out, so a worse word never weighs less than a better one."""
    goal = np.where(label, (label.sum() + 1) / (label.sum() + 2), 1 / ((~label).sum() + 2))
    share = np.tril(np.ones((WORST, WORST))) / np.arange(1, WORST + 1)[:, None]
    means = at @ share.T
    used, kept = np.arange(WORST), np.ones(len(at), bool)
    for _ in range(3):
        while True:
            z = np.column_stack([means[:, used], np.ones(len(at))])
            w = _logistic(z[kept], goal[kept])
            if (w[:-1] >= 0).all():
                break
            used = used[w[:-1] >= 0]
        own = 1 / (1 + np.exp(np.clip(np.where(label, -1, 1) * (z @ w), -40, 40)))
        kept = np.ones(len(at), bool)
        for y in (True, False):
            odd = np.flatnonzero((label == y) & (own < MISLABELLED))
            kept[odd[np.argsort(own[odd], kind="stable")[: int((label == y).sum()) // 10]]] = False
    model.slope, model.shift = w[:-1] @ share[used], float(w[-1])
    return model


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from labelled rows with crc32(doc_id) mod 5 other than 0, by a bounded sample of labels whose few
    ids are then looked up among the documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna()
    known = known.where(crc32_id(F.col("doc_id")) % 5 != 0).groupBy("doc_id").agg(F.max(F.when(F.col("label") == 1, 1).otherwise(0)).alias("label"))
    ids = labelled_sample(known.withColumn("text", F.col("doc_id").cast("string")), 2 * PER_LABEL, 1 << 40, seed=3)
    few = documents.sparkSession.createDataFrame([(int(i), int(label)) for label, i in ids], "doc_id long, label int")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    return taught(texts.join(F.broadcast(few), "doc_id"), PER_LABEL, BYTES_PER_LABEL, train)


def _judge(model: Model | None):
    def run(texts: list[str | None], table: list[WordTable]) -> np.ndarray:
        if model is None:
            return np.zeros(len(texts))
        if not table:
            table.append(WordTable(model.margins))
        out = np.full((len(texts), WORST), model.bias)
        for a in range(0, len(texts), 256):
            parsed = [list(set(words(x))) for x in texts[a : a + 256]]
            got = table[0].of([w for x in parsed for w in x])
            at = 0
            for i, w in enumerate(parsed):
                if w:
                    out[a + i] = _worst(got[at : at + len(w)], model.bias)
                    at += len(w)
        return np.round(model.score(out), 6)

    return run


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    small_batches(documents.sparkSession)
    judge = _judge(fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        table: list[WordTable] = []
        for batch in slices(batches):
            found = judge(batch.column(2).to_pylist(), table)
            out = [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc32_id(F.col("doc_id").cast("long")) % 5 == 0, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns; judged in one pass, without a join."""
    small_batches(documents.sparkSession)
    judge = _judge(fit(documents, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        table: list[WordTable] = []
        for batch in slices(batches):
            found = judge(batch.column(batch.schema.get_field_index("text")).to_pylist(), table)
            yield batch.filter(pa.array(found < 0.5))

    return documents.mapInArrow(keep, documents.schema)
