"""Near-duplicate detection by order MinHash, verified by banded alignment.

A text is its sequence of words (lower-cased runs of letters and digits) and of word 5-grams; a text of fewer than five
words is one shingle. Each occurrence of a shingle carries its number in the text. A sketch takes, for each of ``BANDS``
hash functions, the two occurrence-labelled shingles with the smallest hashes and keeps them in text order, so two
texts share a band only if they have both in the same order. Texts that share a band are candidates, and candidates are
linked if a banded alignment of the two shingle sequences finds a longest common subsequence of l shingles with
l / (m + n - l) >= 0.8, or one of the two word sequences matches at least 0.88 of the longer one's words in order. The
first finds copies with a part cut, appended or put in, the second copies whose edits are spread out.

Equal texts are one text from the start. First a band's texts meet its leader, the text that is in most shared bands;
what links join is a class. In a band that then has several classes, every text outside its largest class meets every
text of another class. A meeting costs an alignment only where it can link: the numbers of words in ranges of the word
hash, 256 of them and up to 4096 for longer texts, bound from above how many words two texts can have in common, so a
pair that fails the bound cannot be linked. Alignments are made in two rounds: in the first a text is aligned with the
eight that it may have most in common with, and what that links is one class; in the second with all that are still of
another class. So in a large group of copies of copies a text is aligned with a few and not with each other one; pairs
of different classes that the bound does not exclude are all aligned. Of every two texts that share a band either a test
has been made or they are of one class already; no text is left out, whatever the size of a band. Meetings are held by
blocks of a band's texts, so a band of any size is many tasks; those of a band of k texts that are no copies cost k * k
comparisons of 256 bytes. Classes are the connected
components of the links, found by hooking and pointer jumping over tables in the shared folder.

Defined results: null and empty texts are copies of nothing; equal texts are always of one class, texts without a word
(punctuation, emoji) are copies of equal ones only;
the class is named by its smallest doc_id, null ids counting as largest; very long texts are read whole; repeated rows
are of one class, and of rows alike in id and text the least by its other columns stays; an empty table gives an empty
result; extra columns are kept by :func:`deduplicated` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, slices, small_batches, tidy, written

SHINGLE = 5
#: The least share of words and of shingles in order, either of which links two texts.
SIMILARITY, SHINGLED = 0.88, 0.8
BANDS = 24
#: Ranges of the word hash whose numbers of words bound what two texts have in common: the fewest, and the most for longer
#: texts.
RANGES, FINEST = 256, 4096
#: Texts of a band that meet as many others in one place.
BLOCK = 512
#: Alignments that a text asks for in each round; None: all that are left.
ROUNDS = (8, None)
_words = re.compile(r"\w+").findall
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_CHUNK = 16384


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(names: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names], np.uint64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of the whole, if there are fewer."""
    n = min(SHINGLE, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * _POWERS[i]
    return _mix(out)


def occurrences(x: np.ndarray) -> np.ndarray:
    """Each hash with the number of its occurrence in the text mixed in, in text order."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if len(first) == len(x):
        return x
    number = np.empty(len(x), np.uint64)
    number[order] = np.arange(len(x)) - np.repeat(first, np.diff(first, append=len(x)))
    return np.where(number > 0, _mix(x + number * np.uint64(0xD6E8FEB86659FD93)), x)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a text's word hashes."""
    x = occurrences(shingles(hashes))
    places = [[], []]
    for a in range(0, len(x), _CHUNK):  # the two smallest of each run of bounded size
        v = _A[:, None] * x[None, a : a + _CHUNK]
        one = v.argmin(axis=1)
        v[np.arange(len(_A)), one] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places[0].append(one + a)
        places[1].append(v.argmin(axis=1) + a)
    if len(places[0]) > 1:
        at = np.concatenate([np.stack(p, axis=1) for p in places], axis=1)
        order = np.argsort(_A[:, None] * x[at], axis=1, kind="stable")
        one, two = np.take_along_axis(at, order[:, :1], 1)[:, 0], np.take_along_axis(at, order[:, 1:2], 1)[:, 0]
    else:
        one, two = places[0][0], places[1][0]
    low, high = np.minimum(one, two), np.maximum(one, two)
    sketch = _mix(x[low] * np.uint64(0x9FB21C651E98DF25) + _mix(x[high] + np.uint64(1)))
    return _mix(sketch * np.uint64(3) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def ranges(hashes: np.ndarray, n: int = RANGES) -> bytes:
    """Numbers of words by range of their hash, each up to 255; ``n``, a power of two: how many ranges."""
    return np.minimum(np.bincount((hashes >> np.uint64(65 - n.bit_length())).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def fineness(words: int) -> int:
    """How many ranges a text of so many words has."""
    return min(max(RANGES, 1 << (words - 1).bit_length()), FINEST)


def folded(numbers: bytes, n: int = RANGES) -> np.ndarray:
    """The numbers of words in ``n`` ranges, of at least as many. Numbers that stopped at 255 differ by less than the
    words do, so what they bound holds."""
    return np.frombuffer(numbers, np.uint8).reshape(n, -1).sum(axis=1, dtype=np.int16)


def possible(m: np.ndarray, x: np.ndarray, n: int | np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether texts of ``m`` words with the numbers ``x`` (one row a text) can be linked to ones of ``n`` words with the
    numbers ``y``. What differs in the numbers is not in common, and two texts that match l shingles in order match l + 4
    words at least, if they have whole shingles."""
    shared = (m + n - np.abs(x - y).sum(axis=1)) // 2
    least = SHINGLED / (1 + SHINGLED) * (np.maximum(m - SHINGLE + 1, 1) + np.maximum(n - SHINGLE + 1, 1)) - 1e-6
    beside = np.where(np.minimum(m, n) >= SHINGLE, SHINGLE - 1, 0)
    return (shared >= SIMILARITY * np.maximum(m, n) - 1e-6) | (shared - beside >= least)


def common(a: list, b: list, width: int) -> int:
    """Length of the longest common subsequence along the diagonals -width .. width, one machine word at a time."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    size = 2 * width + 1
    full = (1 << size) - 1
    row, low, found = full, -width, 0  # bit k stands for column low + k of b; 0 where the subsequence grows
    for x in a:
        hits = where.get(x, 0)
        hits = (hits >> low if low >= 0 else hits << -low) & full
        hit = row & hits
        row = ((row + hit) | (row & ~hits)) & full
        found += 1 - (row & 1)
        row = row >> 1 | 1 << (size - 1)
        low += 1
    return found + size - row.bit_count()


def in_order(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Elements that match in order along the diagonals -width .. width; ``a`` is no shorter than ``b``."""
    m, n = len(a), len(b)
    same = a[:n] == b
    head = n if same.all() else int(same.argmin())
    back = a[m - n + head :][::-1] == b[head:][::-1]
    tail = len(back) if back.all() else int(back.argmin())
    x, y = a[head : m - tail].tolist(), b[head : n - tail].tolist()
    return head + tail + (common(x, y, min(width, max(len(x), len(y)))) if x and y else 0)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Words matched in order over the longer text's words, by banded alignment; 0 if certainly below ``least``."""
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    return in_order(a, b, int(m * (1 - least)) + 1) / m if n >= least * m else 0.0


def overlap(a: np.ndarray, b: np.ndarray, least: float = SHINGLED) -> float:
    """l / (m + n - l) of two shingle sequences by banded alignment; 0 if certainly below ``least``."""
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n < least * m:
        return 0.0
    got = in_order(a, b, int((m + n) * (1 - least) / (1 + least)) + 1)
    return got / (m + n - got)


class Sequence:
    """A text's words and shingles, and both as sorted bags, whose intersections bound what can match in order."""

    def __init__(self, words: np.ndarray):
        self.words, self.shingles = words, shingles(words)
        self.bag, self.shingle_bag = np.sort(occurrences(self.words)), np.sort(occurrences(self.shingles))


def _both(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def near(x: Sequence, y: Sequence) -> bool:
    """Whether two texts are linked: by their words or by their shingles."""
    if _both(x.bag, y.bag) >= SIMILARITY * max(len(x.words), len(y.words)) and similarity(x.words, y.words) >= SIMILARITY:
        return True
    m, n, most = len(x.shingles), len(y.shingles), _both(x.shingle_bag, y.shingle_bag)
    return most >= SHINGLED * (m + n - most) and overlap(x.shingles, y.shingles) >= SHINGLED


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    table = WordTable(word_hashes)
    for batch in slices(batches):
        texts, prints, keys, sizes, numbers, at = batch.column(1).to_pylist(), [], [], [], [], 0
        # a text that Spark finds to have a letter or digit is never without a word here, whatever the Unicode versions
        parsed = [(_words(x.lower()) or [x]) if has else [] for x, has in zip(texts, batch.column(2).to_pylist(), strict=True)]
        got = table.of([w for x in parsed for w in x])
        for text, w in zip(texts, parsed, strict=True):
            own, at = got[at : at + len(w)], at + len(w)
            prints.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest() if text else None)
            sizes.append(len(w))
            keys.append(bands(own).tolist() if w else None)
            numbers.append(ranges(own, fineness(len(w))) if w else None)
        cells = [pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cells], ["doc_id", "fp", "bands", "words", "ranges"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    kept: dict[str, Sequence] = {}

    def sequence(text: str) -> Sequence:
        if text not in kept:
            if len(kept) > 64:
                kept.clear()
            kept[text] = Sequence(word_hashes(_words(text.lower()) or [text]))
        return kept[text]

    for batch in slices(batches):
        linked = [near(sequence(x.as_py()), sequence(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["leader", "fp", "near"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (leader, fp) that can be linked, of rows leader, fp, and the words and ranges of both."""
    for batch in batches:
        m, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[2:4])
        x, y = (np.array([folded(v) for v in c.to_pylist()], np.int16).reshape(-1, RANGES) for c in batch.columns[4:6])
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(possible(m, x, n, y))) for c in batch.columns[:2]], ["leader", "fp"])


_PLACED = ("key", "a", "b", "asks", "fp", "root", "words", "keys", "ranges")


def _meetings(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs that can be linked, of rows in the order of the place (key, a, b) where texts meet. Those that ask meet
    those that do not, if they are of another class and have not met in an earlier band. ``most``: of each text that asks,
    so many pairs of a place, those that may have most in common, with the text that asks and that share."""
    kinds = (np.int64, np.int64, np.int64, bool, object, object, np.int64, object, object)
    held: list[np.ndarray] | None = None
    for batch in batches:
        own = [np.array(c.to_pylist(), k) for c, k in zip(batch.columns, kinds, strict=True)]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        place = np.stack(held[:3])
        ends = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1  # the last place may go on in the next batch
        yield from _meet(held, ends, most)
        if len(ends):
            held = [x[ends[-1] :] for x in held]
    if held is not None and len(held[0]):
        yield from _meet(held, np.array([len(held[0])]), most)


def _share(m: int, x: bytes, n: int, y: bytes) -> float | None:
    """The largest share of the longer text's words that two texts can have in common, by the finest ranges that both
    have; None if they cannot be linked."""
    fine = min(len(x), len(y))
    one, other = folded(x, fine), folded(y, fine)
    if fine > RANGES and not possible(np.array([m]), one[None, :], n, other)[0]:
        return None
    return (m + n - float(np.abs(one - other).sum())) / (2 * max(m, n))


def _meet(rows: list[np.ndarray], ends: np.ndarray, most: int | None) -> Iterator[pa.RecordBatch]:
    key, _, _, asks, fp, root, words, keys, numbers = rows
    out = []
    for first, last in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(ends) else ():
        asking, met = (np.flatnonzero(asks[first:last] == v) + first for v in (True, False))
        if not len(met):
            continue
        outside = {fp[i] for i in asking}  # two that both ask meet once
        number: dict[bytes, int] = {}  # arrays of bytes would not tell zeros at the end
        of = np.array([number.setdefault(x, len(number)) for x in root[first:last]])
        x = np.stack([folded(v) for v in numbers[met]])
        for i in asking.tolist():
            apart = of[met - first] != of[i - first]
            fits = met[apart][possible(words[met][apart], x[apart], words[i], folded(numbers[i]))]
            found = []
            for j in fits.tolist():
                if fp[j] in outside and fp[j] < fp[i]:
                    continue
                own = np.frombuffer(keys[i], ">i8")
                if own[(own == np.frombuffer(keys[j], ">i8")).argmax()] != key[first]:  # not the first band that they share
                    continue
                if (share := _share(int(words[i]), numbers[i], int(words[j]), numbers[j])) is not None:
                    found.append((share, fp[j]))
            out += [(max(fp[i], y), min(fp[i], y), fp[i], share) for share, y in (heapq.nlargest(most, found) if most else found)]
    if out:
        cells = [pa.array(c, pa.float64() if k == 3 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))]
        yield pa.RecordBatch.from_arrays(cells, ["leader", "fp", "asker", "share"]).select(range(4 if most else 2))


def _pairs(asking: DataFrame, met: DataFrame, most: int | None, tested: DataFrame) -> DataFrame:
    """Pairs (leader, fp) of what asks and what is met in the same band, each pair once, without those in ``tested``;
    ``most``: so many of each text that asks. Both have n_asking and n_met, the numbers of either in the band. Each side
    is cut into blocks, and every block of one side meets every block of the other."""
    blocks_a, blocks_b = F.ceil(F.col("n_asking") / BLOCK), F.ceil(F.col("n_met") / BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    of = lambda n: F.pmod(F.xxhash64("fp"), n.cast("long"))
    columns = _PLACED[4:]
    left = asking.select("key", of(blocks_a).alias("a"), every(blocks_b).alias("b"), F.lit(True).alias("asks"), *columns)
    right = met.select("key", every(blocks_a).alias("a"), of(blocks_b).alias("b"), F.lit(False).alias("asks"), *columns)
    placed = left.unionByName(right).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    kinds = "leader binary, fp binary" + (", asker binary, share double" if most else "")
    found = placed.select(*_PLACED).mapInArrow(lambda batches: _meetings(batches, most), kinds).join(tested, ["leader", "fp"], "left_anti")
    if most:
        order = Window.partitionBy("asker").orderBy(F.desc("share"), "leader", "fp")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return found.select("leader", "fp").distinct()  # texts of several blocks that both ask


def _links(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (leader, fp) between different texts; ``texts``: fp, bands, words, ranges, id."""
    members = texts.select("fp", F.explode("bands").alias("key"))
    shared = written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    # what grows with the corpus is merged at every size, never broadcast
    keys = members.join(shared.hint("merge"), "key").groupBy("fp").agg(F.collect_list("key").alias("keys"))  # up to BANDS of each text
    seen = written(keys.join(texts, "fp"), "seen")
    no_id = F.col("id").isNull().alias("no_id")
    place = (F.col("fp"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), no_id)
    own = docs.where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("fp"), F.col("doc_id").alias("id"), "text").select(*place, "text")
    ids = seen.select(*place)

    def judged(pairs: DataFrame, join: str | None = None) -> DataFrame:
        """The pairs with what alignment says; only texts that are in a pair go to it. ``join``: how to find them among
        all documents, if not as Spark sees fit by their number."""
        needed = written(ids.join(pairs.select("fp").union(pairs.select("leader")).distinct(), "fp"), "needed")
        bodies = own.join(needed.hint(join) if join else needed, ["fp", "id", "no_id"]).groupBy("fp", "id", "no_id").agg(F.first("text").alias("text"))  # rows repeated with the same id
        bodies = written(bodies.select("fp", "text"), "bodies")
        heads = bodies.select(F.col("fp").alias("leader"), F.col("text").alias("head"))
        both = pairs.join(bodies.withColumnRenamed("text", "body"), "fp").join(heads, "leader")
        return written(both.select("leader", "fp", "head", "body").mapInArrow(_verify, "leader binary, fp binary, near boolean"), "judged")

    # the leader of a band is its text that is in most shared bands
    placed = seen.select("fp", F.size("keys").alias("degree"), F.explode("keys").alias("key"))
    leaders = written(placed.groupBy("key").agg(F.max(F.struct("degree", "fp")).alias("first")).select("key", F.col("first.fp").alias("leader")), "leaders")
    led = placed.join(leaders.hint("merge"), "key").where("fp <> leader").select("leader", "fp").distinct()
    led = led.join(seen.select("fp", "words", "ranges"), "fp").join(seen.select(F.col("fp").alias("leader"), F.col("words").alias("m"), F.col("ranges").alias("x")), "leader")
    led = led.select("leader", "fp", F.col("m"), "words", "x", "ranges").mapInArrow(_bounded, "leader binary, fp binary")
    tested = judged(written(led, "led"), "merge")
    links = tested.where("near").select("leader", "fp")
    # then, in the bands that are not of one class yet, all but the largest class meet all others
    roots = written(seen.join(components(links), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.col("keys").alias("shared")), "rooted")
    cards = seen.select("fp", "words", F.unhex(F.array_join(F.transform("bands", lambda k: F.lpad(F.hex(k), 16, "0")), "")).alias("keys"), "ranges")
    for most in ROUNDS:
        now = roots.select("fp", "root", F.explode("shared").alias("key"))
        sizes = now.groupBy("key", "root").agg(F.count("*").alias("size"))
        mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("largest"), F.count("*").alias("classes"), F.sum("size").alias("n_met")).where("classes > 1")
        mixed = written(mixed.select("key", F.col("largest.root").alias("largest"), (F.col("n_met") - F.col("largest.size")).alias("n_asking"), "n_met"), "mixed")
        if mixed.isEmpty():
            break
        places = now.join(mixed, "key").groupBy("fp", "root").agg(F.collect_list(F.struct("key", "largest", "n_asking", "n_met")).alias("places"))  # up to BANDS of each text
        crowd = written(places.join(cards, "fp"), "crowd")
        rest = lambda own: crowd.select("fp", "root", F.explode(own).alias("place"), *_PLACED[6:]).select("place.*", *_PLACED[4:])  # noqa: B023, E731
        asking = rest(F.filter("places", lambda place: place["largest"] != F.col("root")))
        found = judged(written(_pairs(asking, rest("places"), most, tested.select("leader", "fp")), "untested"))
        new = found.where("near").select("leader", "fp")
        links, tested = links.unionByName(new), tested.unionByName(found)
        if most:  # what is linked now is one class in the next round
            over = lambda name: crowd.select(F.col("fp").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: B023, E731
            joined = new.join(over("leader"), "leader").join(over("fp"), "fp").select(F.col("leader_root").alias("leader"), F.col("fp_root").alias("fp"))
            on = components(joined).select(F.col("fp").alias("root"), F.col("root").alias("next"))
            roots = written(crowd.join(on, "root", "left").select("fp", F.coalesce("next", "root").alias("root"), F.col("places.key").alias("shared")), "rooted")
    return links


def components(links: DataFrame) -> DataFrame:
    """fp -> root, the smallest print that links reach, for all prints in links.

    In each round every print goes to its smallest neighbour, if that is smaller, and on to where such ways end; links are
    then between the ends, and those within one end are gone."""
    ends = F.greatest("leader", "fp").alias("high"), F.least("leader", "fp").alias("low")
    edges, labels = written(links.where("leader <> fp").select(*ends).distinct(), "edges"), None
    while labels is None or not edges.isEmpty():
        up = written(edges.groupBy(F.col("high").alias("fp")).agg(F.min("low").alias("root")), "up")
        while True:
            # what is joined is a table on both sides, so that Spark can split the rows of a print with very many links
            ahead = up.select(F.col("fp").alias("root"), F.col("root").alias("next"))
            jumped = up.join(ahead, "root", "left").select("fp", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            jumped = written(jumped, "jumped")
            up = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        over = lambda name: up.select(F.col("fp").alias(name), F.col("root").alias(f"{name}_root"))
        left = edges.join(over("high"), "high", "left").join(over("low"), "low", "left")
        left = left.select(F.coalesce("high_root", "high").alias("leader"), F.coalesce("low_root", "low").alias("fp")).where("leader <> fp")
        edges = written(left.select(*ends).distinct(), "edges")
        if labels is not None:  # prints of earlier rounds whose root goes on
            on = labels.join(up.select(F.col("fp").alias("root"), F.col("root").alias("next")), "root", "left")
            up = up.unionByName(on.select("fp", F.coalesce("next", "root").alias("root")))
        labels = written(up, "labels")
    return labels.unionByName(labels.select(F.col("root").alias("fp"), "root").distinct())


def worded() -> F.Column:
    """Whether a text has a letter, digit or underscore at all."""
    return F.coalesce(F.col("text").cast("string").rlike("[\\p{L}\\p{N}_]"), F.lit(False))


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and for each print: class_id, the print that stays, and its number of links."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.withColumn("worded", worded()).mapInArrow(_sketch, "doc_id long, fp binary, bands array<bigint>, words long, ranges binary"), "sketches")
    alike = F.first(F.struct("bands", "words", "ranges")).alias("x")  # equal texts have equal sketches
    texts = written(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), alike).select("fp", "id", "x.*"), "texts")
    links = written(_links(docs, texts), "links")
    degree = links.select(F.col("leader").alias("fp")).union(links.select("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    roots = components(links)
    named = texts.select("fp", "id").join(roots, "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first")
    heads = named.groupBy("root").agg(first).select("root", F.col("first.id").alias("class_id"), F.col("first.fp").alias("keep_fp"))
    grouped = roots.join(heads, "root").join(degree, "fp").select("fp", "class_id", "keep_fp", "links")
    alone = texts.join(roots, "fp", "left_anti").select("fp", F.col("id").alias("class_id"), F.col("fp").alias("keep_fp"), F.lit(0).cast("long").alias("links"))
    return rows.select("doc_id", "fp"), written(grouped.unionByName(alone), "classes")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and the number of links of its text, for every document."""
    rows, classes = _classes(documents)
    printed = rows.where("fp is not null").join(classes, "fp").select("doc_id", "class_id", "links")
    return printed.unionByName(rows.where("fp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each class, the one that names it, and every document without a text."""
    rows, classes = _classes(documents)
    stay = classes.where("fp = keep_fp").select(F.col("fp").alias("_fp"), F.col("class_id").alias("_id"))
    print_of = F.unhex(F.md5(F.col("text").cast("string").cast("binary")))
    own = documents.select(print_of.alias("_own"), F.col("doc_id").cast("long").alias("_doc"), F.struct([F.col(c) for c in documents.columns]).alias("row"))
    kept = own.join(stay, (F.col("_own") == F.col("_fp")) & F.col("_doc").eqNullSafe(F.col("_id")))
    # rows repeated with id and text alike are one document
    once = kept.groupBy("_own").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*") if _repeats(rows, classes) else kept.select("row.*")
    return once.unionByName(documents.where(F.coalesce(F.col("text").cast("string") == "", F.lit(True))))


def _repeats(rows: DataFrame, classes: DataFrame) -> bool:
    """Whether some row is there twice with the same id and text; only then are texts grouped."""
    return not rows.where("fp is not null").groupBy("fp", "doc_id").count().where("count > 1").isEmpty()
