"""Token ids by a public tokenizer file, word by word.

Both byte-level vocabularies split a text by a pattern and then merge inside each piece, so a piece has the same ids
wherever it stands. Pieces repeat, so each distinct piece goes once to the library's merging step, its bytes written as
the characters that the byte level stands for, and the ids are joined as bytes. The vocabulary of lower-case words drops
white space, so its plain texts are cut as arrays of bytes, a run of texts at once, and Python sees each distinct piece of
a run once. Texts with
characters outside tab, line feed, carriage return, printable ASCII and printable Latin-1 go through the library whole,
where classes of characters could differ between pattern engines, and so do texts that hold an added token of the
vocabulary, which the library cuts out before it splits.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .common import CACHES, tidy

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ÿ]*")
#: The splitting patterns that the two vocabularies were made with, for plain text. That of words is
#: 's|'t|'re|'ve|'m|'ll|'d|letters|one number|other characters but white space; :func:`cut_words` does the same.
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_SPACE_KIND, _LETTER_KIND, _NUMBER_KIND, _OTHER_KIND = range(4)
_KIND = np.array([_LETTER_KIND if re.match(f"[{_LETTER}]", chr(i)) else _NUMBER_KIND if re.match(f"[{_NUMBER}]", chr(i)) else _SPACE_KIND if chr(i).isspace() else _OTHER_KIND for i in range(256)], np.uint8)
_LOWER = bytes(ord(chr(i).lower()) for i in range(256))  # Latin-1 stays Latin-1


def cut_words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of plain texts in lower case, as Latin-1 bytes, and the number of pieces up to the end of each text."""
    raw = np.frombuffer("\n".join(texts).encode("latin-1").translate(_LOWER) + b"\n\n\n", np.uint8)
    kind = _KIND[raw]
    first = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == _NUMBER_KIND
    at = np.flatnonzero((raw == ord("'")) & first)  # within other characters an apostrophe is one of them
    one, two = raw[at + 1], raw[at + 2]
    short = at[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    long = at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    first[short + 1] = first[long + 1] = first[long + 2] = False
    first[short + 2] = first[long + 3] = True
    kept = kind != _SPACE_KIND
    first &= kept
    data, starts = raw[kept], np.flatnonzero(first[kept])
    offsets = np.append(starts, len(data))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return pieces.dictionary_encode(), np.searchsorted(np.flatnonzero(first), ends)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.lower = json.load(f)["normalizer"] is not None
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(sorted(added, key=len, reverse=True)) or "(?!)", re.IGNORECASE if self.lower else 0)
        self.most = most or (400_000 if self.lower else 150_000)
        self.known: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {byte: c for x in map(chr, range(256)) for byte, c in zip(x.encode(), "".join(y for y, _ in level.pre_tokenize_str(x)), strict=True)}
        self.space = self.letters[32]
        self.merge = self.tokenizer.model.tokenize
        probes = [chr(c).lower() for c in range(33, 127)] + ["the", " the" if not self.lower else "they", "é", "ñandú", "0", "'s", "?!", "straße", "zqxj" * 9]
        if [self.piece(x) for x in probes] != self.whole(probes):
            raise ValueError(f"{path}: pieces of text do not have the ids that they have in texts")

    def piece(self, text: str) -> bytes:
        """The ids of a piece that the pattern has split off."""
        if text.isascii() and text.isprintable():  # all but the space stand for themselves
            text = text.replace(" ", self.space)
        else:
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.merge(text)]).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone, a slice at a time: its own results are many times the size of the ids."""
        out: list[bytes] = []
        for a in range(0, len(texts), 8192):
            out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts[a : a + 8192], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the batch is worked through in runs of bounded size."""
        out: list[bytes] = []
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= (4_000_000 if self.lower else 1_000_000):
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)

    def _run(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(x) is not None and self.added.search(x) is None for x in texts]
        # a piece never holds an added token, as its text would
        if self.lower:
            rest = iter(self.whole([x for x, p in zip(texts, plain, strict=True) if not p]))
            own = iter(self._words([x for x, p in zip(texts, plain, strict=True) if p]))
            return [next(own if p else rest) for p in plain]
        pieces = [_BYTE_LEVEL.findall(x) if p else None for x, p in zip(texts, plain, strict=True)]
        new: set[str] = set()
        for x in pieces:
            if x:
                new.update(x)
        if len(self.known) + len(new) > self.most:  # what is not met again goes with the next turn
            self.known, self.older = {}, self.known
        for x in new.difference(self.known):
            self.known[x] = self.older.get(x) or self.piece(x)
        find = self.known.__getitem__
        rest = iter(self.whole([x for x, p in zip(texts, plain, strict=True) if not p]))
        return [next(rest) if x is None else b"".join(map(find, x)) for x in pieces]

    def _words(self, texts: list[str]) -> list[bytes]:
        """Plain texts by the vocabulary of words: the ids of the distinct pieces, gathered in the order of the pieces."""
        if not texts:
            return []
        pieces, ends = cut_words(texts)
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if len(self.known) + len(new) > self.most:  # what is not met again goes with the next turn
            self.known, self.older = {w: x for w, x in zip(words, found, strict=True) if x is not None}, self.known
        for i in new:
            word = words[i]
            found[i] = self.known[word] = self.older.get(word) or self.piece(word.decode("latin-1"))
        ids = np.frombuffer(b"".join(found), np.uint32)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = pieces.indices.to_numpy()
        own = lengths[which]
        after = np.append(0, np.cumsum(own))  # ids before each piece, and all
        out = ids[np.repeat((np.cumsum(lengths) - lengths)[which] - after[:-1], own) + np.arange(after[-1])].tobytes()
        cuts = (4 * after[ends]).tolist()
        return [out[a:b] for a, b in zip([0, *cuts], cuts)]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, Encoder] = {}
CACHES.append(_encoders)


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        tidy()
        _encoders[path] = Encoder(path)
    return _encoders[path]
