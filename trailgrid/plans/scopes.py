"""Scopes and drives of a query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailgrid.functions.paths import any_of, ascii_lower, segments, without_verbatim

_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Scope:
    """A root, and whether what lies below it belongs to the scope."""

    root: str
    descendants: bool = True

    def parts(self) -> list[str]:
        """Components, A to Z in lower case."""
        plain = re.sub(r"^\\\\\?\\(UNC\\)?", "", self.root)
        return [x for x in re.split(r"[/\\]", plain.translate(_FOLD)) if x]


def in_scope(path: Column, scopes: list[Scope], place: Column | None = None) -> Column:
    """Whether a path is in any scope; everything is, if there is none. ``place``: the stored path in the form of
    :func:`trailgrid.functions.paths.place`, on whose beginning a scan can skip row groups."""
    if place is not None:

        def stored(scope: Scope) -> Column:
            root = "\\".join(scope.parts())
            below = F.startswith(place, F.lit(root + "\\")) if root else F.lit(True)
            return (place == root) | below if scope.descendants else place == root

        return any_of([stored(s) for s in scopes], True)
    segs = F.transform(segments(without_verbatim(path)), ascii_lower)

    def one(scope: Scope) -> Column:
        parts = scope.parts()
        same = F.slice(segs, F.lit(1), F.lit(max(1, len(parts)))) == F.array(*(F.lit(x) for x in parts)) if parts else F.lit(True)
        return same if scope.descendants else same & (F.size(segs) == len(parts))

    return any_of([one(s) for s in scopes], True)


def drive_letters(pattern: str, available: list[str] = (), roots: list[str] = ()) -> list[str]:
    """Upper-case letters of a pattern, each once; ``*`` means the drives of the roots, or else all available ones."""
    text = pattern.strip()
    if text == "*":
        found = list(dict.fromkeys(m[1].upper() for r in roots if (m := re.match(r"(?:\\\\\?\\)?([A-Za-z]):", r))))
        return found or list(available)
    out = []
    for i, c in enumerate(text):
        if c.isspace() or c in ",;":
            continue
        if not (c.isascii() and c.isalpha()):
            raise ValueError(f"{text!r}: {c!r} at position {i} is no drive letter")
        out.append(c.upper())
    if not out:
        raise ValueError(f"{text!r} names no drive")
    return list(dict.fromkeys(out))
