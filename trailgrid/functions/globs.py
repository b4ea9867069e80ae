"""Globs as Java regular expressions: ``*`` and ``?`` cross separators, ``**`` stands for whole segments."""

from __future__ import annotations

_META = set("*?[]{}")
_ESCAPED = set(r"\.^$|()+*?[]{}-&~#")


def has_meta(pattern: str) -> bool:
    """Whether a pattern is more than literal text."""
    return any(c in _META for c in pattern)


def to_regex(glob: str) -> str:
    """An anchored, case-insensitive expression; raises ValueError on an unbalanced class or alternate."""
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            stars = len(glob) - i - len(glob[i:].lstrip("*"))
            before, after = i == 0 or glob[i - 1] == "/", i + stars == n or glob[i + stars] == "/"
            if stars == 2 and before and after:
                if i + 2 == n:
                    out.append(".*" if i == 0 else ".+")
                    i = n
                else:
                    out.append("(?:.*/)?")
                    i += 3
                continue
            out.append(".*")
            i += stars
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 + (i + 1 < n and glob[i + 1] in "!^"))
            if end < 0:
                raise ValueError(f"unclosed character class in {glob!r}")
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            inner = body[1:] if negated else body
            out.append(f"[{'^' if negated else ''}{''.join(x if x == '-' else _literal(x) for x in inner)}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise ValueError(f"unopened alternate in {glob!r}")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(_literal(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternate in {glob!r}")
    return f"(?is)^{''.join(out)}$"


def _literal(c: str) -> str:
    return f"\\{c}" if c in _ESCAPED else c
