"""Paths as column expressions: everything stays inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RECORD_BITS = (1 << 48) - 1


def segments(path: Column) -> Column:
    """The non-empty segments between slashes and backslashes."""
    return F.filter(F.split(path, r"[/\\]"), lambda s: s != "")


def folded(path: Column) -> Column:
    """Segments in lower case."""
    return F.transform(segments(path), F.lower)


def terminal(segs: Column) -> Column:
    """The last segment; null if there is none."""
    return F.try_element_at(segs, F.lit(-1))


def suffix(term: Column) -> Column:
    """From the last dot on, with at least one character after it; null otherwise."""
    return F.nullif(F.regexp_extract(term, r"(\.[^.]+)$", 1), F.lit(""))


def extension(term: Column) -> Column:
    """After the last dot of a name that has something before it; null otherwise."""
    return F.nullif(F.regexp_extract(term, r"^.+\.([^.]+)$", 1), F.lit(""))


def parent(path: Column) -> Column:
    """The path without its last segment."""
    segs = segments(path)
    return F.array_join(F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0))), "\\")


def canonical(path: Column) -> Column:
    """Segments joined by single backslashes."""
    return F.array_join(segments(path), "\\")


def place(path: Column) -> Column:
    """For scopes: without verbatim prefixes, segments joined by single backslashes, A to Z in lower case."""
    return ascii_lower(canonical(without_verbatim(path)))


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


def normalized(path: Column) -> Column:
    """For rules: forward slashes, ``.`` dropped, ``..`` resolved, A to Z in lower case, no slash at the end."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    back = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    plain = F.array_join(F.when(F.exists(parts, lambda s: s == ".."), back).otherwise(parts), "/")
    joined = F.when(slashed.startswith("/"), F.concat(F.lit("/"), plain)).otherwise(plain)
    return ascii_lower(F.when(joined.rlike("^[A-Za-z]:$"), F.concat(joined, F.lit("/"))).otherwise(joined))


def joined(base: Column, name: Column) -> Column:
    """base and name with exactly one separator added where base does not end in one."""
    return F.when(F.endswith(base, F.lit("\\")), F.concat(base, name)).otherwise(F.concat(base, F.lit("\\"), name))


def without_verbatim(path: Column) -> Column:
    """Without the prefixes of verbatim and UNC paths."""
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\\\\\"), r"^\\\\\?\\", "")


def drive(path: Column) -> Column:
    """The drive letter of an absolute path, verbatim or not; null otherwise."""
    return F.upper(F.nullif(F.regexp_extract(path, r"^(?:\\\\\?\\)?([A-Za-z]):", 1), F.lit("")))


def trigrams(text: Column) -> Column:
    """The distinct runs of three UTF-8 bytes in order, as hex."""
    raw = F.encode(text, "utf-8")
    runs = F.transform(F.sequence(F.lit(0), F.octet_length(raw) - 3), lambda i: F.hex(F.substring(raw, i + 1, F.lit(3))))
    return F.when(F.octet_length(raw) >= 3, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))


def record_number(frn: Column) -> Column:
    """The low 48 bits of a file reference."""
    return frn.bitwiseAND(F.lit(RECORD_BITS))


def sequence_number(frn: Column) -> Column:
    """The high 16 bits."""
    return F.shiftrightunsigned(frn, 48)


def file_reference(record: Column, sequence: Column) -> Column:
    """A file reference of its two parts."""
    return record.bitwiseOR(F.shiftleft(sequence.cast("long"), 48))


#: Change reasons of the journal, in their order of display.
REASONS = (
    (0x00000100, "file-create"), (0x00000200, "file-delete"), (0x00001000, "rename-old-name"),
    (0x00002000, "rename-new-name"), (0x00010000, "hard-link-change"), (0x00008000, "basic-info-change"),
    (0x80000000, "close"), (0x00000001, "data-overwrite"), (0x00000002, "data-extend"),
    (0x00000004, "data-truncation"), (0x00020000, "compression-change"), (0x00000400, "ea-change"),
    (0x00040000, "encryption-change"), (0x00004000, "indexable-change"), (0x00800000, "integrity-change"),
    (0x00000010, "named-data-overwrite"), (0x00000020, "named-data-extend"), (0x00000040, "named-data-truncation"),
    (0x00080000, "object-id-change"), (0x00100000, "reparse-point-change"), (0x00000800, "security-change"),
    (0x00200000, "stream-change"), (0x00400000, "transacted-change"), (0x01000000, "desired-storage-class-change"),
)
LIVE_REASONS = 0x00000100 | 0x00002000 | 0x00010000
DELETED_REASONS = 0x00000200 | 0x00001000


def reason_names(reason: Column) -> Column:
    """The names of the bits that are set."""
    return F.array_compact(F.array(*(F.when(reason.bitwiseAND(F.lit(m)) != 0, F.lit(n)) for m, n in REASONS)))


def rfc3339(at: Column) -> Column:
    """A time as text in UTC, to the second, with fractions where there are any."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    micros = F.unix_micros(at) % 1_000_000
    micros = F.when(micros < 0, micros + 1_000_000).otherwise(micros)
    part = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(micros.cast("string"), 6, "0"), "0+$", "")))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("Z"))


def unix_ms(at: Column) -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(at)


def low_file_id(identifier: Column) -> Column:
    """The low 64 bits of a 128-bit file id, which is 16 bytes, the lowest first; as a signed long."""
    high_first = F.reverse(F.substring(F.hex(identifier), 1, 16))
    pairs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.reverse(F.substring(high_first, i * 2 + 1, F.lit(2)))), "")
    return F.conv(pairs, 16, -10).cast("long")


def reason_hex(reason: Column) -> Column:
    """0x and eight digits."""
    return F.format_string("0x%08x", reason.cast("long"))


def affects_topology(reason: Column) -> Column:
    """Whether links change."""
    return reason.bitwiseAND(F.lit(LIVE_REASONS | DELETED_REASONS)) != 0


def is_directory(attributes: Column) -> Column:
    """By the attribute bit."""
    return attributes.bitwiseAND(F.lit(16)) != 0


def any_of(columns: list[Column], default: bool) -> Column:
    """OR of columns; ``default`` if there is none."""
    return reduce(Column.__or__, columns) if columns else F.lit(default)
