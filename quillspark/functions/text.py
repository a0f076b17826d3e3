"""Column functions on text, all JVM-side. Offsets and lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a search ignores: punctuation, separators, white space and zero-width characters.
IGNORED = r"\p{P}\p{Z}\p{IsWhite_Space}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}"
#: Han ideographs, extensions and compatibility blocks.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
# Path segments that name a document's role, the first that occurs deciding.
ROLE_SEGMENTS = (
    ("raw", ("raw",)),
    ("textual_variant", ("variants",)),
    ("reconstruction", ("reconstruction", "reconstructions")),
    ("derived_reading", ("kanbun", "hanmun", "hanvan")),
    ("translation", ("translation", "translations")),
    ("annotation", ("annotation", "annotations")),
    ("canonical", ("clean",)),
)
UNKNOWN_GROUP = "(Unknown / unclassified)"


def normalised(body: Column, punctuation: str = "ignore") -> Column:
    """The searchable stream of a body."""
    body = F.coalesce(body, F.lit(""))
    return F.regexp_replace(body, f"[{IGNORED}]", "") if punctuation == "ignore" else body


def count_han(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{HAN}]", ""))


def quoted(term: str) -> str:
    """A literal as a regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|#&~" else c for c in term)


def count_exact(stream: Column, term: str) -> Column:
    """Overlapping occurrences of a literal: by length difference where the term cannot overlap itself,
    else by a lookahead."""
    if any(term[:k] == term[-k:] for k in range(1, len(term))):
        return F.size(F.regexp_extract_all(stream, F.lit(f"(?=({quoted(term)}))"), F.lit(1)))
    return ((F.length(stream) - F.length(F.replace(stream, F.lit(term), F.lit("")))) / len(term)).cast("int")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")


def role_of(path: Column) -> Column:
    """The document role that a path's segments give; 'support' without any."""
    lowered = path_segments(F.lower(path))
    role = F.lit("support")
    for name, segments in reversed(ROLE_SEGMENTS):
        role = F.when(F.arrays_overlap(lowered, F.array(*map(F.lit, segments))), F.lit(name)).otherwise(role)
    return role


def canonical_parent(path: Column) -> Column:
    """What lies before the segment that makes a path a variant, else before that which makes it a
    reconstruction; null without one."""
    lowered = path_segments(F.lower(path))
    variant = F.array_position(lowered, "variants")
    made = [F.array_position(lowered, s) for s in ("reconstruction", "reconstructions")]
    first = F.least(*[F.when(p > 0, p) for p in made])
    at = F.when(variant > 0, variant).otherwise(first).cast("int")
    return F.when(at.isNotNull(), F.array_join(F.slice(path_segments(path), F.lit(1), F.greatest(at - 1, F.lit(0))), "/"))


def folder_of(path: Column) -> Column:
    segments = path_segments(path)
    return F.array_join(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), "/")


def group_name(value: Column) -> Column:
    """A facet's group: trimmed, blanks under one name for unknown."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(UNKNOWN_GROUP))


def sexagenary(year: Column) -> Column:
    """The stem-branch name of a CE year; null before."""
    stems, branches = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
    index = F.pmod(year - 4, F.lit(60))
    name = F.concat(F.substring(F.lit(stems), F.pmod(index, F.lit(10)) + 1, F.lit(1)), F.substring(F.lit(branches), F.pmod(index, F.lit(12)) + 1, F.lit(1)))
    return F.when(year > 0, name)


def astronomical(year: Column) -> Column:
    """Historical year (no year 0) to astronomical."""
    return F.when(year < 0, year + 1).otherwise(year)


def century_start(year: Column) -> Column:
    """First year of a historical year's century: 1, 101, ... and -100, -200, ..."""
    return F.when(year > 0, F.floor((year - 1) / 100) * 100 + 1).otherwise(-F.ceil(F.abs(year) / 100) * 100).cast("int")


def han_numeral(number: Column) -> Column:
    """0..9999 in Han numerals, zeros inside written once, a leading 一十 as 十."""
    digit = lambda d: F.substring(F.lit("零一二三四五六七八九"), d + 1, F.lit(1))
    parts = []
    for power, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = F.pmod(F.floor(number / power), F.lit(10)).cast("int")
        parts.append(F.when(d > 0, F.concat(digit(d), F.lit(unit))).otherwise(F.lit("零")))
    whole = F.regexp_replace(F.regexp_replace(F.concat(*parts), "^零+|零+$", ""), "零+", "零")
    whole = F.regexp_replace(whole, "^一十", "十")
    return F.when((number < 0) | (number > 9999), F.lit(None)).when(number == 0, "零").otherwise(whole)


def overlaps_years(start: Column, end: Column, low: int | None, high: int | None) -> Column:
    """Whether a record's years meet an interval; undated records only without an interval."""
    if low is None and high is None:
        return F.lit(True)
    first, last = F.coalesce(start, end), F.coalesce(end, start)
    return F.coalesce((last >= (low if low is not None else -(2**31))) & (first <= (high if high is not None else 2**31 - 1)), F.lit(False))


def title_key(title: Column) -> Column:
    """A title without quotes, brackets with content, punctuation and case."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"[（(][^）)]*[）)]", "")
    return F.lower(F.regexp_replace(bare, f"[{IGNORED}]", ""))


def julian_day(year: Column, month: Column, day: Column, gregorian: bool = True) -> Column:
    """The Julian day number of a date; year is astronomical."""
    shift = F.floor((14 - month) / 12)
    y, m = year + 4800 - shift, month + 12 * shift - 3
    base = day + F.floor((153 * m + 2) / 5) + 365 * y + F.floor(y / 4)
    return (base - F.floor(y / 100) + F.floor(y / 400) - 32045).cast("bigint") if gregorian else (base - 32083).cast("bigint")


def escape_like(text: str, mark: str = "\\") -> str:
    """A text as part of a LIKE pattern, its wildcards and the mark itself escaped."""
    return "".join(mark + c if c in f"%_{mark}" else c for c in text)


def contains_literally(column: Column, text: str) -> Column:
    """Whether a column holds a text letter for letter, as a LIKE that sources can push down."""
    return column.like(f"%{escape_like(text)}%")
