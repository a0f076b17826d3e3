"""Several values packed into one field.

A dictionary of values known to be whole guides the segmentation. It is counted exactly over all rows: a value
that contains a separator is known where at least LEAST_ROWS rows of its field hold it protected by quotes or
brackets. A multi-pattern automaton finds every known value in a field, protected or not, and dynamic
programming picks the best cover of the field by pieces: the fewest, a known value being one piece however
many separators it contains. Quotes and brackets protect what they enclose, known or not.

The dictionary may grow with the data, so it is never assumed to fit: it is dealt by hash into parts of at most
about PART values, each with an automaton of its own that passes over the fields; the cover is chosen when all
parts have reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

SEPARATORS = ";；、,，/／|｜\t\n\r"
QUOTES = {'"': '"', "“": "”", "「": "」"}
BRACKETS = {"(": ")", "（": "）"}
#: A value with separators is known when that many rows of its field hold it protected.
LEAST_ROWS = 3
#: Known values whose automaton one task holds at once.
PART = 200_000
_SPACE = " \t\n\r\f\v\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def cut_points(text: str) -> list[tuple[int, int]]:
    """The segments of text between separators that no quote or bracket protects. A quote opens only at
    the start of a value and must close; unclosed quotes and brackets protect nothing."""
    segments, start, i, n, fresh = [], 0, 0, len(text), True
    while i < n:
        c = text[i]
        close = QUOTES.get(c) if fresh else None
        if close:
            j = text.find(close, i + 1)
            while c == '"' and 0 <= j and text[j + 1 : j + 2] == '"':
                j = text.find('"', j + 2)
            if j >= 0:
                i, fresh = j + 1, False
                continue
        elif c in BRACKETS:
            j = _bracket_end(text, i)
            if j >= 0:
                i, fresh = j + 1, False
                continue
        if c in SEPARATORS:
            segments.append((start, i))
            start, fresh = i + 1, True
        elif c not in _SPACE:
            fresh = False
        i += 1
    segments.append((start, n))
    return segments


def _bracket_end(text: str, i: int) -> int:
    stack = []
    for j in range(i, len(text)):
        c = text[j]
        if c in BRACKETS:
            stack.append(BRACKETS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return j
    return -1


def unquote(piece: str) -> str:
    """Trim, take off enclosing quotes, halve doubled quotes."""
    piece = piece.strip(_SPACE)
    if len(piece) >= 2 and QUOTES.get(piece[0]) == piece[-1]:
        inner = piece[1:-1]
        if piece[0] == '"':
            inner = inner.replace('""', '"')
        piece = inner.strip(_SPACE)
    return piece


def automaton(known: list[tuple[str, list[str]]]):
    """Multi-pattern automaton over (value, fields in which it is known); None without any."""
    import ahocorasick

    if not known:
        return None
    machine = ahocorasick.Automaton()
    for value, of in known:
        machine.add_word(value, (len(value), frozenset(of)))
    machine.make_automaton()
    return machine


def known_spans(text: str, machine, field: str | None = None) -> list[int]:
    """Start and end of every occurrence of a value that is known in the field, flat."""
    return [x for end, (length, of) in machine.iter(text) if field is None or field in of for x in (end + 1 - length, end + 1)]


def split_packed(text: str | None, machine=None, field: str | None = None, spans: list[int] = ()) -> list[str]:
    """The values of one field, by the known spans of it (those of the machine and those given). Null, empty
    and blank give none."""
    if text is None or text != text:
        return []
    segments = cut_points(text)
    if len(segments) > 1:
        found = [*spans, *(known_spans(text, machine, field) if machine is not None else ())]
        segments = best_cover(text, segments, found)
    return [v for a, b in segments if (v := unquote(text[a:b]))]


def best_cover(text: str, segments: list[tuple[int, int]], spans: list[int]) -> list[tuple[int, int]]:
    """The cover of neighbouring segments by the fewest pieces. A piece is a segment, or several that together
    are a known value, space and quotes around them aside; cost[i] is that of the first i segments."""
    first, last = {}, {}
    for k, (a, b) in enumerate(segments):
        piece = text[a:b]
        first[a + len(piece) - len(piece.lstrip(_SPACE))] = k
        last[a + len(piece.rstrip(_SPACE))] = k
    joins: dict[int, list[int]] = {}
    for start, end in zip(spans[::2], spans[1::2]):
        i, j = first.get(start), last.get(end)
        if i is not None and j is not None and j > i:
            joins.setdefault(j, []).append(i)
    if not joins:
        return segments
    cost, back = [0], [0]
    for j in range(len(segments)):
        best, at = min([(cost[j] + 1, j), *((cost[i] + 1, i) for i in joins.get(j, ()))])
        cost.append(best)
        back.append(at)
    cover, j = [], len(segments)
    while j:
        cover.append((segments[back[j]][0], segments[j - 1][1]))
        j = back[j]
    return cover[::-1]


def known_whole_values(fields: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """fields (table_name, row_no, field_name, text) -> value, fields: the dictionary. Rows are counted exactly
    and combined map-side; one row counts once for a value."""

    def protected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for field, text in zip(batch["field_name"], batch["text"]):
                values = {v for a, b in cut_points(text) if (v := unquote(text[a:b]))}
                out += [(field, v) for v in values if any(c in SEPARATORS for c in v)]
            yield pd.DataFrame(out, columns=["field_name", "value"])

    holding = fields.where(F.col("text").rlike(r'["“「(（]')).select("field_name", "text").mapInPandas(protected, "field_name string, value string")
    counted = holding.groupBy("value", "field_name").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    return counted.groupBy("value").agg(F.collect_set("field_name").alias("fields"))


def unpack(fields: DataFrame, known: DataFrame) -> DataFrame:
    """fields (table_name, row_no, field_name, text), known (value, fields) -> table_name, row_no, field_name,
    pos, value.

    Defined cases: null, empty and blank fields give no row; empty pieces take no position; unclosed
    quotes or brackets protect nothing; a row repeated letter for letter must be removed before; of covers
    with equally few pieces the one that joins earlier segments; very long fields are split in one pass;
    an empty dictionary leaves quotes and brackets alone to protect; other columns are ignored.
    """
    spark = fields.sparkSession
    kept = cut(known.select("value", "fields"))
    parts = max(1, -(-kept.count() // PART))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)))
    rows = fields.where(F.col("text").isNotNull()).select("table_name", "row_no", "field_name", "text")
    schema = "table_name string, row_no bigint, field_name string, "
    rows = rows.withColumn("spans", F.array().cast("array<int>"))
    for part in range(parts):
        words = spark.sparkContext.broadcast([(r["value"], list(r["fields"])) for r in dealt.where(F.col("part") == part).select("value", "fields").collect()])
        if part < parts - 1:
            rows = rows.mapInPandas(_scan(words), schema + "text string, spans array<int>")
        else:
            rows = rows.mapInPandas(_split(words), schema + "pos bigint, value string")
    return rows


def _scan(words):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(words.value)
        for batch in batches:
            found = [[*s, *(known_spans(t, machine, f) if machine else ())] for t, f, s in zip(batch["text"], batch["field_name"], batch["spans"])]
            yield batch.assign(spans=found)

    return run


def _split(words):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(words.value)
        for batch in batches:
            values = [split_packed(t, machine, f, list(s)) for t, f, s in zip(batch["text"], batch["field_name"], batch["spans"])]
            counts = [len(v) for v in values]
            out = batch[["table_name", "row_no", "field_name"]].loc[batch.index.repeat(counts)].reset_index(drop=True)
            out["pos"] = pd.Series([p for n in counts for p in range(n)], dtype="int64")
            out["value"] = pd.Series([x for v in values for x in v], dtype=object)
            yield out

    return run
