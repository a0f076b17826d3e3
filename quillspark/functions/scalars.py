"""Scalar functions that Spark lacks, as Arrow-batched pandas functions over pure Python ones."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "元": 1, "兩": 2, "两": 2} | {c: i for i, c in enumerate("０１２３４５６７８９")} | {str(i): i for i in range(10)}
_UNITS = {"十": 10, "百": 100, "千": 1000, "廿": 20, "卅": 30, "卌": 40}

# Calendars that count years, as (names, year before year 1 in astronomical counting).
EPOCHS = ((("民國", "中華民國"), 1911), (("主體",), 1911), (("佛曆", "佛歷"), -543), (("皇紀",), -660), (("檀紀", "檀君紀元"), -2333), (("西曆", "西元", "公元"), 0))
_YELLOW = (("黃帝紀年", "黃帝紀元"), (-2698, -2697))


def numeral(text: str | None) -> int | None:
    """A number written in Arabic or Han digits, by position or with units (also 廿 卅 卌 and 萬)."""
    if not text or any(c not in _DIGITS and c not in _UNITS and c != "萬" and c != "万" for c in text):
        return None
    if not any(c in _UNITS or c in "萬万" for c in text):
        return int("".join(str(_DIGITS[c]) for c in text))
    total = section = digit = 0
    for c in text:
        if c in _DIGITS:
            digit = digit * 10 + _DIGITS[c] if text.isascii() else _DIGITS[c]
        elif c in "廿卅卌":
            section, digit = section + _UNITS[c], 0
        elif c in _UNITS:
            section, digit = section + (digit or 1) * _UNITS[c], 0
        else:
            total, section, digit = (total + section + digit) * 10_000, 0, 0
    return total + section + digit


def historical(astronomical: int) -> int:
    """Astronomical year to historical: there is no year zero."""
    return astronomical if astronomical > 0 else astronomical - 1


def resolve_year(text: str) -> list[int]:
    """The historical years that an expression like 佛曆2569年 may mean; none if it is not understood."""
    for names, before in (*EPOCHS, *((_YELLOW[0], b) for b in _YELLOW[1])):
        for name in sorted(names, key=len, reverse=True):
            m = re.match(rf"{name}(前?)([\d０-９元零〇一二三四五六七八九十百千廿卅卌]+)年", text)
            if m and (n := numeral(m[2])) is not None:
                if before in _YELLOW[1]:
                    return sorted(historical(n + b) for b in _YELLOW[1])
                return [historical(before + (1 - n if m[1] else n))]
    return []


def resolve_date(text: str) -> tuple[int, int | None, int | None] | None:
    """(year, month, day) of an expression with a unique year."""
    years = resolve_year(text)
    if len(years) != 1:
        return None
    m = re.search(r"年(?:([\d元一二三四五六七八九十]+)月)?(?:([\d一二三四五六七八九十廿卅]+)日)?", text)
    return years[0], numeral(m[1]) if m and m[1] else None, numeral(m[2]) if m and m[2] else None


_PINYIN_TONES = {"̄": 1, "́": 2, "̌": 3, "̀": 4}
_VIETNAMESE_TONES = {"́": 2, "̀": 3, "̉": 4, "̃": 5, "̣": 1}


def split_reading(system: str, reading: str) -> tuple[str, int | None]:
    """(slot, tone): the syllable without its tone, and the tone. Mandarin marks 1-4 with 5 for none;
    Vietnamese marks with 6 for none; other systems a digit at the end, or none."""
    reading = reading.strip().lower()
    if m := re.fullmatch(r"(.*?)([0-9⁰¹²³⁴-⁹])", reading):
        return m[1], int(unicodedata.normalize("NFKC", m[2]))
    marks = {"mandarin": _PINYIN_TONES, "vietnamese": _VIETNAMESE_TONES}.get(system)
    if not marks:
        return reading, None
    letters = unicodedata.normalize("NFD", reading)
    tones = [marks[c] for c in letters if c in marks]
    slot = unicodedata.normalize("NFC", "".join(c for c in letters if c not in marks))
    return slot, tones[0] if tones else {"mandarin": 5, "vietnamese": 6}[system]


#: Operators of ideographic description sequences and how many parts they take.
ARITY = {chr(c): 2 for c in range(0x2FF0, 0x2FFC)} | {"⿲": 3, "⿳": 3, "⿾": 1, "⿿": 1, "⿼": 2, "⿽": 2}


def description_tokens(text: str) -> list[str]:
    """Operators, characters and &entities; of a description."""
    return re.findall(r"&[^;&\s]+;|\S", text)


def description_parts(text: str) -> list[tuple[str, int, int]]:
    """Leaves of a description in prefix order as (component, depth, position); empty if incomplete."""
    out, open_parts = [], [1]
    for position, token in enumerate(description_tokens(text)):
        if not open_parts:
            return []
        depth = len(open_parts) - 1
        open_parts[-1] -= 1
        if token in ARITY:
            open_parts.append(ARITY[token])
        else:
            out.append((token, depth, position))
        while open_parts and not open_parts[-1]:
            open_parts.pop()
    return [] if open_parts else out


def description_balance(text: str) -> int:
    """0 if complete, below 0 by the parts that are missing, above by those too many."""
    need = 1
    for token in description_tokens(text):
        need += ARITY.get(token, 0) - 1
    return -need


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def multiset_jaccard(a: str, b: str) -> float:
    x, y = Counter(a), Counter(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def _apply(f, kind: T.DataType, *columns: Column) -> Column:
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in values) else f(*values) for values in zip(*series)], dtype=object)

    # The signature carries the number of columns for Spark.
    one = lambda a: run(a)
    two = lambda a, b: run(a, b)
    g = one if len(columns) == 1 else two
    g.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series} if len(columns) == 2 else {"a": pd.Series, "return": pd.Series}
    return F.pandas_udf(g, kind)(*columns)


def parse_numeral(column: Column) -> Column:
    return _apply(numeral, T.LongType(), column)


def normal_form(column: Column, form: str = "NFKC") -> Column:
    """Unicode normal form; NFKD without marks under the name 'bare'."""
    if form == "bare":
        return _apply(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn"), T.StringType(), column)
    return _apply(lambda t: unicodedata.normalize(form, t), T.StringType(), column)


def subsequence_length(a: Column, b: Column) -> Column:
    return _apply(common_subsequence, T.IntegerType(), a, b)


def character_jaccard(a: Column, b: Column) -> Column:
    return _apply(multiset_jaccard, T.DoubleType(), a, b)


def error_complement(column: Column) -> Column:
    return _apply(math.erfc, T.DoubleType(), column)


def reading_slot(column: Column, system: str) -> Column:
    """The syllable of a reading without its tone."""
    return _apply(lambda t: split_reading(system, t)[0], T.StringType(), column)


def reading_tone(column: Column, system: str) -> Column:
    """The tone of a reading; null where the system or the reading has none."""
    return _apply(lambda t: split_reading(system, t)[1], T.IntegerType(), column)


def resolved_date(column: Column) -> Column:
    """year-month-day of a date expression with a unique historical year, unknown parts empty; null otherwise."""
    show = lambda d: None if d is None else "-".join("" if x is None else str(x) for x in d)
    return _apply(lambda t: show(resolve_date(t)), T.StringType(), column)
