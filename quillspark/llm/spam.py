"""Keyword-stuffed pages, link lists and product-tag pages.

One pass over the whole texts measures each document: share of the most frequent phrases and n-grams, share
of repeated lines, share of link text, density of separators, of tags, of prices and product codes, and of
function words. The language is read off the text, not the lang column, which may be wrong.

Thresholds are calibrated per language from all its documents: the median share of function words says how
sentences of it read, and pages that have at least half of that are its ordinary pages; stuffing is what lies
well above the last hundredth of those. Function words enter every rule: the more of them a page has, the more
repetition it takes to call it stuffed, and links, tags and prices only count on pages that lack them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

_HEADER = re.compile(r"#[ \t]*[A-Z][A-Z0-9_ ]{1,80}[ \t]*[:：]")
_HOST_END = r"(?:example|test|invalid|com|net|org|info|biz|io|cn|jp|kr|vn|tw|hk|shop|xyz|top|site)"
LINK = re.compile(
    r"h(?:tt|xx)ps?://[^\s，。；）】]+|www\.[^\s，。；）】]+|(?<![A-Za-z0-9])[a-z0-9][a-z0-9-]{2,}(?:(?:\.|\[\.\])[a-z0-9-]+)*(?:\.|\[\.\])" + _HOST_END + r"(?![A-Za-z0-9-])[^\s，。；）】]*"
)
_TAG = re.compile(r"[#＃][^\s#＃]+")
# Prices, product codes and (fixed values) words of stock and shipping.
_MARK = re.compile(r"[¥￥$€£]\s?\d[\d.,]*|\b[A-Z]{2,5}-?\d{3,}\b|包[郵邮]|免[運运]|[現现][貨货]|特[價价]|in stock|free shipping|add to cart|buy now", re.I)
_COUNTED = re.compile(r"[(（]\d+[)）]")
_BREAK = re.compile(r"[，。、；：！？,.;:!?|｜>»·•・/\\#＃\[\]()（）【】「」『』《》〈〉“”\"…—–→=\n\r\t　]+|\s-\s|(?<![A-Za-zÀ-ỹ]) +| +(?![A-Za-zÀ-ỹ])")
_WORD = re.compile(r"[A-Za-zÀ-ỹ']+|[぀-ヿ一-鿿가-힣㐀-䶿]+")
# Words that sentences of these languages cannot do without.
_HAN_FUNCTION = re.compile("[之其者也曰以而於不有是夫若故未遂今得則矣乎何可為與的了他們就都把這那在我你因所]")
_LATIN_FUNCTION = re.compile(r"\b(?:the|a|an|of|and|in|at|it|who|it's|said|to|is|was|that|for|on|with|as|by|did|didn't|she|he|i|you|và|của|là|không|có|được|một|những|cho|với)\b", re.I)
_FUNCTION = {
    "classical": _HAN_FUNCTION,
    "modern": _HAN_FUNCTION,
    "kana": re.compile("[はがをにでとのもへハヲニノガス曰く]"),
    "hangul": re.compile("[은는이가을를에의고하다니라서로]"),
    "latin": _LATIN_FUNCTION,
    "vietnamese": _LATIN_FUNCTION,
}
_MODERN, _CLASSICAL = re.compile("[的了這这們们是]"), re.compile("[之也者曰其]")
_VIETNAMESE = re.compile("[ăđơưĂĐƠƯạ-ỹẠ-Ỹ]")
SPACED = ("latin", "vietnamese")
#: Lower and upper bounds of the calibrated shares, so that a language full of spam still gets sensible ones,
#: and what holds for a language of fewer than ENOUGH ordinary pages.
BOUNDS = {"phrase": (0.36, 0.55, 0.4), "gram": (0.2, 0.35, 0.35), "pair": (0.2, 0.3, 0.3), "word": (0.3, 0.53, 0.53), "repeat": (0.3, 0.85, 0.7)}
ENOUGH = 50
#: No language is taken to have a smaller share of function words in its sentences.
LEAST_USUAL = 0.1
MEASURES = "n bigint, language string, phrase double, gram double, pair double, word double, repeat double, lines double, link double, links bigint, tag double, tags bigint, marks bigint, counted bigint, pieces bigint, words bigint, distinct double, separators double, function double"


def _language(text: str) -> str:
    """By the script that most letters belong to (kana count three times, as Japanese mixes them with Han),
    the language: Han is modern where its particles outweigh the classical ones, Latin is Vietnamese by its
    letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    han = int(((codes >= 0x4E00) & (codes <= 0x9FFF) | (codes >= 0x3400) & (codes <= 0x4DBF)).sum())
    kana = 3 * int(((codes >= 0x3040) & (codes <= 0x30FF)).sum())
    hangul = 2 * int(((codes >= 0xAC00) & (codes <= 0xD7A3)).sum())
    latin = int(((codes >= 65) & (codes <= 90) | (codes >= 97) & (codes <= 122) | (codes >= 0xC0) & (codes <= 0x24F) | (codes >= 0x1E00) & (codes <= 0x1EFF)).sum()) // 3
    script = max((han, "han"), (kana, "kana"), (hangul, "hangul"), (latin, "latin"))[1]
    if script == "han":
        modern = len(_MODERN.findall(text))
        return "modern" if modern > len(_CLASSICAL.findall(text)) and modern >= 0.01 * len(text) else "classical"
    if script == "latin" and len(_VIETNAMESE.findall(text)) > 0.02 * len(text):
        return "vietnamese"
    return script


def _gram_share(text: str, size: int = 4) -> float:
    """Share of the text taken by its most frequent run of ``size`` letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 2 * size:
        return 0.0
    grams = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for k in range(size):
        grams = grams * np.uint64(1_114_112 + 1) + codes[k : len(codes) - size + 1 + k]
    grams.sort()
    edges = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1], [True])))
    return float(np.diff(edges).max()) * size / len(codes)


def measure(text: str | None) -> tuple | None:
    """The measures of one text, header lines left out; None for null, empty and blank texts."""
    if not text or not text.strip():
        return None
    lines = [s for s in (x.strip() for x in text.split("\n")) if s]
    start = 0
    while start < len(lines) and _HEADER.match(lines[start]):
        start += 1
    lines = lines[start:]
    body = "\n".join(lines)
    n = len(body)
    if not n:
        return None
    found = LINK.findall(body) if "." in body else []
    plain = LINK.sub(" ", body) if found else body
    tags = _TAG.findall(plain) if "#" in plain or "＃" in plain else []
    language = _language(plain)
    pieces = [p for p in (x.strip() for x in _BREAK.split(plain)) if p and not p.isdigit()]
    phrases = Counter(pieces)
    total = sum(len(p) * k for p, k in phrases.items()) or 1
    repeated = sorted((len(p) * k for p, k in phrases.items() if k > 1), reverse=True)
    words = Counter(_WORD.findall(plain))
    function = _FUNCTION[language]
    content = sorted((len(w) * k for w, k in words.items() if k > 1 and not (language in SPACED and function.fullmatch(w))), reverse=True)
    of_words = sum(len(w) * k for w, k in words.items()) or 1
    same = Counter(lines)
    spoken = function.findall(plain)
    return (
        n,
        language,
        sum(repeated[:8]) / total,
        _gram_share(plain),
        _gram_share("".join(_WORD.findall(plain)), 2),
        sum(content[:8]) / of_words,
        sum(len(p) * k for p, k in phrases.items() if k > 2) / total,
        sum(len(x) * k for x, k in same.items() if k > 1) / n,
        sum(map(len, found)) / n,
        len(found),
        sum(map(len, tags)) / n,
        len(tags),
        len(_MARK.findall(plain)),
        len(_COUNTED.findall(plain)),
        len(pieces),
        words.total(),
        len(words) / max(1, words.total()),
        len(_BREAK.findall(plain)) / n,
        sum(map(len, spoken)) / n,
    )


def measures(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column and the measures of each document; nothing for null, empty and blank texts."""
    kind = documents.schema[id_column].dataType.simpleString()
    names = [f.split()[0] for f in MEASURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [(i, *m) for i, t in zip(batch["id"], batch["text"]) if (m := measure(t))]
            yield pd.DataFrame(kept, columns=["id", *names])

    return (
        documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
        .where("text is not null and id is not null")
        .mapInPandas(run, f"id {kind}, {MEASURES}")
        .withColumnRenamed("id", id_column)
    )


def calibrate(measured: DataFrame) -> DataFrame:
    """One row per language: usual_function, the median share of function words; usual_separators; and for
    each share of BOUNDS the least that counts as stuffing, half as much again as 99 of 100 ordinary pages
    reach, and a little more. Shares are counted in thousandths, so quantiles are exact and their state small."""
    usual = measured.groupBy("language").agg(F.greatest(F.percentile(F.round("function", 3), 0.5), F.lit(LEAST_USUAL)).alias("usual_function"))
    ordinary = measured.join(F.broadcast(usual), "language")
    plain = F.col("function") >= 0.5 * F.col("usual_function")
    of_plain = lambda name: F.when(plain, F.round(name, 3))

    def least(name: str, low: float, high: float, few: float) -> Column:
        reached = F.percentile(of_plain(name), 0.99) * 1.5 + 0.05
        return F.when(F.count_if(plain) < ENOUGH, few).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), reached)))

    return ordinary.groupBy("language").agg(
        F.first("usual_function").alias("usual_function"),
        F.coalesce(F.percentile(of_plain("separators"), 0.5), F.percentile(F.round("separators", 3), 0.5)).alias("usual_separators"),
        *[least(n, *bounds).alias(f"least_{n}") for n, bounds in BOUNDS.items()],
    )


def find_spam(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, language, reason of documents that are mainly keywords, links or tags.

    Defined cases: null, empty and blank texts are never spam; very long texts are measured whole; rows
    repeated letter for letter are judged each; other columns are ignored; an empty table gives no rows.
    """
    measured = cut(measures(documents, id_column, text_column))
    judged = measured.join(F.broadcast(calibrate(measured)), "language")
    # How much a page has of the function words that its language usually has: 1 for ordinary pages, 0 for none.
    sentences = F.least(F.col("function") / F.col("usual_function"), F.lit(1.0))
    judged = judged.withColumn("sentences", sentences).withColumn("need", 1 + 0.35 * F.col("sentences"))
    links = "links >= 3 and link >= 0.3 and (sentences < 0.6 or link >= 0.5)"
    tags = "tags >= 5 and tag >= 0.4 and sentences < 0.6"
    products = "pieces >= 6 and (marks >= 3 and marks >= 0.15 * pieces or counted >= 4 and counted >= 0.4 * pieces) and sentences < 0.6"
    stuffed = f"pieces >= 6 and (phrase >= least_phrase * need or gram >= least_gram * need or pair >= least_pair * need and language not in {SPACED})"
    words = "words >= 12 and word >= least_word and distinct <= 0.62 and sentences < 0.25"
    mixed = "(links >= 2 and link >= 0.15 and phrase >= 0.3 or lines >= 0.6 and pieces >= 12) and sentences < 0.6"
    # Many keywords in turn: no eight of them weigh much, all together are most of the page. Long registers
    # repeat their fields too, but half of their words are names that come once.
    turns = "pieces >= 24 and distinct <= 0.3 and repeat >= least_repeat and separators >= 0.5 * usual_separators and sentences < 0.6"
    reason = F.expr(f"case when {links} then 'links' when {tags} then 'tags' when {products} then 'products' when {stuffed} then 'keywords' when {words} then 'words' when {mixed} then 'mixed' when {turns} then 'keywords' end")
    return judged.withColumn("reason", reason).where("reason is not null").select(id_column, "language", "reason")
