"""Names of people as typed: Han characters of either script, pinyin, Wade-Giles, initials, reordered parts.

Character readings and simplified forms come from the ICU library inside Spark itself (Han-Latin and
Traditional-Simplified transliterators), so their tables are built from a rule at run time; they hold one
entry per character of the CJK blocks, whatever the data.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession

from quillspark.llm.lookalike import CYRILLIC, GREEK, KATAKANA

# Surnames of two characters, simplified.
DOUBLE_SURNAMES = frozenset("诸葛 司空 令狐 上官 皇甫 南宫 东里 欧阳 司马 夏侯 公孙 东方 尉迟 长孙 慕容 宇文 司徒 鲜于 闻人 公冶 申屠 钟离 独孤 端木 西门 东郭 百里 呼延 太史 赫连 澹台 公羊 濮阳 淳于 单于 轩辕".split())
# Initials of pinyin syllables and their Wade-Giles spelling.
WADE_GILES = (("zh", "ch"), ("ch", "ch'"), ("sh", "sh"), ("q", "ch'"), ("j", "ch"), ("x", "hs"), ("z", "ts"), ("c", "ts'"), ("b", "p"), ("p", "p'"), ("d", "t"), ("t", "t'"), ("g", "k"), ("k", "k'"), ("r", "j"))
# Polities, each line one polity under all its names (simplified characters).
POLITIES = """
汉 大汉 汉朝 Han
唐 大唐 李唐 唐朝 Tang
宋 大宋 赵宋 宋朝 Song
元 大元 蒙元 元朝 Yuan
明 大明 朱明 明朝 Ming
清 大清 满清 清朝 Qing
高丽 高丽国 高丽时代 Goryeo
朝鲜 朝鲜国 李氏朝鲜 朝鲜时代 Joseon
平安 平安朝 平安时代 Heian
江户 江户时代 江戸时代 德川 Edo
陈朝 大越陈朝 Tran
后黎 后黎朝 黎朝 Later_Le
阮 阮朝 大南 Nguyen
琉球 琉球国 琉球王国 中山 Ryukyu
"""
# Names that say no name.
NAMELESS = frozenset("佚名 不详 未详 无名氏 阙名 失名 未知 不明 anonymous unknown".split())

_SYLLABLE = re.compile(r"(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ong|ing|ian|iao|uai|uan|uen|ai|ao|an|ei|en|er|ia|ie|in|iu|ou|ua|ue|ui|un|uo|a|e|i|o|u)")
_LOOKS = {ord(a): b for x in (CYRILLIC, GREEK) for a, b in zip(*x)}
_KANA = {ord(a): b for a, b in zip(*KATAKANA)}
_NUMERALS = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}


def plain(text: str) -> str:
    """Latin letters in lower case without marks; ü is u, any apostrophe is '."""
    text = text.strip().lower().replace("ü", "u").replace("’", "'").replace("‘", "'").replace("ʻ", "'")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def han_tables(spark: SparkSession) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(traditional -> simplified, character -> reading, surname -> reading) of the CJK blocks."""
    blocks = [chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000))]
    named = spark._jvm.com.ibm.icu.text.Transliterator
    every = "\n".join(blocks)
    simple, read, surname = (named.getInstance(i).transliterate(every).split("\n") for i in ("Traditional-Simplified", "Han-Latin", "Han-Latin/Names"))
    return (
        {a: b for a, b in zip(blocks, simple) if a != b and len(b) == 1},
        {a: plain(b) for a, b in zip(blocks, read) if a != b},
        {a: plain(b) for a, b, c in zip(blocks, surname, read) if b != c},
    )


def syllables(word: str) -> tuple[str, ...] | None:
    """A pinyin word cut into syllables, longest first, or None."""
    if not word:
        return ()
    ends = sorted({e for e in range(1, min(len(word), 6) + 1) if _SYLLABLE.fullmatch(word[:e])}, reverse=True)
    for e in ends:
        rest = syllables(word[e:])
        if rest is not None:
            return (word[:e], *rest)
    return None


def wade_giles(syllable: str) -> str:
    """A pinyin syllable with the Wade-Giles initial."""
    for pinyin, other in WADE_GILES:
        if syllable.startswith(pinyin):
            return other + syllable[len(pinyin) :]
    return syllable


def number(text: str) -> int | None:
    if text.isascii() and text.isdigit():
        return int(text)
    total = digit = 0
    positional = not any(c in "十百" for c in text)
    for c in text:
        if c == "百":
            total, digit = total + max(digit, 1) * 100, 0
        elif c == "十":
            total, digit = total + max(digit, 1) * 10, 0
        elif c in _NUMERALS:
            digit = digit * 10 * positional + _NUMERALS[c]
        else:
            return None
    return total + digit


class Reader:
    """Reads names, polities and citations in one task."""

    def __init__(self, tables: tuple[dict[str, str], dict[str, str], dict[str, str]]):
        simple, self.reading, self.surname = tables
        self.simple = {ord(a): b for a, b in simple.items()}
        self.polities = {name.replace("_", " ").lower(): line.split()[0] for line in POLITIES.strip().splitlines() for name in line.split()}

    def clean(self, text: str | None) -> str:
        """Half-width, composed, without invisible characters, look-alikes replaced, simplified, trimmed."""
        if not text or text != text:
            return ""
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F and not 0xE0100 <= ord(c) <= 0xE01EF)
        if re.search("[㐀-鿿]", text):
            text = text.translate(_KANA)
        elif re.search("[A-Za-z]", text):
            text = text.translate(_LOOKS)
        return re.sub(r"\s+", " ", text.translate(self.simple)).strip()

    def read(self, word: str) -> list[str]:
        """Pinyin of Han characters; the first is read as a surname."""
        double = word[:2] in DOUBLE_SURNAMES
        return [(self.surname.get(c) if i == 0 and not double else None) or self.reading.get(c, c) for i, c in enumerate(word)]

    def surname_of(self, han: str) -> str:
        return han[:2] if len(han) > 2 and han[:2] in DOUBLE_SURNAMES else han[:1]

    def polity(self, text: str | None) -> str | None:
        """One name per polity; of several, the first."""
        first = re.split(r"[;；、,，/]", self.clean(text))[0].strip().lower()
        return self.polities.get(first, first) or None

    def is_polity(self, text: str) -> bool:
        return self.clean(text).lower() in self.polities

    def name(self, text: str | None) -> dict | None:
        """What a typed name says: han (or None), keys (its spellings in sound, one per possible order of
        the parts), extra (a name in brackets or after a space), initials ((surname, letters) or None).
        Brackets around a polity, numbers and words for editing are left out. None if nobody is named."""
        text = self.clean(text)
        text = re.sub(r"^[\[(【〔（]([^\])】〕）]*)[\])】〕）]", lambda m: "" if self.is_polity(m[1]) else m[0], text)
        parts = re.split(r"[·・]", text)
        if len(parts) > 1 and self.is_polity(parts[0]):
            text = " ".join(parts[1:])
        extra = []
        for inner in re.findall(r"[(（\[]([^)）\]]*)[)）\]]", text):
            if re.fullmatch("[㐀-鿿]{2,}", inner.strip()) and not self.is_polity(inner):
                extra.append(inner.strip())
        text = re.sub(r"[(（\[][^)）\]]*[)）\]]", " ", text).strip(" ,，、;；.．。:：·?？")
        if not text or text.lower().replace(" ", "") in NAMELESS:
            return None
        if re.search("[㐀-鿿]", text):
            words = [w for w in re.split(r"[\s.．·・,，、]+", text) if w]
            if len(words) > 1 and self.is_polity(words[0]):
                words = words[1:]
            if len(words) == 1 and (styled := re.fullmatch("([㐀-鿿]{2,4})[字号]([㐀-鿿]{2,4})", words[0])):
                words, extra = [styled[1]], [*extra, styled[2]]
            if len(words) > 1 and len(words[0]) >= 2 and words[0] not in DOUBLE_SURNAMES:
                extra += [w for w in words[1:] if re.fullmatch("[㐀-鿿]{2,}", w)]
                words = words[:1]
            han = "".join(words)
            if not re.fullmatch("[㐀-鿿]+", han) or han in NAMELESS:
                return None
            return {"han": han, "keys": [self.key_of(han)], "extra": extra, "initials": None}
        raw = plain(text)
        marked = re.search(r"\.", raw) or re.fullmatch(r"[a-z']+,?( [a-z]\.?)+", raw)
        tokens = [t for t in re.split(r"[\s,.]+", raw) if t]
        if not tokens or not all(re.fullmatch("[a-z'-]+", t) for t in tokens):
            return None
        if marked and len(tokens) > 1 and sum(len(t) == 1 for t in tokens) >= len(tokens) - 1:
            long = [t for t in tokens if len(t) > 1]
            letters = "".join(t for t in tokens if len(t) == 1)
            return {"han": None, "keys": [], "extra": [], "initials": (self.sound(long[0], "-" in raw or "'" in raw), letters)} if long else None
        wade = any("-" in t or "'" in t for t in tokens)
        sounds = [self.sound(t, wade) for t in tokens]
        keys = ["".join(sounds)] + ["".join(sounds[k:] + sounds[:k]) for k in range(1, len(sounds))]
        return {"han": None, "keys": list(dict.fromkeys(keys)), "extra": [], "initials": None}

    def sound(self, word: str, wade: bool) -> str:
        if wade:
            return word.replace("-", "")
        cut = syllables(word.replace("'", ""))
        return "".join(map(wade_giles, cut)) if cut else word

    def key_of(self, han: str) -> str:
        return "".join(map(wade_giles, self.read(han)))

    def initials_of(self, han: str) -> tuple[str, str]:
        surname = self.surname_of(han)
        read = self.read(han)
        return "".join(map(wade_giles, read[: len(surname)])), "".join(r[0] for r in read[len(surname) :])

    def citations(self, text: str | None) -> list[str]:
        """title#volume of each line that cites a volume."""
        found = set()
        for line in (text or "").split("\n"):
            line = self.clean(line)
            title = re.match(r"^[见《\s]*([㐀-鿿]+?)》?(?:卷|第|[,．.]|\s|$)", line)
            volume = re.search(r"(?:卷|第|juan\s*|\s)([0-9]+|[一二三四五六七八九十百〇零]+)", line)
            if title and volume and (n := number(volume[1])) is not None:
                found.add(f"{title[1]}#{n}")
        return sorted(found)

    def values(self, text: str | None) -> list[str]:
        """A packed field's values, brackets' content left out, simplified."""
        return sorted({v for p in re.split(r"[;；、,，/／|｜\t\n]", re.sub(r"[(（][^)）]*[)）]", "", self.clean_lines(text))) if (v := p.strip(" \"“”「」'"))})

    def clean_lines(self, text: str | None) -> str:
        return "\n".join(self.clean(x) for x in (text or "").replace("\t", "\n").split("\n"))

    def aliases(self, text: str | None, han: str | None) -> list[str]:
        """Han spellings of a person from the aliases: each alias as it is, and with the surname where that
        is not there already; posthumous and childhood markers taken off."""
        out = set()
        for value in self.values(text):
            value = re.sub('^(?:谥|小字|号|字)', "", value).strip(" \"“”「」")
            if re.fullmatch("[㐀-鿿]{2,}", value):
                out.add(value)
                if han and not value.startswith(self.surname_of(han)):
                    out.add(self.surname_of(han) + value)
        return sorted(out)
