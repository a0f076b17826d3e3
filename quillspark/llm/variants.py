"""Variant spellings of names typed by people, linked to the person they mean.

Merge-and-rematch resolution: every person starts as a profile of spellings, in characters, in sound, as
initials and as near misses of the typed letters. Mentions that share a spelling key with a profile of a
fitting polity are checked exactly (spelling and time); a mention that fits one person best is merged: its
spellings, by-names and their initials join the profile, and what the profile gained enters blocking again,
until a round merges nothing. Mentions that mean nobody in the register are resolved among themselves the
same way: ``outside_register`` takes each name spelled out among them as a profile that the others may join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.names import Reader, han_tables, plain, wade_giles
from quillspark.session import cut

# Words typed around a name, and endings of studio and by-names (simplified characters).
_BEFORE = ("故", "臣", "释", "僧", "题", "旧题")
_AFTER = ("撰并书", "并书", "等编", "等撰", "等辑", "先生", "等", "编", "撰", "注", "辑", "译", "校", "著", "述", "纂", "公", "氏")
_STYLE = ("斋", "轩", "堂主", "居士", "老人", "山人", "散人", "道人", "主人")
_EXACT, _BYNAME, _SOUND, _SWAPPED, _INITIALS, _TYPO = 6, 5, 4, 3, 2, 1
#: A studio name with another ending counts like a swapped name.
_STUDIO = _SWAPPED
#: How far outside a known life a work's year may lie if the polity fits, by agreement; half if that is unknown.
_WITHIN = {_EXACT: 110, _BYNAME: 110, _SOUND: 90, _SWAPPED: 90, _INITIALS: 60, _TYPO: 75}


def bare_han(han: str) -> str:
    for word in _BEFORE:
        if han.startswith(word) and len(han) - len(word) >= 3:
            han = han[len(word) :]
            break
    for word in _AFTER:
        if han.endswith(word) and len(han) - len(word) >= (2 if len(word) > 1 else 3):
            return han[: -len(word)]
    return han


def stem(text: str) -> str:
    """A studio name without its ending."""
    for ending in _STYLE:
        if text.endswith(ending) and len(text) - len(ending) >= 2:
            return text[: -len(ending)]
    return text


def undoubled(text: str) -> str:
    """The text with characters repeated in a row typed once."""
    return "".join(c for i, c in enumerate(text) if not i or c != text[i - 1])


def near(text: str) -> set[str]:
    """The text and what is left when one letter is deleted: two texts one slip apart share one."""
    return {text} | {text[:i] + text[i + 1 :] for i in range(len(text))}


def one_slip(a: str, b: str) -> bool:
    """One letter added, lost, changed, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def letters_of(reader: Reader, han: str) -> list[str]:
    """A name in bare pinyin and Wade-Giles letters."""
    read = reader.read(han)
    return ["".join(read), "".join(map(wade_giles, read)).replace("'", "")]


def keys_of(reader: Reader, han: list[str], bynames: list[str], sounds: list[str] = ()) -> list[str]:
    """Blocking keys of a profile's spellings."""
    keys = set()
    for h in han:
        surname, given = reader.surname_of(h), h[len(reader.surname_of(h)) :]
        keys |= {f"h:{h}", f"k:{reader.key_of(h)}", f"m:{surname}{''.join(sorted(given))}", f"u:{undoubled(h)}", "i:{}|{}".format(*reader.initials_of(h))}
        for letters in letters_of(reader, h):
            keys |= {f"d:{x}" for x in near(letters)}
    keys |= {f"h:{b}" for b in bynames} | {f"k:{reader.key_of(b)}" for b in bynames} | {f"k:{s}" for s in sounds} | {f"s:{stem(b)}" for b in bynames}
    return sorted(keys)


def read_mention(reader: Reader, text: str | None) -> dict | None:
    """The readings of a typed name: han, parts (names it may contain), sounds, letters, initials, extra."""
    name = reader.name(text)
    if name is None:
        return None
    letters: list[str] = []
    parts: list[str] = []
    han = bare_han(name["han"]) if name["han"] else None
    if han and len(han) > 4:
        parts = [han[-n:] for n in (2, 3, 4)] + [han[:n] for n in (2, 3, 4)]
    if not han and not name["initials"]:
        tokens = [t for t in re.split(r"[^a-z]+", plain(reader.clean(text)).replace("'", "").replace("-", "")) if t]
        letters = list(dict.fromkeys("".join(tokens[k:] + tokens[:k]) for k in range(max(1, len(tokens)))))
    return {"han": han, "parts": parts, "sounds": name["keys"] if not han else [reader.key_of(han)], "letters": letters, "initials": "{}|{}".format(*name["initials"]) if name["initials"] else None, "extra": name["extra"]}


def mention_keys(reader: Reader, m: dict) -> list[str]:
    keys = {f"k:{s}" for s in m["sounds"]} | {f"d:{x}" for t in m["letters"] for x in near(t)} | {f"h:{p}" for p in m["parts"]}
    if m["han"]:
        surname, given = reader.surname_of(m["han"]), m["han"][len(reader.surname_of(m["han"])) :]
        keys |= {f"h:{m['han']}", f"m:{surname}{''.join(sorted(given))}", f"u:{undoubled(m['han'])}"}
        if stem(m["han"]) != m["han"]:
            keys.add(f"s:{stem(m['han'])}")
    if m["initials"]:
        keys.add(f"i:{m['initials']}")
    return sorted(keys)


def agreement(reader: Reader, m: dict, names: list[str], bynames: set[str]) -> int:
    """How well a mention's readings agree with a profile's full names and by-names; 0 for not at all."""
    best = 0
    for h in names:
        if m["han"]:
            if m["han"] == h:
                return _EXACT
            if m["han"] in bynames:
                best = max(best, _BYNAME)
            elif stem(m["han"]) != m["han"] and any(stem(m["han"]) == stem(b) for b in bynames):
                best = max(best, _STUDIO)
            for part in m["parts"]:
                rest = m["han"].replace(part, "", 1)
                if part == h and (rest in bynames or rest in _BEFORE or rest in _AFTER or rest.endswith(_STYLE) or reader.is_polity(rest)):
                    best = max(best, _BYNAME)
            if m["sounds"][0] == reader.key_of(h):
                best = max(best, _SOUND)
            surname = reader.surname_of(h)
            if m["han"].startswith(surname) and len(h) - len(surname) > 1 and sorted(m["han"]) == sorted(h):
                best = max(best, _SWAPPED)
            if undoubled(m["han"]) == undoubled(h):
                best = max(best, _SWAPPED)
        elif m["initials"]:
            if m["initials"] == "{}|{}".format(*reader.initials_of(h)):
                best = max(best, _INITIALS)
        else:
            if reader.key_of(h) in m["sounds"]:
                best = max(best, _SOUND)
            elif any(one_slip(a, b) for a in m["letters"] for b in letters_of(reader, h)):
                best = max(best, _TYPO)
    return best


def variant_agreement(reader: Reader, m: dict, bynames: list[str], spelled: list[str], letters: list[str]) -> int:
    """The agreement with what a profile has besides its name: by-names and merged spellings in characters,
    read like names with their initials, and merged spellings in letters. Initials and slips of by-names do
    not count: by-names are built from a few dozen characters, so that any initials meet some by chance."""
    best = agreement(reader, m, bynames, set())
    best = max(best if best >= _SWAPPED else 0, agreement(reader, m, spelled, set()))
    if not best and any(one_slip(a, b) for a in m["letters"] for b in letters):
        return _TYPO
    return best


def variant_keys(reader: Reader, han: list[str], letters: list[str]) -> list[str]:
    """Blocking keys of by-names and merged spellings: as names, and by the letters as typed."""
    return sorted({*keys_of(reader, han, []), *(f"d:{x}" for text in letters for x in near(text))})


def time_gap(year: float | None, start: float | None, end: float | None) -> float | None:
    """Years between a work and a life; 0 inside; None if unknown. A missing end leaves 90 years."""
    if year is None or year != year or (start is None or start != start) and (end is None or end != end):
        return None
    low = end - 90 if start is None or start != start else start
    high = start + 90 if end is None or end != end else end
    return max(low - year, year - high, 0)


def fits(level: int, same_polity: bool | None, gap: float | None) -> bool:
    """The exact check: spelled-out names may lie further from the life than guesses."""
    if level == 0 or same_polity is False:
        return False
    if gap is None:
        return bool(same_polity) or level >= _BYNAME
    if same_polity:
        return gap <= _WITHIN[level]
    return gap <= _WITHIN[level] // 2


_MENTION = "mention_no bigint, text string, polity string, year double, keys array<string>"
_PROFILE = "person_no bigint, names array<string>, bynames array<string>, spelled array<string>, letters array<string>, polity string, year_start double, year_end double, keys array<string>"


def _asked(key: str, polity: str) -> Column:
    """The blocks that a mention asks: its polity's and those of persons of unknown polity; one of unknown
    polity asks the block of all. Initials, which many share, are cut by century where the year is known."""
    of = F.when(F.col(polity).isNull(), F.array(F.lit("*"))).otherwise(F.array(polity, F.lit("")))
    century = F.when(F.col(key).startswith("i:"), F.coalesce(F.floor(F.col("year") / 100).cast("string"), F.lit("*"))).otherwise(F.lit(""))
    return F.transform(of, lambda x: F.concat(x, F.lit("|"), century))


def _entered(key: str, polity: str) -> Column:
    """The blocks that a profile enters: its polity's (or that of unknown polity) and that of all; with
    initials, those of the centuries in which a work may name it, and of unknown year."""
    of = F.array(F.coalesce(polity, F.lit("")), F.lit("*"))
    low, high = F.coalesce(F.col("year_start"), F.col("year_end") - 90), F.coalesce(F.col("year_end"), F.col("year_start") + 90)
    margin = _WITHIN[_INITIALS]
    lived = F.sequence(F.floor((F.least(low, high) - margin) / 100), F.floor((F.greatest(low, high) + margin) / 100))
    known = F.concat(F.transform(lived, lambda c: c.cast("string")), F.array(F.lit("*")))
    # Without any year a profile fits in every century: it enters those in which anything is dated.
    every = F.concat(F.transform(F.sequence(F.lit(-50), F.lit(30)), lambda c: c.cast("string")), F.array(F.lit("*")))
    centuries = F.when(F.col(key).startswith("i:"), F.when(low.isNull() | F.isnan(low) | F.isnan(high), every).otherwise(known)).otherwise(F.array(F.lit("")))
    return F.flatten(F.transform(of, lambda x: F.transform(centuries, lambda c: F.concat(x, F.lit("|"), c))))


def outside_register(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """mentions as in link_mentions, and the links found -> mention_no, meaning: mentions that name somebody
    outside the register, with the smallest mention_no that spells out the name of the person they mean.

    A name spelled out in characters is a profile of its own polity, dated by the years of its works; mentions
    in other spellings join it by the same merging and rematching. Mentions that fit several names stay alone.
    """
    spark = mentions.sparkSession
    tables = spark.sparkContext.broadcast(han_tables(spark))
    rest = cut(mentions.join(links.select("mention_no"), "mention_no", "left_anti").select("mention_no", "text", "polity", "year").dropDuplicates(["mention_no"]))

    def spelled_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(tables.value)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                m = read_mention(reader, r.text)
                if m and m["han"] and not m["parts"] and stem(m["han"]) == m["han"]:
                    out.append((r.mention_no, m["han"], r.polity, r.year))
            yield pd.DataFrame(out, columns=["mention_no", "name", "polity", "year"]).astype({"mention_no": "int64"})

    year = F.col("year").cast("double").alias("year")
    named = rest.where("mention_no is not null and text is not null").select("mention_no", "text", "polity", year).mapInPandas(spelled_out, "mention_no bigint, name string, polity string, year double")
    seeds = named.groupBy("name", "polity").agg(F.min("mention_no").alias("person_no"), (F.min("year") - 30).alias("year_start"), (F.max("year") + 30).alias("year_end"))
    joined = link_mentions(rest, seeds.withColumn("other_names", F.lit(None).cast("string")))
    return joined.select("mention_no", F.col("person_no").alias("meaning"))


def link_mentions(mentions: DataFrame, persons: DataFrame, rematch: bool = True) -> DataFrame:
    """mentions: mention_no, text, polity, year. persons: person_no, name, other_names (packed), polity,
    year_start, year_end. Returns mention_no, person_no, agreement (1-6), round.

    Defined cases: a row repeated letter for letter counts once; null, blank and "name unknown" mean
    nobody; a mention that fits several persons equally well means none; unknown polities and years neither
    help nor hinder; very long names are keyed by their ends only when over four characters; extra columns
    are ignored; empty tables give no rows. Keys carry the polity, so that a name of a third of all rows is
    split by polity; a mention of unknown polity asks a block that every person enters. Without ``rematch``
    only the first round is made, for comparison.
    """
    spark = mentions.sparkSession
    tables = spark.sparkContext.broadcast(han_tables(spark))

    def read_persons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(tables.value)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                name = reader.name(r.name)
                if name is None or not name["han"]:
                    continue
                han = name["han"]
                bynames = sorted({*reader.aliases(r.other_names, han), *name["extra"], *(reader.surname_of(han) + x for x in name["extra"])} - {han})
                out.append((r.person_no, [han], bynames, [], [], reader.polity(r.polity), r.year_start, r.year_end, keys_of(reader, [han], bynames)))
            yield pd.DataFrame(out, columns=["person_no", "names", "bynames", "spelled", "letters", "polity", "year_start", "year_end", "keys"])

    def read_mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(tables.value)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                m = read_mention(reader, r.text)
                if m:
                    out.append((r.mention_no, r.text, reader.polity(r.polity), r.year, mention_keys(reader, m)))
            yield pd.DataFrame(out, columns=["mention_no", "text", "polity", "year", "keys"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(tables.value)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                m = read_mention(reader, r.text)
                level = agreement(reader, m, list(r.names), set(r.bynames)) if m else 0
                direct = int(level > 0)
                if m and r.wide and not level:
                    level = variant_agreement(reader, m, list(r.bynames), list(r.spelled), list(r.letters))
                same = None if r.polity is None or r.of_person is None else r.polity == r.of_person
                gap = time_gap(r.year, r.year_start, r.year_end)
                if fits(level, same, gap):
                    out.append((r.mention_no, r.person_no, direct, level, 2 * (same is True) + (gap == 0)))
            yield pd.DataFrame(out, columns=["mention_no", "person_no", "direct", "agreement", "context"]).astype({"mention_no": "int64", "person_no": "int64", "direct": "int32", "agreement": "int32", "context": "int32"})

    def gained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a merged mention brings to its profile: by-names, and its spelling in characters or letters."""
        reader = Reader(tables.value)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                m = read_mention(reader, r.text)
                new = set(m["extra"]) if m else set()
                for part in m["parts"] if m else ():
                    rest = m["han"].replace(part, "", 1)
                    if part in r.names and len(rest) >= 2 and not reader.is_polity(rest):
                        new.add(rest)
                surname = reader.surname_of(r.names[0])
                new |= {surname + x for x in new if not x.startswith(surname)}
                out += [(r.person_no, "byname", x) for x in sorted(new - set(r.bynames) - set(r.names))]
                if m and m["han"] and not m["parts"] and m["han"] not in {*r.names, *r.bynames, *r.spelled}:
                    out.append((r.person_no, "spelled", m["han"]))
                known = {*r.letters, *(x for h in r.names for x in letters_of(reader, h))}
                out += [(r.person_no, "letters", x) for x in (m["letters"] if m else ()) if x not in known]
            yield pd.DataFrame(out, columns=["person_no", "kind", "value"]).astype({"person_no": "int64"})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(tables.value)
        for batch in batches:
            out = [(r.person_no, key) for r in batch.itertuples(index=False) for key in variant_keys(reader, list(r.han), list(r.letters))]
            yield pd.DataFrame(out, columns=["person_no", "key"]).astype({"person_no": "int64"})

    one_person = persons.where("person_no is not null and name is not null").select("person_no", "name", "other_names", "polity", F.col("year_start").cast("double").alias("year_start"), F.col("year_end").cast("double").alias("year_end"))
    profiles = cut(one_person.dropDuplicates(["person_no"]).mapInPandas(read_persons, _PROFILE))
    one_mention = mentions.where("mention_no is not null and text is not null").select("mention_no", "text", "polity", F.col("year").cast("double").alias("year"))
    waiting = cut(one_mention.dropDuplicates(["mention_no"]).mapInPandas(read_mentions, _MENTION))

    asking = waiting.select("mention_no", "polity", "year", F.explode("keys").alias("key")).select("mention_no", "key", F.explode(_asked("key", "polity")).alias("of"))
    entering = profiles.select("person_no", "polity", "year_start", "year_end", F.explode("keys").alias("key")).select("person_no", "key", F.explode(_entered("key", "polity")).alias("of"))

    none = F.array().cast("array<string>")
    life = ["person_no", "polity", "year_start", "year_end"]
    # By-names and merged spellings are first compared exactly only; once that merges nothing more, they are
    # compared like names with the mentions that fit nobody so far, so that they never outdo a name.
    links, fitted, wide, turn = None, None, False, 1
    while True:
        open_mentions = waiting
        if links is not None:
            open_mentions = waiting.join((fitted if wide else links).select("mention_no"), "mention_no", "left_anti")
        pairs = asking.join(entering, ["key", "of"]).select("mention_no", "person_no").distinct()
        judged = (
            pairs.join(open_mentions.select("mention_no", "text", "polity", "year"), "mention_no")
            .join(profiles.select("person_no", "names", "bynames", "spelled", "letters", F.col("polity").alias("of_person"), "year_start", "year_end"), "person_no")
            .withColumn("wide", F.lit(wide))
            .mapInPandas(judge, "mention_no bigint, person_no bigint, direct int, agreement int, context int")
        )
        best = Window.partitionBy("mention_no")
        ranked = cut(judged.withColumn("score", F.struct("direct", "agreement", "context")).withColumn("top", F.max("score").over(best)).where("score = top").withColumn("rivals", F.count("*").over(best)))
        merged = ranked.where("rivals = 1").select("mention_no", "person_no", "agreement", F.lit(turn).alias("round"))
        links = merged if links is None else links.unionByName(merged)
        if not rematch:
            return links
        fit = ranked.select("mention_no").distinct()
        fitted = fit if fitted is None else fitted.unionByName(fit)
        new = cut(
            merged.join(waiting.select("mention_no", "text"), "mention_no")
            .join(profiles.select("person_no", "names", "bynames", "spelled", "letters"), "person_no")
            .mapInPandas(gained, "person_no bigint, kind string, value string")
            .distinct()
        )
        some = new.where("true" if wide else "kind = 'byname'").take(1)
        if wide and not some:
            return links
        more = new.groupBy("person_no").pivot("kind", ["byname", "spelled", "letters"]).agg(F.sort_array(F.collect_set("value"))).toDF("person_no", "b", "s", "l")
        profiles = cut(profiles.join(more, "person_no", "left").withColumns({c: F.array_union(c, F.coalesce(x, none)) for c, x in (("bynames", "b"), ("spelled", "s"), ("letters", "l"))}).drop("b", "s", "l"))
        # Only what profiles gained enters blocking again; what they had has met every mention already.
        if some and not wide:
            gains = new.where("kind = 'byname'").select("person_no", F.concat(F.lit("h:"), "value").alias("key"))
        else:
            gained_now = more.select("person_no", F.concat(F.coalesce("b", none), F.coalesce("s", none)).alias("han"), F.coalesce("l", none).alias("letters")) if wide else profiles.select("person_no", F.concat("bynames", "spelled").alias("han"), "letters")
            gains = gained_now.mapInPandas(enter, "person_no bigint, key string")
            wide = True
        entering = gains.join(profiles.select(*life), "person_no").select("person_no", "key", F.explode(_entered("key", "polity")).alias("of"))
        turn += 1
