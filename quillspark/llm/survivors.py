"""The best representative of each group of duplicate records.

Field by field, the values of a group are aligned token by token, progressively: the heaviest value starts
the profile, each further one is aligned to it and adds its weight to the tokens of its columns. Each column
elects its heaviest token (or none), and the existing value closest to that consensus is emitted.

How much a record weighs is what its group says of it: (n + 1) ** k in a group of n records, k counting where
it is best of the group: most complete, most trusted, most recent. A record that is best in all three so
outvotes all others together. The role and the time of a record are voted on like its fields. The surviving
record is the one closest to the consensus of all of them. Where one record is best in all three and every
other is worse in one, that record survives: the consensus says what it says, it lacks the fewest values, and
each other record lacks more or differs in trust or time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import cut

#: Distinct values that one task aligns at once; more are aligned in parts whose profiles are aligned again.
PART = 64
# What a field says when nothing is known.
UNKNOWN = ("", "不詳", "未詳", "不明", "佚名", "無名氏", "未知", "闕名", "失名", "—", "-", "–", "?", "？", "(unknown / unclassified)", "(unknown)", "unknown", "anonymous", "n/a", "none", "null")

_TOKEN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ']+|\d+|\S")
Profile = list[dict[str, float]]


def says_something(column: Column) -> Column:
    """True where a text is neither null, blank nor a word for unknown."""
    space = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"
    plain = F.lower(F.regexp_replace(column.cast("string"), f"^{space}|{space}$", ""))
    return F.coalesce(~plain.isin(*UNKNOWN), F.lit(False))


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def align(a: Profile, b: Profile) -> Profile:
    """Two profiles aligned by dynamic programming: what a column of b adds to a column of a is the weight
    of their common tokens, a gap adds nothing. Columns keep the token weights of both; '' is a gap."""
    n, m = len(a), len(b)
    weight_a, weight_b = _weight(a), _weight(b)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, column = score[i], score[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            common = sum(min(w, column[t]) for t, w in b[j].items() if t and t in column)
            row[j] = max(common + below[j + 1] if common else below[j + 1] - 1e-9, below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m:
            common = sum(min(w, a[i][t]) for t, w in b[j].items() if t and t in a[i])
            diagonal = common + score[i + 1][j + 1] if common else score[i + 1][j + 1] - 1e-9
            if diagonal >= score[i + 1][j] and diagonal >= score[i][j + 1]:
                column = dict(a[i])
                for t, w in b[j].items():
                    column[t] = column.get(t, 0.0) + w
                out.append(column)
                i, j = i + 1, j + 1
                continue
        if j >= m or i < n and score[i + 1][j] >= score[i][j + 1]:
            out.append(a[i] | {"": a[i].get("", 0.0) + weight_b})
            i += 1
        else:
            out.append(b[j] | {"": b[j].get("", 0.0) + weight_a})
            j += 1
    return out


def _weight(profile: Profile) -> float:
    return sum(profile[0].values()) if profile else 0.0


def progressive(values: list[tuple[str, float]]) -> Profile:
    """The profile of weighted values, heaviest first, ties by the value itself."""
    profile: Profile = []
    for value, weight in sorted(values, key=lambda x: (-x[1], x[0])):
        one = [{t: weight} for t in tokens(value)]
        profile = align(profile, one) if profile else one
    return profile


def consensus(profile: Profile) -> list[str]:
    """The elected token of each column, ties to the token that sorts first, gaps left out."""
    elected = (min(column.items(), key=lambda x: (-x[1], x[0]))[0] for column in profile)
    return [t for t in elected if t]


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance of token lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of values or of profiles -> one profile each, columns as (tokens, weights)."""
    for batch in batches:
        out = []
        for group, field, part, values, profiles in batch[["group_id", "field", "part", "values", "profiles"]].itertuples(index=False):
            if values is not None:
                profile = progressive([(v["value"], v["weight"]) for v in values])
            else:
                read = sorted((json.loads(p) for p in profiles), key=lambda p: (-_weight(p), str(p)))
                profile = read[0]
                for other in read[1:]:
                    profile = align(profile, other)
            out.append((group, field, part, json.dumps(profile), consensus(profile)))
        yield pd.DataFrame(out, columns=["group_id", "field", "part", "profile", "consensus"])


def field_consensus(values: DataFrame) -> DataFrame:
    """values (group_id, field, value, weight), distinct values with their summed weight -> group_id, field,
    consensus (array of tokens). Groups of any number of values: parts of about PART values are aligned
    where they lie and their profiles aligned again, until one is left for each group and field."""
    sizes = values.groupBy("group_id", "field").agg(F.count("*").alias("size"))
    dealt = values.join(sizes, ["group_id", "field"]).withColumn("parts", F.ceil(F.col("size") / PART)).withColumn("part", F.pmod(F.xxhash64("value"), F.col("parts")))
    schema = "group_id string, field string, part bigint, profile string, consensus array<string>"
    parts = cut(
        dealt.groupBy("group_id", "field", "part")
        .agg(F.collect_list(F.struct("value", "weight")).alias("values"))
        .withColumn("profiles", F.lit(None).cast("array<string>"))
        .mapInPandas(_profiles, schema)
    )
    most = parts.agg(F.max("part")).first()[0] or 0
    while most > 0:
        parts = cut(
            parts.withColumn("part", F.floor(F.col("part") / PART))
            .groupBy("group_id", "field", "part")
            .agg(F.collect_list("profile").alias("profiles"))
            .withColumn("values", F.lit(None).cast("array<struct<value: string, weight: double>>"))
            .mapInPandas(_profiles, schema)
        )
        most = int(most) // PART
    return parts.select("group_id", "field", "consensus")


@F.pandas_udf(T.DoubleType())
def _token_distance(value: pd.Series, elected: pd.Series) -> pd.Series:
    """Token edits between a value and the consensus as a share of the longer one: 0 the same, 1 all other."""
    out = []
    for v, c in zip(value, elected):
        own, other = tokens(v), list(c)
        out.append(distance(own, other) / max(len(own), len(other), 1))
    return pd.Series(out, dtype="float64")


def best_representatives(members: DataFrame, fields: list[str], trusted: Column, recent: Column) -> DataFrame:
    """The survivor of each group.

    members: group_id, member_id (strings) and the fields; a member repeated in a group counts by its most
    recent row. trusted: an int column, more is better. recent: a timestamp column, later is better.
    Returns group_id, member_id, survivor_id, completeness, and best, a map field -> the group's existing
    value closest to the token consensus. Groups of one member are left out.

    Defined cases: null group_id or member_id: the row is left out; nulls, blanks and words for unknown are
    no values (a group without any value has an empty map) and lie as far from a consensus as can be; records
    equally close to the consensus: the smaller member_id survives; groups of any size: values are counted and
    aligned in parts, the survivor is a map-side combined minimum; extra columns are ignored, clashing names
    too, as all but the fields are renamed.
    """
    said = [F.when(says_something(F.col(f)), F.trim(F.col(f).cast("string"))).alias(f) for f in fields]
    rows = members.where("group_id is not null and member_id is not null").select(
        F.col("group_id").cast("string").alias("group_id"), F.col("member_id").cast("string").alias("member_id"), F.coalesce(trusted.cast("int"), F.lit(0)).alias("_trusted"), recent.alias("_recent"), *said
    )
    names = ["_recent", "_trusted", *fields]
    latest = rows.groupBy("group_id", "member_id").agg(F.max(F.struct(*names)).alias("r")).select("group_id", "member_id", *[F.col(f"r.{n}").alias(n) for n in names])
    known = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    latest = latest.withColumn("completeness", known)
    tops = latest.groupBy("group_id").agg(F.count("*").alias("_n"), F.max("completeness").alias("_c"), F.max("_trusted").alias("_t"), F.max("_recent").alias("_r")).where("_n > 1")
    best_in = sum((F.coalesce(F.col(x) == F.col(y), F.lit(False)).cast("int") for x, y in (("completeness", "_c"), ("_trusted", "_t"), ("_recent", "_r"))), F.lit(0))
    kept = cut(latest.join(tops, "group_id").withColumn("weight", F.pow(F.col("_n") + 1.0, best_in)).drop("_n", "_c", "_t", "_r"))

    voted = [(f, F.col(f)) for f in fields] + [("_trusted", F.col("_trusted").cast("string")), ("_recent", F.col("_recent").cast("string"))]
    pairs = kept.select("group_id", "member_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in voted])).alias("x"), "weight")
    pairs = pairs.select("group_id", "member_id", "x.field", "x.value", "weight").where("value is not null")
    values = pairs.groupBy("group_id", "field", "value").agg(F.sum("weight").alias("weight"))
    far = cut(values.join(field_consensus(values), ["group_id", "field"]).withColumn("far", _token_distance("value", "consensus")).select("group_id", "field", "value", "weight", "far"))
    best = (
        far.where(F.col("field").isin(*fields))
        .groupBy("group_id", "field")
        .agg(F.min(F.struct("far", (-F.col("weight")).alias("w"), "value")).alias("b"))
        .groupBy("group_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("b.value").alias("value"))))).alias("best"))
    )
    # What a record does not say is 1 away; fields that nobody in the group fills are so for all.
    closeness = pairs.join(far.select("group_id", "field", "value", "far"), ["group_id", "field", "value"]).groupBy("group_id", "member_id").agg(F.round(F.sum(F.col("far") - 1), 9).alias("far"))
    survivors = closeness.groupBy("group_id").agg(F.min(F.struct("far", "member_id")).alias("s")).select("group_id", F.col("s.member_id").alias("survivor_id"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return (
        kept.select("group_id", "member_id", "completeness")
        .join(survivors, "group_id")
        .join(best, "group_id", "left")
        .select("group_id", "member_id", "survivor_id", "completeness", F.coalesce("best", empty).alias("best"))
    )


def clean_fingerprint(column: Column) -> Column:
    """64 hexadecimal digits in lower case, without prefix or spaces; null for anything else and for the
    fingerprint of the empty body (a fixed value)."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(column, r"\s+", "")), "^sha-?256:", "")
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    return F.when(plain.rlike("^[0-9a-f]{64}$") & (plain != empty), plain)


def body_groups(counts: DataFrame) -> DataFrame:
    """document_counts -> the same rows with group_id and member_id: the cleaned fingerprint, or, for a
    document without one, that of the group whose records list it in duplicate_members_json (of several,
    the one that lists it most often). Broken JSON is read as far as it names ids. Documents of empty
    bodies and documents that nobody lists get none. Lists of documents that themselves have no fingerprint
    count once those have found their group, so this goes on until nothing new is found."""
    rows = counts.withColumn("group_id", F.when(F.col("searchable_characters") > 0, clean_fingerprint(F.col("body_fingerprint")))).withColumn("member_id", F.trim("document_id"))
    listed = F.array_distinct(F.regexp_extract_all("duplicate_members_json", F.lit('"([0-9]+|[0-9a-f]{24})"')))
    homeless = cut(rows.where("group_id is null and searchable_characters > 0 and member_id is not null").select("member_id", listed.alias("listed")).distinct())
    lists = rows.where("group_id is not null").select("group_id", F.explode(listed).alias("member_id"))
    wanted = homeless.select("member_id").distinct()
    found = cut(_most_listed(lists.join(wanted, "member_id")))
    new = found
    while new.take(1):
        further = homeless.join(new, "member_id").select("group_id", F.explode("listed").alias("member_id"))
        new = cut(_most_listed(further.join(wanted, "member_id").join(found.select("member_id"), "member_id", "left_anti")))
        found = found.unionByName(new)
    homes = found.withColumnRenamed("group_id", "_home")
    homed = rows.where("group_id is null and searchable_characters > 0").join(homes, "member_id").withColumn("group_id", F.col("_home")).drop("_home")
    return rows.where("group_id is not null").unionByName(homed)


def _most_listed(lists: DataFrame) -> DataFrame:
    votes = lists.groupBy("member_id", "group_id").agg(F.count("*").alias("n"))
    return votes.groupBy("member_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "group_id")).alias("v")).select("member_id", F.col("v.group_id").alias("group_id"))
