"""Indexes over the corpus: parsed documents, postings, frequencies, phrases, similar texts, equivalences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import HAN
from quillspark.session import cut

_HEADER_LINE = r"#[ \t]*[A-Z][A-Z0-9_ ]{1,80}[ \t]*[:：]"


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. One aggregate per column, so that Catalyst drops those nobody asks for and
    their columns are not even read; no sort of a key's rows, and combined map-side."""
    last = [F.max(order).alias(order) if c == order else F.max_by(c, order).alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*last).select(*df.columns)


def parse_documents(documents: DataFrame, text_column: str) -> DataFrame:
    """Add metadata (map of header keys), entries (their number) and body. The header is the run of
    ``# KEY: value`` lines at the first line that is not blank; the body starts after the blank lines that
    follow it. Line ends become \\n, a byte-order mark goes."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(F.col(text_column), F.lit("")), F.lit("\r\n"), F.lit("\n")), "﻿", ""), r"\A\n+", "")
    head = F.regexp_extract(F.col("_plain"), rf"\A(?:{_HEADER_LINE}[^\n]*(?:\n|\z))+", 0)
    lines = F.filter(F.split("_head", "\n"), lambda x: x.rlike(rf"\A{_HEADER_LINE}"))
    key = lambda x: F.trim(F.regexp_extract(x, r"\A#[ \t]*([A-Z][A-Z0-9_ ]{1,80}?)[ \t]*[:：]", 1))
    value = lambda x: F.nullif(F.trim(F.regexp_replace(x, rf"\A{_HEADER_LINE}", "")), F.lit(""))
    pairs = F.transform("_lines", lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    first = F.aggregate(pairs, F.array().cast("array<struct<k: string, v: string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return (
        documents.withColumn("_plain", plain)
        .withColumn("_head", head)
        .withColumn("_lines", lines)
        .withColumns({"metadata": F.map_from_entries(first), "entries": F.size("_lines").cast("bigint"), "body": F.regexp_replace(F.substring(F.col("_plain"), F.length("_head") + 1, F.length("_plain")), r"\A\n+", "")})
        .drop("_plain", "_head", "_lines")
    )


def postings(documents: DataFrame, text_column: str, id_column: str = "doc_id") -> DataFrame:
    """term, doc_id, n: occurrences of each character per document. A document lies in one row, so its
    characters are counted where it lies and nothing is shuffled; of two rows of one id each has its own."""
    kind = documents.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = [Counter(t) for t in batch["t"]]
            sizes = [len(c) for c in counted]
            yield pd.DataFrame({"term": [k for c in counted for k in c], "doc_id": batch["doc_id"].repeat(sizes).to_numpy(), "n": [n for c in counted for n in c.values()]})

    return documents.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("t")).mapInPandas(count, f"term string, doc_id {kind}, n bigint")


def candidates(index: DataFrame, terms: list[str], how: str) -> DataFrame:
    """Documents that hold all or any of the terms."""
    found = index.where(F.col("term").isin(*terms)).select("term", "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= (len(set(terms)) if how == "all" else 1)).select("doc_id")


def character_counts(documents: DataFrame, text_column: str, han_only: bool) -> DataFrame:
    """ch, n over the whole corpus: each task counts its texts into one table of the characters (a closed
    set), and only those tables meet."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                total.update(t)
        yield pd.DataFrame({"ch": list(total), "n": list(total.values())}).astype({"n": "int64"})

    counted = documents.where(F.col(text_column).isNotNull()).select(F.col(text_column).alias("t")).mapInPandas(count, "ch string, n bigint")
    return (counted.where(F.col("ch").rlike(f"^[{HAN}]$")) if han_only else counted).groupBy("ch").agg(F.sum("n").alias("n"))


def ranked_frequencies(counts: DataFrame) -> DataFrame:
    """Competition rank (equal counts share a rank, the next skips) and cumulative coverage. The window
    runs over the distinct characters, a closed set, not over the corpus."""
    ordered = Window.orderBy(F.desc("n"), "ch").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("ch", "n", F.rank().over(Window.orderBy(F.desc("n"))).cast("bigint").alias("rank"), (F.sum("n").over(ordered) / F.sum("n").over(Window.partitionBy())).alias("coverage"))


def coverage_thresholds(counts: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, characters: how many of the most frequent characters reach it."""
    ordered = Window.orderBy(F.desc("n"), "ch")
    placed = ranked_frequencies(counts).withColumn("place", F.row_number().over(ordered))
    reached = placed.select(F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("coverage") >= t)).alias("threshold"), "place")
    return reached.groupBy("threshold").agg(F.min("place").cast("bigint").alias("characters"))


def merged_frequencies(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts summed after mapping each character through the rules (variant -> base), with its place."""
    merged = counts.join(F.broadcast(rules), counts["ch"] == rules["variant"], "left").groupBy(F.coalesce("base", "ch").alias("ch")).agg(F.sum("n").alias("n"))
    return merged.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ch")).cast("bigint"))


def _grams(stream: Column, size: int) -> Column:
    """All runs of ``size`` characters in order, by a lookahead: one linear pass, where substring() by
    position would scan from the start for every run."""
    return F.regexp_extract_all(stream, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def phrase_matches(streams: DataFrame, phrases: DataFrame) -> DataFrame:
    """streams (doc_id, stream) and phrases (phrase) -> doc_id, phrase, start: every occurrence, also
    overlapping ones, by joining the streams' runs of each phrase length to the dictionary (broadcast by
    Catalyst while it is small, a shuffle join beyond)."""
    lengths = sorted(r["m"] for r in phrases.select(F.length("phrase").alias("m")).distinct().collect())
    if not lengths:
        return streams.select("doc_id", F.lit("").alias("phrase"), F.lit(0).alias("start")).limit(0)
    grams = None
    for m in lengths:
        of_length = streams.where(F.length("stream") >= m).select("doc_id", F.posexplode(_grams(F.col("stream"), m)).alias("start", "phrase"))
        grams = of_length if grams is None else grams.unionByName(of_length)
    return grams.join(phrases.select("phrase").distinct(), "phrase").select("doc_id", "phrase", "start")


def longest_non_overlapping(matches: DataFrame) -> DataFrame:
    """Of a document's matches, left to right, the longest at each start that overlaps none taken before.
    A fold over the document's own sorted matches, inside the JVM."""
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.length("phrase")).alias("order"), "phrase")))
    empty = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start: int, phrase: string>>").alias("kept"))
    take = lambda acc, x: F.when(
        x["start"] >= acc["upto"],
        F.struct((x["start"] + F.length(x["phrase"])).alias("upto"), F.concat(acc["kept"], F.array(F.struct(x["start"].alias("start"), x["phrase"].alias("phrase")))).alias("kept")),
    ).otherwise(acc)
    folded = matches.groupBy("doc_id").agg(ordered.alias("m")).select("doc_id", F.explode(F.aggregate("m", empty, take)["kept"]).alias("k"))
    return folded.select("doc_id", F.col("k.phrase").alias("phrase"), F.col("k.start").alias("start"))


def similar_texts(streams: DataFrame, size: int, least: float) -> DataFrame:
    """streams (doc_id, stream) -> doc_a, doc_b, shared, jaccard, containment for different texts whose sets
    of shingles reach the Jaccard similarity ``least``. Exact copies are first reduced to their smallest
    doc_id, so that no group of copies is expanded.

    Prefix filter, exact at any skew: a text's shingles are ordered from the rarest on; two texts of
    Jaccard t or more must share one among their first n - ceil(t n) + 1. Only those prefixes are joined, and
    common shingles fall out of them; lengths that cannot reach t are refused before verification.
    """
    # Texts meet by digest; whole texts are not shuffled as keys.
    firsts = streams.where(F.length("stream") >= size).groupBy(F.sha2("stream", 256).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    unique = streams.where(F.length("stream") >= size).join(firsts, "doc_id", "left_semi")
    sets = cut(unique.select("doc_id", F.transform(F.array_distinct(_grams(F.col("stream"), size)), lambda g: F.xxhash64(g)).alias("grams")))
    each = sets.select("doc_id", F.explode("grams").alias("g"))
    counted = each.join(each.groupBy("g").agg(F.count("*").alias("df")), "g").where("df > 1")
    # Shingles that occur once can be in no pair: they stay in a set's size and take its first places.
    alone = F.size("grams") - F.size("shared")
    length = F.greatest(F.size("grams") - F.ceil(F.lit(least) * F.size("grams")) + 1 - alone, F.lit(0)).cast("int")
    ranked = counted.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias("shared")).join(sets, "doc_id")
    heads = ranked.select("doc_id", F.size("grams").alias("n"), F.explode(F.slice("shared", F.lit(1), length)).alias("g"))
    a, b = heads.select("g", F.col("doc_id").alias("doc_a"), F.col("n").alias("na")), heads.select("g", F.col("doc_id").alias("doc_b"), F.col("n").alias("nb"))
    pairs = a.join(b, "g").where(f"doc_a < doc_b and na >= {least} * nb and nb >= {least} * na").select("doc_a", "doc_b").distinct()
    left, right = sets.select(F.col("doc_id").alias("doc_a"), F.col("grams").alias("ga")), sets.select(F.col("doc_id").alias("doc_b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    measured = pairs.join(left, "doc_a").join(right, "doc_b").select("doc_a", "doc_b", shared.cast("bigint").alias("shared"), F.size("ga").alias("na"), F.size("gb").alias("nb"))
    return measured.select("doc_a", "doc_b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("containment")).where(F.col("jaccard") >= least)


def copy_membership(streams: DataFrame) -> DataFrame:
    """streams (doc_id, stream) -> doc_id, representative, copies: one row per document. The representative is
    the smallest doc_id of the same stream, by which ``similar_texts`` names a text; copies is the number of
    documents of the stream. Without a stream (null or empty) a document represents itself alone. Only
    digests of the streams are shuffled."""
    keyed = cut(streams.select("doc_id", F.when(F.col("stream") != "", F.sha2("stream", 256)).alias("key")))
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return keyed.join(classes, "key", "left").select("doc_id", F.coalesce("first", "doc_id").alias("representative"), F.coalesce("n", F.lit(1)).cast("bigint").alias("copies"))


def equivalence_classes(edges: DataFrame) -> DataFrame:
    """edges (base, variant) -> ch, representative, members: connected components by the smallest member,
    jumping over the representative's representative, so that long chains take few rounds."""
    both = edges.select(F.col("base").alias("a"), F.col("variant").alias("b"))
    both = cut(both.union(both.select("b", "a")).distinct())
    label = cut(both.select(F.col("a").alias("ch")).distinct().withColumn("representative", F.col("ch")))
    while True:
        around = both.join(label.withColumnRenamed("ch", "b"), "b").groupBy(F.col("a").alias("ch")).agg(F.min("representative").alias("near"))
        nearer = label.join(around, "ch", "left").select("ch", F.least("representative", "near").alias("representative"))
        hop = nearer.select(F.col("ch").alias("representative"), F.col("representative").alias("beyond"))
        new = cut(nearer.join(hop, "representative", "left").select("ch", F.least("representative", "beyond").alias("representative")))
        if not new.join(label.withColumnRenamed("representative", "old"), "ch").where("representative <> old").take(1):
            return new.join(new.groupBy("representative").agg(F.count("*").alias("members")), "representative").select("ch", "representative", "members")
        label = new


def equivalence_paths(edges: DataFrame) -> DataFrame:
    """from, to, path, sources: the shortest path between any two characters of one class (ties: the
    path that sorts first), by breadth-first rounds over the small edge table until no new pair is found."""
    both = edges.select(F.col("base").alias("a"), F.col("variant").alias("b"), "source")
    both = cut(both.union(both.select("b", "a", "source")).groupBy("a", "b").agg(F.min("source").alias("source")))
    found = cut(both.select(F.col("a").alias("from"), F.col("b").alias("to"), F.array("a", "b").alias("path"), F.array("source").alias("sources")))
    front = found
    while True:
        step = front.join(both.withColumnRenamed("a", "to").withColumnRenamed("b", "next"), "to").where(~F.array_contains("path", F.col("next")))
        step = step.select("from", F.col("next").alias("to"), F.concat("path", F.array("next")).alias("path"), F.concat("sources", F.array("source")).alias("sources"))
        best = step.groupBy("from", "to").agg(F.min(F.struct("path", "sources")).alias("p")).select("from", "to", "p.path", "p.sources")
        front = cut(best.join(found.select("from", "to"), ["from", "to"], "left_anti"))
        if not front.take(1):
            return found
        found = cut(found.unionByName(front))


SIGNATURE_BITS, SIGNATURE_HASHES = 4096, 4


def _bits(characters: Column) -> Column:
    each = F.transform(characters, lambda c: F.array(*[F.pmod(F.xxhash64(c, F.lit(k)), F.lit(SIGNATURE_BITS)).cast("int") for k in range(SIGNATURE_HASHES)]))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def signatures(documents: DataFrame, text_column: str, id_column: str = "doc_id") -> DataFrame:
    """doc_id, bits: the set bits of a 4096-bit Bloom signature of a body's distinct characters."""
    distinct = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text_column), F.lit("")), ""), lambda c: c != ""))
    return documents.select(F.col(id_column).alias("doc_id"), _bits(distinct).alias("bits"))


def maybe_holding(signed: DataFrame, term: str) -> DataFrame:
    """Documents whose signature has all bits of the term's characters: none that holds the term is missing."""
    wanted = _bits(F.array(*[F.lit(c) for c in dict.fromkeys(term)]))
    return signed.where(F.size(F.array_except(wanted, F.col("bits"))) == 0).select("doc_id")


def merge_by_priority(layers: list[DataFrame]) -> DataFrame:
    """Annotation layers (doc_id, start, end, label), the first layer winning where ranges coincide."""
    every = None
    for i, layer in enumerate(layers):
        marked = layer.select("doc_id", "start", "end", "label", F.lit(i).alias("layer"))
        every = marked if every is None else every.unionByName(marked)
    best = every.groupBy("doc_id", "start", "end").agg(F.min(F.struct("layer", "label")).alias("b"))
    return best.select("doc_id", "start", "end", "b.label", "b.layer")


def self_dated(hits: DataFrame, lengths: DataFrame, least: int = 5) -> DataFrame:
    """Years that texts give for themselves. hits: doc_id, matched, original_start, left_context,
    right_context; lengths: doc_id, n. A year scores 3 near the start or end (first tenth, last fifth),
    4 beside a word of self-reference, 2 beside a first person, -2 beside narrative words; without
    self-reference at most 4. Only texts whose best years agree are dated."""
    around = F.concat("left_context", F.lit("|"), "right_context")
    place = F.col("original_start") / F.greatest("n", F.lit(1))
    boundary = F.when((place <= 0.1) | (place >= 0.8), 3).otherwise(0)
    oneself = around.rlike("謹[識志書序]|自序|敬[識書]|撰於|書於|識於")
    score = boundary + F.when(oneself, 4).otherwise(0) + F.when(around.rlike("[余予吾臣]"), 2).otherwise(0) - F.when(around.rlike("[卒薨崩生]於|是歲"), 2).otherwise(0)
    scored = hits.join(lengths, "doc_id").select("doc_id", "matched", F.when(oneself, score).otherwise(F.least(score, F.lit(4))).alias("score"))
    top = scored.groupBy("doc_id").agg(F.max("score").alias("top"))
    near = scored.join(top, "doc_id").where((F.col("score") >= least) & (F.col("score") >= F.col("top") - 1))
    return near.groupBy("doc_id").agg(F.countDistinct("matched").alias("years"), F.min("matched").alias("year"), F.max("score").alias("score")).where("years = 1").select("doc_id", "year", "score")
