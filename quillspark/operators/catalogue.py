"""Catalogue queries and joins over works, titles, people and paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import title_key
from quillspark.session import cut

def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """A running number from 1 in the given order, without gathering the rows in one task: rows are dealt
    by ranges, numbered inside each range, and shifted by the sizes of the ranges before."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def title_ranks(forms: DataFrame, asked: str) -> DataFrame:
    """forms (work_key, form, form_kind) -> the forms that match a title and how: 0 exact title, 1 exact
    base, 2 prefix, 3 contains, then 4 to 6 the same on normalised titles."""
    key = title_key(F.col("form"))
    wanted = title_key(F.lit(asked))
    rank = (
        F.when((F.col("form") == asked) & (F.col("form_kind") == "exact_title"), 0)
        .when(F.col("form") == asked, 1)
        .when(F.col("form").startswith(asked), 2)
        .when(F.col("form").contains(asked), 3)
        .when(key == wanted, 4)
        .when(key.startswith(wanted), 5)
        .when(key.contains(wanted), 6)
    )
    return forms.withColumn("rank", rank).where("rank is not null")


def title_search(works: DataFrame, forms: DataFrame, asked: str, limit: int = 100) -> DataFrame:
    """Works by best matching form; ordered by geography, year (unknown last), rank, title."""
    best = title_ranks(forms, asked).groupBy("work_key").agg(F.min(F.struct("rank", "form")).alias("b"))
    found = works.join(best.select("work_key", "b.rank", F.col("b.form").alias("matched_form")), "work_key")
    return found.orderBy("macro_region", F.asc_nulls_last("sort_year"), "rank", "display_title", "work_key").limit(limit)


def timeline(works: DataFrame, descending: bool, page: int, per_page: int) -> DataFrame:
    """A page of works by year, unknown years last either way, with the number of all works."""
    year = F.desc_nulls_last("sort_year") if descending else F.asc_nulls_last("sort_year")
    total = works.agg(F.count("*").alias("total"))
    rows = works.orderBy(year, "display_title", "work_key").offset((max(page, 1) - 1) * per_page).limit(per_page)
    return rows.withColumn("total", total.scalar())


def in_interval(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, step: int = 64) -> DataFrame:
    """Points with the intervals (inclusive) they fall into. An equality join on cells of ``step`` years,
    each interval listed in the cells it meets: no nested loop, and a bound on what any cell holds."""
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor(F.col(end) / step))))
    return points.withColumn("_cell", F.floor(F.col(at) / step)).join(cells, "_cell").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_cell")


def ancestors(path: Column) -> Column:
    """All prefixes of a path at segment borders, itself included, as structs (prefix, depth)."""
    segments = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.struct(F.array_join(F.slice(segments, F.lit(1), k), "/").alias("prefix"), k.alias("depth")))


def nearest_ancestor(rows: DataFrame, key: str, path: str, owners: DataFrame) -> DataFrame:
    """owners (prefix, owner) -> each row's key with the owner of its longest prefix. Prefixes meet by
    equality, so no prefix is compared with every path."""
    spread = rows.select(key, F.explode(ancestors(F.col(path))).alias("a")).select(key, F.col("a.prefix").alias("prefix"), F.col("a.depth").alias("depth"))
    return spread.join(owners, "prefix").groupBy(key).agg(F.max_by(F.struct("prefix", "owner"), "depth").alias("o")).select(key, F.col("o.prefix").alias("prefix"), F.col("o.owner").alias("owner"))


def propagate_unique(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Rows without a label get their group's, if all known labels of the group are the same one; groups
    with several are reported as ambiguous. Groups are combined map-side, not collected."""
    known = rows.where(F.col(label).isNotNull()).groupBy(group).agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
    joined = rows.join(known, group, "left")
    new = F.coalesce(F.col(label), F.when(F.col("_low") == F.col("_high"), F.col("_low")))
    status = F.when(F.col(label).isNotNull(), "known").when(F.col("_low") == F.col("_high"), "propagated").when(F.col("_low").isNotNull(), "ambiguous").otherwise("unknown")
    return joined.withColumns({"label": new, "status": status}).drop("_low", "_high")


def update_from(rows: DataFrame, key: Column, mapping: DataFrame, old: str) -> DataFrame:
    """mapping (map_key, map_order, new_value): rows whose key is mapped get the first mapping's value,
    others pass through; status tells which."""
    first = mapping.groupBy("map_key").agg(F.min_by("new_value", "map_order").alias("new_value"))
    joined = rows.withColumn("map_key", key).join(first, "map_key", "left")
    return joined.withColumns({"status": F.when(F.col("new_value").isNull(), "unmatched").when(F.col("new_value") == F.col(old), "same").otherwise("updated"), "value": F.coalesce("new_value", old)})


def common_interval(members: DataFrame, group: str) -> DataFrame:
    """members (group, start, end): latest start and earliest end of a group; null if they cross or any
    member is unresolved."""
    a = members.groupBy(group).agg(F.max("start").alias("low"), F.min("end").alias("high"), F.count("*").alias("members"), F.count_if(F.col("start").isNotNull() & F.col("end").isNotNull()).alias("resolved"))
    sound = (F.col("members") == F.col("resolved")) & (F.col("low") <= F.col("high"))
    return a.select(group, "members", "resolved", F.when(sound, F.col("low")).alias("low"), F.when(sound, F.col("high")).alias("high"))


def profile_cosines(counts: DataFrame, most_share: float = 0.1) -> DataFrame:
    """counts (profile, item, n) -> pairs of profiles by the cosine of sqrt(n) * ln(profiles / df), linked only
    through items of at most ``most_share`` of the profiles, with containment of the smaller profile. The
    cosine itself runs over all items."""
    total = counts.select("profile").distinct().agg(F.count("*").alias("profiles"))
    df = counts.groupBy("item").agg(F.count("*").alias("df"))
    weighed = counts.join(df, "item").withColumn("profiles", total.scalar()).withColumn("w", F.sqrt("n") * F.ln(F.col("profiles") / F.col("df")))
    size = weighed.groupBy("profile").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("items"))
    x = weighed.select("item", F.col("profile").alias("a"), F.col("w").alias("wa"), (F.col("df") <= F.greatest(F.lit(2.0), F.col("profiles") * most_share)).alias("links"))
    y = weighed.select("item", F.col("profile").alias("b"), F.col("w").alias("wb"))
    linked = x.where("links").select("item", "a").join(y.select("item", "b"), "item").where("a < b").select("a", "b").distinct()
    dots = linked.join(x.drop("links"), "a").join(y, ["b", "item"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.count("*").alias("shared"))
    sa, sb = (size.select(F.col("profile").alias(c), F.col("norm").alias(f"norm_{c}"), F.col("items").alias(f"items_{c}")) for c in ("a", "b"))
    return dots.join(sa, "a").join(sb, "b").select("a", "b", "shared", F.coalesce(F.try_divide(F.col("dot"), F.col("norm_a") * F.col("norm_b")), F.lit(0.0)).alias("cosine"), (F.col("shared") / F.least("items_a", "items_b")).alias("containment"))


def fuzzy_titles(asked: DataFrame, titles: DataFrame, most: int = 80) -> DataFrame:
    """asked (ask) and titles (title), both normalised -> best title of each, its ratio and band: exact, or
    among the ``most`` titles that share most bigrams (a limit that is part of the feature), by matching blocks."""
    import difflib

    pairs_of = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(..))."), F.lit(1)))
    a = asked.distinct().select("ask", F.explode(pairs_of(F.col("ask"))).alias("g"))
    b = titles.distinct().select("title", F.explode(pairs_of(F.col("title"))).alias("g"))
    shared = a.join(b, "g").groupBy("ask", "title").agg(F.count("*").alias("shared"))
    near = shared.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("shared"), "title"))).where(F.col("place") <= most)

    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for x, y in zip(batch["ask"], batch["title"]):
                r = 1.0 if x == y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
                if x != y and min(len(x), len(y)) >= 2 and (x in y or y in x):
                    r = max(r, 0.94)
                scores.append(r)
            yield batch[["ask", "title"]].assign(ratio=scores)

    scored = near.select("ask", "title").mapInPandas(ratio, "ask string, title string, ratio double")
    best = scored.groupBy("ask").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "title")).alias("b"))
    return best.select("ask", "b.title", (-F.col("b.r")).alias("ratio"), F.when(-F.col("b.r") >= 0.92, "strong").when(-F.col("b.r") >= 0.8, "possible").otherwise("weak").alias("band"))


def representative(documents: DataFrame, group: str) -> DataFrame:
    """One document per group: canonical first, then the shallowest, then shortest, then first path."""
    order = F.struct((F.col("document_role") != "canonical").cast("int").alias("a"), F.size(F.split("path", "/")).alias("b"), F.length("path").alias("c"), "path")
    return documents.groupBy(group).agg(F.min(F.struct(order.alias("o"), "document_id")).alias("m")).select(group, F.col("m.document_id").alias("document_id"), F.col("m.o.path").alias("path"))


def chain_pairs(forms: DataFrame) -> DataFrame:
    """forms (family, form) -> how many forms of other families may follow each form, its last character
    being their first. Counted per character and family, never paired form by form."""
    starts = forms.groupBy(F.substring("form", 1, 1).alias("ch")).agg(F.count("*").alias("n"))
    own = forms.groupBy(F.substring("form", 1, 1).alias("ch"), "family").agg(F.count("*").alias("own"))
    last = forms.select("family", "form", F.right(F.col("form"), F.lit(1)).alias("ch"))
    return last.join(starts, "ch", "left").join(own, ["ch", "family"], "left").select("family", "form", (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("branches"))


def windows_of(texts: DataFrame, size: int, stride: int) -> DataFrame:
    """texts (doc_id, text) -> windows of ``size`` characters every ``stride``; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(stride))
    inside = F.filter(starts, lambda s: (s == 0) | (s + (size - stride) < F.length("text")))
    return texts.where(F.length("text") > 0).select("doc_id", "text", F.explode(inside).alias("start")).select("doc_id", "start", F.expr(f"substring(text, start + 1, {size})").alias("window"))


def han_runs(texts: DataFrame, least_han: int = 5, least_chunk: int = 80) -> DataFrame:
    """Maximal runs of lines with ``least_han`` Han characters or more and almost no kana, of at least
    ``least_chunk`` Han characters together: gaps and islands, folded within each text's own lines."""
    han = lambda x: F.length(F.regexp_replace(x, r"[^\p{IsHan}]", ""))
    kana = lambda x: F.length(F.regexp_replace(x, r"[^\p{IsHiragana}\p{IsKatakana}]", ""))
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    marked = lines.select("doc_id", "line", han(F.col("t")).alias("han"), kana(F.col("t")).alias("kana")).where((F.col("han") >= least_han) & (F.col("kana") <= 0.03 * (F.col("han") + F.col("kana"))))
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    runs = marked.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum("han").alias("han"))
    return runs.where(F.col("han") >= least_chunk).select("doc_id", "first_line", "last_line", "han")


def repaired_ids(rows: DataFrame) -> DataFrame:
    """rows (entity, id): one id per entity. Of an entity's ids the smallest stays; of several entities
    with one id the smallest entity keeps it; the others get the numbers after the largest."""
    one = rows.groupBy("entity").agg(F.min("id").alias("id"))
    owner = one.where("id is not null").groupBy("id").agg(F.min("entity").alias("owner"))
    marked = one.join(owner, "id", "left").withColumn("kept", F.coalesce(F.col("entity") == F.col("owner"), F.lit(False)))
    top = one.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = numbered(marked.where("not kept").select("entity"), ["entity"], "k").withColumn("top", top.scalar()).select("entity", (F.col("top") + F.col("k")).alias("id"), F.lit("new").alias("status"))
    return marked.where("kept").select("entity", "id", F.lit("kept").alias("status")).unionByName(fresh)
