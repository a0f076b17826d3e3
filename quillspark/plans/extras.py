"""Queries of signatures, layers, self-dating, day numbers, collations and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.functions.text import contains_literally, julian_day, normalised
from quillspark.operators import index, search, statistics
from quillspark.operators.catalogue import numbered
from quillspark.operators.search import SearchSpec
from quillspark.plans.corpus import LATEST, NORM, SQL_HAN, bodies, manifest
from quillspark.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query()
def m17_maybe_holding(spark: SparkSession, root: str) -> DataFrame:
    """Documents that may hold a term, by their characters' Bloom signatures."""
    return index.maybe_holding(index.signatures(table(spark, root, "documents"), "text"), "未嘗不")


@query("select 0::bigint missed, count(*) filter (where contains(text, '未嘗')) holding from documents")
def m17_missed(spark: SparkSession, root: str) -> DataFrame:
    """How many documents that hold a term its characters' signatures would lose: none may be."""
    documents = table(spark, root, "documents")
    holding = documents.where(F.col("text").contains("未嘗")).select("doc_id")
    maybe = index.maybe_holding(index.signatures(documents, "text"), "未嘗").withColumn("maybe", F.lit(1))
    return holding.join(maybe, "doc_id", "left").agg(F.count_if(F.col("maybe").isNull()).alias("missed"), F.count("*").alias("holding"))


@query("select doc_id, title, work_id, document_role, source from documents")
def f10_compact(spark: SparkSession, root: str) -> DataFrame:
    """The compact row of each document, as lists show it: no text column is read."""
    return table(spark, root, "documents").select("doc_id", "title", "work_id", "document_role", "source")


@query("select source, count(*) filter (where lang = 'lzh') positive, count(*) filter (where lang is not null and lang <> 'lzh') negative, coalesce(sum(length(text)), 0)::bigint characters from documents group by 1")
def a54_labelled_samples(spark: SparkSession, root: str) -> DataFrame:
    """Labelled samples per source: positive, negative, characters."""
    return statistics.labelled_samples(table(spark, root, "documents"), "source", F.col("lang") == "lzh")


@query("select document_id, shard, place from (select document_id, ((k - 1) // 500)::bigint shard, ((k - 1) % 500)::bigint place from (select document_id, row_number() over (order by document_id) k from (select distinct document_id from document_counts)))")
def w11_shards(spark: SparkSession, root: str) -> DataFrame:
    """Documents in order, cut into shards of 500."""
    ordered = numbered(table(spark, root, "document_counts").select("document_id").distinct(), ["document_id"], "k")
    return ordered.select("document_id", F.floor((F.col("k") - 1) / 500).alias("shard"), F.pmod(F.col("k") - 1, F.lit(500)).alias("place"))


@query("select work_key, arg_min(form, (-length(form), form)) chosen from title_forms where form is not null and work_key is not null group by 1")
def o12_longest_form(spark: SparkSession, root: str) -> DataFrame:
    """Of each work's forms the longest, ties to the one that sorts first; combined map-side."""
    forms = table(spark, root, "title_forms").where("form is not null and work_key is not null")
    return forms.groupBy("work_key").agg(F.min_by("form", F.struct((-F.length("form")).alias("n"), "form")).alias("chosen"))


@query(
    "with m as (select distinct mention_no, work_key, name_key, role from work_people where name_key = '佚名' or name_key like '%建%'), w as (select distinct work_key, display_title from works) "
    "select mention_no, name_key, role, display_title from m join w using (work_key)"
)
def j7_works_by_name(spark: SparkSession, root: str) -> DataFrame:
    """Works of people by an exact key or a part of it."""
    mentions = table(spark, root, "work_people").where((F.col("name_key") == "佚名") | F.col("name_key").contains("建")).select("mention_no", "work_key", "name_key", "role").distinct()
    return mentions.join(table(spark, root, "works").select("work_key", "display_title").distinct(), "work_key").select("mention_no", "name_key", "role", "display_title")


@query(r"select form_no, form from title_forms where form like '%\%%' escape '\' or form like '%\_%' escape '\' or form like '%傳%' group by all")
def x25_escaped_like(spark: SparkSession, root: str) -> DataFrame:
    """Forms that hold a text in which wildcards stand for themselves."""
    forms = table(spark, root, "title_forms").select("form_no", "form").distinct()
    return forms.where(contains_literally(F.col("form"), "%") | contains_literally(F.col("form"), "_") | contains_literally(F.col("form"), "傳"))


@query(
    f"""with n as (select doc_id, {NORM} s from documents), a as (select doc_id, i - 1 as start_, i + 1 as end_, 'term' as label, 0 as layer from n, unnest(range(1, length(s))) u(i) where s[i:i + 1] = '是以'),
    b as (select doc_id, i - 1 as start_, i + 1 as end_, 'pair' as label, 1 as layer from n, unnest(range(1, length(s))) u(i) where s[i:i + 1] in ('是以', '公曰')), m as (select * from a union all select * from b)
    select doc_id, start_::int as start, end_::int as "end", arg_min(label, layer) as label, min(layer)::int layer from m group by 1, 2, 3"""
)
def m26_layers(spark: SparkSession, root: str) -> DataFrame:
    """Two annotation layers merged, the first winning."""
    of = lambda spec, label: search.find_hits(bodies(spark, root), spec).select("doc_id", F.col("search_start").alias("start"), F.col("search_end").alias("end"), F.lit(label).alias("label"))
    return index.merge_by_priority([of(SearchSpec(("是以",)), "term"), of(SearchSpec(("是以", "公曰"), mode="or"), "pair")])


@query()
def c12_self_dated(spark: SparkSession, root: str) -> DataFrame:
    """Texts dated by a year they give for themselves."""
    documents = bodies(spark, root)
    hits = search.find_hits(documents, SearchSpec(("[一二三四五六七八九十]+年[一二三四五六七八九十]+月",), mode="regex"))
    return index.self_dated(hits, documents.select("doc_id", F.length("body").alias("n")))


@query("select o_orderkey, julian(o_orderdate::date)::bigint as day_number from orders")
def x15_day_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Julian day numbers of dates."""
    day = julian_day(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return table(spark, root, "orders").select("o_orderkey", day.alias("day_number"))


@query()
def x16_readings(spark: SparkSession, root: str) -> DataFrame:
    """Romanised names split into slot and tone, and their bare form."""
    names = table(spark, root, "people").where("romanized is not null").select("romanized").distinct()
    name = F.col("romanized")
    return names.select("romanized", scalars.reading_slot(name, "mandarin").alias("slot"), scalars.reading_tone(name, "mandarin").alias("tone"), F.lower(scalars.normal_form(name, "bare")).alias("bare"))


@query(
    f"with f as (select ch, count(*) n from (select unnest(string_split(text, '')) ch from documents where text is not null) where regexp_full_match(ch, '[{SQL_HAN}]') group by 1) select ch, row_number() over (order by unicode(ch)) by_code, row_number() over (order by n desc, unicode(ch)) by_frequency from f"
)
def o10_collations(spark: SparkSession, root: str) -> DataFrame:
    """Characters in code-point and in frequency order."""
    counted = index.character_counts(table(spark, root, "documents"), "text", True).withColumn("code", F.ascii("ch"))
    coded = numbered(counted, ["code"], "by_code")
    return numbered(coded, [F.desc("n"), "code"], "by_frequency").select("ch", "by_code", "by_frequency")


@query("select doc_id, sha256('202610:' || doc_id) sample_hash from documents order by 2 limit 100")
def o8_sample(spark: SparkSession, root: str) -> DataFrame:
    """A seeded sample of documents."""
    return statistics.hash_sample(table(spark, root, "documents").select("doc_id"), "doc_id", 202610, 100)


@query(f"with {LATEST}, f as (select document_id, case when coalesce(trim(author), '') in ('', '不詳', '佚名', '—', '(Unknown / unclassified)') then 'no author' end a, case when year_start is null and year_end is null then 'undated' end b, case when searchable_characters = 0 then 'empty' end c from latest) select w as warning, count(*) documents from (select unnest([a, b, c]) w from f) where w is not null group by 1")
def a31_warnings(spark: SparkSession, root: str) -> DataFrame:
    """What to warn of in a result, with the number of documents."""
    unknown = F.coalesce(F.trim("author"), F.lit("")).isin("", "不詳", "佚名", "—", "(Unknown / unclassified)")
    found = F.array(F.when(unknown, "no author"), F.when(F.col("year_start").isNull() & F.col("year_end").isNull(), "undated"), F.when(F.col("searchable_characters") == 0, "empty"))
    return manifest(spark, root).select(F.explode(F.filter(found, lambda w: w.isNotNull())).alias("warning")).groupBy("warning").agg(F.count("*").alias("documents"))


@query(f"with {LATEST}, d as (select l.document_id, length({NORM}) n, l.searchable_characters from latest l join documents using (doc_id)) select document_id, n::int fresh, (n <> searchable_characters) stale from d")
def j3_stale_counts(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows whose character count no longer fits the body."""
    fresh = table(spark, root, "documents").select("doc_id", F.length(normalised(F.col("text"))).alias("fresh"))
    return manifest(spark, root).join(fresh, "doc_id").select("document_id", "fresh", (F.col("fresh") != F.col("searchable_characters")).alias("stale"))
