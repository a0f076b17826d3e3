"""Queries of characters, readings, dates and remaining catalogue operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.functions.text import count_exact, normalised
from quillspark.operators import catalogue, characters, index, search
from quillspark.operators.references import clean_id
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


_CHARS = (
    "c as (select distinct unnest(string_split(name_chn, '')) ch, source, derivation, name_length::varchar size from names), "
    f"props as (select distinct ch, p.f as field, p.v as value from (select ch, unnest([struct_pack(f := 'source', v := source), struct_pack(f := 'derivation', v := derivation), struct_pack(f := 'size', v := size)]) p from c where regexp_full_match(ch, '[{SQL_HAN}]')))"
)


def _properties(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "names").select(F.explode(F.split("name_chn", "")).alias("c"), "source", "derivation", "name_length").where(F.col("c").rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]$"))
    return characters.properties(rows, "c", {"source": "source", "derivation": "derivation", "size": "name_length"})


_STACK = [("source", ["wikidata_east_asia"]), ("derivation", ["variant", "style"]), ("size", ["2", "4"])]
_STACK_SQL = f"""with {_CHARS}, s as (select ch, bool_or(field = 'source' and value = 'wikidata_east_asia') a, bool_or(field = 'derivation' and value in ('variant', 'style')) b, bool_or(field = 'size' and value in ('2', '4')) d from props group by 1)"""


@query(_STACK_SQL + " select ch from s where a and b and d")
def u1_constraints(spark: SparkSession, root: str) -> DataFrame:
    """Characters that meet a stack of constraints."""
    return characters.constrained(_properties(spark, root), _STACK)[0]


@query(_STACK_SQL + " select 1::int step, count(*) filter (where a) survivors from s union all select 2, count(*) filter (where a and b) from s union all select 3, count(*) filter (where a and b and d) from s")
def u1_survivors(spark: SparkSession, root: str) -> DataFrame:
    """Survivors after each constraint."""
    return characters.constrained(_properties(spark, root), _STACK)[1]


_EDGES = [("启", "啟"), ("啟", "啓"), ("荣", "榮"), ("贞", "貞"), ("卢", "盧")]


@query(
    "with recursive e(a, b) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + f"), u as (select a, b from e union select b, a from e), r as (select a, a as b from u union select r.a, u.b from r join u on u.a = r.b), k as (select a ch, min(b) head, count(*) members from r group by 1), {_CHARS} "
    "select distinct ch, coalesce(head, ch) head, coalesce(members, 1) members from (select distinct ch from props) left join k using (ch)"
)
def u3_variant_groups(spark: SparkSession, root: str) -> DataFrame:
    """Characters grouped with their variants."""
    edges = spark.createDataFrame([(a, b, "x") for a, b in _EDGES], "base string, variant string, source string")
    return characters.variant_groups(_properties(spark, root).select("ch").distinct(), edges)


@query(f"with {_CHARS}, o as (select distinct ch, value from props where field = 'derivation') select ch, value, count(*) over (partition by value) - 1 others from o")
def q6_sharing(spark: SparkSession, root: str) -> DataFrame:
    """How many other characters share each derivation (homophones and the like)."""
    return characters.sharing(_properties(spark, root), "derivation")


@query(f"with {_CHARS} select field, count(distinct value) slots, count(distinct ch) characters from props group by 1")
def a49_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Values and characters that each field covers."""
    return _properties(spark, root).groupBy("field").agg(F.countDistinct("value").alias("slots"), F.countDistinct("ch").alias("characters"))


@query("with n as (select distinct name_chn, source, derivation from names) select unnest(list_distinct(string_split(name_chn, ''))) ch, count(*) names, count(distinct source) sources from n where name_chn <> '' group by 1")
def q9_names_by_character(spark: SparkSession, root: str) -> DataFrame:
    """Names that contain each character."""
    names = table(spark, root, "names").select("name_chn", "source", "derivation").distinct()
    spread = names.select("source", F.explode(F.array_distinct(F.split("name_chn", ""))).alias("ch")).where("ch <> ''")
    return spread.groupBy("ch").agg(F.count("*").alias("names"), F.countDistinct("source").alias("sources"))


@query("with p as (select distinct person_no, source, entity_id, polity, year_start, recorded_at from people), h as (select *, first_value(year_start ignore nulls) over (partition by source, polity order by person_no rows between unbounded preceding and unbounded following) f from p) select person_no, coalesce(year_start, f) inherited from h")
def j19_group_heads(spark: SparkSession, root: str) -> DataFrame:
    """Persons without a year take that of the first of their source and polity."""
    people = table(spark, root, "people").select("person_no", "source", "polity", "year_start").distinct()
    return characters.inherit_head(people, ["source", "polity"], "person_no", "year_start").select("person_no", "inherited")


@query(
    """with recursive nested as (select unnest(json_extract(periods, '$[*]')) j, 0 depth from atlas_node_type_rules where json_valid(periods) union all select unnest(json_extract(j, '$.children[*]')), depth + 1 from nested),
    p as (select distinct unnest(json_extract_string(j, '$.corpus_paths[*]')) prefix, (j->>'$.label') label from nested) select prefix, min(label) as label, count(*) labels from p group by 1"""
)
def q14_atlas_paths(spark: SparkSession, root: str) -> DataFrame:
    """Corpus paths that the atlas periods claim, with their label."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["periods"]:
                stack = list(json.loads(text)) if text else []
                while stack:
                    node = stack.pop()
                    out += [(p, node.get("label")) for p in node.get("corpus_paths") or ()]
                    stack += node.get("children") or []
            yield pd.DataFrame(out, columns=["prefix", "label"])

    claims = table(spark, root, "atlas_node_type_rules").where("periods is not null").select("periods").mapInPandas(run, "prefix string, label string").distinct()
    return claims.groupBy("prefix").agg(F.min("label").alias("label"), F.count("*").alias("labels"))


@query(
    f"""with {LATEST}, claims as (select 'p' || (row_number() over (order by folder_path)) as owner, folder_path prefix from (select distinct array_to_string(string_split(folder_path, '/')[:3], '/') folder_path from latest)), a as (select document_id, string_split(folder_path, '/') s from latest),
    x as (select document_id, array_to_string(s[:k], '/') prefix, k from a, unnest(range(1, 65)) u(k) where k <= len(s)) select document_id, max_by(prefix, k) prefix from x join claims using (prefix) group by 1"""
)
def j22_deepest_period(spark: SparkSession, root: str) -> DataFrame:
    """The deepest period folder of each document."""
    rows = manifest(spark, root)
    claims = rows.select(F.array_join(F.slice(F.split("folder_path", "/"), 1, 3), "/").alias("prefix")).distinct().withColumn("owner", F.col("prefix"))
    return catalogue.nearest_ancestor(rows, "document_id", "folder_path", claims).select("document_id", "prefix")


@query(
    """with recursive e as (select distinct 'work:' || id child, 'work:' || regexp_replace(regexp_replace(parent_work_id, '^[ ]+|[ ]+$', '', 'g'), '\\.0$', '') parent from metadata_id_registry where status = 'active' and kind = 'work' and trim(parent_work_id) <> '' and regexp_full_match(regexp_replace(regexp_replace(parent_work_id, '^[ ]+|[ ]+$', '', 'g'), '\\.0$', ''), '[1-9][0-9]*')),
    up as (select child, parent, 1 depth from e union select u.child, e.parent, u.depth + 1 from up u join e on e.child = u.parent where u.depth < 6) select child, parent, min(depth)::int depth from up group by 1, 2"""
)
def j28_ancestor_closure(spark: SparkSession, root: str) -> DataFrame:
    """Ancestors up to six levels of registered works; ids mean the same number however they are typed."""
    works = table(spark, root, "metadata_id_registry").where("status = 'active' and kind = 'work'")
    cleaned = works.select(F.concat(F.lit("work:"), clean_id(F.col("id"))).alias("child"), F.concat(F.lit("work:"), clean_id(F.col("parent_work_id"))).alias("parent"))
    edges = cleaned.where("child is not null and parent is not null").distinct()
    up = edges.withColumn("depth", F.lit(1))
    every = up
    for depth in range(2, 7):
        up = up.select("child", F.col("parent").alias("via")).distinct().join(edges.select(F.col("child").alias("via"), "parent"), "via").select("child", "parent", F.lit(depth).alias("depth"))
        every = every.unionByName(up)
    return every.groupBy("child", "parent").agg(F.min("depth").alias("depth"))


@query(f"with {LATEST}, d as (select distinct doc_id, work_id from documents) select l.document_id, d.doc_id from latest l join d on d.doc_id = l.doc_id and d.work_id is not distinct from l.work_id")
def j4_two_keys(spark: SparkSession, root: str) -> DataFrame:
    """Documents joined to their manifest rows on number and work."""
    documents = table(spark, root, "documents").select(F.col("doc_id").alias("d"), F.col("work_id").alias("w"))
    rows = manifest(spark, root)
    return rows.join(documents, (F.col("doc_id") == F.col("d")) & F.col("work_id").eqNullSafe(F.col("w"))).select("document_id", "doc_id")


@query("with r as (select distinct kind, path, id, registered_at, row_no, 1 run from metadata_id_registry where status = 'active' union select distinct kind, path, id, registered_at, row_no, 2 from metadata_id_registry where status <> 'active') select kind, path, id, run::int run from r qualify row_number() over (partition by kind, path order by run, registered_at, row_no) = 1")
def j26_union_of_runs(spark: SparkSession, root: str) -> DataFrame:
    """Rows of two runs, one per kind and path, those of the first run first."""
    rows = table(spark, root, "metadata_id_registry").withColumn("run", F.when(F.col("status") == "active", 1).otherwise(2))
    first = rows.groupBy("kind", "path").agg(F.min(F.struct("run", "registered_at", "row_no", "id")).alias("r"))
    return first.select("kind", "path", "r.id", "r.run")


@query(f"with n as (select doc_id, {NORM} s from documents), h as (select s[i:i + 1] source_form, doc_id from n, unnest(range(1, length(s))) u(i) where regexp_full_match(s[i:i + 1], '公[曰言]')) select '公曰' query_form, source_form, count(*) occurrences, count(distinct doc_id) documents from h group by 2")
def a15_matched_forms(spark: SparkSession, root: str) -> DataFrame:
    """Forms found for a term of equivalent characters."""
    hits = search.find_hits(bodies(spark, root), SearchSpec(("公曰",), classes=("曰言",)))
    return hits.groupBy(normalised(F.col("matched")).alias("source_form")).agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("documents")).withColumn("query_form", F.lit("公曰"))


@query()
def a17_term_order(spark: SparkSession, root: str) -> DataFrame:
    """In which order the terms of proximity hits stand."""
    hits = search.find_hits(bodies(spark, root), SearchSpec(("是以", "未嘗不"), mode="proximity", span=40))
    order = F.array_join(F.transform(F.array_sort(F.transform("term_matches", lambda t: F.struct(t["search_start"].alias("s"), t["term_index"].alias("t")))), lambda x: x["t"].cast("string")), ">")
    return hits.groupBy(order.alias("term_order")).agg(F.count("*").alias("occurrences"), F.percentile(F.col("search_end") - F.col("search_start"), 0.5).alias("median_span"))


@query(f"with n as (select doc_id, ((length({NORM}) - length(replace({NORM}, '是以', ''))) // 2)::int n from documents), h as (select doc_id, unnest(range(n)) k from n where n > 0) select doc_id, k::int hit, row_number() over (order by doc_id, k) occurrence_id from h")
def w12_occurrence_ids(spark: SparkSession, root: str) -> DataFrame:
    """Running numbers of hits in document order, without gathering them in one task."""
    counted = table(spark, root, "documents").select("doc_id", count_exact(normalised(F.col("text")), "是以").alias("n")).where("n > 0")
    hits = counted.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("hit"))
    return catalogue.numbered(hits, ["doc_id", "hit"], "occurrence_id")


@query(
    f"""with {LATEST}, o as (select document_id, folder_path, path, case when regexp_matches(title, '序|凡例|目[錄录]') then 0 when regexp_matches(title, '附|補遺|补遗') then 2 when regexp_matches(title, '跋|後序|后序') then 3 else 1 end part, coalesce(nullif(regexp_extract(path, '_juan_([0-9]+)', 1), '')::bigint, 0) juan from latest)
    select document_id, row_number() over (partition by folder_path order by part, juan, path)::int place from o"""
)
def o9_natural_order(spark: SparkSession, root: str) -> DataFrame:
    """Documents of each folder in natural order."""
    return characters.natural_order(manifest(spark, root), "folder_path", "title").select("document_id", "place")


@query("with w as (select unnest(['之', '者', '也', '曰']) term, 0 k union all select term, 1 from (select ch as term from (select unnest(string_split(text, '')) ch from documents where text is not null) where regexp_full_match(ch, '[" + SQL_HAN + "]') group by 1 order by count(*) desc, 1 limit 20)) select term, min(k)::int first_list from w group by 1")
def a37_warm_terms(spark: SparkSession, root: str) -> DataFrame:
    """Terms to index first: given headwords and the most frequent characters, each once."""
    top = index.character_counts(table(spark, root, "documents"), "text", True).orderBy(F.desc("n"), "ch").limit(20)
    given = spark.createDataFrame([(c,) for c in "之者也曰"], "term string").withColumn("k", F.lit(0))
    return given.unionByName(top.select(F.col("ch").alias("term"), F.lit(1).alias("k"))).groupBy("term").agg(F.min("k").alias("first_list"))


@query(f"with {LATEST}, g as (select period, sum(occurrences)::bigint occurrences from latest group by 1 order by 2 desc, 1 limit 20) select period, occurrences, row_number() over (order by period nulls last)::int place from g")
def a32_chart_rows(spark: SparkSession, root: str) -> DataFrame:
    """The groups of a chart: the largest, sorted again by name."""
    top = manifest(spark, root).groupBy("period").agg(F.sum("occurrences").alias("occurrences")).orderBy(F.desc("occurrences"), F.asc_nulls_last("period")).limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("period"))))


@query(r"select doc_id, sha256(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '（([^（）]*)$', '（\1）', 'g')) fingerprint from documents where text is not null")
def x31_hygiene(spark: SparkSession, root: str) -> DataFrame:
    """Texts with runs of blank lines cut and a last open bracket closed."""
    t = F.regexp_replace(F.regexp_replace("text", r"\n{3,}", "\n\n"), r"（([^（）]*)\z", "（$1）")
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2(t, 256).alias("fingerprint"))


@query()
def x14_dates(spark: SparkSession, root: str) -> DataFrame:
    """The documents' date texts: the number before 年, and the date where a calendar names the year."""
    dates = table(spark, root, "document_counts").where("date_text is not null").select("date_text").distinct()
    return dates.select("date_text", scalars.parse_numeral(F.regexp_extract("date_text", "([0-9一二三四五六七八九十百千〇元]+)年", 1)).alias("year"), scalars.resolved_date(F.col("date_text")).alias("resolved"))


@query("with y as (select distinct year_start from people where year_start is not null), e(era, low, high) as (values ('漢', -202, 220), ('唐', 618, 907), ('宋', 960, 1279), ('明', 1368, 1644), ('清', 1636, 1912)) select year_start, era, ((case when year_start < 0 then year_start + 1 else year_start end) - (case when low < 0 then low + 1 else low end) + 1)::int era_year from y join e on year_start between low and high")
def x13_era_years(spark: SparkSession, root: str) -> DataFrame:
    """Year of the era for each year, across the missing year zero."""
    from quillspark.functions.text import astronomical

    eras = spark.createDataFrame([("漢", -202, 220), ("唐", 618, 907), ("宋", 960, 1279), ("明", 1368, 1644), ("清", 1636, 1912)], "era string, low int, high int")
    years = table(spark, root, "people").where("year_start is not null").select("year_start").distinct()
    found = catalogue.in_interval(years, "year_start", eras, "low", "high")
    return found.select("year_start", "era", (astronomical(F.col("year_start")) - astronomical(F.col("low")) + 1).alias("era_year"))


@query(f"with c as (select doc_id, length(regexp_replace({NORM}, '[^之也者矣]', '', 'g')) classical, length(regexp_replace({NORM}, '[^的了們這]', '', 'g')) modern, length(regexp_replace({NORM}, '[^吾余予汝爾]', '', 'g')) pronouns, length({NORM}) n from documents) select doc_id, classical, modern, pronouns, case when n > 0 then (2 * classical - 3 * modern) * 100.0 / n else 0 end score from c")
def c8_density_score(spark: SparkSession, root: str) -> DataFrame:
    """The older score from character densities, with profile counters."""
    s = normalised(F.col("text"))
    count = lambda kept: F.length(F.regexp_replace(s, f"[^{kept}]", ""))
    rows = table(spark, root, "documents").select("doc_id", count("之也者矣").alias("classical"), count("的了們這").alias("modern"), count("吾余予汝爾").alias("pronouns"), F.length(s).alias("n"))
    return rows.select("doc_id", "classical", "modern", "pronouns", F.when(F.col("n") > 0, (2 * F.col("classical") - 3 * F.col("modern")) * 100.0 / F.col("n")).otherwise(0.0).alias("score"))


@query(f"select doc_id, len(regexp_extract_all({NORM}, '[卜貞][^卜貞]{{0,6}}[貞卜]'))::int contexts from documents where regexp_matches({NORM}, '[卜貞]')")
def m23_contextual(spark: SparkSession, root: str) -> DataFrame:
    """Characters recognised by what stands near them."""
    s = normalised(F.col("text"))
    return table(spark, root, "documents").where(s.rlike("[卜貞]")).select("doc_id", F.size(F.regexp_extract_all(s, F.lit("[卜貞][^卜貞]{0,6}[貞卜]"), F.lit(0))).alias("contexts"))


@query(
    """with m as (select distinct mention_no, work_key, display_name from work_people), p as (select distinct person_no, name_han, year_start, year_end, country from people where name_han is not null), w as (select distinct work_key, year_start y, nation from works),
    c as (select mention_no, person_no, 82 + case when y between year_start and year_end then 22 when y is null or year_start is null or year_end is null then 0 else -10 end + case when nation = country then 8 when nation is null or country is null then 0 else -3 end score from m join w using (work_key) join p on p.name_han = m.display_name)
    select mention_no, person_no, score::int score, dense_rank() over (partition by mention_no order by score desc)::int place from c"""
)
def m22_candidate_scores(spark: SparkSession, root: str) -> DataFrame:
    """Persons for names as typed, scored by time and country."""
    mentions = table(spark, root, "work_people").select("mention_no", "work_key", "display_name").distinct()
    people = table(spark, root, "people").where("name_han is not null").select("person_no", "name_han", "year_start", "year_end", "country").distinct()
    works = table(spark, root, "works").select("work_key", F.col("year_start").alias("y"), "nation").distinct()
    time = F.when(F.col("y").between(F.col("year_start"), F.col("year_end")), 22).when(F.col("y").isNull() | F.col("year_start").isNull() | F.col("year_end").isNull(), 0).otherwise(-10)
    place = F.when(F.col("nation") == F.col("country"), 8).when(F.col("nation").isNull() | F.col("country").isNull(), 0).otherwise(-3)
    scored = mentions.join(works, "work_key").join(people, F.col("display_name") == F.col("name_han")).select("mention_no", "person_no", (F.lit(82) + time + place).alias("score"))
    return scored.withColumn("place", F.dense_rank().over(Window.partitionBy("mention_no").orderBy(F.desc("score"))))


@query(f"with n as (select source, {NORM} s from documents where text is not null), k as (select source, s, count(*) n from n where s <> '' group by 1, 2) select source, count(*) bodies, sum(n)::bigint documents, sum(n - 1)::bigint copies from k group by 1")
def q15_exact_copies(spark: SparkSession, root: str) -> DataFrame:
    """Bodies and exact copies per source, after normalisation."""
    streams = table(spark, root, "documents").where("text is not null").select("source", F.sha2(normalised(F.col("text")), 256).alias("s"), (normalised(F.col("text")) != "").alias("some")).where("some")
    return streams.groupBy("source", "s").agg(F.count("*").alias("n")).groupBy("source").agg(F.count("*").alias("bodies"), F.sum("n").alias("documents"), F.sum(F.col("n") - 1).alias("copies"))
