"""Queries of catalogue operators, joins, windows and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import astronomical, title_key
from quillspark.operators import catalogue, index
from quillspark.plans.corpus import LATEST, SQL_IGNORED, manifest
from quillspark.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _works(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "works").dropDuplicates(["work_no"])


def _forms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "title_forms").dropDuplicates(["form_no"])




def _title_key(column: str) -> str:
    return f"lower(regexp_replace(regexp_replace(coalesce({column}, ''), '[（(][^）)]*[）)]', '', 'g'), '{SQL_IGNORED}', '', 'g'))"


_ASKED = "八論"
_RANKS = (
    f"f as (select distinct * from title_forms), r as (select *, case when form = '{_ASKED}' and form_kind = 'exact_title' then 0 when form = '{_ASKED}' then 1 when starts_with(form, '{_ASKED}') then 2 when contains(form, '{_ASKED}') then 3 "
    f"when {_title_key('form')} = '{_ASKED}' then 4 when starts_with({_title_key('form')}, '{_ASKED}') then 5 when contains({_title_key('form')}, '{_ASKED}') then 6 end as rank from f)"
)


@query(
    f"""with {_RANKS}, b as (select work_key, min(struct_pack(rank := rank, form := form)) b from r where rank is not null group by 1), w as (select distinct * from works)
    select work_key, display_title, sort_year, b.rank as rank, b.form matched_form from w join b using (work_key) order by macro_region nulls first, sort_year nulls last, b.rank, display_title, work_key limit 100"""
)
def q1_title_search(spark: SparkSession, root: str) -> DataFrame:
    """Works whose titles match, by kind of match."""
    return catalogue.title_search(_works(spark, root), _forms(spark, root), _ASKED).select("work_key", "display_title", "sort_year", "rank", "matched_form")


@query(f"with {_RANKS} select form_no, rank from r where rank is not null")
def o4_title_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Every matching title form with its rank."""
    return catalogue.title_ranks(_forms(spark, root), _ASKED).select("form_no", "rank")


@query("with w as (select distinct * from works) select work_key, sort_year, (select count(*) from w) total from w order by sort_year desc nulls last, display_title, work_key limit 50 offset 50")
def q2_timeline(spark: SparkSession, root: str) -> DataFrame:
    """The second page of the timeline, latest first, undated last, with the total."""
    return catalogue.timeline(_works(spark, root), True, 2, 50).select("work_key", "sort_year", "total")


@query("with p as (select distinct * from work_people), w as (select distinct * from works) select name_key, work_key, role, display_title, sort_year from p join w using (work_key) where role in ('author', 'compiler')")
def q3_works_for_people(spark: SparkSession, root: str) -> DataFrame:
    """Works of each person as author or compiler."""
    people = table(spark, root, "work_people").dropDuplicates(["mention_no"]).where("role in ('author', 'compiler')")
    return people.join(_works(spark, root), "work_key").select("name_key", "work_key", "role", "display_title", "sort_year")


@query(
    f"""with {LATEST} select coalesce(nullif(trim(work_id), ''), folder_path) work_group, count(*) documents, min(struct_pack(p := path, v := title)).v first_title, list_sort(list_distinct(list(document_role))) roles from latest group by 1"""
)
def q4_work_groups(spark: SparkSession, root: str) -> DataFrame:
    """Documents grouped by work id, else by folder, with the first title and the roles."""
    grouped = manifest(spark, root).groupBy(F.coalesce(F.nullif(F.trim("work_id"), F.lit("")), "folder_path").alias("work_group"))
    return grouped.agg(F.count("*").alias("documents"), F.min_by("title", "path").alias("first_title"), F.sort_array(F.collect_set("document_role")).alias("roles"))


@query("with f as (select distinct * from title_forms), b as (select work_key, min(struct_pack(k := case form_kind when 'exact_title' then 0 when 'base_title' then 1 else 2 end, f := form)) b from f group by 1) select work_key, b.f best_form, b.k::int kind from b")
def j5_best_form(spark: SparkSession, root: str) -> DataFrame:
    """The best form of each work: exact title, then base title, then any."""
    kind = F.when(F.col("form_kind") == "exact_title", 0).when(F.col("form_kind") == "base_title", 1).otherwise(2)
    best = _forms(spark, root).groupBy("work_key").agg(F.min(F.struct(kind.alias("k"), F.col("form").alias("f"))).alias("b"))
    return best.select("work_key", F.col("b.f").alias("best_form"), F.col("b.k").alias("kind"))


@query("with w as (select distinct * from works), m as (select work_key, count(*) mentions from (select distinct * from work_people) group by 1) select w.work_key, coalesce(mentions, 0) mentions, count(*) over () total from w left join m using (work_key)")
def j6_total_beside_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every work with its mentions, and the number of all works beside each."""
    mentions = table(spark, root, "work_people").dropDuplicates(["mention_no"]).groupBy("work_key").agg(F.count("*").alias("mentions"))
    works = _works(spark, root).select("work_key")
    return works.join(mentions, "work_key", "left").select("work_key", F.coalesce("mentions", F.lit(0)).alias("mentions")).withColumn("total", works.agg(F.count("*")).scalar())


@query("with w as (select distinct * from works) select work_key from w where work_key in (select work_key from work_people where role = 'preface') and work_key not in (select work_key from work_people where role = 'editor')")
def j10_semi_anti(spark: SparkSession, root: str) -> DataFrame:
    """Works with a preface and without an editor."""
    people = table(spark, root, "work_people")
    return _works(spark, root).select("work_key").join(people.where("role = 'preface'").select("work_key"), "work_key", "left_semi").join(people.where("role = 'editor'").select("work_key"), "work_key", "left_anti")


@query(
    """with f as (select distinct name_chn form, source family from names where length(name_chn) >= 2), s as (select form[1] ch, family, count(*) n from f group by 1, 2)
    select family, form, coalesce((select sum(n) from s where s.ch = f.form[-1] and s.family <> f.family), 0)::bigint branches from f"""
)
def j12_chain_branches(spark: SparkSession, root: str) -> DataFrame:
    """How many forms of other families may follow each form in a chain."""
    forms = table(spark, root, "names").where("length(name_chn) >= 2").select(F.col("source").alias("family"), F.col("name_chn").alias("form")).distinct()
    return catalogue.chain_pairs(forms)


_ERAS = [("漢", -202, 220), ("唐", 618, 907), ("宋", 960, 1279), ("元", 1271, 1368), ("明", 1368, 1644), ("清", 1636, 1912), ("江戶", 1603, 1868)]


@query("with e(era, low, high) as (values " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _ERAS) + ") select work_no, sort_year, era from (select distinct work_no, sort_year from works) w join e on w.sort_year between e.low and e.high")
def j13_years_in_eras(spark: SparkSession, root: str) -> DataFrame:
    """Eras that each work's year falls into."""
    eras = spark.createDataFrame(_ERAS, "era string, low int, high int")
    return catalogue.in_interval(_works(spark, root).select("work_no", "sort_year").where("sort_year is not null"), "sort_year", eras, "low", "high").select("work_no", "sort_year", "era")


@query("with e(era, low, high) as (values " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _ERAS) + "), p as (select distinct person_no, year_start, year_end from people where year_start is not null and year_end is not null and year_start <= year_end) select person_no, era, (least(year_end, high) - greatest(year_start, low) + 1)::int overlap from p join e on year_start <= high and year_end >= low")
def j14_life_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """Eras that lives overlap with, and for how many years."""
    eras = F.broadcast(spark.createDataFrame(_ERAS, "era string, low int, high int"))  # a fixed list
    lives = table(spark, root, "people").where("year_start <= year_end").select("person_no", "year_start", "year_end").distinct()
    overlap = (F.least("year_end", "high") - F.greatest("year_start", "low") + 1).cast("int")
    return lives.join(eras, (F.col("year_start") <= F.col("high")) & (F.col("year_end") >= F.col("low"))).select("person_no", "era", overlap.alias("overlap"))


@query(f"with {LATEST}, k as (select work_key, {_title_key('display_title')} k from (select distinct work_key, display_title from works)) select document_id, min(work_key) work_key from latest join k on {_title_key('latest.title')} = k.k and k.k <> '' group by 1")
def j15_titles_to_works(spark: SparkSession, root: str) -> DataFrame:
    """Documents joined to works by normalised title, the smallest work key first."""
    keys = _works(spark, root).select("work_key", title_key(F.col("display_title")).alias("k")).where("k <> ''").distinct()
    documents = manifest(spark, root).select("document_id", title_key(F.col("title")).alias("k"))
    return documents.join(keys, "k").groupBy("document_id").agg(F.min("work_key").alias("work_key"))


@query()
def j16_fuzzy_titles(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue summaries' titles matched to works' titles by likeness."""
    asked = table(spark, root, "category_work_summary").select(title_key(F.col("work_title")).alias("ask")).where("length(ask) >= 2")
    titles = _works(spark, root).select(title_key(F.col("base_title")).alias("title")).where("length(title) >= 2")
    return catalogue.fuzzy_titles(asked, titles)


@query("with n as (select distinct entity_id, source, derivation, name_chn from names), w as (pivot n on derivation in ('explicit', 'variant', 'surname_style') using count(*) group by source, entity_id) select source, entity_id, explicit, variant, surname_style from w")
def j18_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Forms per entity, one column per derivation."""
    names = table(spark, root, "names").select("entity_id", "source", "derivation", "name_chn").distinct()
    return names.groupBy("source", "entity_id").pivot("derivation", ["explicit", "variant", "surname_style"]).count().fillna(0)


@query("with p as (select distinct person_no, polity, country from people), g as (select polity, min(country) low, max(country) high from p where country is not null group by 1) select person_no, coalesce(country, case when low = high then low end) as label, case when country is not null then 'known' when low = high then 'propagated' when low is not null then 'ambiguous' else 'unknown' end status from p left join g using (polity)")
def j20_propagate(spark: SparkSession, root: str) -> DataFrame:
    """Countries propagated from persons of the same polity where they agree."""
    people = table(spark, root, "people").select("person_no", "polity", "country").distinct()
    return catalogue.propagate_unique(people, "polity", "country").select("person_no", "label", "status")


@query(
    f"""with {LATEST}, o as (select distinct folder_path prefix, min(work_no) as owner from works group by 1), a as (select document_id, string_split(path, '/') s from latest),
    x as (select document_id, array_to_string(s[:k], '/') prefix, k from a, unnest(range(1, 65)) u(k) where k <= len(s)) select document_id, max_by(prefix, k) prefix, max_by(owner, k) as owner from x join o using (prefix) group by 1"""
)
def j21_nearest_ancestor(spark: SparkSession, root: str) -> DataFrame:
    """The work whose folder is the nearest ancestor of each document."""
    owners = table(spark, root, "works").groupBy(F.col("folder_path").alias("prefix")).agg(F.min("work_no").alias("owner"))
    return catalogue.nearest_ancestor(manifest(spark, root), "document_id", "path", owners)


@query(
    """with c as (select distinct author profile, unnest(json_extract_string(categories_json, '$[*]')) item, work_no from works where author is not null and author <> '佚名'), n as (select profile, item, count(distinct work_no) n from c group by 1, 2),
    t as (select count(distinct profile) t from n), d as (select item, count(*) df from n group by 1), w as (select profile, item, sqrt(n) * ln(t / df) w, df <= greatest(2, t * 0.1) links from n join d using (item), t), s as (select profile, sqrt(sum(w * w)) norm, count(*) items from w group by 1),
    l as (select distinct a.profile a, b.profile b from w a join w b on a.item = b.item and a.profile < b.profile and a.links), x as (select l.a, l.b, sum(u.w * v.w) dot, count(*) shared from l join w u on u.profile = l.a join w v on v.profile = l.b and v.item = u.item group by 1, 2)
    select a, b, shared, coalesce(dot / nullif(sa.norm * sb.norm, 0), 0) cosine, shared / least(sa.items, sb.items) containment from x join s sa on sa.profile = a join s sb on sb.profile = b"""
)
def j23_profile_cosines(spark: SparkSession, root: str) -> DataFrame:
    """Authors likened by the categories of their works."""
    spread = _works(spark, root).where("author is not null and author <> '佚名'").select(F.col("author").alias("profile"), "work_no", F.explode(F.from_json("categories_json", "array<string>")).alias("item"))
    return catalogue.profile_cosines(spread.groupBy("profile", "item").agg(F.countDistinct("work_no").alias("n")))


@query(
    f"""with w as (select distinct * from works), m as (select {_title_key('base_title')} k, min(struct_pack(o := work_no, v := period)).v v from w where period <> '' group by 1)
    select summary_no, work_title, coalesce(m.v, category_path) as value, case when m.v is null then 'unmatched' when m.v = category_path then 'same' else 'updated' end status from (select distinct * from category_work_summary) c left join m on {_title_key('work_title')} = m.k"""
)
def j24_update(spark: SparkSession, root: str) -> DataFrame:
    """Summaries updated from works by normalised title, the first mapping winning."""
    mapping = _works(spark, root).where("period <> ''").select(title_key(F.col("base_title")).alias("map_key"), F.col("work_no").alias("map_order"), F.col("period").alias("new_value"))
    rows = table(spark, root, "category_work_summary").dropDuplicates(["summary_no"])
    return catalogue.update_from(rows, title_key(F.col("work_title")), mapping, "category_path").select("summary_no", "work_title", "value", "status")


@query(
    """with p as (select name_han, max(year_start) s, max(year_end) e, count(*) n from (select distinct person_no, name_han, year_start, year_end from people where name_han is not null) group by 1 having count(*) = 1), m as (select distinct mention_no, work_key, display_name from work_people),
    x as (select work_key, max(s) low, min(e) high, count(*) members, count(*) filter (where s is not null and e is not null) resolved from m left join p on p.name_han = m.display_name group by 1)
    select work_key, members, resolved, case when members = resolved and low <= high then low end low, case when members = resolved and low <= high then high end high from x"""
)
def j25_common_interval(spark: SparkSession, root: str) -> DataFrame:
    """Years in which all people named in a work lived."""
    people = table(spark, root, "people").where("name_han is not null").select("person_no", "name_han", "year_start", "year_end").distinct()
    unique = people.groupBy("name_han").agg(F.max("year_start").alias("start"), F.max("year_end").alias("end"), F.count("*").alias("n")).where("n = 1")
    mentions = table(spark, root, "work_people").select("mention_no", "work_key", "display_name").distinct()
    return catalogue.common_interval(mentions.join(unique, mentions["display_name"] == unique["name_han"], "left"), "work_key")


@query(
    f"""with {LATEST}, claims(prefix, polity) as (values ('中國漢文/clean/唐朝', '唐'), ('中國漢文', '中國'), ('日本漢文/clean/江戶時代', '江戶')), a as (select document_id, polity as own, string_split(folder_path, '/') s from latest),
    x as (select document_id, array_to_string(s[:k], '/') prefix, k from a, unnest(range(1, 65)) u(k) where k <= len(s)), c as (select document_id, max_by(polity, k) polity from x join claims using (prefix) group by 1)
    select a.document_id, coalesce(c.polity, a.own) polity, case when c.polity is not null then 'claimed' when a.own is not null then 'metadata' else 'none' end status from a left join c using (document_id)"""
)
def j27_claims(spark: SparkSession, root: str) -> DataFrame:
    """Polities claimed by folders; metadata only where no folder claims."""
    claims = spark.createDataFrame([("中國漢文/clean/唐朝", "唐"), ("中國漢文", "中國"), ("日本漢文/clean/江戶時代", "江戶")], "prefix string, owner string")
    documents = manifest(spark, root).select("document_id", "folder_path", "polity")
    claimed = catalogue.nearest_ancestor(documents, "document_id", "folder_path", claims).select("document_id", "owner")
    joined = documents.join(claimed, "document_id", "left")
    return joined.select("document_id", F.coalesce("owner", "polity").alias("polity"), F.when(F.col("owner").isNotNull(), "claimed").when(F.col("polity").isNotNull(), "metadata").otherwise("none").alias("status"))


@query(f"with {LATEST}, m as (select document_id, work_id, path, (document_role <> 'canonical')::int a, len(string_split(path, '/')) b, length(path) c from latest where trim(work_id) <> '') select work_id, document_id, path from m qualify row_number() over (partition by work_id order by a, b, c, path) = 1")
def w6_representative(spark: SparkSession, root: str) -> DataFrame:
    """One document per work."""
    return catalogue.representative(manifest(spark, root).where("trim(work_id) <> ''"), "work_id")


@query("with w as (select distinct * from works) select work_no, lag(work_no) over (partition by corpus_root order by sort_year nulls last, work_no) previous_no, lead(work_no) over (partition by corpus_root order by sort_year nulls last, work_no) next_no from w")
def w7_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Previous and next work of each corpus root in time."""
    along = Window.partitionBy("corpus_root").orderBy(F.asc_nulls_last("sort_year"), "work_no")
    return _works(spark, root).select("work_no", F.lag("work_no").over(along).alias("previous_no"), F.lead("work_no").over(along).alias("next_no"))


_HAN_ONLY = "regexp_replace(coalesce(text, ''), '[^\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}]', '', 'g')"


@query(f"with h as (select doc_id, {_HAN_ONLY} t from documents) select doc_id, s::int as start, sha256(t[s + 1:s + 300]) window_fingerprint from h, unnest(range(0, greatest(length(t), 1), 200)) u(s) where length(t) > 0 and (s = 0 or s + 100 < length(t))")
def w8_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows of 300 Han characters every 200."""
    han = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]", "")
    return catalogue.windows_of(table(spark, root, "documents").select("doc_id", han.alias("text")), 300, 200).select("doc_id", "start", F.sha2("window", 256).alias("window_fingerprint"))


@query(
    r"""with l as (select doc_id, unnest(range(len(s))) line, unnest(s) t from (select doc_id, string_split(text, chr(10)) s from documents where text is not null)),
    m as (select *, length(regexp_replace(t, '[^\p{Han}]', '', 'g')) han, length(regexp_replace(t, '[^\p{Hiragana}\p{Katakana}]', '', 'g')) kana from l), k as (select * from m where han >= 5 and kana <= 0.03 * (han + kana)),
    i as (select *, line - row_number() over (partition by doc_id order by line) island from k) select doc_id, min(line)::int first_line, max(line)::int last_line, sum(han)::bigint han from i group by doc_id, island having sum(han) >= 80"""
)
def w13_han_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of Han-dominant lines."""
    return catalogue.han_runs(table(spark, root, "documents").where("text is not null").select("doc_id", "text"))


@query("with a as (select distinct document_id from document_counts), b as (select distinct id from metadata_id_registry where kind = 'document' and status = 'active') select document_id as id, 'unregistered' status from a where document_id not in (select id from b) union all select id, 'not exported' from b where id not in (select document_id from a)")
def u5_differences(spark: SparkSession, root: str) -> DataFrame:
    """Exported documents that no registry row names, and registered ones never exported."""
    exported = table(spark, root, "document_counts").select(F.col("document_id").alias("id")).distinct()
    registered = table(spark, root, "metadata_id_registry").where("kind = 'document' and status = 'active'").select("id").distinct()
    return exported.exceptAll(registered).withColumn("status", F.lit("unregistered")).unionByName(registered.exceptAll(exported).withColumn("status", F.lit("not exported")))


@query("select distinct name_key as entry, 'person' kind from work_people union select distinct display_title, 'work' from works union select distinct form, 'form' from title_forms")
def u6_union_index(spark: SparkSession, root: str) -> DataFrame:
    """Names, works and forms in one index."""
    parts = (("work_people", "name_key", "person"), ("works", "display_title", "work"), ("title_forms", "form", "form"))
    one, two, three = (table(spark, root, t).select(F.col(c).alias("entry"), F.lit(k).alias("kind")) for t, c, k in parts)
    return one.union(two).union(three).distinct()


@query("with a as (select work_key from work_people where role = 'author' intersect select work_key from work_people where role = 'preface'), b as (select work_key from work_people where role = 'editor') select work_key, work_key in (select work_key from b) added from (select * from a union select * from b)")
def u2_combine(spark: SparkSession, root: str) -> DataFrame:
    """Constraint sets combined: (author and preface) or editor, with what the second side added."""
    of = lambda role: table(spark, root, "work_people").where(F.col("role") == role).select("work_key").distinct()
    both = of("author").intersect(of("preface"))
    return both.union(of("editor")).distinct().join(of("editor").withColumn("added", F.lit(True)), "work_key", "left").withColumn("added", F.coalesce("added", F.lit(False)))


@query(
    """with r as (select identity_key entity, id::bigint id from metadata_id_registry where kind = 'work' and regexp_full_match(id, '[0-9]{1,9}')), o as (select entity, min(id) id from r group by 1), w as (select id, min(entity) owner from o group by 1),
    m as (select o.*, o.entity = w.owner kept from o join w using (id)) select entity, case when kept then id else (select max(id) from o) + row_number() over (partition by kept order by entity) end id, case when kept then 'kept' else 'new' end status from m"""
)
def u7_repaired_ids(spark: SparkSession, root: str) -> DataFrame:
    """One id per registered work, clashes renumbered."""
    rows = table(spark, root, "metadata_id_registry").where("kind = 'work'").where(F.col("id").rlike("^[0-9]{1,9}$")).select(F.col("identity_key").alias("entity"), F.col("id").cast("bigint").alias("id"))
    return catalogue.repaired_ids(rows)


@query("select person_no, case when year_start < 0 then year_start + 1 else year_start end astronomical, case when year_start is not null and year_end is not null then (case when year_end < 0 then year_end + 1 else year_end end) - (case when year_start < 0 then year_start + 1 else year_start end) end lifespan from (select distinct person_no, year_start, year_end from people)")
def x12_years(spark: SparkSession, root: str) -> DataFrame:
    """Astronomical years and life spans across the missing year zero."""
    people = table(spark, root, "people").select("person_no", "year_start", "year_end").distinct()
    return people.select("person_no", astronomical(F.col("year_start")).alias("astronomical"), (astronomical(F.col("year_end")) - astronomical(F.col("year_start"))).alias("lifespan"))


@query("select document_id, coalesce(nullif(regexp_extract(path, '_juan_([0-9]+)', 1), '')::int, 1) juan from document_counts group by all")
def x30_volume_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Volume numbers from file names, 1 without."""
    number = F.coalesce(F.nullif(F.regexp_extract("path", "_juan_([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1))
    return table(spark, root, "document_counts").select("document_id", number.alias("juan")).distinct()


@query(f"with {LATEST} select document_id, json_extract_string(duplicate_members_json, '$[0].document_id') first_member, json_array_length(duplicate_members_json)::int members from latest where json_valid(duplicate_members_json) and starts_with(duplicate_members_json, '[{{')")
def x29_json_members(spark: SparkSession, root: str) -> DataFrame:
    """Member lists unpacked from JSON."""
    rows = manifest(spark, root).where("startswith(duplicate_members_json, '[{')").select("document_id", F.from_json("duplicate_members_json", "array<struct<document_id: string, path: string>>").alias("m"))
    return rows.where("m is not null").select("document_id", F.col("m")[0]["document_id"].alias("first_member"), F.size("m").alias("members"))


@query("select name_chn, unicode(name_chn) code_point, upper(printf('U+%04X', unicode(name_chn))) label from (select distinct name_chn from names where name_chn <> '')")
def x27_code_points(spark: SparkSession, root: str) -> DataFrame:
    """First code point of each name, and its label."""
    names = table(spark, root, "names").where("name_chn <> ''").select("name_chn").distinct()
    code = F.ascii("name_chn")
    return names.select("name_chn", code.alias("code_point"), F.concat(F.lit("U+"), F.when(F.length(F.hex(code)) < 4, F.lpad(F.hex(code), 4, "0")).otherwise(F.hex(code))).alias("label"))


@query("select name_key, list_sort(list_distinct(regexp_extract_all(display_name, '\\p{Han}{2,16}'))) han_runs from work_people group by name_key, display_name")
def x26_name_keys(spark: SparkSession, root: str) -> DataFrame:
    """Han runs of names as typed."""
    return table(spark, root, "work_people").select("name_key", "display_name").distinct().select("name_key", F.sort_array(F.array_distinct(F.regexp_extract_all("display_name", F.lit(r"\p{IsHan}{2,16}"), F.lit(0)))).alias("han_runs"))


@query("with r as (select distinct * from metadata_id_registry) select kind, id, title, path, status from r qualify row_number() over (partition by kind, id order by registered_at desc, row_no desc) = 1")
def s16_last_upsert(spark: SparkSession, root: str) -> DataFrame:
    """The registry after upserts: the last row of each id wins."""
    rows = table(spark, root, "metadata_id_registry").withColumn("_o", F.struct("registered_at", "row_no"))
    return index.latest_by(rows, ["kind", "id"], "_o").select("kind", "id", "title", "path", "status")


@query("with p as (select distinct string_split(folder_path, '/') s from document_counts) select distinct array_to_string(s[:k], '/') directory from p, unnest(range(1, 65)) u(k) where k <= len(s)")
def s13_directories(spark: SparkSession, root: str) -> DataFrame:
    """All directories of the corpus."""
    folders = table(spark, root, "document_counts").select("folder_path").distinct()
    return folders.select(F.explode(catalogue.ancestors(F.col("folder_path"))).alias("a")).select(F.col("a.prefix").alias("directory")).distinct()


@query("select count(*) as n, count(distinct name_no) distinct_numbers, min(name_no) low, max(name_no) high, max(name_no) - min(name_no) + 1 = count(distinct name_no) contiguous, count(*) filter (where length(name_chn) <> name_length) wrong_lengths from names")
def s17_constraints(spark: SparkSession, root: str) -> DataFrame:
    """Constraints checked before a load."""
    return table(spark, root, "names").agg(
        F.count("*").alias("n"), F.countDistinct("name_no").alias("distinct_numbers"), F.min("name_no").alias("low"), F.max("name_no").alias("high"),
        (F.max("name_no") - F.min("name_no") + 1 == F.countDistinct("name_no")).alias("contiguous"), F.count_if(F.length("name_chn") != F.col("name_length")).alias("wrong_lengths"),
    )


@query("select distinct substr(name_chn, 1, 2) prefix, length(name_chn)::int size, name_chn from names where regexp_full_match(name_chn, '\\p{Han}{1,16}')")
def s18_name_index(spark: SparkSession, root: str) -> DataFrame:
    """Han names by their first two characters and length."""
    names = table(spark, root, "names").where(F.col("name_chn").rlike(r"^\p{IsHan}{1,16}$"))
    return names.select(F.substring("name_chn", 1, 2).alias("prefix"), F.length("name_chn").alias("size"), "name_chn").distinct()
