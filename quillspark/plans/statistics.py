"""Queries of corpus statistics over the last export of each document, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import century_start, group_name, han_numeral
from quillspark.operators import index
from quillspark.operators import statistics as stats
from quillspark.operators.catalogue import numbered
from quillspark.plans.corpus import LATEST, NORM, SQL_HAN, manifest
from quillspark.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_SUMS = """count(*) documents, count(*) filter (where occurrences > 0) matching_documents, coalesce(sum(occurrences), 0)::bigint occurrences,
  coalesce(sum(searchable_characters), 0)::bigint searchable_characters, avg(occurrences) filter (where occurrences > 0) mean_per_matching,
  quantile_cont(occurrences, 0.5) filter (where occurrences > 0) median_per_matching"""
_RATES = "matching_documents / documents prevalence, case when searchable_characters > 0 then occurrences / searchable_characters * 1e6 else 0 end per_million"
_GROUP = "coalesce(nullif(trim({0}), ''), '(Unknown / unclassified)')"
_FOLDER = f"array_to_string(list_filter(string_split(coalesce(folder_path, ''), '/'), lambda s: s <> '' and not list_contains([{_sql_list(stats.LAYERS)}], s))[:3], ' / ')"
_DIMS = (
    f"spread as (select d.dimension, case d.dimension {' '.join(f'when {chr(39)}{d}{chr(39)} then ' + _GROUP.format(_FOLDER if c == 'folder' else c) for d, c in stats.DIMENSIONS)} end as grp, occurrences, searchable_characters, year_start "
    f"from latest, (select unnest([{_sql_list(d for d, _ in stats.DIMENSIONS)}]) dimension) d), "
    f"tables as (select dimension, grp, {_SUMS}, quantile_cont(nullif(year_start, 0), 0.5) sort_year from spread group by 1, 2)"
)


@query(f"with {LATEST}, s as (select {_SUMS}, count(*) filter (where searchable_characters = 0) empty_documents from latest) select *, {_RATES} from s")
def a1_overall(spark: SparkSession, root: str) -> DataFrame:
    return stats.overall(manifest(spark, root))


@query(
    f"with {LATEST}, {_DIMS} select dimension, grp as \"group\", documents, matching_documents, occurrences, searchable_characters, mean_per_matching, median_per_matching, sort_year, {_RATES}, "
    "coalesce(occurrences / nullif(sum(occurrences) over (partition by dimension), 0), 0) occurrence_share, documents / sum(documents) over (partition by dimension) document_share from tables"
)
def a2_dimensions(spark: SparkSession, root: str) -> DataFrame:
    """The eight dimension tables, in one pass."""
    return stats.by_dimension(manifest(spark, root))


@query(
    f"with {LATEST}, {_DIMS} select grp as \"group\", documents, row_number() over (order by sort_year is null, sort_year, grp) place from tables where dimension = 'period'"
)
def a3_period_order(spark: SparkSession, root: str) -> DataFrame:
    """Periods in chronological order, undated groups last."""
    from pyspark.sql import Window

    periods = stats.by_dimension(manifest(spark, root)).where("dimension = 'period'")
    return periods.select("group", "documents", F.row_number().over(Window.orderBy(F.asc_nulls_last("sort_year"), "group")).cast("bigint").alias("place"))


@query(
    f"""with {LATEST}, {_DIMS}, c as (select dimension, count(*) groups, count(*) filter (where documents = 1) singletons, sum(documents)::bigint documents from tables group by 1)
    select *, not (dimension in ('region', 'polity', 'period') and (groups > greatest(1000, documents * 0.1) or (groups > 500 and singletons > 0.8 * groups))) usable from c"""
)
def a4_usable_dimensions(spark: SparkSession, root: str) -> DataFrame:
    return stats.usable_dimensions(stats.by_dimension(manifest(spark, root)))


@query(
    f"""with {LATEST}, c(place, bucket, least, most) as (values (0, '1', 1, 1), (1, '2', 2, 2), (2, '3–5', 3, 5), (3, '6–10', 6, 10), (4, '11–20', 11, 20), (5, '21–50', 21, 50), (6, '51–100', 51, 100), (7, '101+', 101, 1e18::bigint)),
    n as (select place::int place, bucket, count(occurrences) documents from c left join latest on occurrences between least and most group by 1, 2)
    select place, bucket, documents, documents / greatest((select count(*) from latest where occurrences > 0), 1) share from n"""
)
def a7_histogram(spark: SparkSession, root: str) -> DataFrame:
    return stats.histogram(manifest(spark, root))


@query(
    f"""with {LATEST} select document_id, path, occurrences, case when searchable_characters > 0 then occurrences / searchable_characters * 1e6 else 0 end per_million, occurrences / (select sum(occurrences) from latest) share
    from latest where occurrences > 0 order by occurrences desc, path limit 100"""
)
def a8_top_documents(spark: SparkSession, root: str) -> DataFrame:
    return stats.top_documents(manifest(spark, root)).select("document_id", "path", "occurrences", "per_million", "share")


@query(
    f"""with {LATEST}, r as (select occurrences, row_number() over (order by occurrences desc, path) k from latest), t as (select greatest(sum(occurrences), 1) t from latest)
    select sum(occurrences) filter (where k <= 1) / any_value(t) top1_share, sum(occurrences) filter (where k <= 5) / any_value(t) top5_share, sum(occurrences) filter (where k <= 10) / any_value(t) top10_share from r, t"""
)
def a9_concentration(spark: SparkSession, root: str) -> DataFrame:
    return stats.concentration(manifest(spark, root))


@query(f"with {LATEST} select document_id, sha256('202609:' || document_id) sample_hash from latest where occurrences > 0 order by 2 limit 100")
def a10_sample(spark: SparkSession, root: str) -> DataFrame:
    """A deterministic sample of matching documents."""
    return stats.hash_sample(manifest(spark, root).where("occurrences > 0").select("document_id"), "document_id", 202609, 100)


_SIDES = "case when period = '明朝' then 'a' when period = '清朝' then 'b' end"


@query(
    f"""with {LATEST}, s as (select {_SIDES} side, * from latest),
    r as (select {', '.join(f"coalesce(sum({c}) filter (where side = '{s}'), 0)::double {n}_{s}" for s in 'ab' for n, c in (('o', 'occurrences'), ('n', 'searchable_characters'), ('d', '1'), ('m', '(occurrences > 0)::int')))} from s),
    x as (select *, o_a + case when o_a = 0 or o_b = 0 then 0.5 else 0 end a, o_b + case when o_a = 0 or o_b = 0 then 0.5 else 0 end b from r), y as (select *, (a / n_a) / (b / n_b) rr, sqrt(1 / a + 1 / b) se from x)
    select o_a, o_b, rr rate_ratio, exp(ln(rr) - 1.96 * se) low, exp(ln(rr) + 1.96 * se) high, log2(rr) log2_ratio, o_a / n_a * 1e6 - o_b / n_b * 1e6 rate_difference, m_a / d_a * 100 - m_b / d_b * 100 prevalence_difference,
      greatest(2 * (o_a * ln(o_a / ((o_a + o_b) * n_a / (n_a + n_b))) + o_b * ln(o_b / ((o_a + o_b) * n_b / (n_a + n_b)))), 0) g2 from y"""
)
def a11_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Two periods compared."""
    return stats.compare_scopes(manifest(spark, root), F.when(F.col("period") == "明朝", "a").when(F.col("period") == "清朝", "b"))


@query()
def a11_comparison_p(spark: SparkSession, root: str) -> DataFrame:
    """The comparison's p value."""
    compared = stats.compare_scopes(manifest(spark, root), F.when(F.col("period") == "明朝", "a").when(F.col("period") == "清朝", "b"))
    return compared.select("g2", stats.p_value(F.col("g2")).alias("p"))


_KEY = f"chars as (select case when lang in ('ja', 'ko') then 'a' else 'b' end side, unnest(string_split(text, '')) ch from documents where text is not null), k as (select ch item, count(*) filter (where side = 'a') n_a, count(*) filter (where side = 'b') n_b from chars where regexp_full_match(ch, '[{SQL_HAN}]') group by 1), t as (select *, sum(n_a) over ()::double t_a, sum(n_b) over ()::double t_b from k)"


@query(
    f"""with {_KEY}, x as (select *, t_a + t_b n, (n_a + n_b)::double r from t)
    select item, n_a, n_b, greatest(2 * (case when n_a > 0 then n_a * ln(n_a * n / (r * t_a)) else 0 end + case when n_b > 0 then n_b * ln(n_b * n / (r * t_b)) else 0 end
      + case when t_a - n_a > 0 then (t_a - n_a) * ln((t_a - n_a) * n / ((n - r) * t_a)) else 0 end + case when t_b - n_b > 0 then (t_b - n_b) * ln((t_b - n_b) * n / ((n - r) * t_b)) else 0 end), 0) g2,
      log2(((n_a + 0.5) / (t_a + 1)) / ((n_b + 0.5) / (t_b + 1))) log2_ratio, n_a / t_a * 1e4 per_10k_a, n_b / t_b * 1e4 per_10k_b,
      case when ((n_a + 0.5) / (t_a + 1)) / ((n_b + 0.5) / (t_b + 1)) > 1 then 'a' when ((n_a + 0.5) / (t_a + 1)) / ((n_b + 0.5) / (t_b + 1)) < 1 then 'b' else 'none' end favoured from x"""
)
def a19_keyness(spark: SparkSession, root: str) -> DataFrame:
    """Characters key to Japanese and Korean documents against all others."""
    side = F.coalesce(F.col("lang").isin("ja", "ko"), F.lit(False))
    characters = table(spark, root, "documents").where("text is not null").select(side.alias("a"), F.explode(F.split("text", "")).alias("item")).where(F.col("item").rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]$"))
    return stats.keyness(characters.groupBy("item").agg(F.count_if("a").alias("n_a"), F.count_if(~F.col("a")).alias("n_b")))


@query(
    f"""with {LATEST}, {_DIMS}, s as (select dimension, occurrences / nullif(sum(occurrences) over (partition by dimension), 0) v, searchable_characters / sum(searchable_characters) over (partition by dimension) s from tables where searchable_characters > 0),
    d as (select dimension, count(*) groups, 0.5 * sum(abs(v - s)) dp, 1 - min(s) most from s group by 1 having count(*) > 1), n as (select dimension, groups, dp, case when most > 0 then least(dp / most, 1.0) else 0.0 end dp_norm from d where dp is not null)
    select *, 1 - dp_norm evenness from n"""
)
def a21_dimension_dispersion(spark: SparkSession, root: str) -> DataFrame:
    """DP, normalised DP and evenness of each dimension."""
    return stats.dispersion(stats.by_dimension(manifest(spark, root)))


@query(
    f"""with {LATEST}, t as (select sum(occurrences)::double o, sum(searchable_characters)::double n, count(*) documents_in_scope, count(*) filter (where occurrences > 0) matching_documents from latest),
    d as (select 0.5 * sum(abs(occurrences / o - searchable_characters / n)) dp, 1 - min(searchable_characters / n) most from latest, t where searchable_characters > 0),
    v as (select dp, case when most > 0 then least(dp / most, 1.0) end dp_norm from d)
    select dp, dp_norm, 1 - dp_norm evenness, matching_documents / documents_in_scope document_range, matching_documents, documents_in_scope from v, t"""
)
def a20_dispersion(spark: SparkSession, root: str) -> DataFrame:
    """DP over documents, normalised and capped at 1, with the range."""
    return stats.document_dispersion(manifest(spark, root))


@query(
    f"""with {LATEST} select body_fingerprint, count(*) members, sum(occurrences)::bigint occurrences, min(document_id) first_id, max(occurrences) > 0 query_affecting from latest where coalesce(body_fingerprint, '') <> '' group by 1 having count(*) > 1"""
)
def a22_duplicate_groups(spark: SparkSession, root: str) -> DataFrame:
    return stats.duplicate_groups(manifest(spark, root))


@query(
    f"""with {LATEST}, u as (select max(occurrences) occurrences, max(searchable_characters) searchable_characters from latest group by coalesce(nullif(body_fingerprint, ''), 'id:' || document_id)),
    t as (select 'as_stored' as variant, count(*) documents, sum(occurrences)::bigint occurrences, sum(searchable_characters)::bigint searchable_characters from latest union all select 'unique_bodies', count(*), sum(occurrences)::bigint, sum(searchable_characters)::bigint from u)
    select *, occurrences / searchable_characters * 1e6 per_million from t"""
)
def a23_body_sensitivity(spark: SparkSession, root: str) -> DataFrame:
    return stats.body_sensitivity(manifest(spark, root))


_MIDDLE = "(coalesce(nullif(year_start, 0), nullif(year_end, 0)) + coalesce(nullif(year_end, 0), nullif(year_start, 0))) / 2"


@query(
    f"""with {LATEST}, m as (select *, {_MIDDLE} middle from latest), y as (select *, case when middle > 0 then ceil(middle) else floor(middle) end y from m where middle is not null and middle <> 0),
    c as (select (case when y > 0 then floor((y - 1) / 100) * 100 + 1 else -ceil(abs(y) / 100) * 100 end)::int "century", count(*) documents, sum(occurrences)::bigint occurrences, sum(searchable_characters)::bigint searchable_characters from y group by 1)
    select *, case when searchable_characters > 0 then occurrences / searchable_characters * 1e6 else 0 end per_million from c"""
)
def a24_centuries(spark: SparkSession, root: str) -> DataFrame:
    return stats.centuries(manifest(spark, root))


@query()
def a25_poisson_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Exact intervals of each century's rate."""
    return stats.with_poisson_interval(stats.centuries(manifest(spark, root)), "occurrences", "searchable_characters")


@query()
def a26_poisson_trend(spark: SparkSession, root: str) -> DataFrame:
    """Trend of the rate per century."""
    return spark.createDataFrame([stats.poisson_trend(manifest(spark, root))])


_FIELDS = ("author", "date_text", "nation", "macro_region", "polity", "period", "region", "corpus_root", "work_id")


@query(
    f"""with {LATEST}, f as (select unnest([{_sql_list(_FIELDS)}]) field, unnest([{', '.join(_FIELDS)}]) v from latest)
    select field, count(*) filter (where trim(v) <> '') present, count(*) filter (where coalesce(trim(v), '') = '') missing, count(*) filter (where trim(v) <> '') / count(*) coverage from f group by 1"""
)
def a27_metadata_coverage(spark: SparkSession, root: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in _FIELDS])).alias("x")
    said = F.coalesce(F.trim("x.v"), F.lit("")) != ""
    return manifest(spark, root).select(pairs).groupBy(F.col("x.field").alias("field")).agg(F.count_if(said).alias("present"), F.count_if(~said).alias("missing"), (F.count_if(said) / F.count("*")).alias("coverage"))


@query(
    f"""with {LATEST}, k as (select case when regexp_full_match(document_id, '[1-9][0-9]*') then 'numeric' when regexp_full_match(document_id, '[0-9a-f]{{24}}') then 'path_hash' else 'other' end kind,
      case when coalesce(trim(work_id), '') = '' then 'missing' when regexp_full_match(work_id, '[1-9][0-9]*') then 'numeric' else 'other' end work_kind from latest)
    select kind, work_kind, count(*) documents from k group by 1, 2"""
)
def a28_identifier_quality(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("document_id").rlike(r"^[1-9][0-9]*$"), "numeric").when(F.col("document_id").rlike(r"^[0-9a-f]{24}$"), "path_hash").otherwise("other")
    work = F.when(F.coalesce(F.trim("work_id"), F.lit("")) == "", "missing").when(F.col("work_id").rlike(r"^[1-9][0-9]*$"), "numeric").otherwise("other")
    return manifest(spark, root).groupBy(kind.alias("kind"), work.alias("work_kind")).agg(F.count("*").alias("documents"))


@query(
    f"""with {LATEST}, m as (select corpus_root, mode(macro_region) usual from latest where trim(macro_region) <> '' group by 1)
    select document_id, l.corpus_root as declared, string_split(path, '/')[1] as by_path from latest l where l.corpus_root <> string_split(path, '/')[1]"""
)
def a29_scope_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose declared corpus root contradicts their path."""
    by_path = F.split("path", "/")[0]
    return manifest(spark, root).where(F.col("corpus_root") != by_path).select("document_id", F.col("corpus_root").alias("declared"), by_path.alias("by_path"))


@query(f"with {LATEST} select document_role, count(*) documents, sum(searchable_characters)::bigint searchable_characters, grouping(document_role)::int total from latest group by rollup (document_role)")
def a30_role_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals by role, and of all."""
    return manifest(spark, root).rollup("document_role").agg(F.count("*").alias("documents"), F.sum("searchable_characters").alias("searchable_characters"), F.grouping("document_role").cast("int").alias("total"))


@query(
    f"""with {LATEST}, f as (select document_id, unnest(['nation', 'polity', 'period', 'region', 'terms']) facet, unnest([[nation], [polity], [period], [region], json_extract_string(matched_terms_json, '$[*]')]) v from latest),
    x as (select distinct document_id, facet, unnest(v) as value from f)
    select facet, value, count(*) n from x where trim(value) <> '' group by 1, 2"""
)
def a33_facets(spark: SparkSession, root: str) -> DataFrame:
    """Documents per facet value; list facets count a document once per value."""
    terms = F.coalesce(F.from_json("matched_terms_json", "array<string>"), F.array().cast("array<string>"))
    lists = F.array(*[F.struct(F.lit(c).alias("facet"), F.array(c).alias("v")) for c in ("nation", "polity", "period", "region")], F.struct(F.lit("terms").alias("facet"), F.array_distinct(terms).alias("v")))
    spread = manifest(spark, root).select(F.explode(lists).alias("x")).select("x.facet", F.explode("x.v").alias("value"))
    return spread.where("trim(value) <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


@query(
    f"""with {LATEST}, p as (select document_role, string_split(folder_path, '/') s from latest), a as (select document_role, array_to_string(s[:k], '/') folder, k::int depth from p, unnest(range(1, 4)) u(k) where k <= len(s))
    select folder, depth, count(*) documents, count(*) filter (where document_role = 'canonical') canonical from a group by 1, 2"""
)
def a34_folder_tree(spark: SparkSession, root: str) -> DataFrame:
    """Documents under each folder of the first three levels."""
    segments = F.split("folder_path", "/")
    levels = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: k <= F.size(segments))
    ancestors = F.transform(levels, lambda k: F.struct(F.array_join(F.slice(segments, F.lit(1), k), "/").alias("folder"), k.alias("depth")))
    spread = manifest(spark, root).select("document_role", F.explode(ancestors).alias("a"))
    return spread.groupBy("a.folder", "a.depth").agg(F.count("*").alias("documents"), F.count_if(F.col("document_role") == "canonical").alias("canonical"))


@query(
    f"""with {LATEST} select work_id, work, nation, period, count(*) documents, sum(searchable_characters)::bigint characters, coalesce(min(year_start), 0) first_year, coalesce(max(year_end), 0) last_year, min(path) first_path from latest group by 1, 2, 3, 4"""
)
def a42_works(spark: SparkSession, root: str) -> DataFrame:
    """Per-work aggregates."""
    grouped = manifest(spark, root).groupBy("work_id", "work", "nation", "period")
    return grouped.agg(F.count("*").alias("documents"), F.sum("searchable_characters").alias("characters"), F.coalesce(F.min("year_start"), F.lit(0)).alias("first_year"), F.coalesce(F.max("year_end"), F.lit(0)).alias("last_year"), F.min("path").alias("first_path"))


@query(f"with {LATEST}, f as (select folder_path, max(exported_at) latest_at, count(*) files from latest group by 1), r as (select *, row_number() over (order by latest_at desc, folder_path) - 1 k from f) select folder_path, latest_at, files, k as place, (k // 50)::bigint page from r")
def a44_activity(spark: SparkSession, root: str) -> DataFrame:
    """Folders by their latest export, in pages of 50."""
    folders = manifest(spark, root).groupBy("folder_path").agg(F.max("exported_at").alias("latest_at"), F.count("*").alias("files"))
    placed = numbered(folders, [F.desc("latest_at"), "folder_path"], "k").withColumn("place", F.col("k") - 1).drop("k")
    return placed.withColumn("page", F.floor(F.col("place") / 50))


@query(
    f"""with {LATEST}, a as (select corpus_root, trim(unnest(regexp_split_to_array(author, '[;；]'))) author, work_id, document_id from latest), c as (select corpus_root, author, count(distinct work_id) works, count(distinct document_id) documents from a where author <> '' group by 1, 2)
    select corpus_root, author, works, documents from c qualify row_number() over (partition by corpus_root order by works desc, documents desc, author) <= 12"""
)
def a45_atlas_authors(spark: SparkSession, root: str) -> DataFrame:
    """The twelve authors of most works in each corpus root."""
    from pyspark.sql import Window

    spread = manifest(spark, root).select("corpus_root", "work_id", "document_id", F.explode(F.split("author", "[;；]")).alias("author")).withColumn("author", F.trim("author")).where("author <> ''")
    counted = spread.groupBy("corpus_root", "author").agg(F.countDistinct("work_id").alias("works"), F.countDistinct("document_id").alias("documents"))
    place = F.row_number().over(Window.partitionBy("corpus_root").orderBy(F.desc("works"), F.desc("documents"), "author"))
    return counted.withColumn("place", place).where("place <= 12").drop("place")


@query(
    f"""with {LATEST} select corpus_root, count(*) documents, count(distinct nullif(trim(work_id), '')) works, sum(searchable_characters)::bigint characters, count(distinct folder_path) folders from latest group by 1"""
)
def a53_index_summary(spark: SparkSession, root: str) -> DataFrame:
    return manifest(spark, root).groupBy("corpus_root").agg(F.count("*").alias("documents"), F.countDistinct(F.nullif(F.trim("work_id"), F.lit(""))).alias("works"), F.sum("searchable_characters").alias("characters"), F.countDistinct("folder_path").alias("folders"))


@query(
    """with c as (select work_no, unnest(json_extract_string(categories_json, '$[*]')) category from works), n as (select category, count(distinct work_no) works from c group by 1)
    select category, works, case when works >= 8 then 'A' when works >= 5 then 'B' when works >= 3 then 'C' when works = 2 then 'D' else 'E' end band from n"""
)
def a47_category_bands(spark: SparkSession, root: str) -> DataFrame:
    """Categories banded by their number of works."""
    spread = table(spark, root, "works").select("work_no", F.explode(F.from_json("categories_json", "array<string>")).alias("category"))
    counted = spread.groupBy("category").agg(F.countDistinct("work_no").alias("works"))
    return counted.withColumn("band", F.when(F.col("works") >= 8, "A").when(F.col("works") >= 5, "B").when(F.col("works") >= 3, "C").when(F.col("works") == 2, "D").otherwise("E"))


@query("select name_key, count(distinct work_key) works, list_sort(list_distinct(list(role))) roles, min(display_name) display_name from work_people group by 1")
def a48_people(spark: SparkSession, root: str) -> DataFrame:
    """People rolled up from catalogue entries."""
    return table(spark, root, "work_people").groupBy("name_key").agg(F.countDistinct("work_key").alias("works"), F.sort_array(F.collect_set("role")).alias("roles"), F.min("display_name").alias("display_name"))


@query("select event_type, count(*) n, avg(value) mean, quantile_cont(value, 0.5) median, quantile_cont(value, 0.95) p95, max(value) max from events group by 1")
def a50_latency_summary(spark: SparkSession, root: str) -> DataFrame:
    """Median, 95th percentile, mean and largest value per category."""
    return table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("max"))


@query(f"with {LATEST} select corpus_root, count(*) filter (where document_role = 'canonical') canonical, count(*) filter (where document_role = 'raw') raw, count(*) filter (where document_role = 'annotation') annotation, count(*) total from latest group by 1")
def a52_label_crosstab(spark: SparkSession, root: str) -> DataFrame:
    """Roles by corpus root, pivoted, with row totals."""
    rows = manifest(spark, root)
    wide = rows.groupBy("corpus_root").pivot("document_role", ["canonical", "raw", "annotation"]).count().fillna(0)
    return wide.join(rows.groupBy("corpus_root").agg(F.count("*").alias("total")), "corpus_root")


@query(
    """with c as (select work_no, period, polity, unnest(json_extract_string(categories_json, '$[*]')) category from (select distinct work_no, period, polity, categories_json from works))
    select category, count(*) works, bool_and(category = period) or bool_and(coalesce(category = polity, false)) redundant from c group by 1"""
)
def a55_category_audit(spark: SparkSession, root: str) -> DataFrame:
    """Works per category and whether the category only repeats a facet."""
    spread = table(spark, root, "works").select("work_no", "period", "polity", F.explode(F.from_json("categories_json", "array<string>")).alias("category")).distinct()
    same = lambda c: F.bool_and(F.coalesce(F.col("category") == F.col(c), F.lit(False)))
    return spread.groupBy("category").agg(F.count("*").alias("works"), (same("period") | same("polity")).alias("redundant"))


@query("select source, count(distinct entity_id) entities, count(distinct name_chn) forms, count(*) filter (where primary_name = 1) primary_forms, avg(length(name_chn)) mean_length from names group by 1")
def a56_dataset_summary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "names").groupBy("source").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("name_chn").alias("forms"), F.count_if(F.col("primary_name") == 1).alias("primary_forms"), F.avg(F.length("name_chn")).alias("mean_length"))


@query(f"with {LATEST}, t as (select unnest(json_extract_string(matched_terms_json, '$[*]')) term, document_id, occurrences from latest where occurrences > 0) select term, count(distinct document_id) documents, sum(occurrences)::bigint occurrences, sum(occurrences) / (select sum(occurrences) from latest where json_array_length(matched_terms_json) > 0 and occurrences > 0) share from t group by 1")
def a16_alternatives(spark: SparkSession, root: str) -> DataFrame:
    """Per alternative: documents, hits of documents that name it, share."""
    rows = manifest(spark, root).where("occurrences > 0").select("document_id", "occurrences", F.from_json("matched_terms_json", "array<string>").alias("terms")).where("size(terms) > 0")
    total = rows.agg(F.sum("occurrences").alias("total"))
    spread = rows.select("document_id", "occurrences", F.explode("terms").alias("term")).groupBy("term").agg(F.countDistinct("document_id").alias("documents"), F.sum("occurrences").alias("occurrences"))
    return spread.withColumn("total", total.scalar()).select("term", "documents", "occurrences", (F.col("occurrences") / F.col("total")).alias("share"))


@query(f"select lang, quantile_cont(n, 0.0) q0, quantile_cont(n, 0.25) q1, quantile_cont(n, 0.5) q2, quantile_cont(n, 0.75) q3, quantile_cont(n, 1.0) q4, avg(n) mean from (select lang, length({NORM}) n from documents) group by 1")
def a18_five_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Five-number summary and mean of searchable lengths per language."""
    from quillspark.functions.text import normalised

    lengths = table(spark, root, "documents").select("lang", F.length(normalised(F.col("text"))).alias("n"))
    q = F.percentile("n", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return lengths.groupBy("lang").agg(q.alias("q"), F.avg("n").alias("mean")).select("lang", *[F.col("q")[i].alias(f"q{i}") for i in range(5)], "mean")


@query("select year_start, \"century\", numeral from (select distinct year_start, (case when year_start > 0 then (year_start - 1) // 100 * 100 + 1 else -((abs(year_start) + 99) // 100) * 100 end)::int \"century\", case when year_start between 1 and 9999 then regexp_replace(regexp_replace(regexp_replace((case when year_start // 1000 > 0 then substr('零一二三四五六七八九', (year_start // 1000 + 1)::int, 1) || '千' else '零' end) || (case when year_start // 100 % 10 > 0 then substr('零一二三四五六七八九', (year_start // 100 % 10 + 1)::int, 1) || '百' else '零' end) || (case when year_start // 10 % 10 > 0 then substr('零一二三四五六七八九', (year_start // 10 % 10 + 1)::int, 1) || '十' else '零' end) || (case when year_start % 10 > 0 then substr('零一二三四五六七八九', (year_start % 10 + 1)::int, 1) else '零' end), '^零+|零+$', '', 'g'), '零+', '零', 'g'), '^一十', '十') end numeral from document_counts where year_start is not null and year_start <> 0)")
def x10_numerals_and_centuries(spark: SparkSession, root: str) -> DataFrame:
    """Each year's century and Han numeral."""
    years = table(spark, root, "document_counts").where("year_start is not null and year_start <> 0").select("year_start").distinct()
    return years.select("year_start", century_start(F.col("year_start")).alias("century"), han_numeral(F.col("year_start")).alias("numeral"))


@query(f"with {LATEST} select {_GROUP.format('period')} as \"group\", count(*) documents from latest group by 1")
def a6_group_names(spark: SparkSession, root: str) -> DataFrame:
    return manifest(spark, root).groupBy(group_name(F.col("period")).alias("group")).agg(F.count("*").alias("documents"))


@query("select doc_id, list_sort(list_distinct(list(document_id))) ids from document_counts group by 1")
def u4_first_exports(spark: SparkSession, root: str) -> DataFrame:
    """Document ids of each number, repeated exports counted once."""
    once = index.latest_by(table(spark, root, "document_counts"), ["document_id"], "exported_at")
    return once.groupBy("doc_id").agg(F.sort_array(F.collect_set("document_id")).alias("ids"))
