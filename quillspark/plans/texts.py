"""Queries of classification and of scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.functions.text import count_han
from quillspark.operators import classify
from quillspark.operators.classify import DEFAULT_RULES
from quillspark.plans.corpus import SQL_HAN
from quillspark.session import table
from quillspark.sources import corpus

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_SKELETON = r"regexp_replace(regexp_replace(regexp_replace(t, '<[^<>]{1,200}>', '', 'g'), '\[[^\[\]]{1,100}\]', '', 'g'), '[\p{Hiragana}\p{Katakana}\p{Hangul}\p{Latin}\pM]', '', 'g')"
_COUNTS = ", ".join(
    f"case when {'regexp_matches(t, chr(91) || $$，。、；：！？$$ || chr(93))' if r.needs_punctuation else 'true'} then len(regexp_extract_all(t, '{r.pattern}')) else 0 end c_{r.rule_id}" for r in DEFAULT_RULES
)


def _weighed(polarity: str) -> str:
    return " + ".join(f"c_{r.rule_id} * {r.weight}::double" for r in DEFAULT_RULES if r.polarity == polarity)


_DECIDE = """case when {few} and vn_rate >= 20 and share >= 0.3 then 'uncertain' when vn_rate >= 20 and share >= 0.3 then 'not_literary' when lc_rate >= 60 then 'literary' when lc_tier1 > 0 and share < 0.3 then 'literary' else 'uncertain' end"""
_SCORED = f"""
parts as (select doc_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_matches(p, '[^\\s\\pZ\\x0B\\x{{85}}]')) p from documents where text is not null),
seg as (select doc_id, unnest(range(len(p))) segment, unnest(p) t from parts), body as (select doc_id, segment, {_SKELETON} t from seg),
han as (select *, length(regexp_replace(t, '[^{SQL_HAN}]', '', 'g')) han, {_COUNTS} from body),
rates as (select doc_id, segment::int segment, han, case when han > 0 then ({_weighed('lc')}) * 1000 / han else 0 end lc_rate, case when han > 0 then ({_weighed('vn')}) * 1000 / han else 0 end vn_rate,
  ({' + '.join(f'c_{r.rule_id}' for r in DEFAULT_RULES if r.polarity == 'vn')})::bigint vn_hits, ({' + '.join(f'c_{r.rule_id}' for r in DEFAULT_RULES if r.polarity == 'lc' and r.tier == 1)})::bigint lc_tier1 from han),
shares as (select *, case when lc_rate + vn_rate > 0 then vn_rate / (lc_rate + vn_rate) else 0 end share, case when lc_rate + vn_rate > 0 then lc_rate / (lc_rate + vn_rate) else 0.5 end literary_share from rates),
scored as (select *, case when han < 60 then 'too_short' else {_DECIDE.format(few='vn_hits > 0 and vn_hits < 3')} end as label, 1 / (1 + exp(-(10 * (literary_share - 0.5) + least(lc_rate, 300) / 150))) probability from shares)"""
_DOCS = f"""{_SCORED},
sums as (select doc_id, count(*) segments, count(*) filter (where label <> 'too_short') scored_segments, sum(lc_rate * han) filter (where label <> 'too_short') / sum(han) filter (where label <> 'too_short') lc_rate,
  sum(vn_rate * han) filter (where label <> 'too_short') / sum(han) filter (where label <> 'too_short') vn_rate, coalesce(sum(lc_tier1) filter (where label <> 'too_short'), 0) lc_tier1, list_sort(list(probability) filter (where label <> 'too_short')) p from scored group by 1),
d as (select *, case when lc_rate + vn_rate > 0 then vn_rate / (lc_rate + vn_rate) else 0 end share from sums),
docs as (select doc_id, segments, scored_segments, lc_rate, vn_rate, case when scored_segments = 0 then 'too_short' else {_DECIDE.format(few='false')} end as label, p[len(p) // 2 + 1] median_probability from d)"""


def _scored(spark: SparkSession, root: str) -> DataFrame:
    return classify.score_segments(classify.segments(table(spark, root, "documents")))


@query(f"with {_SCORED} select doc_id, segment, han, lc_rate, vn_rate, label, probability from scored")
def c3_segment_scores(spark: SparkSession, root: str) -> DataFrame:
    """Rates, label and prior probability of each paragraph."""
    return _scored(spark, root).select("doc_id", "segment", "han", "lc_rate", "vn_rate", "label", "probability")


@query(f"with {_DOCS} select * from docs")
def c6_document_scores(spark: SparkSession, root: str) -> DataFrame:
    """Document summaries of the paragraph scores."""
    return classify.document_scores(_scored(spark, root))


@query(f"with {_DOCS} select lang, label, count(*) documents from docs join documents using (doc_id) group by 1, 2")
def a46_label_summary(spark: SparkSession, root: str) -> DataFrame:
    """Labels by language."""
    labels = classify.document_scores(_scored(spark, root)).select("doc_id", "label")
    return labels.join(table(spark, root, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "label").agg(F.count("*").alias("documents"))


@query()
def a51_rule_noise(spark: SparkSession, root: str) -> DataFrame:
    """Which rules fire in documents that are literary all the same."""
    scored = _scored(spark, root)
    return classify.rule_noise(scored, classify.document_scores(scored))


@query(
    r"""with l as (select doc_id, string_split(text, chr(10)) s from documents where text is not null) select doc_id, unnest(range(len(p)))::int segment, sha256(unnest(p)) fingerprint from (select doc_id, list_filter(s, lambda x: regexp_matches(x, '[^\s\pZ\x0B\x{85}]')) p from l)"""
)
def x8_lines(spark: SparkSession, root: str) -> DataFrame:
    """Texts cut into lines."""
    return classify.segments(table(spark, root, "documents"), "line").select("doc_id", "segment", F.sha2("text", 256).alias("fingerprint"))


@query(f"select doc_id, length(regexp_replace(text, '[^{SQL_HAN}]', '', 'g')) han, len(regexp_extract_all(text, '[，。、；：！？]'))::int marks, regexp_matches(text, '[，。、；：！？]') punctuated, case when length(regexp_replace(text, '[^{SQL_HAN}]', '', 'g')) > 0 then len(regexp_extract_all(text, '[，。、；：！？]')) * 1000.0 / length(regexp_replace(text, '[^{SQL_HAN}]', '', 'g')) else 0 end density from documents where text is not null")
def x4_density(spark: SparkSession, root: str) -> DataFrame:
    """Han characters, punctuation and its density."""
    marks = F.size(F.regexp_extract_all("text", F.lit("[，。、；：！？]"), F.lit(0)))
    han = count_han(F.col("text"))
    return table(spark, root, "documents").where("text is not null").select("doc_id", han.alias("han"), marks.alias("marks"), (marks > 0).alias("punctuated"), F.when(han > 0, marks * 1000.0 / han).otherwise(0.0).alias("density"))


@query(r"select doc_id, sha256(regexp_replace(regexp_replace(text, '<[^<>]{1,200}>', '', 'g'), '\[[^\[\]]{1,100}\]', '', 'g')) fingerprint from documents where text is not null")
def x5_without_markup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2(classify.strip_markup(F.col("text")), 256).alias("fingerprint"))


@query(r"select doc_id, length(regexp_replace(text, '[^\p{Hiragana}\p{Katakana}]', '', 'g')) kana, length(regexp_replace(text, '[^\p{Hangul}]', '', 'g')) hangul, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) latin, length(text) characters from documents where text is not null")
def x6_apparatus(spark: SparkSession, root: str) -> DataFrame:
    """How much of each text is reading apparatus."""
    left = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", ""))
    return table(spark, root, "documents").where("text is not null").select("doc_id", left(r"\p{IsHiragana}\p{IsKatakana}").alias("kana"), left(r"\p{IsHangul}").alias("hangul"), left(r"\p{IsLatin}").alias("latin"), F.length("text").alias("characters"))


@query()
def x3_normal_forms(spark: SparkSession, root: str) -> DataFrame:
    """Titles in compatibility form and without marks."""
    titles = table(spark, root, "title_forms").select("form").distinct()
    return titles.select("form", scalars.normal_form(F.col("form")).alias("nfkc"), scalars.normal_form(F.col("form"), "bare").alias("bare"))


@query()
def x9_numerals(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of volumes as written in citations."""
    cites = table(spark, root, "people").select(F.explode(F.regexp_extract_all("source_citations", F.lit("卷([〇零一二三四五六七八九十百0-9]+)"), F.lit(1))).alias("written")).distinct()
    return cites.select("written", scalars.parse_numeral(F.col("written")).alias("number"))


@query()
def x19_nearest_names(spark: SparkSession, root: str) -> DataFrame:
    """Likeness of each variant name to its entity's primary name."""
    names = table(spark, root, "names").select("source", "entity_id", "name_chn", "primary_name").distinct()
    primary = names.where("primary_name = 1").groupBy("source", "entity_id").agg(F.min("name_chn").alias("primary"))
    pairs = names.where("primary_name = 0").join(primary, ["source", "entity_id"]).select("name_chn", "primary").distinct()
    return pairs.select("name_chn", "primary", scalars.subsequence_length(F.col("name_chn"), F.col("primary")).alias("common"), scalars.character_jaccard(F.col("name_chn"), F.col("primary")).alias("jaccard"))


@query(
    r"""with l as (select doc_id, unnest(range(len(s))) line, unnest(s) t from (select doc_id, string_split(text, chr(10)) s from documents where starts_with(text, '#')))
    select doc_id, line::int line, last_value(case when starts_with(t, '#') then t end ignore nulls) over (partition by doc_id order by line rows unbounded preceding) heading from l"""
)
def w9_headings(spark: SparkSession, root: str) -> DataFrame:
    """Each line with the heading above it."""
    lines = table(spark, root, "documents").where("startswith(text, '#')").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return corpus.heading_of(lines).select("doc_id", "line", "heading")


@query(
    """with r as (select distinct * from metadata_id_registry where kind = 'document'), old as (select * from r where registered_at < '2024-06-01'), new as (select * from r where registered_at >= '2024-06-01')
    select row_no, id, status from old where id not in (select id from new) union all select row_no, id, status from new"""
)
def s4_refresh(spark: SparkSession, root: str) -> DataFrame:
    """The registry after a targeted refresh by its later half."""
    rows = table(spark, root, "metadata_id_registry").where("kind = 'document'").dropDuplicates()
    cut_at = F.lit("2024-06-01").cast("timestamp_ntz") if dict(rows.dtypes)["registered_at"] == "timestamp_ntz" else F.lit("2024-06-01").cast("timestamp")
    old, new = rows.where(F.col("registered_at") < cut_at), rows.where(F.col("registered_at") >= cut_at)
    return corpus.refresh(old, new, new.limit(0), "id").select("row_no", "id", "status")


@query(
    """with d as (select document_id, exported_at, author, region from document_counts) select document_id, max(exported_at) exported_at, arg_max(author, exported_at) filter (where author is not null) author, arg_max(region, exported_at) filter (where region is not null) region from d group by 1"""
)
def s8_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Exports merged by id, later values over earlier ones, nulls filled."""
    rows = table(spark, root, "document_counts").select("document_id", "author", "region", "exported_at")
    half = F.col("exported_at") < F.lit("2025-01-01").cast("timestamp")
    return corpus.upsert(rows.where(half), rows.where(~half), ["document_id"], "exported_at")


@query("select doc_id, substr(sha256(coalesce(source, '') || '/' || doc_id::varchar), 1, 24) stable_id from documents")
def x2_stable_ids(spark: SparkSession, root: str) -> DataFrame:
    """Stable 24-digit ids."""
    return table(spark, root, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")), 256), 1, 24).alias("stable_id"))
