"""Queries of the search operators over the whole corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import canonical_parent, count_exact, count_han, folder_of, normalised, role_of, sexagenary, title_key
from quillspark.operators import index, search
from quillspark.operators.search import SearchSpec
from quillspark.session import table

QUERIES, SQL = {}, {}

#: The code points that a search ignores, for DuckDB's regular expressions.
SQL_IGNORED = r"[\pP\pZ\s\x0B\x{85}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
SQL_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
NORM = f"regexp_replace(coalesce(text, ''), '{SQL_IGNORED}', '', 'g')"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def bodies(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").withColumn("body", F.col("text"))


#: document_counts with the last export of each document: the manifest of the corpus.
LATEST = "latest as (select * from document_counts qualify row_number() over (partition by document_id order by exported_at desc) = 1)"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "document_counts")
    return index.latest_by(counts, ["document_id"], "exported_at")


# --- sources and predicates -------------------------------------------------------------------------


@query(
    r"""
    with raw as (select doc_id, ltrim(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(65279), ''), chr(10)) t from documents),
    cut as (select doc_id, regexp_extract(t, '^(?:#[ \t]*[A-Z][A-Z0-9_ ]{1,80}[ \t]*[:：][^\n]*(?:\n|$))+') head, t from raw)
    select doc_id, len(regexp_extract_all(head, '#[ \t]*[A-Z][A-Z0-9_ ]{1,80}[ \t]*[:：]')) entries,
      nullif(trim(regexp_extract(head, '#[ \t]*TITLE[ \t]*[:：]([^\n]*)', 1)), '') title,
      nullif(trim(regexp_extract(head, '#[ \t]*AUTHOR[ \t]*[:：]([^\n]*)', 1)), '') author,
      sha256(regexp_replace(t[len(head) + 1:], '^\n+', '')) body_fingerprint
    from cut
    """
)
def s2_header_body(spark: SparkSession, root: str) -> DataFrame:
    """Header entries and body fingerprint of each document."""
    parsed = index.parse_documents(table(spark, root, "documents"), "text")
    return parsed.select("doc_id", "entries", F.col("metadata")["TITLE"].alias("title"), F.col("metadata")["AUTHOR"].alias("author"), F.sha2("body", 256).alias("body_fingerprint"))


@query(
    """
    with l as (select document_id, path, string_split(lower(path), '/') p, string_split(path, '/') q from document_counts),
    r as (select *, case when list_contains(p, 'raw') then 'raw' when list_contains(p, 'variants') then 'textual_variant'
      when list_has_any(p, ['reconstruction', 'reconstructions']) then 'reconstruction' when list_has_any(p, ['kanbun', 'hanmun', 'hanvan']) then 'derived_reading'
      when list_has_any(p, ['translation', 'translations']) then 'translation' when list_has_any(p, ['annotation', 'annotations']) then 'annotation'
      when list_contains(p, 'clean') then 'canonical' else 'support' end as role from l)
    select distinct document_id, role, array_to_string(q[:-2], '/') folder,
      case when list_contains(p, 'variants') then array_to_string(q[:list_position(p, 'variants') - 1], '/') end parent from r
    """
)
def f4_roles_and_folders(spark: SparkSession, root: str) -> DataFrame:
    """Role, folder and canonical parent that each path says."""
    paths = table(spark, root, "document_counts").select("document_id", "path").distinct()
    return paths.select("document_id", role_of(F.col("path")).alias("role"), folder_of(F.col("path")).alias("folder"), canonical_parent(F.col("path")).alias("parent")).distinct()


_SCOPE = SearchSpec(("x",), roles=("canonical", "textual_variant"), folders=("中國漢文",), exclude_folders=("中國漢文/clean/清朝",), metadata={"nation": "Chin"}, year_from=700, year_to=1400)


@query(
    f"""
    with {LATEST}
    select document_id, path from latest
    where document_role in ('canonical', 'textual_variant') and (folder_path = '中國漢文' or starts_with(folder_path, '中國漢文/'))
      and not coalesce(folder_path = '中國漢文/clean/清朝' or starts_with(folder_path, '中國漢文/clean/清朝/'), false)
      and contains(nation, 'Chin') and coalesce(coalesce(year_end, year_start) >= 700 and coalesce(year_start, year_end) <= 1400, false)
    """
)
def f1_scope(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a scope: roles, folders, a metadata substring and a year range."""
    return search.in_scope(manifest(spark, root), _SCOPE).select("document_id", "path")


@query(f"select doc_id, length({NORM}) searchable_characters, sha256({NORM}) stream_fingerprint, length({NORM}) > 0 searchable from documents")
def m1_normalised(spark: SparkSession, root: str) -> DataFrame:
    """Searchable stream of each body: length, fingerprint, whether there is any."""
    stream = normalised(F.col("text"))
    return table(spark, root, "documents").select("doc_id", F.length(stream).alias("searchable_characters"), F.sha2(stream, 256).alias("stream_fingerprint"), (F.length(stream) > 0).alias("searchable"))


# --- matching ----------------------------------------------------------------------------------------

_TERM = "未嘗不"
_HIT_SQL = (
    f"with n as (select doc_id, text, {NORM} s from documents), "
    "kept as (select doc_id, text, s, [i for i in range(1, length(text) + 1) if length(regexp_replace(text[i], '" + SQL_IGNORED + "', '', 'g')) > 0] o from n where contains(s, '@term')), "
    "hits as (select doc_id, text, o, unnest([i - 1 for i in range(1, length(s) - 3 + 2) if s[i:i + 3 - 1] = '@term']) ss from kept) "
)


@query(
    _HIT_SQL.replace("@term", _TERM)
    + """select doc_id, ss::int search_start, (ss + 3)::int search_end, (o[ss + 1] - 1)::int original_start, o[ss + 3]::int original_end, text[o[ss + 1]:o[ss + 3]] matched,
      text[greatest(o[ss + 1] - 20, 1):o[ss + 1] - 1] left_context, text[o[ss + 3] + 1:o[ss + 3] + 20] right_context,
      concat_ws(':', doc_id, o[ss + 1] - 1, o[ss + 3], ss, ss + 3) occurrence_key from hits"""
)
def m3_exact_hits(spark: SparkSession, root: str) -> DataFrame:
    """Exact hits with search and original offsets, keyword in context and key."""
    hits = search.find_hits(bodies(spark, root), SearchSpec((_TERM,)))
    names = ["doc_id", "original_start", "original_end", "search_start", "search_end"]
    return hits.select("doc_id", "search_start", "search_end", "original_start", "original_end", "matched", "left_context", "right_context", search.occurrence_key(*names).alias("occurrence_key"))


@query(f"select doc_id, ((length(s) - length(replace(s, '塔塔', ''))) // 2)::int plain, len([i for i in range(1, length(s)) if s[i:i+1] = '塔塔'])::int overlapping from (select doc_id, {NORM} s from documents)")
def m3_counts(spark: SparkSession, root: str) -> DataFrame:
    """Occurrences of a term that may overlap itself, counted with and without overlap."""
    stream = normalised(F.col("text"))
    plain = ((F.length(stream) - F.length(F.replace(stream, F.lit("塔塔"), F.lit("")))) / 2).cast("int")
    return table(spark, root, "documents").select("doc_id", plain.alias("plain"), count_exact(stream, "塔塔").alias("overlapping"))


_CLASSES = ("曰言", "為爲", "强強")


@query(f"with n as (select doc_id, {NORM} s from documents) select doc_id, unnest([i - 1 for i in range(1, length(s)) if regexp_full_match(s[i:i + 1], '公[曰言]')])::int search_start from n where regexp_matches(s, '公[曰言]')")
def m4_equivalence(spark: SparkSession, root: str) -> DataFrame:
    """Hits of a term whose characters stand for their equivalence classes."""
    return search.find_hits(bodies(spark, root), SearchSpec(("公曰",), classes=_CLASSES)).select("doc_id", "search_start")


_EDGES = [("為", "爲", "a"), ("甲", "由", "a"), ("由", "申", "b"), ("強", "强", "a"), ("强", "彊", "b"), ("驗", "験", "c"), ("験", "验", "c")]


@query(
    "with recursive e(a, b) as (values " + ", ".join(f"('{a}', '{b}')" for a, b, _ in _EDGES) + "), u as (select a, b from e union select b, a from e), "
    "reach as (select a, a as b from u union select r.a, u.b from reach r join u on u.a = r.b) select a as ch, min(b) as representative, count(*) as members from reach group by a"
)
def m5_equivalence_classes(spark: SparkSession, root: str) -> DataFrame:
    """Classes of the equivalence edges, closed transitively, with their representative."""
    return index.equivalence_classes(spark.createDataFrame(_EDGES, "base string, variant string, source string"))


@query()
def m6_equivalence_paths(spark: SparkSession, root: str) -> DataFrame:
    """Shortest mapping path between characters of one class, with the sources on the way."""
    return index.equivalence_paths(spark.createDataFrame(_EDGES, "base string, variant string, source string"))


_REGEX = "[一二三四五六七八九十]+年[一二三四五六七八九十]+月"


@query(f"select doc_id, m as matched, count(*) n from (select doc_id, unnest(regexp_extract_all({NORM}, '{_REGEX}')) m from documents) group by 1, 2")
def m7_regex_hits(spark: SparkSession, root: str) -> DataFrame:
    """Regular-expression hits, per document and matched form."""
    hits = search.find_hits(bodies(spark, root), SearchSpec((_REGEX,), mode="regex"))
    return hits.groupBy("doc_id", normalised(F.col("matched")).alias("matched")).agg(F.count("*").alias("n"))


@query(rf"select doc_id, m as matched, count(*) n from (select doc_id, unnest(regexp_extract_all({NORM}, '[0-9\p{{Nd}}]+')) m from documents) group by 1, 2")
def m7_regex_digits(spark: SparkSession, root: str) -> DataFrame:
    """Runs of decimal digits of any script: a pattern that Java and Python read differently, so no document
    is ruled out before the match."""
    hits = search.find_hits(bodies(spark, root), SearchSpec((r"\d+",), mode="regex"))
    return hits.groupBy("doc_id", normalised(F.col("matched")).alias("matched")).agg(F.count("*").alias("n"))


@query(
    f"""with n as (select doc_id, {NORM} s from documents),
    h as (select doc_id, i, t, k from n, unnest(range(1, length(s))) u(i), (values (0, '是以'), (1, '以是'), (2, '是以')) v(k, t) where s[i:i + 1] = t)
    select doc_id, (i - 1)::int search_start, count(*)::int terms, min(k)::int first_term from h group by doc_id, i"""
)
def m8_alternatives(spark: SparkSession, root: str) -> DataFrame:
    """Hits of any of several terms: one hit per range, with the terms that match it."""
    hits = search.find_hits(bodies(spark, root), SearchSpec(("是以", "以是", "是以"), mode="or"))
    return hits.select("doc_id", "search_start", F.size("term_matches").alias("terms"), F.col("term_matches")[0]["term_index"].alias("first_term"))


@query()
def m9_proximity_any(spark: SparkSession, root: str) -> DataFrame:
    """Compact passages with three terms in any order."""
    return search.find_hits(bodies(spark, root), SearchSpec(("是以", "未嘗不", "公曰"), mode="proximity", span=60)).select("doc_id", "search_start", "search_end", "matched")


@query(
    f"""with n as (select doc_id, {NORM} s from documents),
    p as (select doc_id, [i for i in range(1, length(s)) if s[i:i + 1] = '是以'] a, [i for i in range(1, length(s) - 1) if s[i:i + 2] = '未嘗不'] b from n),
    f as (select doc_id, unnest(a) x, b from p), g as (select doc_id, x, list_min([y for y in b if y >= x]) y from f)
    select distinct doc_id, (x - 1)::int search_start, (y + 2)::int search_end from g where y is not null and y + 2 - (x - 1) <= 40"""
)
def m10_proximity_entered(spark: SparkSession, root: str) -> DataFrame:
    """Passages with two terms in the order typed."""
    return search.find_hits(bodies(spark, root), SearchSpec(("是以", "未嘗不"), mode="proximity", span=40, order="entered")).select("doc_id", "search_start", "search_end")


@query(
    """with d as (select * from documents where text is not null and text <> ''), f as (select *, sha256(text) fp from d)
    select doc_id, fp as body_fingerprint from f qualify row_number() over (partition by fp order by doc_id) = 1"""
)
def m15_first_per_body(spark: SparkSession, root: str) -> DataFrame:
    """The first document of each exact body."""
    documents = table(spark, root, "documents").where("text is not null and text <> ''").select("doc_id", F.sha2("text", 256).alias("body_fingerprint"))
    return search.first_per_body(documents, "body_fingerprint", "doc_id")


@query(f"select doc_id from documents where contains({NORM}, '是以') and contains({NORM}, '未嘗不')")
def m16_prefilter(spark: SparkSession, root: str) -> DataFrame:
    """Documents that may hold all terms."""
    spec = SearchSpec(("是以", "未嘗不"), mode="proximity")
    return table(spark, root, "documents").where(search.prefilter(spec, normalised(F.col("text")))).select("doc_id")


@query("select doc_id, (case when contains(title, '論') then 500 + 20 else 0 end + case when contains(title, '八論') then 500 + 40 else 0 end + case when contains(work_id, '1') then 100 + 10 else 0 end)::int priority from documents")
def m18_priority(spark: SparkSession, root: str) -> DataFrame:
    """Scan priority from hints in titles and works."""
    score = sum((F.when(F.col(c).contains(h), base + each * len(h)).otherwise(0) for c, h, base, each in (("title", "論", 500, 20), ("title", "八論", 500, 20), ("work_id", "1", 100, 10))), F.lit(0))
    return table(spark, root, "documents").select("doc_id", score.cast("int").alias("priority"))


_PHRASES = ("未嘗不議", "不可以論", "不可以望", "何以論乎", "論乎", "以望")


@query(
    f"""with n as (select doc_id, {NORM} s from documents), k(t) as (values {", ".join(f"('{p}')" for p in _PHRASES)}), g as (select doc_id, t, i from n, k, unnest(range(1, length(s) - length(t) + 2)) u(i) where contains(s, t) and s[i:i + length(t) - 1] = t)
    select doc_id, t as phrase, (i - 1)::int as start from g"""
)
def m19_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Phrases of a dictionary in bodies, all occurrences, by joining n-grams to the dictionary."""
    streams = table(spark, root, "documents").select("doc_id", normalised(F.col("text")).alias("stream"))
    return index.phrase_matches(streams, spark.createDataFrame([(p,) for p in _PHRASES], "phrase string"))


@query()
def m20_annotation(spark: SparkSession, root: str) -> DataFrame:
    """Places of the people table in bodies, longest first, without overlap."""
    places = table(spark, root, "people").select(F.explode(F.regexp_extract_all("places", F.lit(r"[\p{IsHan}]{2,16}"), F.lit(0))).alias("phrase"))
    names = places.unionByName(places.select(F.regexp_replace("phrase", "[縣府州]$", "").alias("phrase"))).where("length(phrase) >= 2").distinct()
    streams = table(spark, root, "documents").select("doc_id", normalised(F.col("text")).alias("stream"))
    return index.longest_non_overlapping(index.phrase_matches(streams, names))


@query(rf"select doc_id, label, count(*) occurrences from (select doc_id, unnest(regexp_extract_all({NORM}, '《?[{SQL_HAN}]公曰')) label from documents) group by 1, 2")
def m24_mentions(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of speakers, per document and form."""
    forms = F.explode(F.regexp_extract_all(normalised(F.col("text")), F.lit(r"《?[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]公曰"), F.lit(0)))
    return table(spark, root, "documents").select("doc_id", forms.alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("occurrences"))


@query(r"select doc_id, unnest(regexp_extract_all(text, '《([^《》\n]{1,40})》', 1)) cited from documents where text is not null")
def m25_citations(spark: SparkSession, root: str) -> DataFrame:
    """Titles cited in bodies."""
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"《([^《》\n]{1,40})》"), F.lit(1))).alias("cited"))


# --- hits to statistics --------------------------------------------------------------------------------

_NEIGHBOUR_SQL = _HIT_SQL.replace("@term", _TERM).replace("text, o, unnest", "text, s, o, unnest") + (
    ", side as (select doc_id, 'L' side, k as distance, s[ss + 1 - k] ch from hits, unnest(range(1, 6)) u(k) where ss + 1 - k >= 1 union all "
    "select doc_id, 'R', k, s[ss + 3 + k] from hits, unnest(range(1, 6)) u(k) where ss + 3 + k <= length(s)), "
    "c as (select side, distance, ch, count(*) occurrences, count(distinct doc_id) documents from side group by 1, 2, 3) "
)


@query(_NEIGHBOUR_SQL + "select side, distance::int distance, ch, occurrences, documents, occurrences / sum(occurrences) over (partition by side, distance) share from c")
def a13_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Characters at each position around the hits."""
    return search.neighbours(search.find_hits(bodies(spark, root), SearchSpec((_TERM,))))


@query(
    _NEIGHBOUR_SQL
    + """, w as (select ch, sum(case when side = 'L' then occurrences else 0 end)::bigint on_left, sum(case when side = 'R' then occurrences else 0 end)::bigint on_right from c group by 1)
    select ch, on_left, on_right, on_left + on_right total, (on_right - on_left)::double / (on_left + on_right) direction_balance from w"""
)
def a14_neighbour_window(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours rolled up over the window, with their balance of direction."""
    around = search.neighbours(search.find_hits(bodies(spark, root), SearchSpec((_TERM,))))
    side = lambda s, name: F.sum(F.when(F.col("side") == s, F.col("occurrences")).otherwise(0)).alias(name)
    w = around.groupBy("ch").agg(side("L", "on_left"), side("R", "on_right"))
    return w.select("ch", "on_left", "on_right", (F.col("on_left") + F.col("on_right")).alias("total"), ((F.col("on_right") - F.col("on_left")) / (F.col("on_left") + F.col("on_right"))).alias("direction_balance"))


@query(f"with n as (select doc_id, source, ((length({NORM}) - length(replace({NORM}, '{_TERM}', ''))) // 3)::bigint occurrences from documents) select doc_id, source, occurrences from n")
def j1_zero_hit_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document of the scope with its hits, those without any too."""
    scope = bodies(spark, root)
    return search.hit_counts(scope.select("doc_id", "source"), search.find_hits(scope, SearchSpec((_TERM,))))


@query(
    f"with n as (select doc_id, ((length({NORM}) - length(replace({NORM}, '{_TERM}', ''))) // 3)::bigint occurrences from documents) "
    "select doc_id, occurrences from n where occurrences > 0 order by occurrences desc, doc_id limit 20 offset 20"
)
def o2_page(spark: SparkSession, root: str) -> DataFrame:
    """The second page of documents by hits."""
    counted = table(spark, root, "documents").select("doc_id", count_exact(normalised(F.col("text")), _TERM).cast("bigint").alias("occurrences")).where("occurrences > 0")
    return search.page_of(counted, [F.desc("occurrences"), F.asc("doc_id")], 2, 20)


_PAGE_SQL = (
    _HIT_SQL.replace("@term", _TERM).replace("from documents)", "from (select * from documents order by doc_id @documents))")
    + ", ranked as (select doc_id, (o[ss + 1] - 1)::int original_start, o[ss + 3]::int original_end, text[o[ss + 1]:o[ss + 3]] matched, text[greatest(o[ss + 1] - 5, 1):o[ss + 1] - 1] left_context, text[o[ss + 3] + 1:o[ss + 3] + 5] right_context from hits "
    "order by doc_id, original_start limit @hits), "
    "t as (select least(count(*), @hits) total, count(*) < @hits and (select count(*) from documents) <= @scanned complete from hits) "
    "select r.*, total, greatest(ceil(total / 20), 1)::bigint total_pages, complete, not complete truncated from (select * from ranked order by doc_id, original_start limit 20 offset 20) r, t"
)


def _page(spark: SparkSession, root: str, **bounds) -> DataFrame:
    scope = bodies(spark, root).select("doc_id", F.format_string("%012d", "doc_id").alias("path"), "body", F.lit("canonical").alias("document_role"), F.lit(None).cast("int").alias("year_start"), F.lit(None).cast("int").alias("year_end"))
    page = search.result_page(scope, SearchSpec((_TERM,), context=5, page=2, per_page=20), **bounds)
    return page.select("doc_id", "original_start", "original_end", "matched", "left_context", "right_context", "total", "total_pages", "complete", "truncated")


@query(_PAGE_SQL.replace("@documents", "limit 1000").replace("@hits", "1000").replace("@scanned", "1000"))
def o3_interactive_page(spark: SparkSession, root: str) -> DataFrame:
    """The second page of an interactive search within its budget of documents and hits."""
    return _page(spark, root)


@query(_PAGE_SQL.replace("@documents", "").replace("limit @hits", "").replace("least(count(*), @hits)", "count(*)").replace("count(*) < @hits and (select count(*) from documents) <= @scanned", "true"))
def o1_full_page(spark: SparkSession, root: str) -> DataFrame:
    """The second page of the whole search, hits in the order of path and place."""
    return _page(spark, root, most_hits=None, most_documents=None)


# --- indexes -------------------------------------------------------------------------------------------


@query("select ch as term, doc_id, count(*) n from (select doc_id, unnest(string_split(text, '')) ch from documents where text is not null) where ch <> '' group by 1, 2")
def a35_postings(spark: SparkSession, root: str) -> DataFrame:
    """The term index: occurrences of each character per document, raw bodies."""
    return index.postings(table(spark, root, "documents"), "text")


@query("with p as (select ch as term, count(*) n, count(distinct doc_id) documents from (select doc_id, unnest(string_split(text, '')) ch from documents where text is not null) where ch <> '' group by 1) select term, n, documents from p")
def a36_frequency_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Corpus frequency of each character, from the term index."""
    return index.postings(table(spark, root, "documents"), "text").groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


_FREQ = f"freq as (select ch, count(*) n from (select unnest(string_split(text, '')) ch from documents where text is not null) where regexp_full_match(ch, '[{SQL_HAN}]') group by 1)"


@query(
    f"with {_FREQ} select ch, n, rank() over (order by n desc) as rank, sum(n) over (order by n desc, ch rows unbounded preceding)::double / sum(n) over () coverage from freq"
)
def a38_frequency_list(spark: SparkSession, root: str) -> DataFrame:
    """Han character frequencies with competition rank and cumulative coverage."""
    return index.ranked_frequencies(index.character_counts(table(spark, root, "documents"), "text", han_only=True))


@query(
    f"with {_FREQ}, r as (select ch, n, row_number() over (order by n desc, ch) k, sum(n) over (order by n desc, ch rows unbounded preceding)::double / sum(n) over () coverage from freq) "
    "select t.threshold::double threshold, min(k) characters from r, (values (0.9), (0.95), (0.98), (0.99)) t(threshold) where coverage >= t.threshold group by 1"
)
def a40_coverage_thresholds(spark: SparkSession, root: str) -> DataFrame:
    """How many characters cover 90, 95, 98 and 99 per cent."""
    return index.coverage_thresholds(index.character_counts(table(spark, root, "documents"), "text", han_only=True), [0.9, 0.95, 0.98, 0.99])


@query(f"with {_FREQ}, m as (select translate(ch, '為强验', '爲強驗') ch, n from freq) select ch, sum(n)::bigint n, row_number() over (order by sum(n) desc, ch) place from m group by 1")
def a41_merged_frequency(spark: SparkSession, root: str) -> DataFrame:
    """Frequencies after mapping variants onto one character."""
    rules = spark.createDataFrame([("為", "爲"), ("强", "強"), ("验", "驗")], "variant string, base string")
    return index.merged_frequencies(index.character_counts(table(spark, root, "documents"), "text", han_only=True), rules)


@query(f"select doc_id, length(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g')) characters, length(regexp_replace(coalesce(text, ''), '[^{SQL_HAN}]', '', 'g')) han from documents")
def a43_character_counts(spark: SparkSession, root: str) -> DataFrame:
    """Characters without white space and Han characters of each document."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\p{IsWhite_Space}]", "")
    return table(spark, root, "documents").select("doc_id", F.length(bare).alias("characters"), count_han(F.col("text")).alias("han"))


@query(
    f"""with t as (select doc_id, unnest(string_split(text, '')) ch from documents where text is not null), p as (select distinct ch, doc_id from t where ch in ('嘗', '曰', '𠀀'))
    select doc_id from p group by 1 having count(*) filter (where ch in ('嘗', '曰')) = 2"""
)
def j2_candidates_all(spark: SparkSession, root: str) -> DataFrame:
    """Candidate documents that the postings of all terms share."""
    return index.candidates(index.postings(table(spark, root, "documents"), "text"), ["嘗", "曰"], "all")


@query("with t as (select doc_id, unnest(string_split(text, '')) ch from documents where text is not null) select distinct doc_id from t where ch in ('蟲', '𠀀')")
def j2_candidates_any(spark: SparkSession, root: str) -> DataFrame:
    """Candidate documents of any term."""
    return index.candidates(index.postings(table(spark, root, "documents"), "text"), ["蟲", "𠀀"], "any")


_SHINGLES = f"""n as (select doc_id, {NORM} s from documents where text is not null), f as (select min(doc_id) doc_id, s from n where length(s) >= 5 group by s),
    sh as (select doc_id, unnest(list_distinct([s[i:i + 4] for i in range(1, length(s) - 3)])) g from f), c as (select doc_id, count(*) n from sh group by 1),"""


@query(
    f"""with {_SHINGLES}
    rare as (select g from sh group by g having count(*) between 2 and 50), p as (select a.doc_id x, b.doc_id y from sh a join rare using (g) join sh b using (g) where a.doc_id < b.doc_id group by 1, 2),
    i as (select x, y, count(*) shared from p join sh a on a.doc_id = x join sh b on b.doc_id = y and b.g = a.g group by 1, 2)
    select x as doc_a, y as doc_b, shared, shared::double / (a.n + b.n - shared) jaccard, shared::double / least(a.n, b.n) containment from i join c a on a.doc_id = x join c b on b.doc_id = y where shared::double / (a.n + b.n - shared) >= 0.8"""
)
def j17_similar_documents(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of different texts that share most of their five-character shingles (Jaccard 0.8 or more),
    between the first documents of exact copies; j17_memberships leads from every document to its first."""
    return index.similar_texts(table(spark, root, "documents").select("doc_id", normalised(F.col("text")).alias("stream")), size=5, least=0.8)


@query(
    f"""with n as (select doc_id, nullif({NORM}, '') s from documents), c as (select s, min(doc_id) representative, count(*) copies from n where s is not null group by s)
    select doc_id, coalesce(c.representative, doc_id) representative, coalesce(c.copies, 1)::bigint copies from n left join c on c.s = n.s"""
)
def j17_memberships(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the first document of the same normalised text, the one that j17_similar_documents names."""
    return index.copy_membership(table(spark, root, "documents").select("doc_id", normalised(F.col("text")).alias("stream")))


@query("select doc_id, sexa from (select doc_id, case when y > 0 then substr('甲乙丙丁戊己庚辛壬癸', ((y - 4) % 60 + 60) % 60 % 10 + 1, 1) || substr('子丑寅卯辰巳午未申酉戌亥', ((y - 4) % 60 + 60) % 60 % 12 + 1, 1) end sexa from (select doc_id, year_start y from document_counts)) group by all")
def x11_sexagenary(spark: SparkSession, root: str) -> DataFrame:
    """Stem-branch names of the documents' years."""
    return table(spark, root, "document_counts").select("doc_id", sexagenary(F.col("year_start")).alias("sexa")).distinct()


@query(f"select title, lower(regexp_replace(regexp_replace(coalesce(title, ''), '[（(][^）)]*[）)]', '', 'g'), '{SQL_IGNORED}', '', 'g')) title_key from documents group by all")
def x23_title_keys(spark: SparkSession, root: str) -> DataFrame:
    """Normalised titles."""
    return table(spark, root, "documents").select("title", title_key(F.col("title")).alias("title_key")).distinct()
