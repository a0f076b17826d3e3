"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import lookalike, matching, mixing, spam, survivors, tokens, variants
from quillspark.session import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_GROUP_FIELDS = ["author", "date_text", "year_start", "year_end", "nation", "macro_region", "polity", "period", "region"]


def _survivors(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "document_counts").select("document_id", "body_fingerprint", "searchable_characters", "duplicate_members_json", "document_role", "exported_at", *_GROUP_FIELDS)
    grouped = survivors.body_groups(counts)
    return survivors.best_representatives(grouped, _GROUP_FIELDS, (F.trim("document_role") == "canonical").cast("int"), F.col("exported_at"))


@query
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _survivors(spark, root).select(F.col("member_id").alias("document_id"), F.col("survivor_id").alias("survivor_document_id"))


@query
def p2_golden(spark: SparkSession, root: str) -> DataFrame:
    """Per group the survivor and the best existing value of each field."""
    found = _survivors(spark, root).where("member_id = survivor_id")
    return found.select("survivor_id", "completeness", *[F.col("best")[f].alias(f) for f in _GROUP_FIELDS])


@query
def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.lookalike_pairs(_titles(spark, root))


def _titles(spark: SparkSession, root: str) -> DataFrame:
    parts = [("names", "name_no", "name_chn"), ("works", "work_no", "base_title"), ("title_forms", "form_no", "normalised_form")]
    one, two, three = (table(spark, root, t).select(F.lit(t).alias("table_name"), F.col(n).alias("row_no"), F.col(c).alias("text")) for t, n, c in parts)
    return one.unionByName(two).unionByName(three)


@query
def p7_classes(spark: SparkSession, root: str) -> DataFrame:
    """The forms written in several ways, with the number of their spellings and rows."""
    return lookalike.lookalike_classes(_titles(spark, root))


@query
def p7_forms(spark: SparkSession, root: str) -> DataFrame:
    """Each row's text in its one visual form."""
    return lookalike.with_visual_form(_titles(spark, root).distinct(), "text").select("table_name", "row_no", "visual_form")


@query
def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, root, "documents"))


@query
def p8_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Whether each document's ids decode to its exact text."""
    documents = table(spark, root, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = tokens.encode_corpus(documents)
    decoded = tokens.decode_corpus(encoded).select("doc_id", F.sha2("text", 256).alias("decoded"))
    return documents.select("doc_id", F.sha2("text", 256).alias("original")).join(decoded, "doc_id").select("doc_id", (F.col("original") == F.col("decoded")).alias("exact"))


SQL["p8_round_trip"] = "select doc_id, true as exact from documents"


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.token_counts(table(spark, root, "documents"), ["doc_id", "source"], F.col("text"))
    return mixing.mix(sized, table(spark, root, "mix_targets"))


@query
def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[0]


@query
def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[1]


@query
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return spam.find_spam(table(spark, root, "documents")).select("doc_id")


@query
def p10_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Spam documents per language and reason."""
    return spam.find_spam(table(spark, root, "documents")).groupBy("language", "reason").agg(F.count("*").alias("documents"))


def _mentions(spark: SparkSession, root: str) -> DataFrame:
    works = table(spark, root, "works").select("work_key", "polity", "year_start", "year_end").dropDuplicates(["work_key"])
    named = table(spark, root, "work_people").dropDuplicates(["mention_no"]).join(works, "work_key", "left")
    return named.select("mention_no", F.col("display_name").alias("text"), "polity", F.coalesce("year_start", "year_end").alias("year"))


def _variants(spark: SparkSession, root: str) -> DataFrame:
    people = table(spark, root, "people").where("source = 'fanya_supplementary'")
    persons = people.select("person_no", F.coalesce("name_han", "label").alias("name"), F.col("aliases").alias("other_names"), "polity", "year_start", "year_end")
    return variants.link_mentions(_mentions(spark, root), persons)


@query
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "people").where("source = 'fanya_supplementary'").select("person_no", "name_han").dropDuplicates(["person_no"])
    shown = table(spark, root, "work_people").select("mention_no", "display_name").dropDuplicates(["mention_no"])
    linked = _variants(spark, root).join(shown, "mention_no").join(names, "person_no")
    return linked.where("not (display_name <=> name_han)").select("mention_no", "person_no")


@query
def p6_links(spark: SparkSession, root: str) -> DataFrame:
    """Every linked mention, those typed exactly too, with agreement and round."""
    return _variants(spark, root)


@query
def p6_outside(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of people outside the register, gathered under the first that spells out the name."""
    return variants.outside_register(_mentions(spark, root), _variants(spark, root))


@query
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return matching.match_sources(table(spark, root, "people")).select("person_no_a", "person_no_b")


@query
def p1_matches(spark: SparkSession, root: str) -> DataFrame:
    """The matched pairs with cosine, strength of evidence and calibrated confidence."""
    return matching.match_sources(table(spark, root, "people"))
