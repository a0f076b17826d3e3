"""Register classification: is a text Literary Chinese?

Rules are regular expressions with a polarity (lc literary, vn vernacular), a tier and a weight, given as a
table. They are counted JVM-side, one expression per rule, fused into one stage. The share of vernacular in
all evidence decides, not either rate alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import count_han


@dataclass(frozen=True)
class Rule:
    rule_id: str
    family: str
    polarity: str
    tier: int
    pattern: str
    weight: float
    needs_punctuation: bool = False


#: A small table of common constructions; a corpus project brings its own.
DEFAULT_RULES = (
    Rule("wei_shi", "focus", "lc", 1, "[唯惟]..?是.", 6.0),
    Rule("he_zhi_you", "focus", "lc", 1, "何.{1,2}之有", 6.0),
    Rule("suo_verb", "nominal", "lc", 2, "所[^以謂在有]", 2.0),
    Rule("zhe_ye", "predication", "lc", 2, "者，[^。]{1,12}也", 3.0, True),
    Rule("yi_wei", "predication", "lc", 2, "以.{1,6}為", 2.5),
    Rule("wei_chang_bu", "negation", "lc", 2, "未[嘗始]不", 3.0),
    Rule("final_yi", "particle", "lc", 3, "[矣乎哉焉耳]", 0.8),
    Rule("genitive", "particle", "lc", 3, "之", 0.3),
    Rule("copula_shi", "copula", "vn", 2, "[這那我他你]是|是[很不]", 4.0),
    Rule("plural_men", "pronoun", "vn", 1, "[我你他她它]們", 6.0),
    Rule("genitive_de", "particle", "vn", 2, ".的", 3.0),
    Rule("perfective_le", "aspect", "vn", 2, "..了", 2.5),
    Rule("object_ba", "syntax", "vn", 1, "把.{1,8}[了都]", 5.0),
)
MIN_HAN, LITERARY_RATE, VERNACULAR_RATE, VERNACULAR_SHARE, MIN_VERNACULAR_HITS = 60, 60.0, 20.0, 0.30, 3


def check_rules(rules: tuple[Rule, ...], weights: dict[str, float] | None = None) -> tuple[Rule, ...]:
    """Rules with overridden weights; doubled ids, unknown overrides and unknown polarities are errors."""
    ids = [r.rule_id for r in rules]
    if len(set(ids)) < len(ids) or any(r.polarity not in ("lc", "vn") for r in rules):
        raise ValueError("rule ids must differ and polarities be lc or vn")
    if unknown := set(weights or {}) - set(ids):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    return tuple(Rule(r.rule_id, r.family, r.polarity, r.tier, r.pattern, (weights or {}).get(r.rule_id, r.weight), r.needs_punctuation) for r in rules)


def strip_markup(text: Column) -> Column:
    """Without tags of up to 200 and bracketed notes of up to 100 characters."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^<>]{1,200}>", ""), r"\[[^\[\]]{1,100}\]", "")


def strip_apparatus(text: Column) -> Column:
    """Without kana, Hangul, Latin letters and combining marks: the Han skeleton with its punctuation."""
    return F.regexp_replace(text, r"[\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsLatin}\p{M}]", "")


def segments(texts: DataFrame, mode: str = "paragraph") -> DataFrame:
    """texts (doc_id, text) -> doc_id, segment, text: by paragraph (blank lines), line, or whole."""
    borders = {"paragraph": r"\n\s*\n", "line": r"\n", "sentence": r"(?<=[。！？!?])"}
    parts = F.array("text") if mode == "whole" else F.split("text", borders[mode])
    return texts.where("text is not null").select("doc_id", F.posexplode(F.filter(parts, lambda p: p.rlike(r"[^\p{IsWhite_Space}]"))).alias("segment", "text"))


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def score_segments(parts: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """doc_id, segment, han, lc_rate, vn_rate (weighted hits per 1000 Han), vn_hits, lc_tier1, counts (map
    of the rules that hit), label, probability."""
    rules = check_rules(rules)
    text = strip_apparatus(strip_markup(F.col("text")))
    body = parts.select("doc_id", "segment", text.alias("text"))
    body = body.withColumns({"han": count_han(F.col("text")), "punctuated": F.col("text").rlike(r"[，。、；：！？]")})
    count = lambda r: F.when(F.col("punctuated") | F.lit(not r.needs_punctuation), F.size(F.regexp_extract_all("text", F.lit(f"(?:{r.pattern})"), F.lit(0)))).otherwise(0)
    counted = body.select("doc_id", "segment", "han", *[count(r).alias(f"_{r.rule_id}") for r in rules])
    weighed = lambda p: _sum([F.col(f"_{r.rule_id}") * r.weight for r in rules if r.polarity == p])
    per_1000 = lambda c: F.when(F.col("han") > 0, c * 1000 / F.col("han")).otherwise(0.0)
    hit = F.filter(F.array(*[F.struct(F.lit(r.rule_id).alias("k"), F.col(f"_{r.rule_id}").alias("v")) for r in rules]), lambda x: x["v"] > 0)
    scored = counted.select(
        "doc_id", "segment", "han", per_1000(weighed("lc")).alias("lc_rate"), per_1000(weighed("vn")).alias("vn_rate"),
        _sum([F.col(f"_{r.rule_id}") for r in rules if r.polarity == "vn"]).cast("bigint").alias("vn_hits"),
        _sum([F.col(f"_{r.rule_id}") for r in rules if r.polarity == "lc" and r.tier == 1]).cast("bigint").alias("lc_tier1"), F.map_from_entries(hit).alias("counts"),
    )
    return scored.withColumns({"label": F.when(F.col("han") < MIN_HAN, "too_short").otherwise(decision(F.col("vn_hits"))), "probability": prior_probability()})


def decision(vn_hits: Column | None) -> Column:
    """The label that lc_rate, vn_rate and lc_tier1 give; too few vernacular hits decide nothing."""
    lc, vn = F.col("lc_rate"), F.col("vn_rate")
    share = F.when(lc + vn > 0, vn / (lc + vn)).otherwise(0.0)
    vernacular = (vn >= VERNACULAR_RATE) & (share >= VERNACULAR_SHARE)
    few = (vn_hits > 0) & (vn_hits < MIN_VERNACULAR_HITS) if vn_hits is not None else F.lit(False)
    return (
        F.when(vernacular & few, "uncertain").when(vernacular, "not_literary").when(lc >= LITERARY_RATE, "literary")
        .when((F.col("lc_tier1") > 0) & (share < VERNACULAR_SHARE), "literary").otherwise("uncertain")
    )


def prior_probability() -> Column:
    """Uncalibrated: a sigmoid of the literary share and the literary rate."""
    lc, vn = F.col("lc_rate"), F.col("vn_rate")
    share = F.when(lc + vn > 0, lc / (lc + vn)).otherwise(0.5)
    return 1 / (1 + F.exp(-(10 * (share - 0.5) + F.least(lc, F.lit(300.0)) / 150)))


def document_scores(scored: DataFrame) -> DataFrame:
    """Per document: Han-weighted mean rates over scored segments, the label they give, upper-median
    probability; documents without a scored segment are too short."""
    usable = F.col("label") != "too_short"
    mean = lambda c: F.try_divide(F.sum(F.when(usable, F.col(c) * F.col("han"))), F.sum(F.when(usable, F.col("han"))))
    grouped = scored.groupBy("doc_id").agg(
        F.count("*").alias("segments"), F.count_if(usable).alias("scored_segments"), mean("lc_rate").alias("lc_rate"), mean("vn_rate").alias("vn_rate"),
        F.coalesce(F.sum(F.when(usable, F.col("lc_tier1"))), F.lit(0)).alias("lc_tier1"), F.sort_array(F.collect_list(F.when(usable, F.col("probability")))).alias("p"),
    )
    label = F.when(F.col("scored_segments") == 0, "too_short").otherwise(decision(None))
    return grouped.select("doc_id", "segments", "scored_segments", "lc_rate", "vn_rate", label.alias("label"), F.try_element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int")).alias("median_probability"))


def rule_noise(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Per rule: documents, hits, how many of its documents are literary all the same, and its share of
    all rejections."""
    rejected = labels.agg(F.greatest(F.count_if(F.col("label") == "not_literary"), F.lit(1)).alias("rejections"))
    spread = scored.select("doc_id", F.explode("counts").alias("rule_id", "n")).groupBy("doc_id", "rule_id").agg(F.sum("n").alias("n"))
    per = spread.join(labels.select("doc_id", F.col("label").alias("of")), "doc_id").groupBy("rule_id").agg(
        F.count("*").alias("documents"), F.sum("n").alias("hits"), F.count_if(F.col("of") == "literary").alias("literary"), F.count_if(F.col("of") == "not_literary").alias("not_literary")
    )
    return per.withColumn("rejections", rejected.scalar()).select("rule_id", "documents", "hits", (F.col("literary") / F.col("documents")).alias("still_literary"), (F.col("not_literary") / F.col("rejections")).alias("share_of_rejections"))


def calibrate(features: DataFrame, label: str, columns: list[str], seed: int = 20260911):
    """Logistic calibration of rule rates on labelled rows: (model, test rows scored, area under the curve)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features.where(F.col(label).isNotNull())).select("features", F.col(label).cast("double").alias("label"))
    train, test = rows.randomSplit([0.75, 0.25], seed)
    if train.select("label").distinct().count() < 2:
        raise ValueError("both classes are needed")
    model = LogisticRegression(regParam=0.01, standardization=True).fit(train)
    scored = model.transform(test)
    return model, scored, BinaryClassificationEvaluator().evaluate(scored)
