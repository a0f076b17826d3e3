"""Corpus statistics over a table of documents with hit counts (one row per document of the scope)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import century_start, group_name

#: The facets that are tabulated, as (dimension, column).
DIMENSIONS = (("period", "period"), ("corpus_root", "corpus_root"), ("macro_region", "macro_region"), ("polity", "polity"), ("region", "region"), ("author", "author"), ("folder", "folder"), ("document_role", "document_role"))
# Folder segments that name a layer of the corpus, left out of folder groups.
LAYERS = ("clean", "raw", "variant", "variants", "translation", "translations", "annotation", "annotations", "kanbun", "hanmun", "hanvan")
# The classes of hits per matching document, as (label, least, most).
HISTOGRAM = (("1", 1, 1), ("2", 2, 2), ("3–5", 3, 5), ("6–10", 6, 10), ("11–20", 11, 20), ("21–50", 21, 50), ("51–100", 51, 100), ("101+", 101, 2**62))


def rate(part: Column, whole: Column, scale: float) -> Column:
    """part / whole * scale, 0 where there is no whole."""
    return F.when(whole > 0, part / whole * scale).otherwise(F.lit(0.0))


def folder_group(folder: Column) -> Column:
    """The first three folder segments without layers."""
    kept = F.filter(F.split(F.coalesce(folder, F.lit("")), "/"), lambda s: (s != "") & ~s.isin(*LAYERS))
    return F.array_join(F.slice(kept, 1, 3), " / ")


def _measures() -> list[Column]:
    matching = F.col("occurrences") > 0
    return [
        F.count("*").alias("documents"),
        F.count_if(matching).alias("matching_documents"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
        F.coalesce(F.sum("searchable_characters"), F.lit(0)).alias("searchable_characters"),
        F.avg(F.when(matching, F.col("occurrences"))).alias("mean_per_matching"),
        F.percentile(F.when(matching, F.col("occurrences")), 0.5).alias("median_per_matching"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "prevalence": rate(F.col("matching_documents"), F.col("documents"), 1.0),
            "per_million": rate(F.col("occurrences"), F.col("searchable_characters"), 1e6),
        }
    )


def overall(documents: DataFrame) -> DataFrame:
    """One row: totals, prevalence, rate per million, mean and interpolated median over matching documents."""
    return _rates(documents.agg(*_measures(), F.count_if(F.col("searchable_characters") == 0).alias("empty_documents")))


def by_dimension(documents: DataFrame) -> DataFrame:
    """All dimension tables in one pass: each document is expanded to its eight (dimension, group) pairs
    and aggregated once, map-side combined."""
    prepared = documents.withColumn("folder", folder_group(F.col("folder_path")))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), group_name(F.col(c)).alias("group")) for d, c in DIMENSIONS])
    spread = prepared.select(F.explode(pairs).alias("g"), "occurrences", "searchable_characters", "year_start").select("g.dimension", "g.group", "occurrences", "searchable_characters", "year_start")
    sort_year = F.percentile(F.when(F.col("year_start") != 0, F.col("year_start")), 0.5).alias("sort_year")
    grouped = _rates(spread.groupBy("dimension", "group").agg(*_measures(), sort_year))
    whole = Window.partitionBy("dimension")
    return grouped.withColumns({"occurrence_share": rate(F.col("occurrences"), F.sum("occurrences").over(whole), 1.0), "document_share": F.col("documents") / F.sum("documents").over(whole)})


def usable_dimensions(tables: DataFrame) -> DataFrame:
    """dimension, groups, singletons, usable: region, polity and period tables are left out where they
    have more groups than a tenth of the documents (at least 1000), or over 500 groups mostly of one."""
    counted = tables.groupBy("dimension").agg(F.count("*").alias("groups"), F.count_if(F.col("documents") == 1).alias("singletons"), F.sum("documents").alias("documents"))
    too_many = F.col("groups") > F.greatest(F.lit(1000.0), F.col("documents") * 0.1)
    scattered = (F.col("groups") > 500) & (F.col("singletons") > 0.8 * F.col("groups"))
    return counted.withColumn("usable", ~(F.col("dimension").isin("region", "polity", "period") & (too_many | scattered)))


def histogram(documents: DataFrame) -> DataFrame:
    """Matching documents per class of hits, empty classes too, with their share of the matching documents
    (0 where nothing matches)."""
    spark = documents.sparkSession
    classes = spark.createDataFrame([(i, *c) for i, c in enumerate(HISTOGRAM)], "place int, bucket string, least bigint, most bigint")
    bucket = F.lit(HISTOGRAM[-1][0])
    for label, _, most in reversed(HISTOGRAM[:-1]):
        bucket = F.when(F.col("occurrences") <= most, label).otherwise(bucket)
    counted = documents.where("occurrences > 0").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("documents"))
    filled = F.broadcast(classes).join(counted, "bucket", "left").select("place", "bucket", F.coalesce("documents", F.lit(0)).alias("documents"))
    return filled.withColumn("share", rate(F.col("documents"), F.sum("documents").over(Window.partitionBy()), 1.0))


def top_documents(documents: DataFrame, limit: int = 100) -> DataFrame:
    """The matching documents with most hits, with rate and share of all hits."""
    total = documents.agg(F.sum("occurrences").alias("total"))
    top = documents.where("occurrences > 0").orderBy(F.desc("occurrences"), "path").limit(limit)
    return top.withColumn("total", total.scalar()).withColumns({"per_million": rate(F.col("occurrences"), F.col("searchable_characters"), 1e6), "share": rate(F.col("occurrences"), F.col("total"), 1.0)})


def concentration(documents: DataFrame) -> DataFrame:
    """Share of all hits in the top 1, 5 and 10 documents: only the ten largest leave their tasks."""
    top = documents.orderBy(F.desc("occurrences"), "path").limit(10).withColumn("place", F.row_number().over(Window.orderBy(F.desc("occurrences"), "path")))
    of = [F.coalesce(F.sum(F.when(F.col("place") <= k, F.col("occurrences"))), F.lit(0)).alias(f"t{k}") for k in (1, 5, 10)]
    total = documents.agg(F.greatest(F.coalesce(F.sum("occurrences"), F.lit(0)), F.lit(1)).alias("total"))
    return top.agg(*of).withColumn("total", total.scalar()).select(*[(F.col(f"t{k}") / F.col("total")).alias(f"top{k}_share") for k in (1, 5, 10)])


def hash_sample(rows: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """A sample that depends on seed and keys only: the ``size`` smallest hashes of ``seed:key``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("sample_hash", hashed).orderBy("sample_hash").limit(size)


def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(v) if v == v else None)


def p_value(g: Column) -> Column:
    """Tail probability of a G statistic with one degree of freedom: erfc(sqrt(G / 2))."""
    from pyspark.sql import types as T

    return F.pandas_udf(_erfc, T.DoubleType())(F.sqrt(g / 2))


def compare_scopes(documents: DataFrame, side: Column) -> DataFrame:
    """Two scopes (side 'a' or 'b') compared: rate ratio with 0.5 added to zero counts, its 95 per cent
    interval, log2 ratio, differences of rate and prevalence, Poisson G statistic and p."""
    sides = documents.withColumn("_side", side).where("_side in ('a', 'b')")
    pick = lambda s, c: F.coalesce(F.sum(F.when(F.col("_side") == s, c)), F.lit(0)).cast("double")
    one = F.lit(1)
    row = sides.agg(*[pick(s, c).alias(f"{n}_{s}") for s in "ab" for n, c in (("o", F.col("occurrences")), ("n", F.col("searchable_characters")), ("d", one), ("m", (F.col("occurrences") > 0).cast("int")))])
    some = F.when((F.col("o_a") == 0) | (F.col("o_b") == 0), 0.5).otherwise(0.0)
    a, b = F.col("o_a") + some, F.col("o_b") + some
    ratio = F.try_divide(F.try_divide(a, F.col("n_a")), F.try_divide(b, F.col("n_b")))
    error = F.sqrt(1 / a + 1 / b)
    both, size = F.col("o_a") + F.col("o_b"), F.col("n_a") + F.col("n_b")
    term = lambda o, n: F.when(F.col(o) > 0, F.col(o) * F.ln(F.col(o) / (both * F.col(n) / size))).otherwise(0.0)
    out = row.withColumns({"rate_ratio": ratio, "low": F.exp(F.ln(ratio) - 1.96 * error), "high": F.exp(F.ln(ratio) + 1.96 * error), "log2_ratio": F.log2(ratio), "g2": F.greatest(2 * (term("o_a", "n_a") + term("o_b", "n_b")), F.lit(0.0))})
    out = out.withColumns({"rate_difference": rate(F.col("o_a"), F.col("n_a"), 1e6) - rate(F.col("o_b"), F.col("n_b"), 1e6), "prevalence_difference": rate(F.col("m_a"), F.col("d_a"), 100.0) - rate(F.col("m_b"), F.col("d_b"), 100.0)})
    return out.select("o_a", "o_b", "rate_ratio", "low", "high", "log2_ratio", "rate_difference", "prevalence_difference", "g2")


def keyness(counts: DataFrame) -> DataFrame:
    """counts (item, n_a, n_b) -> two-by-two G statistic, smoothed log2 ratio, rates per 10 000 and the
    favoured side of each item."""
    total = {f"t_{s}": counts.agg(F.sum(f"n_{s}").cast("double")).scalar() for s in "ab"}
    x = counts.withColumns(total).withColumns({"a": F.col("n_a").cast("double"), "b": F.col("n_b").cast("double")})
    size = F.col("t_a") + F.col("t_b")
    cell = lambda o, row, col: F.when(o > 0, o * F.ln(o * size / (row * col))).otherwise(0.0)
    row = F.col("a") + F.col("b")
    rest = size - row
    g2 = 2 * (cell(F.col("a"), row, F.col("t_a")) + cell(F.col("b"), row, F.col("t_b")) + cell(F.col("t_a") - F.col("a"), rest, F.col("t_a")) + cell(F.col("t_b") - F.col("b"), rest, F.col("t_b")))
    ratio = F.log2(((F.col("a") + 0.5) / (F.col("t_a") + 1)) / ((F.col("b") + 0.5) / (F.col("t_b") + 1)))
    return x.select("item", "n_a", "n_b", F.greatest(g2, F.lit(0.0)).alias("g2"), ratio.alias("log2_ratio"), rate(F.col("a"), F.col("t_a"), 1e4).alias("per_10k_a"), rate(F.col("b"), F.col("t_b"), 1e4).alias("per_10k_b"), F.when(ratio > 0, "a").when(ratio < 0, "b").otherwise("none").alias("favoured"))


def dispersion(groups: DataFrame) -> DataFrame:
    """groups (dimension, group, occurrences, searchable_characters) -> DP, DP_norm and evenness of each
    dimension with at least two groups: half the summed distance between shares of hits and shares of text,
    divided by its greatest possible value and at most 1."""
    whole = Window.partitionBy("dimension")
    shares = groups.where("searchable_characters > 0").select("dimension", F.try_divide(F.col("occurrences"), F.sum("occurrences").over(whole)).alias("v"), (F.col("searchable_characters") / F.sum("searchable_characters").over(whole)).alias("s"))
    out = shares.groupBy("dimension").agg(F.count("*").alias("groups"), (F.sum(F.abs(F.col("v") - F.col("s"))) * 0.5).alias("dp"), F.min("s").alias("least"))
    norm = F.when(F.col("least") < 1, F.least(F.col("dp") / (1 - F.col("least")), F.lit(1.0))).otherwise(F.lit(0.0))
    return out.where("groups > 1 and dp is not null").select("dimension", "groups", "dp", norm.alias("dp_norm"), (1 - norm).alias("evenness"))


def document_dispersion(documents: DataFrame) -> DataFrame:
    """One row: DP over the documents with text, DP_norm (at most 1), evenness, and the range: the share of
    documents that match. Two aggregates over the documents; no row meets another."""
    one = documents.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).cast("double").alias("hits"),
        F.coalesce(F.sum("searchable_characters"), F.lit(0)).cast("double").alias("size"),
        F.count("*").alias("documents_in_scope"),
        F.count_if(F.col("occurrences") > 0).alias("matching_documents"),
        F.min(F.when(F.col("searchable_characters") > 0, F.col("searchable_characters"))).alias("least"),
    )
    totals = {c: one.select(c).scalar() for c in ("hits", "size")}
    away = documents.where("searchable_characters > 0").withColumns(totals).agg((F.sum(F.abs(F.try_divide("occurrences", "hits") - F.try_divide("searchable_characters", "size"))) * 0.5).alias("dp"))
    row = one.withColumn("dp", away.scalar())
    most = 1 - F.col("least") / F.col("size")
    norm = F.when(most > 0, F.least(F.col("dp") / most, F.lit(1.0)))
    return row.select("dp", norm.alias("dp_norm"), (1 - norm).alias("evenness"), rate(F.col("matching_documents"), F.col("documents_in_scope"), 1.0).alias("document_range"), "matching_documents", "documents_in_scope")


def labelled_samples(samples: DataFrame, group: str, label: Column, text_column: str = "text") -> DataFrame:
    """Per group: positive and negative samples (null labels are neither) and characters."""
    return samples.groupBy(group).agg(F.count_if(label).alias("positive"), F.count_if(~label).alias("negative"), F.coalesce(F.sum(F.length(text_column)), F.lit(0)).alias("characters"))


#: Dimensions by which two scopes may be compared.
COMPARED = ("period", "nation", "region", "folder", "document_role")


def check_comparison(dimension: str, a: str, b: str) -> None:
    """ValueError unless two different groups of a dimension that can be compared are given."""
    if dimension not in COMPARED:
        raise ValueError(f"dimension must be one of {COMPARED}")
    if not a.strip() or not b.strip() or a.strip() == b.strip():
        raise ValueError("two different groups are needed")


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """Exact-body groups of two and more: members and hits, counted and not listed."""
    grouped = documents.where("coalesce(body_fingerprint, '') <> ''").groupBy("body_fingerprint").agg(F.count("*").alias("members"), F.sum("occurrences").alias("occurrences"), F.max("occurrences").alias("most"), F.min("document_id").alias("first_id"))
    return grouped.where("members > 1").withColumn("query_affecting", F.col("most") > 0).drop("most")


def body_sensitivity(documents: DataFrame) -> DataFrame:
    """Totals with documents as stored and with each exact body once (its largest values)."""
    key = F.coalesce(F.nullif(F.col("body_fingerprint"), F.lit("")), F.concat(F.lit("id:"), F.col("document_id")))
    unique = documents.groupBy(key.alias("k")).agg(F.max("occurrences").alias("occurrences"), F.max("searchable_characters").alias("searchable_characters"))
    total = lambda df, name: df.agg(F.lit(name).alias("variant"), F.count("*").alias("documents"), F.sum("occurrences").alias("occurrences"), F.sum("searchable_characters").alias("searchable_characters"))
    return total(documents, "as_stored").unionByName(total(unique, "unique_bodies")).withColumn("per_million", rate(F.col("occurrences"), F.col("searchable_characters"), 1e6))


def midpoint(start: Column, end: Column) -> Column:
    """Middle of the years given, zeros and nulls left out; rounded away from a year zero."""
    s, e = F.nullif(start, F.lit(0)), F.nullif(end, F.lit(0))
    return (F.coalesce(s, e) + F.coalesce(e, s)) / 2


def centuries(documents: DataFrame) -> DataFrame:
    """Hits and text per century (there is no year zero)."""
    middle = midpoint(F.col("year_start"), F.col("year_end"))
    return (
        documents.withColumn("middle", middle)
        .where("middle is not null and middle <> 0")
        .groupBy(century_start(F.when(F.col("middle") > 0, F.ceil("middle")).otherwise(F.floor("middle"))).alias("century"))
        .agg(F.count("*").alias("documents"), F.sum("occurrences").alias("occurrences"), F.sum("searchable_characters").alias("searchable_characters"))
        .withColumn("per_million", rate(F.col("occurrences"), F.col("searchable_characters"), 1e6))
    )


# --- exact Poisson intervals and trend -------------------------------------------------------------------


def gamma_share(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series below the mean and continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    b = x + 1 - shape
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / ((a * d + b) or 1e-300)
        c = (b + a / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def poisson_interval(count: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a Poisson mean: gamma quantiles by bisection."""

    def quantile(shape: float, share: float) -> float:
        low, high = 0.0, max(10.0, 4 * shape + 40)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if gamma_share(shape, mid) < share else (low, mid)
        return (low + high) / 2

    tail = (1 - level) / 2
    return (quantile(count, tail) if count else 0.0), quantile(count + 1, 1 - tail)


def with_poisson_interval(rows: DataFrame, count: str, size: str, scale: float = 1e6) -> DataFrame:
    """Add low and high of the rate per ``scale``."""

    def run(batches):
        for batch in batches:
            bounds = [poisson_interval(int(n)) for n in batch[count]]
            batch["low"] = [b[0] * scale / s if s else None for b, s in zip(bounds, batch[size])]
            batch["high"] = [b[1] * scale / s if s else None for b, s in zip(bounds, batch[size])]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, low double, high double")


def poisson_trend(documents: DataFrame) -> dict:
    """Log-linear Poisson trend of hits per century with text length as exposure.

    Documents are first summed by their middle year in Spark; the fit then runs over those few sums. The
    spread that decides between Poisson and quasi-Poisson errors is measured on the documents, in one more
    pass. Not eligible (and said so) below 20 documents, 5 middle years or 5 hits.
    """
    dated = documents.withColumn("middle", midpoint(F.col("year_start"), F.col("year_end"))).where("middle is not null and searchable_characters > 0")
    sums = dated.groupBy("middle").agg(F.sum("occurrences").alias("o"), F.sum("searchable_characters").alias("n"), F.count("*").alias("d")).orderBy("middle").collect()
    documents_count, hits = sum(r["d"] for r in sums), sum(r["o"] for r in sums)
    if documents_count < 20 or len(sums) < 5 or hits < 5:
        return {"eligible": False, "documents": documents_count, "midpoints": len(sums), "occurrences": hits}
    centre = sum(r["middle"] * r["n"] for r in sums) / sum(r["n"] for r in sums)
    x = [(r["middle"] - centre) / 100 for r in sums]
    a, b = math.log(hits / sum(r["n"] for r in sums)), 0.0
    for _ in range(40):
        mu = [r["n"] * math.exp(a + b * t) for r, t in zip(sums, x)]
        s0, s1, s2 = sum(mu), sum(m * t for m, t in zip(mu, x)), sum(m * t * t for m, t in zip(mu, x))
        u0, u1 = sum(r["o"] - m for r, m in zip(sums, mu)), sum((r["o"] - m) * t for r, m, t in zip(sums, mu, x))
        det = s0 * s2 - s1 * s1
        if det <= 0:
            break
        da, db = (s2 * u0 - s1 * u1) / det, (s0 * u1 - s1 * u0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-12:
            break
    expected = F.col("searchable_characters") * F.exp(F.lit(a) + F.lit(b) * (F.col("middle") - centre) / 100)
    pearson = dated.agg(F.sum(F.pow(F.col("occurrences") - expected, 2) / expected)).first()[0]
    spread = pearson / max(documents_count - 2, 1)
    quasi = spread > 1.5
    error = math.sqrt(s0 / det) * (math.sqrt(spread) if quasi else 1.0)
    z = b / error if error else 0.0
    return {"eligible": True, "documents": documents_count, "midpoints": len(sums), "occurrences": hits, "ratio_per_century": math.exp(b), "low": math.exp(b - 1.96 * error), "high": math.exp(b + 1.96 * error), "spread": spread, "family": "quasi-poisson" if quasi else "poisson", "z": z, "p": math.erfc(abs(z) / math.sqrt(2))}
