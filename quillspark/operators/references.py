"""References to records that do not exist, or did not exist yet.

Parent keys are integers once cleaned. Sorted, they compress into runs of contiguous numbers; a run also
carries when each of its keys was first known. Runs are cut at multiples of ``BLOCK``, so that a reference
finds its runs by equality on (space, block) and, in that block, the last run that starts at or before its
key: an as-of match without a range join. A key beyond that run's end does not exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 8

_WIDE = "０１２３４５６７８９ＡＢＣＤＥＦａｂｃｄｅｆ．"
_PLAIN = "0123456789abcdefabcdef."


def clean_id(raw: Column) -> Column:
    """One spelling per identifier: half-width, lower case, no space anywhere, no trailing ``.0``, no
    leading zeros (except in 24-digit hexadecimal ids, where they count). Blank becomes null."""
    plain = F.lower(F.translate(raw, _WIDE, _PLAIN))
    plain = F.regexp_replace(plain, r"[\s\u0085\u00a0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+", "")
    plain = F.regexp_replace(plain, r"^(\d+)\.0*$", "$1")
    plain = F.when(F.length(plain) == 24, plain).otherwise(F.regexp_replace(plain, r"^0+(?=\d)", ""))
    return F.when(plain != "", plain)


def with_key(df: DataFrame, id_column: str) -> DataFrame:
    """Add space and key: the integer the id means and the number space it lies in. 24-digit hexadecimal
    ids are 96-bit integers: their high 36 bits go into the space. Any other text is a space of one key."""
    raw = F.col(id_column)
    number = raw.rlike(r"^\d{1,18}$")
    wide = raw.rlike(r"^[0-9a-f]{24}$")
    return df.withColumns(
        {
            "space": F.when(number, F.lit("n")).when(wide, F.concat(F.lit("h"), F.substring(raw, 1, 9))).otherwise(F.concat(F.lit("t"), raw)),
            "key": F.when(number, raw.try_cast("bigint"))
            .when(wide, F.conv(F.substring(raw, 10, 15), 16, 10).try_cast("bigint"))
            .otherwise(F.lit(0).cast("bigint")),
        }
    )


def key_runs(parents: DataFrame) -> DataFrame:
    """parents (target, id, at) -> one row per (target, space, block) with its sorted runs
    array<struct<start, end, known_at: array<timestamp>>>. Repeated parents are combined map-side first,
    so a parent repeated a billion times costs no more than one; no group exceeds 2**BLOCK_BITS keys."""
    first = (
        with_key(parents.where(F.col("id").isNotNull()), "id")
        .groupBy("target", "space", "key")
        .agg(F.min("at").alias("at"))
        .withColumn("block", F.shiftright("key", BLOCK_BITS))
    )
    inside = Window.partitionBy("target", "space", "block").orderBy("key")
    return (
        first.withColumn("island", F.col("key") - F.row_number().over(inside))
        .groupBy("target", "space", "block", "island")
        .agg(
            F.min("key").alias("start"),
            F.max("key").alias("end"),
            F.transform(F.array_sort(F.collect_list(F.struct("key", "at"))), lambda x: x["at"]).alias("known_at"),
        )
        .groupBy("target", "space", "block")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "known_at"))).alias("runs"))
    )


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a parent, or whose parent came later.

    references: table_name, row_no, field_name, ref_pos, target, id, ref_at (id as typed).
    parents: target, id, at (id as typed; several rows of one id count from their first ``at``).
    Returns table_name, row_no, field_name, ref_pos, target, ref_at, reason ('missing' or 'late').

    Defined cases: a null or blank id refers to nothing and gives no row; a reference repeated letter for
    letter gives one row; a parent whose times are all null exists from ever; a reference without a time
    is never late; empty parents make every reference missing; other columns are ignored.
    The join's right side has one row per block, so a parent that a third of all references name is a
    skew of the left side only, which adaptive execution splits.
    """
    names = ["table_name", "row_no", "field_name", "ref_pos", "target", "id", "ref_at"]
    cleaned = references.select(*names).withColumn("id", clean_id(F.col("id"))).where(F.col("id").isNotNull())
    keyed = with_key(cleaned.dropDuplicates(), "id").withColumn("block", F.shiftright("key", BLOCK_BITS))
    runs = key_runs(parents.select("target", clean_id(F.col("id")).alias("id"), "at"))
    matched = keyed.join(runs, ["target", "space", "block"], "left").withColumn(
        "run", F.try_element_at(F.filter("runs", lambda r: r["start"] <= F.col("key")), F.lit(-1))
    )
    offset = (F.col("key") - F.col("run.start") + 1).cast("int")
    reason = F.when(F.col("run.end").isNull() | (F.col("key") > F.col("run.end")), "missing").when(
        F.try_element_at(F.col("run.known_at"), offset) > F.col("ref_at"), "late"
    )
    return (
        matched.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("table_name", "row_no", "field_name", "ref_pos", "target", "ref_at", "reason")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month of the referring row and reason."""
    return (
        orphans.withColumn("month", F.date_format("ref_at", "yyyy-MM"))
        .groupBy("table_name", "field_name", "month", "reason")
        .agg(F.count("*").alias("orphans"), F.countDistinct("row_no").alias("rows"))
    )
