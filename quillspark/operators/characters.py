"""Character queries: constraint stacks over a property table, homophones, variant groups, collations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.index import equivalence_classes


def properties(rows: DataFrame, character: str, fields: dict[str, str]) -> DataFrame:
    """Wide rows to a property table (ch, field, value), blanks left out, each property once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("value")) for k, c in fields.items()])).alias("p")
    return rows.select(F.col(character).alias("ch"), pairs).select("ch", "p.field", "p.value").where("value <> ''").distinct()


def constrained(table: DataFrame, constraints: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(characters that meet every constraint, survivors after each step). A constraint is a field and the
    values it may have; a field of several values meets it by any. One pass over the table: each character
    gets one flag per constraint."""
    flags = [F.max((F.col("field") == f) & F.col("value").isin(*values)).alias(f"_{i}") for i, (f, values) in enumerate(constraints)]
    flagged = table.groupBy("ch").agg(*flags)
    upto = [reduce(lambda a, b: a & b, [F.col(f"_{k}") for k in range(i + 1)]) for i in range(len(constraints))]
    kept = flagged.where(upto[-1]).select("ch")
    counts = flagged.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(upto)])
    steps = counts.select(F.posexplode(F.array(*[F.col(f"n{i}") for i in range(len(constraints))])).alias("step", "survivors"))
    return kept, steps.select((F.col("step") + 1).alias("step"), "survivors")


def sharing(table: DataFrame, field: str) -> DataFrame:
    """How many characters share each value of a field with a character, itself not counted: homophones
    and the like, counted and never paired."""
    one = table.where(F.col("field") == field).select("ch", "value").distinct()
    sizes = one.groupBy("value").agg(F.count("*").alias("n"))
    return one.join(sizes, "value").select("ch", "value", (F.col("n") - 1).alias("others"))


def variant_groups(characters: DataFrame, edges: DataFrame) -> DataFrame:
    """characters (ch) with their variant group: head is the smallest character of the connected component,
    alone without variants."""
    classes = equivalence_classes(edges)
    return characters.join(classes.select("ch", F.col("representative").alias("head"), "members"), "ch", "left").select("ch", F.coalesce("head", "ch").alias("head"), F.coalesce("members", F.lit(1)).alias("members"))


def inherit_head(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows of a group without a value take that of the group's first row that has one."""
    first = F.first(F.col(value), ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("inherited", F.coalesce(F.col(value), first))


def natural_order(rows: DataFrame, group: str, title: str) -> DataFrame:
    """Documents of a work in natural order: front matter, then by the number in the title or file name,
    appendices and afterwords last; ties by path."""
    t = F.col(title)
    part = F.when(t.rlike("序|凡例|目[錄录]"), 0).when(t.rlike("附|補遺|补遗"), 2).when(t.rlike("跋|後序|后序"), 3).otherwise(1)
    ordinal = F.coalesce(F.nullif(F.regexp_extract(F.col("path"), "([0-9]+)(?!.*[0-9])", 1), F.lit("")).cast("bigint"), F.lit(0))
    ordinal = F.coalesce(F.nullif(F.regexp_extract(F.col("path"), "_juan_([0-9]+)", 1), F.lit("")).cast("bigint"), ordinal)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(part, ordinal, "path")))
