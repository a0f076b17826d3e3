"""Readers and writers: corpus trees, metadata, tables, incremental refresh, export bundles."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import canonical_parent, folder_of, normalised, role_of
from quillspark.operators.index import parse_documents

# Directories that a corpus scan leaves out.
SKIPPED = (".git", ".svn", "node_modules", "tmp", "log", "storage", "bak", "vendor")


def read_tree(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Every text file under root: path (relative), content, size, modified, and text; files that are not
    valid UTF-8 have a null text. One file is one row, however large the tree."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(base)
    plain = F.regexp_replace("path", "^file:/*(?=/)", "")
    relative = F.regexp_replace(plain, f"^{base}/", "")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), text.alias("text"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped)))) if skipped else rows


def build_manifest(files: DataFrame) -> DataFrame:
    """Files -> manifest: header metadata, body fingerprint, role, folder, searchable characters. Files
    without text or without any searchable character are left out."""
    parsed = parse_documents(files.where("text is not null"), "text")
    rows = parsed.select(
        F.substring(F.sha2("path", 256), 1, 24).alias("document_id"), "path", "size", "modified", "metadata", F.sha2("body", 256).alias("body_fingerprint"), "body",
        role_of(F.col("path")).alias("document_role"), folder_of(F.col("path")).alias("folder_path"), canonical_parent(F.col("path")).alias("canonical_parent_path"), F.length(normalised(F.col("body"))).alias("searchable_characters"),
    )
    return rows.where("searchable_characters > 0")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Every metadata.json under root, as folder and one map of its fields."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").load(base)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^file:/*(?=/)", ""), f"^{base}/?", ""), "/?metadata.json$", "")
    return files.select(folder.alias("prefix"), F.from_json(F.col("content").cast("string"), "map<string, string>").alias("owner"))


def refresh(old: DataFrame, changed: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """The manifest after replacing the changed rows and dropping the removed ones."""
    gone = changed.select(key).union(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(changed)


def plan_changes(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "body_fingerprint", most: int = 5000) -> dict:
    """What a rebuild has to do: cached (nothing changed), targeted (few) or full, with the numbers."""
    both = old.select(key, F.col(mark).alias("a")).join(new.select(key, F.col(mark).alias("b")), key, "full")
    n = both.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed")).first()
    touched = n["added"] + n["removed"] + n["changed"]
    return {"mode": "cached" if not touched else "targeted" if touched <= most else "full", **n.asDict()}


def not_done(work: DataFrame, spark: SparkSession, output: str, key: str) -> DataFrame:
    """Rows whose key an earlier run has not written yet (append-only JSON lines)."""
    if not Path(output).exists() and "://" not in output:
        return work
    return work.join(spark.read.json(output).select(key), key, "left_anti")


def append_lines(rows: DataFrame, output: str) -> None:
    rows.write.mode("append").json(output)


def read_properties(spark: SparkSession, path: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Lines ``U+XXXX<TAB>field<TAB>value`` without comments, each distinct one once."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="codepoint string, field string, value string", quote="").where("codepoint rlike '^U\\\\+[0-9A-F]{4,6}$' and field is not null")
    rows = rows.where(F.col("field").isin(*fields)) if fields else rows
    return rows.dropDuplicates().withColumn("code", F.conv(F.substring("codepoint", 3, 6), 16, 10).cast("int"))


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with header; NaN and infinite numbers become empty."""
    for c, kind in rows.dtypes:
        if kind in ("double", "float"):
            rows = rows.withColumn(c, F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)))
    rows.write.mode("overwrite").csv(path, header=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def export_bundle(tables: dict[str, DataFrame], folder: str, query: dict, methods: str = "") -> dict:
    """A research export: one CSV folder per table, query.json, METHODS.txt and checksums.json over the
    sidecars and part files that this driver can see."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    for name, rows in tables.items():
        write_table(rows, str(base / name))
    (base / "query.json").write_text(json.dumps(query, ensure_ascii=False, sort_keys=True, indent=1))
    (base / "METHODS.txt").write_text(methods)
    sums = {str(p.relative_to(base)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(base.rglob("*")) if p.is_file() and p.name != "checksums.json" and not p.name.startswith((".", "_"))}
    (base / "checksums.json").write_text(json.dumps(sums, indent=1))
    return sums


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows merged by key: the newest row wins, its nulls filled from the newest older value."""
    both = old.unionByName(new)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in both.columns if c not in keys and c != order]
    return both.groupBy(*keys).agg(*last, F.max(order).alias(order))


def heading_of(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line, t) -> each with the heading (a line that opens with #) above it."""
    along = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(F.col("t").startswith("#"), F.col("t")), ignorenulls=True).over(along))
