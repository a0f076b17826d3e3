"""Queries of the general preparation operators: orphan references, packed fields, hierarchies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.hierarchy import descendant_pairs, descendants, nested_nodes, resolve_hierarchy
from quillspark.operators.packed import known_whole_values, unpack
from quillspark.operators.references import clean_id, orphan_references, orphan_report
from quillspark.session import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    registry = table(spark, root, "metadata_id_registry").where("status = 'active'")
    audits = table(spark, root, "identifier_fallback_works")
    exported = table(spark, root, "document_counts")

    def of_list(column: str, target: str) -> DataFrame:
        return audits.select(
            F.lit("identifier_fallback_works").alias("table_name"),
            F.col("audit_no").alias("row_no"),
            F.lit(column).alias("field_name"),
            F.col("audited_at").alias("ref_at"),
            F.lit(target).alias("target"),
            F.posexplode(column).alias("pos", "id"),
        ).withColumn("ref_pos", F.col("pos").cast("bigint"))

    columns = ["table_name", "row_no", "field_name", "ref_pos", "target", "id", "ref_at"]
    of_registry = registry.select(
        F.lit("metadata_id_registry").alias("table_name"),
        "row_no",
        F.lit("source_document_id").alias("field_name"),
        F.lit(0).cast("bigint").alias("ref_pos"),
        F.lit("document").alias("target"),
        F.col("source_document_id").alias("id"),
        F.col("registered_at").alias("ref_at"),
    )
    references = (
        of_registry.select(columns)
        .unionByName(of_list("fallback_document_ids", "exported").select(columns))
        .unionByName(of_list("missing_work_ids", "work").select(columns))
    )
    parents = registry.where("kind in ('work', 'document')").select(F.col("kind").alias("target"), "id", F.col("registered_at").alias("at"))
    parents = parents.unionByName(exported.select(F.lit("exported").alias("target"), F.col("document_id").alias("id"), F.col("exported_at").alias("at")))
    return orphan_references(references, parents)


@query
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("table_name", "row_no", "field_name", "ref_pos")


@query
def p3_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(_orphans(spark, root))


_CLEAN = r"""nullif(case when length(x) = 24 then x else regexp_replace(x, '^0+([0-9])', '\1') end, '')"""


def _clean_of(name: str) -> str:
    return re.sub(r"\bx\b", name, _CLEAN)


_CLEAN_X = (
    "regexp_replace(regexp_replace(lower(translate({0}, '０１２３４５６７８９ＡＢＣＤＥＦａｂｃｄｅｆ．', '0123456789abcdefabcdef.')),"
    r" '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200d}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{2060}}\x{{3000}}\x{{feff}}]+', '', 'g'), '^([0-9]+)\.0*$', '\1')"
)
_ORPHANS = f"""
with reg as (select * from metadata_id_registry where status = 'active'),
typed as (
  select distinct 'metadata_id_registry' table_name, row_no, 'source_document_id' field_name, 0::bigint ref_pos, 'document' target,
    {_CLEAN_X.format("source_document_id")} x, registered_at ref_at from reg
  union select 'identifier_fallback_works', audit_no, 'fallback_document_ids', pos - 1, 'exported', {_CLEAN_X.format("fallback_document_ids[pos]")}, audited_at
  from (select *, unnest(range(1, len(fallback_document_ids) + 1)) pos from identifier_fallback_works)
  union select 'identifier_fallback_works', audit_no, 'missing_work_ids', pos - 1, 'work', {_CLEAN_X.format("missing_work_ids[pos]")}, audited_at
  from (select *, unnest(range(1, len(missing_work_ids) + 1)) pos from identifier_fallback_works)
),
refs as (select *, {_CLEAN} id from typed),
par_typed as (
  select kind target, {_CLEAN_X.format("id")} x, registered_at seen_at from reg where kind in ('work', 'document')
  union all select 'exported', {_CLEAN_X.format("document_id")}, exported_at from document_counts
),
par as (select target, {_CLEAN} id, min(seen_at) seen_at from par_typed group by 1, 2),
orphans as (
  select r.*, case when p.id is null then 'missing' when p.seen_at > r.ref_at then 'late' end reason
  from refs r left join par p on p.target = r.target and p.id = r.id where r.id is not null
)
"""
SQL["p3_found"] = _ORPHANS + "select distinct table_name, row_no, field_name, ref_pos from orphans where reason is not null"
SQL["p3_report"] = (
    _ORPHANS
    + "select table_name, field_name, strftime(ref_at, '%Y-%m') as month, reason, count(*) orphans, count(distinct row_no) as rows from orphans where reason is not null group by 1, 2, 3, 4"
)


def _packed_fields(spark: SparkSession, root: str) -> DataFrame:
    people = table(spark, root, "people").dropDuplicates(["person_no"])
    categories = table(spark, root, "category_work_summary").dropDuplicates(["summary_no"])
    of_people = people.select(
        F.lit("people").alias("table_name"),
        F.col("person_no").alias("row_no"),
        F.explode(F.create_map(F.lit("roles"), "roles", F.lit("places"), "places", F.lit("aliases"), "aliases")).alias("field_name", "text"),
    )
    of_categories = categories.select(
        F.lit("category_work_summary").alias("table_name"), F.col("summary_no").alias("row_no"), F.lit("source_categories").alias("field_name"), F.col("source_categories").alias("text")
    )
    return of_people.unionByName(of_categories)


@query
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    fields = _packed_fields(spark, root)
    return unpack(fields, known_whole_values(fields))


_TRIM = r"'^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$'"
SQL["p4_found"] = rf"""
with fields as (
  select distinct 'people' table_name, person_no row_no, unnest(['roles', 'places', 'aliases']) field_name, unnest([roles, places, aliases]) t from people
  union select distinct 'category_work_summary', summary_no, 'source_categories', source_categories from category_work_summary
),
pieces as (
  select table_name, row_no, field_name,
    [regexp_replace(x, {_TRIM}, '', 'g') for x in regexp_extract_all(t, '(?:"(?:[^"]|"")*"|“[^”]*”|「[^」]*」|\([^)]*\)|（[^）]*）|[^;；、,，/／|｜\t\n\r])+')] raw
  from fields where t is not null
),
vals as (
  select table_name, row_no, field_name,
    [case when regexp_full_match(x, '"(?s:.*)"') and length(x) > 1 then replace(x[2:-2], '""', '"') when regexp_full_match(x, '“[^”]*”|「[^」]*」') then x[2:-2] else x end for x in raw] v
  from pieces
),
kept as (select table_name, row_no, field_name, [y for y in [regexp_replace(x, {_TRIM}, '', 'g') for x in v] if y <> ''] v from vals)
select table_name, row_no, field_name, unnest(range(len(v))) pos, unnest(v) as value from kept
"""


def _tree_nodes(spark: SparkSession, root: str) -> DataFrame:
    registry = table(spark, root, "metadata_id_registry").where("status = 'active'")
    of_registry = registry.select(
        F.lit("registry").alias("tree"),
        F.concat("kind", F.lit(":"), clean_id(F.col("id"))).alias("node"),
        F.concat(F.lit("work:"), clean_id(F.col("parent_work_id"))).alias("parent"),
    )
    rules = table(spark, root, "atlas_node_type_rules").select(F.concat("id", F.lit("/")).alias("prefix"), F.col("periods").alias("nested"))
    return of_registry.unionByName(nested_nodes(rules).select(F.lit("atlas").alias("tree"), "node", "parent"))


@query
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return resolve_hierarchy(_tree_nodes(spark, root))


@query
def p5_descendant_pairs(spark: SparkSession, root: str) -> DataFrame:
    return descendant_pairs(_tree_nodes(spark, root))


@query
def p5_descendants(spark: SparkSession, root: str) -> DataFrame:
    return descendants(resolve_hierarchy(_tree_nodes(spark, root)))


_TREE = f"""
with recursive typed as (
  select distinct 'registry' tree, kind, {_CLEAN_X.format("id")} x0, {_CLEAN_X.format("parent_work_id")} x1 from metadata_id_registry where status = 'active'
),
cleaned as (select tree, kind || ':' || {_clean_of("x0")} node, 'work:' || {_clean_of("x1")} parent from typed),
nested as (
  select id rule, unnest(json_extract(periods, '$[*]')) j, null::varchar parent from atlas_node_type_rules where json_valid(periods)
  union all select rule, unnest(json_extract(j, '$.children[*]')), rule || '/' || (j->>'$.id') from nested
),
all_nodes as (
  select tree, node, parent from cleaned union all select 'atlas', rule || '/' || (j->>'$.id'), parent from nested
),
nodes as (select n.tree, n.node, p.node parent from all_nodes n left join (select distinct tree, node from all_nodes) p on p.tree = n.tree and p.node = n.parent),
down as (
  select tree, node, node root, 0::bigint depth, node path from nodes where parent is null
  union all select n.tree, n.node, d.root, d.depth + 1, d.path || ' > ' || n.node from nodes n join down d on d.tree = n.tree and d.node = n.parent
),
stray as (select n.tree, n.node, n.parent from nodes n left join down d on d.tree = n.tree and d.node = n.node where d.node is null),
walk as (
  select tree, node, parent upto from stray
  union select w.tree, w.node, s.parent from walk w join stray s on s.tree = w.tree and s.node = w.upto
),
hier as (
  select * , 0::bigint on_cycle from down
  union all select s.tree, s.node, '', -1, '', case when exists (select 1 from walk w where w.tree = s.tree and w.node = s.node and w.upto = s.node) then 1 else 2 end from stray s
)
"""
SQL["p5_found"] = _TREE + "select tree, node, root, depth, path, on_cycle from hier"
SQL["p5_descendant_pairs"] = (
    _TREE
    + """, up as (
  select tree, node descendant, parent upto, 1::bigint distance, [parent] seen from nodes where parent is not null
  union all select u.tree, u.descendant, n.parent, u.distance + 1, list_append(u.seen, n.parent) from up u join nodes n on n.tree = u.tree and n.node = u.upto
  where n.parent is not null and not list_contains(u.seen, n.parent)
)
select n.tree, n.node, u.descendant, u.distance from (select distinct tree, node from nodes) n left join up u on u.tree = n.tree and u.upto = n.node"""
)
SQL["p5_descendants"] = (
    _TREE
    + """, above as (select tree, node, depth, string_split(path, ' > ') names from hier where on_cycle = 0 and depth > 0),
pairs as (select tree, depth, unnest(names[:-2]) node, unnest(range(len(names) - 1)) level from above)
select tree, node, count(*) descendants, sum(case when level = depth - 1 then 1 else 0 end)::bigint children from pairs group by 1, 2"""
)
