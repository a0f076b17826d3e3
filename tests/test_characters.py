from pyspark.sql import functions as F

from quillspark.operators import characters


def test_constraint_stack(spark):
    wide = spark.createDataFrame([("甲", "a", "1"), ("甲", "b", "2"), ("乙", "a", "2"), ("丙", None, "1"), ("丁", "", "1")], "ch string, s string, n string")
    table = characters.properties(wide, "ch", {"s": "s", "n": "n"})
    kept, steps = characters.constrained(table, [("n", ["1"]), ("s", ["a", "b"])])
    assert [r.ch for r in kept.collect()] == ["甲"]
    assert [(r.step, r.survivors) for r in steps.orderBy("step").collect()] == [(1, 3), (2, 1)]
    assert {(r.ch, r.value, r.others) for r in characters.sharing(table, "s").collect()} == {("甲", "a", 1), ("乙", "a", 1), ("甲", "b", 0)}


def test_variant_groups_and_heads(spark):
    chars = spark.createDataFrame([("为",), ("爲",), ("山",)], "ch string")
    edges = spark.createDataFrame([("為", "爲", "x"), ("為", "为", "y")], "base string, variant string, source string")
    got = {r.ch: (r["head"], r.members) for r in characters.variant_groups(chars, edges).collect()}
    assert got == {"为": ("为", 3), "爲": ("为", 3), "山": ("山", 1)}
    rows = spark.createDataFrame([("g", 1, None), ("g", 2, "x"), ("g", 3, None), ("h", 1, None)], "g string, k int, v string")
    assert {(r.g, r.k, r.inherited) for r in characters.inherit_head(rows, ["g"], "k", "v").collect()} == {("g", 1, "x"), ("g", 2, "x"), ("g", 3, "x"), ("h", 1, None)}


def test_natural_order(spark):
    rows = [("w", "卷", "w_juan_10_5.txt"), ("w", "卷", "w_juan_2_9.txt"), ("w", "序", "w_juan_1_1.txt"), ("w", "跋", "w_0.txt"), ("w", "附錄", "w_3.txt")]
    df = spark.createDataFrame(rows, "work string, title string, path string")
    placed = characters.natural_order(df, "work", "title").orderBy("place").select(F.col("path")).collect()
    assert [r.path for r in placed] == ["w_juan_1_1.txt", "w_juan_2_9.txt", "w_juan_10_5.txt", "w_3.txt", "w_0.txt"]


def test_signatures_miss_nothing(spark):
    from quillspark.operators import index

    rows = [(1, "未嘗不可"), (2, "甲乙"), (3, None), (4, ""), (5, "不嘗未" * 500)]
    signed = index.signatures(spark.createDataFrame(rows, "doc_id bigint, text string"), "text")
    found = {r.doc_id for r in index.maybe_holding(signed, "未嘗不").collect()}
    assert {1, 5} <= found and not {3, 4} & found


def test_self_dating_and_layers(spark):
    from quillspark.operators import index

    hits = spark.createDataFrame([(1, "三年五月", 95, "余謹識於", ""), (1, "一年一月", 50, "", "卒於"), (2, "三年五月", 1, "余", ""), (2, "四年五月", 99, "余", "")], "doc_id bigint, matched string, original_start int, left_context string, right_context string")
    lengths = spark.createDataFrame([(1, 100), (2, 100)], "doc_id bigint, n int")
    assert [(r.doc_id, r.year, r.score) for r in index.self_dated(hits, lengths).collect()] == [(1, "三年五月", 9)]
    a = spark.createDataFrame([(1, 0, 2, "x")], "doc_id bigint, start int, end int, label string")
    b = spark.createDataFrame([(1, 0, 2, "y"), (1, 3, 4, "z")], "doc_id bigint, start int, end int, label string")
    assert {(r.start, r.label, r.layer) for r in index.merge_by_priority([a, b]).collect()} == {(0, "x", 0), (3, "z", 1)}


def test_day_numbers(spark):
    from quillspark.functions.text import julian_day

    df = spark.createDataFrame([(2000, 1, 1), (1582, 10, 15), (-4712, 1, 1)], "y int, m int, d int")
    assert [r[0] for r in df.select(julian_day(F.col("y"), F.col("m"), F.col("d"))).collect()][:2] == [2451545, 2299161]
    assert df.where("y < 0").select(julian_day(F.col("y"), F.col("m"), F.col("d"), False)).first()[0] == 0


def test_ancestors_of_unevenly_typed_ids(spark, tmp_path):
    from quillspark.plans.characters import j28_ancestor_closure

    rows = [("1", "00102"), ("１０２", "103\u3000"), ("0103", "１０４"), ("104", "105.0"), ("105 ", None), ("9", " "), (None, "104")]
    registry = spark.createDataFrame([("work", "active", *r) for r in rows] + [("work", "retired", "7", "1")], "kind string, status string, id string, parent_work_id string")
    registry.write.parquet(f"{tmp_path}/metadata_id_registry.parquet")
    got = {(r.child, r.parent, r.depth) for r in j28_ancestor_closure(spark, str(tmp_path)).collect()}
    chain = [f"work:{i}" for i in (1, 102, 103, 104, 105)]
    assert got == {(chain[i], chain[k], k - i) for i in range(5) for k in range(i + 1, 5)}
