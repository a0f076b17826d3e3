import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import catalogue, classify, statistics
from quillspark.sources import corpus


def test_poisson_interval_and_trend(spark):
    low, high = statistics.poisson_interval(10)
    assert abs(low - 4.7954) < 1e-3 and abs(high - 18.3904) < 1e-3
    assert statistics.poisson_interval(0)[0] == 0 and abs(statistics.poisson_interval(0)[1] - 3.6889) < 1e-3
    assert abs(statistics.gamma_share(1, 2) - (1 - math.exp(-2))) < 1e-12
    rows = [(y, y, round(50 * math.exp(0.3 * (y - 1000) / 100)), 1_000_000) for y in range(600, 1600, 20)]
    df = spark.createDataFrame(rows, "year_start int, year_end int, occurrences bigint, searchable_characters bigint")
    trend = statistics.poisson_trend(df)
    assert trend["eligible"] and abs(trend["ratio_per_century"] - math.exp(0.3)) < 0.01 and trend["family"] == "poisson"
    assert not statistics.poisson_trend(df.limit(5))["eligible"]


def test_p_value_and_keyness(spark):
    got = spark.createDataFrame([(3.841,), (0.0,), (None,)], "g double").select(statistics.p_value(F.col("g")).alias("p")).collect()
    assert abs(got[0].p - 0.05) < 1e-3 and got[1].p == 1.0 and got[2].p is None
    rows = {r.item: r for r in statistics.keyness(spark.createDataFrame([("x", 30, 10), ("y", 70, 90)], "item string, n_a bigint, n_b bigint")).collect()}
    assert rows["x"].favoured == "a" and rows["x"].g2 > 10


def test_zero_hit_scopes(spark):
    df = spark.createDataFrame([("a", 0, 100), ("b", 5, 100), ("c", 9, 9)], "s string, occurrences bigint, searchable_characters bigint")
    row = statistics.compare_scopes(df, F.col("s")).first()
    assert abs(row.rate_ratio - 0.5 / 5.5) < 1e-12 and row.o_a == 0
    empty = statistics.overall(df.limit(0)).first()
    assert empty.documents == 0 and empty.prevalence == 0 and empty.per_million == 0


def test_numerals_and_dates():
    assert [scalars.numeral(x) for x in ("一百一十五", "二〇二四", "元", "廿三", "四千七百二十四", "三萬二千", "105", "十", "x", "")] == [115, 2024, 1, 23, 4724, 32000, 105, 10, None, None]
    assert scalars.resolve_date("民國一百一十五年八月二十六日") == (2026, 8, 26)
    assert scalars.resolve_year("主體2500年") == [4411]
    assert [scalars.resolve_year(f"佛曆{n}年") for n in ("2569", "元", "543", "544")] == [[2026], [-543], [-1], [1]]
    assert scalars.resolve_year("黃帝紀年四千七百二十四年") == [2026, 2027] and scalars.resolve_year("某年") == []


def test_readings():
    assert scalars.split_reading("mandarin", "lǖ") == ("lü", 1)
    assert [scalars.split_reading("mandarin", x)[1] for x in ("yī", "yí", "yǐ", "yì", "yi")] == [1, 2, 3, 4, 5]
    assert scalars.split_reading("vietnamese", "ứ") == ("ư", 2) and scalars.split_reading("vietnamese", "ầ") == ("â", 3) and scalars.split_reading("vietnamese", "ma") == ("ma", 6)
    assert scalars.split_reading("cantonese", "ji6") == ("ji", 6) and scalars.split_reading("cantonese", "zi") == ("zi", None)


def test_structures():
    assert [scalars.description_balance(x) for x in ("⿰木目", "⿰木", "⿰木目目")] == [0, -1, 1]
    assert scalars.description_tokens("⿰&CDP-8BF5;木") == ["⿰", "&CDP-8BF5;", "木"]
    assert scalars.description_parts("⿰亻⿱也木") == [("亻", 1, 1), ("也", 2, 3), ("木", 2, 4)] and scalars.description_parts("⿰木") == []


def test_likeness_columns(spark):
    df = spark.createDataFrame([("蔡逵鶴", "蔡鶴逵"), ("", ""), (None, "a")], "a string, b string")
    rows = df.select(scalars.subsequence_length(F.col("a"), F.col("b")).alias("l"), scalars.character_jaccard(F.col("a"), F.col("b")).alias("j"), scalars.normal_form(F.col("b")).alias("n")).collect()
    assert [(r.l, r.j) for r in rows] == [(2, 1.0), (0, 0.0), (None, None)]


def test_classifier(spark):
    literary = "德不孤必有鄰則善矣。何陋之有。未嘗不嘆息也。" * 6
    modern = "我們把這個的書都看了，他們說那是很好的。" * 6
    docs = spark.createDataFrame([(1, literary), (2, modern), (3, "短文"), (4, None), (5, ""), (6, literary * 20)], "doc_id bigint, text string")
    scored = classify.score_segments(classify.segments(docs))
    labels = {r.doc_id: r.label for r in classify.document_scores(scored).collect()}
    assert labels == {1: "literary", 2: "not_literary", 3: "too_short", 6: "literary"}
    rates = {r.doc_id: r.lc_rate for r in scored.collect()}
    assert abs(rates[1] - rates[6]) < 0.15 * rates[1]
    with pytest.raises(ValueError):
        classify.check_rules(classify.DEFAULT_RULES, {"nothing": 1.0})


def test_calibration(spark):
    import random

    rng = random.Random(3)
    rows = [(float(k) + rng.gauss(0, 0.3), k) for k in (0, 1) for _ in range(80)]
    _, _, area = classify.calibrate(spark.createDataFrame(rows, "x double, y int"), "y", ["x"])
    assert area > 0.9


def test_catalogue_pieces(spark):
    points = spark.createDataFrame([(1, 100), (2, 200), (3, -5), (4, None)], "i int, y int")
    eras = spark.createDataFrame([("a", 50, 150), ("b", -100, 100), ("c", 150, 400)], "era string, low int, high int")
    assert {(r.i, r.era) for r in catalogue.in_interval(points.where("y is not null"), "y", eras, "low", "high").collect()} == {(1, "a"), (1, "b"), (2, "c"), (3, "b")}
    ranked = catalogue.numbered(spark.createDataFrame([(v,) for v in (5, 3, 9, 1, 7)], "v int"), ["v"], "k")
    assert {(r.v, r.k) for r in ranked.collect()} == {(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)}
    ids = catalogue.repaired_ids(spark.createDataFrame([("a", 5), ("a", 7), ("b", 5), ("c", None)], "entity string, id bigint"))
    assert {(r.entity, r.id, r.status) for r in ids.collect()} == {("a", 5, "kept"), ("b", 6, "new"), ("c", 7, "new")}
    fuzzy = {r.ask: (r.title, r.band) for r in catalogue.fuzzy_titles(spark.createDataFrame([("史記集解",), ("漢書",)], "ask string"), spark.createDataFrame([("史記集觧",), ("史記",), ("漢書",)], "title string")).collect()}
    assert fuzzy["漢書"] == ("漢書", "strong") and fuzzy["史記集解"] == ("史記", "strong")


def test_sources_round_trip(spark, tmp_path):
    tree = tmp_path / "corpus"
    for path, data in {"中國漢文/clean/a.txt": "# TITLE: A\n\n甲乙", "中國漢文/raw/b.txt": "丙", "tmp/c.txt": "丁", "x/clean/d.txt": "。，", "x/clean/metadata.json": '{"polity": "唐"}'}.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(data)
    (tree / "x/clean/bad.txt").write_bytes(b"\xff\xfe\xff")
    manifest = corpus.build_manifest(corpus.read_tree(spark, str(tree)))
    assert {(r.path, r.document_role, r.searchable_characters) for r in manifest.collect()} == {("中國漢文/clean/a.txt", "canonical", 2), ("中國漢文/raw/b.txt", "raw", 1)}
    assert corpus.read_metadata(spark, str(tree)).first().owner == {"polity": "唐"}
    old = manifest.select("path", "body_fingerprint")
    assert corpus.plan_changes(old, old)["mode"] == "cached"
    new = old.withColumn("body_fingerprint", F.lit("z")).where("path like '%a.txt'")
    assert corpus.plan_changes(old, corpus.refresh(old, new, new.limit(0)))["mode"] == "targeted"
    out = str(tmp_path / "lines")
    work = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    corpus.append_lines(corpus.not_done(work.limit(1), spark, out, "path"), out)
    assert corpus.not_done(work, spark, out, "path").count() == 1
    sums = corpus.export_bundle({"t": work.withColumn("x", F.lit(float("nan")))}, str(tmp_path / "bundle"), {"q": 1}, "as said")
    assert {"query.json", "METHODS.txt"} <= set(sums) and corpus.read_table(spark, str(tmp_path / "bundle/t")).count() == 2
    props = tmp_path / "p.tsv"
    props.write_text("# note\nU+4E00\tkDefinition\tone\nU+4E00\tkDefinition\tone\nbroken\nU+20000\tkOther\tx\n")
    assert {(r.code, r.field) for r in corpus.read_properties(spark, str(props)).collect()} == {(0x4E00, "kDefinition"), (0x20000, "kOther")}
    merged = corpus.upsert(spark.createDataFrame([("a", "x", None, 1)], "k string, u string, v string, t int"), spark.createDataFrame([("a", None, "y", 2)], "k string, u string, v string, t int"), ["k"], "t")
    assert [tuple(r) for r in merged.select("k", "u", "v", "t").collect()] == [("a", "x", "y", 2)]


def test_streaming(spark, tmp_path):
    import datetime as dt

    from quillspark.streaming import incremental

    rows = [(i, f"文{i % 3}春秋春秋", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(9)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id bigint, text string, added_at timestamp").write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = incremental.documents_stream(spark, folder, schema)
    incremental.run_once(incremental.alerts(stream, "春秋"), str(tmp_path / "a"), str(tmp_path / "ca"))
    assert {(r.doc_id, r.occurrences) for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {(i, 2) for i in range(9)}
    incremental.run_once(incremental.first_bodies(stream, "added_at", "30 days"), str(tmp_path / "b"), str(tmp_path / "cb"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_comparisons_and_escapes(spark):
    from quillspark.functions.text import contains_literally, escape_like

    statistics.check_comparison("period", "明", "清")
    for wrong in (("author", "a", "b"), ("period", "a", " a"), ("period", "", "b")):
        with pytest.raises(ValueError):
            statistics.check_comparison(*wrong)
    assert escape_like("50%_\\") == "50\\%\\_\\\\"
    df = spark.createDataFrame([("50%",), ("505",), ("a_b",), ("a\\b",), (None,)], "t string")
    held = lambda x: [r.t for r in df.where(contains_literally(df["t"], x)).collect()]
    assert held("50%") == ["50%"] and held("a_") == ["a_b"] and held("\\") == ["a\\b"] and held("0") == ["50%", "505"]


def test_reading_and_date_columns(spark):
    df = spark.createDataFrame([("mǎ", "佛曆2569年三月五日"), ("ma4", "西元前1年"), ("ma", "某年"), (None, None)], "r string, d string")
    got = [tuple(r) for r in df.select(scalars.reading_slot(df["r"], "mandarin"), scalars.reading_tone(df["r"], "mandarin"), scalars.resolved_date(df["d"])).collect()]
    assert got[:3] == [("ma", 3, "2026-3-5"), ("ma", 4, "-1--"), ("ma", 5, None)]
    assert got[3][0] is None and got[3][2] is None
