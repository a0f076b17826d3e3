import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import canonical_parent, century_start, count_exact, folder_of, han_numeral, normalised, overlaps_years, role_of, sexagenary
from quillspark.operators import index, search
from quillspark.operators.search import SearchSpec, compact_windows, match_text, ordered_windows


def windows(units, terms, span, order="any"):
    spec = SearchSpec(tuple(terms), mode="proximity", span=span, order=order)
    return match_text(spec, units.replace(" ", ""))


@pytest.mark.parametrize(
    "units, terms, span, order, expected",
    [
        ("甲 舜 乙 天 下 丙 孝 丁", ["舜", "孝", "天下"], 7, "any", [[(0, 1, 2), (1, 6, 7), (2, 3, 5)]]),
        ("舜 孝 天 下", ["舜", "孝", "天下"], 4, "entered", [[(0, 0, 1), (1, 1, 2), (2, 2, 4)]]),
        ("舜 孝 天 下", ["孝", "舜", "天下"], 4, "entered", []),
        ("民 君", ["民", "民", "君"], 3, "any", []),
        ("民 民 君", ["民", "民", "君"], 3, "any", [[(0, 0, 1), (1, 1, 2), (2, 2, 3)]]),
        ("舜 舜 孝", ["舜", "孝"], 3, "any", [[(0, 1, 2), (1, 2, 3)]]),
        ("民 與 民 共 事 君", ["民", "民", "君"], 8, "entered", [[(0, 0, 1), (1, 2, 3), (2, 5, 6)]]),
    ],
)
def test_proximity(units, terms, span, order, expected):
    assert windows(units, terms, span, order) == expected


def test_windows_like_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abcx") for _ in range(14))
        places = [[(m.start(), m.start() + 1) for m in re.finditer(t, text)] for t in "abc"]
        if not all(places):
            continue
        found = compact_windows(places, [0, 1, 2], 99)
        for w in found:
            s, e = min(x[1] for x in w), max(x[2] for x in w)
            inside = text[s:e]
            assert all(t in inside for t in "abc")
            assert not all(t in inside[1:] for t in "abc") and not all(t in inside[:-1] for t in "abc")
        every = {(s, e) for s in range(14) for e in range(s + 1, 15) if all(t in text[s:e] for t in "abc") and not all(t in text[s + 1 : e] for t in "abc") and not all(t in text[s : e - 1] for t in "abc")}
        assert {(min(x[1] for x in w), max(x[2] for x in w)) for w in found} <= every
        assert bool(found) == bool(every)
        for w in ordered_windows(places, [0, 1, 2], 99):
            assert w[0][1] <= w[1][1] <= w[2][1]


CORPUS = [
    (1, "中國漢文/clean/周朝/metadata_only.txt", "# TITLE: 關關雎鳩在河之洲\n\n無匹配正文\n"),
    (2, "中國漢文/clean/周朝/body.txt", "# TITLE: Body\n\n關關雎鳩，在河之洲。\n"),
    (3, "中國漢文/clean/周朝/proximity.txt", "# TITLE: Proximity\n\n舜，克孝，聞於天下。\n"),
    (4, "中國漢文/clean/周朝/repeated.txt", "# TITLE: Repeated\n\n民與民共事君。\n"),
    (5, "中國漢文/clean/周朝/alternatives.txt", "# TITLE: 仁義不入正文搜尋\n\n君子仁而有義。\n"),
    (6, "日本漢文/clean/江戶時代/broad.txt", "# TITLE: Broad\n\n試験之法。\n"),
    (7, "中國漢文/clean/周朝/variants/variant.txt", "關關雎鳩在河之洲\n"),
    (8, "中國漢文/raw/周朝/raw.txt", "關關雎鳩在河之洲\n"),
    (9, "x/clean/none.txt", None),
    (10, "x/clean/empty.txt", ""),
]


@pytest.fixture(scope="module")
def manifest(spark):
    files = spark.createDataFrame(CORPUS, "doc_id bigint, path string, text string")
    parsed = index.parse_documents(files, "text")
    rows = parsed.withColumns({"document_role": role_of(F.col("path")), "folder_path": folder_of(F.col("path")), "year_start": F.lit(None).cast("int"), "year_end": F.lit(None).cast("int"), "parent": canonical_parent(F.col("path"))})
    return rows.cache()


def hits(manifest, terms, **more):
    spec = SearchSpec(tuple(terms), **more)
    return sorted((r.doc_id, r.matched, r.search_start, r.search_end, r.original_start, r.original_end) for r in search.find_hits(search.in_scope(manifest, spec), spec).collect())


def test_exact_search(manifest):
    assert hits(manifest, ["關關雎鳩在河之洲"]) == [(2, "關關雎鳩，在河之洲", 0, 8, 0, 9)]
    assert hits(manifest, ["關關雎鳩在河之洲"], punctuation="respect") == []
    assert len(hits(manifest, ["關關雎鳩，在河之洲"], punctuation="respect")) == 1
    assert [h[0] for h in hits(manifest, ["關關雎鳩"], roles=("textual_variant", "canonical"))] == [2, 7]
    assert [h[0] for h in hits(manifest, ["關關雎鳩"], roles=("textual_variant",))] == [7]
    assert [h[0] for h in hits(manifest, ["關關雎鳩"], roles=("canonical", "raw"), folders=("中國漢文/raw",))] == [8]
    assert {r.doc_id: r.parent for r in manifest.collect()}[7] == "中國漢文/clean/周朝"


def test_equivalence_alternatives_and_proximity(manifest):
    assert hits(manifest, ["試驗"]) == []
    assert [h[1] for h in hits(manifest, ["試驗"], classes=("驗験验",))] == ["試験"]
    assert [h[1] for h in hits(manifest, ["仁", "義"], mode="or")] == ["仁", "義"]
    assert hits(manifest, ["不入正文搜尋", "不存在"], mode="or") == []
    spec = SearchSpec(("仁", "仁"), mode="or")
    (one,) = search.find_hits(manifest.where("doc_id = 5"), spec).collect()
    assert len(one.term_matches) == 2
    assert [h[1] for h in hits(manifest, ["舜", "孝"], mode="proximity", span=3, order="entered")] == ["舜，克孝"]
    assert [h[1] for h in hits(manifest, ["舜", "孝", "天下"], mode="proximity", span=8, order="entered")] == ["舜，克孝，聞於天下"]
    assert hits(manifest, ["孝", "舜"], mode="proximity", span=3, order="entered") == []
    assert [h[1] for h in hits(manifest, ["[民君]"], mode="regex")] == ["君", "民", "民", "君"]


def test_spec_clamps_refuses_and_round_trips():
    spec = SearchSpec(("a" * 80,), span=99_999, context=900, per_page=0, page=-3, roles=("nobody",), folders=("/x/y/", " "))
    assert (spec.span, spec.context, spec.per_page, spec.page, spec.roles, spec.folders) == (5000, 500, 1, 1, ("canonical",), ("x/y",))
    assert SearchSpec.from_dict(spec.to_dict()) == spec
    assert spec.cache_key() == SearchSpec.from_dict({**spec.to_dict(), "page": 7, "context": 3}).cache_key() != SearchSpec(("a",)).cache_key()
    refused = [("a" * 81,), (), ("a", "b"), (" ",)]
    for terms in refused:
        with pytest.raises(ValueError):
            SearchSpec(terms)
    for terms, mode in ((("a",), "none"), (("a",), "or"), (tuple("abcdefghijk"), "or"), (("a",), "proximity"), (("a" * 1001,), "regex"), (("(",), "regex"), (("",), "regex")):
        with pytest.raises(ValueError):
            SearchSpec(terms, mode=mode)
    assert len(SearchSpec(tuple("abcdefghij"), mode="or").terms) == 10


def test_patterns_that_engines_read_differently(spark):
    texts = [(1, "第12章"), (2, "第１２章"), (3, "ab_é"), (4, ""), (5, None), (6, "a\u2028b")]
    df = spark.createDataFrame(texts, "doc_id bigint, body string")
    for pattern in (r"\d+", r"\w+", r"\bb", "(?i)A", "[一二]+", "a.b", "é{1,2}|章"):
        spec = SearchSpec((pattern,), mode="regex", punctuation="respect")
        got = sorted((r.doc_id, r.search_start, r.search_end) for r in search.find_hits(df, spec).collect())
        assert got == sorted((i, *m.span()) for i, t in texts if t for m in re.finditer(pattern, t)), pattern
    assert search.read_alike("[一二三]+年(甲|乙)?x{1,2}")
    assert not any(map(search.read_alike, (r"\d", "a.b", "^a", "a$", "(?:a)", "[a&&b]", "a*+", "a{", "")))
    with pytest.raises(TimeoutError):
        search.regex_spans("(a|aa)+$", "a" * 60 + "b", 0.05)


def test_offsets_by_runs():
    ignored = search.ignored_runs()
    for body in ("", "，", "a", "，a，b。。c", "a\u200bb　c", "𠀀，𠀀"):
        stream, starts, shifts = search.without_ignored(body, ignored)
        kept = [i for i, c in enumerate(body) if not ignored.fullmatch(c)]
        assert stream == "".join(body[i] for i in kept)
        assert [i + shifts[search.bisect_right(starts, i) - 1] for i in range(len(stream))] == kept


def test_result_page(manifest):
    scope = manifest.select("*").where("body <> ''")
    page = search.result_page(scope, SearchSpec(("[民君]",), mode="regex", per_page=3, context=1))
    rows = page.collect()
    assert [(r.path[-11:], r.matched, r.left_context, r.right_context) for r in rows] == [("natives.txt", "君", "", "子"), ("epeated.txt", "民", "", "與"), ("epeated.txt", "民", "與", "共")]
    assert {(r.total, r.total_pages, r.complete, r.truncated) for r in rows} == {(4, 2, True, False)}
    short = search.result_page(scope, SearchSpec(("[民君]",), mode="regex"), most_hits=2).collect()
    assert len(short) == 2 and {(r.total, r.complete, r.truncated) for r in short} == {(2, False, True)}
    few = search.result_page(scope, SearchSpec(("[民君]",), mode="regex"), most_documents=2).collect()
    assert {r.complete for r in few} == {False}
    every = search.result_page(scope, SearchSpec(("關關雎鳩",), roles=("canonical", "raw", "textual_variant"), deduplicate=True), most_hits=None, most_documents=None).collect()
    assert len(every) == 2


def test_header_and_empty_bodies(manifest):
    got = {r.doc_id: (r.metadata, r.body) for r in manifest.collect()}
    assert got[2] == ({"TITLE": "Body"}, "關關雎鳩，在河之洲。\n")
    assert got[7] == ({}, "關關雎鳩在河之洲\n") and got[9] == ({}, "") and got[10] == ({}, "")


def test_counts_overlap_and_astral_offsets(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "a𠀀b𠀀 a𠀀b"), (3, None)], "doc_id bigint, body string")
    assert [r[0] for r in df.select(count_exact(normalised(F.col("body")), "aa")).collect()] == [3, 0, 0]
    found = search.find_hits(df, SearchSpec(("𠀀b",))).collect()
    assert sorted((r.doc_id, r.original_start, r.original_end) for r in found) == [(2, 1, 3), (2, 6, 8)]
    grams = {(r.doc_id, r.start, r.phrase) for r in index.phrase_matches(df.select("doc_id", F.col("body").alias("stream")).where("body is not null"), spark.createDataFrame([("𠀀b",)], "phrase string")).collect()}
    assert grams == {(2, 1, "𠀀b"), (2, 6, "𠀀b")}


def test_column_functions(spark):
    years = spark.createDataFrame([(1,), (100,), (101,), (-1,), (-100,), (-101,), (2024,)], "y int")
    rows = {r.y: (r.c, r.s, r.n) for r in years.select("y", century_start(F.col("y")).alias("c"), sexagenary(F.col("y")).alias("s"), han_numeral(F.col("y")).alias("n")).collect()}
    assert {y: r[0] for y, r in rows.items()} == {1: 1, 100: 1, 101: 101, -1: -100, -100: -100, -101: -200, 2024: 2001}
    assert rows[2024] == (2001, "甲辰", "二千零二十四") and rows[-1][1] is None and rows[100][2] == "一百"
    ranges = spark.createDataFrame([(1, 100, 200), (2, None, 150), (3, None, None), (4, 300, None)], "i int, a int, b int")
    assert [r.i for r in ranges.where(overlaps_years(F.col("a"), F.col("b"), 140, 250)).collect()] == [1, 2]
    assert ranges.where(overlaps_years(F.col("a"), F.col("b"), None, None)).count() == 4


def test_similar_texts_like_brute_force(spark):
    import random

    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    texts = {}
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(60)] = rng.choice("xyz")
        texts[i] = "".join(t)
    texts |= {100: "abc", 101: "", 102: base[0]}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, stream string")
    got = {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in index.similar_texts(df, 5, 0.8).collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for t, i in first.items() if len(t) >= 5}
    wanted = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert got == wanted and wanted


def test_dedup_pages_and_latest(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, None), (5, "y")], "i int, fp string")
    assert sorted(r.i for r in search.first_per_body(df, "fp", "i").collect()) == [1, 3, 4, 5]
    assert [r.i for r in search.page_of(df, [F.desc("i")], 2, 2).collect()] == [3, 2]
    last = index.latest_by(spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 1, None)], "k string, t int, v string"), ["k"], "t")
    assert {(r.k, r.t, r.v) for r in last.collect()} == {("a", 2, "q"), ("b", 1, None)}


def test_longest_non_overlapping(spark):
    rows = [(1, "ab", 0), (1, "abc", 0), (1, "bc", 1), (1, "cd", 2), (1, "de", 3)]
    got = index.longest_non_overlapping(spark.createDataFrame(rows, "doc_id bigint, phrase string, start int"))
    assert sorted((r.start, r.phrase) for r in got.collect()) == [(0, "abc"), (3, "de")]


def test_every_copy_leads_to_its_pairs(spark):
    a, b = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy!"
    texts = {5: a, 3: a, 9: b, 7: b, 8: b, 1: "", 2: None, 4: "", 6: "xyz", 10: "xyz"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, stream string")
    member = {r.doc_id: (r.representative, r.copies) for r in index.copy_membership(df).collect()}
    assert member == {3: (3, 2), 5: (3, 2), 7: (7, 3), 8: (7, 3), 9: (7, 3), 1: (1, 1), 2: (2, 1), 4: (4, 1), 6: (6, 2), 10: (6, 2)}
    pairs = {(r.doc_a, r.doc_b) for r in index.similar_texts(df, 5, 0.8).collect()}
    assert {(x, y) for x in texts for y in texts if (member[x][0], member[y][0]) in pairs} == {(x, y) for x in (3, 5) for y in (7, 8, 9)}


def test_paths_along_a_long_chain(spark):
    edges = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}", "s") for i in range(12)], "base string, variant string, source string")
    got = {(r["from"], r.to): (r.path, len(r.sources)) for r in index.equivalence_paths(edges).collect()}
    names = [f"c{i:02}" for i in range(13)]
    assert got == {(names[i], names[k]): (names[i : k + 1] if i < k else names[k : i + 1][::-1], abs(i - k)) for i in range(13) for k in range(13) if i != k}


def test_similar_texts_of_a_large_family(spark):
    base = "".join(chr(0x4E00 + i) for i in range(100))
    texts = [(i, base + chr(0x5F00 + i)) for i in range(70)]
    got = {(r.doc_a, r.doc_b) for r in index.similar_texts(spark.createDataFrame(texts, "doc_id bigint, stream string"), 5, 0.8).collect()}
    assert got == {(a, b) for a in range(70) for b in range(a + 1, 70)}
