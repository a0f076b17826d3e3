import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import matching, names, variants


@pytest.fixture(scope="module")
def reader(spark):
    return names.Reader(names.han_tables(spark))


def test_names_in_every_spelling(reader):
    key = reader.name("曹騰啟")["keys"][0]
    for text in ("曹腾启", "Cao Tengqi", "Tengqi Cao", "Ts'ao T'eng-ch'i", "曹​騰啓", "CAO teng qi", "[明]曹騰啟", "大明·曹騰啟", "曹 騰啟 (2)"):
        assert key in reader.name(text)["keys"], text
    assert reader.name("任綸冠（子耀）")["extra"] == ["子耀"]
    assert reader.name("許洲毅字伯能") | {"keys": 0} == {"han": "许洲毅", "keys": 0, "extra": ["伯能"], "initials": None}
    assert reader.name("Li, Q. D.")["initials"] == ("li", "qd")
    assert reader.initials_of("李潛德") == ("li", "qd")
    for nobody in (None, "", " ", "佚名", "Anonymous", "？", "123"):
        assert reader.name(nobody) is None
    assert names.number("一一〇") == 110 and names.number("一百零三") == 103 and names.number("十五") == 15 and names.number("x") is None


def test_citations_and_polities(reader):
    lines = ["见《古空氏族略》第105卷", "古空氏族略卷一〇五葉1", "古空氏族略, juan 105, p. 1", "古空氏族略 105:1a", "古空氏族略．卷一百零五．7頁"]
    assert {tuple(reader.citations(x)) for x in lines} == {("古空氏族略#105",)}
    assert reader.citations("\n".join(lines)) == ["古空氏族略#105"]
    assert reader.citations("Reign-date source conflict retained") == reader.citations(None) == []
    assert reader.polity("滿清; 清朝") == reader.polity("Qing") == "清" and reader.polity(" ") is None


def test_slips():
    assert variants.one_slip("jingbing", "jinbing") and variants.one_slip("abc", "acb") and variants.one_slip("abc", "abd") and variants.one_slip("abc", "abcc")
    assert not variants.one_slip("abc", "bca") and not variants.one_slip("abc", "abcde")


PEOPLE = "person_no bigint, source string, label string, local_label string, romanized string, name_han string, aliases string, year_start int, year_end int, polity string, places string, source_citations string, a string"


def person(no, source, label, start, end, polity="清", cites=None, romanized=None, aliases=None, places=None, local=None):
    return (no, source, label, local, romanized, label if source == "f" else None, aliases, start, end, polity, places, cites, "x")


def test_match_sources(spark):
    rows = [
        person(1, "f", "蔡逵鶴", 1714, 1745, "江戶", "浦無列傳卷2葉58", "Cai Kuihe", "季芳"),
        person(2, "w", "Kuihe Cai", 1712, 1745, "德川", "见《浦無列傳》第2卷"),
        person(3, "c", "蔡季芳", 1714, 1745, "Edo", "浦無列傳 2:58a"),
        person(4, "f", "何海維", 650, 720, "唐", "甲書卷1"),
        person(5, "c", "何海维", 1707, 1741, "清", "乙書卷2"),
        person(6, "w", "何海維", 651, 720, "Tang", None),
        person(7, "f", "范朗義", 795, 854, "唐", "丙書卷5"),
        person(8, "c", "范國葆", 833, 894, "唐", "丙書卷5"),
        person(9, "f", None, None, None, None),
        person(10, "c", "佚名", 1, 2, "唐"),
        person(11, None, "何海維", 650, 720, "唐", "甲書卷1"),
        person(12, "f", "袁福杰", 806, 881, "唐", "丁書卷3", places="北陽府"),
        person(13, "c", "袁杰福", 806, 881, "唐", "丁書卷3", places="北陽府"),
        person(2, "w", "Kuihe Cai", 1712, 1745, "德川", "见《浦無列傳》第2卷"),
    ]
    df = spark.createDataFrame(rows, PEOPLE)
    found = matching.match_sources(df).collect()
    assert sorted((r.person_no_a, r.person_no_b) for r in found) == [(1, 2), (1, 3), (2, 3), (4, 6), (12, 13)]
    assert all(matching.LEAST <= r.confidence <= 1 and abs(1 / (1 + math.exp(-r.strength)) - r.confidence) < 1e-9 for r in found)
    assert matching.match_sources(df.limit(0)).count() == 0


def test_the_result_reads_few_intermediates(spark):
    """Closing over the third source reads the best pairs three times; not cut, each reading plans and scores all candidates anew."""
    rows = [person(1, "f", "何海維", 650, 720, "唐", "甲書卷1"), person(2, "c", "何海維", 651, 720, "唐", "甲書卷1")]
    found = matching.match_sources(spark.createDataFrame(rows, PEOPLE))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 5
    assert [(r.person_no_a, r.person_no_b) for r in found.collect()] == [(1, 2)]


def test_match_with_polity_and_uneven_years_only(spark):
    rows = [person(1, "f", "何海維", 650, 720, "唐", "甲書卷1"), person(2, "c", "何海維", 671, 729, "唐", None), person(3, "f", "蔡逵鶴", 1714, 1745, "清", None), person(4, "c", "蔡逵鶴", 1700, 1750, "清", None)]
    found = matching.match_sources(spark.createDataFrame(rows, PEOPLE)).collect()
    assert {(r.person_no_a, r.person_no_b) for r in found} == {(1, 2), (3, 4)}


def test_third_source_closes_and_ties_stay_single(spark):
    schema = "a bigint, b bigint, source_a string, source_b string, cosine double, strength double"
    pairs = spark.createDataFrame([(1, 2, "x", "y", 0.9, 5.0), (2, 3, "y", "z", 0.8, 5.0), (1, 4, "x", "y", 0.9, 5.0), (5, 2, "x", "y", 0.99, 4.0)], schema)
    best = matching.mutual_best(pairs)
    assert {(r.a, r.b) for r in best.collect()} == {(1, 2), (2, 3)}
    assert {(r.a, r.b) for r in matching.close_over_third(best).collect()} == {(1, 2), (2, 3), (1, 3)}


MENTIONS = "mention_no bigint, text string, polity string, year int, person_no string"
PERSONS = "person_no bigint, name string, other_names string, polity string, year_start int, year_end int, text string"


def links(spark, mentions, persons, **how):
    m = spark.createDataFrame([(*r, "x") for r in mentions], MENTIONS)
    p = spark.createDataFrame([(*r, "x") for r in persons], PERSONS)
    return {r.mention_no: r.person_no for r in variants.link_mentions(m, p, **how).collect()}


def test_mentions_that_fit_merged_spellings_only(spark):
    persons = [(1, "曹建琦", "景輔", "元", 1341, 1408), (2, "錢炳吉", "", "漢", -131, -93)]
    mentions = [(1, "Cao Jingfu", "元", 1380), (2, "Qian Bigji", "漢", -110), (3, "Qian Bigjy", "漢", -110), (4, "Cao Jingfu", "清", 1800), (5, "Qian Xxxxx", "漢", -110)]
    assert links(spark, mentions, persons) == {1: 1, 2: 2, 3: 2}


def test_links_come_from_merging_and_rematching(spark):
    persons = [(1, "曹建琦", "景輔", "元", 1341, 1408), (2, "錢炳吉", "", "漢", -131, -93), (3, "李潛德", None, "明", 1500, 1560)]
    mentions = [(1, "弟偽居士曹建琦", "元", 1380), (2, "弟偽居士", "元", 1380), (3, "Qian Bigji", "漢", -110), (4, "Qian Bigjy", "漢", -110), (5, "Cao Jingfu", "元", 1380), (6, "李潛德字伯能", "明", 1530), (7, "Li Boneng", "明", 1530), (8, "Li, B. N.", "明", 1530)]
    assert links(spark, mentions, persons) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 3, 7: 3}
    assert links(spark, mentions, persons, rematch=False) == {1: 1, 3: 2, 6: 3}


def test_mentions_of_unknown_polity_meet_every_person(spark):
    persons = [(1, "何海維", None, "遼", 1000, 1050), (2, "蔡逵鶴", None, None, 1000, 1050), (3, "范朗義", None, "唐", None, None)]
    mentions = [(1, "何海維", None, 1030), (2, "Cai, K. H.", None, 1030), (3, "Fan, L. Y.", "唐", 850), (4, "蔡逵鶴", "宋", 1020), (5, "He, H. W.", None, 1030), (6, "Fan, L. Y.", "唐", None), (7, "蔡 逵鶴居士", None, None)]
    assert links(spark, mentions, persons) == {1: 1, 2: 2, 3: 3, 4: 2, 5: 1, 6: 3, 7: 2}


def test_studio_names_with_another_ending(spark):
    assert variants.stem("庫死居士") == "庫死" and variants.stem("居士") == "居士"
    assert links(spark, [(1, "庫死居士", "唐", 655), (2, "庫死", "唐", 655), (3, "庫活居士", "唐", 655)], [(1, "程善卿", "孟安; 庫死軒", "唐", 640, 700)]) == {1: 1}


def test_people_outside_the_register(spark):
    mentions = [(5, "郭魯靖", "元", 1320), (3, "Guo Lujing", "元", 1330), (7, "Guo, L. J.", "元", None), (9, "郭魯靖", "元", 1340), (11, "郭魯靖", "清", 1800), (4, "曹建琦", "元", 1380), (8, "佚名", "元", 1320), (6, None, "元", 1320), (12, "Wu Xinlin", "元", 1320)]
    m = spark.createDataFrame([(*r, "x") for r in mentions], MENTIONS)
    found = spark.createDataFrame([(4, 1)], "mention_no bigint, person_no bigint")
    assert {r.mention_no: r.meaning for r in variants.outside_register(m, found).collect()} == {5: 5, 3: 5, 7: 5, 9: 5, 11: 11}
    assert variants.outside_register(m.limit(0), found).count() == 0


def test_link_blocking_recall_against_all_pairs(spark, reader):
    import random

    rng = random.Random(6)
    signs, given = "曹錢盧李何蔡范袁", "建琦炳吉知榮潛德海維逵鶴朗義福杰"
    persons = [(i, rng.choice(signs) + "".join(rng.sample(given, 2)), None, rng.choice(["元", "明", None]), y := rng.randrange(1280, 1600), y + 50) for i in range(60)]
    texts = []
    for _, name, *_ in persons:
        letters = reader.read(name)
        texts += [name[0] + name[2] + name[1], f"{letters[0].title()} {''.join(letters[1:]).title()}", f"{letters[0].title()}, {letters[1][0].upper()}. {letters[2][0].upper()}.", name + "撰"]
    mentions = [(i, t, rng.choice(["元", "明", None]), rng.choice([None, rng.randrange(1280, 1640)])) for i, t in enumerate(texts)]
    wanted = {}
    for no, text, polity, year in mentions:
        m = variants.read_mention(reader, text)
        scores = {}
        for person, name, _, of, start, end in persons:
            level = variants.agreement(reader, m, [reader.clean(name)], set())
            same = None if polity is None or of is None else polity == of
            gap = variants.time_gap(year, start, end)
            if variants.fits(level, same, gap):
                scores[person] = (level, 2 * (same is True) + (gap == 0))
        best = [p for p, x in scores.items() if x == max(scores.values())]
        if len(best) == 1:
            wanted[no] = best[0]
    got = links(spark, mentions, persons, rematch=False)
    assert len(wanted) > 60 and got == wanted


def test_link_mentions(spark):
    persons = [(1, "曹建琦", "弟偽居士 | 景輔", "元", 1341, 1408), (2, "錢炳吉", "", "漢", -131, -93), (3, "盧知榮", None, "唐", 716, 742), (4, "盧知榮", None, "清", 1816, 1842), (5, None, None, "清", 1, 2), (6, "李潛德", None, "明", 1500, 1560), (7, "李清丹", None, "明", 1500, 1560), (1, "曹建琦", "弟偽居士 | 景輔", "元", 1341, 1408)]
    mentions = [
        (1, "[大元]曹建琦", "Yuan", 1380), (2, "曹景輔", "元", None), (3, "弟偽居士曹建琦等編", "元", 1400), (4, "Qian Bigji", "漢", -110), (5, "卢知荣", "大清", 1830),
        (6, "盧知榮", None, None), (7, "盧榮知", "唐", 740), (8, "Li, Q. D.", "明", 1530), (9, "佚名", "明", 1530), (10, None, "明", 1530), (11, "曹建琦", "清", 1800),
        (12, "故錢炳吉公 撰", "漢", -100), (13, "曹建琦 墨客", "元", 1370), (14, "曹墨客", "元", 1375), (15, "錢炳吉吉", "漢", -100), (1, "[大元]曹建琦", "Yuan", 1380),
    ]
    assert links(spark, mentions, persons) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 4, 7: 3, 12: 2, 13: 1, 14: 1, 15: 2}
    assert links(spark, [], persons) == {} == links(spark, mentions, [])


def pairs_of(people):
    return {(r.person_no_a, r.person_no_b) for r in matching.match_sources(people).collect()}


@pytest.fixture(scope="module")
def people(spark):
    from pathlib import Path

    path = "/root/testdata/sf0.01/people.parquet"
    if not Path(path).exists():
        pytest.skip("no test data")
    return spark.read.parquet(path)


def test_blocking_recall_against_all_pairs(people, monkeypatch):
    found = pairs_of(people)

    def every(known, tables, trained):
        one = known.select("person_no", "source")
        b = one.withColumnsRenamed({"person_no": "b", "source": "of_b"})
        return one.withColumnsRenamed({"person_no": "a", "source": "of_a"}).join(b, (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b"))).select("a", "b")

    monkeypatch.setattr(matching, "candidate_pairs", every)
    wanted = pairs_of(people)
    assert len(wanted) > 100
    assert len(found & wanted) / len(wanted) >= 0.97
    assert len(found - wanted) <= 0.05 * len(found)


def test_matches_come_from_the_trained_vectors(people, monkeypatch):
    found = pairs_of(people)
    monkeypatch.setattr(matching, "train_tokens", lambda tokens, seed=5: np.zeros((matching.BUCKETS, matching.SIZE), dtype=np.float32))
    assert len(pairs_of(people) & found) < 0.5 * len(found)


def test_mixture_finds_the_classes_without_labels():
    rng = np.random.default_rng(2)
    one = rng.random(20_000) < 0.3
    shares = {"name": ([0, 0, 0, 0, 0, 0, 0.1, 0.9], [0.4, 0.3, 0.2, 0.05, 0.03, 0.01, 0, 0.01]), "cites": ([0.2, 0.1, 0.4, 0.3], [0.2, 0.7, 0.1, 0]), "polity": ([0.5, 0.5], [0.5, 0.5]), "place": ([0.6, 0.1, 0.3], [0.6, 0.39, 0.01])}
    columns = [np.where(one, *(rng.choice(len(s), 20_000, p=s) for s in shares[f])) if f in shares else np.zeros(20_000, dtype=int) for f in matching.EXPECTED]
    patterns, at, counts = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True, return_counts=True)
    start, weights = matching.fit_mixture(patterns, counts.astype(float))
    odds = start + sum(weights[f][patterns[:, k]] for k, f in enumerate(matching.EXPECTED))
    p = (1 / (1 + np.exp(-odds)))[at.ravel()]
    assert abs(p.mean() - one.mean()) < 0.02
    assert ((p > 0.5) == one).mean() > 0.98
    # Confidences are shares: of the pairs given about this confidence, so many mean one person.
    for low, high in ((0, 0.1), (0.9, 1.01)):
        chosen = (p >= low) & (p < high)
        assert abs(one[chosen].mean() - p[chosen].mean()) < 0.03
