import datetime as dt
import random
import re
import unicodedata

import numpy as np
import pytest

from quillspark.llm import lookalike, mixing, spam, survivors, tokens

TOKENIZER = tokens.TOKENIZER_FOLDER


@pytest.fixture(scope="module")
def codec():
    return tokens.Codec(tokens.default_model())


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(f"{TOKENIZER}/byte_bpe_50k.tiktoken"), special_tokens={})


def test_ids_equal_the_tokenizer(codec):
    rng = random.Random(1)
    alphabet = "之其者也 the lo'll 19，。\n\r\t　​𠀀é▁Ġ<|>한かが\x00"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 120))) for _ in range(300)]
    texts += ["<|endoftext|>", " ", "  a", "之" * 5000, "a" * 20_000, "▁▁", "<unk>", "�"]
    own = reference()
    for t in texts:
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t), t[:40]
        assert codec.decode(ids) == t
    assert codec.encode(None) == codec.encode("") == []


def test_encode_corpus_of_every_kind_of_row(spark, codec):
    rows = [(1, "君子 and", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x"), (5, " \n", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, tuple(r.ids)) for r in tokens.encode_corpus(df).collect()))
    assert got == sorted((i or 0, tuple(codec.encode(t))) for i, t, _ in rows)
    back = {(r.doc_id, r.text) for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    counts = {(r.doc_id, r.tokens) for r in tokens.token_counts(df, ["doc_id"], df["text"]).collect()}
    assert counts == {(i, len(codec.encode(t))) for i, t, _ in rows}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def look(text):
    table = {ord(a): b for x in (lookalike.CYRILLIC, lookalike.GREEK, lookalike.HYPHENS, lookalike.KATAKANA) for a, b in zip(*x)}
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf" and not (unicodedata.category(c) == "Mn" and not unicodedata.combining(c)))
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text.translate(table))).strip()


def test_visual_form(spark):
    texts = ["論​ニ集", "論二集　", "﻿論︀二集", "Ｃａfé", "Café", "Сafé", "한", "한", "土", "士", "a b", "a b", "a   b", "k‑n", "k-n", "⼀", "一", "論"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, t string, visual_form string")
    got = {r.t: r.visual_form for r in lookalike.with_visual_form(df, "t").collect()}
    assert got == {t: look(t) for t in texts}
    other = spark.createDataFrame([(None,), ("",), ("​　",), ("カタカナ",), ("ｶﾞ",), ("x" * 100_000,), ("東京のニ",)], "t string")
    got = {r.t: r.visual_form for r in lookalike.with_visual_form(other, "t").collect()}
    assert got == {None: None, "": "", "​　": "", "カタカナ": "カタカナ", "ｶﾞ": "ガ", "x" * 100_000: "x" * 100_000, "東京のニ": "東京のニ"}


def test_lookalike_pairs(spark):
    rows = [("a", 3, "二"), ("a", 1, "ニ二"), ("a", 2, "二二"), ("a", 2, "二二"), ("a", 7, "二二"), ("b", 1, "二 二"), ("a", 9, None), ("a", 10, ""), ("a", 11, "​"), ("a", 5, "二二​")]
    df = spark.createDataFrame(rows, "table_name string, row_no bigint, text string")
    got = sorted((r.table_name, r.row_no_a, r.row_no_b) for r in lookalike.lookalike_pairs(df).collect())
    assert got == [("a", 1, 2), ("a", 1, 5), ("a", 1, 7), ("a", 2, 5), ("a", 5, 7)]


def test_lookalike_classes(spark):
    rows = [("a", 1, "二"), ("a", 2, "二​"), ("a", 2, "二​"), ("a", 3, "二"), ("a", 4, "三"), ("b", 5, "二"), ("a", 6, None), ("a", 7, "​")]
    df = spark.createDataFrame(rows, "table_name string, row_no bigint, text string")
    assert [tuple(r) for r in lookalike.lookalike_classes(df).collect()] == [("a", "二", 2, 3)]


def test_split_tree_is_exact():
    counts = np.array([5, 0, 31, 1000])
    rows = mixing.split_tree(counts, 7, np.random.default_rng(3))
    assert rows.sum(axis=0).tolist() == counts.tolist()
    assert rows.sum(axis=1).max() - rows.sum(axis=1).min() <= 3


def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c"]), rng.randrange(0, 400), "x") for i in range(3000)] + [(9001, None, 50, "x"), (9002, "unwanted", 50, "x")]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, position string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(sized, targets, shards=5)
    got = mixed.collect()
    of = {r["source"]: r for r in report.collect()}
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(of[s].actual_share - share) < 0.005
        assert of[s].copies <= of[s].max_repeats
    assert of["none"].mixed_tokens == 0
    assert len({(r.doc_id, r["copy"]) for r in got}) == len(got)
    source = {i: s for i, s, *_ in rows}
    assert all(source[r.doc_id] == r.source and r.tokens > 0 for r in got)
    for shard in range(5):
        assert sorted(r.position for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    short = {r["source"]: r for r in mixing.mix(sized, targets, total_tokens=10**9)[1].collect()}
    assert short["b"].mixed_tokens == 3 * short["b"].available_tokens
    assert mixing.mix(sized.limit(0), targets)[0].count() == 0


def test_small_sources_reach_every_shard(spark):
    rows = [(i, "large" if i % 50 else "small", 100) for i in range(20_000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("large", 0.98, 1), ("small", 0.02, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(sized, targets, shards=16)[0].groupBy("shard").pivot("source", ["large", "small"]).count().collect()
    assert len(got) == 16 and all(10 <= r.small <= 45 for r in got) and sum(r.small for r in got) in range(398, 401)


SPAM = [
    "墨商、墨商、紙店、墨商、紙店、紙店、墨商、紙店、墨商、墨商",
    "夫人不可以忘其友。\n" + "\n".join(f"硯石{i} http://shop{i}.example/{i}.html" for i in range(6)),
    "#茶 #old_bell #紙墨 ＃硯 #frost #刻本",
    "古硯 ¥315|宣紙 包郵|字畫 現貨|印章|拓片 SKU95370|真跡 包郵|刻本",
    "首頁 > 甲乙 | 下一頁 > 甲乙 | 更多 > 丙丁 >> 首頁 > 甲乙 | 首頁 > 丙丁 | 更多 > 甲乙",
    "欲得寒墨者求寒墨，天下寒墨無如此寒墨。最佳寒墨。買寒墨，便宜寒墨在此，寒墨哪家強，最佳寒墨。",
]
SOUND = [
    "故命徙之。遂懷星於月筆。是而不東，兵而不小。新鄉有賤，譚禮以甲氣懷路甲，是以馬權奏於安江。（見 https://lib.example/juan/20）",
    "\n".join(f"卷{c}　{a}集　凡{b}篇" for c, a, b in zip("一二三四五六七八", "義貧強素賈友筮誌", "十六九四三二七五")),
    "\n".join(f"{a}縣　戶五{b}四　田六十{c}頃　安{a}" for a, b, c in zip("東白北臨長金平新", "一二三四五六七八", "三五七九一二四六")),
    "\n".join(f"{a}而不{b}，{b}{c}之{a}。遂懷{c}{a}於{b}。月明兮歸來。" for a, b, c in zip("天地人山水火木", "東西南北上下中", "金石絲竹土革匏")),
    "It's said the orchard's monk buried nothing; she didn't know who carried the archive. The second ferry crossed the province.",
]


def test_spam_and_sound_texts(spark):
    rows = list(enumerate(SPAM)) + [(100 + i, t) for i, t in enumerate(SOUND)] + [(200, None), (201, ""), (202, " \n"), (203, "# TITLE: 一"), (204, "故命徙之，" * 1)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, language string")
    assert {r.doc_id for r in spam.find_spam(df).collect()} == set(range(len(SPAM)))
    assert spam.find_spam(df.limit(0)).count() == 0
    assert spam.measure("字" * 300_000)[0] == 300_000


def test_many_keywords_in_turn_are_spam(spark):
    import random

    rng = random.Random(3)
    signs = [chr(0x5100 + i) for i in range(120)]
    keywords = ["".join(signs[4 * i : 4 * i + 4]) for i in range(30)]
    page = "、".join(rng.choice(keywords) for _ in range(240))
    contents = "、".join("".join(rng.choice(signs) for _ in range(4)) for _ in range(240))
    rows = [(1, page), (2, contents), *((3 + i, t) for i, t in enumerate(SOUND))]
    found = spam.find_spam(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.reason) for r in found] == [(1, "keywords")]


def test_thresholds_move_with_the_language(spark):
    rng = random.Random(12)
    page = lambda letters, particle, share: "，".join("".join(rng.choice(letters) if rng.random() > share else particle for _ in range(9)) for _ in range(30))
    signs, syllables = [chr(0x5100 + i) for i in range(300)], [chr(0xAC00 + 7 * i) for i in range(300)]
    refrain = lambda letters, n: "，".join(["".join(letters[:9])] * n + ["".join(rng.choice(letters[9:]) for _ in range(9)) for _ in range(30 - n)])
    rows = [(i, page(signs, "之", 0.3)) for i in range(60)] + [(100 + i, page(syllables, "은", 0.3)) for i in range(60)]
    # Ordinary pages of the one language repeat a phrase, those of the other never do.
    rows += [(200 + i, "，".join([page(signs, "之", 0.3), *["天地玄黃之其者也曰"] * 14])) for i in range(60)]
    rows += [(900, refrain(signs, 13)), (901, refrain(syllables, 13))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bound = {r.language: r.least_phrase for r in spam.calibrate(spam.measures(df)).collect()}
    assert bound["classical"] > bound["hangul"] + 0.1
    assert {r.doc_id for r in spam.find_spam(df).collect()} == {901}


T0 = dt.datetime(2024, 1, 1)
FIELDS = ["author", "year"]
SCHEMA = "group_id string, member_id string, author string, year int, role string, seen timestamp, survivor_id string"


def best(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(g, m, a, y, r, T0 + dt.timedelta(days=d), "clash") for g, m, a, y, r, d in rows], SCHEMA)
    found = survivors.best_representatives(df, FIELDS, (F.col("role") == "canonical").cast("int"), F.col("seen"))
    return {(r.group_id, r.member_id): (r.survivor_id, r.best) for r in found.collect()}


def test_survivor_order(spark):
    rows = [
        ("g", "a", "佚名", 5, "canonical", 1), ("g", "b", "李白", 5, "raw", 0), ("g", "c", None, None, "canonical", 9),
        ("h", "a", "x", 1, "raw", 1), ("h", "b", "x", 1, "canonical", 1), ("h", "b", "x", 1, "canonical", 1),
        ("i", "a", "x", 1, "raw", 1), ("i", "b", "x", 1, "raw", 2), ("alone", "z", "x", 1, "raw", 1), ("alone", "z", "x", 1, "raw", 2),
        (None, "q", "x", 1, "raw", 1), (None, "r", "x", 1, "raw", 1), ("e", "a", None, None, "raw", 1), ("e", "b", " ", None, "raw", 1),
    ]
    got = best(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {("g", "a"): "a", ("g", "b"): "a", ("g", "c"): "a", ("h", "a"): "b", ("h", "b"): "b", ("i", "a"): "b", ("i", "b"): "b", ("e", "a"): "a", ("e", "b"): "a"}
    assert got["g", "a"][1] == {"author": "李白", "year": "5"}
    assert got["e", "a"][1] == {}


def test_consensus_breaks_ties_and_picks_values(spark, monkeypatch):
    names = ["Wang Wei", "Wang Wie", "Wang Wei jr", "Wamg Wei", "Wang Wei"]
    rows = [("g", f"m{i}", n, 1, "raw", 0) for i, n in enumerate(names)]
    wanted = best(spark, rows)
    assert all(v == ("m0", {"author": "Wang Wei", "year": "1"}) for v in wanted.values())
    monkeypatch.setattr(survivors, "PART", 2)
    rows += [("g", f"n{i}", f"Wang Wei {i}", 1, "raw", 0) for i in range(30)]
    assert best(spark, rows)["g", "m0"] == ("m0", {"author": "Wang Wei", "year": "1"})


def test_survivors_come_from_the_consensus(spark, monkeypatch):
    rng = random.Random(4)
    rows, wanted = [], {}
    for g in range(30):
        names = rng.sample(["Wang Wei", "Wang Wei of Taiyuan", "Wang Mojie", "Wang W", "Wei"], 4)
        top = rng.randrange(4)
        for i, n in enumerate(names):
            worse = rng.randrange(3)
            rows.append((f"g{g}", f"m{i}", n if i == top or worse != 0 else None, 7, "canonical" if i == top or worse != 1 else "raw", 9 if i == top or worse != 2 else rng.randrange(9)))
        wanted[f"g{g}"] = f"m{top}"
    assert {g: s for (g, _), (s, _) in best(spark, rows).items()} == wanted
    # Without the consensus the survivors are lost.
    monkeypatch.setattr(survivors, "_token_distance", lambda value, consensus: survivors.F.lit(0.0))
    blind = {g: s for (g, _), (s, _) in best(spark, rows).items()}
    assert sum(blind[g] == wanted[g] for g in wanted) < 0.8 * len(wanted)


def test_alignment():
    profile = survivors.progressive([("a b c", 2.0), ("a c", 1.0), ("a b d c", 1.0)])
    assert survivors.consensus(profile) == ["a", "b", "c"]
    assert survivors.distance(list("kitten"), list("sitting")) == 3
    assert survivors.progressive([]) == []


def test_body_groups(spark):
    f, g = "a" * 64, "b" * 64
    rows = [
        ("1", f.upper(), 5, '["3", "x"]'), ("2", f"sha256:{f}", 5, '[{"document_id": "3", "path": "p/4.txt"}, {"docu'), ("3", None, 5, '["6"]'), ("4", "", 5, None),
        ("5", g, 5, '["3", "7"]'), ("6", " ", 5, "[]"), ("7", "", 0, "[]"), ("8", g, 5, "[]"), ("9", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", 5, "[]"),
    ]
    df = spark.createDataFrame(rows, "document_id string, body_fingerprint string, searchable_characters bigint, duplicate_members_json string")
    got = {r.member_id: r.group_id for r in survivors.body_groups(df).collect()}
    assert got == {"1": f, "2": f, "3": f, "5": g, "6": f, "8": g}
