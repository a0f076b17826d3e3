import datetime as dt
import itertools
import random

import pytest

from quillspark.operators import hierarchy, packed
from quillspark.operators.hierarchy import resolve_hierarchy
from quillspark.operators.packed import automaton, known_whole_values, split_packed, unpack
from quillspark.operators.references import orphan_references

DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


REFS = "table_name string, row_no bigint, field_name string, ref_pos bigint, target string, id string, ref_at timestamp, extra string"
PARENTS = "target string, id string, at timestamp, table_name string"


def orphans(spark, refs, parents):
    r = spark.createDataFrame([("t", n, "f", 0, "work", i, day(d), "x") for n, i, d in refs], REFS)
    p = spark.createDataFrame([("work", i, day(d), "clash") for i, d in parents], PARENTS)
    return {(x.row_no, x.reason) for x in orphan_references(r, p).collect()}


def test_orphans_of_every_spelling(spark):
    parents = [("100", 5), ("101", 5), ("102", 9), ("102", 1), ("0a" * 12, 3), ("word", 2), ("", 1), (None, 1), ("300", None)]
    refs = [(1, "100", 6), (2, " ０１０１.0　", 4), (3, "102", 2), (4, "103", 9), (5, "0A" * 12, 4), (6, "a0" * 12, 4), (7, "word", 1), (8, None, 1), (9, " ", 1), (10, "99", 9), (11, "300", 0), (12, "101", None), (4, "103", 9), (13, "9" * 30, 1)]
    assert orphans(spark, refs, parents) == {(2, "late"), (4, "missing"), (6, "missing"), (7, "late"), (10, "missing"), (13, "missing")}


def test_orphans_without_parents_or_references(spark):
    assert orphans(spark, [(1, "5", 1)], []) == {(1, "missing")}
    assert orphans(spark, [], [("5", 1)]) == set()


def test_orphans_like_brute_force(spark):
    rng = random.Random(4)
    parents = [(str(rng.randrange(2000)), rng.randrange(50)) for _ in range(900)]
    refs = [(n, str(rng.choice([7, rng.randrange(2100)])), rng.randrange(50)) for n in range(1500)]
    first = {}
    for i, d in parents:
        first[i] = min(d, first.get(i, d))
    wanted = {(n, "missing" if i not in first else "late") for n, i, d in refs if i not in first or first[i] > d}
    assert orphans(spark, refs, parents) == wanted


def test_split_protects_quotes_and_brackets():
    assert split_packed('僧;"提刑, 兼轉運" / 儒者(經師、塾師)') == ["僧", "提刑, 兼轉運", "儒者(經師、塾師)"]
    assert split_packed('"小字""湖忠""";　a ') == ['小字"湖忠"', "a"]
    assert split_packed("「a、b」，“c|d”\n e ；；") == ["a、b", "c|d", "e"]
    assert split_packed('a"b;c"d') == ['a"b', 'c"d']
    assert split_packed('"open;b（c、d') == ['"open', "b（c", "d"]
    assert split_packed("") == split_packed(None) == split_packed(" ; ") == split_packed('""') == []
    assert split_packed("x;" * 200_000) == ["x"] * 200_000


def test_dictionary_protects_unquoted_values():
    machine = automaton([(v, ["f"]) for v in ("提刑, 兼轉運", "兼轉運, 僧", "plain")])
    assert split_packed("a, 提刑, 兼轉運,b", machine) == ["a", "提刑, 兼轉運", "b"]
    assert split_packed("a, 提刑, 兼轉運,b", machine, "g") == ["a", "提刑", "兼轉運", "b"]
    assert split_packed("提刑, 兼轉運, 僧", machine) == ["提刑", "兼轉運, 僧"]
    assert split_packed("x提刑, 兼轉運", machine) == ["x提刑", "兼轉運"]
    assert automaton([]) is None


def test_best_cover_like_brute_force():
    import itertools
    import random

    rng = random.Random(8)
    for _ in range(300):
        pieces = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        known = {", ".join(rng.choice("abc") for _ in range(rng.randrange(2, 4))) for _ in range(4)}
        got = split_packed(", ".join(pieces), automaton([(k, ["f"]) for k in known]))
        covers = []
        for cuts in itertools.product((0, 1), repeat=len(pieces) - 1):
            groups = [[pieces[0]]]
            for p, c in zip(pieces[1:], cuts):
                if c:
                    groups.append([p])
                else:
                    groups[-1].append(p)
            cover = [", ".join(g) for g in groups]
            if all(len(g) == 1 or c in known for g, c in zip(groups, cover)):
                covers.append(cover)
        assert got in covers and len(got) == min(map(len, covers))


@pytest.mark.parametrize("part", [200_000, 1])
def test_unpack_with_learned_dictionary(spark, monkeypatch, part):
    monkeypatch.setattr(packed, "PART", part)
    rows = [("t", n, "f", '"a, b"; c; x（d、e）', 1) for n in range(3)] + [("t", 9, "f", "a, b|d", 1), ("t", 10, "f", None, 1), ("t", 11, "f", "", 1), ("t", 12, "f", '"g, h"', 1), ("t", 13, "f", "g, h", 1), ("t", 14, "other", "a, b", 1)]
    rows += [("t", 20 + n, "f", '"k; l"', 1) for n in range(3)] + [("t", 30, "f", "m,k; l ,a, b", 1)]
    fields = spark.createDataFrame(rows, "table_name string, row_no bigint, field_name string, text string, pos int")
    known = known_whole_values(fields)
    assert {(r.value, *r.fields) for r in known.collect()} == {("a, b", "f"), ("x（d、e）", "f"), ("k; l", "f")}
    values = lambda df: {i: [v for _, v in sorted((r.pos, r.value) for r in rows)] for i, rows in itertools.groupby(sorted(df.collect(), key=lambda r: r.row_no), lambda r: r.row_no)}
    got = values(unpack(fields, known))
    assert got == {n: ["a, b", "c", "x（d、e）"] for n in range(3)} | {9: ["a, b", "d"], 12: ["g, h"], 13: ["g", "h"], 14: ["a", "b"]} | {20 + n: ["k; l"] for n in range(3)} | {30: ["m", "k; l", "a, b"]}
    # Without the dictionary the values typed without quotes fall apart.
    assert {n for n, v in values(unpack(fields, known.limit(0))).items() if v != got[n]} == {9, 30}
    assert unpack(fields.limit(0), known.limit(0)).count() == 0


def brute(links):
    out = {}
    for n in links:
        seen, at = [n], links[n]
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        if at in links:
            out[n] = ("", -1, "", 1 if at == n else 2)
        else:
            out[n] = (seen[-1], len(seen) - 1, " > ".join(reversed(seen)), 0)
    # on a cycle exactly if it is reached from itself
    for n in links:
        if out[n][3] == 2:
            at = links[n]
            for _ in links:
                if at == n:
                    out[n] = ("", -1, "", 1)
                    break
                at = links.get(at)
    return out


def resolved(spark, links, tasks):
    rows = [("t", n, p, "x") for n, p in links.items()]
    got = resolve_hierarchy(spark.createDataFrame(rows, "tree string, node string, parent string, depth string"), tasks)
    return {r.node: (r.root, r.depth, r.path, r.on_cycle) for r in got.collect()}


def test_hierarchy_like_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    links = {f"n{i}": f"n{rng.randrange(-40, 300)}" if rng.random() < 0.8 else None for i in range(300)}
    links |= {f"c{i}": f"c{i + 1}" for i in range(90)} | {"s": "s", "hot": None} | {f"h{i}": "hot" for i in range(100)} | {f"k{i}": f"k{(i + 1) % 37}" for i in range(37)}
    wanted = brute(links)
    assert resolved(spark, links, 3) == wanted
    monkeypatch.setattr(hierarchy, "LINKS_PER_TASK", 20)
    assert resolved(spark, links, 6) == wanted


def test_descendants_like_brute_force(spark):
    rng = random.Random(5)
    links = {f"n{i}": f"n{rng.randrange(-10, 80)}" if rng.random() < 0.8 else None for i in range(80)}
    links |= {f"c{i}": f"c{i + 1}" for i in range(21)} | {"a > b": None, "c > d": "a > b", "s": "s", "t": "s"} | {f"k{i}": f"k{(i + 1) % 7}" for i in range(7)} | {"into": "k3"}
    wanted = set()
    for n in links:
        seen, at, far = {}, links[n], 1
        while at in links and at not in seen:
            seen[at], at, far = far, links[at], far + 1
        wanted |= {("t", a, n, d) for a, d in seen.items()}
    above = {a for _, a, _, _ in wanted}
    wanted |= {("t", n, None, None) for n in links if n not in above}
    schema = "tree string, node string, parent string"
    rows = hierarchy.descendant_pairs(spark.createDataFrame([("t", *x) for x in links.items()], schema)).collect()
    assert len(rows) == len(wanted) and {tuple(r) for r in rows} == wanted
    assert ("t", "k0", "k0", 7) in wanted and ("t", "a > b", "c > d", 1) in wanted
    assert hierarchy.descendant_pairs(spark.createDataFrame([], schema)).count() == 0


def test_hierarchy_of_nothing_and_nulls(spark):
    schema = "tree string, node string, parent string"
    assert resolve_hierarchy(spark.createDataFrame([], schema), 2).count() == 0
    rows = [("t", None, "a"), ("t", "a", None), ("t", "a", None), ("u", "b", "a"), ("t", "b", "a")]
    got = {(r.tree, r.node, r.root, r.depth) for r in resolve_hierarchy(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {("t", "a", "a", 0), ("u", "b", "b", 0), ("t", "b", "a", 1)}


def test_nested_json():
    assert hierarchy.flatten_nested('[{"id":"a","children":[{"id":"b","children":null},{"id":"c","children":[]}]}]', "r/") == [("r/a", None), ("r/b", "r/a"), ("r/c", "r/a")]
    assert hierarchy.flatten_nested("broken", "") == hierarchy.flatten_nested(None, "") == hierarchy.flatten_nested("[]", "") == []
    assert packed.unquote(" x ") == "x"
