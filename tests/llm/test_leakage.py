"""Leaked passages against a plain search, tiling of reordered passages, blocks of items."""

import random
import re
import time

from tallyforge.llm import leakage
from tallyforge.llm.leakage import leaked, tile


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]


def brute(docs, items, n=13):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    held = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs for g in [grams(t)] for i, h in held if g & h}


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, None) for x in items], "item_id bigint, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leaked(d, i, **kw).collect()}


def corpus(seed=5):
    r = random.Random(seed)
    vocabulary = ["aa", "B7", "cé", "dd", "Ee", "f", "gg", "h9"]
    line = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    items = [(i, line(r.randint(5, 60))) for i in range(20)]
    docs = [(d, line(r.randint(0, 80)) + r.choice(items)[1][: r.randint(0, 150)].upper() + line(r.randint(0, 30))) for d in range(120)]
    return [*docs, (900, None), (901, ""), (902, items[0][1]), (902, items[0][1])], [*items, (50, None), (51, ""), (52, items[1][1]), (52, items[1][1])]


def test_against_brute_force(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(6)
    monkeypatch.setattr(leakage, "BLOCK", 3)
    assert run(spark, docs, items) == brute(docs, items)


def test_tiles_are_longest_first_and_found_in_any_order():
    a, b = list("abcdefghij"), list("fghijXabcde")
    assert sorted(tile(a, b, 3)) == [(0, 6, 5), (5, 0, 5)]
    assert tile(list("abcabc"), list("abc"), 3) == [(0, 0, 3)]
    assert tile([], b, 3) == [] and tile(a, [], 3) == []


def test_coverage_threshold(spark):
    w = [f"w{i}" for i in range(60)]
    item = (1, " ".join(w))
    docs = [(1, " ".join(w[30:] + ["x"] + w[:30])), (2, " ".join(w[:20]))]
    assert run(spark, docs, [item]) == {(1, 1), (2, 1)}
    assert run(spark, docs, [item], least_coverage=0.9) == {(1, 1)}


def test_empty_and_long(spark):
    assert run(spark, [], []) == set() and run(spark, [(1, "a " * 50)], []) == set()
    long = "x " * 200_000 + " ".join(f"w{i}" for i in range(13))
    assert run(spark, [(1, long)], [(1, " ".join(f"W{i}" for i in range(13)))]) == {(1, 1)}


def test_reordered_passages_are_told_by_coverage(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    item = r.sample(words, 60)
    parts = [item[i : i + 8] for i in range(0, 56, 8)]
    r.shuffle(parts)
    filler = lambda: [f"z{r.randint(0, 999)}" for _ in range(4)]
    reordered = " ".join(w for p in parts for w in [*p, *filler()])
    docs = spark.createDataFrame([(1, reordered), (2, " ".join(parts[0] + filler() + parts[1])), (3, " ".join(item)), (4, None), (5, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert {x.doc_id for x in leaked(docs, items).collect()} == {3}  # no thirteen words in a row are left
    found = {x.doc_id: (x.tiles, x.covered) for x in leaked(docs, items, least=6, least_coverage=0.6).collect()}
    assert set(found) == {1, 3} and found[3] == (1, 60) and found[1][1] >= 56 and found[1][0] >= 6


def test_repetitive_texts_take_no_longer():
    a, b = [b"la"] * 20_000, [b"la"] * 1_000
    began = time.time()
    assert tile(a, b, 13) == [(0, 0, 1000)]
    assert tile([b"x", b"y"] * 5_000, [b"y", b"x"] * 2_000 + [b"q"], 13)[0][2] == 4000
    assert time.time() - began < 5


def tiled(a, b, least):
    """Longest unmarked match first, the first of equals, found by trying every pair of places."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ua[i + k] and not ub[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        ua[i : i + k] = ub[j : j + k] = [True] * k
        out.append((i, j, k))


def test_tiles_are_those_of_brute_force():
    r = random.Random(8)
    for _ in range(60):
        a, b = ([bytes([97 + r.randrange(3)]) for _ in range(r.randint(0, 40))] for _ in "ab")
        assert tile(a, b, 4) == tiled(a, b, 4)


def test_many_rows_of_one_item_are_all_searched(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 3)
    items = spark.createDataFrame([(1, f"a{i} " + " ".join(f"k{i}x{j}" for j in range(15))) for i in range(10)] + [(2, "q")], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(f"k{i}x{j}" for j in range(15))) for i in range(10)], "doc_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in leakage.leaked(docs, items).collect()} == {(i, 1) for i in range(10)}
