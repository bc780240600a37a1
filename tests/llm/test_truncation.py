"""Texts cut off by limits, in transfer, or shown by a copy; whole texts that look alike."""

import random

from tallyforge.llm.truncation import aligned, describe, judged_texts, kind_of, sketches, truncation_by_source


def function(r, n):
    name = lambda: r.choice("abcdefgh") + r.choice("xyzw") * r.randint(1, 9)
    return f"int {name()}(int {name()}) {{\n" + "".join(f"    int {name()} = {name()}({r.randint(0, 999)}, \"{name()}\");\n" for _ in range(n)) + f"    return {name()};\n}}\n"


def corpus():
    r = random.Random(11)
    whole = [(i, "\n".join(function(r, r.randint(3, 9)) for _ in range(r.randint(2, 6))), r.choice(["a", "b"])) for i in range(400)]
    whole = [(i, t.rstrip("\n") if i % 4 == 0 else t, s) for i, t, s in whole]
    text = lambda: "\n".join(function(r, r.randint(3, 14)) for _ in range(9))
    limit = [(1000 + i, text()[:1000], "a") for i in range(40)]
    transfer = []
    while len(transfer) < 12:
        t = text()
        t = t[: r.randint(300, len(t) - 20)]
        if t[-1].isalnum() and t.count("{") > t.count("}"):
            transfer.append((2000 + len(transfer), t, "b"))
    return whole, limit, transfer


def run(spark, rows):
    return judged_texts(spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, text string, source string, reason string"))


def test_limits_and_transfers(spark):
    whole, limit, transfer = corpus()
    rest = [(5000, None, "a"), (5001, "", None), (5002, "ok.\n", None), whole[0], whole[0]]
    judged = run(spark, whole + limit + transfer + rest)
    found = {r.doc_id: r.reason for r in judged.filter("truncated").collect()}
    cut = {x[0] for x in limit if not x[1].endswith("\n")} | {x[0] for x in transfer}
    sure = {x[0] for x in transfer} | {x[0] for x in limit if x[0] in cut and not x[1].endswith("}")}
    assert sure <= set(found), sure - set(found)
    assert set(found) - cut <= {x[0] for x in limit}
    assert judged.count() == len(whole) + len(limit) + len(transfer) + 3
    share = {r.source: r for r in truncation_by_source(judged).collect()}
    assert share["b"].truncated == len(transfer) and share["a"].texts > 200


def test_a_longer_copy_shows_what_was_lost(spark):
    r = random.Random(2)
    words = [f"{r.choice('abcdefgh')}{i}" for i in range(400)]
    full = " ".join(words[:200]) + " " + " ".join(words[200:]) + "."
    rows = [(1, full, "s"), (2, full[: full.index(words[150]) - 1], "s")] + [(10 + i, " ".join(r.choices(words, k=120)), "s") for i in range(60)]
    assert {r.doc_id: r.reason for r in run(spark, rows).filter("truncated").collect()} == {2: "copy"}


def test_every_longer_text_of_a_bucket_is_tried(spark):
    r = random.Random(2)
    words = [f"{r.choice('abcdefgh')}{i}" for i in range(600)]
    full = " ".join(words[:200]) + "."
    forks = [(100 + i, " ".join(words[:128] + r.choices(words[300:], k=100 + i)) + ".", "s") for i in range(12)]
    rows = [(1, full, "s"), (2, full[: full.index(words[150]) - 1], "s"), *forks] + [(10 + i, " ".join(r.choices(words, k=120)), "s") for i in range(60)]
    assert {r.doc_id: r.reason for r in run(spark, rows).filter("truncated").collect()} == {2: "copy"}


def test_empty_and_long(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, None, None), (2, "", "s")]).filter("truncated").count() == 0
    assert run(spark, [(1, "int a() {\n" + "x();\n" * 100_000 + "}\n", "s")]).count() == 1


def test_marks():
    assert describe('f("abc [...]')[2] == "[...]" and describe("one two…")[2] == "…" and describe("one two…\n")[2] == ""


def test_sketches_of_a_prefix_meet_those_of_the_whole():
    text = " ".join(f"w{i}" for i in range(100)).encode()
    buckets, per, words = sketches([text, text[:190], b"", b"a b"])
    assert words.tolist() == [100, 50, 0, 2] and per[2] == per[3] == 0
    assert buckets[: per[1]].tolist() == buckets[per[0] : per[0] + per[1]].tolist()


def test_copies_are_aligned_where_the_text_ends():
    words = [f"w{i}x" for i in range(300)]
    full = "".join(w + (" " if i % 9 else ";\n    ") for i, w in enumerate(words))
    text = full[: full.index(words[199]) + 2]
    assert aligned(text, full) == "line"
    assert aligned(text.replace(words[196], "renamed"), full) == "line"
    assert aligned(text.replace("\n    ", "\r\n\t"), full) == "line"
    assert aligned(full[: full.index(words[199]) - 5], full) == "text"
    assert aligned(full[: full.index(words[190])] + "and so it ends quite otherwise than there, with a word of its own.", full) is None
    assert aligned(full, full) == "same" and aligned(full + " more", full) is None
    # a tail that recurs is judged where the text ends, not at its first place
    block = " ".join(f"same{i}" for i in range(8))
    twice = " ".join(words[:120]) + f" {block} " + " ".join(words[120:160]) + f" {block}"
    assert aligned(twice, twice + " and on") == "line"


def test_very_long_texts_are_aligned():
    full = " ".join(f"w{i * 7919 % 100_003}" for i in range(100_000))
    assert aligned(full[:500_000], full) == "line"
    assert aligned("la " * 50_000 + "lu", "la " * 50_000 + "lu la") == "line"


def test_the_kind_is_decided_over_the_whole_text():
    licence = "".join(f"Clause {i} of a licence that is long and has no code in it\n" for i in range(100))
    assert len(licence) > 4000 and kind_of(licence) == "prose"
    assert kind_of(licence + "int a() {\n    f(1);\n") == "braces"
    assert describe(licence + "int a() {\n    f(1);\n")[1].split("|")[2] == "1"
    assert kind_of("\n" * 1_000_000 + "x") == "prose"


def made_copies(r, n):
    """Files, cuts of them at any place, and the files again with words renamed: (rows, ids of cuts by brute force)."""
    rows, cuts = [], []
    for i in range(n):
        words = [f"{r.choice('abcdefgh')}{r.randint(0, 99999)}" for _ in range(r.randint(60, 500))]
        full = "".join(w + r.choice([" ", " ", " ", "; ", "\n"]) for w in words) + "end.\n"
        edited = list(words)
        for _ in range(len(words) // 100):
            edited[r.randrange(len(words))] = f"zz{r.randint(0, 99999)}"
        rows.append((i, "".join(w + " " for w in edited[:-1]) + "last.\n" if i % 2 else full, "s"))
        at = r.randint(len(full) // 3, len(full) - 30)
        cuts.append((10_000 + i, full[:at], "s"))
    return rows, cuts


def test_banding_finds_the_copies_that_brute_force_finds(spark):
    rows, cuts = made_copies(random.Random(5), 150)
    spaced = [(i, " ".join(t.split()), s) for i, t, s in rows]
    asked = [(i, " ".join(t.split()), s) for i, t, s in cuts]
    # brute force: every cut against every file, by the alignment alone
    truth = {c[0] for c in asked if any(aligned(c[1], w[1]) == "line" for w in spaced)}
    assert len(truth) > 120
    found = {r.doc_id for r in run(spark, spaced + asked).filter("reason = 'copy'").collect()}
    assert len(found & truth) >= 0.95 * len(truth) and found <= truth


def test_copies_decide_before_endings(spark):
    r = random.Random(9)
    text = "\n".join(function(r, 12) for _ in range(6))
    place = text.index(";", len(text) * 2 // 3) - 4  # inside a statement, with a bracket open: its ending alone would tell
    twins = [(2, text[:place], "s"), (3, text[:place].replace(function(r, 1), "") + " ", "s")]
    rest = [(100 + i, "\n".join(function(r, r.randint(3, 9)) for _ in range(4)), "s") for i in range(80)]
    verdicts = {x.doc_id: x.reason for x in run(spark, [(1, text, "s"), *twins, *rest]).filter("truncated").collect()}
    assert verdicts == {2: "copy", 3: "copy"}


def test_texts_of_other_scripts_have_near_copies(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("абвгдежзик") for _ in range(r.randint(3, 9)))
    text = " ".join(word() for _ in range(200)) + ".\n"
    han = "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(300)) + "。\n"
    rows = [(1, text, "s"), (2, text[: len(text) // 2 + 1], "s"), (3, han, "s"), (4, han[:200], "s")]
    rest = [(100 + i, " ".join(word() for _ in range(40)) + ".\n", "s") for i in range(60)]
    assert {x.doc_id for x in run(spark, rows + rest).filter("reason = 'copy'").collect()} == {2, 4}
