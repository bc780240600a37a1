"""Snapshot difference against a plain dictionary walk, and its edge cases."""

import datetime as dt
import random
import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from tallyforge.operators.snapshots import snapshot_changes, uncomposed_class

SCHEMA = "source_table string, root_id bigint, snapshot_no int, name string, stamp bigint, size bigint, crc string, delivered_at timestamp_ntz"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def run(spark, rows, extra=None):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra or ():
        df = df.selectExpr("*", f"'x' as {c}")
    return {tuple(r) for r in snapshot_changes(df).collect()}


def seconds(v):
    if v is None or v == -(2**63):
        return None
    for limit, per, epoch in ((10**11, 1, 0), (10**14, 10**3, 0), (10**17, 10**6, 0), (25 * 10**16, 10**7, 11644473600), (10**18, 10**7, 62135596800)):
        if abs(v) < limit:
            return v // per - epoch
    return v // 10**9


def brute(rows):
    by = {}
    for src, root, snap, name, stamp, size, crc, d in sorted((r for r in rows if r[3] and r[2] is not None), key=lambda r: r[7]):
        n = unicodedata.normalize("NFC", name.replace("\\", "/"))
        by.setdefault((src, root), {}).setdefault(snap, {})[n] = (seconds(stamp), size, crc and crc.lower())
    out = set()
    for (src, root), snaps in by.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            for n in snaps[a].keys() | snaps[b].keys():
                x, y = snaps[a].get(n), snaps[b].get(n)
                change = "added" if x is None else "removed" if y is None else "changed" if any(p is not None and q is not None and p != q for p, q in zip(x, y)) else None
                if change:
                    out.add((src, root, b, n, change))
    return out


def test_random_against_brute_force(spark):
    r = random.Random(7)
    rows = []
    for i in range(600):
        base = r.choice(["a/b", "a\\b", "é", "é", "c", "d", "한", "한"])
        stamp = r.choice([1600000000, 1600000000000, 1600000001, None, 637355936000000000, 132444736000000000, -5])
        rows.append(("t", r.choice([7, 7, 7, 8, 9, None]), r.randint(1, 5), r.choice([base, base, base, None, ""]), stamp, r.choice([1, 2, None]), r.choice(["00AA00bb", "00aa00BB", "1", None]), at(i)))
    want = {(*x[:3], x[3], x[4]) for x in brute([(*x[:6], x[6] and x[6].rjust(8, "0"), x[7]) for x in rows])}
    assert run(spark, rows, ["root_key", "before", "n"]) == want


def test_late_row_of_a_file_holds_and_skipped_snapshots_are_skipped(spark):
    rows = [("t", 1, 1, "a", 10, 1, None, at(1)), ("t", 1, 3, "a", 10, 2, None, at(2)), ("t", 1, 3, "a", 10, 1, None, at(3))]
    assert run(spark, rows) == set()
    assert run(spark, rows[:2]) == {("t", 1, 3, "a", "changed")}


def test_empty_and_repeats(spark):
    assert run(spark, []) == set()
    row = ("t", 1, 1, "a", 10, 1, "aa", at(1))
    assert run(spark, [row] * 5) == set()


def test_long_names_and_ties(spark):
    long = "x" * 100_000
    rows = [("t", 1, 1, long, 1, 1, None, at(1)), ("t", 1, 2, "y", 1, 1, None, at(1)), ("t", 1, 2, "y", 2, 1, None, at(1))]
    assert run(spark, rows) == {("t", 1, 2, long, "removed"), ("t", 1, 2, "y", "added")}


SPANS = [tuple(int(x[3:-1], 16) for x in part.split("-")) for part in uncomposed_class()[1:-1].replace("}\\x", "}|\\x").split("|")]


@given(st.text())
def test_class_covers_all_that_is_not_composed(text):
    if unicodedata.normalize("NFC", text) != text:
        assert any(s[0] <= ord(c) <= s[-1] for s in SPANS for c in text)
