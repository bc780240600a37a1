"""Repair planning against a plain replay, ranking of hot keys, statistics, reports."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge import session
from tallyforge.operators import report, stats
from tallyforge.plans import fixes
from tallyforge.schemas import DAT_STATUS, GOT_STATUS

SCHEMA = "node_id string, ord bigint, archive string, game string, name string, size bigint, crc string, sha1 string, md5 string, dat_status string, got_status string, selected boolean, locked boolean, deep boolean, file_type string, physical string, alt_size bigint, alt_crc string, alt_sha1 string, alt_md5 string, header_type string, header_required boolean, from_header boolean"
BARE = {"alt_size": None, "alt_crc": None, "alt_sha1": None, "alt_md5": None, "header_type": None, "header_required": False, "from_header": False}


def node(i, content, dat, got, **kw):
    h = f"{content:08x}"
    return {"node_id": f"n{i:04d}", "ord": i, "archive": f"a{i % 5}", "game": f"g{i % 7}", "name": f"f{i}", "size": content, "crc": h, "sha1": h * 5, "md5": h * 4, "dat_status": dat, "got_status": got, "selected": True, "locked": False, "deep": True, "file_type": "File", "physical": f"p{i}"} | BARE | kw


def frame(spark, rows):
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


RANK = {"InDatCollect": 0, "InDatMIA": 1, "InDatMerged": 2, "InDatNoDump": 2, "InToSort": 3, "NotInDat": 4}


def fits(t, s):
    if t["header_type"] and s["header_type"] and t["header_type"] != s["header_type"] or t["header_required"] and not (s["header_type"] and s["from_header"]):
        return False
    return not s["deep"] or all(not t[x] or not s[c] or t[x] in (s[c], s["alt_" + c]) for c in ("sha1", "md5") for x in (c, "alt_" + c))


def replay(rows):
    held = [r for r in rows if r["got_status"] in ("Got", "Corrupt")]
    stays = [r["physical"] for r in held if r["got_status"] == "Got" and r["dat_status"] in ("InDatCollect", "InDatMIA")]
    backed = lambda s: stays.count(s["physical"]) > (s["got_status"] == "Got" and s["dat_status"] in ("InDatCollect", "InDatMIA"))
    once = lambda s: not s["locked"] and s["dat_status"] not in ("InDatCollect", "InDatMIA")
    spent, out = set(), {}
    for t in rows:
        if t["got_status"] != "NotGot" or t["dat_status"] not in ("InDatCollect", "InDatMIA"):
            continue
        bare = t["size"] if t["alt_size"] is None else t["alt_size"]
        for lane in ("crc", "sha1", "md5"):
            asked = {(t["size"], t[lane]), (bare, t[lane]), (bare, t["alt_" + lane])}
            holds = lambda s: {(s["size"], s[lane]), (s["size"] if s["alt_size"] is None else s["alt_size"], s["alt_" + lane])}
            fit = [s for s in held if any(k[1] for k in asked & holds(s)) and s["node_id"] not in spent and fits(t, s)]
            if fit:
                best = min(fit, key=lambda s: (RANK[s["dat_status"]], backed(s), s["got_status"] == "Corrupt", not once(s), s["ord"]))
                out[t["node_id"]] = best["node_id"]
                if once(best):
                    spent.add(best["node_id"])
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_against_replay(spark, seed):
    r = random.Random(seed)
    rows = [node(i, r.randint(1, 25), r.choice(DAT_STATUS), r.choice(GOT_STATUS), locked=r.random() < 0.2, deep=r.random() < 0.7) for i in range(300)]
    for x in rows:
        if r.random() < 0.05:  # equal crc and size, other content
            x["sha1"] = "9" * 40
        if r.random() < 0.1:
            x["physical"] = "p0"
        if x["got_status"] in ("Got", "Corrupt") and r.random() < 0.2:  # held with a header in front of what the catalog states
            h = f"{x['size'] + 1000:08x}"
            x |= {"alt_size": x["size"], "alt_crc": x["crc"], "alt_sha1": x["sha1"], "alt_md5": x["md5"], "size": x["size"] + 16, "crc": h, "sha1": h * 5, "md5": h * 4, "header_type": r.choice(["NES", "LYNX"]), "from_header": r.random() < 0.7}
        elif x["got_status"] == "NotGot" and r.random() < 0.2:
            x |= {"header_type": "NES", "header_required": r.random() < 0.5}
        if r.random() < 0.05:
            x[r.choice(["crc", "sha1", "md5"])] = None
    held, missing = fixes.partitions(frame(spark, rows))
    got = {x.missing_id: x.source_id for x in fixes.assign_sources(missing.filter("dat_status in ('InDatCollect', 'InDatMIA')"), held).collect()}
    assert got == replay(rows)


def test_spent_sources_serve_once(spark):
    rows = [node(1, 5, "InDatCollect", "NotGot"), node(2, 5, "InDatCollect", "NotGot"), node(3, 5, "InToSort", "Got")]
    plan, _ = fixes.plan_fixes(frame(spark, rows))
    assert {x.node_id: x.plan_status for x in plan.collect()} == {"n0001": "CanBeFixed", "n0002": "Missing", "n0003": "NeededForFix"}
    rows[2]["locked"] = True
    plan, _ = fixes.plan_fixes(frame(spark, rows))
    assert [x.plan_status for x in plan.orderBy("node_id").collect()] == ["CanBeFixed", "CanBeFixed", "NeededForFix"]


def test_empty_plan(spark):
    plan, pairs = fixes.plan_fixes(frame(spark, []))
    assert plan.count() == 0 and fixes.plan_actions(plan, pairs).count() == 0


def test_rows_without_hashes_stay_missing(spark):
    rows = [node(1, 0, "InDatCollect", "NotGot", crc=None, sha1=None, md5=None, size=None), node(2, 0, "InToSort", "Got", crc=None, sha1=None, md5=None)]
    plan, _ = fixes.plan_fixes(frame(spark, rows))
    assert {x.plan_status for x in plan.collect()} == {"Missing", "InToSort"}


def test_fill_in_by_other_lane(spark):
    rows = [node(1, 5, "InDatCollect", "NotGot", crc=None), node(2, 5, "InToSort", "Got"), node(3, 5, "InDatCollect", "NotGot", crc=None, sha1=None)]
    held, missing = fixes.partitions(frame(spark, rows))
    assert {(x.missing_id, x.source_id) for x in fixes.assign_sources(missing, held).collect()} == {("n0001", "n0002")}


def test_rank_over_ranges_equals_window(spark, monkeypatch):
    monkeypatch.setattr(session, "WINDOW_ROWS", 10)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("k"), F.hash("id").alias("o"), "id")
    got = session.spread_rank(df, ["k"], ["o", "id"])
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.o, r.id)):
        want.setdefault(r.k, []).append(r.id)
    assert {(r.k, r["rank"], r.id) for r in got.collect()} == {(k, i + 1, x) for k, v in want.items() for i, x in enumerate(v)}


def test_salted_join_equals_broadcast(spark):
    left = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    one, other = (sorted((r.k, r.id, r.v or "") for r in session.sized_join(left, right, ["k"], "left", limit=n).collect()) for n in (100, 1))
    assert one == other and len(one) == 500


def test_children_sum_to_the_parent(spark):
    r = random.Random(4)
    rows = [(["x", r.choice("ab"), r.choice("cd")], r.choice(["Correct", "Missing", "CanBeFixed", "Corrupt", "Unknown"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "path array<string>, status string")
    by = {x.directory: x for x in stats.stats_by_directory(df).collect()}
    total = stats.stats(df).first()
    assert by["x"].asDict() == {"directory": "x"} | total.asDict()
    assert by["x"].missing == by["x/a"].missing + by["x/b"].missing
    assert stats.stats(df.limit(0)).first().total == 0


@pytest.mark.parametrize("dat,got,kind,want", [("InDatCollect", "Got", "File", "Correct"), ("InDatMIA", "Got", "Dir", "UnScanned"), ("NotInDat", "Got", "Zip", "DirUnknown"), ("InDatMerged", "NotGot", "FileZip", "NotCollected"), ("InToSort", "Corrupt", "SevenZip", "DirCorrupt"), ("InDatCollect", "FileLocked", "File", "UnScanned"), (None, None, None, "UnScanned")])
def test_matrix(spark, dat, got, kind, want):
    df = spark.createDataFrame([(dat, got, kind)], "d string, g string, f string")
    assert df.select(stats.base_status(F.col("d"), F.col("g"), F.col("f"))).first()[0] == want


def test_report_box(spark):
    df = spark.createDataFrame([("c", "g", "long name", "Delete"), ("c", "game", None, "Rename")], "dat string, game string, name string, plan_status string")
    lines = [r.line for r in report.boxed_report(df, "dat").orderBy("part", "k1").collect()]
    assert len({len(x) for x in lines}) == 1 and lines[0] == lines[-1] and len(lines) == 4


def test_headers(spark):
    """Content with a header serves what is stated without it; another type doesn't, nor content without the header that is demanded."""
    held = node(3, 5, "InToSort", "Got", size=21, crc="f" * 8, sha1="f" * 40, md5="f" * 32, alt_size=5, alt_crc=f"{5:08x}", alt_sha1=f"{5:08x}" * 5, alt_md5=f"{5:08x}" * 4, header_type="NES", from_header=True)
    status = lambda *rows: [x.plan_status for x in fixes.plan_fixes(frame(spark, list(rows)))[0].orderBy("node_id").collect()]
    assert status(node(1, 5, "InDatCollect", "NotGot"), held) == ["CanBeFixed", "NeededForFix"]
    assert status(node(1, 5, "InDatCollect", "NotGot", header_type="LYNX"), held) == ["Missing", "InToSort"]
    assert status(node(1, 5, "InDatCollect", "NotGot", header_type="NES", header_required=True), held) == ["CanBeFixed", "NeededForFix"]
    assert status(node(1, 5, "InDatCollect", "NotGot", header_type="NES", header_required=True), held | {"from_header": False}) == ["Missing", "InToSort"]
    assert status(node(1, 5, "InDatCollect", "NotGot", header_required=True), node(2, 5, "InToSort", "Got")) == ["Missing", "InToSort"]


def test_renames_pending_and_backing(spark):
    status = lambda *rows: [x.plan_status for x in fixes.plan_fixes(frame(spark, list(rows)))[0].orderBy("node_id").collect()]
    same = {"game": "g"}
    assert status(node(1, 5, "InDatCollect", "NotGot", **same), node(2, 5, "InToSort", "Got", **same)) == ["CanBeFixed", "Rename"]
    assert status(node(1, 5, "InDatCollect", "NotGot"), node(2, 5, "InToSort", "Got"), node(3, 5, "InToSort", "Got")) == ["CanBeFixed", "NeededForFix", "Delete"]
    assert status(node(1, 5, "InDatCollect", "Got", physical="p"), node(2, 6, "InDatMerged", "Got", physical="p"), node(3, 7, "InDatMerged", "Got")) == ["Correct", "NotCollected", "UnNeeded"]
    # a source that backs a row that stays comes after one that doesn't
    plan, pairs = fixes.plan_fixes(frame(spark, [node(1, 5, "InDatCollect", "NotGot"), node(2, 5, "InToSort", "Got", physical="q"), node(3, 5, "InToSort", "Got"), node(4, 9, "InDatCollect", "Got", physical="q")]))
    assert [(x.missing_id, x.source_id) for x in pairs.collect()] == [("n0001", "n0003")]
