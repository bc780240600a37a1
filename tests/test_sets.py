"""Clone graphs, merged and split sets, duplicates: against walks in plain Python over random sets with unknown facts."""

import random

import pytest

from tallyforge.operators import transforms
from tallyforge.session import carry_last, components

MEMBER = "game string, ord bigint, name string, size bigint, crc string, sha1 string, sha256 string, md5 string, merge string, status string, is_disk boolean, dat_status string"
GAME = "game string, ord bigint, clone_of string, rom_of string, is_bios string, device_ref array<string>"
FACTS = slice(3, 8)


def random_sets(seed, games=14, each=7):
    r = random.Random(seed)
    sets, rows = [], []
    for g in range(games):
        name = lambda k: f"g{k}" if 0 <= k < games + 1 else None
        rom_of = r.choice([None, name(g), name(r.randrange(games + 1)), "", None])
        sets.append((f"g{g}", g, r.choice([None, name(r.randrange(games + 1))]), rom_of, r.choice([None, None, "yes"]), [f"g{r.randrange(games + 1)}" for _ in range(r.randrange(3))]))
        for i in range(r.randint(1, each)):
            c = r.randrange(6)
            maybe = lambda v: r.choice([v, v, None])
            file = r.choice(["a.bin", "b.bin", "x/a.bin", "x/b.bin", "y/a.bin", "c.bin"])
            rows.append((f"g{g}", i, file, maybe(c), maybe(f"c{c // 2}"), maybe(f"s{c}"), maybe(f"t{c}"), maybe(f"m{c}"), r.choice([None, "", "a.bin"]), r.choice([None, None, "nodump"]), r.random() < 0.2, None))
    return sets, rows


def chain_of(game, sets, include_bios=True):
    by = {s[0]: s for s in sets}
    _, _, clone, rom, _, _ = by[game]
    at = rom if rom and rom != game else clone
    out = []
    if not at or at == game:
        return out
    while at in by and at not in out and (include_bios or by[at][4] != "yes"):
        out.append(at)
        onward = by[at][3] if by[at][3] is not None else by[at][2]
        if not onward or onward == at:
            break
        at = onward
    return out


def same(a, b):
    return all(x is None or y is None or x == y for x, y in zip(a[FACTS], b[FACTS], strict=True)) and a[10] == b[10]


@pytest.mark.parametrize("seed", range(3))
def test_sets_as_walked(spark, seed):
    sets, rows = random_sets(seed)
    games, members = spark.createDataFrame(sets, GAME), spark.createDataFrame(rows, MEMBER)
    chains = {s[0]: chain_of(s[0], sets) for s in sets}
    got = {}
    for x in sorted(transforms.parent_chain(games).collect(), key=lambda x: (x.game, x.depth)):
        got.setdefault(x.game, []).append(x.ancestor)
    assert got == {k: v for k, v in chains.items() if v}
    short = {(x.game, x.ancestor) for x in transforms.parent_chain(games, include_bios=False).collect()}
    assert short == {(s[0], a) for s in sets for a in chain_of(s[0], sets, False)}
    inside = lambda m, where: any(same(m, p) for p in rows if p[0] in where)
    dumped = lambda m: m[9] != "nodump"
    assert {(x.game, x.ord) for x in transforms.split_set(games, members).filter("dat_status = 'InDatMerged'").collect()} == {(m[0], m[1]) for m in rows if dumped(m) and inside(m, chains[m[0]])}
    bios = {s[0] for s in sets if s[4] == "yes"}
    want = []
    for m in rows:
        up = chains[m[0]]
        if dumped(m) and inside(m, [a for a in up if a in bios]):
            continue
        tops = [a for a in up if a not in bios]
        want.append((tops[-1] if tops else m[0], f"{m[0]}/{m[2]}" if tops and not m[10] else m[2]))
    assert sorted((x.game, x.name) for x in transforms.merge_set(games, members, with_game_name=True).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_split_set_in_small_parts(spark, monkeypatch, seed):
    """Ways spread over tasks and packs that come one by one; ords of any size, some unknown, which count for others only."""
    monkeypatch.setattr(transforms, "WAY_SETS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    ords = [-70, -1, 0, 63, 64, 70_000, 1 << 40, None]
    sets, rows = random_sets(seed + 20, each=8)
    rows = [(m[0], ords[m[1]], *m[2:]) for m in rows]
    try:
        out = transforms.split_set(spark.createDataFrame(sets, GAME), spark.createDataFrame(rows, MEMBER)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    chains = {s[0]: chain_of(s[0], sets) for s in sets}
    want = {(m[0], m[1]) for m in rows if m[9] != "nodump" and m[1] is not None and any(same(m, p) for p in rows if p[0] in chains[m[0]])}
    assert len(out) == len(rows) and {(x.game, x.ord) for x in out if x.dat_status == "InDatMerged"} == want


def test_split_set_moves_each_member_a_few_times(spark):
    """No key is written for each ancestor and pattern of known facts."""
    sets = [(f"g{i}", i, f"g{i // 10 * 10}" if i % 10 else None, None if i % 10 else "g0", "yes" if i == 0 else None, []) for i in range(100)]
    known = lambda i, bit, v: v if i >> bit & 1 else None
    rows = [(f"g{g}", i, "a", known(i, 0, i), known(i, 1, f"c{g}-{i}"), known(i, 2, f"s{g}-{i}"), None, known(i, 3, f"m{g}-{i}"), None, None, False, None) for g in range(100) for i in range(1, 33)]
    games, members = spark.createDataFrame(sets, GAME), spark.createDataFrame(rows, MEMBER)
    context = spark.sparkContext
    context.setJobGroup("split_set", "")
    try:
        transforms.split_set(games, members).write.format("noop").mode("overwrite").save()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup("split_set") for i in tracker.getJobInfo(job).stageIds}
    assert 0 < sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages) < 4 * len(rows)


@pytest.mark.parametrize("seed", range(2))
def test_devices_as_walked(spark, seed):
    sets, rows = random_sets(seed + 10)
    by = {s[0]: s for s in sets}
    want = [(m[0], m[2], m[5]) for m in rows]
    for s in sets:
        reached, todo = [], list(s[5])
        while todo:
            d = todo.pop(0)
            if d in by and d not in reached:
                reached.append(d)
                todo += by[d][5]
        have = {(m[2], m[5]) for m in rows if m[0] == s[0] and m[5] is not None}
        want += [(s[0], m[2], m[5]) for d in reached for m in rows if m[0] == d and (m[2], m[5]) not in have]
    key = lambda x: tuple(v or "" for v in x)
    got = [(x.game, x.name, x.sha1) for x in transforms.non_merge_set(spark.createDataFrame(sets, GAME), spark.createDataFrame(rows, MEMBER)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def walked_duplicates(rows, test_name, with_merge):
    """Ords that stay, pair by pair from the front, starting over after each removal."""
    alive = sorted(rows, key=lambda m: m[1])

    def loser():
        for i, a in enumerate(alive):
            for b in alive[i + 1 :]:
                known = [(x, y) for x, y in zip(a[4:8], b[4:8], strict=True) if x is not None and y is not None]
                evidence = any(a[k] is not None and b[k] is not None for k in (4, 5, 7))
                if test_name and a[2] != b[2] or any(x != y for x, y in known) or not evidence:
                    continue
                deep = "/" in a[2], "/" in b[2]
                if deep == (True, False):
                    return a
                if deep == (False, True):
                    return b
                if deep == (True, True):
                    return b if a[2].split("/")[0] != b[2].split("/")[0] or transforms.alphanumeric(a[2], b[2]) < 0 else a
                if a[2] == b[2] or with_merge and a[2] == (b[8] or ""):
                    return b
        return None

    while (gone := loser()) is not None:
        alive.remove(gone)
    return {m[1] for m in alive}


@pytest.mark.parametrize("seed,test_name,with_merge", [(1, False, False), (2, False, True), (3, True, False), (4, False, False)])
def test_duplicates_as_walked(spark, seed, test_name, with_merge):
    _, rows = random_sets(seed, games=30, each=12)
    want = {(g, o) for g in {m[0] for m in rows} for o in walked_duplicates([m for m in rows if m[0] == g], test_name, with_merge)}
    got = {(x.game, x.ord) for x in transforms.remove_duplicates(spark.createDataFrame(rows, MEMBER), test_name, with_merge).collect()}
    assert got == want


def test_edges_of_sets(spark):
    games, members = spark.createDataFrame([], GAME), spark.createDataFrame([], MEMBER)
    for out in (transforms.split_set(games, members), transforms.merge_set(games, members), transforms.non_merge_set(games, members), transforms.remove_duplicates(members), transforms.device_closure(games), transforms.parent_chain(games)):
        assert out.count() == 0


def test_categories_and_ids(spark):
    c = spark.createDataFrame([(1, "g", [" Arcade "]), (2, "g", ["", "x"]), (3, "g", ["b", "A"]), (4, "g", []), (5, "g", None), (6, "g", [" "])], "ord int, game string, category array<string>")
    assert [r.game for r in transforms.add_category(c, ["a", "B"]).orderBy("ord").collect()] == ["Arcade/g", "g", "a/g", "g", "g", "g"]
    ids = spark.createDataFrame([(1, "d", "x", None), (2, "d", "y", "7"), (3, "d", "z", None), (4, "e", "w", None)], "ord int, d string, game string, id string")
    sets, inside = transforms.add_id_numbers(ids, ["d"], spark.createDataFrame([("z", "f")], "game string, name string"))
    assert [r.game for r in sets.orderBy("ord").collect()] == [" - x", "7 - y", "7 - z", " - w"] and [tuple(r) for r in inside.collect()] == [("7 - z", "7 - f")]


def test_names_of_types(spark):
    df = spark.createDataFrame([("g", 1, "a.b", "Dir"), ("g", 2, "A.b", "Dir"), ("g", 3, "a.b", "File"), ("g", 4, "d/.x", "File"), ("g", 5, "d/.x", "File"), ("g", 6, "a.b", "File")], "game string, ord int, name string, file_type string")
    assert [r.name for r in transforms.fix_duplicate_names(df).orderBy("ord").collect()] == ["a.b_0", "A.b", "a.b", "d/.x", "d/.x_0", "a_0.b"]


def test_hot_keys_are_spread(spark, monkeypatch):
    import tallyforge.session as session

    monkeypatch.setattr(session, "WINDOW_ROWS", 10)
    rows = [("k", i, f"v{i}" if i % 7 == 3 else None) for i in range(200)] + [("j", 5, None)]
    got = {(r.k, r.o): r.last for r in carry_last(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], ["o"], "v", "last").collect()}
    assert all(got["k", i] == (None if i < 3 else f"v{(i - 3) // 7 * 7 + 3}") for i in range(200)) and got["j", 5] is None


def test_components(spark):
    links = spark.createDataFrame([(i, f"{i // 2}") for i in range(40)] + [(i, f"x{(i + 1) // 2}") for i in range(20)] + [(99, "alone"), (None, "alone"), (98, None)], "id bigint, key string")
    got = {r.id: r.component for r in components(links, "id", "key").collect()}
    assert {got[i] for i in range(20)} == {0} and got[21] == 20 and got[99] == 99 and 98 not in got


def test_hot_keys_of_a_join_are_split_off(spark):
    from tallyforge.session import split_join

    left = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else cast(id as string) end as k", "'' as z")
    right = spark.createDataFrame([("hot", "", 1), ("7", "", 2), ("8", "x", 3)], "k string, z string, v int")
    want = {r.id: r.v for r in left.join(right, ["k", "z"], "left").collect()}
    got = split_join(left, right, ["k", "z"], limit=0)
    assert got.columns == ["id", "k", "z", "v"] and {r.id: r.v for r in got.collect()} == want and got.count() == 30_000


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is materialised, with no side small enough to be broadcast."""
    import tallyforge.session as session

    kept, cut = [], session.cut

    def noted(df):
        kept.append(planned(df))
        return cut(df)

    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    for m in (session, transforms):
        monkeypatch.setattr(m, "cut", noted)
    return kept


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("include_bios", [True, False])
def test_a_chain_is_never_broadcast_by_estimate(spark, plans, include_bios):
    sets, _ = random_sets(1)
    plans.append(planned(transforms.parent_chain(spark.createDataFrame(sets, GAME), include_bios)))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_devices_are_never_broadcast_by_estimate(spark, plans):
    sets, _ = random_sets(11)
    plans.append(planned(transforms.device_closure(spark.createDataFrame(sets, GAME))))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("transform", ["merge_set", "merge_set_named", "split_set", "non_merge_set"])
def test_sets_are_never_broadcast_by_estimate(spark, plans, transform):
    sets, rows = random_sets(2)
    games, members = spark.createDataFrame(sets, GAME), spark.createDataFrame(rows, MEMBER)
    named = {"with_game_name": True} if transform == "merge_set_named" else {}
    plans.append(planned(getattr(transforms, transform.removesuffix("_named"))(games, members, **named)))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
