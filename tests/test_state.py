"""State transitions, settings and presets, the second planning pass."""

from test_plan import frame, node

from tallyforge.operators import state
from tallyforge.operators.rules import apply_preset
from tallyforge.plans import fixes


def test_transitions(spark):
    rows = [("a/b", "InDatCollect", "Got"), ("a/c", "NotInDat", "Got"), ("ab", "NotInDat", "Got"), (None, None, None)]
    df = spark.createDataFrame(rows, "path string, dat_status string, got_status string")
    assert {(r.path, r.got_status) for r in state.mark_missing(df, ["a"]).collect()} == {("a/b", "NotGot"), ("ab", "Got"), (None, None)}
    assert {(r.path, r.dat_status) for r in state.holding_area(df, ["a/"]).collect()} == {("a/b", "InDatCollect"), ("a/c", "InToSort"), ("ab", "NotInDat"), (None, None)}
    c = spark.createDataFrame([("x/1", 5), ("y", 6)], "path string, date_modified bigint")
    assert {tuple(r) for r in state.refresh_catalogs(c, "x").collect()} == {("x/1", state.NEVER), ("y", 6)}


def test_scans(spark):
    m = spark.createDataFrame([("a", "1", "2", "3"), ("a", "1", None, "3"), ("b", "1", "2", "3")], "archive string, crc string, sha1 string, md5 string")
    assert {tuple(r) for r in state.deep_scanned(m).collect()} == {("a", False), ("b", True)}
    prior = spark.createDataFrame([("p", 1, 1, True), ("q", 1, 1, False), ("r", 1, 1, True)], "path string, modified int, size int, deep boolean")
    now = spark.createDataFrame([("p", 1, 1), ("q", 1, 1), ("r", 2, 1), ("s", 1, 1)], "path string, modified int, size int")
    paths = lambda n: {r.path for r in state.needs_rescan(prior, now, n).collect()}
    assert paths(1) == {"r", "s"} and paths(2) == {"q", "r", "s"} and paths(3) == {"p", "q", "r", "s"}


def test_settings_and_presets(spark):
    s = state.Settings("root", True, ["*.tmp", "regex:^x"], [{"dir_key": "a/b", "merge": "split"}, {"dir_key": "a\\b\\", "merge": "none"}], [])
    assert state.Settings.from_xml(s.to_xml()) == s
    assert [tuple(r) for r in s.rule_table(spark).collect()] == [("a\\b", "split")]
    preset = state.read_preset(spark, state.preset_xml([("p", False, True)]))
    nodes = spark.createDataFrame([("p", True), ("q", True)], "path string, selected boolean")
    assert {tuple(r) for r in apply_preset(nodes, preset).collect()} == {("p", False), ("q", True)}


def test_second_pass_undoes_complete_only_and_renames(spark):
    rows = [node(1, 5, "InDatCollect", "Got", game="g"), node(2, 6, "InDatCollect", "NotGot", game="g"), node(3, 7, "InDatCollect", "NotGot", game="h", archive="x", file_type="FileZip"), node(4, 7, "InToSort", "Got", archive="x", file_type="FileZip")]
    first = {r.node_id: r.plan_status for r in fixes.complete_only(fixes.plan_fixes(frame(spark, rows))[0]).collect()}
    assert first == {"n0001": "IncompleteRemove", "n0002": "Missing", "n0003": "CanBeFixed", "n0004": "Rename"}
    both = {r.node_id: r.plan_status for r in fixes.two_pass_plan(frame(spark, rows)).collect()}
    assert both == {"n0001": "Correct", "n0002": "Missing", "n0003": "CanBeFixed", "n0004": "Rename"}
